"""The document stream: steps, repeated events, restarts, attempts that run out."""

from datetime import datetime, timedelta

import pytest

from heronlake.streaming import documents

SCHEMA = "event_id string, document_id string, event string, at timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds batches of events one after the other through one checkpoint; gives what each run put out."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, documents.PROVIDER)
    fed = []

    def feed(*events):
        fed.append(len(fed))
        rows = [(f"{d}-{e}-{m}", d, e, START + timedelta(minutes=m)) for d, e, m in events]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = []
        tasks = documents.document_tasks(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), timedelta(minutes=10), timedelta(minutes=2), attempts=3)
        query = tasks.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.document_id, r.stage, r.task_id) for r in out)

    yield feed
    spark.conf.set(key, before)


def test_a_document_goes_its_way(stream):
    assert stream(("a", "registered", 0), ("b", "registered", 0)) == [("a", "parsing", "a:1:parse:1"), ("b", "parsing", "b:1:parse:1")]
    # a repeated event and one that doesn't belong here give nothing; a pending answer polls again
    got = stream(("a", "parse_started", 1), ("a", "parse_started", 1), ("a", "indexed", 1), ("a", "parse_pending", 2), ("a", "parsed", 3), ("b", "failed", 3))
    assert got == [("a", "indexing", "a:1:index:1"), ("a", "polling", "a:1:poll:1"), ("a", "polling", "a:1:poll:2"), ("b", "failed", None)]
    assert stream(("a", "parse_started", 1), ("a", "indexed", 4), ("b", "registered", 5)) == [("a", "done", None), ("b", "parsing", "b:2:parse:1")]


def test_unanswered_tasks_come_again_and_run_out(stream):
    assert stream(("a", "registered", 0)) == [("a", "parsing", "a:1:parse:1")]
    found = []
    for minute in (15, 26, 40):  # another document's events move time on
        found += [r for r in stream((f"x{minute}", "registered", minute)) if r[0] == "a"]
    assert found == [("a", "parsing", "a:1:parse:2"), ("a", "parsing", "a:1:parse:3"), ("a", "failed", None)]


def test_wall_clock_with_time_to_live(spark, tmp_path):
    """By the wall clock, a repeated event within the time to live is passed over."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", documents.PROVIDER)
    out = []
    for _ in range(2):
        spark.createDataFrame([("e1", "a", "registered", START)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tasks = documents.document_tasks(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), timedelta(hours=1), wall_clock=True)
        tasks.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.document_id, r.task_id) for r in out] == [("a", "a:1:parse:1")]
