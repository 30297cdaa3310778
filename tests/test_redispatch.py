"""Dispatches without an acknowledgement come back, once each, until attempts run out."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heronlake.operators import sync
from heronlake.streaming import redispatch
from heronlake.streaming.ingest import ingest

TASK = "task_id string, attempt int, at timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture
def world(spark, tmp_path):
    """Appends rows to the three streams and runs the query over one checkpoint; gives what it sent."""
    for name in ("dispatches", "acks", "ticks"):
        (tmp_path / name).mkdir()

    def at(m):
        return START + timedelta(minutes=m)

    def read(name, schema):
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    def run(tick, dispatches=(), acks=(), attempts=3):
        for name, rows in (("dispatches", dispatches), ("acks", acks)):
            if rows:
                spark.createDataFrame([(t, n, at(m)) for t, n, m in rows], TASK).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        if tick is not None:
            spark.createDataFrame([(at(tick),)], "at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        out = []
        query = redispatch.redispatch(
            read("dispatches", TASK), read("acks", TASK), read("ticks", "at timestamp"), lambda df, _: out.extend(df.collect()), str(tmp_path / "cp"), timedelta(minutes=10), attempts
        )
        query.awaitTermination(200)
        return sorted((r.task_id, r.attempt, r.status) for r in out)

    return run


def test_unanswered_come_back_once(world):
    assert world(0, [("a", 1, 0), ("b", 1, 0), ("c", 1, 1), ("a", 1, 0), (None, 1, 0)], [("b", 1, 3)]) == []
    assert world(5) == []
    assert world(30) == [("a", 2, "again"), ("c", 2, "again")]  # no acknowledgement moved the clock, the ticks did
    assert world(60) == []
    # the second attempt of one is answered, of the other too late and with the wrong attempt
    assert world(90, [("a", 2, 61), ("c", 2, 61)], [("a", 2, 65), ("c", 1, 65), ("c", 2, 72)]) == [("c", 3, "again")]
    assert world(120, [("c", 3, 91)]) == [("c", 3, "lost")]
    assert world(150) == []


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "workspace_id int, kb_id int, job_id int, type string, status string, created_at int, payload string")


def test_pending_cleanups_and_their_objects(spark):
    payload = '{"objects": [{"key": "a", "store": "raw"}, {"key": 5}, {"key": ""}, 7, null, {"store": "x"}, {"key": "b", "store": 3}, {"key": "c"}]}'
    jobs = _jobs(spark, [
        (1, 1, 1, "source_cleanup", "pending", 1, payload), (1, 1, 2, "source_cleanup", "pending", 2, None), (2, 1, 3, "source_cleanup", "completed", 3, "{}"),
        (2, 1, 4, "parse", "pending", 4, '{"objects": 3}'), (2, 1, 5, "source_cleanup", "pending", 5, "not json"), (None, 1, 6, "source_cleanup", None, 6, "[]"),
    ])
    queued = spark.createDataFrame([("source_cleanup:1:2",), (None,)], "task_id string")
    assert [r.task_id for r in sync.pending_cleanups(jobs, queued).orderBy("created_at").collect()] == ["source_cleanup:1:1", "source_cleanup:2:5"]
    got = [(r.job_id, r.position, r.store, r.key) for r in sync.cleanup_objects(jobs).orderBy("position").collect()]
    assert [(j, s, k) for j, _, s, k in got] == [(1, "raw", "a"), (1, "", "b"), (1, "", "c")]
    assert sync.cleanup_objects(jobs.limit(0)).count() == 0


def test_ingest_knows_keys_that_the_transform_drops(spark, tmp_path):
    """A transform without the key column: a later batch's repeats are still known."""
    schema = "document_id string, text string"
    for text in ("one", "two"):
        spark.createDataFrame([("a", text), (text, text)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda df: df.select(F.upper("text").alias("t"))).awaitTermination(120)
    assert sorted(r.t for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == ["ONE", "ONE", "TWO"]
