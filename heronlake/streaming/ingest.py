"""Structured Streaming forms: idempotent ingest of files, delayed polling with an attempt limit, force latches, and the scheduler's ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from heronlake.operators import sync
from heronlake.operators.state import SnapshotStore

#: Folders of an ingest's key index.
KEY_BUCKETS = 256


def _fs(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ingest(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "document_id", once: bool = True) -> StreamingQuery:
    """Write transform(batch) of a stream as Parquet under target/rows, each key once, also if a batch is replayed.

    Of a batch's rows with one key the first by all columns counts. Known keys stand in target/keys, in folders by hash; a batch reads only those
    of its own keys. A batch's files go to folders of its own id, which a replay overwrites and doesn't count as known. Keys are those
    of the batch, whatever transform makes of its rows: one that it drops is known too.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(KEY_BUCKETS)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [F.col(c) for c in batch.columns if c != key]
        fresh = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*rest) if rest else Window.partitionBy(key).orderBy(key))).where("_n = 1").drop("_n").withColumn("_b", bucket)
        fs, path = _fs(spark, f"{target}/keys")
        if fs.exists(path):
            mine = [r["_b"] for r in fresh.select("_b").distinct().collect()]  # at most KEY_BUCKETS rows
            known = spark.read.parquet(f"{target}/keys").where(F.col("_b").isin(mine) & (F.col("epoch") != epoch)).select(key)
            fresh = fresh.join(known, key, "left_anti")
        transform(fresh.drop("_b")).write.mode("overwrite").parquet(f"{target}/rows/epoch={epoch}")
        for b in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/keys/_b=*/epoch={epoch}")) or []:
            fs.delete(b.getPath(), True)
        fresh.select(key, "_b").withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("_b", "epoch").parquet(f"{target}/keys")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


POLL = "job_id string, attempts int, status string, poll boolean"


def poll_step(state: tuple[int, str], ready: bool | None, max_attempts: int) -> tuple[int, str]:
    """(attempts, status) after one poll result: ready, not ready, or None for a poll that brought nothing before its delay ended."""
    attempts, status = state
    if status != "pending":
        return state
    attempts += 1
    return attempts, "done" if ready else "failed" if attempts >= max_attempts else "pending"


def poll_states(events: DataFrame, max_attempts: int, delay_ms: int = 10_000) -> DataFrame:
    """State of each job after its poll results: (job_id, attempts, status, poll), updated as results come.

    events: job_id, ready (boolean), at. A job is done at its first ready result and failed when the attempts are used up. A job without a result within
    delay_ms uses up an attempt and asks to be polled again (poll). A job that has ended keeps its state for one more delay, so that late results find it, and is then forgotten.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, "pending")
        if state.hasTimedOut:
            if now[1] != "pending":
                state.remove()
                return
            now = poll_step(now, None, max_attempts)
            poll = now[1] == "pending"
        else:
            for ready in pd.concat(list(frames)).sort_values("at")["ready"]:
                now = poll_step(now, bool(ready), max_attempts)
            poll = False
        state.update(now)
        state.setTimeoutDuration(delay_ms)
        yield pd.DataFrame({"job_id": [key[0]], "attempts": [now[0]], "status": [now[1]], "poll": [poll]})

    return events.groupBy("job_id").applyInPandasWithState(step, POLL, "attempts int, status string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def latches(events: DataFrame) -> DataFrame:
    """Force latch of each knowledge base: requests set it (many count as one), a consumed run clears it, a run that fails sets it again: (kb_id, forced, requests).

    events: kb_id, kind (`request`, `consume` or `fail`), at.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        forced, n = state.get if state.exists else (False, 0)
        for kind in pd.concat(list(frames)).sort_values("at")["kind"]:
            forced, n = (kind != "consume", n + (kind == "request"))
        state.update((bool(forced), int(n)))
        yield pd.DataFrame({"kb_id": [key[0]], "forced": [forced], "requests": [n]})

    return events.groupBy("kb_id").applyInPandasWithState(step, "kb_id string, forced boolean, requests int", "forced boolean, requests int", "update", "NoTimeout")


def schedule(ticks: DataFrame, bases: SnapshotStore, active: Callable[[], DataFrame], limit: int, start: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """The scheduler as a stream of ticks (tick: timestamp): at each batch the bases that are due at its latest tick are admitted and given to start, and get their next time.

    bases: a snapshot store of (kb_id, connection_id, cron, next_at); active: running jobs, (connection_id, n). The latest tick is one value, so the
    due scan is a filter on next_at. A replayed batch finds its snapshot and does nothing; one that ended between start and its snapshot
    starts the same jobs again under the same number, so start must take a job that it has started in this batch once.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        name = f"tick-{epoch:012d}"
        tick = batch.agg(F.max("tick")).first()[0]
        before = bases.current()
        if tick is None or (before or "").startswith("tick-") and before >= name:
            return
        admitted, moved = sync.scheduled(bases.read(), active(), F.lit(tick), limit)
        start(admitted, epoch)
        bases.write(moved, name, before)

    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def due(schedules: DataFrame, tick) -> DataFrame:
    """Knowledge bases that are due at a tick (a column or a time). schedules: kb_id, next_sync_at (null: never)."""
    return schedules.where(F.col("next_sync_at") <= tick).select("kb_id")
