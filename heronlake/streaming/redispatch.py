"""Work that was given out and never acknowledged, found by a stream-stream outer join and given out again."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: No task has this id: it marks ticks, which only move the watermark.
TICK = ""
_EVER = datetime(1, 1, 2)


def unanswered(dispatches: DataFrame, acks: DataFrame, timeout: timedelta, attempts: int = 5, late: str = "0 seconds", ticks: DataFrame | None = None) -> DataFrame:
    """(task_id, attempt, dispatched_at, status) of each dispatch that nobody acknowledged within timeout, once: `again` with the next attempt, or `lost` with the last one where attempts have run out.

    dispatches: task_id, attempt, at; acks: task_id, attempt, at; ticks: at. A dispatch that is written twice (same task, attempt and time) counts once. An acknowledgement counts
    if it has the dispatch's attempt and a time from the dispatch's to its time-out; rows without a task or time are passed over. State is kept for the time-out and `late` only.
    The watermark follows the slower of the two streams; where all workers are dead there are no acknowledgements, so ticks (of any clock) move both on.
    """
    sides = []
    for df in (dispatches, acks):
        side = df.select("task_id", F.col("attempt").cast("int").alias("attempt"), "at")
        side = side.where("task_id is not null and attempt is not null and at is not null")
        if ticks is not None:
            side = side.unionByName(ticks.select(F.lit(TICK).alias("task_id"), F.lit(0).alias("attempt"), "at"))
        sides.append(side)
    sent = sides[0].withWatermark("at", late).dropDuplicatesWithinWatermark(["task_id", "attempt"])
    seen = sides[1].select(F.col("task_id").alias("_task"), F.col("attempt").alias("_attempt"), F.col("at").alias("_at")).withWatermark("_at", late)
    span = F.expr(f"interval {int(timeout.total_seconds() * 1000)} milliseconds")
    both = sent.join(seen, (F.col("task_id") == F.col("_task")) & (F.col("attempt") == F.col("_attempt")) & (F.col("_at") >= F.col("at")) & (F.col("_at") <= F.col("at") + span), "left_outer")
    # a filter that names the time stays above the watermark, so that ticks still move it
    missing = both.where(F.col("_task").isNull() & ((F.col("task_id") != TICK) | (F.col("at") < F.lit(_EVER))))
    more = F.col("attempt") < attempts
    return missing.select("task_id", F.when(more, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.col("at").alias("dispatched_at"), F.when(more, "again").otherwise("lost").alias("status"))


def redispatch(
    dispatches: DataFrame, acks: DataFrame, ticks: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, timeout: timedelta, attempts: int = 5, late: str = "0 seconds", once: bool = True
) -> StreamingQuery:
    """Give what `unanswered` finds to send(rows, batch). A batch that is replayed after a crash has the same rows and number, so a queue that knows its tasks by id and attempt takes each once.

    What send gives out again it writes to the stream of dispatches with the time at which it did so.
    """
    writer = unanswered(dispatches, acks, timeout, attempts, late, ticks).writeStream.outputMode("append").foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
