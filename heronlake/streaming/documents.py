"""The way of a document through parsing and indexing, as a stateful stream with named state variables, timers and time to live.

Events (event_id, document_id, event, at) move a document on; each step gives the task to do next:

    registered -> task parse -> parse_started -> task poll -> (parse_pending -> task poll again, later) -> parsed -> task index -> indexed -> done

A task that nobody answers in time is given again by a timer, with the next attempt, until attempts run out and the document has failed. `failed` ends it at once, and
`registered` starts it anew. Task ids follow from document, round, kind and attempt, so a batch that is computed twice gives the same tasks. Events known by their id
are passed over (remembered for a time), and so are events that don't belong to the present step.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "document_id string, stage string, task string, task_id string, attempt int, due timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (stage, event) -> (next stage, its task); a task of None ends the way.
STEPS = {
    ("parsing", "parse_started"): ("polling", "poll"), ("parsing", "parsed"): ("indexing", "index"), ("polling", "parsed"): ("indexing", "index"),
    ("indexing", "indexed"): ("done", None), ("parsing", "failed"): ("failed", None), ("polling", "failed"): ("failed", None), ("indexing", "failed"): ("failed", None),
}
TASKS = {"parsing": "parse", "polling": "poll", "indexing": "index"}


class DocumentSteps(StatefulProcessor):
    def __init__(self, timeout: timedelta, poll_delay: timedelta, attempts: int, remembered: timedelta, wall_clock: bool = False):
        self.timeout, self.poll_delay, self.attempts, self.remembered, self.wall_clock = timeout, poll_delay, attempts, remembered, wall_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "stage string, round int, attempt int")
        # by the wall clock Spark forgets old entries itself; by the events' own time that is done here
        self.seen = handle.getMapState("seen", "event_id string", "ms long", _ms(self.remembered) if self.wall_clock else None)

    def _timer(self, ms: int | None) -> None:
        """The document's only timer: at a time (milliseconds), or none."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ms is not None:
            self.handle.registerTimer(ms)

    def _give(self, key: str, stage: str, round_: int, attempt: int, ms: int, delay: timedelta = timedelta()) -> tuple:
        """Enter a stage, or its next attempt: its row of output."""
        task = TASKS.get(stage)
        if task and attempt > self.attempts:
            stage, task, attempt = "failed", None, attempt - 1
        self.at.update((stage, round_, attempt))
        due = ms + _ms(delay)
        self._timer(due + _ms(self.timeout) if task else None)
        return key, stage, task, f"{key}:{round_}:{task}:{attempt}" if task else None, attempt, pd.Timestamp(due, unit="ms") if task else None

    def _event(self, key: str, event: str, ms: int) -> tuple | None:
        stage, round_, attempt = self.at.get() if self.at.exists() else ("new", 0, 0)
        if event == "registered":
            return self._give(key, "parsing", round_ + 1, 1, ms)
        if (stage, event) == ("polling", "parse_pending"):
            return self._give(key, stage, round_, attempt + 1, ms, self.poll_delay)
        if (stage, event) in STEPS:
            return self._give(key, STEPS[stage, event][0], round_, 1, ms)
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        out = []
        for event_id, event, at in zip(events["event_id"], events["event"], events["at"], strict=True):
            ms = timerValues.getCurrentProcessingTimeInMs() if self.wall_clock else int(at.timestamp() * 1000)
            if not self.seen.containsKey((event_id,)):
                self.seen.updateValue((event_id,), (ms,))
                out.append(self._event(key[0], event, ms))
        if not self.wall_clock:
            for name in [k for k, v in self.seen.iterator() if v[0] < timerValues.getCurrentWatermarkInMs() - _ms(self.remembered)]:
                self.seen.removeKey(name)
        yield _frame([r for r in out if r])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stage, round_, attempt = self.at.get()
        yield _frame([self._give(key[0], stage, round_, attempt + 1, expiredTimerInfo.getExpiryTimeInMs())] if stage in TASKS else [])

    def close(self) -> None:
        pass


def _ms(time: timedelta) -> int:
    return int(time.total_seconds() * 1000)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["document_id", "stage", "task", "task_id", "attempt", "due"])
    return out.astype({"attempt": "int32", "due": "datetime64[us]"})


def document_tasks(
    events: DataFrame, timeout: timedelta, poll_delay: timedelta = timedelta(), attempts: int = 5, remembered: timedelta = timedelta(days=7), late: str = "0 seconds", wall_clock: bool = False
) -> DataFrame:
    """The tasks that a stream of events (event_id, document_id, event, at) gives: OUTPUT. Timers follow the events' own time (the watermark, `late` behind), or the wall clock. The session's state store must be PROVIDER."""
    steps = DocumentSteps(timeout, poll_delay, attempts, remembered, wall_clock)
    marked = events if wall_clock else events.withWatermark("at", late)
    return marked.groupBy("document_id").transformWithStateInPandas(steps, OUTPUT, "append", "ProcessingTime" if wall_clock else "EventTime")
