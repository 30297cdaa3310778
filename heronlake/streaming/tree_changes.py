"""Incremental listing of remote trees: a streaming data source whose offset is the safe watermark of each root.

A batch lists every root once more, a task a root, and keeps the documents edited after the root's watermark, or at an unknown time. When they are processed, their outcomes move the
watermarks (sync.safe_watermarks), which are written to the state folder as a mark; the next batch starts there. A document that fails therefore holds its root's watermark back and comes again, an
incomplete listing moves nothing, and a restarted stream lists only what has changed. Documents that have gone can't be seen this way; sync.sync_diff of a whole listing finds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from heronlake.operators.sync import safe_watermarks
from heronlake.sources.connector import NODES, Recoverable, connector_of, edit_time
from heronlake.sources.objects import file_system

#: Nodes, and for each root a last row (ended) with its warning, if the listing is incomplete. since: the root's watermark before, in microseconds.
CHANGES = f"{NODES}, round long, since long, ended boolean"


def newest_mark(state: str) -> tuple[int, dict[str, int]]:
    """(round, watermark of each root in microseconds) of the newest mark; round -1 if there is none."""
    system, path = file_system(state)
    found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/marks", allow_not_found=True))
    rounds = [int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json")]
    if not rounds:
        return -1, {}
    with system.open_input_stream(f"{path}/marks/{max(rounds):012d}.json") as f:
        return max(rounds), json.loads(f.read())


def write_mark(state: str, round_: int, marks: dict[str, int]) -> None:
    """Write a round's mark, whole or not at all. Older ones but the one before it go."""
    system, path = file_system(state)
    system.create_dir(f"{path}/marks", recursive=True)
    with system.open_output_stream(f"{path}/marks/{round_:012d}.tmp") as f:
        f.write(json.dumps(marks).encode())
    system.move(f"{path}/marks/{round_:012d}.tmp", f"{path}/marks/{round_:012d}.json")
    for x in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/marks")):
        if x.base_name < f"{round_ - 1:012d}.json":
            system.delete_file(x.path)


@dataclass
class Listing(InputPartition):
    """One root, listed by one task."""

    root: str
    round: int
    since: int | None


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.connector, self.state = options["connector"], options["state"]
        self.roots = [r.strip() for r in options["roots"].split(",") if r.strip()]

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"round": -1, "since": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        done, marks = newest_mark(self.state)
        return {"round": done + 1, "since": marks}

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        return [] if start == end else [Listing(r, end["round"], end["since"].get(r)) for r in self.roots]

    def read(self, partition: Listing) -> Iterator[tuple]:
        root, n, warning, own = partition.root, 0, None, (partition.round, partition.since)
        try:
            for page in connector_of(self.connector).pages(root):
                for x in page:
                    at = edit_time(x)
                    if at is None or partition.since is None or _micros(at) > partition.since:
                        yield root, x.get("token"), x.get("parent_token"), x.get("title"), bool(x.get("has_document")), at, n, None, *own, False
                    n += 1
        except Recoverable as e:
            warning = str(e) or "listing ended early"
        yield root, None, None, None, False, None, n, warning, *own, True


def _micros(at) -> int:
    return int(at.timestamp()) * 1_000_000 + at.microsecond


class TreeChanges(DataSource):
    """Format `heronlake_tree_changes`: options connector (module:class), roots (separated by commas) and state (a shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "heronlake_tree_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ChangeReader(dict(self.options))


def follow(spark: SparkSession, connector: str, roots: list[str], state: str, process: Callable[[DataFrame, int], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give each batch's changed nodes to process(nodes, round), which returns (root, token, success), and move the watermarks by it.

    A batch that ended before its mark is listed and processed again under the same round, so process must be repeatable. Where no checkpoint is left, the marks in the state folder still say where to start.
    """
    spark.dataSource.register(TreeChanges)
    changes = spark.readStream.format("heronlake_tree_changes").option("connector", connector).option("roots", ",".join(roots)).option("state", state).load()

    def run(batch: DataFrame, epoch: int) -> None:
        own = f"{state}/batch-{epoch:012d}"
        batch.write.mode("overwrite").parquet(f"{own}/listing")  # the remote tree is read once
        listed = spark.read.parquet(f"{own}/listing")
        ends = listed.where("ended").select("root", "round", "since", F.timestamp_micros("since").alias("previous"), F.col("warning").isNull().alias("complete"))
        first = ends.select("round").first()
        if first is not None:
            nodes = listed.where("not ended").drop("warning", "ended", "round", "since")
            process(nodes, first["round"]).select("root", "token", "success").write.mode("overwrite").parquet(f"{own}/outcomes")
            marks = safe_watermarks(nodes, spark.read.parquet(f"{own}/outcomes"), ends).select("root", F.unix_micros("watermark").alias("at")).collect()  # a row a root
            kept = newest_mark(state)[1]  # a root that isn't followed now keeps its mark
            write_mark(state, first["round"], {**kept, **{r["root"]: r["at"] for r in marks if r["at"] is not None}})
        system, path = file_system(own)
        system.delete_dir(path)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
