"""An inverted index that follows publications: segments of changes, tombstones, and a merge by size.

A change (entries published, entries gone) is one new segment: the postings of what came, in blocks, and the ids of what went. An older segment's
posting counts unless a later segment names its entry as gone. So a publication costs what it changes, not a new index. Segments are merged
when the newer ones together come near the size of an older one: each posting is then rewritten a number of times that grows with the
logarithm of the index. Which segments count is a snapshot of a small list; readers that started before a change go on with theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.functions.text import tokens
from heronlake.operators.index import all_positions, block_search, exploded, of_terms, write_blocks
from heronlake.operators.retrieval import KEYWORD_K, few_terms
from heronlake.operators.state import SnapshotStore

#: A segment is merged with the newer ones once it has at most so many times their entries.
RATIO = 4
#: Tombstones that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_LIST = "segment long, folder string, entries long, gone long"


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that became published, entry_id of those that ceased to be) between two states of a table of entries (entry_id, state, ...)."""
    old, new = before.where("state = 'published'").select("entry_id"), after.where("state = 'published'")
    return new.join(old, "entry_id", "left_anti"), old.join(new.select("entry_id"), "entry_id", "left_anti")


class LivePostings:
    """Index of entries (entry_id, [by], text) in a folder; text_col names their text."""

    def __init__(self, spark: SparkSession, path: str, by: str | None = None, text_col: str = "text", split: Callable[[Column], Column] = tokens):
        self.spark, self.path, self.by, self.text_col, self.split = spark, path.rstrip("/"), by, text_col, split
        self.store = SnapshotStore(spark, f"{self.path}/list")

    def segments(self) -> list:
        """The segments that count, oldest first."""
        return sorted(self.store.read().collect(), key=lambda r: r["segment"]) if self.store.current() else []

    def _point(self, rows: list[tuple], expected: str | None) -> None:
        self.store.write(self.spark.createDataFrame(rows, _LIST).coalesce(1), uuid.uuid4().hex, expected)

    def _write(self, postings: DataFrame, gone: DataFrame) -> str:
        folder = f"{self.path}/{uuid.uuid4().hex}"
        write_blocks(postings, f"{folder}/blocks", self.by)
        gone.write.parquet(f"{folder}/gone")
        return folder

    def apply(self, came: DataFrame, gone: DataFrame) -> None:
        """One change: entries that came (new ones, or known ones with a new text), and ids (entry_id) of those that went."""
        expected, have = self.store.current(), self.segments()
        groups = [self.by] if self.by else []
        ids = gone.select("entry_id").unionByName(came.select("entry_id")).distinct()
        if not have:
            ids = ids.where("false")
        folder = self._write(all_positions(came, self.text_col, ["entry_id", *groups], self.split), ids)
        new = (have[-1]["segment"] + 1 if have else 0, folder, came.count(), self.spark.read.parquet(f"{folder}/gone").count())
        self._point([*(tuple(r) for r in have), new], expected)

    def _dead(self, segments: list) -> DataFrame:
        """(entry_id, _until): an entry's postings of segments before _until don't count."""
        out = None
        for r in segments:
            if r["gone"]:
                one = self.spark.read.parquet(f"{r['folder']}/gone").select("entry_id", F.lit(r["segment"]).alias("_until"))
                out = one if out is None else out.unionByName(one)
        return out if out is None else out.groupBy("entry_id").agg(F.max("_until").alias("_until"))

    def _living(self, segments: list) -> Callable[[DataFrame], DataFrame]:
        dead, n = self._dead(segments), sum(r["gone"] for r in segments)
        if dead is None:
            return lambda postings: postings.drop("segment")
        dead = dead.withColumnRenamed("entry_id", "_entry")
        dead = F.broadcast(dead) if n <= MOST_BROADCAST else dead
        return lambda postings: postings.join(dead, (F.col("entry_id") == F.col("_entry")) & (F.col("segment") < F.col("_until")), "left_anti").drop("segment")

    def _blocks(self, segments: list, few: list[str] | None) -> DataFrame:
        out = None
        for r in segments:
            one = of_terms(self.spark, self.spark.read.parquet(f"{r['folder']}/blocks"), few).withColumn("segment", F.lit(r["segment"]))
            out = one if out is None else out.unionByName(one)
        return out

    def read(self, wanted: DataFrame) -> DataFrame:
        """Living postings of the terms wanted (query_id, term, n_terms), with the query."""
        have = self.segments()
        rows = exploded(self._blocks(have, few_terms(wanted)), ["term", *([self.by] if self.by else []), "segment"])
        return self._living(have)(rows).join(wanted, "term")

    def search(self, queries: DataFrame, k: int = KEYWORD_K, by: str | None = None) -> DataFrame:
        """As retrieval.keyword_top of the entries that are published now."""
        have = self.segments()
        if not have:
            raise FileNotFoundError(f"no segment in {self.path}")
        return block_search(self.spark, lambda few: self._blocks(have, few), queries, k, self.by, by, self.split, self._living(have), sum(r["gone"] for r in have))

    def merge(self, ratio: int = RATIO) -> int:
        """Merge the newest segments, as far back as each has at most `ratio` times the entries of those after it; gives how many were merged."""
        expected, have = self.store.current(), self.segments()
        many, total = 0, 0
        for r in reversed(have):
            if many and r["entries"] > ratio * max(total, 1):
                break
            many, total = many + 1, total + r["entries"]
        if many < 2:
            return 0
        old, new = have[:-many], have[-many:]
        groups = [self.by] if self.by else []
        living = self._living(new)(exploded(self._blocks(new, None), ["term", *groups, "segment"]))
        dead = self._dead(new) if old else None
        ids = (dead if dead is not None else self.spark.createDataFrame([], f"entry_id {living.schema['entry_id'].dataType.simpleString()}, _until long")).select("entry_id")
        folder = self._write(living, ids)
        rows = self.spark.read.parquet(f"{folder}/blocks")
        entries = rows.select(F.explode("ids").alias("id")).distinct().count()
        self._point([*(tuple(r) for r in old), (new[-1]["segment"], folder, entries, self.spark.read.parquet(f"{folder}/gone").count())], expected)
        return many
