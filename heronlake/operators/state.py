"""State transitions as functions: an old table and events give a new table, which is written as a new snapshot.

Nothing is updated in place; a pointer file names the snapshot that readers resolve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE_BATCH = 100


def stage(entries: DataFrame, new: DataFrame) -> DataFrame:
    """New staging rows replace those of the same generation and chunk."""
    staging = entries.where("state = 'staging'").join(new.select("generation_id", "chunk_id"), ["generation_id", "chunk_id"], "left_anti")
    return entries.where("state <> 'staging'").unionByName(staging).unionByName(new.withColumn("state", F.lit("staging")).select(*entries.columns))


def stage_problems(new: DataFrame, dimension: int) -> DataFrame:
    """(chunk_id, reason) of new staging rows that may not be staged: no lineage, blank text, a bad vector, or a chunk given twice."""
    from heronlake.functions.text import non_blank
    from heronlake.functions.vectors import valid

    twice = F.count("*").over(Window.partitionBy("generation_id", "chunk_id")) > 1
    reason = (
        F.when(F.col("generation_id").isNull() | F.col("chunk_id").isNull() | F.col("document_id").isNull(), "lineage").when(~non_blank(F.col("search_content")), "blank")
        .when(~F.coalesce(valid(F.col("embedding"), dimension), F.lit(False)), "vector").when(twice, "twice")
    )
    return new.select("chunk_id", reason.alias("reason")).where("reason is not null")


def publish(entries: DataFrame, published: DataFrame) -> DataFrame:
    """Publish documents: what they had published retires, what they had staged is published.

    published: document_id, generation_id, at. Other documents stay as they are.
    """
    event = published.select("document_id", "generation_id", F.col("at").alias("_at"))
    out = entries.join(event, ["document_id", "generation_id"], "left")
    hit = F.col("_at").isNotNull()
    state = F.when(hit & (F.col("state") == "published"), "retired").when(hit & (F.col("state") == "staging"), "published").otherwise(F.col("state"))
    published_at = F.when(hit & (F.col("state") == "staging"), F.col("_at")).otherwise(F.col("published_at"))
    retired_at = F.when(hit & (F.col("state") == "published"), F.col("_at")).otherwise(F.col("retired_at"))
    return out.select(*(c for c in entries.columns if c not in ("state", "published_at", "retired_at")), state.alias("state"), published_at.alias("published_at"), retired_at.alias("retired_at"))


def soft_delete(entries: DataFrame, documents: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete documents: their entries retire, they are marked, their file nodes go. gone: document_id, at."""
    mark = gone.select("document_id", F.col("at").alias("_at"))
    e = entries.join(mark, "document_id", "left")
    retired = e.select(*(c for c in entries.columns if c != "state"), F.when(F.col("_at").isNotNull(), "retired").otherwise(F.col("state")).alias("state"))
    d = documents.join(mark, "document_id", "left")
    deleted = d.select(*(c for c in documents.columns if c != "deleted_at"), F.coalesce("deleted_at", "_at").alias("deleted_at"))
    return retired, deleted, nodes.join(mark, "document_id", "left_anti")


def unused_sets(chunk_sets: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunk sets that no live entry refers to."""
    return chunk_sets.join(entries.where("state <> 'retired'").select("chunk_set_id"), "chunk_set_id", "left_anti")


def get_or_create(have: DataFrame, want: DataFrame, key: list[str]) -> DataFrame:
    """Rows of want whose natural key is new, added once each (the first by all columns)."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*(c for c in have.columns if c not in key)))
    return have.unionByName(want.withColumn("_n", n).where("_n = 1").join(have.select(*key), key, "left_anti").select(*have.columns))


def upsert(have: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key; at equal times a new row goes before one there is, then the larger by all columns."""
    rest = [F.desc(c) for c in have.columns if c not in (*key, order)]
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"), *rest))
    both = have.withColumn("_new", F.lit(0)).unionByName(new.select(*have.columns).withColumn("_new", F.lit(1)))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def cleanup_batches(keys: list[DataFrame], size: int = DELETE_BATCH) -> DataFrame:
    """(key, batch) of all object keys, each once, in order; batches of one size.

    Numbered without gathering all keys in a task: keys are sorted into range partitions, and each partition starts where those before it end.
    """
    every = keys[0]
    for k in keys[1:]:
        every = every.unionByName(k)
    once = every.where("key is not null").distinct()
    parts = max(int(once.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    part = once.repartitionByRange(parts, "key").withColumn("p", F.spark_partition_id())
    # partitions hold disjoint ranges of keys, so that a key's range (its smallest and largest) tells its place in any run of the plan
    ranges = part.groupBy("p").agg(F.min("key").alias("low"), F.count("*").alias("n")).orderBy("low").collect()  # one row a partition
    lows, before, total = [r["low"] for r in ranges], [], 0
    for r in ranges:
        before.append(total)
        total += r["n"]
    if not lows:
        return once.select("key", F.lit(0).cast("long").alias("batch"))
    at = F.aggregate(F.array(*map(F.lit, lows)), F.lit(-1), lambda acc, low: acc + F.when(F.col("key") >= low, 1).otherwise(0))
    placed = once.withColumn("r", at)
    n = F.row_number().over(Window.partitionBy("r").orderBy("key"))
    return placed.select("key", F.floor((F.get(F.array(*map(F.lit, before)), F.col("r")) + n - 1) / size).cast("long").alias("batch"))


def touch(keys: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Last use moves on only if it is unset or older than an interval."""
    old = F.col("last_used_at").isNull() | (F.col("last_used_at") <= now - F.make_dt_interval(secs=F.lit(seconds)))
    return keys.withColumn("last_used_at", F.when(old, now).otherwise(F.col("last_used_at")))


class SnapshotStore:
    """Immutable snapshots of a table under one folder, and a pointer to the current one; any Hadoop file system."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _marks(self) -> list[tuple[int, str]]:
        """(turn, snapshot) of all pointers, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        return sorted((int(n.split("-", 2)[1]), n.split("-", 2)[2]) for n in names if n.startswith("pointer-"))

    def current(self) -> str | None:
        """Name of the current snapshot: that of the first pointer of the highest turn."""
        marks = self._marks()
        return min(n for t, n in marks if t == marks[-1][0]) if marks else None

    def write(self, df: DataFrame, name: str, expected: str | None) -> None:
        """Write a snapshot and point to it, if the current one is still the expected one.

        The pointer is one empty file, made whole or not at all; a writer that dies before leaves nothing that stops the next. Of two
        writers of one turn, both of whose pointers then stand there, the one whose name sorts first has won, and the other is told so. That
        needs a file system that makes a file at once and lists it at once; elsewhere let one writer at a time work on a root.
        """
        if self.current() != expected:
            raise RuntimeError("the snapshot that this one rests on is not current")
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        marks = self._marks()
        turn = marks[-1][0] if marks else 0
        if self.current() != expected or not self._fs.createNewFile(self._path(f"pointer-{turn + 1:08d}-{name}")) or self.current() != name:
            raise RuntimeError("another writer was faster")

    def read(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}")
