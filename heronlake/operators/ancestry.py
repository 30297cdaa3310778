"""Questions about the ancestors of tree nodes, at any depth, by pointer doubling: log2(depth) equi-joins instead of one a level."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one, made once a session, where a local session has none set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='heronlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared checkpoint folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Forest:
    """Jump tables of nodes (id, parent_id): level k holds (id, up), where up is 2^k levels above; nodes with fewer ancestors aren't in it.

    Ways end at roots and at parents that aren't nodes. Levels are added until one is empty. Where parents run in a circle none ever is,
    so they end when 2^k exceeds the number of edges, too; the last level then leads to the nodes of the circles.
    """

    def __init__(self, nodes: DataFrame):
        ids = nodes.select(F.col("id").alias("up"))
        self.edges = cut(nodes.select("id", F.col("parent_id").alias("up")).join(ids, "up", "left_semi").select("id", "up"))
        self.levels = [self.edges]
        most = self.edges.count()
        while 2 ** len(self.levels) <= 2 * most:
            last = self.levels[-1]
            higher = cut(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("higher")), "up").select("id", F.col("higher").alias("up")))
            if higher.isEmpty():
                break
            self.levels.append(higher)
        self.circular = most > 0 and 2 ** (len(self.levels) - 1) > most  # a way longer than all edges

    def circles(self) -> DataFrame:
        """(id) of the nodes that lie on a circle."""
        last = self.levels[-1] if self.circular else self.edges.where("false")
        return last.select(F.col("up").alias("id")).distinct()

    def opened(self) -> tuple[Forest, DataFrame]:
        """The forest with one edge of each circle (that of its smallest id) taken away, and these edges (id, up)."""
        if not self.circular:
            return self, self.edges.where("false")
        least = self.circles().select("id", F.col("id").alias("least"))
        for level in self.levels:
            onward = level.join(least.select(F.col("id").alias("up"), F.col("least").alias("other")), "up").select("id", "other")
            least = cut(least.join(onward, "id").select("id", F.least("least", "other").alias("least")))
        gone = cut(self.edges.join(least.where("id = least").select("id"), "id", "left_semi"))
        nodes = self.edges.join(gone, "id", "left_anti").select("id", F.col("up").alias("parent_id"))
        return Forest(nodes.unionByName(self.edges.select(F.col("up").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").select("id", F.lit(None).cast(nodes.schema["parent_id"].dataType).alias("parent_id")))), gone

    def _jump(self, df: DataFrame, col: str, k: int, when: Column) -> DataFrame:
        """df with col moved 2^k levels up where `when` holds and there are so many, and whether it moved (_moved)."""
        up = self.levels[k].select(F.col("id").alias(col), F.col("up").alias("_up"))
        moves = when & F.col("_up").isNotNull()
        joined = df.join(up, col, "left")
        return joined.withColumn(col, F.when(moves, F.col("_up")).otherwise(F.col(col))).withColumn("_moved", moves).drop("_up")

    def climb(self, df: DataFrame, col: str, top: str, depth: str) -> DataFrame:
        """df with the last ancestor of col (itself, if it has none) and the number of levels to it. The forest has no circles."""
        out = df.withColumn(top, F.col(col)).withColumn(depth, F.lit(0).cast("long"))
        for k in reversed(range(len(self.levels))):
            out = self._jump(out, top, k, F.lit(True)).withColumn(depth, F.col(depth) + F.when(F.col("_moved"), 2**k).otherwise(0)).drop("_moved")
        return out

    def above(self, pairs: DataFrame) -> DataFrame:
        """The pairs (id, low, ...) whose id is low or an ancestor of it. The forest has no circles."""
        deep = self.climb(self.climb(pairs, "low", "_top", "_low_depth"), "id", "_other_top", "_id_depth").where("_low_depth >= _id_depth and (_top = _other_top)")
        deep = cut(deep.withColumn("_at", F.col("low")).withColumn("_left", F.col("_low_depth") - F.col("_id_depth")).drop("_top", "_other_top", "_low_depth", "_id_depth"))
        for k in range(len(self.levels)):
            deep = self._jump(deep, "_at", k, F.col("_left").bitwiseAND(2**k) != 0).drop("_moved")
        return deep.where("_at = id").select(*pairs.columns)


def creates_cycle(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """(move_id, cycle): whether a node would come to lie under itself, at any depth. nodes: id, parent_id; moves: move_id, id, new_parent_id.

    Trees that are circular already are walked all the same: from a new parent below or on a circle the way goes once around it.
    """
    forest, gone = Forest(nodes).opened()
    asked = moves.where("new_parent_id is not null").select("move_id", "id", F.col("new_parent_id").alias("low"))
    around = forest.climb(asked, "low", "_top", "_depth").join(gone.select(F.col("id").alias("_top"), F.col("up").alias("_next")), "_top").select("move_id", "id", F.col("_next").alias("low"))
    met = forest.above(asked.unionByName(around)).select("move_id").distinct().withColumn("_met", F.lit(True))
    return moves.select("move_id").join(met, "move_id", "left").select("move_id", F.col("_met").isNotNull().alias("cycle"))


def prunable(nodes: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing folders with nothing under them, at any depth, that is a file or a folder still there. nodes: id, parent_id, node_type; missing: id.

    What stays holds the missing folders above it, through missing folders only; folders that contain each other in a circle are never empty.
    """
    gone = missing.select("id", F.lit(True).alias("_gone")).distinct()
    state = nodes.join(gone, "id", "left").select("id", "parent_id", "node_type", F.coalesce("_gone", F.lit(False)).alias("_gone"))
    folders = state.where("_gone and node_type = 'folder'").select("id", "parent_id")
    stays = state.where("node_type = 'file' or not _gone").select(F.col("parent_id").alias("id"))
    forest = Forest(folders)
    held = cut(stays.join(folders.select("id"), "id", "left_semi").unionByName(forest.circles()).distinct())
    for level in forest.levels:
        held = cut(held.unionByName(level.join(held, "id", "left_semi").select(F.col("up").alias("id"))).distinct())
    return folders.select("id").join(held, "id", "left_anti")
