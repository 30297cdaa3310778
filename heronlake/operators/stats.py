"""Statistics, listings, pages, trees and expectations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.operators.ancestry import creates_cycle, prunable  # noqa: F401  questions about trees are asked here

PAGE_LIMIT = 200
MAX_DEPTH = 64


def counts(df: DataFrame, keys: list[str] | None = None, **conditions: Column) -> DataFrame:
    """How many rows meet each condition, in all or by keys."""
    aggs = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "n")


def next_number(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """A page by seek: rows after a position in an order of (column, descending), one more than limit to tell if others follow."""
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be 1 to {PAGE_LIMIT}")
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after, strict=True):
            past = past | (same & (F.col(name) < F.lit(value) if down else F.col(name) > F.lit(value)))
            same = same & (F.col(name) == F.lit(value))
        df = df.where(past)
    return df.orderBy(*(F.desc(n) if down else F.asc(n) for n, down in order)).limit(limit + 1)


def generation_stats(documents: DataFrame, chunk_sets: DataFrame, chunks: DataFrame, revisions: DataFrame, entries: DataFrame) -> DataFrame:
    """By knowledge base: documents, chunks of their effective sets, published entries, manual edits, disabled, missing sets and revisions.

    documents: kb_id, document_id, active_revision_id; chunk_sets: chunk_set_id, document_id, revision_id, status, created_at;
    chunks: chunk_id, chunk_set_id, [active_revision_id]; revisions: chunk_id, edit_source, enabled, [revision_id]; entries: kb_id, state. Where
    chunks name their active revision only that one counts.
    """
    on = ["chunk_id", "active_revision_id"] if "active_revision_id" in chunks.columns else ["chunk_id"]
    revisions = revisions.withColumnRenamed("revision_id", "active_revision_id") if len(on) > 1 else revisions
    active = documents.where("active_revision_id is not null").select("kb_id", "document_id", F.col("active_revision_id").alias("revision_id"))
    ready = latest(chunk_sets.where("status = 'ready'"), ["document_id", "revision_id"], [F.desc("created_at"), F.desc("chunk_set_id")])
    effective = active.join(ready.select("document_id", "revision_id", "chunk_set_id"), ["document_id", "revision_id"], "left")
    rev = revisions.select(*on, "edit_source", "enabled", F.lit(True).alias("found"))
    detail = effective.join(chunks, "chunk_set_id", "left").join(rev, on, "left")
    one = detail.groupBy("kb_id").agg(
        F.count_distinct("document_id").alias("document_count"), F.count("chunk_id").alias("chunk_count"), F.count_if(F.col("edit_source") == "user").alias("manual_edit_count"),
        F.count_if(~F.col("enabled")).alias("disabled_chunk_count"), F.count_if(F.col("chunk_set_id").isNull()).alias("missing_chunk_set_count"),
        F.count_if(F.col("chunk_id").isNotNull() & F.col("found").isNull()).alias("missing_revision_count"),
    )
    published = entries.where("state = 'published'").groupBy("kb_id").agg(F.count("*").alias("indexed_count"))
    return one.join(published, "kb_id", "left").withColumn("indexed_count", F.coalesce("indexed_count", F.lit(0)))


def complete(stats: DataFrame) -> DataFrame:
    """The rows of generation_stats, but the job ends with an error at a base whose projection is incomplete: chunk sets or revisions are missing, or more is indexed than there are chunks."""
    bad = (F.col("missing_chunk_set_count") != 0) | (F.col("missing_revision_count") != 0) | (F.col("indexed_count") > F.col("chunk_count"))
    said = F.format_string("incomplete projection of %s: missing_chunk_sets=%d missing_revisions=%d indexed=%d chunks=%d", F.col("kb_id").cast("string"), *(F.col(c) for c in ("missing_chunk_set_count", "missing_revision_count", "indexed_count", "chunk_count")))
    return stats.withColumn("chunk_count", F.when(bad, F.raise_error(said).cast("long")).otherwise(F.col("chunk_count")))


def _view(df: DataFrame) -> str:
    """df under a view name of its own."""
    name = f"heronlake_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def tree_paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, path, depth) of every node under a root, at most max_depth levels down. nodes: id, parent_id (null for roots), name, node_type.

    One join a level; each level joins only its own nodes. Nodes that aren't reached are in tree_problems.
    """
    view = _view(nodes.select("id", "parent_id", "name"))
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE t(id, path, depth) AS (
            SELECT id, CAST('/' AS STRING), 0 FROM {view} WHERE parent_id IS NULL
            UNION ALL
            SELECT n.id, CASE WHEN t.depth = 0 THEN concat('/', n.name) ELSE concat(t.path, '/', n.name) END, t.depth + 1
            FROM t JOIN {view} n ON n.parent_id = t.id WHERE t.depth < {max_depth})
        SELECT id, path, depth FROM t LIMIT ALL""")  # LIMIT ALL lifts Spark's limit on the rows of a recursion


def tree_problems(nodes: DataFrame) -> DataFrame:
    """(id, problem) of the nodes that no path reaches: `orphan` (its parent is absent), or `unreachable` (below an orphan, on or below a cycle, or too deep)."""
    lost = nodes.select("id", "parent_id").join(tree_paths(nodes).select("id"), "id", "left_anti")
    parent = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    return lost.join(parent, "parent_id", "left").select("id", F.when(F.col("_there").isNull(), "orphan").otherwise("unreachable").alias("problem"))


def tree_rows(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, path, depth, place): paths, and each node's place among its siblings by kind (files first), name in any case, and id."""
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("node_type", F.lower("name"), "id"))
    return nodes.withColumn("place", place).join(tree_paths(nodes), "id").select("id", "parent_id", "path", "depth", "place")


def deletion_order(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, depth, turn) of the nodes to delete, the deepest in turn 0; nodes of one turn don't contain each other. gone: id."""
    deep = tree_paths(nodes).join(gone.select("id"), "id", "left_semi").select("id", "depth")
    most = deep.agg(F.max("depth").alias("most"))
    return deep.crossJoin(F.broadcast(most)).select("id", "depth", (F.col("most") - F.col("depth")).alias("turn"))  # one row


def child_counts(nodes: DataFrame) -> DataFrame:
    """(id, n_children) of every folder."""
    n = nodes.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return nodes.where("node_type = 'folder'").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_children"))


def parents_of(remote: DataFrame, known: DataFrame, root: Column) -> DataFrame:
    """(token, parent_node_id, outcome) of remote nodes: the node of the parent token, the root where there is none, or outcome `failed` if the parent isn't known.

    remote: token, parent_token; known: token, node_id (stored nodes, and folders just written).
    """
    k = known.select(F.col("token").alias("parent_token"), F.col("node_id").alias("_node"))
    top = F.coalesce(F.btrim("parent_token"), F.lit("")) == ""
    node = F.when(top, root).otherwise(F.col("_node"))
    return remote.join(k, "parent_token", "left").select("token", node.alias("parent_node_id"), F.when(node.isNull(), "failed").otherwise("ok").alias("outcome"))


def tree_rules(nodes: DataFrame) -> dict[str, DataFrame]:
    """Rows that break a rule of file trees. nodes: kb_id, id, parent_id, name, node_type."""
    clean = F.btrim(F.coalesce("name", F.lit("")))
    names = nodes.where("parent_id is not null")
    return {
        "one_root_a_base": duplicates(nodes.where("parent_id is null"), ["kb_id"]),
        "sibling_names_differ": duplicates(names.withColumn("lower_name", F.lower("name")), ["kb_id", "parent_id", "lower_name"]),
        "name_is_one_segment": names.where((clean == "") | clean.isin(".", "..") | F.col("name").rlike(r"[/\\\x00]")),
        "parent_is_a_folder": names.join(nodes.where("node_type = 'folder'").select(F.col("id").alias("parent_id")), "parent_id", "left_anti"),
    }


def chunk_rules(chunks: DataFrame, generations: DataFrame) -> dict[str, DataFrame]:
    """Rows that break a rule of chunks and generations. chunks: chunk_set_id, chunk_id, role, parent_chunk_id, sequence; generations: kb_id, status, chunk_count, indexed_count."""
    return {
        "child_has_a_parent": chunks.where("(role = 'child') <> (parent_chunk_id is not null)"),
        "sequence_is_unique": duplicates(chunks, ["chunk_set_id", "role", "sequence"]),
        "one_building_generation": duplicates(generations.where("status = 'building'"), ["kb_id"]),
        "indexed_at_most_chunks": generations.where("indexed_count > chunk_count"),
    }


def expectations(entries: DataFrame, documents: DataFrame, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, n): how many rows break each integrity rule; all should be 0. more: further rules, as tree_rules and chunk_rules give them."""
    more = more or {}
    rules = [
        ("published_entry_is_complete", entries.where("state = 'published' and (embedding is null or published_at is null)")),
        ("one_published_entry_a_chunk", duplicates(entries.where("state = 'published'"), ["generation_id", "chunk_id"])),
        ("entry_has_document", entries.join(documents, "document_id", "left_anti")),
        ("document_name_not_blank", documents.where("trim(coalesce(name, '')) = ''")),
        *more.items(),
    ]
    out = None
    for name, df in rules:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out
