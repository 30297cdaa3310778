"""Line deduplication by distinct-site spread, in DataFrame functions only.

Lines (split at line feeds, trimmed of ASCII spaces, of MIN_WORDS words or more) are known by 96 bits of hashes. A HyperLogLog
sketch of each line's sites is built in every task and merged by aggregation, so a line that half of
all documents share costs one sketch a task. A line whose estimate is clear of the threshold is settled; those near it get exact
distinct counts. Lines on MIN_SITES sites or more are boilerplate: all their places but the first (smallest
document id, null ids last, then line number) are removed, so that no text leaves the corpus altogether.

Joins are equi-joins on line hashes between written tables, where Spark splits a hot line's rows.

Cases: null text stays null and has no lines; a null site counts as none; empty and short lines are never removed; rows that
repeat an id (or its absence) and text lose the same lines; an empty table gives an empty result; columns of the input
with the names of results are left out. The removed line numbers of a document follow its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import SPACES, Written, table

MIN_SITES = 8
MIN_WORDS = 3
LG_K = 10
WORD = r"[^\x20\x09-\x0D]+"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def lines(docs: DataFrame, site: str) -> DataFrame:
    """(doc_id, same, n, h1, h2, site): the lines that count; same tells texts of one id apart."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("same"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rows = rows.withColumn("line", _trim(F.col("line"))).where(F.length("line") >= 2 * MIN_WORDS - 1).where(F.regexp_count("line", F.lit(WORD)) >= MIN_WORDS)
    return rows.select("doc_id", "same", "n", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "site")


def _place() -> Column:
    """A line's place, which is never null and sorts by document id, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "n")


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): lines on min_sites sites or more, and the place of each that stays."""
    spread = found.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(_place()).alias("first"))
    margin = max(2.0, 4 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    guess = F.hll_sketch_estimate("sketch")
    likely = Written(spread.withColumn("sites", guess).where(F.col("sites") >= min_sites - margin).select("h1", "h2", "first", (F.col("sites") > min_sites + margin).alias("clear")), "likely-lines")
    near = likely.df.where("not clear").select("h1", "h2")
    exact = found.join(near, ["h1", "h2"], "left_semi").where("site is not null").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return likely.df.where("clear").select("h1", "h2", "first").unionByName(likely.df.where("not clear").join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with clean_text, n_lines and n_removed added."""
    added = ["clean_text", "n_lines", "n_removed"]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in [*added, "_same", "_gone"]))
    found = Written(lines(docs, site), "lines").df
    marks = Written(boilerplate(found, min_sites), "boilerplate").df
    gone = found.join(marks, ["h1", "h2"]).where(_place() != F.col("first")).groupBy("doc_id", "same").agg(F.collect_set("n").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("same").alias("_hash"), F.col("gone").alias("_gone"))
    out = docs.withColumn("_same", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_same") == F.col("_hash")), "left").drop("_same", "_doc", "_hash")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains("_gone", k)), "\n")
    n_lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0)).cast("long")
    return out.withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).withColumn("n_lines", n_lines).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")).drop("_gone")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "clean_text")


#: The same in DuckDB; {min_sites} sites, over a view with doc_id, source, text.
DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {docs} WHERE text IS NOT NULL),
c AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
k AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {min_words} AS counts FROM c),
b AS (SELECT line, min((doc_id, n)) AS first FROM k WHERE counts GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
j AS (SELECT k.doc_id, k.n, k.raw, coalesce(k.counts AND b.line IS NOT NULL AND (k.doc_id, k.n) <> b.first, false) AS gone FROM k LEFT JOIN b ON k.counts AND k.line = b.line),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT gone), '') AS clean_text FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed, s.clean_text FROM {docs} d LEFT JOIN s USING (doc_id)
"""
OP4_SQL = DEDUP_SQL.format(docs="documents", min_sites=MIN_SITES, min_words=MIN_WORDS)
