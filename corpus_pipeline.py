"""The corpus pipeline: quality rules, language identification, line dedup, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import best_fit_packing, language_id, line_dedup, quality_rules
from heronlake.llm import near_copies as copies
from heronlake.llm.common import Scratch, Written, fold, table

#: A document nearer than this to no language profile at all is rejected by the language stage.
MIN_SIMILARITY = 0.2


def _wrapped(docs: DataFrame) -> DataFrame:
    """docs with all columns also in one struct, so that no name of theirs meets an operator's own; the struct's text is null, as a new one comes, so that texts are shuffled once."""
    return docs.withColumn("document", F.struct(*(F.lit(None).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns)))


def _with_text(df: DataFrame) -> DataFrame:
    """The columns of the struct, with clean_text as text."""
    text = F.col("clean_text")
    return df.select(F.col("document").withField("text", text).withField("n_chars", F.length(text).cast("long")).alias("document")).select("document.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines; n_chars follows the text. Bytes that aren't UTF-8 become U+FFFD, as later stages decode texts in Python."""
    return _with_text(quality_rules.judged(_wrapped(docs).select("document", F.make_valid_utf8("text").alias("text"))).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages; `und` and texts unlike any profile go."""
    profiles = language_id.learn(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold("doc_id", 5) != 0)
    return language_id.keep(docs, profiles, MIN_SIMILARITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated places of cross-site lines; n_chars follows the text."""
    out = line_dedup.dedup(_wrapped(docs).select("document", "doc_id", "source", "text"))
    return _with_text(out)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), one row: that of the smallest id, or of a null id if there is no other."""
    return copies.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    import public_tokenizers

    return best_fit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_copies", near_copies), ("packing", packing)]
#: Tokenising and SimHash are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. A stage's own tables, and what the stage before it left, are deleted when its result is written; the last stage's stay for the reader."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scratch() as own:
            done = own.keep(Written(stage(spark, docs, sf_dir), name))
        if last is not None:
            last.drop()
        docs, last = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
