"""Stored indexes: an inverted index of texts, and cells of vectors for approximate search. Both are Parquet folders that readers prune."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.functions.text import tokens
from heronlake.operators.retrieval import KEYWORD_K, MOST_TERMS, VECTOR_K, _blocks, cover_density, few_terms, query_terms, top
from heronlake.operators.term_sets import best_of_postings, few_sets, named_sets, of_queries

#: Folders of an inverted index; a term lies in one of them.
BUCKETS = 64
#: Postings of a block at most.
BLOCK = 1024


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def all_positions(entries: DataFrame, text_col: str, keep: list[str], split: Callable[[Column], Column] = tokens) -> DataFrame:
    """As retrieval.positions, for all terms: an entry's tokens are split natively and gathered by term within its own row, for whole Arrow batches at once, without a shuffle."""
    cols = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                words = part.column(len(cols))
                sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                coded = words.flatten().dictionary_encode()
                term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = row * max(len(coded.dictionary), 1) + term
                order = np.argsort(key, kind="stable")  # places of a term stay in order
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                ends = np.append(first, len(order))
                at = order[first]
                of = pa.array(row[at])
                places = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in range(len(cols))), coded.dictionary.take(pa.array(term[at])), pa.array(np.diff(ends).astype(np.int32)), places], [*cols, "term", "tf", "positions"])

    kinds = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in cols)
    return entries.select(*cols, split(F.col(text_col)).alias("_tokens")).mapInArrow(run, f"{kinds}, term string, tf int, positions array<int>")


def write_blocks(postings: DataFrame, path: str, by: str | None = None) -> None:
    """Store postings (entry_id, [by], term, tf, positions) as blocks, partitioned by bucket.

    A block is one row: up to BLOCK postings of a term (and group), those with the most occurrences first, with its size and its largest and smallest tf, which readers
    see without reading the postings. Range partitions cut a frequent term between tasks.
    """
    groups = [by] if by else []
    rows = postings.select("entry_id", *groups, "term", "tf", "positions", _bucket(F.col("term")).alias("bucket"), (-F.col("tf")).alias("less"))
    order = ["bucket", "term", *groups, "less", "entry_id"]
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            new = np.zeros(batch.num_rows, bool)
            for c in ("term", *groups):
                code = col(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new |= np.diff(code, prepend=code[0] - 1) != 0
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, batch.num_rows))
            cuts = np.concatenate([np.arange(a, a + n, BLOCK) for a, n in zip(first, sizes, strict=True)])
            ends, at = pa.array(np.append(cuts, batch.num_rows).astype(np.int32)), pa.array(cuts)
            last = pa.array(np.append(cuts[1:], batch.num_rows) - 1)
            lists = [pa.ListArray.from_arrays(ends, col(c)) for c in ("entry_id", "tf", "positions")]
            heads = [col(c).take(at) for c in ("bucket", "term", *groups)]
            n = pa.array(np.diff(np.append(cuts, batch.num_rows)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*heads, n, col("tf").take(at), col("tf").take(last), *lists], ["bucket", "term", *groups, "n", "max_tf", "min_tf", "ids", "tfs", "places"])

    kinds = "".join(f"`{g}` {postings.schema[g].dataType.simpleString()}, " for g in groups)
    schema = f"bucket int, term string, {kinds}n int, max_tf int, min_tf int, ids array<{postings.schema['entry_id'].dataType.simpleString()}>, tfs array<int>, places array<array<int>>"
    blocks = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("less").mapInArrow(run, schema)
    blocks.write.partitionBy("bucket").parquet(path)


def exploded(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., entry_id, tf, positions) of all postings in blocks."""
    each = blocks.select(*keep, F.explode(F.arrays_zip("ids", "tfs", "places")).alias("p"))
    return each.select(*keep, F.col("p.ids").alias("entry_id"), F.col("p.tfs").alias("tf"), F.col("p.places").alias("positions"))


def least_tf(blocks: DataFrame, k: int, groups: list[str]) -> DataFrame:
    """(term, groups..., least): a tf that k postings of a term reach for certain, by the blocks' heads alone; 0 where there are fewer. No posting below it can be among the first k."""
    sizes = blocks.groupBy("term", *groups, "min_tf").agg(F.sum("n").alias("n"))  # few rows a term: one for each smallest tf
    before = F.sum("n").over(Window.partitionBy("term", *groups).orderBy(F.desc("min_tf")))
    enough = F.when(before >= k, F.col("min_tf"))
    return sizes.withColumn("enough", enough).groupBy("term", *groups).agg(F.coalesce(F.max("enough"), F.lit(0)).alias("least"))


class Postings:
    """An inverted index on disk, in blocks (see write_blocks), partitioned by bucket and sorted by term and tf.

    A query reads the buckets of its terms, and in them the row groups that hold these; texts aren't read. Of a one-term query's blocks only those are read and decoded that can hold
    one of its best k. Only the text given is indexed.
    """

    def __init__(self, spark: SparkSession, path: str, by: str | None = None, split: Callable[[Column], Column] = tokens):
        self.spark, self.path, self.by, self.split = spark, path, by, split

    @classmethod
    def build(cls, entries: DataFrame, path: str, text_col: str = "text", by: str | None = None, split: Callable[[Column], Column] = tokens) -> Postings:
        """Index entries (entry_id, [by], text)."""
        write_blocks(all_positions(entries, text_col, ["entry_id", *([by] if by else [])], split), path, by)
        return cls(entries.sparkSession, path, by, split)

    def blocks(self, few: list[str] | None) -> DataFrame:
        """The blocks of some terms, or of all."""
        return of_terms(self.spark, self.spark.read.parquet(self.path), few)

    def read(self, wanted: DataFrame) -> DataFrame:
        """Postings of the terms wanted (query_id, term, n_terms), with the query."""
        return exploded(self.blocks(few_terms(wanted)), ["term", *([self.by] if self.by else [])]).join(wanted, "term")

    def search(self, queries: DataFrame, k: int = KEYWORD_K, by: str | None = None) -> DataFrame:
        """As retrieval.keyword_top, from the stored postings."""
        return block_search(self.spark, self.blocks, queries, k, self.by, by, self.split)


def of_terms(spark: SparkSession, blocks: DataFrame, few: list[str] | None) -> DataFrame:
    if few is None:
        return blocks.drop("bucket")
    at = [r["b"] for r in spark.createDataFrame([(t,) for t in few], "term string").select(_bucket(F.col("term")).alias("b")).distinct().collect()] if few else []
    return blocks.where(F.col("bucket").isin(at) & F.col("term").isin(few)).drop("bucket")


def block_search(spark: SparkSession, blocks: Callable[[list[str] | None], DataFrame], queries: DataFrame, k: int, stored_by: str | None, by: str | None, split: Callable, live: Callable[[DataFrame], DataFrame] = lambda df: df, spare: int = 0) -> DataFrame:
    """The best k of each query (in each `by` group) from blocks. live: keeps the postings that count; spare: how many others there may be at most.

    One-term queries: the heads of the blocks give a tf that the k best reach, and blocks below it are left out. Other queries hold every term, and read all its blocks.
    Queries with the same terms are searched once.
    """
    groups, kept = [by] if by else [], [stored_by] if stored_by else []
    order = [F.desc(F.round("score", 9)), "entry_id"]
    named = named_sets(queries, split)
    sets = few_sets(named)
    if sets is None:
        return _joined_search(blocks, queries, k, kept, groups, split, live, spare)

    def with_code(numbers: np.ndarray, of: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Living postings of some terms, with their numbers in sets.terms, in the blocks that `of` keeps."""
        terms = sets.terms.take(pa.array(numbers))
        found = blocks(terms.to_pylist() if len(terms) <= MOST_TERMS else None)
        codes = F.broadcast(spark.createDataFrame(pa.table({"term": terms, "code": pa.array(numbers.astype(np.int32))})))  # at most the terms of MOST_SETS sets
        found = of(found.join(codes, "term"))
        return live(exploded(found, ["code", *kept, *(c for c in found.columns if c == "segment")]))

    parts = []
    one = sets.sets.get(1)
    if one is not None:
        numbers, codes = one[0], one[1][:, 0]
        mine = F.broadcast(spark.createDataFrame(pa.table({"code": pa.array(codes.astype(np.int32)), "_set": sets.ids.take(pa.array(numbers))})))
        hits = with_code(codes, lambda found: needed_blocks(found, k + spare, groups)).select("code", *groups, "entry_id", (F.col("tf") * F.lit(0.1)).alias("score"))
        parts.append(top(hits.join(mine, "code").drop("code"), ["_set", *groups], order, k))
    many = sets.several()
    if many is not None or not parts:
        hits = with_code(many.used() if many is not None else np.empty(0, np.int64)).select("entry_id", *groups, "code", "positions")
        parts.append(top(best_of_postings(hits, many or sets, k, groups), ["_set", *groups], order, k))
    return of_queries(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), named, groups)


def _joined_search(blocks: Callable[[list[str] | None], DataFrame], queries: DataFrame, k: int, kept: list[str], groups: list[str], split: Callable, live: Callable[[DataFrame], DataFrame], spare: int) -> DataFrame:
    """The same where the queries' sets of terms are too many to go to tasks: postings are joined with the queries' terms."""
    wanted, keys, order = query_terms(queries, split), ["query_id", *groups, "entry_id"], [F.desc(F.round("score", 9)), "entry_id"]
    one, many, found = wanted.where("n_terms = 1"), wanted.where("n_terms > 1"), blocks(None)
    columns = ["term", *kept, *(c for c in found.columns if c == "segment")]
    singles = live(exploded(needed_blocks(found.join(one.select("term").distinct(), "term", "left_semi"), k + spare, groups), columns)).join(one, "term")
    several = live(exploded(found.join(many.select("term").distinct(), "term", "left_semi"), columns)).join(many, "term")
    first = top(singles.select(*keys, (F.col("tf") * F.lit(0.1)).alias("score")), ["query_id", *groups], order, k)
    return first.unionByName(top(cover_density(several, keys), ["query_id", *groups], order, k))


def needed_blocks(blocks: DataFrame, k: int, groups: list[str]) -> DataFrame:
    """The blocks of each term (and group) that may hold one of its k postings with the most occurrences."""
    least = least_tf(blocks.select("term", *groups, "n", "min_tf"), k, groups)
    on = [F.col("term") == F.col("_term"), *(F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups)]
    bound = least.select(F.col("term").alias("_term"), *(F.col(g).alias(f"_{g}") for g in groups), "least")
    return blocks.join(bound, on).where("max_tf >= least").drop("least", "_term", *(f"_{g}" for g in groups))


class Cells:
    """Approximate vector search: vectors lie in the cell of their nearest centre, and a query reads the `probes` cells nearest to it.

    The centres are fitted on a bounded sample (SAMPLE rows with the smallest hashes of their ids); every row is indexed. `probes` is a recall
    knob, which `calibrate` sets against exact search. index: cell, entry_id, embedding, written by the caller partitioned by cell, or used as it is.
    """

    SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 8

    def __init__(self, centres: np.ndarray, probes: int = 1):
        self.centres, self.probes = centres, probes

    @classmethod
    def fit(cls, entries: DataFrame, cells: int | None = None) -> Cells:
        rows = entries.where("embedding is not null").orderBy(F.xxhash64("entry_id"), "entry_id").limit(cls.SAMPLE).select("embedding").collect()
        found = [np.array(r["embedding"], float) for r in rows]
        size = max((len(v) for v in found), default=0)
        v = np.array([x / np.linalg.norm(x) for x in found if len(x) == size and np.isfinite(x).all() and np.linalg.norm(x) > 0]).reshape(-1, size)
        n = min(cells or max(1, int(np.sqrt(entries.count()))), cls.MOST_CELLS, max(len(v), 1))
        centres = v[np.random.default_rng(0).permutation(len(v))[:n]]
        for _ in range(cls.ROUNDS):
            mine = (v @ centres.T).argmax(axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, mine, v)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(length > 0, total / np.where(length > 0, length, 1), centres)
        return cls(centres)

    def assign(self, rows: DataFrame, id_col: str = "entry_id", many: int = 1) -> DataFrame:
        """(cell, id, embedding): each row once for each of its `many` nearest cells; vectors of another dimension, or without a length, in none."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = [np.array(x if x is not None and len(x) == centres.shape[1] else [np.nan], float) for x in batch.column(1).to_pylist()]
                good = np.array([len(x) == centres.shape[1] and bool(np.isfinite(x).all()) and bool(x.any()) for x in v], bool)
                if good.any():
                    near = np.argsort(-(np.array([x for x, g in zip(v, good, strict=True) if g]) @ centres.T), axis=1, kind="stable")[:, :many]
                    at = np.repeat(np.flatnonzero(good), near.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["cell", id_col, "embedding"])

        kind = rows.schema["embedding"].dataType.simpleString()
        return rows.select(F.col(id_col).cast("long"), "embedding").mapInArrow(run, f"cell int, {id_col} long, embedding {kind}")

    def search(self, index: DataFrame, queries: DataFrame, k: int = VECTOR_K) -> DataFrame:
        """(query_id, entry_id, score, rank): blocks of vectors and of queries meet by cell, an equi-join; each pair of blocks yields its best k."""
        parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        e = _blocks(index.repartitionByRange(parts, "cell", "entry_id").sortWithinPartitions("cell", "entry_id"), "entry_id", ["cell"])
        asked = self.assign(queries.select("query_id", "embedding"), "query_id", self.probes)
        q = _blocks(asked.repartition(parts, "cell").sortWithinPartitions("cell", "query_id"), "query_id", ["cell"]).select("cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, vectors, q_ids, q_vectors in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "q_ids", "q_vectors")), strict=True):
                    ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                    s = np.frombuffer(q_vectors).reshape(len(q_ids), -1) @ np.frombuffer(vectors).reshape(len(ids), -1).T
                    best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are sorted, so equal scores keep the smaller first
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, best.shape[1])), pa.array(ids[best.reshape(-1)]), pa.array(np.take_along_axis(s, best, 1).reshape(-1))], ["query_id", "entry_id", "score"])

        found = e.join(q, "cell").select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id long, entry_id long, score double")
        return top(found, ["query_id"], [F.desc(F.round("score", 9)), "entry_id"], k)

    def calibrate(self, index: DataFrame, queries: DataFrame, exact: DataFrame, k: int = VECTOR_K, recall: float = 0.9) -> Cells:
        """The fewest probes (doubling, then halving the step) that give at least this recall of the exact results (query_id, entry_id) on these queries."""
        want = exact.count()
        exact = exact.select("query_id", "entry_id")

        def enough(probes: int) -> bool:
            return probes >= len(self.centres) or Cells(self.centres, probes).search(index, queries, k).join(exact, ["query_id", "entry_id"], "left_semi").count() >= recall * want

        low, high = 0, 1
        while not enough(high):
            low, high = high, min(2 * high, len(self.centres))
        while high - low > max(1, high // 8):
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle) else (middle, high)
        return Cells(self.centres, high)


