"""Near copies by SimHash, held to a Jaccard similarity of word shingles.

Two texts of similarity SIMILARITY differ in 9.7 of 64 SimHash bits on average and in up to about RADIUS: too many for bands of equal bits
to bring them together, as simhash_neardup does within its radius of 4. So MinHash bands choose which fingerprints are compared, SimHash decides
among them, bit-sliced, and what it lets through is checked exactly.

1. Sketches: in Arrow batches, each text's set of word shingles (XXH64) gives its SimHash and BANDS keys of ROWS minima each. Texts of one set are one
   class; only classes go on, so copies cost nothing further.
2. Rows of (key, class) are range-partitioned and sorted. Each key's classes are held against the first of them; pairs whose fingerprints differ in RADIUS bits at
   most are candidates. A pair of similarity s shares none of the keys with probability (1 - s ** ROWS) ** BANDS: 5e-8 at s = 0.8; its
   fingerprints differ in more than RADIUS bits with about 1e-6.
3. A candidate is a link if the Jaccard similarity of its two sets, computed from the texts, is SIMILARITY or more. Links give components.
4. Keys whose classes still lie in several components: all their fingerprints are compared bit-sliced, in pairs of blocks. Only classes with a near
   fingerprint in another component go on to the exact comparison, in pairs of blocks too, so no link between components is left out.

Cases: words are as in simhash_neardup (A-Z alone are lowered, the six ASCII spaces separate); fewer words than a shingle are one shingle; null text
and text without words have the empty set and are copies of each other; each row counts by itself, so ids may be null or repeat; an empty table
gives an empty result. Very long texts need memory in proportion to their words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import Written, map_batches
from heronlake.llm.components import components
from heronlake.llm.simhash_neardup import _padding, _upper, forest, within

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Hashes that are permuted at once, and sets that a task keeps.
RUN, KEPT = 1 << 12, 64
#: Bits in which the fingerprints of a candidate may differ.
RADIUS = 24
#: Size of a block of fingerprints, and of one of sets, in classes or hashes.
PAGE, BLOCK_ROWS, BLOCK_HASHES = 1024, 256, 1 << 17
#: Rows of the sorted index that a task holds; row numbers that are sent to all tasks (more are joined by a shuffle).
HELD, MOST_BROADCAST = 1 << 18, 2_000_000


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = len(words) - SHINGLE + 1
    joined = b" ".join(words)
    if n <= 1:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], stops[: n - 1] + 1)).tolist()
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins, stops[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n))


@functools.cache
def _factors() -> np.ndarray:
    return np.random.default_rng(20240301).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, as signed numbers; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), RUN):
        low = np.minimum(low, (found[at : at + RUN] * _factors()).min(axis=1))
    return np.array([xxh64_intdigest(low[ROWS * k : ROWS * (k + 1)].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def simhash(found: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed number: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), RUN):
        ones += np.unpackbits(found[at : at + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def sketches(rows: DataFrame) -> DataFrame:
    """(row, doc_id, same, fp, keys): same tells sets apart."""

    def make():
        from xxhash import xxh3_128_digest

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array(map(simhash, found), pa.int64()), pa.array([band_keys(f) for f in found], pa.list_(pa.int64()))], ["row", "doc_id", "same", "fp", "keys"])

        return step

    return map_batches(rows.select("row", "doc_id", "text"), make, "row long, doc_id long, same binary, fp long, keys array<long>")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. texts: (row, text)."""
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(row: int, text: str | None) -> np.ndarray:
            if row not in kept:
                if len(kept) >= KEPT:
                    kept.pop(next(iter(kept)))
                kept[row] = shingles(text)
            return kept[row]

        for batch in batches:
            near = [alike(of(a, x), of(b, y)) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if any(near):
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def first_pairs(index: DataFrame) -> DataFrame:
    """(a, b, key, node, fp) of sorted (key, node, fp) rows: b under a, the first of its key, if their fingerprints are near; and, as key, node and fp,
    all of keys with three classes or more, or at the ends of a partition or of a HELD run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        first, size = True, 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            key, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            whole = final or len(cuts) == 2  # a single run that fills all that is held goes as if it ended here
            held = []
            if not whole:
                held, cuts = [(key[cuts[-2] :], node[cuts[-2] :], fp[cuts[-2] :])], cuts[:-1]
                key, node, fp = key[: cuts[-1]], node[: cuts[-1]], fp[: cuts[-1]]
            many = np.diff(cuts)
            wide = many > 2
            wide[0] |= first
            wide[-1] |= whole
            first = whole
            lead, mark = np.repeat(node[cuts[:-1]], many), np.repeat(fp[cuts[:-1]], many)
            pair = (lead != node) & (np.bitwise_count((mark ^ fp).view(np.uint64)) <= RADIUS)
            rest = np.repeat(wide, many)
            none = lambda n: pa.nulls(int(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lead[pair]), pa.array(node[pair]), *[none(pair.sum())] * 3], ["a", "b", "key", "node", "fp"])
            yield pa.RecordBatch.from_arrays([*[none(rest.sum())] * 2, pa.array(key[rest]), pa.array(node[rest]), pa.array(fp[rest])], ["a", "b", "key", "node", "fp"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)))
            size += batch.num_rows
            if size >= HELD:
                yield from flush(False)
                size = sum(len(k) for k, _, _ in held)
        if held:
            yield from flush(True)

    return index.mapInArrow(run, "a long, b long, key long, node long, fp long")


def near_nodes(members: DataFrame) -> DataFrame:
    """(key, node) of members (key, node, root, fp) with a near fingerprint in another component of their key; fingerprints are compared bit-sliced, in pairs of blocks."""
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / PAGE).cast("int").alias("blocks"))
    dealt = members.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    all_of = lambda c: F.transform("all", lambda x: x[c]).alias(c)
    blocks = dealt.groupBy("key", "block").agg(F.collect_list(F.struct("node", "root", "fp")).alias("all")).select("key", "block", all_of("node"), all_of("root"), all_of("fp"))
    blocks = Written(blocks, "fingerprint-blocks")
    left, right = (blocks.df.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "node", "root", "fp"))) for side in "xy")
    pairs = left.join(right, "key").where("block_x <= block_y").select("key", "block_x", "block_y", "node_x", "root_x", "fp_x", "node_y", "root_y", "fp_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, m, n = (batch.column(c)[i].as_py() for c in range(3))
                node, root, fp, node_y, root_y, fp_y = (batch.column(c)[i].values.to_numpy() for c in range(3, 9))
                r, lane = within(fp.view(np.uint64), fp_y.view(np.uint64), RADIUS, _upper(len(fp)) if m == n else _padding(len(fp), len(fp_y)))
                apart = root[r] != root_y[lane]
                found = np.unique(np.concatenate((node[r[apart]], node_y[lane[apart]])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key)), pa.array(found)], ["key", "node"])

    return pairs.mapInArrow(run, "key long, node long").distinct()


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, block, node, root, found): the classes of each key in blocks of about BLOCK_ROWS classes or BLOCK_HASHES hashes, as arrays. members: (key, node, root); sets: (node, found)."""
    many = members.join(sets.select("node", F.length("found").alias("size")), "node").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.col("size") / 8) / BLOCK_HASHES)).cast("int").alias("blocks"))
    dealt = members.join(many, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(sets, "node")
    one = F.collect_list(F.struct("node", "root", "found"))
    return dealt.groupBy("key", "block").agg(one.alias("all")).select("key", "block", "all.node", "all.root", "all.found")


def compare_blocks(blocks: DataFrame) -> DataFrame:
    """(a, b): similar classes of one key that lie in different components."""
    left = blocks.select("key", *(F.col(c).alias(f"{c}_x") for c in ("block", "node", "root", "found")))
    right = blocks.select("key", *(F.col(c).alias(f"{c}_y") for c in ("block", "node", "root", "found")))
    pairs = left.join(right, "key").where("block_x <= block_y").drop("key", "block_x", "block_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, r, f, m, q, g = (batch.column(c)[k].as_py() for c in range(6))
                a, b = similar_across([np.frombuffer(x, np.uint64) for x in f], np.array(r), [np.frombuffer(x, np.uint64) for x in g], np.array(q))
                if len(a):  # a spanning forest of the links does
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.array(n)[a], np.array(m)[b])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def similar_across(x: list[np.ndarray], rx: np.ndarray, y: list[np.ndarray], ry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of similar sets whose roots differ; no set is empty."""
    sizes = np.array([len(s) for s in y])
    names, of = np.unique(np.concatenate(y), return_inverse=True)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out_x, out_y = [], []
    for i, s in enumerate(x):
        if (ry == rx[i]).all():
            continue
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        here = np.zeros(len(names), np.int64)
        here[at[names[at] == s]] = 1
        both = np.add.reduceat(here[of], begins)
        j = np.flatnonzero((both >= SIMILARITY * (len(s) + sizes - both)) & (ry != rx[i]))
        out_x += [i] * len(j)
        out_y += j.tolist()
    return np.array(out_x, np.int64), np.array(out_y, np.int64)


def sets(texts: DataFrame) -> DataFrame:
    """(node, found): the shingle hashes of texts (row, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "found"])

        return step

    return map_batches(texts.select("row", "text"), make, "node long, found binary")


def _semi(big: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """big joined with the written row numbers of few; these are broadcast behind a check of their count, so that texts aren't shuffled."""
    return big.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few, "row", how)


def links(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links between classes (node, fp, keys) that keep every connection. rows: (row, text), the classes' own among them."""
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    index = classes.select(F.explode("keys").alias("key"), "node", "fp").repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    met = Written(first_pairs(index), "met")
    pairs = Written(met.df.where("a is not null").select("a", "b").distinct(), "pairs")
    ends = Written(pairs.df.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends")
    texts = Written(_semi(rows.select("row", "text"), ends.df, "left_semi"), "texts")
    known = Written(linked(pairs.df, texts.df), "links")
    texts.drop()
    roots = components(known.df)
    wide = Written(met.df.where("key is not null").select("key", "node", "fp").join(roots.df, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root")), "wide")
    met.drop()
    split = wide.df.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rest = Written(wide.df.join(split, "key", "left_semi"), "split")
    live = Written(rest.df.select("key", "node", "root").join(near_nodes(rest.df), ["key", "node"], "left_semi"), "live")
    more = Written(live.df.select(F.col("node").alias("row")).distinct(), "more")
    found = Written(sets(_semi(rows.select("row", "text"), more.df, "left_semi")), "sets")
    return known.df.unionByName(compare_blocks(Written(_blocks(live.df, found.df), "blocks").df))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, of each component of near copies one row: that of the smallest id; null ids come last, and one of several rows of that id stays."""
    rows = Written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")), "rows")
    plain = rows.df.select("row", F.col("document.doc_id").cast("long").alias("doc_id"), F.col("document.text").alias("text"))
    marked = Written(sketches(plain), "sketches")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = Written(marked.df.groupBy("same").agg(F.min(best).alias("best"), F.min("fp").alias("fp"), F.min("keys").alias("keys")).select("same", F.col("best.row").alias("node"), "best", "fp", "keys"), "classes")
    roots = components(links(classes.df.select("node", "fp", "keys"), plain))
    stay = classes.df.select("node", "best").join(roots.df, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    gone = Written(marked.df.select("row").join(stay, "row", "left_anti"), "gone")
    marked.drop()
    classes.drop()
    return _semi(rows.df, gone.df, "left_anti").select("document.*")
