"""SimHash near-duplicates, compared bit-sliced.

1. Fingerprints: in Arrow batches, over the XXH64 of each text's word shingles (repeats included).
2. Documents of one fingerprint are one class; only distinct fingerprints go on, so copies cost nothing further.
3. Candidate search: the 64 bits are cut into BANDS bands. Within RADIUS differing bits at least BANDS - RADIUS
   bands are equal, so each fingerprint is sent once for each choice of that many bands, its bits rotated so
   that the chosen bands come first. Rows are range-partitioned and sorted by the whole rotated fingerprint: a hot choice of
   bands (many fingerprints with these bands equal) is cut between partitions like any other.
4. Each partition is read as pages of whole groups (rows with equal chosen bands), at most PAGE rows. A page is stored
   as bit planes, one machine word for 64 fingerprints, and all its rows are compared at once: a plane at a time, the differing bits are
   added to carry-save counters (three bits and a sticky overflow), and a row of words is abandoned once
   all its lanes exceed the radius. Unequal bands come first, so most rows end after a few planes.
5. A group that does not lie within one page of one partition is cut into blocks; these few blocks are
   written, and pairs of blocks of a group (not of rows) are joined and compared in the same way. So the work of a hot group is
   spread over tasks by pairs of blocks, each of bounded size.
6. Pages give a spanning forest of their links. Components of the links, joined back by fingerprint, give the classes.

Cases: null or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; a bit set in exactly half the hashes is 0; rows that repeat a document id count as rows of that id; an empty
table gives an empty result; columns other than the two named are not read. Very long texts need memory in proportion to their words
(hashes are added up in runs of RUN).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import Written, map_batches, table
from heronlake.llm.components import components

SHINGLE = 4
RADIUS = 4
BANDS = 6
PAGE = 512
RUN = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII spaces separate
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], stops[: n - 1] + 1)).tolist()
    ends = stops[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, RUN):
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins[lo : lo + RUN], ends[lo : lo + RUN], strict=True)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


# --- bit-sliced comparison -------------------------------------------------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) array: bit k of word w of plane p is bit p of value 64 * w + k."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(rows: np.ndarray, lanes: np.ndarray, radius: int, dead: np.ndarray, order: range = range(64)) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) indices whose values differ in at most `radius` bits. dead: (rows, words) bits of pairs not to compare."""
    planes = bit_planes(lanes)
    live = np.arange(len(rows))
    over = dead.copy()
    counters = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for step, p in enumerate(order):
        flip = np.where((rows[live] >> np.uint64(p)) & np.uint64(1), full, np.uint64(0))
        carry = planes[p][None, :] ^ flip[:, None]
        for c in counters:  # carry-save: add one bit to each lane's counter
            c ^= carry
            carry &= ~c
        over |= carry
        if step % 4 == 3 or p == order[-1]:
            over |= _exceeds(counters, radius)
            keep = (over != full).any(axis=1)
            if not keep.all():  # rows of words all of whose lanes exceed the radius are abandoned
                live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
                if not len(live):
                    break
    if not len(live):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(lanes)]
    r, lane = np.nonzero(near)
    return live[r], lane


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than radius, by comparing bits from the highest."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def _upper(n: int) -> np.ndarray:
    """Dead pairs of a page against itself: lanes up to the row's own, and padding."""
    words = -(-n // 64)
    bits = np.zeros((n, words * 64), np.uint8)
    bits[:, :n] = np.tri(n, n, 0, dtype=np.uint8)
    bits[:, n:] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _padding(rows: int, lanes: int) -> np.ndarray:
    bits = np.zeros((1, -(-lanes // 64) * 64), np.uint8)
    bits[:, lanes:] = 1
    return np.repeat(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), rows, axis=0)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b."""
    names, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(where[: len(a)].tolist(), where[len(a) :].tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append(k)
    return a[kept], b[kept]


# --- candidate search ------------------------------------------------------------------------------------------------


def rotations(bands: int = BANDS, radius: int = RADIUS) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of bands: all bands as (lowest bit, width), the chosen ones in front, and how many bits these have."""
    edges = [round(64 * k / bands) for k in range(bands + 1)]
    parts = [(edges[k], edges[k + 1] - edges[k]) for k in range(bands)]
    out = []
    for chosen in itertools.combinations(range(bands), bands - radius):
        out.append(([parts[k] for k in (*chosen, *(k for k in range(bands) if k not in chosen))], sum(parts[k][1] for k in chosen)))
    return out


def _rotate(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The bands of each value in the given order, the first the most significant."""
    out, at = np.zeros_like(values), 64
    for low, width in order:
        at -= width
        out |= (values >> np.uint64(low) & np.uint64((1 << width) - 1)) << np.uint64(at)
    return out


def _sorted_key(values: np.ndarray) -> np.ndarray:
    """Unsigned values as signed ones in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def candidate_rows(distinct: DataFrame, bands: int, radius: int) -> DataFrame:
    """(choice, at, fp): each distinct fingerprint once for each choice of bands; at sorts by the rotated bits."""

    def make():
        turns = rotations(bands, radius)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.concatenate([_sorted_key(_rotate(fp.view(np.uint64), order)) for order, _ in turns])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(turns), dtype=np.int32), len(fp))), pa.array(at), pa.array(np.tile(fp, len(turns)))], ["choice", "at", "fp"])

        return step

    return map_batches(distinct.select("fp"), make, "choice int, at long, fp long")


LINK_SCHEMA = "a long, b long, choice int, grp long, block string, fps binary"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = forest(a, b)
    n = len(a)
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.string(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], ["a", "b", "choice", "grp", "block", "fps"])


def search_pages(rows: DataFrame, bands: int, radius: int, page: int) -> DataFrame:
    """Links within pages of sorted rows, and the blocks of groups that reach beyond a page or a partition."""
    widths = [w for _, w in rotations(bands, radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        name = itertools.count()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # choice, group, fp; sorted
        first = True

        def blocks(choice: int, grp: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(fps), page):
                part = fps[lo : lo + page]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([choice], pa.int32()), pa.array([grp], pa.int64()), pa.array([f"{task}-{next(name)}"]), pa.array([part.tobytes()], pa.binary())], ["a", "b", "choice", "grp", "block", "fps"])

        def compare(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(fps), page):
                v = fps[lo : lo + page]
                if len(v) > 1:
                    r, lane = within(v.view(np.uint64), v.view(np.uint64), radius, _upper(len(v)))
                    if len(r):
                        yield _links(v[r], v[lane])

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            if not held:
                return
            choice, grp, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (grp[1:] != grp[:-1])) + 1, [len(fp)]))
            open_group = int(cuts[-2]) if not final else len(fp)
            held = [(choice[open_group:], grp[open_group:], fp[open_group:])] if open_group < len(fp) else []
            last = len(cuts) - 2
            pageful, filled = [], 0
            for k in range(last if not final else last + 1):
                lo, hi = int(cuts[k]), int(cuts[k + 1])
                edge = (first and k == 0) or (final and k == last)
                if edge or hi - lo > page:  # it may go on in another partition, or has several blocks
                    yield from blocks(int(choice[lo]), int(grp[lo]), fp[lo:hi])
                if hi - lo > page:
                    yield from compare(fp[lo:hi])
                elif hi - lo > 1:
                    if filled + hi - lo > page:
                        yield from compare(np.concatenate(pageful))
                        pageful, filled = [], 0
                    pageful.append(fp[lo:hi])
                    filled += hi - lo
            first = first and open_group == 0
            if pageful:
                yield from compare(np.concatenate(pageful))

        size = 0
        for batch in batches:
            choice, at, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            grp = (at.view(np.uint64) ^ np.uint64(1 << 63)) >> (np.uint64(64) - np.array(widths, np.uint64)[choice])
            held.append((choice, grp.astype(np.int64), fp))
            size += len(fp)
            if size >= 1 << 16:
                yield from flush(False)
                size = sum(len(x[2]) for x in held)
                if size >= 1 << 16:  # one group fills all that is held: let its full blocks go
                    choice, grp, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                    keep = len(fp) // page * page
                    yield from blocks(int(choice[0]), int(grp[0]), fp[:keep])
                    yield from compare(fp[:keep])
                    held, size = [(choice[keep:], grp[keep:], fp[keep:])] if keep < len(fp) else [], len(fp) - keep
                    first = True  # the rest of the group also meets its other blocks
        yield from flush(True)

    return rows.mapInArrow(run, LINK_SCHEMA)


def compare_blocks(blocks: DataFrame, radius: int) -> DataFrame:
    """Links between different blocks of one group."""
    names = blocks.select("choice", "grp", "block")  # names are paired first, so that a hot group's fingerprints don't meet in one task
    pairs = names.withColumnRenamed("block", "x").join(names.withColumnRenamed("block", "y"), ["choice", "grp"]).where("x < y").select("x", "y")
    pairs = pairs.join(blocks.select(F.col("block").alias("x"), F.col("fps").alias("fx")), "x").join(blocks.select(F.col("block").alias("y"), F.col("fps").alias("fy")), "y").select("x", "y", "fx", "fy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v, w = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                r, lane = within(v.view(np.uint64), w.view(np.uint64), radius, _padding(len(v), len(w)))
                if len(r):
                    yield _links(v[r], w[lane])

    return pairs.mapInArrow(run, LINK_SCHEMA)


def bands_for(many: int, radius: int = RADIUS, page: int = PAGE) -> int:
    """The fewest bands, BANDS at least, whose chosen bits cut `many` fingerprints into groups of about a page."""
    bands = max(BANDS, radius + 2)
    while bands < 4 * radius and many > page << (64 * (bands - radius) // bands):
        bands += 1
    return bands


def links(distinct: DataFrame, radius: int = RADIUS, bands: int | None = None, page: int = PAGE) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that keep every connection within the radius."""
    bands = bands or bands_for(distinct.count(), radius, page)
    rows = candidate_rows(distinct, bands, radius)
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, "choice", "at").sortWithinPartitions("choice", "at")
    found = Written(search_pages(dealt, bands, radius, page), "pages")
    inside = found.df.where("block is null").select("a", "b")
    blocks = found.df.where("block is not null").select("choice", "grp", "block", "fps")
    return inside.unionByName(compare_blocks(blocks, radius).select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, the document's own included."""
    marked = Written(fingerprints(docs, shingle), "fingerprints")
    distinct = Written(marked.df.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    joined = components(links(distinct.df, radius)).df
    low = distinct.df.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = Written(low.groupBy("root").agg(F.min("low").alias("component_id")), "least-ids")
    named = Written(low.join(least.df, "root").select("fp", "component_id"), "named")
    return marked.df.join(named.df, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
