"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

1. Components become integers (floor of `scale` times each), so scores, the inner products, are exact.
2. A vector gets one component more, sqrt(largest norm squared - its norm squared), an anchor a zero. Then the distance of an anchor a and a
   row is sqrt(|a|^2 + largest norm squared - 2 score): the nearest rows are those with the highest scores.
3. PIVOTS rows of a bounded sample are pivots; each row lies in the cell of its nearest one and keeps its distance. Anchors
   are grouped by the cells they lie in, with up to GROUP anchors a group.
4. First a group meets the rows of its own cells. What is found bounds what other rows must reach: the score of
   the k-th best so far. For each group and cell, the triangle inequality turns these bounds into an interval of
   distances to the cell's pivot, and only the rows within it are replicated to that group. Then group and rows are joined
   exactly. A group's rows are dealt over as many tasks as they need (BLOCK rows each), and each task sends its best k.
5. This is done twice: for positives (the best rows of the anchor's label), and for negatives (rows of
   other labels whose score lies in a band under each positive's), whose intervals are bounded on both sides.

What reaches the driver follows the number of pivots and groups (one for GROUP anchors), never rows.

Cases: rows with a null label, a null vector or a null or non-finite component take no part; rows with a null id take part but are no
anchors, and come last among equal scores; shorter vectors count as ended with zeros; rows that repeat an id
are rows of their own (also as others of an anchor with that id); of rows with equal score and id any comes first; an anchor without positives, or a
positive without negatives, gives no rows; an empty table gives an empty result; other columns, whatever their names, are not
read. Vectors whose scores could reach 2^56 are refused, as hundredths of such scores don't fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import Scratch, Written, map_batches, table

#: Pivots, and the bounded sample of rows that they are drawn from.
PIVOTS, SAMPLE = 64, 1024
#: Anchors of a group, and rows that a group meets in one task, about.
GROUP, BLOCK = 4096, 4096
#: Intervals that are broadcast at most; more are joined.
MAX_BROADCAST = 500_000
#: Anchors whose scores a task holds at once.
STEP = 256


def _matrix(column, width: int, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


class Space:
    """The pivots, and distances to them in the space with one component more."""

    def __init__(self, pivots: np.ndarray, norm: float, exact: bool):
        self.pivots, self.norm, self.width = pivots, norm, pivots.shape[1]
        self.kind = np.float64 if exact else np.int64  # both give whole scores; floating numbers are faster
        self.more = np.sqrt(np.maximum(norm - (pivots**2).sum(1), 0))
        self.slack = 1e-6 * (1 + np.sqrt(norm))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.norm - (x**2).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.norm - 2 * (x @ self.pivots.T + np.outer(more, self.more)), 0))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + self.norm - 2 * (x @ self.pivots.T), 0))

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance between an anchor and a row of that score."""
        return np.sqrt(np.maximum((x**2).sum(1) + self.norm - 2 * score, 0))


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, q) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col("label").isNotNull() & e.isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def _space(rows: DataFrame, pivots: int) -> Space | None:
    x = F.col("q")
    squares = F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    width, norm, top = rows.agg(F.max(F.size(x)), F.max(squares), F.max(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double")))))).first()
    if width is None:
        return None
    if (top or 0) ** 2 * width >= 2**56:
        raise ValueError("these vectors may have scores of 2^56 and more")
    drawn = rows.select("q", "row").orderBy(F.xxhash64("row"), "row").limit(max(SAMPLE, pivots)).select("q").collect()
    q = np.array([[*r.q, *[0] * (width - len(r.q))] for r in drawn], np.float64).reshape(len(drawn), width)
    _, first = np.unique(q, axis=0, return_index=True)  # equal vectors would be one cell
    return Space(q[np.sort(first)[:pivots]], norm * (1 + 1e-12), (top or 0) ** 2 * width < 2**53)


def _in_cells(rows: DataFrame, space: Space) -> DataFrame:
    """(row, vec_id, label, q, cell, dist): vectors of full length, and the nearest pivot."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            dist = space.of_rows(_matrix(batch.column(3), space.width))
            cell = dist.argmin(1) if len(space.pivots) else np.zeros(len(dist), int)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(dist[np.arange(len(dist)), cell])], ["row", "vec_id", "label", "q", "cell", "dist"])

        return step

    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(space.width) - F.size("q")))
    return map_batches(rows.select("row", "vec_id", "label", padded.alias("q")), make, "row long, vec_id long, label long, q array<long>, cell int, dist double")


def _with_cell(anchors: DataFrame, space: Space) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = space.of_anchors(_matrix(batch.column(3), space.width)).argmin(1).astype(np.int32)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["row", "vec_id", "label", "q", "home"])

        return step

    return map_batches(anchors.select("row", "vec_id", "label", "q"), make, "row long, vec_id long, label long, q array<long>, home int")


def _groups(counts: dict[int, int], space: Space, most: int) -> dict[int, list[int]]:
    """Cell -> the groups of its anchors. Cells are taken along a chain of near pivots; small ones share a group, large ones have several."""
    out: dict[int, list[int]] = {}
    left, at, group, held = sorted(counts), None, 0, 0
    while left:
        if at is not None:
            left.sort(key=lambda c: ((space.pivots[c] - space.pivots[at]) ** 2).sum())
        at = left.pop(0)
        if held and held + counts[at] > most:
            group, held = group + 1, 0
        many = -(-counts[at] // most)
        out[at] = list(range(group, group + many))
        if many > 1:
            group, held = group + many, 0
        else:
            held += counts[at]
    return out


def _lookup(values: dict[int, int], size: int, key: str) -> Column:
    return F.get(F.array(*(F.lit(values.get(c, 0)) for c in range(size))), F.col(key))


def _meet(rows: DataFrame, anchors: DataFrame, routes: list[tuple[int, int, float, float]], counts: dict[int, int], block: int, join: Callable, schema: str) -> DataFrame | None:
    """Each group's anchors with the rows routed to it. routes: (cell, group, least and greatest distance)."""
    spark, load = rows.sparkSession, {}
    for cell, group, *_ in routes:
        load[group] = load.get(group, 0) + counts.get(cell, 0)
    parts = {g: max(1, -(-n // block)) for g, n in load.items() if n}
    routes = [r for r in routes if r[1] in parts]
    if not routes:
        return None
    way = spark.createDataFrame([(*r, parts[r[1]]) for r in routes], "cell int, group int, nearest double, farthest double, parts int")
    sent = rows.join(F.broadcast(way) if len(routes) <= MAX_BROADCAST else way, "cell").where(F.col("dist").between(F.col("nearest"), F.col("farthest")))
    sent = sent.select("group", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "row", "vec_id", "label", "q")
    dealt = spark.createDataFrame(list(parts.items()), "group int, parts int")
    met = anchors.join(F.broadcast(dealt) if len(parts) <= MAX_BROADCAST else dealt, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return sent.groupBy("group", "part").cogroup(met.groupBy("group", "part")).applyInArrow(join, schema)


def _scores(rows: pa.Table, anchors: pa.Table, space: Space):
    """(number of the anchor, its scores) for each anchor; rows in order of their id, and that order."""
    ids = rows["vec_id"].combine_chunks()
    key = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    order = np.lexsort((rows["row"].to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), key))
    rows = rows.take(pa.array(order))
    x, a = _matrix(rows["q"], space.width, space.kind), _matrix(anchors["q"], space.width, space.kind)

    def each():
        for lo in range(0, len(a), STEP):
            for k, s in enumerate((a[lo : lo + STEP] @ x.T).astype(np.int64)):
                yield lo + k, s

    return rows, each()


def _positives(space: Space, k: int) -> Callable:
    def join(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, scores = _scores(rows, anchors, space)
        label, own, names, wanted = rows["label"].to_numpy(), rows["row"].to_numpy(), anchors["row"].to_numpy(), anchors["label"].to_numpy()
        who, what, how = [], [], []
        same = {v: np.flatnonzero(label == v) for v in np.unique(wanted)}
        for i, s in scores:
            fit = same[wanted[i]]
            fit = fit[own[fit] != names[i]]
            s = s[fit]
            if len(s) > k:
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                fit, s = fit[near], s[near]
            best = np.argsort(-s, kind="stable")[:k]
            who += [names[i]] * len(best)
            what.append(fit[best])
            how.append(s[best])
        at = pa.array(np.concatenate([*what, np.zeros(0, int)]))
        return pa.table({"anchor": pa.array(who, pa.int64()), "score": pa.array(np.concatenate([*how, np.zeros(0, np.int64)])), "vec_id": rows["vec_id"].take(at), "row": rows["row"].take(at)})

    return join


def _negatives(space: Space, k: int) -> Callable:
    """Anchors carry `least` and `most`, the scores that a negative of each positive may have."""

    def join(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, scores = _scores(rows, anchors, space)
        label, names, wanted = rows["label"].to_numpy(), anchors["row"].to_numpy(), anchors["label"].to_numpy()
        least, most = anchors["least"].to_pylist(), anchors["most"].to_pylist()
        who, which, what, how = [], [], [], []
        other = {v: np.flatnonzero(label != v) for v in np.unique(wanted)}
        for i, s in scores:
            fit = other[wanted[i]]
            s = s[fit]
            some = (s >= min(least[i])) & (s <= max(most[i]))
            fit, s = fit[some], s[some]
            order = np.argsort(-s, kind="stable")
            fit, s = fit[order], s[order]
            for p, (lo, hi) in enumerate(zip(least[i], most[i], strict=True)):
                a = np.searchsorted(-s, -hi, "left")
                b = max(a, min(a + k, np.searchsorted(-s, -lo, "right")))
                who += [names[i]] * (b - a)
                which += [p] * (b - a)
                what.append(fit[a:b])
                how.append(s[a:b])
        at = pa.array(np.concatenate([*what, np.zeros(0, int)]))
        return pa.table({"anchor": pa.array(who, pa.int64()), "place": pa.array(which, pa.int32()), "score": pa.array(np.concatenate([*how, np.zeros(0, np.int64)])), "vec_id": rows["vec_id"].take(at), "row": rows["row"].take(at)})

    return join


def _intervals(anchors: DataFrame, space: Space, homes: dict[int, list[int]]) -> list[tuple[int, int, float, float]]:
    """Routes of the rows outside a group's own cells. anchors: (group, q, from_score, to_score), the scores that are still of use."""

    def bounds(group: pa.Table) -> pa.Table:
        x = _matrix(group["q"], space.width)
        d = space.of_anchors(x)
        far, near = (space.reach(x, group[c].to_numpy())[:, None] for c in ("from_score", "to_score"))
        nearest, farthest = np.maximum(d - far, near - d).min(0) - space.slack, (d + far).max(0) + space.slack
        return pa.table({"group": pa.array([group["group"][0].as_py()] * len(nearest), pa.int32()), "cell": pa.array(np.arange(len(nearest), dtype=np.int32)), "nearest": pa.array(nearest), "farthest": pa.array(farthest)})

    found = anchors.select("group", "q", "from_score", "to_score").groupBy("group").applyInArrow(bounds, "group int, cell int, nearest double, farthest double")
    return [(r.cell, r.group, r.nearest, r.farthest) for r in found.collect() if r.group not in homes.get(r.cell, []) and r.nearest <= r.farthest]


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k by score, then id, of each anchor (and place), with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _joined(rows: DataFrame, anchors: DataFrame, homes: dict, counts: dict, block: int, join: Callable, schema: str, by: list[str], k: int, bounded: Callable[[DataFrame], DataFrame], space: Space) -> DataFrame:
    """The first k of each anchor (and place): own cells first, then what their bounds leave of the others."""
    spark = rows.sparkSession
    everywhere = [(c, g, 0.0, float("inf")) for c, groups in homes.items() for g in groups]
    own = _meet(rows, anchors, everywhere, counts, block, join, schema)
    own = Written(_first(own, by, k), "own").df if own is not None else spark.createDataFrame([], f"{schema}, rank int")
    if all(set(groups) == {g for x in homes.values() for g in x} for groups in (homes.get(c, []) for c in counts)):
        return own  # each group's own cells are all cells
    still = Written(bounded(own), "bounded").df
    rest = _meet(rows, still, _intervals(still, space, homes), counts, block, join, schema)
    return own if rest is None else Written(_first(own.drop("rank").unionByName(rest), by, k), "best").df


def _hundredth(n: Column) -> Column:
    """The floor of n / 100, in whole numbers."""
    return F.call_function("div", n - F.pmod(n, F.lit(100).cast("long")), F.lit(100).cast("long"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, embedding, label); is_anchor is a condition on vec_id and label."""
    with Scratch() as own:
        return own.keep(Written(_mined(vectors, is_anchor, positives, negatives, low, high, scale, pivots, group, block), "hard_negatives")).df


def _mined(vectors: DataFrame, is_anchor: Column, positives: int, negatives: int, low: int, high: int, scale: int, pivots: int, group: int, block: int) -> DataFrame:
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    usable = Written(_usable(vectors, scale), "usable").df
    space = _space(usable, pivots)
    if space is None:
        return spark.createDataFrame([], out)
    rows = Written(_in_cells(usable, space), "cells").df
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    homed = Written(_with_cell(rows.where(is_anchor), space), "anchors").df
    homes = _groups({r["home"]: r["count"] for r in homed.groupBy("home").count().collect()}, space, group)
    if not homes:
        return spark.createDataFrame([], out)
    size = len(space.pivots)
    first, many = _lookup({c: g[0] for c, g in homes.items()}, size, "home"), _lookup({c: len(g) for c, g in homes.items()}, size, "home")
    anchors = homed.withColumn("group", (first + F.pmod(F.xxhash64("row"), F.greatest(many, F.lit(1)))).cast("int")).drop("home")

    def reach_of_positives(own: DataFrame) -> DataFrame:
        worst = own.groupBy("anchor").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("worst"))
        from_score = F.when(F.col("have") >= positives, F.col("worst").cast("double")).otherwise(F.lit(float("-inf")))
        return anchors.join(worst, anchors["row"] == worst["anchor"], "left").select(anchors["*"], from_score.alias("from_score"), F.lit(float("inf")).alias("to_score"))

    best = _joined(rows, anchors, homes, counts, block, _positives(space, positives), "anchor long, score long, vec_id long, row long", ["anchor"], positives, reach_of_positives, space)
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list"))
    low_of = F.transform("list", lambda p: -_hundredth(-low * p["score"]))
    high_of = F.transform("list", lambda p: _hundredth(high * p["score"]))
    paired = Written(anchors.join(listed, anchors["row"] == listed["anchor"]).select(anchors["*"], "list", low_of.alias("least"), high_of.alias("most")), "positives").df

    def reach_of_negatives(own: DataFrame) -> DataFrame:
        worst = own.groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("worst")).where(F.col("have") >= negatives)
        worst = worst.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "worst"))).alias("worst"))
        still = F.transform("least", lambda v, i: F.greatest(v, F.element_at("worst", i)))  # without an entry, the band's own end
        bounds = paired.join(worst, paired["row"] == worst["anchor"], "left").select(*(paired[c] for c in paired.columns if c != "least"), still.alias("least"))
        return bounds.withColumn("from_score", F.array_min("least").cast("double")).withColumn("to_score", F.array_max("most").cast("double"))

    found = _joined(rows, paired, homes, counts, block, _negatives(space, negatives), "anchor long, place int, score long, vec_id long, row long", ["anchor", "place"], negatives, reach_of_negatives, space)
    named = paired.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("list").alias("place", "positive"))
    return found.join(named, (found["anchor"] == named["row"]) & (found["place"] == named["place"])).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
