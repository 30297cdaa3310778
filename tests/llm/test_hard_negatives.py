"""Hard negatives against brute force: scores, ties, bands, many groups, pruning, odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.llm import hard_negatives, registry
from heronlake.llm.common import table

SF = "/root/testdata/sf0.001"
COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def slow_mine(rows, positives=5, negatives=10, low=30, high=90, scale=256, step=100):
    """rows: (vec_id, vector, label)."""
    fit = []
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            fit.append((vec_id, [math.floor(scale * float(v)) for v in x], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (vec_id, x, label) in enumerate(fit):
        if vec_id is None or vec_id % step:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=False)), last(i), i, other) for k, (i, y, other) in enumerate(fit) if k != a), key=lambda t: t[:2])
        for ps, _, p, _ in [t for t in scored if t[3] == label][:positives]:
            ps = -ps
            near = [(i, -s) for s, _, i, other in scored if other != label and low * ps <= 100 * -s <= high * ps][:negatives]
            out += [(vec_id, p, k + 1, i, ps, s) for k, (i, s) in enumerate(near)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=key)


def test_query(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table(spark, SF, "embeddings").collect()]
    got = rows_of(registry.QUERIES["op11_hard_negatives"](spark, SF))
    assert got == sorted(slow_mine(rows), key=key) and len(got) > 100


def clustered(n, centres, width, seed, labels=4):
    draw = np.random.default_rng(seed)
    at = draw.normal(0, 4, (centres, width))
    return [(i, (at[c] + draw.normal(0, 0.3, width)).tolist(), int(draw.integers(labels))) for i, c in enumerate(draw.integers(centres, size=n))]


@pytest.mark.parametrize("group, block, pivots", [(4096, 4096, 64), (3, 16, 8), (1, 1000, 40), (50, 20, 1)])
def test_groups_and_blocks(spark, group, block, pivots):
    rows = clustered(400, 12, 6, 5) + [(1000 + i, [1.0, 2.0, 3.0, 0.5, -1.0, 2.0], i % 3) for i in range(120)]  # a third or so are one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = rows_of(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, pivots=pivots, group=group, block=block))
    assert got == sorted(slow_mine(rows, step=10), key=key)


def test_bounds_prune(spark, monkeypatch):
    """Of unit vectors in clusters, few rows are sent to groups of other cells, and the result is right all the same."""
    sent = []
    meet = hard_negatives._meet

    def counted(rows, anchors, routes, counts, *rest):
        way = spark.createDataFrame(routes, "cell int, group int, nearest double, farthest double")
        sent.append((rows.join(way, "cell").where("dist between nearest and farthest").count(), anchors.select("group").distinct().count()))
        return meet(rows, anchors, routes, counts, *rest)

    monkeypatch.setattr(hard_negatives, "_meet", counted)
    rows = [(i, (np.array(x) / np.linalg.norm(x)).tolist(), label) for i, x, label in clustered(900, 30, 5, 9, labels=2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = rows_of(hard_negatives.mine(df, F.col("vec_id") % 20 == 0, pivots=40, group=4, block=100, low=80, high=100, scale=4096))
    assert got == sorted(slow_mine(rows, step=20, low=80, high=100, scale=4096), key=key) and got
    assert len(sent) == 4 and all(n < 900 * groups / 3 for n, groups in sent), sent


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (0, [1.0, 0.9], 2), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [1.0, 1.0], None), (None, [1.0, 0.8], 2), (None, [1.0, 0.7], 1), (6, [0.5], 2), (7, [], 2), (-100, [-1.0, 0.0], 1), (8, [1e3, 2e3], 2), (9, [0.9, 1.0], 2), (100, [0.0, 0.0], 3), (200, [0.2, 0.1], 3)]
    df = spark.createDataFrame([(*r, 1.0, "c", 3) for r in rows], "vec_id long, embedding array<double>, label int, dist double, cell string, row int")
    got = rows_of(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, group=1, block=2, pivots=3))
    assert got == sorted(slow_mine(rows), key=key) and got
    assert rows_of(hard_negatives.mine(df.where("false"), F.lit(True))) == []
    assert rows_of(hard_negatives.mine(df, F.lit(False))) == []
    big = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hard_negatives.mine(big, F.lit(True))
    large = [(i, [float(1 << 19) + i, 3.0 * i], i % 2) for i in range(12)]  # scores beyond what floating numbers hold exactly
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")
    assert rows_of(hard_negatives.mine(df, F.lit(True), high=100, pivots=2, group=3)) == sorted(slow_mine(large, step=1, high=100), key=key)
