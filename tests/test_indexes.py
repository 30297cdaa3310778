"""Stored indexes: quantised vectors in pruned cells, postings in blocks with early stop, segments that follow publications."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import index, retrieval
from heronlake.operators.live_postings import LivePostings, changes
from heronlake.operators.vector_index import Quantiser, VectorIndex

# --- vectors ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 32))
    rows = [(f"e{k}", (centres[c] + draw.normal(0, 0.25, 32)).tolist(), int(c) % 3) for k, c in enumerate(draw.integers(60, size=6000))]
    odd = [("null", None, 0), ("zero", [0.0] * 32, 0), ("nan", [float("nan")] * 32, 1), ("short", [1.0, 2.0], 1), ("short2", [2.0, 1.0], 2), ("hole", [1.0, None], 0)]
    return spark.createDataFrame(rows + odd, "entry_id string, embedding array<double>, kb_id int")


@pytest.fixture(scope="module")
def stored(clustered, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('vectors')}/index"
    VectorIndex.build(clustered.repartition(4), path, "kb_id")
    return path


def exact_best(clustered, queries, k, by=None):
    rows = [(r.entry_id, np.array(r.embedding), r.kb_id) for r in clustered.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    out = {}
    for q in queries.collect():
        v = np.array(q.embedding)
        s = sorted((-round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 9), e, kb) for e, x, kb in rows if len(x) == len(v))
        for kb in {r[2] for r in s} if by else [None]:
            out[q.query_id, kb] = [e for _, e, g in s if not by or g == kb][:k]
    return out


def found(df, by=None):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault((r.query_id, r[by] if by else None), []).append(r.entry_id)
    return out


@pytest.mark.parametrize("by", [None, "kb_id"])
def test_vector_index_recall_and_pruning(spark, clustered, stored, by):
    """Another reader of the folder finds nine tenths of the best with few of the cells, and reads only their files."""
    i = VectorIndex(spark, stored, probes=8)
    queries = clustered.where("try_cast(substring(entry_id, 2) as int) % 150 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    want, got = exact_best(clustered, queries, 10, by), found(i.search(queries, 10, by), by)
    hits = sum(len(set(got.get(q, [])) & set(x)) for q, x in want.items())
    assert hits >= (0.9 if by is None else 0.85) * sum(map(len, want.values()))
    cells = sorted(r.cell for r in i.asked(queries.limit(3), 32).select("cell").distinct().collect())
    blocks = i.codes(32, cells)
    assert re.search(r"PartitionFilters: \[.*cell#", blocks._jdf.queryExecution().toString())
    read = {r.f for r in blocks.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and {int(re.search(r"/cell=(\d+)/", f)[1]) for f in read} == set(cells)
    size = lambda folder: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))
    whole = size(f"{stored}/d=32/codes")
    assert sum(size(f"{stored}/d=32/codes/cell={c}") for c in cells) < 0.4 * whole
    assert len(i.quantisers[32].centres) == 77 and i.search(queries, 10).count() == 10 * queries.count()


def test_vector_index_all_cells_is_exact(spark, clustered, stored):
    """With all cells and everything rescored, results are those of exact search, in each dimension."""
    i = VectorIndex(spark, stored, probes=100, refine=700)
    queries = clustered.where("entry_id in ('e5', 'e77', 'short', 'zero', 'nan', 'null')").select(F.col("entry_id").alias("query_id"), "embedding")
    want = {q: x for q, x in exact_best(clustered, queries.where("entry_id in ('e5', 'e77', 'short')".replace("entry_id", "query_id")), 10).items()}
    assert found(i.search(queries, 10)) == want and want["short", None] == ["short", "short2"]


def test_vector_index_holds_every_row(spark, clustered, stored):
    ids = [r.id for d in (2, 32) for r in spark.read.parquet(f"{stored}/d={d}/codes").select(F.explode("ids").alias("id")).collect()]
    assert len(ids) == len(set(ids)) == 6002


def test_hybrid_takes_the_index(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from heronlake.plans.tables import entries, search_queries

    e, q = entries(spark, sf), search_queries(spark, sf)
    i = VectorIndex.build(e, f"{tmp_path}/v", probes=1000, refine=1000)
    a, b = (sorted(map(str, retrieval.hybrid(e, q, vectors=v).collect())) for v in (None, i))
    assert a == b


def test_calibration_meets_its_recall(spark, clustered, stored):
    queries = clustered.where("try_cast(substring(entry_id, 2) as int) % 400 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    exact = spark.createDataFrame([(q, e) for (q, _), x in exact_best(clustered, queries, 10).items() for e in x], "query_id string, entry_id string")
    tuned = VectorIndex(spark, stored, refine=2).calibrate(queries, exact, 10, 0.95)
    assert tuned.search(queries, 10).join(exact, ["query_id", "entry_id"], "left_semi").count() >= 0.95 * exact.count()


def test_codewords_are_near():
    v = np.random.default_rng(1).normal(size=(3000, 10))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = Quantiser.fit(v, 20)
    again = Quantiser.of(q.row())
    cell = again.near(v, 1)[:, 0]
    codes = again.code(v, cell)
    for c in range(20):
        own = cell == c
        assert np.abs(again.scores(v[:50], c, codes[own]) - v[:50] @ v[own].T).max() < 0.35
    assert [w.shape[1] for w in q.words] == [4, 4, 2]


# --- postings ---------------------------------------------------------------------------------------------------------------

WORDS = [f"w{k}" for k in range(12)]


def random_entries(r, ids):
    return [(k, k % 3, " ".join(r.choices(WORDS, weights=range(12, 0, -1), k=r.randrange(0, 25)))) for k in ids]


SCHEMA = "entry_id long, kb_id int, text string"


@pytest.mark.parametrize("by", [None, "kb_id"])
def test_blocks_give_the_same_rows_and_fewer_postings(spark, tmp_path, monkeypatch, by):
    monkeypatch.setattr(index, "BLOCK", 8)
    r = random.Random(1)
    e = spark.createDataFrame(random_entries(r, range(800)), SCHEMA)
    q = spark.createDataFrame([(k, w) for k, w in enumerate([*WORDS, "w0 w1", "w2 w3 w4", "nothing", "", "w1 nothing"])], "query_id long, query string")
    p = index.Postings.build(e, f"{tmp_path}/p", by=by)
    key = lambda df: sorted(tuple(map(str, (x.query_id, x[by] if by else 0, x.entry_id, round(x.score, 6), x["rank"]))) for x in df.collect())
    assert key(p.search(q, 5, by)) == key(retrieval.keyword_top(e, q, 5, by=by))
    every = p.blocks(["w0"])
    needed = index.needed_blocks(every, 5, [by] if by else [])
    total, read = (df.agg(F.sum("n")).first()[0] for df in (every, needed))
    assert read < total / 3 and needed.count() >= 1
    assert every.where("n <> size(ids) or max_tf < min_tf or n > 8").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_segments_follow_changes(spark, tmp_path, seed):
    """After random changes and merges, the index answers as one built anew from the final state."""
    r = random.Random(seed)
    live, now = LivePostings(spark, f"{tmp_path}/live", "kb_id"), {}
    q = spark.createDataFrame([(k, w) for k, w in enumerate([*WORDS[:4], "w0 w1", "w3 w2"])], "query_id long, query string")
    key = lambda df: sorted((x.query_id, x.kb_id, x.entry_id, round(x.score, 6), x["rank"]) for x in df.collect())
    for turn in range(4):
        ids = r.sample(range(60), r.choice([3, 8, 40]))
        gone = r.sample(sorted(now), min(len(now), r.choice([0, 2, 10])))
        came = random_entries(r, [k for k in ids if k not in gone])
        live.apply(spark.createDataFrame(came, SCHEMA), spark.createDataFrame([(k,) for k in gone], "entry_id long"))
        now = {k: v for k, v in now.items() if k not in gone} | {x[0]: x for x in came}
        if turn in (1, 3):
            live.merge(ratio=r.choice([1, 4, 100]))
        state = spark.createDataFrame(sorted(now.values()), SCHEMA)
        assert key(live.search(q, 4, "kb_id")) == key(retrieval.keyword_top(state, q, 4, by="kb_id"))
    live.merge(ratio=10**6)
    assert len(live.segments()) == 1 and live.segments()[0]["gone"] == 0
    assert key(LivePostings(spark, f"{tmp_path}/live", "kb_id").search(q, 4, "kb_id")) == key(retrieval.keyword_top(state, q, 4, by="kb_id"))


def test_a_publication_shows_in_search(spark, tmp_path):
    old = spark.createDataFrame([(1, "published", 0, "alpha beta"), (2, "staging", 0, "alpha"), (3, "published", 0, "alpha")], "entry_id long, state string, kb_id int, text string")
    new = old.withColumn("state", F.when(F.col("entry_id") == 2, "published").when(F.col("entry_id") == 3, "retired").otherwise(F.col("state")))
    live = LivePostings(spark, f"{tmp_path}/live", "kb_id")
    with pytest.raises(FileNotFoundError):
        live.search(old.select(F.col("entry_id").alias("query_id"), F.col("text").alias("query")))
    none = old.where("false")
    live.apply(*changes(none, old))
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert {x.entry_id for x in live.search(q).collect()} == {1, 3}
    before = os.listdir(f"{tmp_path}/live")
    live.apply(*changes(old, new))
    assert {x.entry_id for x in live.search(q).collect()} == {1, 2} and set(before) < set(os.listdir(f"{tmp_path}/live"))


def test_calibration_needs_few_searches(spark, tmp_path, monkeypatch):
    """Vectors without clusters need most cells; these are found by counting, not by searching with more and more of them."""
    r = np.random.default_rng(7)
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(1500, 16)))], "entry_id long, embedding array<double>")
    queries = e.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    exact, seen, search = retrieval.vector_top_batch(e, queries, 10), [], VectorIndex.search
    monkeypatch.setattr(VectorIndex, "search", lambda self, *a, **b: seen.append(self.probes) or search(self, *a, **b))
    tuned = VectorIndex.build(e, f"{tmp_path}/v", refine=20).calibrate(queries, exact, 10)
    assert len(seen) <= 2 and tuned.search(queries, 10).join(exact, ["query_id", "entry_id"], "left_semi").count() >= 0.9 * 10 * 30
