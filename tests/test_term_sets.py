import random

import numpy as np
import pyarrow as pa
import pytest
from plan_rows import most_rows
from pyspark.sql import functions as F

from heronlake.operators import index, retrieval, term_sets

WORDS = [f"w{i}" for i in range(12)]


def _texts(n, seed, longest=40):
    r = random.Random(seed)
    return [(i, i % 3, " ".join(r.choices(WORDS, k=r.randrange(longest)))) for i in range(n)]


def _queries(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choices([*WORDS, "absent", "W1,"], k=r.choice((0, 1, 2, 2, 3, 4))))) for i in range(n)]


def _rows(df):
    return sorted((r.query_id, *((r.kb_id,) if "kb_id" in r else ()), r["rank"], r.entry_id, round(r.score, 12)) for r in df.collect())


@pytest.mark.parametrize("by", [None, "kb_id"])
def test_sets_give_what_joins_give(spark, tmp_path, monkeypatch, by):
    entries = spark.createDataFrame(_texts(300, 1), "entry_id long, kb_id int, text string").repartition(3)
    queries = spark.createDataFrame(_queries(60, 2), "query_id long, query string")
    postings = index.Postings.build(entries, str(tmp_path / "p"), by="kb_id")
    got = _rows(retrieval.keyword_top(entries, queries, 5, by=by)), _rows(postings.search(queries, 5, by))
    monkeypatch.setattr(term_sets, "MOST_SETS", 0)
    want = _rows(retrieval.keyword_top(entries, queries, 5, by=by)), _rows(postings.search(queries, 5, by))
    assert want[0] and got[0] == want[0] and got[1] == want[1] == want[0]


def test_text_ids(spark, monkeypatch):
    entries = spark.createDataFrame(_texts(80, 5), "entry_id long, kb_id int, text string").withColumn("entry_id", F.concat(F.lit("e"), "entry_id"))
    queries = spark.createDataFrame(_queries(20, 6), "query_id long, query string").withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    got = _rows(retrieval.keyword_top(entries, queries, 4))
    monkeypatch.setattr(term_sets, "MOST_SETS", 0)
    assert got and got == _rows(retrieval.keyword_top(entries, queries, 4))


@pytest.mark.parametrize("held", [3, 1000])
def test_small_blocks(monkeypatch, held):
    """Pairs, places and kept rows are cut anywhere; no pair that counts is lost by the bound."""
    monkeypatch.setattr(term_sets, "CELLS", 7)
    monkeypatch.setattr(term_sets, "PLACES", 5)
    monkeypatch.setattr(term_sets, "HELD", held)
    texts, asked = _texts(60, 3, 12), [sorted({*q.lower().replace(",", "").split()}) for _, q in _queries(30, 4)]
    asked = [q for q in asked if q]
    sets = term_sets.TermSets(pa.table({"_set": pa.array(range(len(asked)), pa.int64()), "terms": pa.array(asked, pa.list_(pa.string()))}))
    code = {t: i for i, t in enumerate(sets.terms.to_pylist())}
    best, out = term_sets.Best(4, sets.ids, pa.int64(), [], ["_set", "entry_id", "score"]), []
    for lo in range(0, 60, 10):
        posts = [(row, code[t], [p for p, x in enumerate(text.split()) if x == t]) for row, (_, _, text) in enumerate(texts[lo : lo + 10]) for t in sorted({*text.split()} & {*code})]
        block = term_sets.Block(10, *(np.array([p[i] for p in posts]) for i in (0, 1)), np.array([len(p[2]) for p in posts]), np.array([x for p in posts for x in p[2]]))
        out += list(best.take(sets, block, [], pa.array(range(lo, lo + 10), pa.int64())))
    out += list(best.given())
    got = sorted((s, -round(x, 9), e) for b in out for s, e, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    want = []
    for s, q in enumerate(asked):
        scores = []
        for e, _, text in texts:
            at = [(p, t) for p, t in enumerate(text.split()) if t in q]
            if {t for _, t in at} == {*q}:
                covers = {}
                for i in range(len(at)):
                    for j in range(i, len(at)):
                        if {t for _, t in at[i : j + 1]} == {*q}:
                            covers[(i, j)] = 0.1 / (1 + at[j][0] - at[i][0] - (j - i))
                least = [c for c in covers if not any(d != c and c[0] <= d[0] and d[1] <= c[1] for d in covers)]
                scores.append((s, -round(sum(covers[c] for c in least), 9), e))
        want += sorted(scores)[:4]
    first = [x for s in range(len(asked)) for x in [y for y in got if y[0] == s][:4]]
    assert first == sorted(want)


def test_rounds_as_spark(spark):
    x = [0.1 / 512, 0.1 / 1024, 0.3 / 512, 0.1, 2.5e-9, 1.5e-9, 0.0, -0.25, 1 / 3, *(0.1 / (1 + n) for n in range(3000))]
    want = [round(r.v * 1e9) for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 9).alias("v")).collect()]
    assert term_sets.round9(np.array(x)).tolist() == want


def test_queries_do_not_meet_postings(spark, tmp_path):
    """Many queries of the same words, and many entries that hold them: the two aren't joined."""
    entries = spark.range(400).selectExpr("id as entry_id", "concat('the word ', id, ' the') as text")
    queries = spark.range(300).selectExpr("id as query_id", "if(id % 2 = 0, 'the word', 'word the') as query")
    postings = index.Postings.build(entries, str(tmp_path / "p"))
    for df in (retrieval.keyword_top(entries, queries, 3), postings.search(queries, 3)):
        got, most = most_rows(df, "Join")
        assert len(got) == 900 and {r.entry_id for r in got} == {0, 1, 2} and most <= 1000


def test_equal_vectors_over_blocks(spark):
    """Equal scores go by id, wherever the rows lie."""
    entries = spark.range(3000).selectExpr("id as entry_id", "array(double(id % 3), 1D) as embedding").repartition(5)
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], "query_id long, embedding array<double>")
    got = retrieval.vector_top_batch(entries, queries, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.entry_id) for r in got] == [(q, e) for q, first in ((1, 0), (2, 2)) for e in range(first, first + 12, 3)]
