"""Scoped search: what a request may not read is never joined, and nothing of it shows."""

from pyspark.sql import functions as F

from heronlake.operators import retrieval
from heronlake.operators.search import search_requests


def _world(spark):
    e = spark.createDataFrame(
        [(w, kb, g, s, i, i, t, v) for w, kb, g, s, i, t, v in [
            (1, 10, 100, "published", 1, "alpha beta", [1.0, 0.0]), (1, 10, 100, "staging", 2, "alpha", [1.0, 0.0]), (1, 10, 99, "published", 3, "alpha", [1.0, 0.0]), (1, 11, 110, "published", 4, "alpha", [0.8, 0.6]),
            (2, 20, 200, "published", 5, "alpha", [1.0, 0.0]), (1, 12, 120, "published", 6, "alpha", [1.0, 0.0]), (1, 10, 100, "published", 7, "alpha", [1.0, 0.0, 0.0])]],
        "workspace_id int, kb_id int, generation_id int, state string, entry_id long, parent_id long, text string, embedding array<double>",
    )
    bases = spark.createDataFrame([(1, 10, 100, None), (1, 11, 110, None), (2, 20, 200, None), (1, 12, 120, 1)], "workspace_id int, kb_id int, active_generation_id int, deleted_at int")
    generations = spark.createDataFrame([(1, 10, 100, 2), (1, 10, 99, 2), (1, 11, 110, 2), (2, 20, 200, 2), (1, 12, 120, 2)], "workspace_id int, kb_id int, generation_id int, dimension int")
    grants = spark.createDataFrame([("a", 1, True, []), ("b", 2, False, [20, 10])], "key_id string, workspace_id int, unrestricted boolean, kb_ids array<int>")
    requests = [(1, "a", [10, 11]), (2, "a", [10, 20]), (3, "b", [20]), (4, "b", [10]), (5, "a", []), (6, "a", [12]), (7, "none", [10]), (8, "a", [10, 10, 11, 11])]
    asked = spark.createDataFrame([(*r, "alpha", [1.0, 0.0]) for r in requests], "request_id int, key_id string, kb_ids array<int>, query string, embedding array<double>")
    return asked, grants, bases, generations, e


def test_requests_see_their_own(spark):
    found, statuses = search_requests(*_world(spark))
    assert {r.request_id: r.status for r in statuses.collect()} == {1: "ok", 2: "not_found", 3: "ok", 4: "not_found", 5: "invalid", 6: "not_found", 7: "not_found", 8: "ok"}
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.kb_id, r.entry_id))
    assert got == {1: [(10, 1), (11, 4)], 3: [(20, 5)], 8: [(10, 1), (11, 4)]}


def test_no_cross_join(spark):
    asked, grants, bases, generations, e = _world(spark)
    found, _ = search_requests(asked, grants, bases, generations, e)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_one_rerank_over_all_bases(spark):
    found, _ = search_requests(*_world(spark), final_k=1, scorer=lambda t: F.when(t == "alpha", 1.0).otherwise(0.0))
    assert [(r.query_id, r.kb_id, r.entry_id, r.stage) for r in found.where("query_id = 1").collect()] == [(1, 11, 4, "rerank")]


def test_granted_groups_are_those_of_all_groups(spark):
    """With every group granted, results are those without grants."""
    *_, e = _world(spark)
    q = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "beta", [0.0, 1.0])], "query_id int, query string, embedding array<double>")
    every = q.select("query_id").crossJoin(e.select("kb_id").distinct())
    a, b = (sorted(map(str, retrieval.hybrid(e, q, by="kb_id", granted=g).collect())) for g in (None, every))
    assert a == b
