"""Scope: no table without a workspace, scans of one partition, changes that stay within."""

import os

import pytest
import test_search
from pyspark.sql import functions as F

from heronlake.operators import lifecycle
from heronlake.operators.search import search_requests
from heronlake.operators.tenants import PARTITION, ScopeError, Tenants


def _docs(spark, tmp_path):
    rows = lambda status: [(w, w * 10 + i, status, "e", 5) for w in (1, 2, 30) for i in range(3)]
    schema = "workspace_id int, document_id int, status string, error string, deleted_at int"
    d, f = spark.createDataFrame(rows("ready"), schema), spark.createDataFrame(rows("failed"), schema).drop("deleted_at")
    return Tenants(spark, f"file://{tmp_path}/t").load(documents=d, revisions=f, jobs=f)


def test_no_table_without_a_workspace(spark, tmp_path):
    t = _docs(spark, tmp_path)
    with pytest.raises(ScopeError):
        t.table("documents")
    for bad in (None, "", True, 1.5):
        with pytest.raises(ScopeError):
            t.within(bad)
    assert t.within(99).table("documents").count() == 0
    assert sorted(r.document_id for r in t.within(2).table("documents").collect()) == [20, 21, 22]
    with pytest.raises(Exception, match="no workspace"):
        t.load(other=spark.createDataFrame([(None, 1)], "workspace_id int, x int"))


def test_a_scan_reads_one_partition(spark, tmp_path):
    plan = _docs(spark, tmp_path).within(2).table("documents")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" + PARTITION in plan and f"({PARTITION}" in plan and "w-2" in plan
    assert "EqualTo(workspace_id,2)" in plan


def test_text_ids(spark, tmp_path):
    names = ["007", "7", "a/b =%", "ü"]
    t = Tenants(spark, f"file://{tmp_path}/t").load(x=spark.createDataFrame([(n, i) for i, n in enumerate(names)], "workspace_id string, v int"))
    assert [[r.v for r in t.within(n).table("x").collect()] for n in names] == [[0], [1], [2], [3]]
    for n in names:
        t.within(n).change(lambda x: (x.withColumn("v", F.col("v") + 10),), ["x"], ["x"])
    assert [[(r.workspace_id, r.v) for r in t.within(n).table("x").collect()] for n in names] == [[(n, 10 + i)] for i, n in enumerate(names)]


def test_changes_stay_within(spark, tmp_path):
    t = _docs(spark, tmp_path)
    before = {w: sorted(map(tuple, t.within(w).table("jobs").collect())) for w in (1, 30)}
    asked = spark.createDataFrame([(2, 20), (2, 22), (1, 21), (1, 10)], "workspace_id int, document_id int")
    names = ["documents", "revisions", "jobs"]
    assert t.within(2).change(lifecycle.retry_documents, names, names, asked) == []
    for n in ("revisions", "jobs"):
        assert {(r.workspace_id, r.document_id): r.status for r in t.within(2).table(n).collect()} == {(2, 20): "pending", (2, 21): "failed", (2, 22): "pending"}
    assert {r.document_id: r.deleted_at for r in t.within(2).table("documents").collect()} == {20: None, 21: 5, 22: None}
    assert before == {w: sorted(map(tuple, t.within(w).table("jobs").collect())) for w in (1, 30)}
    # without the column, ids of other workspaces' documents find nothing
    t.within(1).change(lifecycle.retry_documents, names, names, asked.drop("workspace_id"))
    assert sum(r.status == "pending" for r in t.within(1).table("jobs").collect()) == 1
    # a second change rests on the first
    t.within(2).change(lifecycle.retry_documents, names, names, spark.createDataFrame([(21,)], "document_id int"))
    assert t.within(2).table("jobs").where("status = 'pending'").count() == 3


def test_of_two_changes_one_wins(spark, tmp_path):
    t = _docs(spark, tmp_path)
    w = t.within(2)

    def slow(jobs):
        w.change(lambda j: (j.withColumn("error", F.lit("first")),), ["jobs"], ["jobs"])
        return (jobs.withColumn("error", F.lit("second")),)

    with pytest.raises(RuntimeError):
        t.within(2).change(slow, ["jobs"], ["jobs"])
    assert {r.error for r in w.table("jobs").collect()} == {"first"}
    with pytest.raises(ValueError, match="gives 1"):
        w.change(lambda j: (j,), ["jobs"], ["jobs", "documents"])


def test_search_within(spark, tmp_path):
    """Every request as in the whole, but those of the other workspace's keys, which aren't found."""
    asked, grants, bases, generations, entries = test_search._world(spark)
    t = Tenants(spark, f"file://{tmp_path}/t").load(grants=grants, bases=bases, generations=generations, entries=entries)
    whole, all_statuses = search_requests(asked, grants, bases, generations, entries)
    want = {1: {1, 8}, 2: {3}}
    for w, mine in want.items():
        found, statuses = t.within(w).search(asked)
        assert {r.request_id for r in statuses.collect() if r.status == "ok"} == mine
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.where(F.col("query_id").isin(*mine)).collect()))
    assert {r.request_id for r in all_statuses.collect() if r.status == "ok"} == {1, 3, 8}
    assert not os.path.exists(f"{tmp_path}/t/changed")
