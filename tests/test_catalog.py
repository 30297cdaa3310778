from plan_rows import most_rows

from heronlake.operators import catalog


def test_reuse_meets_one_revision_of_each_content(spark):
    """Requests for a content that many documents share don't meet all of these."""
    n = 2000
    asked = spark.range(n).selectExpr("id as request_id", "1 as kb_id", "7 as content_hash").unionByName(spark.sql("select 5L as request_id, 2 as kb_id, 7 as content_hash"))
    docs = spark.range(n).selectExpr("if(id = 3, 2, 1) as kb_id", "id as document_id", "id + 10000 as active_revision_id", "if(id = 1999, 1, null) as deleted_at")
    revs = spark.range(n).selectExpr("id + 10000 as revision_id", "id as document_id", "7 as content_hash", "if(id = 1998, 'failed', 'ready') as status", "if(id = 3, 999, id div 10) as created_at")
    got, most = most_rows(catalog.reusable_revisions(asked, docs, revs), "Join")
    assert {r.request_id: r.revision_id for r in got} == {i: 10003 if i == 5 else 11997 for i in range(n)} and len(got) == n
    assert 0 < most <= 2 * n


def test_reuse_without_times(spark):
    """A revision without a time comes after all others; equal times go by the larger id."""
    asked = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 1, 9)], "request_id int, kb_id int, content_hash int")
    docs = spark.createDataFrame([(1, d, d, None) for d in (1, 2, 3, 4)], "kb_id int, document_id int, active_revision_id int, deleted_at int")
    revs = spark.createDataFrame([(1, 1, 7, "ready", 5), (2, 2, 7, "ready", None), (3, 3, 8, "ready", None), (4, 4, 8, "ready", None)], "revision_id int, document_id int, content_hash int, status string, created_at int")
    assert sorted(tuple(r) for r in catalog.reusable_revisions(asked, docs, revs).collect()) == [(1, 1), (2, 4)]
