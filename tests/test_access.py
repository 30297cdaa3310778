from plan_rows import most_rows
from pyspark.sql import functions as F

from heronlake.operators import access


def _tables(spark, keys, bases):
    kbs = spark.range(bases).selectExpr("id % 2 as workspace_id", "id as kb_id", "if(id % 7 = 0, 1, null) as deleted_at")
    grants = spark.range(keys).selectExpr("id as key_id", "id % 2 as workspace_id", "id % 5 = 0 as unrestricted", "array(id % 20 + 1, id % 13 + 1, id % 20 + 1, 9999) as kb_ids")
    return kbs, grants


def test_lists_are_the_pairs(spark):
    kbs, grants = _tables(spark, 60, 40)
    pairs = access.allowed(kbs, grants).groupBy("key_id").agg(F.array_sort(F.collect_list("kb_id")).alias("allowed"))
    lists = access.allowed_lists(kbs, grants)
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, pairs.collect()))


def test_status_by_list_and_by_pairs(spark):
    kbs, grants = _tables(spark, 60, 40)
    lists = access.allowed_lists(kbs, grants)
    mine = lists.select(F.col("key_id").alias("request_id"), "key_id", F.expr("case key_id % 4 when 0 then concat(slice(allowed, 1, 3), array(null), slice(allowed, 1, 2)) when 1 then concat(allowed, array(0L)) when 2 then array() else sequence(1L, 30L) end").alias("kb_ids"), "allowed")
    by_list = access.requested(mine)
    by_pairs = access.requested(mine.drop("allowed"), access.allowed(kbs, grants))
    got = sorted(map(repr, by_list.collect()))
    assert got == sorted(map(repr, by_pairs.collect()))
    kinds = {(r.request_id % 4, r.status) for r in by_list.collect()}
    assert (0, "ok") in kinds and (1, "not_found") in kinds and (2, "invalid") in kinds and (3, "invalid") in kinds
    unknown = mine.limit(1).select(F.lit(-1).alias("request_id"), F.lit(-1).cast("long").alias("key_id"), F.array(F.lit(1).cast("long")).alias("kb_ids"))
    assert [r.status for r in access.requested(unknown, access.allowed(kbs, grants)).collect()] == ["not_found"]
    none = mine.limit(1).select("request_id", "key_id", F.lit(None).cast("array<bigint>").alias("kb_ids"))
    assert [(r.kb_id, r.position, r.status) for r in access.requested(none, access.allowed(kbs, grants)).collect()] == [(None, None, "invalid")]


def test_pairs_of_keys_and_bases_are_not_joined(spark):
    """The query's unrestricted keys see many bases: these aren't paired with the keys before the result is written."""
    from heronlake.plans import registry

    got, most = most_rows(registry.QUERIES["multi_kb_request"](spark, "/root/testdata/sf0.1"), "Join")
    assert 0 < most < len(got) / 4
