"""Registered queries of guarded transitions, upserts, clean-up, scheduling and synchronisation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text as T
from heronlake.operators import lifecycle as L
from heronlake.operators import state as K
from heronlake.operators import stats as S
from heronlake.operators import sync as D
from heronlake.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _at(text):
    return F.lit(text).cast("timestamp")


# Customers stand for generations and documents, their orders for entries and chunks; 25 knowledge bases are the nations.
_CG = """gen AS (SELECT c_custkey AS generation_id, c_nationkey AS kb_id, CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE c_nationkey END AS base_generation_id, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS source_content_version,
CASE c_custkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' ELSE 'building' END AS status FROM customer)"""
_OE = """en AS (SELECT o_orderkey AS id, o_custkey AS generation_id, o_orderkey AS chunk_id, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'F' THEN 'staging' ELSE 'published' END AS state, o_orderkey % 31 <> 0 AS good FROM orders)"""


def _generations(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("generation_id"), F.col("c_nationkey").alias("kb_id"), F.when(k % 5 == 0, F.lit(7)).otherwise(F.col("c_nationkey")).cast("long").alias("base_generation_id"), F.when(k % 7 == 0, 2).otherwise(1).alias("source_content_version"),
        F.when(k % 4 == 0, "ready").when(k % 4 == 1, "failed").otherwise("building").alias("status"), F.lit(0).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("indexed_count"), F.lit(None).cast("timestamp").alias("ready_at"), F.lit(None).cast("timestamp").alias("retired_at"),
    )


def _bases(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("kb_id"), F.col("n_nationkey").cast("long").alias("active_generation_id"), F.lit(1).alias("content_version"))


def _entries(spark, sf):
    k = F.col("o_orderkey")
    good = k % 31 != 0
    return table(spark, sf, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("generation_id"), k.alias("chunk_id"), F.when(F.col("o_orderstatus") == "P", "published").otherwise("staging").alias("state"), F.when(good, F.array(F.lit(1.0))).alias("embedding"), F.lit(1).alias("dimension"),
        F.lit("t").alias("search_content"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("retired_at"), (k % 40).alias("chunk_set_id"),
    )


def _completed(spark, sf):
    e, g = _entries(spark, sf), _generations(spark, sf)
    staged = e.where("state = 'staging'").groupBy("generation_id").agg(F.count("*").alias("expected"))
    asked = g.where("generation_id % 3 <> 0").select(F.col("generation_id").alias("request_id"), "generation_id").join(staged, "generation_id", "left")
    asked = asked.select("request_id", "generation_id", (F.coalesce("expected", F.lit(0)) + F.when(F.col("generation_id") % 11 == 0, 1).otherwise(0)).alias("expected"), _at("2020-01-01").alias("at"))
    return L.complete_generations(_bases(spark, sf), g, e, asked)


_COMPLETE = f"""{_CG}, {_OE}, st AS (SELECT generation_id, count(*) AS n, count(*) FILTER (good) AS g FROM en WHERE state = 'staging' GROUP BY 1),
done AS (SELECT gen.*, coalesce(n, 0) + CASE WHEN generation_id % 11 = 0 THEN 1 ELSE 0 END AS expected, CASE WHEN status = 'ready' THEN 'already_ready' WHEN status <> 'building' THEN 'not_building' WHEN base_generation_id <> kb_id OR source_content_version <> 1 THEN 'stale'
WHEN coalesce(n, 0) + CASE WHEN generation_id % 11 = 0 THEN 1 ELSE 0 END <> coalesce(n, 0) OR coalesce(g, 0) <> coalesce(n, 0) THEN 'conflict' ELSE 'published' END AS outcome FROM gen LEFT JOIN st USING (generation_id) WHERE generation_id % 3 <> 0)"""


@query(f"WITH {_COMPLETE} SELECT generation_id AS request_id, outcome FROM done")
def complete_generation(spark, sf):
    return _completed(spark, sf)[2]


@query(f"""WITH {_COMPLETE} SELECT gen.generation_id, CASE outcome WHEN 'published' THEN 'ready' WHEN 'stale' THEN 'stale' ELSE gen.status END AS status, CASE WHEN outcome = 'published' THEN expected ELSE 0 END AS indexed_count,
(SELECT count(*) FROM en WHERE en.generation_id = gen.generation_id AND (state = 'published' OR outcome = 'published')) AS n_published FROM gen LEFT JOIN done ON done.generation_id = gen.generation_id""")
def complete_generation_state(spark, sf):
    g, e, _ = _completed(spark, sf)
    n = e.groupBy("generation_id").agg(F.count_if(F.col("state") == "published").alias("n"))
    return g.join(n, "generation_id", "left").select("generation_id", "status", "indexed_count", F.coalesce("n", F.lit(0)).alias("n_published"))


_ACT = f"""{_CG}, a AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY generation_id) AS turn FROM gen WHERE generation_id % 3 <> 0),
done AS (SELECT *, CASE WHEN status <> 'ready' THEN 'not_ready' WHEN base_generation_id <> kb_id OR source_content_version <> 1 THEN 'stale' WHEN turn > 1 THEN 'conflict' ELSE 'activated' END AS outcome FROM a)"""


def _activated(spark, sf):
    g, e = _generations(spark, sf), _entries(spark, sf)
    asked = g.where("generation_id % 3 <> 0").select(F.col("generation_id").alias("request_id"), "generation_id", _at("2020-01-01").alias("at"))
    sets = spark.range(60).select(F.col("id").alias("chunk_set_id"), F.when(F.col("id") % 2 == 0, "ready").otherwise("pending").alias("status"))
    return L.activate_generations(_bases(spark, sf), g, sets, e, asked)


@query(f"WITH {_ACT} SELECT generation_id AS request_id, outcome FROM done")
def activate_generation(spark, sf):
    return _activated(spark, sf)[3]


@query(f"""WITH {_ACT}, act AS (SELECT * FROM done WHERE outcome = 'activated'),
g2 AS (SELECT gen.generation_id, CASE WHEN gen.generation_id IN (SELECT base_generation_id FROM act) THEN 'retired' ELSE gen.status END AS status FROM gen),
used AS (SELECT DISTINCT o_orderkey % 40 AS s FROM orders JOIN g2 ON generation_id = o_custkey WHERE status <> 'retired')
SELECT 'base' AS kind, n_nationkey::BIGINT AS id, coalesce(act.generation_id, n_nationkey)::VARCHAR AS value FROM nation LEFT JOIN act ON kb_id = n_nationkey
UNION ALL SELECT 'generation', generation_id, status FROM g2
UNION ALL SELECT 'chunk_set', s, CASE WHEN s % 2 = 0 AND s NOT IN (SELECT s FROM used) THEN 'archived' WHEN s % 2 = 0 THEN 'ready' ELSE 'pending' END FROM range(60) r(s)""")
def activate_generation_state(spark, sf):
    b, g, s, _ = _activated(spark, sf)
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(value).cast("string").alias("value"))
    return row(b, "base", "kb_id", "active_generation_id").unionByName(row(g, "generation", "generation_id", "status")).unionByName(row(s, "chunk_set", "chunk_set_id", "status"))


# Documents are customers, with one chunk for each of their orders: those divisible by 6 were cut from revision 1, the others from revision 2. A base's active generation is its own number.
# Staged entries: of some disabled chunks too (100), of a foreign chunk revision (41), without a vector (61); some generations are failed or behind their base.
_PUB = """doc AS (SELECT c_custkey AS document_id, c_nationkey AS kb_id, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS old FROM customer),
ch AS (SELECT o_orderkey AS chunk_id, o_custkey AS document_id, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 2 END AS revision_id, o_orderkey % 10 <> 0 AS enabled, o_orderkey % 7 = 0 AS edited FROM orders),
ent AS (SELECT chunk_id, document_id, kb_id, CASE WHEN revision_id = 1 THEN 'published' ELSE 'staging' END AS state, chunk_id % 41 = 0 AS foreign_, chunk_id % 61 <> 0 AS good, enabled FROM ch JOIN doc USING (document_id) WHERE enabled OR chunk_id % 100 = 0),
gen AS (SELECT n_nationkey AS generation_id, CASE WHEN n_nationkey % 8 = 3 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN n_nationkey % 7 = 5 THEN 0 ELSE 1 END AS indexed FROM nation),
need AS (SELECT document_id, count(*) AS n FROM ch WHERE revision_id = 2 AND enabled GROUP BY 1),
have AS (SELECT document_id, count(*) AS n, count(*) FILTER (enabled AND NOT foreign_) AS m, count(*) FILTER (NOT good) AS broken FROM ent WHERE state = 'staging' GROUP BY 1),
done AS (SELECT doc.*, CASE WHEN doc.document_id % 9 = 0 THEN 'stale' WHEN status = 'failed' THEN 'not_found' WHEN indexed <> 1 THEN 'stale' WHEN coalesce(need.n, 0) <> coalesce(have.n, 0) OR coalesce(need.n, 0) <> coalesce(m, 0) THEN 'invalid'
WHEN coalesce(broken, 0) > 0 THEN 'conflict' ELSE 'published' END AS outcome FROM doc JOIN gen ON generation_id = kb_id LEFT JOIN need USING (document_id) LEFT JOIN have USING (document_id) WHERE doc.document_id % 2 = 0)"""


def _published(spark, sf):
    k = F.col("o_orderkey")
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    docs = c.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("long").alias("kb_id"), F.when(F.col("c_custkey") % 5 != 0, 1).alias("active_revision_id"))
    chunks = o.select(k.alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.when(k % 6 == 0, 1).otherwise(2).alias("revision_id"), (k * 10).alias("new_revision_id"), F.when(k % 6 == 0, k * 10).alias("active_revision_id"), (k % 10 != 0).alias("enabled"), F.lit("child").alias("role"), F.when(k % 7 == 0, "user").otherwise("system").alias("edit_source"))
    e = o.where("o_orderkey % 10 <> 0 or o_orderkey % 100 = 0").join(docs.select(F.col("document_id").alias("o_custkey"), "kb_id"), "o_custkey").select(
        k.alias("entry_id"), k.alias("chunk_id"), (k * 10 + F.when(k % 41 == 0, 1).otherwise(0)).alias("chunk_revision_id"), F.col("o_custkey").alias("document_id"), F.col("kb_id").alias("generation_id"), F.when(k % 6 == 0, "published").otherwise("staging").alias("state"),
        F.when(k % 61 != 0, F.array(F.lit(1.0))).alias("embedding"), F.lit(1).alias("dimension"), F.lit("t").alias("search_content"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("retired_at"),
    )
    n = F.col("n_nationkey").cast("long")
    bare = table(spark, sf, "nation").select(n.alias("generation_id"), n.alias("kb_id"), F.when(n % 8 == 3, "failed").otherwise("ready").alias("status"), F.when(n % 7 == 5, 0).otherwise(1).cast("long").alias("indexed_content_version"))
    asked = docs.where("document_id % 2 = 0").select(F.col("document_id").alias("request_id"), "document_id", F.lit(2).alias("revision_id"), F.when(F.col("document_id") % 9 == 0, F.lit(99).cast("long")).when(F.col("document_id") % 4 == 0, F.col("kb_id")).alias("generation_id"), _at("2020-01-01").alias("at"))
    return L.publish_documents(_bases(spark, sf), docs, bare.join(L.recount(bare, docs, chunks, e), "generation_id"), chunks, e, asked)


@query(f"WITH {_PUB} SELECT document_id AS request_id, outcome FROM done")
def publish_document(spark, sf):
    return _published(spark, sf)["outcomes"]


@query(f"""WITH {_PUB} SELECT doc.document_id, CASE WHEN outcome = 'published' THEN 2 ELSE coalesce(doc.old, 0) END AS active_revision_id,
count(chunk_id) FILTER (CASE WHEN outcome = 'published' THEN state = 'staging' ELSE state = 'published' END) AS n_published, count(chunk_id) FILTER (outcome = 'published' AND state = 'published') AS n_retired,
(1 + (SELECT count(*) FROM done d2 WHERE d2.kb_id = doc.kb_id AND d2.outcome = 'published'))::BIGINT AS content_version FROM doc LEFT JOIN done ON done.document_id = doc.document_id LEFT JOIN ent ON ent.document_id = doc.document_id GROUP BY doc.document_id, doc.kb_id, doc.old, outcome""")
def publish_document_state(spark, sf):
    out = _published(spark, sf)
    n = out["entries"].groupBy("document_id").agg(F.count_if(F.col("state") == "published").alias("p"), F.count_if(F.col("state") == "retired").alias("r"))
    return out["documents"].join(n, "document_id", "left").join(out["bases"], "kb_id").select("document_id", F.coalesce("active_revision_id", F.lit(0)).alias("active_revision_id"), F.coalesce("p", F.lit(0)).alias("n_published"), F.coalesce("r", F.lit(0)).alias("n_retired"), F.col("content_version").cast("long").alias("content_version"))


@query(f"""WITH {_PUB}, act AS (SELECT doc.document_id, doc.kb_id, CASE WHEN outcome = 'published' THEN 2 ELSE doc.old END AS rev, outcome FROM doc LEFT JOIN done USING (document_id)),
c AS (SELECT kb_id, count(*) AS n, count(*) FILTER (edited) AS m, count(*) FILTER (NOT enabled) AS d FROM act JOIN ch ON ch.document_id = act.document_id AND ch.revision_id = act.rev GROUP BY 1),
e AS (SELECT ent.kb_id, count(*) AS n FROM ent JOIN act USING (document_id) WHERE CASE WHEN outcome = 'published' THEN state = 'staging' ELSE state = 'published' END GROUP BY 1)
SELECT generation_id, (indexed + (SELECT count(*) FROM done WHERE done.kb_id = generation_id AND outcome = 'published'))::BIGINT AS indexed_content_version, (SELECT count(*) FROM act WHERE act.kb_id = generation_id AND rev IS NOT NULL) AS document_count,
coalesce(c.n, 0) AS chunk_count, coalesce(e.n, 0) AS indexed_count, coalesce(c.m, 0) AS manual_edit_count, coalesce(c.d, 0) AS disabled_chunk_count FROM gen LEFT JOIN c ON c.kb_id = generation_id LEFT JOIN e ON e.kb_id = generation_id""")
def publish_document_counters(spark, sf):
    """Counters moved by differences; the oracle counts everything anew."""
    return _published(spark, sf)["generations"].drop("kb_id", "status")


@query(f"WITH {_PUB} SELECT chunk_id, CASE WHEN revision_id = 1 OR outcome = 'published' THEN chunk_id * 10 ELSE 0 END AS active_revision_id FROM ch LEFT JOIN done USING (document_id)")
def publish_document_chunks(spark, sf):
    return _published(spark, sf)["chunks"].select("chunk_id", F.coalesce("active_revision_id", F.lit(0)).alias("active_revision_id"))


_EDIT = """done AS (SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 8 = 0 THEN 'revision_conflict' WHEN o_orderkey % 9 = 0 THEN 'stale' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 10 = 7 THEN 'conflict' ELSE 'published' END AS outcome, o_orderkey % 3 <> 0 AS enabled FROM orders)"""


def _edited(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    chunks = o.select(k.alias("chunk_id"), (k % 25).alias("kb_id"), F.lit(1).alias("active_revision_id"))
    row = lambda rev, state: o.select(k.alias("chunk_id"), F.lit(rev).alias("revision_id"), F.lit(state).alias("state"), F.when(k % 10 != 7, F.array(F.lit(1.0))).alias("embedding"), F.lit(1).alias("dimension"), F.lit("t").alias("search_content"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("retired_at"))
    asked = o.select(k.alias("request_id"), k.alias("chunk_id"), F.when(k % 8 == 0, 5).otherwise(1).alias("base_revision_id"), F.lit(2).alias("revision_id"), F.when(k % 9 == 0, 3).otherwise(1).alias("content_version"), (k % 3 != 0).alias("enabled"), _at("2020-01-01").alias("at"))
    return L.publish_edits(_bases(spark, sf), chunks, row(1, "published").unionByName(row(2, "staging")), asked)


@query(f"""WITH {_EDIT} SELECT chunk_id, outcome, CASE WHEN outcome = 'published' THEN 2 ELSE 1 END AS active_revision_id, CASE WHEN outcome <> 'published' THEN 'published,staging' WHEN enabled THEN 'retired,published' ELSE 'retired,staging' END AS states FROM done""")
def publish_chunk_edit(spark, sf):
    _, c, e, out = _edited(spark, sf)
    states = e.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("revision_id", "state"))), lambda x: x["state"]), ",").alias("states"))
    return c.join(states, "chunk_id").join(out.withColumnRenamed("request_id", "chunk_id"), "chunk_id").select("chunk_id", "outcome", "active_revision_id", "states")


@query("""WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_comment END AS content, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE ' ' || o_clerk || ' ' END AS header FROM (SELECT *, 'order ' || o_orderpriority AS o_comment, 'clerk ' || o_orderkey AS o_clerk FROM orders))
SELECT k AS request_id, CASE WHEN trim(content) = '' AND k % 2 = 1 THEN 'invalid' WHEN k % 13 = 0 THEN 'immutable' WHEN k % 17 = 0 THEN 'revision_conflict' ELSE 'created' END AS outcome,
CASE WHEN NOT (trim(content) = '' AND k % 2 = 1) AND k % 13 <> 0 AND k % 17 <> 0 THEN CASE WHEN trim(header) = '' THEN content ELSE trim(header) || chr(10) || chr(10) || content END END AS embedding_content FROM q""")
def chunk_edit(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    chunks = o.select(k.alias("chunk_id"), k.alias("document_id"), F.when(k % 13 == 0, "parent").otherwise("child").alias("role"), F.lit("1").alias("active_revision_id"))
    revs = o.select(F.lit("1").alias("revision_id"), k.alias("chunk_id"), F.lit(1).alias("revision_no"), F.lit(None).cast("string").alias("base_revision_id"), F.lit("x").alias("content"), F.lit("").alias("context_header"), F.lit("x").alias("embedding_content"), F.lit(True).alias("enabled"), F.lit("ready").alias("status"), F.lit("system").alias("edit_source"))
    asked = o.select(
        k.alias("request_id"), k.alias("chunk_id"), F.when(k % 17 == 0, "9").otherwise("1").alias("base_revision_id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit("order "), "o_orderpriority")).alias("content"),
        F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" clerk "), k.cast("string"), F.lit(" "))).alias("context_header"), (k % 2 == 1).alias("enabled"),
    )
    new, out = L.edit_chunks(chunks, revs, o.select(k.alias("document_id"), F.lit("file").alias("kind")), asked)
    made = new.where("revision_no = 2").select(F.col("chunk_id").alias("request_id"), "embedding_content")
    return out.join(made, "request_id", "left")


@query("""SELECT l_orderkey AS chunk_set_id, l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, -l_linenumber, l_orderkey * 10 + l_linenumber)::INTEGER AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <> 5""")
def chunk_set_order(spark, sf):
    n = F.col("l_linenumber")
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    key = F.col("l_orderkey") * 10 + n
    chunks = x.select(F.col("l_orderkey").alias("chunk_set_id"), key.alias("chunk_id"), F.when(n % 3 == 0, "parent").when(n % 3 == 1, "child").otherwise("flat").alias("role"), (-n).alias("sequence"), F.lit(1).alias("active_revision_id"))
    revs = x.where("l_linenumber <> 5").select(key.alias("chunk_id"), F.lit(1).alias("revision_id"), F.lit("c").alias("content"), F.lit(True).alias("enabled"))
    return L.chunk_set_rows(chunks, revs).select("chunk_set_id", "chunk_id", "place")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'staging' WHEN o_orderkey % 3 = 1 THEN 'published' ELSE 'retired' END AS state, CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS version FROM orders
UNION ALL SELECT o_orderkey + 100000000, 'staging', 2 FROM orders WHERE o_orderkey % 6 = 3""")
def stage_batch(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    old = o.select(k.alias("id"), F.lit(1).alias("generation_id"), k.alias("chunk_id"), F.when(k % 3 == 0, "staging").when(k % 3 == 1, "published").otherwise("retired").alias("state"), F.lit(1).alias("version"))
    new = o.where("o_orderkey % 6 = 0").select(k.alias("id"), F.lit(1).alias("generation_id"), k.alias("chunk_id"), F.lit(2).alias("version"))
    more = o.where("o_orderkey % 6 = 3").select((k + 100000000).alias("id"), F.lit(2).alias("generation_id"), k.alias("chunk_id"), F.lit(2).alias("version"))
    return K.stage(old, new.unionByName(more)).select("id", "state", "version")


@query("""SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 0 THEN 'lineage' WHEN vec_id % 7 = 0 THEN 'blank' WHEN vec_id % 5 = 0 THEN 'vector' END AS reason FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0""")
def stage_validation(spark, sf):
    k = F.col("vec_id")
    v = table(spark, sf, "embeddings").select(
        k.alias("chunk_id"), F.when(k % 10 != 0, 1).alias("generation_id"), F.lit(1).alias("document_id"), F.when(k % 7 == 0, " \n").otherwise("text").alias("search_content"), F.when(k % 5 == 0, F.array(F.lit(float("nan")))).otherwise(F.col("embedding").cast("array<double>")).alias("embedding")
    )
    return K.stage_problems(v, 64)


@query("SELECT DISTINCT o_custkey % 700 AS revision_id, o_orderpriority AS strategy, CASE WHEN o_custkey % 700 < 300 AND o_orderpriority = '1-URGENT' THEN 'old' ELSE 'new' END AS origin FROM orders UNION SELECT r, '1-URGENT', 'old' FROM range(300) t(r)")
def get_or_create(spark, sf):
    have = spark.range(300).select(F.col("id").alias("revision_id"), F.lit("1-URGENT").alias("strategy"), F.lit("old").alias("origin"))
    want = table(spark, sf, "orders").select((F.col("o_custkey") % 700).alias("revision_id"), F.col("o_orderpriority").alias("strategy"), F.lit("new").alias("origin"))
    return K.get_or_create(have, want, ["revision_id", "strategy"])


@query("""WITH a AS (SELECT c_custkey AS workspace_id, 'old' AS v, TIMESTAMP '1995-01-01' AS t FROM customer UNION ALL SELECT o_custkey, o_orderpriority, o_orderdate FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderpriority DESC) = 1))
SELECT workspace_id, v FROM a QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY t DESC, (v = 'old')::INTEGER, v DESC) = 1""")
def settings_upsert(spark, sf):
    have = table(spark, sf, "customer").select(F.col("c_custkey").alias("workspace_id"), F.lit("old").alias("v"), _at("1995-01-01").alias("at"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderpriority").alias("v"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return K.upsert(have, new, ["workspace_id"], "at").select("workspace_id", "v")


_GONE = "gone AS (SELECT c_custkey AS document_id, CASE WHEN c_acctbal < -500 THEN 'remove' ELSE 'keep' END AS policy FROM customer WHERE c_acctbal < 0)"


def _source_removed(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    docs = c.select(k.alias("document_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    gone = c.where("c_acctbal < 0").select(k.alias("document_id"), F.when(F.col("c_acctbal") < -500, "remove").otherwise("keep").alias("policy"), _at("2020-01-01").alias("at"))
    revs = c.select(k.alias("document_id"), F.concat(F.lit("raw/"), k).alias("raw_key"), F.when(k % 2 == 0, F.concat(F.lit("md/"), k)).alias("parsed_key"))
    assets = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.concat(F.lit("img/"), "o_orderkey").alias("asset_key"))
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.lit("published").alias("state"))
    return L.remove_source_documents(docs, entries, revs, assets, gone)


@query(f"""WITH {_GONE} SELECT 'document' AS kind, c_custkey AS id, CASE WHEN policy = 'keep' THEN 'deleted' ELSE 'live' END AS state FROM customer LEFT JOIN gone ON document_id = c_custkey WHERE coalesce(policy, 'keep') <> 'remove'
UNION ALL SELECT 'entry', o_orderkey, CASE WHEN policy = 'keep' THEN 'retired' ELSE 'published' END FROM orders LEFT JOIN gone ON document_id = o_custkey WHERE coalesce(policy, 'keep') <> 'remove'""")
def source_delete(spark, sf):
    d, e, _ = _source_removed(spark, sf)
    return d.select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), F.when(F.col("deleted_at").isNotNull(), "deleted").otherwise("live").alias("state")).unionByName(e.select(F.lit("entry").alias("kind"), "id", "state"))


@query(f"""WITH {_GONE}, r AS (SELECT document_id FROM gone WHERE policy = 'remove'), k AS (SELECT 'raw/' || document_id AS key FROM r UNION SELECT 'md/' || document_id FROM r WHERE document_id % 2 = 0 UNION SELECT 'img/' || o_orderkey FROM orders JOIN r ON document_id = o_custkey)
SELECT key, (row_number() OVER (ORDER BY key) - 1) // 100 AS batch FROM k""")
def source_delete_keys(spark, sf):
    return _source_removed(spark, sf)[2]


@query("""SELECT c_custkey AS document_id, (c_custkey % 3 = 0 OR c_custkey % 4 <> 0) AS live, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'failed' END ELSE 'ready' END AS status, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 'e' END AS error FROM customer""")
def retry_documents(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    docs = c.select(k.alias("document_id"), F.when(k % 4 == 0, _at("2020-01-01")).alias("deleted_at"))
    revs = c.select(k.alias("document_id"), F.when(k % 5 == 0, "failed").otherwise("ready").alias("status"), F.when(k % 5 == 0, "e").alias("error"))
    d, r, _ = L.retry_documents(docs, revs, revs, c.where("c_custkey % 3 = 0").select(k.alias("document_id")))
    return d.join(r, "document_id").select("document_id", F.col("deleted_at").isNull().alias("live"), "status", "error")


@query("""SELECT c_custkey AS generation_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'failed' WHEN c_custkey % 4 = 0 THEN 'ready' ELSE 'building' END AS status, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'provider_error' END AS error_class FROM customer""")
def fail_markers(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    g = c.select(k.alias("generation_id"), F.when(k % 4 == 0, "ready").otherwise("building").alias("status"), F.lit(None).cast("string").alias("error_class"), F.lit(None).cast("string").alias("error"))
    failed = c.where("c_custkey % 3 = 0").select(k.alias("generation_id"), F.lit("provider_error").alias("error_class"), F.lit("x").alias("error"))
    return L.fail_work(g, failed, "generation_id").select("generation_id", "status", "error_class")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'keep=1,new=' || user_id ELSE 'new=' || user_id END AS config FROM events""")
def config_update(spark, sf):
    base = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("keep"), F.lit("1"), F.lit("old"), F.lit("2"), F.lit("new"), F.lit("3")))
    out = L.set_keys(base, {"new": F.col("user_id")}, ("old",))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return table(spark, sf, "events").select("event_id", text.alias("config"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey AS generation_id FROM orders) SELECT 'entry' AS kind, id FROM e WHERE id % 5 <> 0 AND generation_id % 7 <> 0 UNION ALL SELECT 'generation', c_custkey FROM customer WHERE c_custkey % 7 <> 0""")
def cleanup_delete(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("generation_id"))
    g = table(spark, sf, "customer").select(F.col("c_custkey").alias("generation_id"))
    e, g = L.purge(e, g, e.where("id % 5 = 0"), g.where("generation_id % 7 = 0"))
    return e.select(F.lit("entry").alias("kind"), "id").unionByName(g.select(F.lit("generation").alias("kind"), F.col("generation_id").alias("id")))


@query("""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'retired' ELSE 'published' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate + to_days((o_orderkey % 400)::INTEGER) END AS d FROM orders), gone AS (SELECT id FROM x WHERE state = 'retired' AND d < TIMESTAMP '1996-01-01' ORDER BY d, id LIMIT 100),
g AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey % 50, c_custkey) AS n FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0)
SELECT 'entry' AS kind, id FROM gone UNION ALL SELECT 'generation', id FROM g WHERE n <= 100 - (SELECT count(*) FROM gone)""")
def cleanup_budget(spark, sf):
    o = table(spark, sf, "orders")
    e = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "retired").otherwise("published").alias("state"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 400).cast("int"))).alias("retired_at"))
    k = F.col("c_custkey")
    g = table(spark, sf, "customer").where(k % 2 == 0).select(k.alias("generation_id"), F.lit("retired").alias("status"), F.timestamp_seconds(k % 50).alias("retired_at"))
    b = table(spark, sf, "customer").where(k % 10 == 0).select(k.alias("active_generation_id"))
    rows, old = D.expired_by_budget(e, g, b, _at("1990-01-01"), _at("1996-01-01"), 100)
    return rows.select(F.lit("entry").alias("kind"), "id").unionByName(old.select(F.lit("generation").alias("kind"), F.col("generation_id").alias("id")))


@query("""SELECT o_custkey AS key, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1""")
def next_revision(spark, sf):
    return S.next_number(table(spark, sf, "orders").withColumnRenamed("o_custkey", "key"), ["key"], "o_orderkey")


@query("""SELECT c_custkey AS key_id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 THEN TIMESTAMP '2020-01-02' ELSE TIMESTAMP '2020-01-01 23:59:30' END AS last_used_at FROM customer""")
def throttled_touch(spark, sf):
    k = F.col("c_custkey")
    keys = table(spark, sf, "customer").select(k.alias("key_id"), F.when(k % 3 == 1, _at("2020-01-01")).when(k % 3 == 2, _at("2020-01-01 23:59:30")).alias("last_used_at"))
    return K.touch(keys, _at("2020-01-02"), 60)


@query("""SELECT user_id AS run_id, count(*) FILTER (event_type = 'click' AND value > 2) AS n_added, count(*) FILTER (event_type = 'purchase' AND value > 2) AS n_updated, count(*) FILTER (event_type = 'signup' AND value > 2) AS n_removed,
count(*) FILTER (event_type NOT IN ('click', 'purchase', 'signup')) AS n_skipped, count(*) FILTER (event_type IN ('click', 'purchase', 'signup') AND value <= 2) AS n_failed, (user_id % 5) * 2 < user_id % 7 AS looks_truncated,
CASE WHEN user_id % 6 = 0 AND count(*) FILTER (event_type IN ('click', 'purchase', 'signup') AND value <= 2) = 0 THEN 'partial' WHEN count(*) FILTER (event_type IN ('click', 'purchase', 'signup') AND value <= 2) = 0 THEN 'success'
WHEN count(*) FILTER (event_type NOT IN ('click', 'purchase', 'signup') OR value > 2) > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY user_id""")
def sync_run_summary(spark, sf):
    e, t = table(spark, sf, "events"), F.col("event_type")
    outcomes = e.select(F.col("user_id").alias("run_id"), F.when(t == "click", "add").when(t == "purchase", "update").when(t == "signup", "remove").otherwise("skip").alias("action"), (F.col("value") > 2).alias("success"))
    runs = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", (F.col("run_id") % 5).alias("n_remote"), (F.col("run_id") % 7).alias("n_local"), (F.col("run_id") % 6 != 0).alias("complete"))
    return D.run_summary(outcomes, runs)


@query("""SELECT user_id, max(CASE WHEN event_id % 3 <> 0 THEN ts END) AS edit_time FROM events GROUP BY user_id""")
def latest_edit_time(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("edit_time"))
    return D.latest_edit(e, ["user_id"])


@query("""SELECT c_custkey AS kb_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 28 + 1 <= 14 AND c_custkey % 5 <> 0""")
def due_scan(spark, sf):
    k = F.col("c_custkey")
    at = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    config = F.concat(F.lit('{"auto_sync":'), (k % 2 == 0).cast("string"), F.when(k % 3 != 0, F.concat(F.lit(',"next_sync_at":"'), at, F.lit('"'))).otherwise(""), F.lit("}"))
    b = table(spark, sf, "customer").select(k.alias("kb_id"), config.alias("source_config"), F.when(k % 5 == 0, 1).alias("deleted_at"))
    return D.due_bases(b, _at("2024-01-14")).select("kb_id")


@query("""WITH b AS (SELECT c_custkey AS kb_id, c_nationkey AS c, TIMESTAMP '2024-01-01' + to_days((c_custkey % 20)::INTEGER) AS t, c_custkey % 4 AS m FROM customer), a AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, kb_id) AS n FROM b WHERE t <= TIMESTAMP '2024-01-10 06:30:00')
SELECT b.kb_id, CASE WHEN a.n <= 3 - b.c % 2 THEN CASE b.m WHEN 0 THEN TIMESTAMP '2024-01-10 06:45:00' WHEN 1 THEN TIMESTAMP '2024-01-11 03:00:00' WHEN 2 THEN TIMESTAMP '2024-02-01 00:00:00' END ELSE b.t END AS next_at FROM b LEFT JOIN a ON a.kb_id = b.kb_id""")
def scheduler_tick(spark, sf):
    k = F.col("c_custkey")
    cron = F.when(k % 4 == 0, "*/15 * * * *").when(k % 4 == 1, "0 3 * * *").when(k % 4 == 2, "0 0 1 * *").otherwise("never")
    b = table(spark, sf, "customer").select(k.alias("kb_id"), F.col("c_nationkey").alias("connection_id"), cron.alias("cron"), (_at("2024-01-01") + F.make_dt_interval(days=(k % 20).cast("int"))).alias("next_at"))
    active = table(spark, sf, "nation").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("connection_id"), F.lit(1).alias("n"))
    return D.scheduled(b, active, _at("2024-01-10 06:30:00"), 3)[1].select("kb_id", "next_at")


@query("SELECT c_custkey AS kb_id FROM customer WHERE c_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def latch_recovery(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("kb_id"), (F.col("c_acctbal") > 5000).alias("forced"))
    jobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("kb_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    return D.orphaned(c, jobs).select("kb_id")


@query("""WITH r AS (SELECT o_custkey AS document_id, arg_max(o_orderkey, o_orderkey) AS rev, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS document_id, (c_custkey % 4 = 0 OR r.rev IS NULL OR s <> 'F' OR rev % 9 = 0) AS retry_required FROM customer LEFT JOIN r ON document_id = c_custkey""")
def retry_required(spark, sf):
    k, o = F.col("c_custkey"), table(spark, sf, "orders")
    docs = table(spark, sf, "customer").select(k.alias("document_id"), F.when(k % 4 != 0, 1).alias("active_revision_id"))
    revs = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderkey").alias("revision_no"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"))
    jobs = o.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("document_revision_id"), F.lit("failed").alias("status"))
    return D.retry_required(docs, revs, jobs)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'retry' ELSE 'skip' END ELSE 'new_revision' END AS action FROM events""")
def content_change(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", D.content_action(F.sha2((k % 4).cast("string"), 256), F.sha2(F.lit("0"), 256), k % 8 == 0).alias("action"))


_FT = """ft AS (SELECT 'root' AS id, NULL AS parent_id, '' AS name, 'folder' AS node_type UNION ALL SELECT 'r' || r_regionkey, 'root', r_name, 'folder' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'folder' FROM nation
UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'gone' ELSE 'n' || s_nationkey END, s_name, 'file' FROM supplier UNION ALL SELECT 'i' || s_suppkey, 's' || s_suppkey, 'inner', 'file' FROM supplier WHERE s_suppkey % 13 < 2)"""


def _tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), F.lit("folder").alias("node_type"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit("folder"))
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), k), F.when(k % 13 == 0, "gone").otherwise(F.concat(F.lit("n"), "s_nationkey")), "s_name", F.lit("file"))
    i = table(spark, sf, "supplier").where("s_suppkey % 13 < 2").select(F.concat(F.lit("i"), k), F.concat(F.lit("s"), k), F.lit("inner"), F.lit("file"))
    return spark.createDataFrame([("root", None, "", "folder")], "id string, parent_id string, name string, node_type string").union(r).union(n).union(s).union(i)


_FTP = f"""{_FT}, t(id, path, depth) AS (SELECT id, '/', 0 FROM ft WHERE parent_id IS NULL UNION ALL SELECT n.id, CASE WHEN depth = 0 THEN '/' || n.name ELSE path || '/' || n.name END, depth + 1 FROM t JOIN ft n ON n.parent_id = t.id)"""


@query(f"WITH RECURSIVE {_FTP} SELECT id, CASE WHEN parent_id = 'gone' THEN 'orphan' ELSE 'unreachable' END AS problem FROM ft WHERE id NOT IN (SELECT id FROM t)")
def tree_problems(spark, sf):
    return S.tree_problems(_tree(spark, sf))


@query(f"WITH RECURSIVE {_FTP} SELECT id, parent_id, path, depth, place FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY node_type, lower(name), id)::INTEGER AS place FROM ft) JOIN t USING (id)")
def tree_order(spark, sf):
    return S.tree_rows(_tree(spark, sf))


@query(f"WITH RECURSIVE {_FTP} SELECT id, depth, (SELECT max(depth) FROM t WHERE id LIKE 'n%' OR id LIKE 'r_') - depth AS turn FROM t WHERE id LIKE 'n%' OR id LIKE 'r_'")
def tree_deletion_order(spark, sf):
    t = _tree(spark, sf)
    return S.deletion_order(t, t.where("id like 'n%' or id like 'r_'").select("id"))


@query(f"WITH {_FT} SELECT f.id, count(c.id) AS n_children FROM ft f LEFT JOIN ft c ON c.parent_id = f.id WHERE f.node_type = 'folder' GROUP BY f.id")
def tree_child_counts(spark, sf):
    return S.child_counts(_tree(spark, sf))


@query("""SELECT s_suppkey::VARCHAR AS token, CASE WHEN s_suppkey % 6 = 0 THEN -1 WHEN s_suppkey % 10 < 8 THEN 100 + s_suppkey % 10 ELSE -2 END AS parent_node_id, CASE WHEN s_suppkey % 6 = 0 OR s_suppkey % 10 < 8 THEN 'ok' ELSE 'failed' END AS outcome FROM supplier""")
def parent_resolution(spark, sf):
    k = F.col("s_suppkey")
    remote = table(spark, sf, "supplier").select(k.cast("string").alias("token"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("t"), (k % 10).cast("string"))).alias("parent_token"))
    known = spark.range(8).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"), (F.col("id") + 100).alias("node_id"))
    return S.parents_of(remote, known, F.lit(-1).cast("long")).fillna(-2, ["parent_node_id"])


@query("""SELECT 'one_root_a_base' AS rule, 0 AS n UNION ALL SELECT 'sibling_names_differ', (SELECT count(*) FROM (SELECT 1 FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey HAVING count(*) > 1)) UNION ALL SELECT 'name_is_one_segment', (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 0)
UNION ALL SELECT 'parent_is_a_folder', 0 UNION ALL SELECT 'published_entry_is_complete', 0 UNION ALL SELECT 'one_published_entry_a_chunk', 0 UNION ALL SELECT 'entry_has_document', 0 UNION ALL SELECT 'document_name_not_blank', 0""")
def tree_expectations(spark, sf):
    k = F.col("s_suppkey")
    n = table(spark, sf, "nation").select(F.lit(1).alias("kb_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("root").alias("parent_id"), F.col("n_name").alias("name"), F.lit("folder").alias("node_type"))
    name = F.when(k % 9 == 0, F.concat(F.lit("a/"), k.cast("string"))).when(k % 3 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.when(k % 2 == 0, "SAME").otherwise("same"))
    s = table(spark, sf, "supplier").select(F.lit(1), F.concat(F.lit("s"), k), F.concat(F.lit("n"), "s_nationkey"), name, F.lit("file"))
    root = spark.createDataFrame([(1, "root", None, "", "folder")], "kb_id int, id string, parent_id string, name string, node_type string")
    none = spark.createDataFrame([], "generation_id int, chunk_id int, document_id int, state string, embedding int, published_at int, name string")
    return S.expectations(none, none.select("document_id", "name"), S.tree_rules(root.union(n).union(s)))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Fetched ' || doc_id WHEN 1 THEN 'Listed' ELSE 'tok' || doc_id END AS title, CASE WHEN doc_id % 4 = 0 THEN 'remove' ELSE 'keep' END AS policy, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-05-01 10:00:00' WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-05-01 08:00:00' END AS at FROM documents""")
def sync_scalars(spark, sf):
    k = F.col("doc_id")
    title = T.document_title(F.when(k % 5 == 0, F.concat(F.lit(" Fetched "), k.cast("string"))).otherwise(" "), F.when(k % 5 == 1, "Listed").when(k % 5 == 2, "\t"), F.concat(F.lit("tok"), k.cast("string")))
    at = F.when(k % 3 == 0, "2024-05-01T10:00:00Z").when(k % 3 == 1, " 2024-05-01T10:00:00.000+02:00").otherwise("2024-05-01 10:00")
    return table(spark, sf, "documents").select("doc_id", title.alias("title"), T.strict_delete_policy(F.when(k % 4 == 0, " Remove").otherwise("KEEP")).alias("policy"), T.rfc3339(at).alias("at"))
