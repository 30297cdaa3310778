"""Registered queries of statistics, listings, trees, synchronisation and state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

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


@query("""SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value > 50) AS large, count(*) FILTER (value <= 50) AS small,
count(*) FILTER (user_id % 2 = 0) AS even_users, count(*) FILTER (props IS NULL) AS bare, count(*) AS total FROM events""")
def summary_counts(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return S.counts(e, clicks=kind == "click", purchases=kind == "purchase", large=F.col("value") > 50, small=F.col("value") <= 50, even_users=F.col("user_id") % 2 == 0, bare=F.col("props").isNull(), total=F.lit(True))


@query("""SELECT c_nationkey AS workspace, count(*) FILTER (c_acctbal < 0) AS overdrawn, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_acctbal >= 0) AS ready, count(*) AS total FROM customer GROUP BY 1""")
def readiness_counts(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "workspace")
    return S.counts(c, ["workspace"], overdrawn=F.col("c_acctbal") < 0, building=F.col("c_mktsegment") == "BUILDING", ready=F.col("c_acctbal") >= 0, total=F.lit(True))


@query("""SELECT p_brand AS provider, count(*) AS total, count(*) FILTER (p_size > 10) AS active, count(*) FILTER (p_type LIKE '%STEEL%') AS embedding, count(*) FILTER (p_type LIKE '%BRASS%') AS rerank FROM part GROUP BY 1""")
def provider_counts(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "provider")
    return S.counts(p, ["provider"], total=F.lit(True), active=F.col("p_size") > 10, embedding=F.col("p_type").contains("STEEL"), rerank=F.col("p_type").contains("BRASS"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_group(spark, sf):
    return S.latest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH p AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(p.k, r.k) AS set_id FROM customer LEFT JOIN p ON p.o_custkey = c_custkey LEFT JOIN r ON r.o_custkey = c_custkey""")
def effective_set_fallback(spark, sf):
    o = table(spark, sf, "orders")
    published = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("p"))
    ready = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("r"))
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return c.join(published, "o_custkey", "left").join(ready, "o_custkey", "left").select(F.col("o_custkey").alias("c_custkey"), F.coalesce("p", "r").alias("set_id"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_not_exists(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND p_partkey NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def anti_not_in(spark, sf):
    used = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("chunk_set_id"), F.lit("published").alias("state"))
    sets = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("chunk_set_id"))
    return K.unused_sets(sets, used).select(F.col("chunk_set_id").alias("p_partkey"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return S.duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("SELECT event_type, user_id, event_id FROM events WHERE (event_type, user_id, event_id) > ('click', 20, 0) ORDER BY event_type, user_id, event_id LIMIT 101")
def keyset_page_asc(spark, sf):
    order = [("event_type", False), ("user_id", False), ("event_id", False)]
    return S.page(table(spark, sf, "events").select("event_type", "user_id", "event_id"), order, 100, ("click", 20, 0))


@query("SELECT value, event_id FROM events WHERE (value, event_id) < (40.0, 500) ORDER BY value DESC, event_id DESC LIMIT 51")
def keyset_page_desc(spark, sf):
    return S.page(table(spark, sf, "events").select("value", "event_id"), [("value", True), ("event_id", True)], 50, (40.0, 500))


def _tree(spark, sf):
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), F.lit("folder").alias("node_type"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit("folder"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name", F.lit("file"))
    return spark.createDataFrame([("root", None, "", "folder")], "id string, parent_id string, name string, node_type string").union(r).union(n).union(s)


_TREE = """tree AS (SELECT 'root' AS id, NULL AS parent_id, '' AS name, 'folder' AS node_type UNION ALL SELECT 'r' || r_regionkey, 'root', r_name, 'folder' FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'folder' FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'file' FROM supplier)"""


@query(f"""WITH RECURSIVE {_TREE}, t(id, path, depth) AS (SELECT id, '/', 0 FROM tree WHERE parent_id IS NULL UNION ALL SELECT n.id, CASE WHEN depth = 0 THEN '/' || n.name ELSE path || '/' || n.name END, depth + 1 FROM t JOIN tree n ON n.parent_id = t.id)
SELECT * FROM t""")
def tree_paths(spark, sf):
    return S.tree_paths(_tree(spark, sf))


# Below the tree hangs a chain of folders as long as there are suppliers: c<k> lies in c<k - 1>, and c0 in the root.
_DEEP = f"""{_TREE}, deep AS (SELECT * FROM tree UNION ALL SELECT 'c' || s_suppkey, CASE WHEN s_suppkey = 0 THEN 'root' ELSE 'c' || (s_suppkey - 1) END, 'chain', 'folder' FROM supplier)"""


def _deep(spark, sf):
    k = F.col("s_suppkey")
    chain = table(spark, sf, "supplier").select(F.concat(F.lit("c"), k), F.when(k == 0, "root").otherwise(F.concat(F.lit("c"), k - 1)), F.lit("chain"), F.lit("folder"))
    return _tree(spark, sf).union(chain)


@query(f"""WITH RECURSIVE {_DEEP}, up(id, a) AS (SELECT id, parent_id FROM tree WHERE parent_id IS NOT NULL UNION SELECT up.id, t.parent_id FROM up JOIN tree t ON t.id = up.a WHERE t.parent_id IS NOT NULL),
m AS (SELECT id AS move_id, 'r' || (length(id) % 5) AS id, id AS target FROM tree)
SELECT move_id, (m.id = target OR EXISTS (SELECT 1 FROM up WHERE up.id = target AND up.a = m.id)) AS cycle FROM m
UNION ALL SELECT 'down ' || s_suppkey, s_suppkey % 5 < 3 FROM supplier UNION ALL SELECT 'up ' || s_suppkey, false FROM supplier WHERE s_suppkey > 0""")
def tree_cycle_check(spark, sf):
    """The tree's nodes under regions; each chain folder under the chain's end (a cycle), under the root or a file's folder (none), and under the folder above it (none)."""
    t = _tree(spark, sf)
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit(1).alias("one"))
    end = s.agg(F.max("s_suppkey").alias("end")).select("end", F.lit(1).alias("one"))
    moves = t.select(F.col("id").alias("move_id"), F.concat(F.lit("r"), (F.length("id") % 5).cast("string")).alias("m"), F.col("id").alias("new_parent_id"))
    down = s.join(F.broadcast(end), "one").select(F.concat(F.lit("down "), k), F.concat(F.lit("c"), k), F.when(k % 5 < 3, F.concat(F.lit("c"), F.col("end"))).when(k % 5 == 3, F.lit("root")).otherwise("n1"))
    up = s.where("s_suppkey > 0").select(F.concat(F.lit("up "), k), F.concat(F.lit("c"), k), F.concat(F.lit("c"), k - 1))
    return S.creates_cycle(_deep(spark, sf), moves.union(down).union(up).withColumnRenamed("m", "id"))


@query(f"""WITH RECURSIVE {_DEEP}, up(id, a) AS (SELECT id, parent_id FROM tree WHERE parent_id IS NOT NULL UNION SELECT up.id, t.parent_id FROM up JOIN tree t ON t.id = up.a WHERE t.parent_id IS NOT NULL), gone AS (SELECT id FROM tree WHERE id <> 'root' AND (node_type = 'folder' OR length(id) > 2)),
alive AS (SELECT id FROM tree WHERE (node_type = 'file' AND parent_id IN ('n1', 'n4', 'n7')) OR (node_type = 'folder' AND id NOT IN (SELECT id FROM gone)))
SELECT id FROM tree WHERE node_type = 'folder' AND id IN (SELECT id FROM gone) AND id NOT IN (SELECT a FROM up JOIN alive USING (id))
UNION ALL SELECT 'c' || s_suppkey FROM supplier WHERE s_suppkey > (SELECT max(s_suppkey) - 5 FROM supplier)""")
def tree_prunable(spark, sf):
    """All chain folders are missing; a file lies five levels above the chain's end, and holds those above it."""
    t = _deep(spark, sf).where("node_type = 'folder' or parent_id in ('n1', 'n4', 'n7')")  # other files are gone already
    file = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("end")).select(F.lit("held"), F.concat(F.lit("c"), F.col("end") - 5), F.lit("file"), F.lit("file"))
    return S.prunable(t.union(file), t.where("id <> 'root' and (node_type = 'folder' or length(id) > 2)").select("id"))


def _remote(o):
    return o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("token"), F.lit(True).alias("has_document"), F.col("o_orderdate").alias("edit_time"), F.col("o_orderkey").alias("ordinal"))


@query("""WITH r AS (SELECT o_orderkey::VARCHAR AS token, o_orderdate AS t FROM orders WHERE o_orderkey % 7 <> 0), l AS (SELECT o_orderkey::VARCHAR AS token, o_orderstatus = 'P' AS retry, o_custkey % 11 = 0 AS gone FROM orders WHERE o_orderkey % 5 <> 0)
SELECT token, CASE WHEN l.token IS NULL THEN 'add' WHEN r.token IS NULL THEN 'remove' WHEN retry OR t IS NULL OR t > TIMESTAMP '1996-01-01' THEN 'update' ELSE 'skip' END AS action FROM r FULL JOIN l USING (token) WHERE r.token IS NOT NULL OR NOT gone""")
def sync_diff(spark, sf):
    o = table(spark, sf, "orders")
    local = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("external_id"), (F.col("o_orderstatus") == "P").alias("retry_required"), F.when(F.col("o_custkey") % 11 == 0, F.col("o_orderdate")).alias("deleted_at"), F.col("o_orderkey").alias("ordinal"))
    return D.sync_diff(_remote(o), local, F.lit("1996-01-01").cast("timestamp"))


@query("""WITH r AS (SELECT o_orderkey, o_orderdate AS t FROM orders WHERE o_orderkey % 7 <> 0), o AS (SELECT o_orderkey, o_totalprice > 1500 AS ok FROM orders WHERE o_orderkey % 3571 <> 0),
g AS (SELECT t, bool_and(coalesce(ok, false)) AS good FROM r LEFT JOIN o USING (o_orderkey) GROUP BY t)
SELECT greatest(coalesce(max(t) FILTER (t < coalesce((SELECT min(t) FROM g WHERE NOT good), TIMESTAMP '9999-01-01')), TIMESTAMP '1990-01-01'), TIMESTAMP '1990-01-01') AS watermark FROM g""")
def safe_watermark(spark, sf):
    o = table(spark, sf, "orders")
    outcomes = o.where("o_orderkey % 3571 <> 0").select(F.col("o_orderkey").cast("string").alias("token"), (F.col("o_totalprice") > 1500).alias("success"))
    return D.safe_watermark(_remote(o), outcomes, F.lit("1990-01-01").cast("timestamp"))


@query("""WITH due AS (SELECT user_id % 20 AS connection, user_id AS kb, min(ts) AS next_at FROM events GROUP BY 1, 2), act AS (SELECT user_id % 20 AS connection, count(*) % 3 AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT connection, kb, next_at, row_number() OVER (PARTITION BY connection ORDER BY next_at, kb)::INTEGER AS rank FROM due LEFT JOIN act USING (connection) QUALIFY rank <= 4 - coalesce(n, 0)""")
def schedule_admission(spark, sf):
    e = table(spark, sf, "events").withColumn("connection", F.col("user_id") % 20)
    due = e.groupBy("connection", F.col("user_id").alias("kb")).agg(F.min("ts").alias("next_at"))
    active = e.where("event_type = 'purchase'").groupBy("connection").agg((F.count("*") % 3).alias("n"))
    return D.admitted(due, active, 4)


def _orders_as_entries(o):
    state = F.when(F.col("o_orderstatus") == "O", "staging").when(F.col("o_orderstatus") == "F", "published").otherwise("retired")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 2).alias("generation_id"), F.col("o_orderkey").alias("chunk_id"), state.alias("state"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("published_at"), F.when(~F.col("o_orderstatus").isin("O", "F"), F.col("o_orderdate")).alias("retired_at"),
    )


_ENTRIES = """en AS (SELECT o_orderkey AS id, o_custkey AS document_id, o_orderkey % 2 AS generation_id, CASE o_orderstatus WHEN 'O' THEN 'staging' WHEN 'F' THEN 'published' ELSE 'retired' END AS state, o_orderdate AS created_at,
CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS published_at, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderdate END AS retired_at FROM orders)"""


@query(f"""WITH {_ENTRIES} SELECT id, state, created_at FROM en WHERE (state = 'staging' AND created_at < TIMESTAMP '1997-01-01') OR (state = 'retired' AND retired_at < TIMESTAMP '1996-06-01') ORDER BY created_at, id LIMIT 1000""")
def retention_candidates(spark, sf):
    e = _orders_as_entries(table(spark, sf, "orders"))
    return D.expired(e, F.lit("1997-01-01").cast("timestamp"), F.lit("1996-06-01").cast("timestamp")).select("id", "state", "created_at")


@query("""WITH r AS (SELECT event_id AS request_id, user_id || ':' || event_type AS key, event_type || (value > 50)::INTEGER AS hash FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY request_id) AS n, first_value(hash) OVER (PARTITION BY key ORDER BY request_id) AS h0 FROM r),
o AS (SELECT hash, min(request_id) AS owner FROM f WHERE n = 1 GROUP BY 1)
SELECT request_id, CASE WHEN n > 1 AND hash <> h0 THEN 'conflict' WHEN n > 1 THEN 'replay' WHEN request_id <> owner THEN 'deduped' ELSE 'accepted' END AS outcome FROM f LEFT JOIN o USING (hash)""")
def idempotent_ingest(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("event_id").alias("request_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.concat("event_type", (F.col("value") > 50).cast("int").cast("string")).alias("hash"))
    return D.idempotent(r)


@query(f"""WITH {_ENTRIES}, ev AS (SELECT c_custkey AS document_id, 1 AS generation_id FROM customer WHERE c_acctbal > 0)
SELECT id, CASE WHEN ev.document_id IS NOT NULL AND state = 'published' THEN 'retired' WHEN ev.document_id IS NOT NULL AND state = 'staging' THEN 'published' ELSE state END AS state,
CASE WHEN ev.document_id IS NOT NULL AND state = 'staging' THEN TIMESTAMP '2000-01-01' ELSE published_at END AS published_at FROM en LEFT JOIN ev USING (document_id, generation_id)""")
def publish_transition(spark, sf):
    e = _orders_as_entries(table(spark, sf, "orders"))
    events = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.lit(1).cast("long").alias("generation_id"), F.lit("2000-01-01").cast("timestamp").alias("at"))
    return K.publish(e, events).select("id", "state", "published_at")


@query(f"""WITH {_ENTRIES} SELECT id, CASE WHEN c_custkey IS NOT NULL THEN 'retired' ELSE state END AS state FROM en LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = document_id""")
def soft_delete_transition(spark, sf):
    e = _orders_as_entries(table(spark, sf, "orders"))
    c = table(spark, sf, "customer")
    gone = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("document_id"), F.lit("2000-01-01").cast("timestamp").alias("at"))
    docs = c.select(F.col("c_custkey").alias("document_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return K.soft_delete(e, docs, docs.select("document_id"), gone)[0].select("id", "state")


@query("""WITH k AS (SELECT 'raw/' || p_partkey AS key FROM part UNION SELECT 'doc/' || s_suppkey FROM supplier UNION SELECT CASE WHEN c_custkey % 2 = 0 THEN 'img/' || c_custkey END FROM customer)
SELECT key, (row_number() OVER (ORDER BY key) - 1) // 100 AS batch FROM k WHERE key IS NOT NULL""")
def cleanup_batches(spark, sf):
    raw = table(spark, sf, "part").select(F.concat(F.lit("raw/"), "p_partkey").alias("key"))
    doc = table(spark, sf, "supplier").select(F.concat(F.lit("doc/"), "s_suppkey").alias("key"))
    img = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("img/"), "c_custkey")).alias("key"))
    return K.cleanup_batches([raw, doc, img])


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%' ORDER BY lower(p_name), p_partkey LIMIT 100""")
def model_search_ilike(spark, sf):
    like = F.col("p_name").ilike("%an%") | F.col("p_brand").ilike("%an%") | F.col("p_type").ilike("%an%")
    return table(spark, sf, "part").where(like).orderBy(F.lower("p_name"), "p_partkey").limit(100).select("p_partkey", "p_name")


@query("""WITH a AS (SELECT c_nationkey AS kb_id, c_custkey AS document_id FROM customer WHERE c_acctbal > -500),
e AS (SELECT a.*, s.chunk_set_id FROM a LEFT JOIN (SELECT o_custkey, o_orderkey AS chunk_set_id FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) s ON s.o_custkey = a.document_id),
d AS (SELECT e.kb_id, e.document_id, e.chunk_set_id, l.c, CASE WHEN l.c % 13 <> 0 THEN l.f END AS f, l.c % 13 <> 0 AS found, l.q FROM e LEFT JOIN (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS c, max(l_returnflag) AS f, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) l ON l.l_orderkey = e.chunk_set_id)
SELECT kb_id, count(DISTINCT document_id) AS document_count, count(c) AS chunk_count, count(*) FILTER (f = 'R') AS manual_edit_count, count(*) FILTER (found AND q <= 5) AS disabled_chunk_count,
count(*) FILTER (chunk_set_id IS NULL) AS missing_chunk_set_count, count(*) FILTER (c IS NOT NULL AND NOT found) AS missing_revision_count, coalesce(any_value(i.n), 0) AS indexed_count
FROM d LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) i ON i.c_nationkey = d.kb_id GROUP BY kb_id""")
def generation_stats(spark, sf):
    c, o, line = (table(spark, sf, n) for n in ("customer", "orders", "lineitem"))
    docs = c.select(F.col("c_nationkey").alias("kb_id"), F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") > -500, F.lit(1)).alias("active_revision_id"))
    sets = o.select(F.col("o_orderkey").alias("chunk_set_id"), F.col("o_custkey").alias("document_id"), F.lit(1).alias("revision_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending").alias("status"), F.col("o_orderdate").alias("created_at"))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id")
    line = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_quantity").alias("l_quantity"))
    chunks = line.select(key, F.col("l_orderkey").alias("chunk_set_id"), F.lit(2).alias("active_revision_id"))
    revs = line.select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("revision_id"), F.when(F.col("l_returnflag") == "R", "user").otherwise("system").alias("edit_source"), (F.col("l_quantity") > 5).alias("enabled")).where("chunk_id % 13 <> 0")
    entries = c.select(F.col("c_nationkey").alias("kb_id"), F.when(F.col("c_mktsegment") == "BUILDING", "published").otherwise("staging").alias("state"))
    return S.generation_stats(docs, sets, chunks, revs, entries)


@query(f"""WITH {_ENTRIES} SELECT 'published_entry_is_complete' AS rule, count(*) FILTER (state = 'published' AND (id % 9 = 0 OR published_at IS NULL)) AS n FROM en
UNION ALL SELECT 'one_published_entry_a_chunk', (SELECT count(*) FROM (SELECT 1 FROM en WHERE state = 'published' GROUP BY generation_id, id HAVING count(*) > 1))
UNION ALL SELECT 'entry_has_document', count(*) FROM en WHERE document_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'document_name_not_blank', count(*) FROM customer WHERE c_acctbal > 0 AND trim(coalesce(c_name, '')) = ''""")
def expectations_violations(spark, sf):
    e = _orders_as_entries(table(spark, sf, "orders")).withColumn("embedding", F.when(F.col("id") % 9 != 0, F.lit(1)))
    d = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"))
    return S.expectations(e, d)


# Each order is a clean-up job of its customer's workspace; open orders are pending, the queue holds one in four.
def _cleanup_jobs(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "parse").otherwise("source_cleanup")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return o.select((F.col("o_custkey") % 25).alias("workspace_id"), F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("job_id"), kind.alias("type"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query("""SELECT 'source_cleanup:' || (o_custkey % 25) || ':' || o_orderkey AS task_id, o_custkey AS kb_id, o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0""")
def cleanup_redispatch(spark, sf):
    jobs = _cleanup_jobs(spark, sf)
    queued = jobs.where("job_id % 4 = 0").select(F.concat_ws(":", F.lit("source_cleanup"), "workspace_id", "job_id").alias("task_id"))
    return D.pending_cleanups(jobs, queued).select("task_id", "kb_id", "job_id")


@query("""WITH named AS (SELECT l_orderkey AS job_id, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 7 = 0 THEN '' ELSE 'raw/' || l_partkey END AS key, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS store FROM lineitem)
SELECT job_id, store, key FROM named WHERE key <> ''""")
def cleanup_payloads(spark, sf):
    """The objects in the payloads of clean-up jobs: each order's lines, of which every third has no key."""
    n = F.col("l_linenumber")
    key = F.when(n % 3 == 0, None).when(n % 7 == 0, "").otherwise(F.concat(F.lit("raw/"), F.col("l_partkey")))
    one = F.struct(key.alias("key"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("store"))
    payload = F.to_json(F.struct(F.collect_list(one).alias("objects")))
    jobs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(payload.alias("payload"))
    return D.cleanup_objects(jobs).select("job_id", "store", "key")


@query("""WITH e AS (SELECT event_type AS root, event_id, ts, event_id % 1000 <> 999 OR event_type = 'click' AS good FROM events WHERE event_id % 4 <> 0),
bad AS (SELECT root, min(ts) AS bad FROM e WHERE NOT good GROUP BY 1)
SELECT e.root, CASE WHEN e.root = 'view' THEN 0 ELSE coalesce(max(epoch_us(ts)) FILTER (bad IS NULL OR ts < bad), 0) END AS watermark FROM e LEFT JOIN bad USING (root) GROUP BY 1""")
def root_watermarks(spark, sf):
    """Event types as roots, events as documents: one in a thousand fails, but for clicks; the listing of views is incomplete."""
    n = F.col("event_id")
    nodes = table(spark, sf, "events").select(F.col("event_type").alias("root"), n.cast("string").alias("token"), (n % 4 != 0).alias("has_document"), F.col("ts").cast("timestamp").alias("edit_time"))
    outcomes = table(spark, sf, "events").select(F.col("event_type").alias("root"), n.cast("string").alias("token"), ((n % 1000 != 999) | (F.col("event_type") == "click")).alias("success"))
    roots = nodes.select("root").distinct().select("root", F.timestamp_micros(F.lit(0)).alias("previous"), (F.col("root") != "view").alias("complete"))
    return D.safe_watermarks(nodes, outcomes, roots).select("root", F.unix_micros("watermark").alias("watermark"))


@query("""SELECT o_orderkey AS document_id, CASE WHEN o_custkey % 4 = 2 AND o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ready' END AS status,
CASE WHEN o_orderkey % 7 = 0 AND NOT (o_custkey % 4 = 2 AND o_orderkey % 3 = 0) THEN 1 ELSE 0 END AS deleted FROM orders""")
def tenant_retry(spark, sf):
    """A retry of one order in three, asked for within workspace 2: other workspaces' documents stay as they are."""
    from heronlake.operators.lifecycle import retry_documents
    from heronlake.plans.tables import tenants

    o, names = table(spark, sf, "orders"), ["documents", "revisions", "jobs"]

    def make():
        failed = F.col("o_orderstatus") == "F"
        work = o.select((F.col("o_custkey") % 4).alias("workspace_id"), F.col("o_orderkey").alias("document_id"), F.when(failed, "failed").otherwise("ready").alias("status"), F.when(failed, "e").alias("error"))
        return {"documents": o.select((F.col("o_custkey") % 4).alias("workspace_id"), F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 7 == 0, 1).alias("deleted_at")), "revisions": work, "jobs": work}

    stored = tenants(spark, sf, "retry", make)
    stored.within(2).change(retry_documents, names, names, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("document_id")))
    each = [stored.within(w).run(lambda d, j: d.join(j, "document_id"), ["documents", "jobs"]) for w in range(4)]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return rows.select("document_id", "status", F.coalesce("deleted_at", F.lit(0)).alias("deleted"))
