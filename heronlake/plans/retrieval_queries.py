"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions.text import tokens
from heronlake.functions.vectors import valid
from heronlake.operators import retrieval as R
from heronlake.plans.tables import EDGES, ENTRIES, MOST_IDS, SEARCH_QUERIES, document_postings, entries, entry_postings, fused_sql, grouped_sql, keyword_sql, publication_index, search_queries, search_sql, stored_vectors, table, tenants, vector_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT vec_id AS entry_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 30""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    vector = e.where("entry_id = 0").first()["embedding"]
    return R.vector_top(e, [float(x) for x in vector], 30).select("entry_id", F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT vec_id AS entry_id, embedding FROM embeddings),
s AS (SELECT q.entry_id AS query_id, e.entry_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM e, e q WHERE q.entry_id % 50 = 0)
SELECT query_id, entry_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entry_id) AS rank FROM s QUALIFY rank <= 30""")
def vector_topk_batch(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    q = e.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    return R.vector_top_batch(e, q, 30).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
SELECT doc_id AS entry_id, round(sum(0.1::DOUBLE), 6) AS score FROM t WHERE term = 'the' GROUP BY 1 ORDER BY count(*) DESC, doc_id LIMIT 30""")
def keyword_single_term(spark, sf):
    q = spark.createDataFrame([(0, "The")], "query_id long, query string")
    return document_postings(spark, sf).search(q, 30).select("entry_id", F.round("score", 6).alias("score"))


@query(f"WITH {ENTRIES}, {SEARCH_QUERIES}, {keyword_sql()} SELECT query_id, entry_id, round(score, 6) AS score, r AS rank FROM k")
def keyword_cover_density(spark, sf):
    return entry_postings(spark, sf).search(search_queries(spark, sf), 30).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {ENTRIES}, {SEARCH_QUERIES}, {EDGES}, {vector_sql()}, {keyword_sql()}, {fused_sql()} SELECT query_id, entry_id, round(score, 9) AS score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score FROM fused")
def rrf_fusion(spark, sf):
    e, q = entries(spark, sf), search_queries(spark, sf)
    f = R.fuse(R.vector_top_batch(e, q), entry_postings(spark, sf).search(q))
    return f.select("query_id", "entry_id", F.round("score", 9).alias("score"), F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"))


_RESULT = "query_id, parent_id, entry_id, round(score, 9) AS score, array_to_string(matched, ',') AS matched, rank"


def _result(df, *more):
    return df.select("query_id", *more, "parent_id", "entry_id", F.round("score", 9).alias("score"), F.array_join("matched", ",").alias("matched"), F.col("rank").cast("long").alias("rank"))


@query(f"{search_sql()} SELECT {_RESULT} FROM res")
def hybrid_search(spark, sf):
    return _result(R.hybrid(entries(spark, sf), search_queries(spark, sf), postings=entry_postings(spark, sf)))


@query(f"{search_sql('kb_id', 50)} SELECT kb_id, {_RESULT} FROM res")
def multi_kb_search(spark, sf):
    return _result(R.hybrid(entries(spark, sf), search_queries(spark, sf), final_k=R.MULTI_FINAL_K, by="kb_id", postings=entry_postings(spark, sf)), "kb_id")


_SCORER = "(length({t}) * 31 + ascii({t})) % 97 / 97"


@query(f"""{search_sql('', 50)},
mt AS (SELECT query_id, parent_id, score, rank, unnest(matched) AS id, generate_subscripts(matched, 1) AS i FROM res),
tx AS (SELECT query_id, parent_id, any_value(score) AS score, rank, substr(string_agg(text, chr(10) ORDER BY i), 1, 2000) AS rerank_text FROM (SELECT mt.*, e.text, row_number() OVER (PARTITION BY query_id, mt.parent_id, e.text ORDER BY i) AS once FROM mt JOIN (SELECT entry_id, text FROM entries) e ON e.entry_id = mt.id) WHERE once = 1 GROUP BY query_id, parent_id, rank),
sc AS (SELECT *, round(((length(rerank_text) * 31 + unicode(substr(rerank_text, 1, 1))) % 97)::DOUBLE / 97, 6) AS rerank_score FROM tx)
SELECT query_id, parent_id, round(score, 9) AS score, rerank_score, 'rerank' AS stage, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, round(score, 12) DESC, rank) AS final_rank FROM sc QUALIFY final_rank <= 10""")
def rerank_stage(spark, sf):
    e = entries(spark, sf)
    res = R.hybrid(e, search_queries(spark, sf), final_k=50, postings=entry_postings(spark, sf))
    hit = res.select("query_id", "parent_id", F.posexplode("matched").alias("i", "entry_id")).join(e.select("entry_id", "text"), "entry_id")
    texts = hit.groupBy("query_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("texts"))
    named = res.join(texts, ["query_id", "parent_id"]).withColumn("rerank_text", R.rerank_text(F.col("texts"), 2000))
    score = lambda t: F.round(((F.length(t) * 31 + F.ascii(t)) % 97).cast("double") / 97, 6)
    return R.rerank(named, score, 50, 10).select("query_id", "parent_id", F.round("score", 9).alias("score"), "rerank_score", "stage", F.col("final_rank").cast("long").alias("final_rank"))


@query("SELECT p, s, list_sort(list(label)) ::VARCHAR AS kbs, count(*) AS n FROM (SELECT DISTINCT label, label % 3 AS p, len(embedding)::INTEGER AS s FROM embeddings) GROUP BY p, s")
def embedding_groups(spark, sf):
    kb = table(spark, sf, "embeddings").select("label", (F.col("label") % 3).alias("p"), F.size("embedding").alias("s")).distinct()
    g = kb.groupBy("p", "s").agg(F.sort_array(F.collect_set("label")).alias("k"), F.count("*").alias("n"))
    return g.select("p", "s", F.concat(F.lit("["), F.array_join("k", ", "), F.lit("]")).alias("kbs"), "n")


@query("""WITH e AS (SELECT vec_id, label, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS ok FROM embeddings)
SELECT d.doc_id, e.label AS kb_id, length(d.text)::BIGINT AS n FROM documents d JOIN e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE ok AND coalesce(l.quality, 1) = 1 AND trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def index_projection(spark, sf):
    d, e = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    enabled = table(spark, sf, "labels").select("doc_id", "quality")
    ok = e.where(valid(F.col("embedding"), 64)).select("vec_id", F.col("label").alias("kb_id"))
    rows = d.join(ok, d.doc_id == ok.vec_id).join(enabled, "doc_id", "left").where("coalesce(quality, 1) = 1")
    return rows.where(F.btrim("text", F.lit(" \t\n\r")) != "").select("doc_id", "kb_id", F.length("text").cast("long").alias("n"))


@query(r"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term""")
def term_statistics(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    each = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"WITH {ENTRIES}, {SEARCH_QUERIES}, {keyword_sql()} SELECT query_id, entry_id, round(score, 6) AS score, r AS rank FROM k")
def keyword_unindexed(spark, sf):
    """The same without a stored index: texts are split anew."""
    return R.keyword_top(entries(spark, sf), search_queries(spark, sf), 30).select("query_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT vec_id AS entry_id, label FROM embeddings),
h AS (SELECT entry_id, d.doc_id, d.lang, CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id - d.doc_id % 4 END AS parent, d.text, d.source FROM e JOIN documents d ON d.doc_id = e.entry_id)
SELECT h.entry_id, coalesce(h.parent, h.doc_id) AS chunk_id, coalesce(h.source, '') AS title, length(coalesce(p.text, h.text))::BIGINT AS n_chars FROM h LEFT JOIN documents p ON p.doc_id = h.parent LEFT JOIN labels l ON l.doc_id = h.doc_id WHERE coalesce(l.toxic, 0) = 0""")
def evidence_join(spark, sf):
    d = table(spark, sf, "documents")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - F.col("doc_id") % 4).alias("parent_chunk_id"), F.col("text").alias("content"))
    gone = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, F.lit("x")).alias("deleted_at"))
    docs = d.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("title")).join(gone, "document_id", "left")
    nodes = d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("name"))
    out = R.evidence(e.select("entry_id"), e, chunks, docs, nodes)
    return out.select("entry_id", "chunk_id", "title", F.length("content").cast("long").alias("n_chars"))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS entry_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
c AS (SELECT *, CASE WHEN query_id % 4 = 0 THEN 0.0 ELSE (entry_id % 7)::DOUBLE END AS rerank_score, CASE WHEN query_id % 4 = 0 THEN 'rrf_fallback' ELSE 'rerank' END AS stage FROM r WHERE rank <= 50)
SELECT query_id, entry_id, 'candidate-' || lpad(rank::VARCHAR, 6, '0') AS candidate_id, rerank_score, stage, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS final_rank FROM c QUALIFY final_rank <= 5""")
def rerank_fallback(spark, sf):
    o = table(spark, sf, "orders")
    ranked = R.top(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("p")), ["query_id"], [F.desc("p"), "entry_id"], 1000)
    error = F.when((F.col("query_id") % 8 == 0) & (F.col("rank") == 1), "request_timeout")
    text = F.when(F.col("query_id") % 4 == 0, F.lit(None)).otherwise(F.col("entry_id").cast("string"))
    named = ranked.select("query_id", "entry_id", "rank", (-F.col("rank")).cast("double").alias("score"), text.alias("rerank_text"), error.alias("rerank_error"))
    out = R.rerank(named, lambda t: (t.cast("long") % 7).cast("double"), 50, 5)
    return out.select("query_id", "entry_id", "candidate_id", "rerank_score", "stage", F.col("final_rank").cast("long").alias("final_rank"))


@query("""SELECT event_id % 50 AS index, event_id AS row_id FROM events WHERE event_id < 60 AND (event_id % 50 < 10 OR event_id % 9 = 0 OR event_id % 50 >= 45)""")
def rerank_response_check(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    answer = e.where("event_id < 60").select(k.alias("row_id"), (k % 50).alias("index"), F.when(k % 18 == 0, float("nan")).when(k % 9 == 0, float("inf")).otherwise(0.5).alias("score"))
    return R.check_rerank(answer, 45).select("index", "row_id")


@query("""SELECT l_orderkey AS query_id, count(*) FILTER (l_returnflag = 'R') AS vector, count(*) FILTER (l_returnflag = 'A') AS keyword, count(*) FILTER (l_quantity > 30) AS fused, count(*) FILTER (l_quantity > 40) AS grouped, count(*) AS result FROM lineitem GROUP BY 1""")
def search_counters(spark, sf):
    x = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "query_id")
    out = R.counters(x.where("l_returnflag = 'R'"), x.where("l_returnflag = 'A'"), x.where("l_quantity > 30"), x.where("l_quantity > 40"), x)
    return out.fillna(0)


@query("""SELECT c_custkey AS entry_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 2 ELSE -1 END AS revision, CASE WHEN c_custkey % 3 = 0 THEN 'none' WHEN c_custkey % 5 = 0 THEN 'deleted' ELSE 'found' END AS kind FROM customer""")
def evidence_revisions(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    hits = c.select(k.alias("entry_id"))
    entries_ = c.select(k.alias("entry_id"), k.alias("chunk_id"), k.alias("document_id"))
    chunks = c.select(k.alias("chunk_id"), F.lit(None).cast("long").alias("parent_chunk_id"), (k * 2).alias("active_revision_id"))
    revs = c.where("c_custkey % 3 <> 0").select(k.alias("chunk_id"), F.explode(F.array(k, k * 2)).alias("revision_id")).withColumn("content", F.col("revision_id").cast("string"))
    named = R.active_content(chunks, revs)
    docs = c.select(k.alias("document_id"), F.lit("t").alias("title"), F.when((k % 5 == 0) & (k % 3 != 0), 1).alias("deleted_at"))
    found = R.evidence(hits, entries_, named, docs, docs.select("document_id", F.lit("n").alias("name")))
    gone = R.missing_evidence(hits, found, ["entry_id"]).withColumn("gone", F.lit(True))
    all_ = hits.join(named.select(F.col("chunk_id").alias("entry_id"), "content"), "entry_id").join(gone, "entry_id", "left")
    kind = F.when(F.col("content").isNull(), "none").when(F.col("gone"), "deleted").otherwise("found")
    return all_.select("entry_id", F.coalesce(F.col("content").cast("long"), F.lit(-1)).alias("revision"), kind.alias("kind"))


@query("""SELECT vec_id AS chunk_id, 'n' || vec_id AS document_name, 'rrf' AS ranking_stage, 16 AS n_fields FROM embeddings""")
def result_fields(spark, sf):
    from heronlake.operators.access import RESULT_FIELDS, result_rows

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("document_name"), F.lit("rrf").alias("ranking_stage"))
    full = result_rows(e)
    return full.select("chunk_id", "document_name", "ranking_stage", F.lit(sum(c in full.columns for c in RESULT_FIELDS)).alias("n_fields"))


@query("""SELECT page_id, strlen(html)::BIGINT AS n FROM pages WHERE page_id % 3 <> 0 AND strlen(html) <= 1500""")
def fetch_capped(spark, sf):
    from heronlake.sources.connector import within_size

    p = table(spark, sf, "pages")
    contents = p.where("page_id % 3 <> 0").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return within_size(contents, 1500).select("page_id", F.octet_length("content").cast("long").alias("n"))


# Entries come in three publications: those whose id % 5 < 4 at first; then the others come, with the text of another document for ids divisible by 7, and ids divisible by 11 go or don't come; then ids divisible by 13 come back with their own.
_MOVED = """moved AS (SELECT e.vec_id AS entry_id, e.vec_id // 4 AS parent_id, e.label AS kb_id, CASE WHEN e.vec_id % 7 = 0 AND e.vec_id % 13 <> 0 THEN o.text ELSE d.text END AS text, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
JOIN documents o ON o.doc_id = e.vec_id - e.vec_id % 2 WHERE e.vec_id % 11 <> 0 OR e.vec_id % 13 = 0)"""


def _publications(spark, sf):
    e = entries(spark, sf).select("entry_id", "kb_id", "text")
    other = table(spark, sf, "documents").select(F.col("doc_id").alias("_other"), F.col("text").alias("_text"))
    k = F.col("entry_id")
    ids = table(spark, sf, "embeddings").select((F.col("vec_id") - F.col("vec_id") % 2).alias("_other")).distinct()
    if ids.count() <= MOST_IDS:  # texts that nothing takes are left out before the texts are shuffled
        other = other.join(F.broadcast(ids), "_other", "left_semi")
    changed = e.join(other, k - k % 2 == F.col("_other")).select("entry_id", "kb_id", F.when(k % 7 == 0, F.col("_text")).otherwise(F.col("text")).alias("text"))
    none = e.select("entry_id").where("false")
    return [(e.where("entry_id % 5 < 4"), none), (changed.where("(entry_id % 7 = 0 or entry_id % 5 = 4) and entry_id % 11 <> 0"), e.where("entry_id % 11 = 0").select("entry_id")), (e.where("entry_id % 13 = 0"), none)]


@query(f"WITH {ENTRIES.replace('entries AS', 'every AS')}, {_MOVED}, queries AS (SELECT entry_id AS query_id, regexp_extract(text, '^([^ \\n]+[ \\n]+[^ \\n]+)', 1) AS query, embedding FROM every WHERE entry_id % 50 = 0 UNION ALL SELECT -entry_id - 1, regexp_extract(text, '^([^ \\n]+)', 1), embedding FROM every WHERE entry_id % 50 = 0), entries AS (SELECT * FROM moved), {keyword_sql('kb_id')} SELECT query_id, kb_id, entry_id, round(score, 6) AS score, r AS rank FROM k")
def keyword_after_publications(spark, sf):
    """Keyword search of an index that followed three publications by segments, the last two merged; one- and two-word queries."""
    index = publication_index(spark, sf, _publications)
    q = search_queries(spark, sf)
    first = q.select((-F.col("query_id") - 1).alias("query_id"), F.regexp_extract("query", r"^([^ \n]+)", 1).alias("query"), "embedding")
    return index.search(q.unionByName(first), 30, "kb_id").select("query_id", "kb_id", "entry_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(None)
def vector_index(spark, sf):
    """Approximate search with a stored index: product-quantised cells, pruned partitions, exact rescoring; its recall against exact search is a test."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    q = e.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    return stored_vectors(spark, sf).calibrate(q, R.vector_top_batch(e, q, 30), 30).search(q, 30)


# Even bases are of workspace 0, odd ones of workspace 1. Entries divisible by 9 lie in a generation that is no longer active, those divisible by 11 are staged only; base 4 is deleted. Key 1 reads all of
# workspace 0, key 2 bases 1 and 3 of its own and, in vain, 2. Of the requests one in four asks for a base it may not read, and one in four for none.
_SCOPED = f"""WITH {ENTRIES.replace('FROM embeddings e', 'FROM (SELECT * FROM embeddings WHERE vec_id % 9 <> 0 AND vec_id % 11 <> 0 AND label <> 4) e')}, every AS (SELECT e.vec_id AS entry_id, d.text, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
{SEARCH_QUERIES.replace('FROM entries', 'FROM every')}, pairs AS (SELECT query_id, unnest(CASE query_id % 200 WHEN 0 THEN [0, 2, 8] WHEN 50 THEN [1, 3] ELSE []::INTEGER[] END) AS kb_id FROM queries),
sim AS (SELECT q.query_id, e.kb_id, e.entry_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM pairs p JOIN entries e ON e.kb_id = p.kb_id JOIN queries q ON q.query_id = p.query_id),
{vector_sql('kb_id')}, {keyword_sql('kb_id').replace('k AS (SELECT query_id', 'k0 AS (SELECT query_id')}, k AS (SELECT k0.* FROM k0 JOIN pairs USING (query_id, kb_id)), {fused_sql('kb_id')}, {grouped_sql('kb_id', 50)}"""


def _requests(spark, sf):
    e = entries(spark, sf)
    k, kb = F.col("entry_id"), F.col("kb_id")
    generation = F.when(k % 9 == 0, kb + 100).otherwise(kb)
    stored = e.select((kb % 2).alias("workspace_id"), "kb_id", generation.alias("generation_id"), F.when(k % 11 == 0, "staging").otherwise("published").alias("state"), "entry_id", "parent_id", "text", "embedding")
    kbs = spark.range(10).select((F.col("id") % 2).cast("int").alias("workspace_id"), F.col("id").cast("int").alias("kb_id"))
    bases = kbs.select("*", F.col("kb_id").alias("active_generation_id"), F.when(F.col("kb_id") == 4, 1).alias("deleted_at"))
    generations = kbs.select("*", F.explode(F.array("kb_id", F.col("kb_id") + 100)).alias("generation_id"), F.lit(64).alias("dimension"))
    grants = spark.createDataFrame([(1, 0, True, []), (2, 1, False, [1, 2, 3])], "key_id int, workspace_id int, unrestricted boolean, kb_ids array<int>")
    q = F.col("query_id")
    asked = search_queries(spark, sf).select(
        q.alias("request_id"), F.when(q % 100 == 0, 1).otherwise(2).alias("key_id"),
        F.when(q % 200 == 0, F.array(F.lit(2), F.lit(0), F.lit(8), F.lit(2))).when(q % 200 == 50, F.array(F.lit(1), F.lit(3))).when(q % 200 == 100, F.array(F.lit(0), F.lit(1))).otherwise(F.array().cast("array<int>")).alias("kb_ids"), "query", "embedding",
    )
    return asked, grants, bases, generations, stored


@query(f"{_SCOPED} SELECT kb_id, {_RESULT} FROM res")
def scoped_search(spark, sf):
    from heronlake.operators.search import search_requests

    return _result(search_requests(*_requests(spark, sf))[0], "kb_id")


@query(f"WITH {ENTRIES} SELECT entry_id AS request_id, CASE entry_id % 200 WHEN 100 THEN 'not_found' WHEN 150 THEN 'invalid' ELSE 'ok' END AS status FROM entries WHERE entry_id % 50 = 0")
def scoped_search_status(spark, sf):
    from heronlake.operators.search import search_requests

    return search_requests(*_requests(spark, sf))[1]


@query(f"""{_SCOPED},
mt AS (SELECT query_id, kb_id, parent_id, score, rank, unnest(matched) AS id, generate_subscripts(matched, 1) AS i FROM res),
tx AS (SELECT query_id, kb_id, parent_id, any_value(score) AS score, rank, substr(string_agg(text, chr(10) ORDER BY i), 1, 2000) AS rerank_text FROM (SELECT mt.*, e.text, row_number() OVER (PARTITION BY query_id, mt.kb_id, mt.parent_id, e.text ORDER BY i) AS once FROM mt JOIN (SELECT entry_id, text FROM entries) e ON e.entry_id = mt.id) WHERE once = 1 GROUP BY query_id, kb_id, parent_id, rank),
sc AS (SELECT *, round(((length(rerank_text) * 31 + unicode(substr(rerank_text, 1, 1))) % 97)::DOUBLE / 97, 6) AS rerank_score FROM tx)
SELECT query_id, kb_id, parent_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, round(score, 12) DESC, rank) AS final_rank FROM sc QUALIFY final_rank <= 10""")
def scoped_rerank(spark, sf):
    """One rerank over all bases of each request."""
    from heronlake.operators.search import search_requests

    score = lambda t: F.round(((F.length(t) * 31 + F.ascii(t)) % 97).cast("double") / 97, 6)
    return search_requests(*_requests(spark, sf), final_k=10, scorer=score)[0].select("query_id", "kb_id", "parent_id", "rerank_score", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"{_SCOPED} SELECT kb_id, {_RESULT} FROM res")
def tenant_search(spark, sf):
    """The same requests given to each workspace: its own scope answers those of its keys."""
    asked, *rest = _requests(spark, sf)
    stored = tenants(spark, sf, "search", lambda: dict(zip(("grants", "bases", "generations", "entries"), rest, strict=True)))
    found = [stored.within(w).search(asked)[0] for w in (0, 1)]
    return _result(found[0].unionByName(found[1]), "kb_id")
