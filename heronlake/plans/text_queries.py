"""Registered queries of scalar functions, assets, embedding and stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text as T
from heronlake.functions.vectors import half
from heronlake.operators import assets as A
from heronlake.operators import chunking as C
from heronlake.operators import embedding as E
from heronlake.operators import index as I
from heronlake.operators import retrieval as R
from heronlake.plans.chunk_queries import _TRIM
from heronlake.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""SELECT doc_id, replace(replace(text, chr(13), chr(10)), chr(10), '|') AS fixed, CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' WHEN 3 THEN 'docx' ELSE NULL END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'D ' || doc_id WHEN doc_id % 3 = 1 THEN 'second' ELSE '-' END AS shown,
CASE doc_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'bin' END AS ext, 'raw/' || doc_id || '/a_b.txt' AS key, CASE doc_id % 4 WHEN 0 THEN 'revoked' WHEN 1 THEN 'expired' ELSE 'active' END AS key_status,
CASE WHEN doc_id % 2 = 0 THEN 'candidate_ready' WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'updating' ELSE 'synced' END AS state, CASE WHEN doc_id % 7 = 0 THEN 'remove' ELSE 'keep' END AS policy FROM documents WHERE text IS NOT NULL""")
def scalar_text(spark, sf):
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    crlf = F.concat(F.lit("﻿"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    name = F.when(k % 5 == 0, "x.MD").when(k % 5 == 1, "x.pdf").when(k % 5 == 2, "y.tar.CSV")
    at = lambda x: F.lit(x).cast("timestamp")
    return table(spark, sf, "documents").where("text is not null").select(
        "doc_id", F.replace(T.normalize_newlines(crlf), F.lit("\n"), F.lit("|")).alias("fixed"), T.file_type(name, F.when(k % 5 == 3, "application/docx")).alias("kind"),
        T.display_name(F.when(k % 3 == 0, F.concat(F.lit(" D "), s)), F.when(k % 3 == 1, "second").otherwise("  ")).alias("shown"), T.mime_extension(F.when(k % 6 == 0, "image/PNG").when(k % 6 == 1, " image/jpeg").otherwise("text/x")).alias("ext"),
        T.object_key(F.lit("raw"), k, F.lit("a b.txt")).alias("key"), T.api_key_status(F.when(k % 4 == 0, at("2020-01-01")), F.when(k % 4 == 1, at("2021-01-01")).when(k % 4 == 2, at("2031-01-01")), at("2025-01-01")).alias("key_status"),
        T.sync_state(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("state"), T.delete_policy(F.when(k % 7 == 0, " REMOVE\n").when(k % 7 == 1, "odd")).alias("policy"),
    )


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'drive_folder' WHEN 1 THEN 'wiki_node' WHEN 2 THEN 'wiki_node' END AS kind, CASE page_id % 4 WHEN 3 THEN NULL ELSE 'tok' || page_id END AS token, 'a b+' || page_id || '/c.png' AS path, TIMESTAMP '1970-01-01' + to_seconds(page_id) AS at, CASE WHEN page_id % 2 = 0 THEN 'bytes ' || page_id END AS data FROM pages""")
def scalar_sources(spark, sf):
    s, k = F.col("page_id").cast("string"), F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://x.io/drive/folder/tok"), s, F.lit("?a=1"))).when(k % 4 == 1, F.concat(F.lit("https://x.io/wiki/tok"), s)).when(k % 4 == 2, F.concat(F.lit("tok"), s)).otherwise("https://x.io/other/path")
    body = F.base64(F.encode(F.concat(F.lit("bytes "), s), "UTF-8"))
    data = F.decode(T.data_uri(F.concat(F.lit("data:image/png;base64,"), F.when(k % 2 == 0, body).otherwise("!")), 1000), "UTF-8")
    path = T.relative_path(F.concat(F.lit("././a%20b+"), s, F.lit("\\c.png")))
    return table(spark, sf, "pages").select("page_id", T.sync_root(url).alias("kind"), T.sync_token(url).alias("token"), path.alias("path"), T.millis((k * 1000).cast("string")).alias("at"), data.alias("data"))


@query(r"""WITH i AS (SELECT doc_id, regexp_replace(text, '([\\`*_\[\]<>|~])', '\\\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: CASE WHEN starts_with(x, chr(9)) THEN '&#9;' || substr(x, 2) WHEN starts_with(x, '    ') THEN '&#32;' || substr(x, 2)
ELSE regexp_replace(x, '^( {0,3})(#{1,6}(?:[ \t]|$)|[-+](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$)|=+[ \t]*$|(?:[ \t]*-){3}[-\t ]*$)', '\1\\\2') END) AS ls FROM i)
SELECT doc_id, array_to_string(ls, chr(10)) AS escaped FROM b""")
def escape_markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.escape_markdown(F.col("text")).alias("escaped"))


@query("""SELECT doc_id, sha256('{"id":' || doc_id || ',"lang":"' || lang || '"}') AS request FROM documents WHERE lang IS NOT NULL""")
def request_hashes(spark, sf):
    from heronlake.functions.hashing import request_hash

    return table(spark, sf, "documents").where("lang is not null").select("doc_id", request_hash(F.col("doc_id").alias("id"), "lang").alias("request"))


_WORDS = ["智能", "人工智能", "技术"]


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '人工智能/与/技术' WHEN 1 THEN '新/技术/的/spark/入门' ELSE '学' END || '/x1/你好/好吗' AS terms FROM documents WHERE text IS NOT NULL")
def cjk_terms(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    k = F.col("doc_id") % 3
    text = F.concat(F.when(k == 0, "人工智能与技术").when(k == 1, "新技术的Spark入门").otherwise("学"), F.lit(" X1 你好吗"))
    return d.select("doc_id", F.array_join(T.cjk_tokens(text, _WORDS), "/").alias("terms"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x::DOUBLE / pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END)), 6) AS total FROM embeddings""")
def half_precision(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", half(F.col("embedding")).alias("h"))
    return v.select("vec_id", F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _asset_docs(spark, sf):
    s = F.col("page_id").cast("string")
    md = F.concat(F.lit("see ./img/"), s, F.lit(".png: ![a](./img/"), s, F.lit('.png "t") and <img src="http://x/y.png"> ![b](data:image/png;base64,QUJD) ![c](gone.gif) ![d](doc.pdf)'))
    docs = table(spark, sf, "pages").select("page_id", md.alias("markdown"))
    files = docs.select("page_id", F.explode(F.array(F.struct(F.concat(F.lit("img/"), s, F.lit(".png")).alias("path"), F.lit("image/png").alias("mime")), F.struct(F.lit("doc.pdf").alias("path"), F.lit("application/pdf").alias("mime")))).alias("f"))
    files = files.select("page_id", "f.path", "f.mime", F.encode(F.concat(F.lit("picture "), s), "UTF-8").alias("content"))
    return docs, A.resolve(A.references(docs, "page_id", "markdown"), files, "page_id")


@query("""SELECT page_id, u.n::INTEGER AS n, u.problem, CASE WHEN u.body IS NOT NULL THEN 'assets/' || page_id || '/' || sha256(u.body) || '.png' END AS key FROM pages, LATERAL (VALUES (0, NULL, 'picture ' || page_id), (1, NULL, 'ABC'), (2, 'missing', NULL), (3, 'type', NULL), (4, 'remote', NULL)) u(n, problem, body)""")
def asset_resolution(spark, sf):
    return _asset_docs(spark, sf)[1].select("page_id", "n", "problem", "key")


@query("""SELECT page_id, 'see ./img/' || page_id || '.png: ![a](asset://assets/' || page_id || '/' || sha256('picture ' || page_id) || '.png "t") and <img src="http://x/y.png"> ![b](asset://assets/' || page_id || '/' || sha256('ABC') || '.png) ![c](gone.gif) ![d](doc.pdf)' AS markdown FROM pages""")
def asset_rewrite(spark, sf):
    docs, resolved = _asset_docs(spark, sf)
    return A.rewrite(docs, resolved, "page_id", "markdown")


@query("""SELECT 'new' AS origin, page_id, n::INTEGER AS n, size::BIGINT AS size FROM pages, LATERAL (VALUES (0, length('picture ' || page_id)), (1, 3)) u(n, size) UNION ALL SELECT 'old', -page_id, 0, 9 FROM pages WHERE page_id <> 0""")
def asset_archive(spark, sf):
    _, resolved = _asset_docs(spark, sf)
    row = lambda key: table(spark, sf, "pages").select(key.alias("page_id"), F.lit(0).alias("n"), F.lit("k").alias("key"), F.lit("image/png").alias("mime"), F.lit(9).cast("long").alias("size"))
    k = F.col("page_id")
    out = A.archived(row(k).unionByName(row(-k)).where("page_id <> 0"), resolved, "page_id")
    fresh = out.where("key <> 'k'").select(F.lit("new").alias("origin"), "page_id", "n", "size")
    return fresh.unionByName(out.where("key = 'k'").select(F.lit("old").alias("origin"), "page_id", "n", "size"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ' || chr(10) || chr(9)) = '' THEN 'blank' END AS embedding_error, CASE WHEN text IS NULL OR trim(text, ' ' || chr(10) || chr(9)) = '' THEN -1 ELSE 4 END AS dimension, CASE WHEN NOT (text IS NULL OR trim(text, ' ' || chr(10) || chr(9)) = '') THEN length(text) % 97 ELSE -1 END AS first FROM documents""")
def embed_batches(spark, sf):
    out = E.embed(table(spark, sf, "documents").select("doc_id", "text"), lambda ts: [[float(len(t) % 97), 1.0, 2.0, 3.0] for t in ts], 4, "text", 7)
    return out.select("doc_id", "embedding_error", F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(-1).alias("dimension"), F.coalesce(F.col("embedding")[0].cast("long"), F.lit(-1)).alias("first"))


@query(rf"""WITH RECURSIVE w(doc_id, text, start, stop) AS (
  SELECT doc_id, text, 0, 0 FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, nxt, nxt + CASE
      WHEN nxt + 384 > length(text) THEN length(text) - nxt
      WHEN p2 > 0 AND 384 - p2 + 1 > 192 THEN 384 - p2 + 1
      WHEN p1 > 0 AND 384 - p1 + 1 > 192 THEN 384 - p1 + 1
      WHEN 384 - p0 > 192 THEN 384 - p0 ELSE 384 END
  FROM (SELECT doc_id, text, nxt, instr(seg, chr(10) || chr(10)) AS p2, instr(seg, chr(10)) AS p1, length(regexp_extract(seg, '^[^。！？.!?；;]*')) AS p0
    FROM (SELECT *, reverse(substr(text, nxt + 1, 384)) AS seg FROM (SELECT doc_id, text, CASE WHEN stop = 0 THEN 0 WHEN stop - 76 <= start THEN stop ELSE stop - 76 END AS nxt FROM w WHERE stop < length(text))))),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS sequence, {_TRIM.format('substr(text, start + 1, stop - start)')} AS content FROM w WHERE stop > 0)
SELECT doc_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY sequence)::INTEGER - 1 AS sequence, content FROM c WHERE content <> ''""")
def chunk_children(spark, sf):
    """Children of the default parent-and-child mode; parents are tested as properties."""
    got = C.chunk(table(spark, sf, "documents"), C.ChunkingConfig(strategy="recursive"), id_col="doc_id")
    return got.where("role = 'child'").select("document_id", "sequence", "content")


@query(r"""WITH e AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(ts) AS term FROM e)
SELECT doc_id, term, count(*)::INTEGER AS tf FROM p WHERE term IN ('the', 'de', 'der', 'is') GROUP BY 1, 2""")
def stored_postings(spark, sf):
    from heronlake.plans.tables import document_postings

    q = spark.createDataFrame([(0, "The de DER is")], "query_id long, query string")
    index = document_postings(spark, sf)
    return index.read(R.query_terms(q)).select(F.col("entry_id").alias("doc_id"), "term", "tf")


@query(None)
def vector_cells(spark, sf):
    """Approximate search; its recall against exact search is a test."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding")
    q = e.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    exact = R.vector_top_batch(e, q, 30)
    cells = I.Cells.fit(e)
    index = cells.assign(e)
    return cells.calibrate(index, q, exact, 30).search(index, q, 30)
