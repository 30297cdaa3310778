"""Registered chunking and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text as T
from heronlake.operators import chunking as C
from heronlake.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TRIM = r"regexp_replace(regexp_replace({0}, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')"


@query(f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN n <= 512 THEN 0 ELSE ceil((n - 512) / 432.0)::INTEGER END)) AS sequence FROM d),
c AS (SELECT doc_id, sequence::INTEGER AS sequence, {_TRIM.format('substr(text, sequence * 432 + 1, 512)')} AS content FROM s)
SELECT * FROM c WHERE content <> ''""")
def chunk_fixed_window(spark, sf):
    return C.fixed_windows(table(spark, sf, "documents"), 512, 80)


@query(rf"""WITH RECURSIVE w(doc_id, text, start, stop) AS (
  SELECT doc_id, text, 0, 0 FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, nxt, nxt + CASE
      WHEN nxt + 512 > length(text) THEN length(text) - nxt
      WHEN p2 > 0 AND 512 - p2 + 1 > 256 THEN 512 - p2 + 1
      WHEN p1 > 0 AND 512 - p1 + 1 > 256 THEN 512 - p1 + 1
      WHEN 512 - p0 > 256 THEN 512 - p0 ELSE 512 END
  FROM (SELECT doc_id, text, nxt, instr(seg, chr(10) || chr(10)) AS p2, instr(seg, chr(10)) AS p1, length(regexp_extract(seg, '^[^。！？.!?；;]*')) AS p0
    FROM (SELECT *, reverse(substr(text, nxt + 1, 512)) AS seg FROM (SELECT doc_id, text, CASE WHEN stop = 0 THEN 0 WHEN stop - 80 <= start THEN stop ELSE stop - 80 END AS nxt FROM w WHERE stop < length(text))))),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS sequence, {_TRIM.format('substr(text, start + 1, stop - start)')} AS content FROM w WHERE stop > 0)
SELECT doc_id::VARCHAR AS document_id, sequence::INTEGER AS sequence, content FROM c WHERE content <> ''""")
def chunk_preferred_boundary(spark, sf):
    config = C.ChunkingConfig(enable_parent_child=False, strategy="recursive")
    return C.chunk(table(spark, sf, "documents"), config, id_col="doc_id").select("document_id", "sequence", "content")


@query(None)
def chunk_parent_child(spark, sf):
    return C.chunk(table(spark, sf, "documents"), C.ChunkingConfig(), id_col="doc_id", title_col="source").select("document_id", "chunk_id", "role", "parent_chunk_id", "sequence", "content", "embedding_content")


_LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


@query(rf"""WITH {_LINES}, t AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l),
b AS (SELECT doc_id, n, regexp_matches(line, '^(#|\f|第.*(章|节|部分)|[0-9]+[.、)]|[-_=*]{{3,}}$)') OR (regexp_matches(line, '^[A-Z _:-]+$') AND regexp_matches(line, '[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]')) AS starts FROM t)
SELECT doc_id, count(*) AS n_lines, sum(starts::INTEGER)::BIGINT AS n_sections FROM b GROUP BY doc_id""")
def heuristic_boundaries(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(C.boundary_column(F.col("line"))).alias("n_sections"))


@query("""WITH p AS (SELECT doc_id, [source, lang, upper(lang), NULL, 'Body'] AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM p),
o AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS n FROM u WHERE x IS NOT NULL AND trim(x) <> ''),
h AS (SELECT doc_id, string_agg(trim(x), ' > ' ORDER BY i) AS header FROM o WHERE n = 1 GROUP BY doc_id)
SELECT doc_id, header, length(header || chr(10) || chr(10) || d.text)::INTEGER AS n_chars FROM h JOIN documents d USING (doc_id)""")
def context_header(spark, sf):
    d = table(spark, sf, "documents").withColumn("header", T.context_header(F.col("source"), F.array("lang", F.upper("lang"), F.lit(None)), F.lit("Body")))
    return d.select("doc_id", "header", F.length(T.embedding_text(F.col("header"), F.col("text"))).alias("n_chars"))


@query("""WITH q AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) AS q, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS raw FROM conversations WHERE role = 'user' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
f AS (SELECT conv_id, turn, raw FROM q QUALIFY row_number() OVER (PARTITION BY conv_id, lower(q) ORDER BY turn) = 1),
a AS (SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT f.conv_id, count(*) AS n_questions, any_value(answer) AS content, string_agg(raw, chr(10) ORDER BY turn) AS embedding_content,
  string_agg('Q: ' || raw, chr(10) ORDER BY turn) || chr(10) || 'A: ' || any_value(answer) AS source FROM f JOIN a USING (conv_id) GROUP BY f.conv_id""")
def faq_chunks(spark, sf):
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("sequence"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"))
    return C.faq_chunks(q, a, "conv_id")


@query(r"""WITH m AS (SELECT page_id, '![a](' || url || ') and <img src="' || url || '"> ![b](img/' || page_id || '.png "t")' AS md FROM pages)
SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(md, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), regexp_extract_all(md, '<img[^>]*\ssrc=["'']([^"'']+)["'']', 1)))) AS ref FROM m""")
def asset_refs(spark, sf):
    md = F.concat(F.lit("![a]("), F.col("url"), F.lit(') and <img src="'), F.col("url"), F.lit('"> ![b](img/'), F.col("page_id").cast("string"), F.lit('.png "t")'))
    return table(spark, sf, "pages").select("page_id", F.explode(T.asset_refs(md)).alias("ref"))


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '(\?[^#]*)', 1) AS q FROM pages)
SELECT page_id, CASE WHEN s IN ('http', 'https') AND h <> '' AND h NOT LIKE '%@%' THEN s || '://' || regexp_replace(h, CASE s WHEN 'http' THEN ':(80)?$' ELSE ':(443)?$' END, '') || CASE p WHEN '' THEN '/' ELSE p END || q END AS uri FROM p""")
def web_uri_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.web_uri(F.col("url")).alias("uri"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(concat_ws(':', 'doc', doc_id::VARCHAR, source)) AS task_hash FROM documents")
def content_hashes(spark, sf):
    from heronlake.functions.hashing import content_hash

    d = table(spark, sf, "documents")
    return d.select("doc_id", content_hash(F.col("text")).alias("content_hash"), F.sha2(T.task_id(F.lit("doc"), F.col("doc_id").cast("string"), F.col("source")), 256).alias("task_hash"))
