"""The test tables as the model's entities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.operators.ancestry import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_indexes: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> object:
    """What build(folder) stores, built once for each application and input, in the folder that spark.checkpoint.dir names (a local one in local sessions)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = build(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _indexes[key]


def _index(spark: SparkSession, sf_dir: str, name: str, make) -> object:
    """The stored inverted index of a table."""
    from heronlake.operators.index import Postings

    def build(folder: str):
        rows, by = make()
        return Postings.build(rows, folder, "text", by)

    return _once(spark, sf_dir, name, build)


def publication_index(spark: SparkSession, sf_dir: str, publications):
    """The stored index that followed publications(spark, sf_dir), each (entries that came, entries that went)."""
    from heronlake.operators.live_postings import LivePostings

    def build(folder: str):
        out = LivePostings(spark, folder, "kb_id")
        for came, gone in publications(spark, sf_dir):
            out.apply(came, gone)
        out.merge()
        return out

    return _once(spark, sf_dir, "publications", build)


def tenants(spark: SparkSession, sf_dir: str, name: str, make):
    """The workspaces' tables that make() gives by name, stored once under a name."""
    from heronlake.operators.tenants import Tenants

    return _once(spark, sf_dir, name, lambda folder: Tenants(spark, folder).load(**make()))


def stored_vectors(spark: SparkSession, sf_dir: str):
    """The stored index of all vectors."""
    from heronlake.operators.vector_index import VectorIndex

    return _once(spark, sf_dir, "vectors", lambda folder: VectorIndex.build(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding"), folder))


def document_postings(spark: SparkSession, sf_dir: str):
    """The stored inverted index of all documents."""
    return _index(spark, sf_dir, "document-postings", lambda: (table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), "text"), None))


def entry_postings(spark: SparkSession, sf_dir: str):
    """The stored inverted index of all entries, with their knowledge bases."""
    return _index(spark, sf_dir, "entry-postings", lambda: (entries(spark, sf_dir), "kb_id"))


#: Ids that are broadcast at most.
MOST_IDS = 2_000_000


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval entries: each vector with its document; four neighbours have one parent; the vector's label is the knowledge base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), "embedding", F.col("label").alias("kb_id"))
    if vecs.count() <= MOST_IDS:  # texts without a vector are left out before the texts are shuffled
        docs = docs.join(F.broadcast(vecs.select(F.col("entry_id").alias("doc_id"))), "doc_id", "left_semi")
    return vecs.join(docs, vecs.entry_id == docs.doc_id).select("entry_id", F.expr("entry_id div 4").alias("parent_id"), "kb_id", "text", "embedding")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every entry whose id is divisible by 50 asks for its own vector and its text's first two words."""
    e = entries(spark, sf_dir).where("entry_id % 50 = 0")
    return e.select(F.col("entry_id").alias("query_id"), F.regexp_extract("text", r"^([^ \n]+[ \n]+[^ \n]+)", 1).alias("query"), "embedding")


#: The same in DuckDB.
ENTRIES = "entries AS (SELECT e.vec_id AS entry_id, e.vec_id // 4 AS parent_id, e.label AS kb_id, d.text, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"
SEARCH_QUERIES = r"queries AS (SELECT entry_id AS query_id, regexp_extract(text, '^([^ \n]+[ \n]+[^ \n]+)', 1) AS query, embedding FROM entries WHERE entry_id % 50 = 0)"
EDGES = "sim AS (SELECT q.query_id, e.kb_id, e.entry_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM entries e, queries q)"


def vector_sql(by: str = "") -> str:
    g = f", {by}" if by else ""
    return f"v AS (SELECT query_id{g}, entry_id, score, row_number() OVER (PARTITION BY query_id{g} ORDER BY round(score, 9) DESC, entry_id) AS r FROM sim QUALIFY r <= 30)"


def keyword_sql(by: str = "") -> str:
    g = f", {by}" if by else ""
    return f"""tok AS (SELECT entry_id, kb_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM entries),
post AS (SELECT entry_id, kb_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM tok),
want AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM queries),
need AS (SELECT query_id, count(*) AS n FROM want GROUP BY 1),
hit AS (SELECT query_id, entry_id, kb_id, pos, term FROM post JOIN want USING (term)),
enough AS (SELECT query_id, entry_id FROM hit GROUP BY 1, 2 HAVING count(DISTINCT term) = (SELECT n FROM need WHERE need.query_id = hit.query_id)),
num AS (SELECT *, row_number() OVER (PARTITION BY query_id, entry_id ORDER BY pos) AS rn FROM hit SEMI JOIN enough USING (query_id, entry_id)),
spread AS (SELECT a.*, w.term AS want, max(CASE WHEN a.term = w.term THEN pos END) OVER (PARTITION BY a.query_id, entry_id, w.term ORDER BY pos) AS lp FROM num a JOIN want w ON a.query_id = w.query_id),
cov AS (SELECT query_id, entry_id, kb_id, pos AS e, rn, min(lp) AS s, count(lp) AS have FROM spread GROUP BY ALL),
mini AS (SELECT c.query_id, entry_id, kb_id, s, min(e) AS e, min(rn) AS rn FROM cov c JOIN need USING (query_id) WHERE have = n GROUP BY 1, 2, 3, 4),
kw AS (SELECT m.query_id, m.entry_id, m.kb_id, sum(0.1::DOUBLE / (1 + (e - s) - (m.rn - n.rn))) AS score FROM mini m JOIN num n ON n.query_id = m.query_id AND n.entry_id = m.entry_id AND n.pos = m.s GROUP BY 1, 2, 3),
k AS (SELECT query_id{g}, entry_id, score, row_number() OVER (PARTITION BY query_id{g} ORDER BY round(score, 9) DESC, entry_id) AS r FROM kw QUALIFY r <= 30)"""


def fused_sql(by: str = "") -> str:
    g = f", {by}" if by else ""
    return f"fused AS (SELECT query_id{g}, entry_id, coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + k.r), 0) AS score, v.score AS vector_score, k.score AS keyword_score FROM v FULL JOIN k USING (query_id{g}, entry_id))"


def grouped_sql(by: str = "", final_k: int = 10) -> str:
    g = f", {by}" if by else ""
    return f"""named AS (SELECT f.*, p.parent_id FROM fused f JOIN (SELECT entry_id, parent_id FROM entries) p USING (entry_id)),
grp AS (SELECT query_id{g}, parent_id, list(entry_id ORDER BY score DESC, entry_id) AS m, max(score) AS score FROM named GROUP BY query_id{g}, parent_id),
res AS (SELECT query_id{g}, parent_id, m[1] AS entry_id, score, m AS matched, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC{g}, m[1]) AS rank FROM grp QUALIFY rank <= {final_k})"""


def search_sql(by: str = "", final_k: int = 10) -> str:
    return f"WITH {ENTRIES}, {SEARCH_QUERIES}, {EDGES}, {vector_sql(by)}, {keyword_sql(by)}, {fused_sql(by)}, {grouped_sql(by, final_k)}"
