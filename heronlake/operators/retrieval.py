"""Hybrid retrieval for batches of queries: vector and keyword candidates, rank fusion, parent grouping, rerank.

Candidates carry ids and scores only; texts are joined after the cut. Every ranking is a window with a row limit,
which Spark applies before its shuffle too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heronlake.functions.text import tokens
from heronlake.functions.vectors import cosine
from heronlake.operators.term_sets import best_of_texts, few_sets, named_sets, of_queries, round9

#: Defaults and bounds.
RRF_K, VECTOR_K, KEYWORD_K, FINAL_K, MULTI_FINAL_K, MAX_FINAL_K = 60, 30, 30, 10, 50, 50
RERANK_RANGE = (50, 200)
MAX_BASES = 20
BLOCK = 1024


def check_options(vector_k: int = VECTOR_K, keyword_k: int = KEYWORD_K, final_k: int = FINAL_K, rrf_k: int = RRF_K) -> tuple[int, int, int, int]:
    """Options within their bounds; the final size is cut to the largest allowed."""
    for name, v in (("vector_k", vector_k), ("keyword_k", keyword_k)):
        if not 1 <= v <= 1000:
            raise ValueError(f"{name} must be 1 to 1000")
    if final_k < 1 or rrf_k < 1:
        raise ValueError("final_k and rrf_k must be positive")
    return vector_k, keyword_k, min(final_k, MAX_FINAL_K), rrf_k


def top(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """Rows of rank 1 to k within keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)


def vector_top(entries: DataFrame, vector: Column | list[float], k: int = VECTOR_K) -> DataFrame:
    """One query's nearest entries by cosine: entry_id, score."""
    if isinstance(vector, list):
        vector = F.array(*map(F.lit, vector))
    scored = entries.select("entry_id", cosine(F.col("embedding"), vector).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "entry_id").limit(k)


def _blocks(df: DataFrame, id_col: str, groups: list[str]) -> DataFrame:
    """Unit vectors in blocks: (groups, ids, vectors), one group (knowledge base) and one dimension in a block; vectors without a length or with odd numbers go."""

    arrow = [to_arrow_type(df.schema[g].dataType) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            t = t[t["embedding"].notna()]
            for key, part in t.groupby(groups, dropna=False) if groups else [((), t)]:
                for p in [same.iloc[lo : lo + BLOCK] for _, same in part.groupby(part["embedding"].map(len)) for lo in range(0, len(same), BLOCK)]:
                    v = np.array(p["embedding"].tolist(), np.float64)
                    size = np.sqrt((v * v).sum(axis=1))
                    good = np.isfinite(size) & (size > 0)
                    if good.any():
                        v = v[good] / size[good, None]
                        row = [*[pa.array([k], a) for k, a in zip(key, arrow, strict=True)], pa.array([p[id_col].to_numpy(np.int64)[good].tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(row, [*groups, "ids", "vectors"])

    kinds = ", ".join(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups)
    return df.select(id_col, "embedding", *groups).mapInArrow(run, f"{kinds + ', ' if kinds else ''}ids binary, vectors binary")


#: Blocks of queries whose best rows a task holds at most.
MOST_HELD = 64


def _best_of(s: np.ndarray, ids: np.ndarray, k: int, before: tuple | None) -> tuple:
    """(number, id, score, least): the best k of each row of scores together with those before; equal rounded scores go by id. least: the k-th score, less what rounding hides."""
    n = len(s)
    least = np.full(n, -np.inf) if before is None else before[3]
    here = np.partition(s, -k, axis=1)[:, -k] - 2e-9 if np.isinf(least).any() and len(ids) > k else np.full(n, -np.inf)
    number, at = np.nonzero(s >= np.maximum(least, here)[:, None])
    entry, score = ids[at], s[number, at]
    if before is not None:
        if not len(number):
            return before
        number, entry, score = (np.concatenate(x) for x in zip(before[:3], (number, entry, score), strict=True))
    order = np.lexsort((entry, -round9(score), number))
    number = number[order]
    first = np.searchsorted(number, np.arange(n))
    place = np.arange(len(number)) - first[number]
    keep = order[place < k]
    last = place == k - 1
    least = np.full(n, -np.inf)
    least[number[last]] = score[order[last]] - 2e-9
    return number[place < k], entry[keep], score[keep], least


def vector_top_batch(entries: DataFrame, queries: DataFrame, k: int = VECTOR_K, by: str | None = None, granted: DataFrame | None = None) -> DataFrame:
    """Each query's nearest entries by exact cosine (in each `by` group): query_id, [by], entry_id, score, rank.

    entries: entry_id, embedding, [by]; queries: query_id, embedding. Both sides go in blocks of vectors; each pair of blocks is one
    matrix product that yields its best k, so what is shuffled follows queries * blocks * k. With granted (query_id, by), queries meet only the blocks of the groups they may
    read, joined by group and dimension; without, all blocks.
    """
    groups = [by] if by else []
    e = _blocks(entries, "entry_id", groups)
    asked = queries if granted is None else queries.select("query_id", "embedding").join(granted.select("query_id", by).distinct(), "query_id")
    q = _blocks(asked, "query_id", groups if granted is not None else []).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    arrow = [to_arrow_type(entries.schema[g].dataType) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}  # of each block of queries (and group): (number of the query, id, score) of the best so far, and each query's least score that counts

        def given() -> Iterator[pa.RecordBatch]:
            for (q_ids, *group), (number, entry, score, _) in held.items():
                rows = [pa.array(np.frombuffer(q_ids, np.int64)[number]), *[pa.array([g] * len(number), a) for g, a in zip(group, arrow, strict=True)], pa.array(entry), pa.array(score)]
                yield pa.RecordBatch.from_arrays(rows, ["query_id", *groups, "entry_id", "score"])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c: batch.column(batch.schema.get_field_index(c))[r].as_py()  # noqa: B023, E731
                key = (cell("q_ids"), *(cell(g) for g in groups))
                ids, q_ids = np.frombuffer(cell("ids"), np.int64), np.frombuffer(key[0], np.int64)
                v = np.frombuffer(cell("vectors")).reshape(len(ids), -1)
                w = np.frombuffer(cell("q_vectors")).reshape(len(q_ids), -1)
                if v.shape[1] != w.shape[1]:
                    continue
                if key not in held and len(held) >= MOST_HELD:
                    yield from given()
                held[key] = _best_of(w @ v.T, ids, k, held.get(key))
        yield from given()

    kinds = "".join(f"{g} {entries.schema[g].dataType.simpleString()}, " for g in groups)
    if granted is None:
        pairs = e.crossJoin(q)
    else:
        width = lambda ids, vectors: (F.octet_length(vectors) / F.octet_length(ids)).cast("int").alias("_width")
        pairs = e.select("*", width("ids", "vectors")).join(q.select("*", width("q_ids", "q_vectors")), [by, "_width"])
    found = pairs.select(*groups, "ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, f"query_id long, {kinds}entry_id long, score double")
    return top(found, ["query_id", *groups], [F.desc(F.round("score", 9)), "entry_id"], k)


def query_terms(queries: DataFrame, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(query_id, term, n_terms): the distinct terms of each query. queries: query_id, query."""
    once = queries.select("query_id", F.array_distinct(split(F.col("query"))).alias("terms"))
    return once.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def positions(entries: DataFrame, text_col: str, keep: list[str], split: Callable[[Column], Column] = tokens, only: list[str] | None = None) -> DataFrame:
    """(keep..., term, tf, positions) of every entry and term of its indexed text; `only` some terms, where few are asked for."""
    each = entries.select(*keep, F.posexplode(split(F.col(text_col))).alias("pos", "term"))
    if only is not None:
        each = each.where(F.col("term").isin(only))
    return each.groupBy(*keep, "term").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select(*keep, "term", F.size("positions").alias("tf"), "positions")


#: Distinct query terms up to which they go into the plan as a list, so that others are dropped before they are shuffled or read.
MOST_TERMS = 1000


def few_terms(wanted: DataFrame) -> list[str] | None:
    """The distinct terms asked for, if they are at most MOST_TERMS."""
    got = [r["term"] for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    return got if len(got) <= MOST_TERMS else None


def cover_density(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score) of entries that hold every term of a query: the sum of 0.1 / (1 + noise) over the minimal covers of all terms, where noise is the cover's length
    less the matched tokens in it. hits: keys, term, tf, positions, n_terms.

    A one-term query needs only counts. Of the others an entry's positions are gathered in its own row and passed once, in order: the last place of each term is kept, and where the
    earliest of these moves on, a minimal cover ends.
    """
    one = hits.where("n_terms = 1").select(*keys, (F.col("tf") * F.lit(0.1)).alias("score"))
    many = hits.where("n_terms > 1")
    whole = many.groupBy(*keys, "n_terms").agg(F.collect_list(F.struct("term", "positions")).alias("terms")).where(F.size("terms") == F.col("n_terms"))
    places = F.array_sort(F.flatten(F.transform("terms", lambda t, i: F.transform(t["positions"], lambda p: F.struct(p.alias("pos"), i.alias("term"))))))
    unseen = F.array_repeat(F.lit(-1), F.col("n_terms"))
    begin = F.struct(unseen.alias("last"), unseen.alias("turn"), F.lit(-1).alias("start"), F.lit(0).alias("n"), F.lit(0.0).alias("score"))

    def seen(acc: Column, x: Column) -> Column:
        """The state with the last place of x's term, and the number of that place among all, moved on."""
        put = lambda values, new: F.transform(values, lambda v, i: F.when(i == x["term"], new).otherwise(v))
        return F.struct(put(acc["last"], x["pos"]).alias("last"), put(acc["turn"], acc["n"]).alias("turn"), acc["start"].alias("start"), (acc["n"] + 1).alias("n"), acc["score"].alias("score"))

    def covered(acc: Column, x: Column) -> Column:
        """The state with the cover that ends here, if it is a new one."""
        start = F.array_min(acc["last"])
        noise = (x["pos"] - start) - (acc["n"] - 1 - F.array_min(acc["turn"]))
        new = (start >= 0) & (start != acc["start"])
        return F.struct(acc["last"].alias("last"), acc["turn"].alias("turn"), F.when(new, start).otherwise(acc["start"]).alias("start"), acc["n"].alias("n"), (acc["score"] + F.when(new, 0.1 / (1 + noise)).otherwise(0.0)).alias("score"))

    once = lambda acc, x: F.get(F.transform(F.array(seen(acc, x)), lambda now: covered(now, x)), F.lit(0))  # noqa: E731  the new state is computed once
    return one.unionByName(whole.select(*keys, F.aggregate(places, begin, once)["score"].alias("score")))


def keyword_top(entries: DataFrame, queries: DataFrame, k: int = KEYWORD_K, text_col: str = "text", by: str | None = None, split: Callable[[Column], Column] = tokens, granted: DataFrame | None = None) -> DataFrame:
    """Each query's best entries by cover density: query_id, [by], entry_id, score, rank; of the granted groups (query_id, by) alone, if given. Texts are read and split anew; a stored index (index.Postings) spares that."""
    groups = [by] if by else []
    order = [F.desc(F.round("score", 9)), "entry_id"]
    named = named_sets(queries, split)
    sets = few_sets(named)
    if sets is not None:
        found = of_queries(top(best_of_texts(entries, sets, k, text_col, groups, split), ["_set", *groups], order, k), named, groups)
        return found if granted is None else found.join(granted.select("query_id", by).distinct(), ["query_id", by], "left_semi")
    wanted = query_terms(queries, split)
    hits = positions(entries, text_col, ["entry_id", *groups], split, few_terms(wanted)).join(wanted, "term")
    if granted is not None:
        hits = hits.join(granted.select("query_id", by).distinct(), ["query_id", by], "left_semi")
    return top(cover_density(hits, ["query_id", *groups, "entry_id"]), ["query_id", *groups], order, k)


def fuse(vector: DataFrame, keyword: DataFrame, rrf_k: int = RRF_K, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion: keys, entry_id, score, vector_score, keyword_score; a branch without the entry adds nothing."""
    on = [*keys, "entry_id"]
    v = vector.select(*on, F.col("score").alias("vector_score"), F.col("rank").alias("vr"))
    w = keyword.select(*on, F.col("score").alias("keyword_score"), F.col("rank").alias("kr"))
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    return v.join(w, on, "full_outer").select(*on, (part("vr") + part("kr")).alias("score"), "vector_score", "keyword_score")


def group_by_parent(hits: DataFrame, parents: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One result for each parent: its best hit's id and score, and all matched children by score.

    parents: entry_id, parent_id.
    """
    named = hits.join(parents, "entry_id")
    child = F.struct((-F.col("score")).alias("s"), F.col("entry_id"))
    out = named.groupBy(*keys, "parent_id").agg(F.array_sort(F.collect_list(child)).alias("c"))
    return out.select(*keys, "parent_id", F.element_at("c", 1)["entry_id"].alias("entry_id"), (-F.element_at("c", 1)["s"]).alias("score"), F.transform("c", lambda x: x["entry_id"]).alias("matched"))


def hybrid(entries: DataFrame, queries: DataFrame, vector_k: int = VECTOR_K, keyword_k: int = KEYWORD_K, final_k: int = FINAL_K, rrf_k: int = RRF_K, by: str | None = None, postings=None, vectors=None, granted: DataFrame | None = None) -> DataFrame:
    """Hybrid search of a batch: query_id, [by], parent_id, entry_id, score, matched, rank. postings, vectors: stored indexes of the entries' texts and vectors, if there are any.

    entries: entry_id, parent_id, text, embedding, [by]; queries: query_id, query, embedding.
    With `by`, candidates and fusion are per group and the merge is over all (ties: the smaller group, then entry); granted (query_id, by) names the groups that each query may read.
    """
    if granted is not None and not by:
        raise ValueError("grants are for groups")
    only = lambda df: df if granted is None else df.join(granted.select("query_id", by).distinct(), ["query_id", by], "left_semi")
    vector_k, keyword_k, final_k, rrf_k = check_options(vector_k, keyword_k, final_k, rrf_k)
    keys = ("query_id", by) if by else ("query_id",)
    v = only(vectors.search(queries, vector_k, by)) if vectors is not None else vector_top_batch(entries, queries, vector_k, by, granted)
    w = only(postings.search(queries, keyword_k, by)) if postings is not None else keyword_top(entries, queries, keyword_k, by=by, granted=granted)
    grouped = group_by_parent(fuse(v, w, rrf_k, keys), entries.select("entry_id", "parent_id"), keys)
    return top(grouped, ["query_id"], [F.desc(F.round("score", 12)), *([by] if by else []), "entry_id"], final_k)


def rerank_text(matched_texts: Column, max_chars: int) -> Column:
    """Matched texts, each once, in order, cut to a number of characters."""
    return F.substring(F.array_join(F.array_distinct(matched_texts), "\n"), 1, max_chars)


#: Classes of reranker errors after which the fusion order may stand in.
RECOVERABLE = ("rerank_unavailable", "rerank_rate_limited", "request_timeout", "endpoint_unreachable", "provider_rejected", "invalid_rerank_response")


def rerank(results: DataFrame, scorer: Callable[[Column], Column], candidate_k: int, final_k: int, failure_mode: str = "fallback") -> DataFrame:
    """The best candidate_k results (by rank) in the order of a scorer of their rerank_text; a missing score is 0.

    Adds candidate_id (opaque, by rank), rerank_score, stage and final_rank; ties keep fusion score, then position. A query fails if its rows name an error class (column
    rerank_error, where there is one), or if no candidate of it has a score (`invalid_rerank_response`). With failure_mode `fallback` an error of RECOVERABLE leaves its
    fusion order (stage `rrf_fallback`); any other, or with failure_mode `error`, ends the job.
    """
    if not RERANK_RANGE[0] <= candidate_k <= RERANK_RANGE[1]:
        raise ValueError(f"candidate_k must be {RERANK_RANGE[0]} to {RERANK_RANGE[1]}")
    if failure_mode not in ("fallback", "error"):
        raise ValueError("failure_mode must be fallback or error")
    named = results if "rerank_error" in results.columns else results.withColumn("rerank_error", F.lit(None).cast("string"))
    got = named.where(F.col("rank") <= candidate_k).withColumn("candidate_id", F.format_string("candidate-%06d", F.col("rank"))).withColumn("given", scorer(F.col("rerank_text")))
    query = Window.partitionBy("query_id")
    error = F.coalesce(F.max("rerank_error").over(query), F.when(F.count("given").over(query) == 0, "invalid_rerank_response"))
    failed = got.withColumn("error", error)
    soft = F.col("error").isin(*RECOVERABLE) & F.lit(failure_mode == "fallback")
    stage = F.when(F.col("error").isNull(), "rerank").when(soft, "rrf_fallback").otherwise(F.raise_error(F.concat(F.lit("rerank failed: "), F.col("error"))).cast("string"))
    scored = failed.withColumn("stage", stage).withColumn("rerank_score", F.when(F.col("stage") == "rerank", F.coalesce("given", F.lit(0.0))).otherwise(0.0))
    order = query.orderBy(F.desc("rerank_score"), F.desc(F.round("score", 12)), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= final_k).drop("given", "error", "rerank_error")


def check_rerank(response: DataFrame, n_candidates: int) -> DataFrame:
    """Rows of a reranker's response (index, score) that break its contract: index twice or out of range, score not finite."""
    twice = F.count("*").over(Window.partitionBy("index")) > 1
    odd = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    return response.withColumn("twice", twice).where(F.col("twice") | odd | (F.col("index") < 0) | (F.col("index") >= n_candidates)).drop("twice")


def active_content(chunks: DataFrame, revisions: DataFrame) -> DataFrame:
    """Chunks with the content of their active revision; a chunk whose active revision is absent has none. chunks: active_revision_id; revisions: chunk_id, revision_id, content."""
    own = revisions.select("chunk_id", F.col("revision_id").alias("active_revision_id"), F.col("content").alias("_content"))
    return chunks.drop("content").join(own, ["chunk_id", "active_revision_id"], "left").withColumnRenamed("_content", "content")


def missing_evidence(hits: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Hits for which `evidence` found nothing (a deleted document, a chunk that is gone); empty where the index is sound. A caller that must not lose any checks this."""
    return hits.join(found.select(*keys), keys, "left_anti")


def evidence(hits: DataFrame, entries: DataFrame, chunks: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with their texts: the parent's where there is one, else the child's; title by the file node's current name.

    entries: entry_id, chunk_id, document_id; chunks: chunk_id, parent_chunk_id, content (of the active revision, see active_content); documents: document_id,
    title, deleted_at; nodes: document_id, name. Deleted documents give no evidence (see missing_evidence).
    """
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content"))
    child = chunks.select("chunk_id", "parent_chunk_id", "content")
    live = documents.where("deleted_at is null").select("document_id", "title")
    out = hits.join(entries.select("entry_id", "chunk_id", "document_id"), "entry_id").join(child, "chunk_id").join(parent, "parent_chunk_id", "left").join(live, "document_id").join(nodes.select("document_id", "name"), "document_id", "left")
    return out.select(*hits.columns, "document_id", F.coalesce("name", "title").alias("title"), F.coalesce("parent_chunk_id", "chunk_id").alias("chunk_id"), F.coalesce("parent_content", "content").alias("content"), F.col("content").alias("search_content"))


def counters(vector: DataFrame, keyword: DataFrame, fused: DataFrame, grouped: DataFrame, result: DataFrame) -> DataFrame:
    """Candidate counts of each query's stages."""
    parts = None
    for name, df in (("vector", vector), ("keyword", keyword), ("fused", fused), ("grouped", grouped), ("result", result)):
        n = df.groupBy("query_id").count().select("query_id", F.lit(name).alias("stage"), F.col("count").alias("n"))
        parts = n if parts is None else parts.unionByName(n)
    return parts.groupBy("query_id").pivot("stage", ["vector", "keyword", "fused", "grouped", "result"]).agg(F.coalesce(F.sum("n"), F.lit(0)))
