"""Search requests end to end: who may read what, which entries count, hybrid search over many bases, one rerank over all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.operators import retrieval as R
from heronlake.operators.access import allowed, requested, searchable


def search_requests(
    requests: DataFrame, grants: DataFrame, bases: DataFrame, generations: DataFrame, entries: DataFrame, final_k: int = R.MULTI_FINAL_K,
    scorer: Callable[[Column], Column] | None = None, candidate_k: int = 50, max_chars: int = 2000, failure_mode: str = "fallback", **options,
) -> tuple[DataFrame, DataFrame]:
    """(results, statuses) of a batch of requests.

    statuses: request_id, status, as in access.requested: only `ok` requests are searched, the others give no result. A request reads its own bases (those it names and its key may
    read, in the key's workspace), of these the published entries of the active generation, and of these the vectors of the generation's dimension. Vectors meet by base and
    dimension, so a request is never held against a base it may not read. results: query_id (the request), kb_id, parent_id, entry_id, score, matched, rank; with a scorer,
    the best candidate_k of each request over all its bases are put in the order of one rerank (columns of retrieval.rerank).

    requests: request_id, key_id, kb_ids, query, embedding; grants: key_id, workspace_id, unrestricted, kb_ids; bases: workspace_id, kb_id, active_generation_id, deleted_at; generations: workspace_id, kb_id,
    generation_id, dimension; entries: workspace_id, kb_id, generation_id, state, entry_id, parent_id, text, embedding. options: vector_k, keyword_k, rrf_k.
    """
    asked = requested(requests.select("request_id", "key_id", "kb_ids"), allowed(bases, grants))
    statuses = asked.select("request_id", "status").distinct()
    pairs = asked.where("status = 'ok'").select(F.col("request_id").alias("query_id"), "kb_id")
    live = searchable(entries, bases, generations).join(pairs.select("kb_id").distinct(), "kb_id", "left_semi")
    queries = requests.select(F.col("request_id").alias("query_id"), "query", "embedding").join(pairs.select("query_id").distinct(), "query_id", "left_semi")
    found = R.hybrid(live, queries, final_k=candidate_k if scorer else final_k, by="kb_id", granted=pairs, **options)
    if scorer is None:
        return found, statuses
    hit = found.select("query_id", "kb_id", "parent_id", F.posexplode("matched").alias("_place", "_entry"))
    texts = hit.join(live.select(F.col("entry_id").alias("_entry"), "text"), "_entry").groupBy("query_id", "kb_id", "parent_id").agg(F.array_sort(F.collect_list(F.struct("_place", "text"))).alias("_texts"))
    named = found.join(texts, ["query_id", "kb_id", "parent_id"]).withColumn("rerank_text", R.rerank_text(F.transform("_texts", lambda t: t["text"]), max_chars)).drop("_texts")
    return R.rerank(named, scorer, candidate_k, final_k, failure_mode), statuses
