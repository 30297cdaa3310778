"""Who may see what: tenant scope, access to knowledge bases, visibility, and which generation a search reads."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.operators.retrieval import MAX_BASES, MULTI_FINAL_K, check_options

#: What a search must find unchanged between the embedding of its query and the reading of candidates.
SNAPSHOT = ["model_id", "provider", "model_name", "dimension", "config_hash"]


def scoped(df: DataFrame, workspace: int | str) -> DataFrame:
    """The rows of one workspace. Every read of a tenant's table starts here, so the predicate reaches the scan."""
    return df.where(F.col("workspace_id") == F.lit(workspace))


def allowed(bases: DataFrame, grants: DataFrame) -> DataFrame:
    """(key_id, kb_id): the live knowledge bases that each key may read, in its own workspace.

    bases: workspace_id, kb_id, deleted_at; grants: key_id, workspace_id, unrestricted, kb_ids (array).
    """
    live = bases.where("deleted_at is null").select("workspace_id", "kb_id")
    every = grants.where("unrestricted").select("key_id", "workspace_id").join(live, "workspace_id").select("key_id", "kb_id")
    named = grants.where("not unrestricted").select("key_id", "workspace_id", F.explode("kb_ids").alias("kb_id")).distinct()
    return every.unionByName(named.join(live, ["workspace_id", "kb_id"], "left_semi").select("key_id", "kb_id"))


#: Bases up to which the lists of their workspaces are broadcast.
MOST_BASES = 2_000_000


def allowed_lists(bases: DataFrame, grants: DataFrame) -> DataFrame:
    """(key_id, allowed): as `allowed`, one row a key with the sorted array of its bases; keys without any are left out. grants: one row a key.

    An unrestricted key takes the list of its workspace, so that keys and bases are never paired.
    """
    live = bases.where("deleted_at is null").select("workspace_id", "kb_id")
    lists = live.groupBy("workspace_id").agg(F.array_sort(F.collect_list("kb_id")).alias("allowed"))
    lists = F.broadcast(lists) if bases.count() <= MOST_BASES else lists
    # dealt out by key: what is made of the long lists is then spread over tasks
    parts = max(int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    every = grants.where("unrestricted").select("key_id", "workspace_id").repartition(parts, "key_id").join(lists, "workspace_id").select("key_id", "allowed")
    named = grants.where("not unrestricted").select("key_id", "workspace_id", F.explode(F.array_distinct("kb_ids")).alias("kb_id"))
    some = named.join(live, ["workspace_id", "kb_id"], "left_semi").groupBy("key_id").agg(F.array_sort(F.collect_list("kb_id")).alias("allowed"))
    return every.unionByName(some)


def requested(requests: DataFrame, access: DataFrame | None = None) -> DataFrame:
    """(request_id, kb_id, position, status) of each request's distinct knowledge bases, in the order of their first mention.

    requests: request_id, key_id, kb_ids (array), and allowed (array, as `allowed_lists` has it) where no access is given; access: key_id, kb_id. Access is all or nothing: status is `ok`, or for all bases of the request
    `not_found` if one of them may not be read (which tells nothing of its existence), `invalid` if there are none or more than MAX_BASES.
    """
    if access is not None:
        requests = requests.join(access.groupBy("key_id").agg(F.collect_set("kb_id").alias("allowed")), "key_id", "left")
    once = requests.select("request_id", F.array_distinct(F.filter("kb_ids", lambda k: k.isNotNull())).alias("ids"), F.coalesce("allowed", F.array()).alias("allowed"))
    n = F.coalesce(F.size("ids"), F.lit(-1))
    bad = F.size(F.array_except("ids", "allowed")) > 0
    # a request's status is told within its row, so its bases aren't shuffled
    status = F.when((n < 1) | (n > MAX_BASES), "invalid").when(bad, "not_found").otherwise("ok")
    return once.select("request_id", "ids", status.alias("status")).select("request_id", F.posexplode_outer("ids").alias("position", "kb_id"), "status").select("request_id", "kb_id", "position", "status")


def visible(df: DataFrame, workspace: Column) -> DataFrame:
    """Rows of the platform, and those of the workspace itself."""
    return df.where((F.col("scope") == "platform") | ((F.col("scope") == "workspace") & (F.col("workspace_id") == workspace)))


def active_generations(bases: DataFrame, generations: DataFrame) -> DataFrame:
    """The generations that live knowledge bases point to, by the whole key: a pointer into another workspace or base finds nothing."""
    pointer = bases.where("deleted_at is null and active_generation_id is not null").select("workspace_id", "kb_id", F.col("active_generation_id").alias("generation_id"))
    return generations.join(pointer, ["workspace_id", "kb_id", "generation_id"], "left_semi")


def searchable(entries: DataFrame, bases: DataFrame, generations: DataFrame) -> DataFrame:
    """Published entries of active generations whose vectors have the generation's dimension."""
    g = active_generations(bases, generations).select("workspace_id", "kb_id", "generation_id", "dimension")
    return entries.where("state = 'published'").join(g, ["workspace_id", "kb_id", "generation_id"]).where(F.size("embedding") == F.col("dimension")).drop("dimension")


def snapshot_changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(kb_id, reason) of the bases whose search can't go on: `stale` if the active generation is another one, `snapshot` if it is the same with other settings.

    before and now: kb_id, generation_id and SNAPSHOT, one row a base.
    """
    other = now.select("kb_id", F.col("generation_id").alias("_g"), *(F.col(c).alias(f"_{c}") for c in SNAPSHOT))
    differs = F.lit(False)
    for c in SNAPSHOT:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    reason = F.when(~F.col("generation_id").eqNullSafe(F.col("_g")), "stale").when(differs, "snapshot")
    return before.join(other, "kb_id", "left").select("kb_id", reason.alias("reason")).where("reason is not null")


@dataclass(frozen=True)
class SearchOptions:
    """A generation's search settings; a call may override each of them."""

    fts_config: str = "simple"
    vector_k: int = 30
    keyword_k: int = 30
    final_k: int = 10
    rrf_k: int = 60

    def override(self, many: bool = False, **given) -> SearchOptions:
        """These settings with those given (None: not given), within their bounds. `many`: a search over several bases, with its own final size."""
        unknown = set(given) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        value = {f.name: getattr(self, f.name) for f in fields(self)}
        if many:
            value["final_k"] = MULTI_FINAL_K
        value.update({k: v for k, v in given.items() if v is not None})
        if value["fts_config"] not in ("simple", "cjk"):
            raise ValueError(f"unknown text configuration {value['fts_config']}")
        vector_k, keyword_k, final_k, rrf_k = check_options(value["vector_k"], value["keyword_k"], value["final_k"], value["rrf_k"])
        return SearchOptions(value["fts_config"], vector_k, keyword_k, final_k, rrf_k)


def effective_options(generations: DataFrame, overrides: DataFrame) -> DataFrame:
    """(request_id, generation_id, vector_k, keyword_k, final_k, rrf_k) of each request, as columns: the override, else the generation's; final_k is cut to its bound.

    generations: generation_id and the four; overrides: request_id, generation_id and the four, where null is not given.
    """
    names = ["vector_k", "keyword_k", "final_k", "rrf_k"]
    own = generations.select("generation_id", *(F.col(c).alias(f"_{c}") for c in names))
    best = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in names}
    best["final_k"] = F.least(best["final_k"], F.lit(50))
    return overrides.join(own, "generation_id").select("request_id", "generation_id", *(v.alias(k) for k, v in best.items()))


#: Fields of one search result, in order.
RESULT_FIELDS = ["chunk_id", "chunk_revision_id", "document_id", "document_kind", "content", "document_name", "source_anchor", "score", "vector_score", "keyword_score", "rerank_score", "ranking_stage", "metadata", "matched_children", "knowledge_base_id", "knowledge_base_name"]


def result_rows(results: DataFrame) -> DataFrame:
    """Results with all RESULT_FIELDS, in order; those that a stage doesn't give are null."""
    return results.select(*[c for c in results.columns if c not in RESULT_FIELDS], *(F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in RESULT_FIELDS))
