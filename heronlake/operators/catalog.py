"""Listings of knowledge bases, models, jobs and documents: joins of small dimension tables to what they describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import display_name
from heronlake.operators.access import visible

RECENT_JOBS, TOP_BLOCKERS = 5, 20


def optional(df: DataFrame, **equals) -> DataFrame:
    """Rows that meet the filters given; None means that a filter is not set."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def named_like(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in one of the columns, in any case; `%` and `_` in it stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.where(hit)


def config_text(config: Column, key: str, kind: str = "string") -> Column:
    """A key of a JSON object column as text, cast; null if it is absent or no such value."""
    return F.get_json_object(config, f"$.{key}").try_cast(kind)


def base_details(bases: DataFrame, generations: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """Each live base with its active generation, that one's model and its provider, as far as there are any.

    bases: workspace_id, kb_id, name, active_generation_id, deleted_at; generations: workspace_id, kb_id, generation_id, model_id, status;
    models: model_id, provider_id, model_name; providers: provider_id, provider_name.
    """
    g = generations.select("workspace_id", "kb_id", F.col("generation_id").alias("active_generation_id"), "model_id", F.col("status").alias("generation_status"))
    live = bases.where("deleted_at is null").drop("deleted_at")
    return live.join(g, ["workspace_id", "kb_id", "active_generation_id"], "left").join(models.select("model_id", "provider_id", "model_name"), "model_id", "left").join(providers.select("provider_id", "provider_name"), "provider_id", "left")


def model_list(models: DataFrame, providers: DataFrame, workspace: Column) -> DataFrame:
    """Models that a workspace sees, with their providers; a provider it doesn't see hides its models."""
    p = visible(providers, workspace).select("provider_id", "provider_name", F.col("status").alias("provider_status"))
    return visible(models, workspace).join(p, "provider_id")


def selectable(models: DataFrame, providers: DataFrame, workspace: Column, kind: str) -> DataFrame:
    """Models of a kind that can be chosen: active, with an active provider."""
    return model_list(models.where((F.col("status") == "active") & (F.col("model_type") == kind)), providers, workspace).where("provider_status = 'active'")


def reusable_revisions(requests: DataFrame, documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """(request_id, revision_id): for each request the newest ready, active revision of a live document of its base with the same content.

    requests: request_id, kb_id, content_hash; documents: kb_id, document_id, active_revision_id, deleted_at;
    revisions: revision_id, document_id, content_hash, status, created_at.
    """
    live = documents.where("deleted_at is null").select("kb_id", "document_id", F.col("active_revision_id").alias("revision_id"))
    ready = revisions.where("status = 'ready'").select("revision_id", "document_id", "content_hash", "created_at")
    newest = F.max(F.struct("created_at", "revision_id")).alias("_newest")
    # one candidate for each content of a base: requests must not meet all of its revisions
    each = live.join(ready, ["document_id", "revision_id"]).groupBy("kb_id", "content_hash").agg(newest)
    found = requests.join(each, ["kb_id", "content_hash"]).groupBy("request_id").agg(F.max("_newest").alias("_newest"))
    return found.select("request_id", F.col("_newest")["revision_id"].alias("revision_id"))


def published_as(tasks: DataFrame, documents: DataFrame, bases: DataFrame) -> DataFrame:
    """(task_id, published): whether the task's revision and generation are both the active ones.

    tasks: task_id, kb_id, document_id, revision_id, generation_id.
    """
    d = documents.where("deleted_at is null").select("kb_id", "document_id", F.col("active_revision_id").alias("revision_id"), F.lit(True).alias("_d"))
    b = bases.where("deleted_at is null").select("kb_id", F.col("active_generation_id").alias("generation_id"), F.lit(True).alias("_b"))
    out = tasks.join(d, ["kb_id", "document_id", "revision_id"], "left").join(b, ["kb_id", "generation_id"], "left")
    return out.select("task_id", (F.col("_d").isNotNull() & F.col("_b").isNotNull()).alias("published"))


def lineage(documents: DataFrame, bases: DataFrame, generations: DataFrame) -> DataFrame:
    """(kb_id, document_id, revision_id, generation_id, chunking): live documents with the active generation of their base."""
    b = bases.where("deleted_at is null").select("workspace_id", "kb_id", F.col("active_generation_id").alias("generation_id"))
    g = generations.select("workspace_id", "kb_id", "generation_id", "chunking")
    d = documents.where("deleted_at is null").select("workspace_id", "kb_id", "document_id", F.col("active_revision_id").alias("revision_id"))
    return d.join(b, ["workspace_id", "kb_id"]).join(g, ["workspace_id", "kb_id", "generation_id"]).select("kb_id", "document_id", "revision_id", "generation_id", "chunking")


def with_editors(revisions: DataFrame, users: DataFrame) -> DataFrame:
    """Chunk revisions with the nickname of who wrote them; system revisions and lost users have none."""
    return revisions.join(users.select(F.col("user_id").alias("created_by"), F.col("nickname").alias("editor")), "created_by", "left")


def job_list(jobs: DataFrame, documents: DataFrame, nodes: DataFrame, generations: DataFrame, models: DataFrame) -> DataFrame:
    """Jobs with what they work on: target_type, target_name (node, else document, else model name, else `-`).

    jobs: job_id, kb_id, document_id, generation_id, status, created_at; documents: document_id, title; nodes: document_id, name;
    generations: generation_id, model_id; models: model_id, model_name.
    """
    out = jobs.join(documents.select("document_id", "title"), "document_id", "left").join(nodes.select("document_id", F.col("name").alias("_node")), "document_id", "left")
    out = out.join(generations.select("generation_id", "model_id"), "generation_id", "left").join(models.select("model_id", "model_name"), "model_id", "left")
    kind = F.when(F.col("document_id").isNotNull(), "document").when(F.col("generation_id").isNotNull(), "generation").otherwise("knowledge_base")
    return out.select(*jobs.columns, kind.alias("target_type"), display_name(F.col("_node"), F.col("title"), F.col("model_name")).alias("target_name"))


def recent_jobs(jobs: DataFrame) -> DataFrame:
    """The latest RECENT_JOBS jobs of each base."""
    from heronlake.operators.retrieval import top

    return top(jobs, ["kb_id"], [F.desc("created_at"), F.desc("job_id")], RECENT_JOBS)


def blockers(documents: DataFrame, nodes: DataFrame, revisions: DataFrame) -> DataFrame:
    """Of each base at most TOP_BLOCKERS live documents whose latest revision failed: kb_id, document_id, name, error, rank; the latest failures first.

    revisions: document_id, revision_no, status, error, finished_at.
    """
    from heronlake.operators.retrieval import top

    last = revisions.groupBy("document_id").agg(F.max_by(F.struct("status", "error", "finished_at"), "revision_no").alias("r")).where("r.status = 'failed'")
    bad = documents.where("deleted_at is null").join(last, "document_id").join(nodes.select("document_id", F.col("name").alias("_node")), "document_id", "left")
    rows = bad.select("kb_id", "document_id", display_name(F.col("_node"), F.col("title")).alias("name"), F.col("r.error").alias("error"), F.col("r.finished_at").alias("finished_at"))
    return top(rows, ["kb_id"], [F.desc_nulls_last("finished_at"), F.asc("document_id")], TOP_BLOCKERS)


def readiness(workspaces: DataFrame, bases: DataFrame, models: DataFrame, providers: DataFrame) -> DataFrame:
    """(workspace_id, has_provider, has_embedding_model, n_searchable, next_step) for each workspace.

    providers and models: workspace_id (null on the platform), scope, status; models: provider_id, model_type; bases: active_generation_id, deleted_at.
    """
    p = providers.where("status = 'active'").select("provider_id", F.col("scope").alias("p_scope"), F.col("workspace_id").alias("p_ws"))
    m = models.where("status = 'active' and model_type = 'embedding'").select("provider_id", "scope", F.col("workspace_id").alias("m_ws"))
    usable = m.join(p, "provider_id")
    anyone = lambda df, scopes: df.where(" and ".join(f"{s} = 'platform'" for s in scopes)).agg((F.count("*") > 0).alias("all")).first()["all"]
    shared_p, shared_m = anyone(p, ["p_scope"]), anyone(usable, ["p_scope", "scope"])
    own_p = p.where("p_scope = 'workspace'").select(F.col("p_ws").alias("workspace_id")).distinct().withColumn("_p", F.lit(True))
    fits = usable.where("(p_scope = 'platform' or p_ws = coalesce(m_ws, p_ws)) and not (p_scope = 'platform' and scope = 'platform')")
    own_m = fits.select(F.coalesce("m_ws", "p_ws").alias("workspace_id")).distinct().withColumn("_m", F.lit(True))
    n = bases.where("deleted_at is null and active_generation_id is not null").groupBy("workspace_id").agg(F.count("*").alias("n_searchable"))
    out = workspaces.select("workspace_id").join(own_p, "workspace_id", "left").join(own_m, "workspace_id", "left").join(n, "workspace_id", "left")
    has_p, has_m, many = F.coalesce("_p", F.lit(shared_p)), F.coalesce("_m", F.lit(shared_m)), F.coalesce("n_searchable", F.lit(0))
    step = F.when(~has_p, "add_provider").when(~has_m, "add_embedding_model").when(many == 0, "create_knowledge_base").otherwise("search")
    return out.select("workspace_id", has_p.alias("has_provider"), has_m.alias("has_embedding_model"), many.alias("n_searchable"), step.alias("next_step"))


def reference_counts(key: str, *parts: DataFrame) -> DataFrame:
    """(key, n): how many rows of all parts together name each key."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.unionByName(p.select(key))
    return every.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def guards(generations: DataFrame, keys: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """(rule, key, n): building generations of each base, live keys of each workspace, running jobs of each connection."""
    live = keys.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    parts = [("building", generations.where("status = 'building'"), "kb_id"), ("live_keys", live, "workspace_id"), ("active_jobs", jobs.where("status in ('pending', 'running')"), "connection_id")]
    out = None
    for rule, df, key in parts:
        one = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out
