"""Incremental source synchronisation: snapshot diff, safe watermark, admission, idempotent ingest, retention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def needs_update(force: bool, retry: Column, edited: Column, cursor: Column) -> Column:
    return F.lit(force) | F.coalesce(retry, F.lit(False)) | edited.isNull() | (edited > cursor)


def sync_diff(remote: DataFrame, local: DataFrame, cursor: Column, complete: bool = True, force: bool = False) -> DataFrame:
    """(token, action) with action add, update, skip or remove.

    remote: token, has_document, edit_time, ordinal; local: external_id, retry_required, deleted_at, ordinal. The first row of a token
    counts, on both sides; local tokens that repeat are never removed; nothing is removed on an incomplete listing.
    """
    there = first_by(remote.where(F.col("has_document") & (F.coalesce("token", F.lit("")) != "")), "token", "ordinal").select("token", "edit_time", F.lit(True).alias("r"))
    known = local.where(F.coalesce("external_id", F.lit("")) != "")
    times = F.count("*").over(Window.partitionBy("external_id"))
    here = first_by(known.withColumn("times", times), "external_id", "ordinal").select(F.col("external_id").alias("token"), "retry_required", "deleted_at", "times", F.lit(True).alias("l"))
    both = there.join(here, "token", "full_outer")
    removable = F.lit(complete) & (F.col("times") == 1) & F.col("deleted_at").isNull()
    action = (
        F.when(F.col("l").isNull(), "add")
        .when(F.col("r").isNull(), F.when(removable, "remove"))
        .when(needs_update(force, F.col("retry_required"), F.col("edit_time"), cursor), "update")
        .otherwise("skip")
    )
    return both.select("token", action.alias("action")).where("action is not null")


def duplicate_warnings(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(side, token, n): tokens that repeat on a side."""
    r = remote.where(F.col("has_document") & (F.coalesce("token", F.lit("")) != "")).groupBy("token").count().where("count > 1").select(F.lit("remote").alias("side"), "token", F.col("count").alias("n"))
    x = local.where(F.coalesce("external_id", F.lit("")) != "").groupBy("external_id").count().where("count > 1")
    return r.unionByName(x.select(F.lit("local").alias("side"), F.col("external_id").alias("token"), F.col("count").alias("n")))


def safe_watermark(remote: DataFrame, outcomes: DataFrame, previous: Column, complete: bool = True) -> DataFrame:
    """(watermark): the latest edit time up to which every node succeeded, never before the previous one.

    remote: token, edit_time; outcomes: token, success. A node without an outcome counts as failed; unknown times don't count. Success is a
    property of times, so the answer is one comparison: the latest time before the first that failed.
    """
    if not complete:
        return remote.sparkSession.range(1).select(previous.alias("watermark"))
    known = remote.where("edit_time is not null").join(outcomes.groupBy("token").agg(F.min("success").alias("success")), "token", "left")
    times = known.groupBy("edit_time").agg(F.min(F.coalesce("success", F.lit(False))).alias("good"))
    bound = times.agg(F.min(F.when(~F.col("good"), F.col("edit_time"))).alias("bad"))
    best = times.crossJoin(F.broadcast(bound)).where("bad is null or edit_time < bad").agg(F.max("edit_time").alias("t"))  # one row
    return best.select(F.greatest("t", previous).alias("watermark"))


def safe_watermarks(nodes: DataFrame, outcomes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(root, watermark) of each listed root, as safe_watermark for one: the latest edit time before the first document that failed, never before the previous one; unchanged where the listing is incomplete.

    nodes: root, token, has_document, edit_time; outcomes: root, token, success; snapshots: root, previous, complete, one row for each of a few roots.
    Nodes without a document or a token don't count; a document without an outcome has failed.
    """
    documents = nodes.where(F.col("has_document") & (F.coalesce("token", F.lit("")) != "") & F.col("edit_time").isNotNull())
    known = documents.join(outcomes.groupBy("root", "token").agg(F.min(F.coalesce("success", F.lit(False))).alias("success")), ["root", "token"], "left")
    times = known.groupBy("root", "edit_time").agg(F.min(F.coalesce("success", F.lit(False))).alias("good"))
    bad = times.where("not good").groupBy("root").agg(F.min("edit_time").alias("bad"))
    best = times.join(F.broadcast(bad), "root", "left").where("bad is null or edit_time < bad").groupBy("root").agg(F.max("edit_time").alias("best"))  # a row a root
    moved = F.when(F.col("complete"), F.greatest("best", "previous")).otherwise(F.col("previous"))
    return snapshots.join(best, "root", "left").select("root", moved.alias("watermark"))


def content_action(hash_now: Column, hash_then: Column, retry: Column) -> Column:
    """After a fetch: skip an unchanged document, retry an unfinished revision of it, else make a new one."""
    return F.when(hash_now.eqNullSafe(hash_then), F.when(F.coalesce(retry, F.lit(False)), "retry").otherwise("skip")).otherwise("new_revision")


def sync_status(n_failed: Column, n_done: Column) -> Column:
    return F.when(n_failed == 0, "success").when(n_done > 0, "partial").otherwise("failed")


def truncated(n_remote: Column, n_local: Column) -> Column:
    """A listing of less than half of what is known looks cut short."""
    return n_remote * 2 < n_local


def run_summary(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, n_added, n_updated, n_removed, n_skipped, n_failed, looks_truncated, status) of each sync run.

    outcomes: run_id, action (add, update, remove, skip), success; runs: run_id, n_remote, n_local, complete. A run whose listing is incomplete is partial at best.
    """
    good = F.coalesce("success", F.lit(False))
    each = outcomes.groupBy("run_id").agg(
        F.count_if((F.col("action") == "add") & good).alias("n_added"), F.count_if((F.col("action") == "update") & good).alias("n_updated"), F.count_if((F.col("action") == "remove") & good).alias("n_removed"),
        F.count_if(F.col("action") == "skip").alias("n_skipped"), F.count_if((F.col("action") != "skip") & ~good).alias("n_failed"),
    )
    names = ["n_added", "n_updated", "n_removed", "n_skipped", "n_failed"]
    full = runs.join(each, "run_id", "left").select("run_id", "n_remote", "n_local", "complete", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))
    done = F.col("n_added") + F.col("n_updated") + F.col("n_removed") + F.col("n_skipped")
    status = F.when(~F.col("complete") & (F.col("n_failed") == 0), "partial").otherwise(sync_status(F.col("n_failed"), done))
    return full.select("run_id", *names, truncated(F.col("n_remote"), F.col("n_local")).alias("looks_truncated"), status.alias("status"))


def latest_edit(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, edit_time): the latest known edit time under each key; null where all are unknown."""
    return nodes.groupBy(*keys).agg(F.max("edit_time").alias("edit_time"))


def due_bases(bases: DataFrame, now: Column) -> DataFrame:
    """Live bases whose next sync is due: auto_sync is on and next_sync_at, both in the JSON text source_config, is set and not after now. A base without a time is never due."""
    at = F.try_to_timestamp(F.get_json_object("source_config", "$.next_sync_at"))
    on = F.get_json_object("source_config", "$.auto_sync").try_cast("boolean")
    return bases.where("deleted_at is null").withColumn("next_at", at).where(F.coalesce(on, F.lit(False)) & (F.col("next_at") <= now))


def with_next_run(bases: DataFrame, cron_col: str, now: Column) -> DataFrame:
    """bases with next_at: the next minute after now that the cron expression names; null if it is absent, invalid or never. In Arrow batches, one look-up for each distinct expression."""
    def run(expressions: pd.Series, times: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(expressions, times, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pd.isna(pair[1]) else next_cron(pair[0], pair[1].to_pydatetime())
            out.append(known[pair])
        return pd.to_datetime(pd.Series(out, dtype="object"))

    return bases.withColumn("next_at", F.pandas_udf(run, "timestamp")(F.col(cron_col), now.cast("timestamp")))


def scheduled(bases: DataFrame, active: DataFrame, now: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(admitted, bases): one tick of the scheduler. Due bases are admitted up to the limit of each connection; the admitted ones get their next time, the others stay due.

    bases: kb_id, connection_id, cron, next_at; active: connection_id, n.
    """
    ready = bases.where(F.col("next_at") <= now)
    start = admitted(ready.select(F.col("connection_id").alias("connection"), F.col("kb_id").alias("kb"), "next_at"), active.withColumnRenamed("connection_id", "connection"), limit)
    started = start.select(F.col("kb").alias("kb_id"), F.lit(True).alias("_started"))
    moved = with_next_run(bases.join(started, "kb_id", "left_semi").drop("next_at"), "cron", now).select(*bases.columns)
    return start, bases.join(started, "kb_id", "left_anti").select(*bases.columns).unionByName(moved)


def orphaned(latched: DataFrame, jobs: DataFrame) -> DataFrame:
    """Bases whose force latch is set but that no pending or running job works for: they are dispatched again. latched: kb_id, forced; jobs: kb_id, status."""
    return latched.where("forced").join(jobs.where("status in ('pending', 'running')").select("kb_id"), "kb_id", "left_anti")


def pending_cleanups(jobs: DataFrame, queued: DataFrame, kind: str = "source_cleanup") -> DataFrame:
    """(task_id, workspace_id, kb_id, job_id, created_at) of the pending clean-up jobs that the queue doesn't hold: they are given out again, the oldest first.

    jobs: workspace_id, kb_id, job_id, type, status, created_at; queued: task_id. The task's id follows from the job, so a job that is given out twice is one task.
    """
    task = F.concat_ws(":", F.lit(kind), F.col("workspace_id").cast("string"), F.col("job_id").cast("string"))
    waiting = jobs.where((F.col("type") == kind) & (F.col("status") == "pending")).select(task.alias("task_id"), "workspace_id", "kb_id", "job_id", "created_at")
    return waiting.join(queued.select("task_id"), "task_id", "left_anti")


def cleanup_objects(jobs: DataFrame) -> DataFrame:
    """(job_id, position, store, key): the objects that a clean-up job's JSON payload lists under `objects`. Entries that are no object, or whose key is no text or empty, are passed over; a store that is no text is empty."""
    listed = F.expr("filter(try_variant_get(try_parse_json(payload), '$.objects', 'array<variant>'), o -> schema_of_variant(variant_get(o, '$.key', 'variant')) = 'STRING')")
    store = F.expr("if(schema_of_variant(variant_get(o, '$.store', 'variant')) = 'STRING', variant_get(o, '$.store', 'string'), '')")
    each = jobs.select("job_id", F.posexplode(listed).alias("position", "o"))
    return each.select("job_id", "position", store.alias("store"), F.expr("variant_get(o, '$.key', 'string')").alias("key")).where("key <> ''")


def admitted(due: DataFrame, active: DataFrame, limit: int) -> DataFrame:
    """Due knowledge bases that may start now: at most `limit` jobs a connection with those that are active.

    due: connection, kb, next_at; active: connection, n. The earliest go first.
    """
    rank = F.row_number().over(Window.partitionBy("connection").orderBy("next_at", "kb"))
    return due.withColumn("rank", rank).join(active, "connection", "left").where(F.col("rank") <= limit - F.coalesce("n", F.lit(0))).select("connection", "kb", "next_at", "rank")


def idempotent(requests: DataFrame) -> DataFrame:
    """(request_id, outcome): accepted, replay (same key and hash), conflict (same key, another hash), or deduped (a new key, known content).

    requests: request_id, key, hash; a smaller id came earlier.
    """
    by_key = Window.partitionBy("key").orderBy("request_id")
    first = requests.withColumn("n", F.row_number().over(by_key)).withColumn("hash0", F.first("hash").over(by_key))
    lead = first.where("n = 1").groupBy("hash").agg(F.min("request_id").alias("owner"))
    out = F.when((F.col("n") > 1) & (F.col("hash") != F.col("hash0")), "conflict").when(F.col("n") > 1, "replay").when(F.col("request_id") != F.col("owner"), "deduped").otherwise("accepted")
    return first.join(lead, "hash", "left").select("request_id", out.alias("outcome"))


def expired(entries: DataFrame, staging_before: Column, retired_before: Column, batch: int = 1000) -> DataFrame:
    """Entries to clean up, oldest first, one batch: staging or failed before one time, retired before another. An entry's age counts from its retirement, or from its creation where it has none."""
    since = F.coalesce("retired_at", "created_at")
    old = (F.col("state").isin("staging", "failed") & (F.col("created_at") < staging_before)) | ((F.col("state") == "retired") & (since < retired_before))
    return entries.where(old).orderBy(since, "id").limit(batch)


def expired_by_budget(entries: DataFrame, generations: DataFrame, bases: DataFrame, staging_before: Column, retired_before: Column, batch: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(entries, generations) of one clean-up: entries as in `expired`; what they leave of the batch goes to retired generations, the oldest first."""
    rows = expired(entries, staging_before, retired_before, batch)
    left = rows.agg((F.lit(batch) - F.count("*")).alias("_left"))
    old = retired_generations(generations, bases, retired_before).orderBy("retired_at", "generation_id").limit(batch)  # a batch at most, so one task ranks it
    ranked = old.withColumn("_n", F.row_number().over(Window.orderBy("retired_at", "generation_id")))
    return rows, ranked.crossJoin(F.broadcast(left)).where("_n <= _left").drop("_n", "_left")


def retired_generations(generations: DataFrame, bases: DataFrame, before: Column) -> DataFrame:
    """Retired generations that no knowledge base points to."""
    return generations.where((F.col("status") == "retired") & (F.col("retired_at") < before)).join(bases.select(F.col("active_generation_id").alias("generation_id")), "generation_id", "left_anti")


def next_cron(expression: str | None, after):
    """The next minute after a time that matches a five-field cron expression; None if it is absent, invalid or never."""
    from datetime import timedelta

    bounds = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    parts = (expression or "").split()
    if len(parts) != 5:
        return None
    sets = []
    try:
        for text, (lo, hi) in zip(parts, bounds, strict=True):
            values: set[int] = set()
            for item in text.split(","):
                span, _, step = item.partition("/")
                a, b = (lo, hi) if span == "*" else (int(span), int(span)) if span.isdigit() else tuple(map(int, span.split("-")))
                if "/" in item and span.isdigit():
                    b = hi
                if not lo <= a <= b <= hi or (step and int(step) < 1):
                    return None
                values.update(range(a, b + 1, int(step or 1)))
            sets.append(values)
    except ValueError:
        return None
    minute, hour, day, month, week = sets
    week = {w % 7 for w in week}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        either = (at.day in day) or (at.isoweekday() % 7 in week) if parts[2] != "*" and parts[4] != "*" else (at.day in day and at.isoweekday() % 7 in week)
        if at.month in month and either:
            for h in sorted(x for x in hour if x >= at.hour):
                for m in sorted(x for x in minute if h > at.hour or x >= at.minute):
                    return at.replace(hour=h, minute=m)
        at = at.replace(hour=0, minute=0) + timedelta(days=1)
    return None


def retry_required(documents: DataFrame, revisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, retry_required): no active revision, an unfinished latest one, or a failed job on it."""
    latest = revisions.groupBy("document_id").agg(F.max_by(F.struct("revision_id", "status"), "revision_no").alias("r"))
    failed = jobs.where("status = 'failed'").select(F.col("document_revision_id").alias("revision_id"), F.lit(True).alias("failed")).distinct()
    named = documents.join(latest, "document_id", "left").withColumn("revision_id", F.col("r.revision_id")).join(failed, "revision_id", "left")
    why = F.col("active_revision_id").isNull() | (F.col("r.status") != "ready") | F.coalesce("failed", F.lit(False))
    return named.select("document_id", F.coalesce(why, F.lit(True)).alias("retry_required"))
