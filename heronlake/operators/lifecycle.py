"""Guarded state transitions: each takes old tables and a table of requests, and gives new tables and an outcome for every request.

A request takes effect only if its guard holds (compare-and-set on pointers and versions, completeness of what was staged); others leave
all tables as they are and say why. Requests are rows, so a thousand documents are published by one plan. Requests of one call must be for different
targets; the first of those that share one counts (smallest request_id), the others are `conflict`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.operators.state import unused_sets

MAX_REVISION_CHARS = 100_000


def _set(df: DataFrame, **values: Column) -> DataFrame:
    """df with some of its columns computed anew, in the order they had; helper columns go."""
    return df.select(*(values[c].alias(c) if c in values else F.col(c) for c in df.columns if not c.startswith("_")))


def _turn(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy("request_id")))


def good_entry() -> Column:
    """A staged entry that may be published: it has a vector of its dimension and indexed text."""
    return F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimension")) & F.col("search_content").isNotNull()


def complete_generations(bases: DataFrame, generations: DataFrame, entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(generations, entries, outcomes) after builds end: published (staged entries go live, the generation is ready), already_ready, not_building, stale
    (the base's active generation or content moved on; the generation is marked so), or conflict (entries are missing or incomplete).

    bases: kb_id, active_generation_id, content_version; generations: generation_id, kb_id, base_generation_id, source_content_version, status, chunk_count, indexed_count, ready_at;
    entries: generation_id, chunk_id, state, embedding, dimension, search_content, published_at; requests: request_id, generation_id, expected (entries), at.
    """
    staged = entries.where("state = 'staging'").groupBy("generation_id").agg(F.count_if(good_entry()).alias("_good"), F.count("*").alias("_all"))
    b = bases.select("kb_id", F.col("active_generation_id").alias("_active"), F.col("content_version").alias("_version"))
    g = _turn(requests, ["generation_id"]).join(generations, "generation_id", "left").join(b, "kb_id", "left").join(staged, "generation_id", "left")
    moved = ~F.col("base_generation_id").eqNullSafe(F.col("_active")) | F.col("base_generation_id").isNull() | ~F.col("source_content_version").eqNullSafe(F.col("_version"))
    whole = (F.coalesce("_good", F.lit(0)) == F.col("expected")) & (F.coalesce("_all", F.lit(0)) == F.col("expected"))
    outcome = (
        F.when(F.col("_turn") > 1, "conflict").when(F.col("status") == "ready", "already_ready").when(F.col("status").isNull() | (F.col("status") != "building"), "not_building")
        .when(moved, "stale").when(~whole, "conflict").otherwise("published")
    )
    done = g.select("request_id", "generation_id", "expected", "at", outcome.alias("outcome"))
    event = done.where("outcome in ('published', 'stale')").select("generation_id", F.col("outcome").alias("_o"), F.col("expected").alias("_n"), F.col("at").alias("_at"))
    out = generations.join(event, "generation_id", "left")
    live = F.col("_o") == "published"
    new_generations = _set(
        out, status=F.when(live, "ready").when(F.col("_o") == "stale", "stale").otherwise(F.col("status")), chunk_count=F.when(live, F.col("_n")).otherwise(F.col("chunk_count")),
        indexed_count=F.when(live, F.col("_n")).otherwise(F.col("indexed_count")), ready_at=F.when(live, F.col("_at")).otherwise(F.col("ready_at")),
    )
    e = entries.join(event.where("_o = 'published'"), "generation_id", "left")
    goes = F.col("_o").isNotNull() & (F.col("state") == "staging")
    new_entries = _set(e, state=F.when(goes, "published").otherwise(F.col("state")), published_at=F.when(goes, F.col("_at")).otherwise(F.col("published_at")))
    return new_generations.select(*generations.columns), new_entries.select(*entries.columns), done.select("request_id", "outcome")


def activate_generations(bases: DataFrame, generations: DataFrame, chunk_sets: DataFrame, entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bases, generations, chunk_sets, outcomes): the base's pointer goes to a ready generation that rests on the active one and has its content (else `not_ready` or
    `stale`); the former generation retires, and chunk sets that no live entry of a generation in use names are archived.

    As complete_generations; generations also have retired_at; chunk_sets: chunk_set_id, status; entries: chunk_set_id, generation_id, state; requests: request_id, generation_id, at.
    """
    b = bases.select("kb_id", F.col("active_generation_id").alias("_active"), F.col("content_version").alias("_version"))
    g = _turn(requests.join(generations, "generation_id", "left"), ["kb_id"]).join(b, "kb_id", "left")
    moved = ~F.col("base_generation_id").eqNullSafe(F.col("_active")) | ~F.col("source_content_version").eqNullSafe(F.col("_version"))
    outcome = F.when(F.col("status").isNull() | (F.col("status") != "ready"), "not_ready").when(moved, "stale").when(F.col("_turn") > 1, "conflict").otherwise("activated")
    done = g.select("request_id", "kb_id", "generation_id", "base_generation_id", "at", outcome.alias("outcome"))
    swap = done.where("outcome = 'activated'").select("kb_id", F.col("generation_id").alias("_new"), F.col("base_generation_id").alias("_old"), F.col("at").alias("_at"))
    new_bases = _set(bases.join(swap, "kb_id", "left"), active_generation_id=F.coalesce("_new", "active_generation_id")).select(*bases.columns)
    old = swap.where("_old is not null").select(F.col("_old").alias("generation_id"), "_at")
    retires = F.col("_at").isNotNull()
    new_generations = _set(generations.join(old, "generation_id", "left"), status=F.when(retires, "retired").otherwise(F.col("status")), retired_at=F.coalesce("_at", "retired_at")).select(*generations.columns)
    live = entries.join(new_generations.where("status <> 'retired'").select("generation_id"), "generation_id", "left_semi")
    unused = unused_sets(chunk_sets.where("status = 'ready'").select("chunk_set_id"), live).withColumn("_u", F.lit(True))
    new_sets = _set(chunk_sets.join(unused, "chunk_set_id", "left"), status=F.when(F.col("_u"), "archived").otherwise(F.col("status"))).select(*chunk_sets.columns)
    return new_bases, new_generations, new_sets, done.select("request_id", "outcome")


#: The counters that a generation keeps of what it holds.
COUNTERS = ["document_count", "chunk_count", "indexed_count", "manual_edit_count", "disabled_chunk_count"]


def _chunk_facts(sign: int) -> list[Column]:
    """What a document's chunks add to the counters (sign 1) or take away (-1)."""
    one = F.lit(sign).cast("long")
    return [one.alias("chunk_count"), F.when(F.col("edit_source") == "user", one).otherwise(0).alias("manual_edit_count"), F.when(~F.col("enabled"), one).otherwise(0).alias("disabled_chunk_count")]


def publish_documents(bases: DataFrame, documents: DataFrame, generations: DataFrame, chunks: DataFrame, entries: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Documents are published in their base's active generation: new bases, documents, generations, chunks and entries, and outcomes, by these names.

    Outcomes, the first that holds: `not_found` (the document, its base, or the generation, which must be ready or building); `invalid` (the base has no active
    generation); `stale` (the request's generation isn't the active one, or has another content version than the base); `invalid` (there must be as many staged entries of the document in the
    generation as the revision has enabled child or flat chunks, each of one of these and of its chunk revision); `conflict` (a staged entry has no vector of its dimension or no indexed text; a second
    request for the document); `published`. Then what the document had published in the generation retires, exactly the entries that were checked go live, the revision's chunks switch to
    their new revisions, the document's active revision switches, and base and generation both count one content version more for each document. The
    generation's counters move by the differences alone: what its documents' old chunks and entries counted goes, what the new ones count comes.

    bases: kb_id, active_generation_id, content_version; documents: document_id, kb_id, active_revision_id; generations: generation_id, kb_id, status, indexed_content_version and COUNTERS; chunks:
    chunk_id, document_id, revision_id (the document's revision that they cut), new_revision_id, active_revision_id (of the chunk), enabled, role, edit_source; entries: entry_id, document_id, generation_id,
    chunk_id, chunk_revision_id, state, embedding, dimension, search_content, published_at, retired_at; requests: request_id, document_id, revision_id, generation_id (null: the active one), at.
    """
    b = bases.select("kb_id", F.col("active_generation_id").alias("_active"), F.col("content_version").alias("_version"), F.lit(True).alias("_base"))
    g = generations.where("status in ('ready', 'building')").select("generation_id", "kb_id", F.col("indexed_content_version").alias("_indexed"), F.lit(True).alias("_generation"))
    d = documents.select("document_id", "kb_id", F.col("active_revision_id").alias("_old"))
    r = _turn(requests, ["document_id"]).join(d, "document_id", "left").join(b, "kb_id", "left")
    r = r.withColumn("generation_id", F.coalesce("generation_id", "_active")).join(g, ["generation_id", "kb_id"], "left")
    want = chunks.where("enabled and coalesce(role, 'flat') in ('child', 'flat')").select("document_id", "revision_id", "chunk_id", F.col("new_revision_id").alias("chunk_revision_id"), F.lit(True).alias("_wanted"))
    asked = r.select("request_id", "document_id", "revision_id", "generation_id")
    expected = asked.join(want, ["document_id", "revision_id"]).groupBy("request_id").agg(F.count("*").alias("_expected"))
    staged = asked.join(entries.where("state = 'staging'").select("entry_id", "document_id", "generation_id", "chunk_id", "chunk_revision_id", good_entry().alias("_good")), ["document_id", "generation_id"])
    held = staged.join(want, ["document_id", "revision_id", "chunk_id", "chunk_revision_id"], "left")
    found = held.groupBy("request_id").agg(F.count("*").alias("_staged"), F.count_distinct(F.when(F.col("_wanted"), F.col("chunk_id"))).alias("_matched"), F.count_if(~F.coalesce("_good", F.lit(False))).alias("_broken"))
    n = lambda c: F.coalesce(c, F.lit(0))
    r = r.join(expected, "request_id", "left").join(found, "request_id", "left")
    outcome = (
        F.when(F.col("_base").isNull(), "not_found").when(F.col("_active").isNull(), "invalid").when(F.col("generation_id") != F.col("_active"), "stale").when(F.col("_generation").isNull(), "not_found")
        .when(~F.col("_indexed").eqNullSafe(F.col("_version")), "stale").when((n("_expected") != n("_staged")) | (n("_expected") != n("_matched")), "invalid")
        .when((n("_broken") > 0) | (F.col("_turn") > 1), "conflict").otherwise("published")
    )
    done = r.select("request_id", "kb_id", "document_id", "revision_id", "generation_id", "_old", "at", outcome.alias("outcome"))
    good = done.where("outcome = 'published'")
    event = good.select("document_id", F.col("revision_id").alias("_revision"), F.col("generation_id").alias("_generation"), F.col("at").alias("_at"))

    new_documents = _set(documents.join(event, "document_id", "left"), active_revision_id=F.coalesce("_revision", "active_revision_id")).select(*documents.columns)
    switches = F.col("_revision") == F.col("revision_id")
    new_chunks = _set(chunks.join(event, "document_id", "left"), active_revision_id=F.when(switches, F.col("new_revision_id")).otherwise(F.col("active_revision_id"))).select(*chunks.columns)
    live = held.where("_wanted").join(good.select("request_id"), "request_id", "left_semi").select("entry_id", F.lit(True).alias("_goes"))
    e = entries.join(event, "document_id", "left").join(live, "entry_id", "left")
    goes = F.coalesce("_goes", F.lit(False))
    ends = F.col("generation_id").eqNullSafe(F.col("_generation")) & F.col("_at").isNotNull() & (F.col("state") == "published")
    new_entries = _set(
        e, state=F.when(goes, "published").when(ends, "retired").otherwise(F.col("state")), published_at=F.when(goes, F.col("_at")).otherwise(F.col("published_at")),
        retired_at=F.when(goes, F.lit(None)).when(ends, F.col("_at")).otherwise(F.col("retired_at")),
    ).select(*entries.columns)

    first = good.select("generation_id", F.when(F.col("_old").isNull(), 1).otherwise(0).cast("long").alias("document_count"))
    before = good.join(chunks, (chunks["document_id"] == good["document_id"]) & (chunks["revision_id"] == good["_old"])).select("generation_id", *_chunk_facts(-1))
    after = good.join(chunks, (chunks["document_id"] == good["document_id"]) & (chunks["revision_id"] == good["revision_id"])).select("generation_id", *_chunk_facts(1))
    moved = new_entries.select("entry_id", F.col("state").alias("_now")).join(entries.select("entry_id", "generation_id", "state"), "entry_id").where("(_now = 'published') <> (state = 'published')")
    indexed = moved.select("generation_id", F.when(F.col("_now") == "published", 1).otherwise(-1).cast("long").alias("indexed_count"))
    delta = first.unionByName(before, True).unionByName(after, True).unionByName(indexed, True).groupBy("generation_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in COUNTERS))
    steps = good.groupBy("generation_id").agg(F.count("*").alias("_steps"))
    new_generations = _set(
        generations.join(delta, "generation_id", "left").join(steps, "generation_id", "left"),
        indexed_content_version=F.col("indexed_content_version") + F.coalesce("_steps", F.lit(0)), **{c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in COUNTERS},
    ).select(*generations.columns)
    more = good.groupBy("kb_id").agg(F.count("*").alias("_more"))
    new_bases = _set(bases.join(more, "kb_id", "left"), content_version=F.col("content_version") + F.coalesce("_more", F.lit(0))).select(*bases.columns)
    return {"bases": new_bases, "documents": new_documents, "generations": new_generations, "chunks": new_chunks, "entries": new_entries, "outcomes": done.select("request_id", "outcome")}


def recount(generations: DataFrame, documents: DataFrame, chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(generation_id and COUNTERS) from the facts themselves: the documents of its base with an active revision, their chunks, and its published entries. Tables as in publish_documents."""
    active = documents.where("active_revision_id is not null").select("kb_id", "document_id", F.col("active_revision_id").alias("revision_id"))
    d = active.groupBy("kb_id").agg(F.count("*").alias("document_count"))
    c = active.join(chunks, ["document_id", "revision_id"]).select("kb_id", *_chunk_facts(1)).groupBy("kb_id").agg(*(F.sum(x).alias(x) for x in COUNTERS if x not in ("document_count", "indexed_count")))
    e = entries.where("state = 'published'").groupBy("generation_id").agg(F.count("*").alias("indexed_count"))
    out = generations.select("generation_id", "kb_id").join(d, "kb_id", "left").join(c, "kb_id", "left").join(e, "generation_id", "left")
    return out.select("generation_id", *(F.coalesce(x, F.lit(0)).alias(x) for x in COUNTERS))


def publish_edits(bases: DataFrame, chunks: DataFrame, entries: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bases, chunks, entries, outcomes) after single chunks' new revisions are published.

    The chunk must still have the base revision (else `revision_conflict`), the base its content version (else `stale`), and an enabled revision a good staged entry (else
    `conflict`). A disabled revision only retires what was published. bases: kb_id, content_version; chunks: chunk_id, kb_id, active_revision_id; entries: chunk_id,
    revision_id, state, embedding, dimension, search_content, published_at, retired_at; requests: request_id, chunk_id, base_revision_id, revision_id, content_version, enabled, at.
    """
    have = entries.where("state = 'staging'").where(good_entry()).select("chunk_id", "revision_id", F.lit(True).alias("_have")).distinct()
    r = _turn(requests, ["chunk_id"]).join(chunks.select("chunk_id", "kb_id", F.col("active_revision_id").alias("_now")), "chunk_id", "left")
    r = r.join(bases.select("kb_id", F.col("content_version").alias("_version")), "kb_id", "left").join(have, ["chunk_id", "revision_id"], "left")
    outcome = (
        F.when(F.col("kb_id").isNull(), "not_found").when(~F.col("base_revision_id").eqNullSafe(F.col("_now")), "revision_conflict").when(~F.col("content_version").eqNullSafe(F.col("_version")), "stale")
        .when((F.col("enabled") & F.col("_have").isNull()) | (F.col("_turn") > 1), "conflict").otherwise("published")
    )
    done = r.select("request_id", "kb_id", "chunk_id", "revision_id", "enabled", "at", outcome.alias("outcome"))
    good = done.where("outcome = 'published'")
    event = good.select("chunk_id", F.col("revision_id").alias("_revision"), F.col("enabled").alias("_enabled"), F.col("at").alias("_at"))
    new_chunks = _set(chunks.join(event, "chunk_id", "left"), active_revision_id=F.coalesce("_revision", "active_revision_id")).select(*chunks.columns)
    e = entries.join(event, "chunk_id", "left")
    ends = F.col("_at").isNotNull() & (F.col("state") == "published")
    goes = F.col("_enabled") & (F.col("state") == "staging") & (F.col("revision_id") == F.col("_revision"))
    new_entries = _set(
        e, state=F.when(goes, "published").when(ends, "retired").otherwise(F.col("state")), published_at=F.when(goes, F.col("_at")).otherwise(F.col("published_at")),
        retired_at=F.when(ends, F.col("_at")).otherwise(F.col("retired_at")),
    ).select(*entries.columns)
    touched = good.select("kb_id").distinct().withColumn("_t", F.lit(1))
    new_bases = _set(bases.join(touched, "kb_id", "left"), content_version=F.col("content_version") + F.coalesce("_t", F.lit(0))).select(*bases.columns)
    return new_bases, new_chunks, new_entries, done.select("request_id", "outcome")


def edit_chunks(chunks: DataFrame, revisions: DataFrame, documents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions with the new ones, outcomes): users' edits of chunks as new pending revisions.

    Outcomes: created; not_found; immutable (a parent, or a chunk of an FAQ); invalid (header and content over MAX_REVISION_CHARS characters, or enabled without
    content); revision_conflict (the base revision isn't the active one). chunks: chunk_id, document_id, role, active_revision_id; revisions: revision_id, chunk_id, revision_no,
    base_revision_id, content, context_header, embedding_content, enabled, status, edit_source; documents: document_id, kind; requests: request_id, chunk_id,
    base_revision_id, content, context_header, enabled.
    """
    from heronlake.functions.text import embedding_text, non_blank, trim_all

    last = revisions.groupBy("chunk_id").agg(F.max("revision_no").alias("_last"))
    r = _turn(requests, ["chunk_id"]).join(chunks.select("chunk_id", "document_id", "role", "active_revision_id"), "chunk_id", "left").join(documents.select("document_id", "kind"), "document_id", "left").join(last, "chunk_id", "left")
    size = F.length(F.coalesce("content", F.lit(""))) + F.length(F.coalesce("context_header", F.lit("")))
    outcome = (
        F.when((size > MAX_REVISION_CHARS) | (F.col("enabled") & ~non_blank(F.col("content"))), "invalid").when(F.col("role").isNull(), "not_found")
        .when((F.col("role") == "parent") | (F.col("kind") == "faq"), "immutable").when(~F.col("base_revision_id").eqNullSafe(F.col("active_revision_id")) | (F.col("_turn") > 1), "revision_conflict").otherwise("created")
    )
    done = r.withColumn("outcome", outcome)
    header = trim_all(F.coalesce("context_header", F.lit("")))
    no = F.coalesce("_last", F.lit(0)) + 1
    new = done.where("outcome = 'created'").select(
        F.concat_ws(":", F.col("chunk_id").cast("string"), no.cast("string")).alias("revision_id"), "chunk_id", no.alias("revision_no"), "base_revision_id", "content", "context_header",
        embedding_text(header, F.col("content")).alias("embedding_content"), "enabled", F.lit("pending").alias("status"), F.lit("user").alias("edit_source"),
    )
    return revisions.unionByName(new.select(*(F.col(c).cast(revisions.schema[c].dataType) for c in revisions.columns))), done.select("request_id", "outcome")


def chunk_set_rows(chunks: DataFrame, revisions: DataFrame) -> DataFrame:
    """Chunks with their active revision, in reading order within each set: parents, children, flat ones, by sequence and id."""
    active = revisions.select("chunk_id", F.col("revision_id").alias("active_revision_id"), "content", "enabled")
    rank = F.when(F.col("role") == "parent", 0).when(F.col("role") == "child", 1).otherwise(2)
    return chunks.join(active, ["chunk_id", "active_revision_id"]).withColumn("place", F.row_number().over(Window.partitionBy("chunk_set_id").orderBy(rank, "sequence", "chunk_id")))


def purge(entries: DataFrame, generations: DataFrame, gone_entries: DataFrame, gone_generations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, generations) without the rows that a clean-up chose, nor any entry of a generation that goes."""
    left = entries.join(gone_entries.select("id"), "id", "left_anti").join(gone_generations.select("generation_id"), "generation_id", "left_anti")
    return left.select(*entries.columns), generations.join(gone_generations.select("generation_id"), "generation_id", "left_anti").select(*generations.columns)


def remove_source_documents(documents: DataFrame, entries: DataFrame, revisions: DataFrame, assets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, entries, keys) after a sync found documents gone. gone: document_id, policy, at.

    `keep` marks the document and retires its entries; `remove` takes both away, and its stored objects' keys (raw, parsed, images) are given for deletion in batches.
    revisions: document_id, raw_key, parsed_key; assets: document_id, asset_key.
    """
    from heronlake.operators.state import cleanup_batches

    mark = gone.select("document_id", F.col("policy").alias("_p"), F.col("at").alias("_at"))
    d = documents.join(mark, "document_id", "left").where("coalesce(_p, 'keep') <> 'remove'")
    e = entries.join(mark, "document_id", "left").where("coalesce(_p, 'keep') <> 'remove'")
    removed = gone.where("policy = 'remove'").select("document_id")
    own = revisions.join(removed, "document_id", "left_semi")
    keys = cleanup_batches([own.select(F.col("raw_key").alias("key")), own.select(F.col("parsed_key").alias("key")), assets.join(removed, "document_id", "left_semi").select(F.col("asset_key").alias("key"))])
    retired = F.when(F.col("_at").isNotNull(), "retired").otherwise(F.col("state"))
    return _set(d, deleted_at=F.coalesce("deleted_at", "_at")).select(*documents.columns), _set(e, state=retired).select(*entries.columns), keys


def retry_documents(documents: DataFrame, revisions: DataFrame, jobs: DataFrame, retry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, revisions, jobs): failed revisions and jobs of the documents named are pending again without their errors, and deleted documents live again. retry: document_id."""
    named = retry.select("document_id").distinct().withColumn("_r", F.lit(True))
    again = F.col("_r") & (F.col("status") == "failed")
    reset = lambda df: _set(df.join(named, "document_id", "left"), status=F.when(again, "pending").otherwise(F.col("status")), error=F.when(again, F.lit(None)).otherwise(F.col("error"))).select(*df.columns)
    d = _set(documents.join(named, "document_id", "left"), deleted_at=F.when(F.col("_r"), F.lit(None)).otherwise(F.col("deleted_at"))).select(*documents.columns)
    return d, reset(revisions), reset(jobs)


def fail_work(rows: DataFrame, failed: DataFrame, key: str, final: tuple[str, ...] = ("ready",)) -> DataFrame:
    """Rows named in failed (key, error_class, error) are failed with that error; those in a final state stay."""
    event = failed.select(key, F.col("error_class").alias("_class"), F.col("error").alias("_error"), F.lit(True).alias("_f"))
    hit = F.col("_f").isNotNull() & ~F.col("status").isin(*final)
    out = rows.join(event, key, "left")
    return _set(out, status=F.when(hit, "failed").otherwise(F.col("status")), error_class=F.when(hit, F.col("_class")).otherwise(F.col("error_class")), error=F.when(hit, F.col("_error")).otherwise(F.col("error"))).select(*rows.columns)


def set_keys(config: Column, values: dict[str, Column], remove: tuple[str, ...] = ()) -> Column:
    """A map column with keys set and others taken away."""
    new = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))) if values else F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(config, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*remove, *values) if remove or values else F.lit(True))
    return F.map_concat(kept, new)
