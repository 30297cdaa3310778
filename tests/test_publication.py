"""Publication of documents: the gate, what goes live, and counters that move by differences, against a recount."""

import random
from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from heronlake.operators import lifecycle, stats

AT = datetime(2024, 1, 1)
KINDS = {
    "bases": "kb_id long, active_generation_id long, content_version long", "documents": "document_id long, kb_id long, active_revision_id long",
    "generations": "generation_id long, kb_id long, status string, indexed_content_version long, document_count long, chunk_count long, indexed_count long, manual_edit_count long, disabled_chunk_count long",
    "chunks": "chunk_id long, document_id long, revision_id long, new_revision_id long, active_revision_id long, enabled boolean, role string, edit_source string",
    "entries": "entry_id long, document_id long, generation_id long, chunk_id long, chunk_revision_id long, state string, embedding array<double>, dimension int, search_content string, published_at timestamp, retired_at timestamp",
    "requests": "request_id long, document_id long, revision_id long, generation_id long, at timestamp",
}


def tables(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), KINDS[k]) for k in KINDS}


def entry(n, chunk, revision=None, state="staging", vector=(1.0,), doc=1):
    return (n, doc, 7, chunk, revision or chunk * 10, state, list(vector) if vector else None, 1, "t", None, None)


@pytest.mark.parametrize("staged, outcome", [
    ([entry(1, 1), entry(2, 2)], "published"), ([entry(1, 1)], "invalid"), ([entry(1, 1), entry(2, 2), entry(3, 3)], "invalid"), ([entry(1, 1), entry(2, 2, 99)], "invalid"),
    ([entry(1, 1), entry(2, 2, vector=None)], "conflict"), ([entry(1, 1), entry(2, 1)], "invalid"), ([entry(1, 1), entry(2, 2), entry(4, 1, state="published")], "published"), ([], "invalid"),
])
def test_gate(spark, staged, outcome):
    """Two enabled chunks and a disabled one (3): exactly the two must be staged, of their own revisions, and whole."""
    chunks = [(1, 1, 2, 10, None, True, "child", "system"), (2, 1, 2, 20, None, True, None, "user"), (3, 1, 2, 30, None, False, "child", "system"), (4, 1, 2, 40, None, True, "parent", "system")]
    t = tables(spark, bases=[(5, 7, 3)], documents=[(1, 5, None)], generations=[(7, 5, "ready", 3, 0, 0, sum(e[5] == "published" for e in staged), 0, 0)], chunks=chunks, entries=staged, requests=[(1, 1, 2, None, AT)])
    out = lifecycle.publish_documents(**t)
    assert [r.outcome for r in out["outcomes"].collect()] == [outcome]
    state = {r.entry_id: r.state for r in out["entries"].collect()}
    if outcome == "published":
        assert state == {e[0]: "retired" if e[5] == "published" else "published" for e in staged}
        assert {r.chunk_id: r.active_revision_id for r in out["chunks"].collect()} == {1: 10, 2: 20, 3: 30, 4: 40}
        assert out["generations"].collect()[0][3:] == (4, 1, 4, 2, 1, 1) and out["bases"].first().content_version == 4
    else:
        assert state == {e[0]: e[5] for e in staged} and out["bases"].first().content_version == 3


@pytest.mark.parametrize("base, generation, asked, outcome", [
    ((5, None, 1), (7, 5, "ready", 1), 7, "invalid"), ((5, 8, 1), (7, 5, "ready", 1), 7, "stale"), ((5, 7, 1), (7, 5, "failed", 1), 7, "not_found"), ((5, 7, 2), (7, 5, "ready", 1), None, "stale"),
    ((5, 7, 1), (7, 6, "ready", 1), 7, "not_found"), ((6, 7, 1), (7, 5, "ready", 1), 7, "not_found"),
])
def test_generation_must_be_current(spark, base, generation, asked, outcome):
    t = tables(spark, bases=[base], documents=[(1, 5, None)], generations=[(*generation, 0, 0, 0, 0, 0)], requests=[(1, 1, 2, asked, AT)])
    assert [r.outcome for r in lifecycle.publish_documents(**t)["outcomes"].collect()] == [outcome]


def test_counters_follow_many_publications(spark):
    """After three rounds of publications the counters equal a full recount."""
    r = random.Random(4)
    chunks, entries, n = [], [], 0
    for doc in range(20):
        for rev in (1, 2, 3):
            for _ in range(r.randrange(1, 5)):
                n += 1
                enabled = r.random() < 0.8
                chunks.append((n, doc, rev, n * 10, None, enabled, r.choice(["child", "flat", None]), r.choice(["user", "system"])))
                if enabled:
                    entries.append((rev, (n, doc, doc % 2, n, n * 10, "staging", [1.0] if r.random() < 0.95 else None, 1, "t", None, None)))
    t = tables(spark, bases=[(0, 0, 1), (1, 1, 1)], documents=[(d, d % 2, None) for d in range(20)], generations=[(g, g, "ready", 1, 0, 0, 0, 0, 0) for g in (0, 1)], chunks=chunks)
    done = set()
    for rev in (1, 2, 3):
        staged = spark.createDataFrame([e for v, e in entries if v == rev], KINDS["entries"])
        asked = [(d, d, rev, None, AT) for d in r.sample(range(20), 14)]
        t["entries"] = spark.createDataFrame(t["entries"].where("state <> 'staging'").unionByName(staged).collect(), KINDS["entries"])
        t["requests"] = spark.createDataFrame(asked, KINDS["requests"])
        out = lifecycle.publish_documents(**t)
        done |= {x.outcome for x in out["outcomes"].collect()}
        t |= {k: spark.createDataFrame(out[k].collect(), KINDS[k]) for k in ("bases", "documents", "generations", "chunks", "entries")}
        want = {x.generation_id: tuple(x)[1:] for x in lifecycle.recount(t["generations"], t["documents"], t["chunks"], t["entries"]).collect()}
        assert {x.generation_id: tuple(x[c] for c in lifecycle.COUNTERS) for x in t["generations"].collect()} == want
        assert all(x.indexed_content_version == x.content_version for x in t["generations"].join(t["bases"], "kb_id").collect())
    assert done == {"published", "conflict"} and all(v[0] > 5 for v in want.values())


def test_incomplete_projection_is_an_error(spark):
    row = "kb_id int, document_count int, chunk_count long, indexed_count long, manual_edit_count int, disabled_chunk_count int, missing_chunk_set_count int, missing_revision_count int"
    good = spark.createDataFrame([(1, 1, 5, 5, 0, 0, 0, 0)], row)
    assert stats.complete(good).collect() == good.collect()
    for bad in ((1, 1, 5, 6, 0, 0, 0, 0), (1, 1, 5, 5, 0, 0, 1, 0), (1, 1, 5, 5, 0, 0, 0, 2)):
        with pytest.raises(PySparkException, match="incomplete projection of 1"):
            stats.complete(spark.createDataFrame([bad], row)).collect()
