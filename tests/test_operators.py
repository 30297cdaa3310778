import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heronlake.functions import text as T
from heronlake.functions.hashing import canonical_json, config_hash, decode_cursor, encode_cursor
from heronlake.operators import retrieval, state, stats, sync


def test_fusion_order(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], "query_id long, entry_id string, score double, rank int")
    k = spark.createDataFrame([(1, "b", 0.7, 1), (1, "c", 0.6, 2)], "query_id long, entry_id string, score double, rank int")
    got = retrieval.fuse(v, k).orderBy(F.desc("score"), "entry_id").collect()
    assert [r.entry_id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[1].keyword_score is None


def test_grouping(spark):
    hits = spark.createDataFrame([(1, 10, 0.8), (1, 11, 0.9), (1, 20, 0.5)], "query_id long, entry_id long, score double")
    parents = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "entry_id long, parent_id long")
    got = {r.parent_id: r for r in retrieval.group_by_parent(hits, parents).collect()}
    assert got[1].matched == [11, 10] and got[1].score == 0.9 and len(got) == 2


def test_options():
    assert retrieval.check_options(final_k=99)[2] == 50
    with pytest.raises(ValueError):
        retrieval.check_options(vector_k=0)


NEW, OLD, CURSOR = datetime(2024, 7, 1), datetime(2024, 5, 1), datetime(2024, 6, 1)


@pytest.mark.parametrize(
    "edit, local, complete, force, want",
    [
        (NEW, None, True, False, "add"), (None, "live", True, False, "remove"), (None, "live", False, False, None), (None, "gone", True, False, None), (OLD, "live", True, True, "update"),
        (OLD, "retry", True, False, "update"), (NEW, "live", True, False, "update"), (OLD, "live", True, False, "skip"), (CURSOR, "live", True, False, "skip"), (NEW, "gone", True, False, "update"),
    ],
)
def test_sync_diff(spark, edit, local, complete, force, want):
    r = spark.createDataFrame([("t", True, edit, 0)] if edit else [], "token string, has_document boolean, edit_time timestamp, ordinal int")
    x = spark.createDataFrame([("t", local == "retry", NEW if local == "gone" else None, 0)] if local else [], "external_id string, retry_required boolean, deleted_at timestamp, ordinal int")
    got = sync.sync_diff(r, x, F.lit(CURSOR), complete, force).collect()
    assert [g.action for g in got] == ([want] if want else [])


def test_sync_diff_duplicates(spark):
    r = spark.createDataFrame([("a", True, NEW, 0), ("a", True, OLD, 1), ("f", False, NEW, 2)], "token string, has_document boolean, edit_time timestamp, ordinal int")
    x = spark.createDataFrame([("b", False, None, 0), ("b", False, None, 1)], "external_id string, retry_required boolean, deleted_at timestamp, ordinal int")
    assert [(g.token, g.action) for g in sync.sync_diff(r, x, F.lit(CURSOR)).collect()] == [("a", "add")]
    assert {(w.side, w.token) for w in sync.duplicate_warnings(r, x).collect()} == {("remote", "a"), ("local", "b")}


def test_watermark(spark):
    r = spark.createDataFrame([("a", OLD), ("b", CURSOR), ("c", CURSOR), ("d", NEW), ("z", None)], "token string, edit_time timestamp")
    o = lambda **k: spark.createDataFrame(list(k.items()), "token string, success boolean")
    mark = lambda out, prev=datetime(2024, 1, 1), full=True: sync.safe_watermark(r, out, F.lit(prev), full).first()[0]
    assert mark(o(a=True, b=True, c=True, d=True)) == NEW
    assert mark(o(a=True, b=True, c=False, d=True)) == OLD
    assert mark(o(b=True, c=True, d=True)) == datetime(2024, 1, 1)
    assert mark(o(a=True), prev=NEW) == NEW and mark(o(a=True), full=False) == datetime(2024, 1, 1)


def test_cron():
    at = datetime(2024, 2, 28, 23, 59, 30)
    assert sync.next_cron("*/15 * * * *", at) == datetime(2024, 2, 29, 0, 0)
    assert sync.next_cron("0 9 * * 1", at) == datetime(2024, 3, 4, 9, 0)
    assert sync.next_cron("bad", at) is None and sync.next_cron(None, at) is None and sync.next_cron("61 * * * *", at) is None


def test_hashing():
    assert canonical_json({"b": 1.0, "a": [1, 2.5]}) == '{"a":[1,2.5],"b":1}' and config_hash({"a": 1}) == config_hash({"a": 1.0})
    with pytest.raises(ValueError):
        canonical_json({"a": float("nan")})
    assert decode_cursor(encode_cursor(a=1, b="x"), {"a", "b"}) == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        decode_cursor("!!", {"a"})


def test_text_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.web_uri(F.lit("HTTPS://Ex.com:443#f"))) == "https://ex.com/" and one(T.web_uri(F.lit("https://u@ex.com/"))) is None
    assert one(T.sync_root(F.lit("https://x/drive/folder/abc"))) == "drive_folder" and one(T.sync_root(F.lit("a b"))) is None
    assert one(T.relative_path(F.lit(".\\a%20b+c.png"))) == "a b+c.png"
    assert one(T.faq_question(F.lit("  How \n ARE you "))) == "how are you"
    assert one(T.context_header(F.lit("Guide"), F.array(F.lit("guide"), F.lit(" A ")), F.lit(None).cast("string"))) == "Guide > A"


def test_pages_and_limits(spark):
    df = spark.range(10)
    assert [r.id for r in stats.page(df, [("id", False)], 2, (4,)).collect()] == [5, 6, 7]
    with pytest.raises(ValueError):
        stats.page(df, [("id", False)], 201)


def test_plans_have_no_products(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    q = spark.createDataFrame([(1, "5 6")], "query_id long, query string")
    plan = retrieval.keyword_top(df.withColumnRenamed("doc_id", "entry_id"), q)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_snapshot_store(spark, tmp_path):
    s = state.SnapshotStore(spark, str(tmp_path / "s"))
    s.write(spark.range(3), "one", None)
    s.write(spark.range(5), "two", "one")
    assert s.current() == "two" and s.read().count() == 5
    with pytest.raises(RuntimeError):
        s.write(spark.range(1), "three", "one")


def test_snapshot_store_outlives_a_writer_that_dies(spark, tmp_path):
    s = state.SnapshotStore(spark, str(tmp_path / "s"))
    s.write(spark.range(3), "one", None)
    spark.range(9).write.parquet(f"{s.root}/dead")  # a snapshot whose pointer was never made
    s.write(spark.range(4), "two", "one")
    assert s.current() == "two"
    s._fs.createNewFile(s._path("pointer-00000003-b"))  # two writers of one turn: the name that sorts first has won
    s._fs.createNewFile(s._path("pointer-00000003-a"))
    assert s.current() == "a"


def test_streams(spark, tmp_path):
    from heronlake.streaming.ingest import ingest, latches, poll_states, poll_step

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 2), ("a", 1), ("b", 2)], "document_id string, v int").coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest(spark.readStream.schema("document_id string, v int").parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b).awaitTermination()
        assert {(r.document_id, r.v) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()} == {("a", 1), ("b", 2)}
        spark.createDataFrame([("b", 3)], "document_id string, v int").coalesce(1).write.mode("append").parquet(src)
    polls = str(tmp_path / "polls")
    spark.createDataFrame([("j", False, 1), ("j", True, 2), ("k", False, 1), ("k", False, 2), ("w", False, 1)], "job_id string, ready boolean, at int").coalesce(1).write.parquet(polls)
    q = poll_states(spark.readStream.schema("job_id string, ready boolean, at int").parquet(polls), 2, 600_000).writeStream.outputMode("update").format("memory").queryName("polled").trigger(processingTime="1 second").start()
    want, seen = {"j": (2, "done"), "k": (2, "failed"), "w": (1, "pending")}, {}
    for _ in range(60):  # a stream with timers never ends by itself
        seen = {r.job_id: (r.attempts, r.status) for r in spark.table("polled").collect()}
        if seen == want:
            break
        time.sleep(1)
    q.stop()
    assert seen == want
    assert poll_step((1, "pending"), None, 2) == (2, "failed") and poll_step((2, "done"), False, 2) == (2, "done")
    asks = str(tmp_path / "asks")
    spark.createDataFrame([("x", "request", 1), ("x", "request", 2), ("x", "consume", 3), ("y", "consume", 1), ("y", "fail", 2), ("z", "request", 2), ("z", "consume", 1)], "kb_id string, kind string, at int").coalesce(1).write.parquet(asks)
    q = latches(spark.readStream.schema("kb_id string, kind string, at int").parquet(asks)).writeStream.outputMode("update").format("memory").queryName("latched").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.kb_id: (r.forced, r.requests) for r in spark.table("latched").collect()} == {"x": (False, 2), "y": (True, 0), "z": (True, 1)}


def test_scheduler_stream(spark, tmp_path):
    from heronlake.streaming.ingest import schedule

    at = lambda d, h=0: datetime(2024, 1, d, h)
    store = state.SnapshotStore(spark, str(tmp_path / "bases"))
    rows = [("a", "c", "0 3 * * *", at(1)), ("b", "c", "0 3 * * *", at(2)), ("d", "e", "bad", at(1)), ("f", "e", "0 3 * * *", at(9))]
    store.write(spark.createDataFrame(rows, "kb_id string, connection_id string, cron string, next_at timestamp"), "first", None)
    ticks, started = str(tmp_path / "ticks"), []
    spark.createDataFrame([(at(3),), (at(4),)], "tick timestamp").coalesce(1).write.parquet(ticks)
    running = lambda: spark.createDataFrame([("c", 1)], "connection_id string, n int")
    for _ in range(2):  # the second run has no new tick
        schedule(spark.readStream.schema("tick timestamp").parquet(ticks), store, running, 2, lambda df, epoch: started.extend(r.kb for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(started) == ["a", "d"]
    assert {r.kb_id: r.next_at for r in store.read().collect()} == {"a": at(4, 3), "b": at(2), "d": None, "f": at(9)}


def test_deep_and_broken_trees(spark):
    rows = [("r", None, "", "folder")] + [(f"n{k}", f"n{k - 1}" if k else "r", f"f{k}", "folder") for k in range(80)] + [("o", "gone", "x", "file"), ("c1", "c2", "x", "folder"), ("c2", "c1", "x", "folder")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, name string, node_type string")
    found = {r.id: r.problem for r in stats.tree_problems(nodes).collect()}
    assert found == {"o": "orphan", "c1": "unreachable", "c2": "unreachable"} | {f"n{k}": "unreachable" for k in range(stats.MAX_DEPTH, 80)}
    moves = spark.createDataFrame([(1, "n1", "n5"), (2, "n5", "n1"), (3, "n5", "c1"), (4, "n2", "n2"), (5, "n2", None)], "move_id int, id string, new_parent_id string")
    assert {r.move_id: r.cycle for r in stats.creates_cycle(nodes, moves).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_vectors_of_many_kinds(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0, 0.0]), (4, [float("nan"), 1.0]), (5, None), (6, [0.0, 0.0]), (7, [])]
    e = spark.createDataFrame(rows, "entry_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0, 2.0]), (3, [float("inf"), 0.0])], "query_id long, embedding array<double>")
    got = [(r.query_id, r.entry_id) for r in retrieval.vector_top_batch(e, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 2), (2, 3)]


def test_vector_cells_recall(spark):
    from heronlake.operators.index import Cells

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("entry_id"), "embedding")
    q = e.where("entry_id % 10 = 0").select(F.col("entry_id").alias("query_id"), "embedding")
    exact = retrieval.vector_top_batch(e, q, 10)
    cells = Cells.fit(e)
    index = cells.assign(e)
    assert index.count() == e.count() and len(cells.centres) == 22
    tuned = cells.calibrate(index, q, exact, 10)
    found = tuned.search(index, q, 10)
    assert found.join(exact, ["query_id", "entry_id"], "left_semi").count() >= 0.9 * exact.count()
    assert Cells(cells.centres, 22).search(index, q, 10).join(exact, ["query_id", "entry_id"], "left_semi").count() == exact.count()


def test_stored_postings_read_only_their_terms(spark, tmp_path):
    from heronlake.operators.index import Postings

    e = spark.createDataFrame([(k, "Common words, and rare" if k % 10 == 0 else f"common word{k}") for k in range(100)], "entry_id long, text string")
    p = Postings.build(e, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "rare common"), (2, "RARE"), (3, "nothing"), (4, "")], "query_id long, query string")
    got = [(r.query_id, r.entry_id, round(r.score, 6)) for r in p.search(q, 3).orderBy("query_id", "rank").collect()]
    want = [(r.query_id, r.entry_id, round(r.score, 6)) for r in retrieval.keyword_top(e, q, 3).orderBy("query_id", "rank").collect()]
    assert got == want and [x[:2] for x in got] == [(1, 0), (1, 10), (1, 20), (2, 0), (2, 10), (2, 20)]
    plan = p.read(retrieval.query_terms(q))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket") and "PushedFilters: [IsNotNull(term)" in plan.replace("In(term", "IsNotNull(term)")


def test_access_options():
    from heronlake.operators.access import RESULT_FIELDS, SearchOptions

    own = SearchOptions(final_k=7)
    assert own.override().final_k == 7 and own.override(many=True).final_k == 50 and own.override(many=True, final_k=90, vector_k=3) == SearchOptions(vector_k=3, final_k=50)
    assert len(RESULT_FIELDS) == 16
    for bad in ({"k": 1}, {"fts_config": "other"}, {"vector_k": 1001}, {"rrf_k": 0}):
        with pytest.raises(ValueError):
            own.override(**bad)


def test_embedder_answers_are_checked(spark):
    from heronlake.operators import embedding

    good = embedding.hashed(8)
    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, None), (4, "c")], "chunk_id long, embedding_content string").coalesce(1)
    out = {r.chunk_id: r for r in embedding.embed(rows, good, 8).collect()}
    assert len(out[1].embedding) == 8 and out[2].embedding_error == out[3].embedding_error == "blank" and out[4].embedding_error is None

    def broken(texts):
        raise TimeoutError

    cases = [(lambda t: [], "count"), (lambda t: [[]] * len(t), "empty"), (lambda t: [[1.0]] * len(t), "dimension"), (lambda t: [[float("nan")] * 8] * len(t), "number"), (lambda t: [[1e39] * 8] * len(t), "number"), (broken, "provider: TimeoutError")]
    for f, why in cases:
        assert {r.embedding_error for r in embedding.embed(rows.where("chunk_id in (1, 4)"), f, 8).collect()} == {why}


class Remote:
    """A small remote tree: one good root, one whose second page fails."""

    def pages(self, root):
        from heronlake.sources.connector import Recoverable

        yield [{"token": f"{root}-f", "title": "Folder"}, {"token": f"{root}-d", "parent_token": f"{root}-f", "title": "Doc", "has_document": True, "edit_time": 1_700_000_000}]
        if root == "bad":
            raise Recoverable("too many calls")
        yield [{"token": f"{root}-e", "has_document": True, "edit_time": 0}]

    def fetch(self, token):
        from heronlake.sources.connector import Recoverable

        if token == "lost":
            raise Recoverable
        return token.encode() * 10


def test_tree_connector(spark):
    from heronlake.sources import connector

    nodes, snapshots = connector.list_tree(spark, "test_operators:Remote", ["good", "bad"])
    assert {(r.token, r.has_document, r.edit_time is None) for r in nodes.where("root = 'good'").collect()} == {("good-f", False, True), ("good-d", True, False), ("good-e", True, True)}
    assert {r.root: (r.n_nodes, r.complete, r.warnings) for r in snapshots.collect()} == {"good": (3, True, []), "bad": (2, False, ["too many calls"])}
    got = {r.token: (r.content, r.problem) for r in connector.fetch(spark.createDataFrame([("ab",), ("abcdef",), ("lost",)], "token string"), "test_operators:Remote", 30).collect()}
    assert got == {"ab": (bytearray(b"ab" * 10), None), "abcdef": (None, "size"), "lost": (None, "recoverable")}


def test_guarded_requests_of_one_target(spark):
    from heronlake.operators import lifecycle

    bases = spark.createDataFrame([("k", "g", 4)], "kb_id string, active_generation_id string, content_version int")
    chunks = spark.createDataFrame([("c", "k", "r1")], "chunk_id string, kb_id string, active_revision_id string")
    entries = spark.createDataFrame([("c", "r1", "published", [1.0], 1, "t", None, None)], "chunk_id string, revision_id string, state string, embedding array<double>, dimension int, search_content string, published_at timestamp, retired_at timestamp")
    asked = spark.createDataFrame([(1, "c", "r1", "r2", 4, False, datetime(2024, 1, 1)), (2, "c", "r1", "r3", 4, False, datetime(2024, 1, 1)), (3, "x", "r1", "r3", 4, False, datetime(2024, 1, 1))], "request_id int, chunk_id string, base_revision_id string, revision_id string, content_version int, enabled boolean, at timestamp")
    b, c, e, out = lifecycle.publish_edits(bases, chunks, entries, asked)
    assert {r.request_id: r.outcome for r in out.collect()} == {1: "published", 2: "conflict", 3: "not_found"}
    assert b.first().content_version == 5 and c.first().active_revision_id == "r2" and e.first().state == "retired" and e.count() == 1


def test_both_escapers_are_one(spark):
    """The column's form gives for every short line of marks what the parsers give, alone and within a text."""
    import itertools

    from heronlake.sources.parsers import escape_line

    lines = ["".join(p) for n in range(5) for p in itertools.product(" \t-+#1.=a", repeat=n)] + ["\\`*_[]<>|~{}", "   - x", "123456789. x", "1234567890. x", "####### x", " = = ", "- - -x", "\u2028- x", "a\r- x"]
    got = {r.t: r.e for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", T.escape_markdown(F.col("t")).alias("e")).collect()}
    assert got == {x: escape_line(x) for x in lines}
    text = "\n".join(lines)
    assert spark.createDataFrame([(text,), (None,)], "t string").select(T.escape_markdown(F.col("t"))).collect() == [("\n".join(map(escape_line, lines)),), (None,)]
