"""Incremental listing: only what changed, failures hold the watermark back, incomplete listings move nothing."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from heronlake.operators import sync
from heronlake.streaming import tree_changes

#: The file that stands for the remote tree; workers are forked from a daemon, so its place can't be an environment variable of one test.
PLACE = f"/tmp/heronlake-tree-{os.getuid()}.json"


class Remote:
    def pages(self, root):
        from heronlake.sources.connector import Recoverable

        with open(PLACE) as f:
            tree = json.load(f)
        for page in tree.get(root, []):
            if page == "error":
                raise Recoverable("too many calls")
            yield page


def node(token, at, document=True):
    return {"token": token, "parent_token": None, "title": token, "has_document": document, "edit_time": at}


def test_follow(spark, tmp_path):
    def run(tree, failing=(), checkpoint="cp"):
        with open(PLACE, "w") as f:
            json.dump(tree, f)
        seen = []

        def process(nodes, round_):
            rows = nodes.collect()
            seen.extend((r.root, r.token) for r in rows)
            return nodes.select("root", "token", (~F.col("token").isin(*failing, "")).alias("success"))

        tree_changes.follow(spark, "test_tree_changes:Remote", ["r", "s"], f"file://{tmp_path}/state", process, f"{tmp_path}/{checkpoint}").awaitTermination(120)
        return sorted(map(str, (f"{a}:{b}" for a, b in seen))), {k: v // 1_000_000 for k, v in tree_changes.newest_mark(f"file://{tmp_path}/state")[1].items()}

    tree = {"r": [[node("a", 100), node("b", 200)], [node("c", 300), node("d", 0)]], "s": [[node("x", 50)], "error"]}
    assert run(tree) == (["r:a", "r:b", "r:c", "r:d", "s:x"], {"r": 300})  # s is incomplete: no watermark
    assert run(tree) == (["r:d", "s:x"], {"r": 300})  # an unknown time comes each time
    tree["s"] = [[node("x", 50), node("f", 60, document=False)]]
    tree["r"][0][0], tree["r"][1][1] = node("a", 400), node("e", 500)
    assert run(tree, failing=["a"]) == (["r:a", "r:e", "s:f", "s:x"], {"r": 300, "s": 50})  # e is later than a, which failed
    assert run(tree, failing=["e"]) == (["r:a", "r:e", "s:f"], {"r": 400, "s": 50})
    assert run(tree, checkpoint="other") == (["r:e", "s:f"], {"r": 500, "s": 50})  # the marks outlive a checkpoint
    assert run({"r": [], "s": []}) == ([], {"r": 500, "s": 50})
    assert not [x for x in os.listdir(tmp_path / "state") if x.startswith("batch")] and len(os.listdir(tmp_path / "state" / "marks")) <= 2


def test_a_batch_without_its_mark_comes_again(spark, tmp_path):
    """A batch that fails after processing is processed again under its round."""
    with open(PLACE, "w") as f:
        json.dump({"r": [[node("a", 100)]]}, f)
    rounds = []

    def process(nodes, round_):
        rounds.append(round_)
        if len(rounds) == 1:
            raise ValueError("lost")
        return nodes.select("root", "token", F.lit(True).alias("success"))

    for _ in range(3):
        query = tree_changes.follow(spark, "test_tree_changes:Remote", ["r"], f"file://{tmp_path}/state", process, f"{tmp_path}/cp")
        try:
            query.awaitTermination(120)
        except Exception as e:  # noqa: BLE001  the stream's own error
            assert "lost" in str(e)
    assert rounds == [0, 0, 1]


def test_safe_watermarks(spark):
    """As safe_watermark for each root alone."""
    t = lambda n: datetime(2024, 1, n) if n else None
    nodes = [("a", "p", True, t(1)), ("a", "q", True, t(3)), ("a", "q2", True, t(2)), ("b", "p", True, t(4)), ("b", None, True, t(9)), ("b", "", True, t(9)), ("b", "dir", False, t(8)), ("c", "p", True, None), ("d", "p", True, t(5)), ("e", "p", True, t(2))]
    done = [("a", "p", True), ("a", "q", True), ("a", "q2", False), ("b", "p", True), ("b", "p", True), ("c", "p", False), ("d", "p", True), ("e", "p", None), ("zz", "p", False)]
    listed = [("a", None, True), ("b", None, True), ("c", t(7), True), ("d", t(1), False), ("e", t(3), True), ("f", t(6), True), ("g", None, True)]
    n = spark.createDataFrame(nodes, "root string, token string, has_document boolean, edit_time timestamp")
    o = spark.createDataFrame(done, "root string, token string, success boolean")
    s = spark.createDataFrame(listed, "root string, previous timestamp, complete boolean")
    got = {r.root: r.watermark for r in sync.safe_watermarks(n, o, s).collect()}
    assert got == {"a": t(1), "b": t(4), "c": t(7), "d": t(1), "e": t(3), "f": t(6), "g": None}
    for root, previous, complete in listed:
        one = sync.safe_watermark(n.where((F.col("root") == root) & F.col("has_document") & (F.col("token") != "")), o.where(F.col("root") == root), F.lit(previous).cast("timestamp"), complete)
        assert one.first()[0] == got[root]
