"""Stored objects: put, open, list and delete; failed and repeated tasks."""

import os
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from heronlake.sources import objects


def files(root):
    return sorted(os.path.relpath(f"{d}/{f}", root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_put_open_list_delete(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(f"ws/{k % 3}/doc{k}.bin", bytes([k]) * k) for k in range(30)] + [("top", b"x"), ("empty", None)]
    objects.put(spark.createDataFrame(rows, "key string, content binary").repartition(4), root)
    want = {k: v or b"" for k, v in rows}
    assert files(f"{tmp_path}/store") == sorted(want)
    assert {r.key: r.size for r in objects.listed(spark, root).collect()} == {k: len(v) for k, v in want.items()}
    keys = spark.createDataFrame([(k,) for k in [*want, "none/at/all"]], "key string")
    assert {r.key: None if r.content is None else bytes(r.content) for r in objects.opened(keys, root).collect()} == want | {"none/at/all": None}
    objects.put(spark.createDataFrame([("top", b"again")], "key string, content binary"), root)
    assert bytes(objects.opened(keys.where("key = 'top'"), root).first().content) == b"again"
    gone = keys.where("key like 'ws/1/%' or key like 'none%'")
    assert {r.key: r.deleted for r in objects.deleted(gone, root).collect()} == {k: True for k in want if k.startswith("ws/1/")} | {"none/at/all": False}
    assert not any(r.deleted for r in objects.deleted(gone, root).collect())
    assert files(f"{tmp_path}/store") == sorted(k for k in want if not k.startswith("ws/1/"))


@pytest.mark.parametrize("bad", ["/abs", "a/../b", "", "a//b", "a\\b", ".pending/x", None])
def test_a_failed_put_leaves_nothing(spark, tmp_path, bad):
    """One bad key among many fails the put: no object of any task is there, and what tasks left while they were stopped can be swept."""
    root = f"file://{tmp_path}/store"
    rows = spark.range(40).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="not a key"):
        objects.put(rows.unionByName(spark.createDataFrame([(bad, b"y")], "key string, content binary")).repartition(4), root)
    assert objects.listed(spark, root).count() == 0 and all(f.startswith(".pending/") for f in files(f"{tmp_path}/store"))
    assert objects.sweep(root, datetime(2020, 1, 1, tzinfo=UTC)) == []
    time.sleep(1)  # for tasks that are being stopped
    objects.sweep(root, datetime.now(UTC))
    assert files(f"{tmp_path}/store") == []


def test_a_repeated_task_counts_once(tmp_path):
    """Of two attempts of a task only the committed one's objects move; what the other left goes."""
    writer = objects.ObjectWriter(f"file://{tmp_path}", "job")
    lost, kept = (writer.write(iter([{"key": "a", "content": c}, {"key": "b", "content": c}])) for c in (b"lost", b"kept"))
    assert lost.folder != kept.folder and all(f.startswith(".pending/") for f in files(tmp_path))
    writer.commit([kept, None])
    assert files(tmp_path) == ["a", "b"] and (tmp_path / "a").read_bytes() == b"kept"
