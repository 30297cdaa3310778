"""A source of remote documents as a Spark data source: the listing of a tree, page by page, and the contents with a size limit.

A connector is a class with `pages(root)`, which yields lists of nodes (token, parent_token, title, has_document, edit_time), and `fetch(token)`, which gives bytes. An error that
may pass (Recoverable) ends a folder's listing early, and the snapshot is marked incomplete; any other error ends the query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NODES = "root string, token string, parent_token string, title string, has_document boolean, edit_time timestamp, ordinal long, warning string"


class Recoverable(Exception):
    """An error of a remote source that a later run may not meet: a limit on calls, a time-out."""


class Connector(Protocol):
    def pages(self, root: str) -> Iterator[list[dict]]: ...

    def fetch(self, token: str) -> bytes: ...


def edit_time(node: dict) -> dt.datetime | None:
    """A node's edit time with its zone: seconds (none if not positive) or a time, which is UTC if it has no zone."""
    at = node.get("edit_time")
    if isinstance(at, int | float):
        return dt.datetime.fromtimestamp(at, dt.UTC) if at > 0 else None
    return at.replace(tzinfo=dt.UTC) if at is not None and at.tzinfo is None else at


class _Root(InputPartition):
    def __init__(self, root: str):
        super().__init__(root)
        self.root = root


class TreeListing(DataSource):
    """Format `heronlake_tree`: options connector (module:class) and roots (separated by commas). One task lists one root."""

    @classmethod
    def name(cls) -> str:
        return "heronlake_tree"

    def schema(self) -> str:
        return NODES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def connector_of(name: str) -> Connector:
    """The connector class named as module:class, made anew."""
    import importlib

    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.connector, self.roots = options["connector"], [r.strip() for r in options["roots"].split(",") if r.strip()]

    def partitions(self) -> list[InputPartition]:
        return [_Root(r) for r in self.roots]

    def read(self, partition: _Root) -> Iterator[tuple]:
        n, root = 0, partition.root
        try:
            for page in connector_of(self.connector).pages(root):
                for x in page:
                    at = edit_time(x)
                    yield root, x.get("token"), x.get("parent_token"), x.get("title"), bool(x.get("has_document")), at, n, None
                    n += 1
        except Recoverable as e:
            yield root, None, None, None, False, None, n, str(e) or "listing ended early"


def list_tree(spark, connector: str, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, snapshots): the nodes of all roots, and (root, n_nodes, complete, warnings) of each."""
    spark.dataSource.register(TreeListing)
    rows = spark.read.format("heronlake_tree").option("connector", connector).option("roots", ",".join(roots)).load()
    snapshots = rows.groupBy("root").agg(F.count_if(F.col("warning").isNull()).alias("n_nodes"), (F.count("warning") == 0).alias("complete"), F.collect_list("warning").alias("warnings"))
    return rows.where("warning is null").drop("warning"), snapshots


def fetch(tokens: DataFrame, connector: str, max_bytes: int) -> DataFrame:
    """(token, content, problem) of tokens (token): contents in Arrow batches; problem is size, recoverable, or null. A content beyond max_bytes is dropped, not cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = connector_of(connector)
        for batch in batches:
            for token in batch.column(0).to_pylist():  # a row at a time, so that a task holds one content
                try:
                    content, why = own.fetch(token), None
                except Recoverable:
                    content, why = None, "recoverable"
                if content is not None and len(content) > max_bytes:
                    content, why = None, "size"
                yield pa.RecordBatch.from_arrays([pa.array([token]), pa.array([content], pa.binary()), pa.array([why], pa.string())], ["token", "content", "problem"])

    return tokens.select("token").mapInArrow(run, "token string, content binary, problem string")


def within_size(contents: DataFrame, max_bytes: int) -> DataFrame:
    """Contents that a limit on bytes lets through."""
    return contents.where(F.octet_length("content") <= max_bytes)
