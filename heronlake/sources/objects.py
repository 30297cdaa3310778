"""Stored objects: a Python data source that puts objects by key, and reads or deletes them. Any file system that pyarrow opens (file, hdfs, s3, gs, abfs).

    spark.dataSource.register(ObjectSource)
    contents.write.format("heronlake_objects").option("path", root).mode("append").save()       # key string, content binary
    spark.read.format("heronlake_objects").option("path", root).load()                            # key, size

A task writes its objects under names of its own attempt (`.pending/<attempt>/<n>`); only the commit, which Spark calls once with the messages of the attempts that count, moves them to
their keys. A task that fails half-way, is repeated or runs twice therefore leaves no object. What it left pending is removed by the commit or abort; a task that is still being
stopped while its job aborts may leave pending files after that, which `sweep` removes. Putting the same key again replaces the object whole. Deleting is idempotent.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PENDING = ".pending"
MOST_KEY_BYTES = 1024
#: Keys listed by one task of a reader.
LISTED = 1000


def file_system(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """pyarrow's file system and path of an address as Spark writes it."""
    address = re.sub("^file:/(?!/)", "file:///", re.sub("^s3[an]://", "s3://", address.rstrip("/")))
    return pyarrow.fs.FileSystem.from_uri(address)


def check_key(key: str | None) -> str:
    """A key whose parts name a place below the root."""
    if not key or len(key.encode()) > MOST_KEY_BYTES or key.startswith("/") or "\\" in key or "\0" in key or any(p in ("", ".", "..", PENDING) for p in key.split("/")):
        raise ValueError(f"not a key of an object: {key!r}")
    return key


@dataclass
class Put(WriterCommitMessage):
    """What one task has pending: its folder, and the keys in order."""

    folder: str
    keys: list[str]


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator: Iterator) -> Put:
        system, path = file_system(self.root)
        folder, keys = f"{PENDING}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            if not keys:
                system.create_dir(f"{path}/{folder}", recursive=True)
            key = check_key(row["key"])
            with system.open_output_stream(f"{path}/{folder}/{len(keys)}") as out:
                out.write(bytes(row["content"] or b""))
            keys.append(key)
        return Put(folder, keys)

    def _clear(self) -> None:
        system, path = file_system(self.root)
        if system.get_file_info(f"{path}/{PENDING}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(f"{path}/{PENDING}/{self.job}")

    def commit(self, messages: list[Put | None]) -> None:
        system, path = file_system(self.root)
        for m in filter(None, messages):
            for n, key in enumerate(m.keys):
                system.create_dir(posixpath.dirname(f"{path}/{key}"), recursive=True)
                system.move(f"{path}/{m.folder}/{n}", f"{path}/{key}")
        self._clear()

    def abort(self, messages: list[Put | None]) -> None:
        self._clear()


@dataclass
class Folder(InputPartition):
    """One folder below the root that a task lists."""

    name: str
    deep: bool


class ObjectReader(DataSourceReader):
    """Keys and sizes: the root's folders are listed by a task each."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        system, path = file_system(self.root)
        found = system.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return [Folder("", False), *(Folder(x.base_name, True) for x in found if x.type == pyarrow.fs.FileType.Directory and x.base_name != PENDING)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, path = file_system(self.root)
        found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/{partition.name}".rstrip("/"), allow_not_found=True, recursive=partition.deep))
        files = [(x.path[len(path) :].lstrip("/"), x.size) for x in found if x.type == pyarrow.fs.FileType.File]
        for lo in range(0, len(files), LISTED):
            some = files[lo : lo + LISTED]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["key", "size"])


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heronlake_objects"

    def schema(self) -> str:
        return "key string, size long"

    def reader(self, schema: StructType) -> ObjectReader:
        return ObjectReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are put one by one: use the append mode")
        if not {"key", "content"} <= set(schema.names):
            raise ValueError("objects have a key and a content")
        return ObjectWriter(self.options["path"], uuid.uuid4().hex)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSource)


def put(contents: DataFrame, root: str) -> None:
    """Put objects (key, content). Of rows that share a key in one call any may win, so callers make keys unique."""
    register(contents.sparkSession)
    contents.select("key", "content").write.format("heronlake_objects").option("path", root).mode("append").save()


def sweep(root: str, before: datetime) -> list[str]:
    """Remove what jobs that began before a time (with a zone) have left pending; gives their names."""
    system, path = file_system(root)
    found = system.get_file_info(pyarrow.fs.FileSelector(f"{path}/{PENDING}", allow_not_found=True))
    old = [x for x in found if x.mtime is None or x.mtime < before]
    for x in old:
        system.delete_dir(x.path)
    return sorted(x.base_name for x in old)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(key, size) of all objects."""
    register(spark)
    return spark.read.format("heronlake_objects").option("path", root).load()


def _each(keys: DataFrame, root: str, one, schema: str, kinds: list) -> DataFrame:
    """A row for each key (key string) from one(file system, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(root)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                names = batch.column(0).slice(lo, 64).to_pylist()
                got = [one(system, f"{path}/{check_key(k)}") for k in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(got, kinds)], ["key", schema.split()[0]])

    return keys.select("key").mapInArrow(run, f"key string, {schema}")


def _content(system, path: str) -> bytes | None:
    if system.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    with system.open_input_file(path) as f:
        return f.read()


def _delete(system, path: str) -> bool:
    there = system.get_file_info(path).type == pyarrow.fs.FileType.File
    if there:
        system.delete_file(path)
    return there


def opened(keys: DataFrame, root: str) -> DataFrame:
    """(key, content) of objects; null where there is none."""
    return _each(keys, root, _content, "content binary", pa.binary())


def deleted(keys: DataFrame, root: str) -> DataFrame:
    """Delete objects; (key, deleted), false where there was none. Run once, by an action on the result."""
    return _each(keys, root, _delete, "deleted boolean", pa.bool_())
