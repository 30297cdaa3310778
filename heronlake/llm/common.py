"""Helpers shared by the operators: table paths, written tables that cut lineage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII characters that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where it is unset (a local session, as in tests) is a local folder made, once a session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='heronlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """A table written to the shared folder: its lineage is cut and it outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema
        if Scratch.open:
            Scratch.open[-1].tables.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing that is still to run may read them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Owner of the tables written within it (`with Scratch() as own`): at its end all are deleted but those it is told to keep."""

    open: list[Scratch] = []

    def __init__(self):
        self.tables: list[Written] = []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def keep(self, table: Written) -> Written:
        self.tables.remove(table)
        return table

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)
        for t in self.tables:
            t.drop()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with one set-up a task: make() returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for lo in range(0, batch.num_rows, 1000):
                    yield step(batch.slice(lo, 1000))

    return df.mapInArrow(run, schema)


def fold(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod: the fold of a row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod
