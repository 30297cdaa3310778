"""Tables of many workspaces that can be read and changed from within one workspace alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.operators.access import scoped
from heronlake.operators.state import SnapshotStore

#: The partition column of stored tables; its values start with a letter, so that Spark reads them as text.
PARTITION = "_ws"


class ScopeError(ValueError):
    """A table was asked for without a workspace."""


def _name(workspace: int | str) -> str:
    return f"w-{workspace}"


class Tenants:
    """All workspaces' tables under one folder, each partitioned by workspace.

    `load` stores them once for all workspaces. After that there is no way to a table but `within(workspace)`: `table` raises, so a scope can't be forgotten.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, **tables: DataFrame) -> Tenants:
        """Store tables with a column workspace_id (number or text, never null: such a row ends the job). A workspace with very many rows is cut into several files."""
        for name, df in tables.items():
            known = F.when(F.col("workspace_id").isNotNull(), F.concat(F.lit("w-"), F.col("workspace_id").cast("string"))).otherwise(F.raise_error(F.lit(f"a row of {name} has no workspace")))
            df.withColumn(PARTITION, known).hint("rebalance", PARTITION).write.mode("errorifexists").partitionBy(PARTITION).parquet(f"{self.root}/tables/{name}")
        return self

    def table(self, name: str) -> DataFrame:
        raise ScopeError(f"{name} is read from within a workspace")

    def within(self, workspace: int | str | None) -> Workspace:
        if workspace is None or workspace == "" or isinstance(workspace, bool) or not isinstance(workspace, int | str):
            raise ScopeError("a workspace's id is a number or a text that isn't empty")
        return Workspace(self, workspace)


class Workspace:
    """One workspace's view. What it changes is written as new snapshots of its own, all tables of one change at once; other workspaces' files are never touched."""

    def __init__(self, tenants: Tenants, workspace: int | str):
        self.spark, self.root, self.id = tenants.spark, tenants.root, workspace
        self._own = f"{self.root}/changed/{quote(_name(workspace), safe='')}"
        self._store = SnapshotStore(self.spark, f"{self._own}/manifests")

    def _changed(self) -> tuple[str | None, dict[str, str]]:
        """(version, folder of each table that was changed); a row for each table."""
        version = self._store.current()
        return version, {} if version is None else {r["name"]: r["folder"] for r in self._store.read().collect()}

    def _rows(self, name: str, changed: dict[str, str]) -> DataFrame:
        if name in changed:
            return self.spark.read.parquet(changed[name])
        stored = self.spark.read.parquet(f"{self.root}/tables/{name}").where(F.col(PARTITION) == _name(self.id))
        return scoped(stored, self.id).drop(PARTITION)

    def table(self, name: str) -> DataFrame:
        """The workspace's rows of a table; the scan reads its partition alone."""
        return self._rows(name, self._changed()[1])

    def search(self, requests: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        """search.search_requests over the workspace's grants, bases, generations and entries: keys and bases of other workspaces are not found."""
        from heronlake.operators.search import search_requests

        changed = self._changed()[1]
        return search_requests(requests, *(self._rows(n, changed) for n in ("grants", "bases", "generations", "entries")), **options)

    def _arguments(self, args: tuple) -> list:
        """Frames that say whose rows they are give those of this workspace."""
        return [scoped(a, self.id).drop("workspace_id") if isinstance(a, DataFrame) and "workspace_id" in a.columns else a for a in args]

    def run(self, operator: Callable, names: list[str], *args, **options):
        """operator(tables by name, args): the operator sees this workspace's rows, without the column workspace_id."""
        changed = self._changed()[1]
        return operator(*(self._rows(n, changed).drop("workspace_id") for n in names), *self._arguments(args), **options)

    def change(self, operator: Callable, names: list[str], written: list[str], *args, **options) -> list[DataFrame] | dict[str, DataFrame]:
        """Like run, and then the operator's results are the new tables: of a tuple the first ones, by the names written; of a dict those of these names. Gives the other results.

        All tables change at once or none, and only if nobody else has changed the workspace since they were read (else RuntimeError). New rows are of this workspace, whatever the operator does.
        """
        version, changed = self._changed()
        got = operator(*(self._rows(n, changed).drop("workspace_id") for n in names), *self._arguments(args), **options)
        new = {n: got[n] for n in written} if isinstance(got, dict) else dict(zip(written, got, strict=False))
        if len(new) < len(written):
            raise ValueError(f"the operator gives {len(new)} tables, not {len(written)}")
        turn = uuid.uuid4().hex
        for n, df in new.items():
            kind = self._rows(n, changed).schema["workspace_id"].dataType
            df.withColumn("workspace_id", F.lit(self.id).cast(kind)).write.parquet(f"{self._own}/{turn}/{n}")
        folders = {**changed, **{n: f"{self._own}/{turn}/{n}" for n in new}}
        self._store.write(self.spark.createDataFrame(sorted(folders.items()), "name string, folder string"), turn, version)
        return {k: v for k, v in got.items() if k not in new} if isinstance(got, dict) else list(got[len(written) :])
