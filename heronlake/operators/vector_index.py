"""A stored index for approximate vector search: cells of near vectors, product-quantised residuals, exact rescoring.

The folder of an index holds, for each dimension of vectors (`d=<n>`):

* `model`: one row with the centres of the cells and the codebooks, fitted on a bounded sample (SAMPLE rows);
* `codes/cell=<c>`: blocks of up to BLOCK entries, each with its id and a code of one byte for each part of PART components: which
  codeword is nearest to that part of its residual (the unit vector less its cell's centre). Every usable row is indexed;
* `vectors/cell=<c>`: the vectors themselves, sorted by id, for rescoring.

A query reads the codes of the `probes` cells nearest to it, other cells are pruned partitions; scores come from a table of 256
products for each part. The best `refine` * k by code are scored again with their own vectors. Another application opens the folder and searches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heronlake.functions.vectors import cosine
from heronlake.operators.ancestry import cut
from heronlake.operators.retrieval import VECTOR_K, top
from heronlake.operators.term_sets import Best

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 4096, 8
PART, WORDS, BLOCK = 4, 256, 4096
#: Queries of a block; entries whose codes are broadcast at most, and queries.
QUERIES, MOST_CODES, MOST_QUERIES = 128, 2_000_000, 100_000
#: Dimensions of vectors in one index at most.
MOST_DIMENSIONS = 16


def unit_rows(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have this dimension, a length and only finite numbers; their unit vectors)."""
    found = [np.asarray(x, float) if x is not None and len(x) == width and None not in x else np.zeros(width) for x in column.to_pylist()]
    v = np.array(found, float).reshape(len(found), width)
    size = np.sqrt((v * v).sum(1))
    good = np.flatnonzero(np.isfinite(size) & (size > 0))
    return good, v[good] / size[good, None]


def _centres(v: np.ndarray, n: int, rounds: int = ROUNDS, unit: bool = False) -> np.ndarray:
    """Means of n groups of near rows; equal draws for equal data. unit: the means have length 1."""
    c = v[np.random.default_rng(0).permutation(len(v))[:n]]
    for _ in range(rounds):
        near = (v @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        total, many = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, v)
        c = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], c)
        if unit:
            size = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(size > 0, c / np.where(size > 0, size, 1), c)
    return c


class Quantiser:
    """Cells, and codewords of the residuals' parts, for vectors of one dimension."""

    def __init__(self, centres: np.ndarray, words: list[np.ndarray]):
        self.centres, self.words, self.width = centres, words, centres.shape[1]
        self.ends = np.cumsum([w.shape[1] for w in words])

    @classmethod
    def fit(cls, v: np.ndarray, cells: int) -> Quantiser:
        centres = _centres(v, min(cells, len(v)), unit=True)
        rest = v - centres[(v @ centres.T).argmax(1)]
        cuts = range(PART, v.shape[1], PART)
        return cls(centres, [_centres(part, min(WORDS, len(v))) for part in np.split(rest, cuts, axis=1)])

    def near(self, v: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-(v @ self.centres.T), axis=1, kind="stable")[:, :many]

    def code(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = np.split(v - self.centres[cell], self.ends[:-1], axis=1)
        return np.stack([(p @ w.T - 0.5 * (w * w).sum(1)).argmax(1).astype(np.uint8) for p, w in zip(rest, self.words, strict=True)], axis=1)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries and the coded vectors of a cell."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for part, w, column in zip(np.split(q, self.ends[:-1], axis=1), self.words, codes.T, strict=True):
            out += (part @ w.T)[:, column]
        return out

    def table(self, v: np.ndarray) -> list[np.ndarray]:
        """Products of each query's parts with all codewords."""
        return [(part @ w.T).astype(np.float32) for part, w in zip(np.split(v, self.ends[:-1], axis=1), self.words, strict=True)]

    @staticmethod
    def coded(table: list[np.ndarray], mine: np.ndarray, centre: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """As scores, of some queries (rows of table) whose products with the cell's centre are known."""
        out = np.repeat(centre[:, None].astype(np.float32), len(codes), axis=1)
        for products, column in zip(table, codes.T, strict=True):
            out += (products if len(mine) == len(products) else products[mine]).take(column, axis=1)
        return out

    def row(self) -> dict:
        return {"width": self.width, "centres": self.centres.tobytes(), "words": [w.tobytes() for w in self.words]}

    @classmethod
    def of(cls, row) -> Quantiser:
        sizes = np.diff([*range(0, row["width"], PART), row["width"]])
        return cls(np.frombuffer(row["centres"]).reshape(-1, row["width"]), [np.frombuffer(w).reshape(-1, s) for w, s in zip(row["words"], sizes, strict=True)])


class VectorIndex:
    """An index folder. `probes` and `refine` are the knobs of recall; `calibrate` sets the probes against exact search."""

    def __init__(self, spark: SparkSession, path: str, probes: int = 8, refine: int = 10):
        self.spark, self.path, self.probes, self.refine = spark, path, probes, refine
        model = spark.read.parquet(f"{path}/model").collect()  # one row a dimension
        self.quantisers = {r["width"]: Quantiser.of(r) for r in model}

    @classmethod
    def build(cls, entries: DataFrame, path: str, by: str | None = None, cells: int | None = None, **knobs) -> VectorIndex:
        """Index entries (entry_id, embedding, [by]). Cells: about the root of the number of rows, if not given."""
        spark = entries.sparkSession
        rows = entries.select("entry_id", "embedding", *([by] if by else [])).where("embedding is not null and size(embedding) > 0")
        sizes = {r["width"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("width")).count().limit(MOST_DIMENSIONS + 1).collect()}
        if len(sizes) > MOST_DIMENSIONS:
            raise ValueError(f"vectors have more than {MOST_DIMENSIONS} dimensions")
        models = []
        for width, n in sorted(sizes.items()):
            own = rows.where(F.size("embedding") == width)
            drawn = own.orderBy(F.xxhash64("entry_id"), F.col("entry_id").cast("string")).limit(SAMPLE).select("embedding").toArrow()
            good, v = unit_rows(drawn["embedding"].combine_chunks(), width)
            if not len(good):
                continue
            q = Quantiser.fit(v, min(cells or max(1, int(n**0.5)), MOST_CELLS))
            models.append(q.row())
            cls._write(own, f"{path}/d={width}", by, q)
        spark.createDataFrame(models, "width int, centres binary, words array<binary>").coalesce(1).write.parquet(f"{path}/model")
        return cls(spark, path, **knobs)

    @staticmethod
    def _write(rows: DataFrame, path: str, by: str | None, q: Quantiser) -> None:
        """One pass codes all rows of a dimension; both tables are dealt by cell and id, so that a large cell is spread over tasks."""
        spark, keep = rows.sparkSession, [f for f in rows.schema if f.name != "embedding"]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
        names = [f.name for f in keep]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, v = unit_rows(batch.column(batch.schema.get_field_index("embedding")), q.width)
                if len(good):
                    cell, at = q.near(v, 1)[:, 0], pa.array(good)
                    codes = pa.array([x.tobytes() for x in q.code(v, cell)], pa.binary())
                    floats = pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).take(at) for n in names), pa.array(cell.astype(np.int32)), codes, floats], [*names, "cell", "code", "unit"])

        coded = rows.select(*names, "embedding").mapInArrow(code, f"{kinds}, cell int, code binary, unit array<float>")
        order = ["cell", *(n for n in names if n != "entry_id"), "entry_id"]
        coded.repartitionByRange("cell", "entry_id").sortWithinPartitions(*order).write.partitionBy("cell").parquet(f"{path}/vectors")
        groups = [f for f in keep if f.name != "entry_id"]
        id_kind = to_arrow_type(rows.schema["entry_id"].dataType)
        arrow = [to_arrow_type(f.dataType) for f in groups]

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, key = [], None

            def close() -> pa.RecordBatch:
                cell, *group = key
                made = [*(pa.array([g], a) for g, a in zip(group, arrow, strict=True)), pa.array([cell], pa.int32()), pa.array([[i for i, _ in held]], pa.list_(id_kind)), pa.array([b"".join(c for _, c in held)], pa.binary())]
                held.clear()
                return pa.RecordBatch.from_arrays(made, [*(g.name for g in groups), "cell", "ids", "codes"])

            for batch in batches:
                cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("cell", *(g.name for g in groups), "entry_id", "code")]
                for *now, entry, c in zip(*cols, strict=True):
                    if held and (now != key or len(held) == BLOCK):
                        yield close()
                    key = now
                    held.append((entry, c))
            if held:
                yield close()

        # an own schema: a partition column is read back as an int, whatever it was
        stored = spark.read.schema(coded.schema).parquet(f"{path}/vectors")
        kinds = "".join(f"`{g.name}` {g.dataType.simpleString()}, " for g in groups)
        table = stored.drop("unit").repartitionByRange("cell", "entry_id").sortWithinPartitions(*order).mapInArrow(blocks, f"{kinds}cell int, ids array<{rows.schema['entry_id'].dataType.simpleString()}>, codes binary")
        table.write.partitionBy("cell").parquet(f"{path}/codes")

    def codes(self, width: int, cells: list[int]) -> DataFrame:
        """The blocks of some cells: only their partitions are read."""
        stored = self.spark.read.parquet(f"{self.path}/d={width}/codes")
        return stored if len(cells) == len(self.quantisers[width].centres) else stored.where(F.col("cell").isin(cells))

    def asked(self, queries: DataFrame, width: int, probes: int | None = None) -> DataFrame:
        """(query_id, cell, vector): each query of that dimension, once for each cell that it probes."""
        q, many = self.quantisers[width], probes or self.probes
        kind = queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, v = unit_rows(batch.column(1), width)
                if len(good):
                    near = q.near(v, many)
                    at = np.repeat(np.arange(len(good)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good[at])), pa.array(near.reshape(-1).astype(np.int32)), pa.array([v[k].tobytes() for k in at], pa.binary())], ["query_id", "cell", "vector"])

        return queries.select("query_id", "embedding").where(F.size("embedding") == width).mapInArrow(run, f"query_id {kind}, cell int, vector binary")

    def _probed(self, queries: DataFrame, width: int) -> list[int]:
        """The cells that any query probes, at most MOST_CELLS numbers; a job of its own, where some may be spared."""
        q, many = self.quantisers[width], self.probes
        if many >= len(q.centres):
            return list(range(len(q.centres)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(q.centres), bool)
            for batch in batches:
                seen[np.unique(q.near(unit_rows(batch.column(0), width)[1], many))] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32))], ["cell"])

        asked = queries.select("embedding").where(F.size("embedding") == width).mapInArrow(run, "cell int")
        return sorted(r["cell"] for r in asked.distinct().collect())

    def _one(self, queries: DataFrame, width: int, k: int, by: str | None) -> DataFrame:
        """Blocks of queries meet blocks of codes; a task keeps the best of each query, so what is shuffled follows the queries alone while the codes are few enough to be broadcast."""
        cells = self._probed(queries, width)
        blocks = self.codes(width, cells)
        groups, want, many = [by] if by else [], self.refine * k, self.probes
        q, kinds = self.quantisers[width], {n: blocks.schema[n].dataType for n in groups}
        id_kind, q_kind = blocks.schema["ids"].dataType.elementType, queries.schema["query_id"].dataType
        arrow, arrow_id, arrow_q = [to_arrow_type(kinds[g]) for g in groups], to_arrow_type(id_kind), to_arrow_type(q_kind)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good, v = unit_rows(batch.column(1), width)
                for lo in range(0, len(good), QUERIES):
                    ids = batch.column(0).take(pa.array(good[lo : lo + QUERIES]))
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v[lo : lo + QUERIES].tobytes()], pa.binary())], ["q_ids", "q_vectors"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, seen, held = ["query_id", *groups, "entry_id", "rough"], None, None
            for batch in batches:
                col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                for r in range(batch.num_rows):
                    if (now := (col("q_ids")[r].values.to_pylist(), col("q_vectors")[r].as_py())) != seen:
                        if held is not None:
                            yield from held.given()
                        seen, held = now, Best(want, pa.array(now[0], arrow_q), arrow_id, arrow, names)
                        v = np.frombuffer(now[1]).reshape(len(now[0]), -1)
                        probes = np.zeros((len(v), len(q.centres)), bool)
                        np.put_along_axis(probes, q.near(v, many), True, axis=1)
                        to_centres, table = v @ q.centres.T, q.table(v)
                    cell, ids = col("cell")[r].as_py(), col("ids")[r].values
                    mine = np.flatnonzero(probes[:, cell])
                    if not len(mine):
                        continue
                    rough = q.coded(table, mine, to_centres[mine, cell], np.frombuffer(col("codes")[r].as_py(), np.uint8).reshape(len(ids), -1))
                    group = int(held.codes([col(g).slice(r, 1) for g in groups], 1)[0])
                    least = held.least_of(mine, group)
                    if want < len(ids) and np.isinf(least).any():
                        least = np.maximum(least, np.partition(rough, -want, axis=1)[:, -want])
                    number, at = np.nonzero(rough >= least[:, None])
                    held.add(mine[number], np.full(len(number), group), ids.take(pa.array(at)), rough[number, at].astype(float))
                    if held.rows > 4 * want * len(v) * len(held.groups):
                        held.cut()
            if held is not None:
                yield from held.given()

        columns = "".join(f"`{g}` {kinds[g].simpleString()}, " for g in groups)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        asked = queries.select("query_id", "embedding").where(F.size("embedding") == width).mapInArrow(pack, f"q_ids array<{q_kind.simpleString()}>, q_vectors binary").repartition(parts)
        n = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
        pairs = asked.crossJoin(F.broadcast(blocks) if n <= MOST_CODES else blocks).select(*groups, "cell", "ids", "codes", "q_ids", "q_vectors")
        found = pairs.mapInArrow(score, f"query_id {q_kind.simpleString()}, {columns}entry_id {id_kind.simpleString()}, rough double")
        few = top(found, ["query_id", *groups], [F.desc("rough"), "entry_id"], want, "place").drop("place", "rough")
        vectors = self.spark.read.parquet(f"{self.path}/d={width}/vectors")
        vectors = (vectors if len(cells) == len(q.centres) else vectors.where(F.col("cell").isin(cells))).select("entry_id", "unit")
        own = queries.select("query_id", "embedding").where(F.size("embedding") == width)
        own = F.broadcast(own) if own.count() <= MOST_QUERIES else own
        exact = few.join(vectors, "entry_id").join(own, "query_id").withColumn("score", cosine(F.col("unit"), F.col("embedding")))
        return top(exact.drop("unit", "embedding"), ["query_id", *groups], [F.desc(F.round("score", 9)), "entry_id"], k)

    def search(self, queries: DataFrame, k: int = VECTOR_K, by: str | None = None) -> DataFrame:
        """(query_id, [by], entry_id, score, rank), as retrieval.vector_top_batch, of the probed cells."""
        out = None
        for width in sorted(self.quantisers):
            one = self._one(queries, width, k, by)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("the index holds no vectors")
        return out

    def _reaching(self, queries: DataFrame, exact: DataFrame, least: float) -> int:
        """The fewest probes whose cells hold so many of the exact results: counts by the place of an entry's cell among its query's nearest."""
        reached = np.zeros(max(len(q.centres) for q in self.quantisers.values()), np.int64)
        for width, q in self.quantisers.items():

            def run(batches: Iterator[pa.RecordBatch], q: Quantiser = q) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    good, v = unit_rows(batch.column(0), q.width)
                    cell, s = batch.column(1).to_numpy()[good], v @ q.centres.T
                    own = s[np.arange(len(s)), cell][:, None]
                    before = (s > own) | ((s == own) & (np.arange(s.shape[1]) < cell[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(before.sum(1).astype(np.int32))], ["place"])

            stored = self.spark.read.parquet(f"{self.path}/d={width}/vectors").select("entry_id", "cell")
            own = queries.select("query_id", "embedding").where(F.size("embedding") == width)
            for r in exact.join(stored, "entry_id").join(own, "query_id").select("embedding", "cell").mapInArrow(run, "place int").groupBy("place").count().collect():
                reached[r["place"]] += r["count"]
        enough = np.flatnonzero(np.cumsum(reached) >= least)
        return int(enough[0]) + 1 if len(enough) else len(reached)

    def calibrate(self, queries: DataFrame, exact: DataFrame, k: int = VECTOR_K, recall: float = 0.9) -> VectorIndex:
        """The index with few probes whose results hold this share of the exact ones (query_id, entry_id): as many as reach the cells of so many, then twice as many until a search shows it; where all cells don't, `refine` grows."""
        exact = cut(exact.select("query_id", "entry_id"))
        want, most = exact.count(), max(len(q.centres) for q in self.quantisers.values())
        probes, refine = self._reaching(queries, exact, recall * want), self.refine
        while True:
            tried = VectorIndex(self.spark, self.path, min(probes, most), refine)
            if tried.search(queries, k).join(exact, ["query_id", "entry_id"], "left_semi").count() >= recall * want or refine > 1000:
                return tried
            probes, refine = (2 * probes, refine) if probes < most else (most, 4 * refine)
