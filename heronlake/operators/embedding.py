"""Embedding as a port: a function of texts in Arrow batches, and checks of what it gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts to vectors, in order. Called once a batch in each task.
Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 64
#: The largest number of single precision.
MOST = float(np.finfo(np.float32).max)


def problem(texts: list[str], vectors: list[list[float]], dimension: int) -> str | None:
    """What is wrong with an embedder's answer: count, empty, dimension or number; None if nothing is."""
    if len(vectors) != len(texts):
        return "count"
    for v in vectors:
        if not v:
            return "empty"
        if len(v) != dimension:
            return "dimension"
        if not all(x is not None and abs(x) <= MOST for x in v):
            return "number"
    return None


def embed(chunks: DataFrame, embedder: Embedder, dimension: int, text_col: str = "embedding_content", batch: int = BATCH) -> DataFrame:
    """chunks with embedding (array of floats) and embedding_error: a batch whose answer breaks the contract, or whose call fails, has no vectors and says why.

    Blank texts aren't sent; their error is `blank`. Nothing is shuffled; a task sends its rows in batches of the given size.
    """
    cols = [c for c in chunks.columns if c not in ("embedding", "embedding_error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for lo in range(0, given.num_rows, batch):
                part = given.slice(lo, batch)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                sent = [k for k, t in enumerate(texts) if t and t.strip()]
                why, vectors = None, []
                try:
                    vectors = embedder([texts[k] for k in sent]) if sent else []
                    why = problem([texts[k] for k in sent], vectors, dimension)
                except Exception as e:  # a provider's fault is its rows' error
                    why = f"provider: {type(e).__name__}"
                out: list = [None] * len(texts)
                error: list = ["blank"] * len(texts)
                for n, k in enumerate(sent):
                    out[k], error[k] = (None, why) if why else (vectors[n], None)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in cols), pa.array(out, pa.list_(pa.float32())), pa.array(error, pa.string())], [*cols, "embedding", "embedding_error"])

    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in cols)
    return chunks.select(*cols).mapInArrow(run, f"{schema}, embedding array<float>, embedding_error string")


def hashed(dimension: int) -> Embedder:
    """A deterministic embedder for tests: unit vectors of hashed words."""
    import zlib

    def of(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h >> 31 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else np.eye(dimension)[0]).tolist())
        return out

    return of


def query_groups(bases: DataFrame) -> DataFrame:
    """(provider, model_id, model_name, dimension, config_hash, kb_ids, n): bases of one embedding snapshot share one query embedding. bases: kb_id and the five."""
    keys = ["provider", "model_id", "model_name", "dimension", "config_hash"]
    return bases.groupBy(*keys).agg(F.sort_array(F.collect_set("kb_id")).alias("kb_ids"), F.count_distinct("kb_id").alias("n"))
