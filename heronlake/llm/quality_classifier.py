"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits or of other signs. Features are hashed into BUCKETS: tokens, pairs of
neighbours (a token that repeats the one before it makes one common pair), and pairs of token shapes. A document's feature has the value count / sqrt(all
features), and its score is the logistic function of a sparse dot product.

The model is fitted on a bounded sample: the SAMPLE labelled rows of the training folds whose ids have the smallest
hashes, in that order, EPOCHS times, in one task (the updates are sequential). Its size is fixed by BUCKETS.

Cases: null or empty text scores the model's bias; null labels are not learnt; where a document has several labels the
smallest counts, where an id has several texts the smallest is learnt; without a training row every score is 0.5; repeated rows give repeated results; an empty table gives
an empty result; a row without an id is in no fold (not held out, nothing is learnt from it); other columns are not read. A very long text needs
memory in proportion to its tokens, beside a worker's table of tokens, which is bounded by tokens and bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import fold, map_batches, table

BUCKETS = 1 << 20
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Tokens and bytes that a worker remembers at most (the table starts anew when it is full), and the length of tokens that are kept.
MAX_TOKENS, MAX_BYTES, LONG = 600_000, 96 << 20, 64
_TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")


def _shape(token: str) -> str:
    if not token[0].isalnum():
        return token[:2]
    return "0" if token[0].isdigit() else "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"


class Hasher:
    """Feature buckets of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.held = 0

    def _code(self, token: str) -> int:
        """Upper half: hash of the token; lower half: hash of its shape."""
        return zlib.crc32(token.encode()) << 32 | zlib.crc32(_shape(token).encode())

    def features(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.empty(0, np.int64)
        if len(self.known) > MAX_TOKENS or self.held > MAX_BYTES:
            self.known, self.held = {}, 0
        known = self.known
        fresh = set(tokens).difference(known)
        for t in fresh:
            known[t] = self._code(t)
        self.held += 4 * len("".join(fresh))  # a character has four bytes at most
        code = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        for t in [t for t in fresh if len(t) > LONG]:  # tokens that hardly come again aren't kept
            del known[t]
        word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        pair = np.where(word[:-1] == word[1:], np.uint64(7), (word[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ word[1:] + np.uint64(1))
        shapes = (shape[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ shape[1:] + np.uint64(2)
        mixed = np.concatenate((word, pair, shapes)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - 20)).astype(np.int64)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after follow-the-regularised-leader updates over the examples (features, label)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    ready = []
    for features, label in examples:
        index, count = np.unique(features, return_counts=True)
        ready.append((np.append(index, BUCKETS), np.append(count / np.sqrt(max(len(features), 1)), 1.0), label))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for index, value, label in ready:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - label) * value
            more = ni + g * g
            z[index] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[index] = more
    w = weights(z, n)
    return w[:BUCKETS].astype(np.float32), float(w[BUCKETS])


def train(docs: DataFrame, labels: DataFrame, learnable, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Model from labelled rows. docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    known = labels.where(F.col("label").isin(0, 1) & learnable).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))  # at most `sample` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        examples = [(hasher.features(t), y) for b in batches for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        w, bias = fit(examples) if examples else (np.zeros(BUCKETS, np.float32), 0.0)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([w[used].tobytes()], pa.binary()), pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([bias])], ["weights", "used", "bias"])

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(run, "weights binary, used binary, bias double").first()
    weights = np.zeros(BUCKETS, np.float32)
    if got is None:
        return weights, 0.0
    weights[np.frombuffer(got["used"], np.int32)] = np.frombuffer(got["weights"], np.float32)
    return weights, got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score)"""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers of 4 bytes

    def make():
        weights, bias = shared.value
        hasher = Hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in batch.column(1).to_pylist():
                f = hasher.features(t)
                out.append(bias + (float(weights[f].sum(dtype=np.float64)) / np.sqrt(len(f)) if len(f) else 0.0))
            p = 1 / (1 + np.exp(-np.clip(np.array(out), -500, 500)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = score(docs, train(docs, labels, fold("doc_id", 3) != 1))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
