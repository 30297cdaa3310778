"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (one to three letters; words are set between
spaces), most frequent first. A document's own most frequent n-grams are compared with each profile by out-of-place distance: the sum
over them of the difference of ranks, or PROFILE for those that the profile lacks. The nearest language wins.

Profiles are learnt from a bounded sample: in each language the PER_LANGUAGE learnable documents whose ids
have the smallest hashes. Their n-gram counts are summed by Spark; PROFILE rows a language reach the driver.

Counting is vectorised in Arrow batches: three letters of 21 bits each fit one 64-bit number, so no n-gram is hashed.

Cases: null text, or one without a letter, gives `und` with score 0; a row without an id is in no fold (not held out, nothing is learnt from it); of rows that repeat an id and language the smallest text is learnt; equal counts rank the smaller n-gram code first, equal
distances the language that sorts first; null languages are not learnt; of learnt rows bytes that aren't UTF-8 count as U+FFFD; without any learnable row all is `und`;
repeated rows give repeated results; an empty table gives an empty result; other columns are not read. Very long
texts are counted in parts of PART letters, each n-gram once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import Written, fold, map_batches, table

PROFILE = 400
DOCUMENT = 300
PER_LANGUAGE = 1000
PART = 1 << 20
#: Rows (ids of the sample, or counts of languages) that are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 200_000


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as numbers, and how often each occurs."""
    low = (text or "").lower()
    found: list[np.ndarray] = []
    times: list[np.ndarray] = []
    for lo in range(0, len(low), PART):  # parts overlap by two letters; n-grams belong to the part they start in
        chars = np.frombuffer(low[max(lo - 1, 0) : lo + PART + 2].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        chars = np.where(_letters()[chars], chars, 32)
        if lo == 0:
            chars = np.concatenate(([32], chars))
        if lo + PART + 2 >= len(low):
            chars = np.concatenate((chars, [32, 32]))
        n = min(PART + 1, len(chars) - 2) if lo + PART < len(low) else len(chars) - 2
        a, b, c = chars[:n], chars[1 : n + 1], chars[2 : n + 2]
        if lo:
            a, b, c = a[1:], b[1:], c[1:]
        one = a[a != 32]
        two = ((a << 21) | b)[(a != 32) | (b != 32)]
        three = ((a << 42) | (b << 21) | c)[b != 32]
        g, k = np.unique(np.concatenate((one, two, three)), return_counts=True)
        found.append(g)
        times.append(k)
    if len(found) == 1:
        return found[0], times[0]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g, where = np.unique(np.concatenate(found), return_inverse=True)
    return g, np.bincount(where, np.concatenate(times)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, many: int) -> np.ndarray:
    """The `many` most frequent n-grams, most frequent first."""
    if len(grams) > 4 * many:  # those that cannot be among them go first
        keep = counts >= np.partition(counts, len(counts) - many)[len(counts) - many]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:many]]


class Profiles:
    """Profiles of languages, as one table of n-grams with a row of ranks for each."""

    def __init__(self, by_language: dict[str, list[int]]):
        self.languages = sorted(by_language)
        self.grams = np.unique(np.array([g for x in by_language.values() for g in x], np.int64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.grams, by_language[name])] = np.arange(len(by_language[name]))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, similarity): score says how far the nearest is from the next, similarity how near it is."""
        if not self.languages:
            return "und", 0.0, 0.0
        own = ranked(*gram_counts(text), DOCUMENT)
        if not len(own):
            return "und", 0.0, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        rank = self.ranks[:, at]
        far = np.where(rank < 0, PROFILE, np.minimum(np.abs(rank - np.arange(len(own))), PROFILE)).sum(axis=1) / (PROFILE * len(own))
        best = int(far.argmin())
        rest = np.delete(far, best).min() if len(far) > 1 else 1.0
        return self.languages[best], float(1 - far[best] / rest) if rest > 0 else 0.0, float(1 - far[best])


def learn(docs: DataFrame, learnable, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from the learnable rows of docs (doc_id, text, lang)."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # a threshold on the uniform hash leaves about 1.5 * per_language ids a language, so that no language's ids meet in one task
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("n"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("most"))
    sizes = Written(sizes, "sizes").df
    if sizes.count() <= MOST_BROADCAST:  # one row a language: the other side isn't shuffled by language
        sizes = F.broadcast(sizes)
    few = known.join(sizes, "lang").where(F.col("h").cast("double") <= F.col("most"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = Written(few.withColumn("k", first).where(F.col("k") <= per_language).select("doc_id").distinct(), "chosen").df
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).join(chosen, "doc_id", "left_semi")
    rows = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # a repeated id is one document
    rows = rows.select(*(F.make_valid_utf8(c).alias(c) for c in ("lang", "text")))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for lang in set(batch.column(0).to_pylist()):
                texts = [t for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x == lang]
                g, k = gram_counts("\n".join(t or "" for t in texts))
                langs += [lang] * len(g)
                grams.append(g)
                counts.append(k)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

        return step

    total = map_batches(rows, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = total.withColumn("rank", top).where(F.col("rank") <= PROFILE).select("lang", "gram", "rank").collect()
    by: dict[str, list[int]] = {}
    for r in sorted(kept, key=lambda r: (r["lang"], r["rank"])):
        by.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score, similarity)"""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE rows a language

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, near = zip(*map(own.predict, batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(near)], ["doc_id", "lang_pred", "score", "similarity"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double, similarity double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, learn(docs, fold("doc_id", 5) != 0))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "similarity")


def keep(docs: DataFrame, profiles: Profiles, min_similarity: float) -> DataFrame:
    """The rows of docs whose text is in one of the profiles' languages, in one pass over them."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            good = [lang != "und" and near >= min_similarity for lang, _, near in map(own.predict, texts)]
            return batch.filter(pa.array(good))

        return step

    return map_batches(docs, make, docs.schema)
