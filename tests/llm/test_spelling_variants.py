"""Spelling variants against brute force: counts, near words, forms and roots, and odd inputs."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from heronlake.llm import registry, spelling_variants
from heronlake.llm.common import Written, table

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def slow_counts(rows, min_length=7, fold=31):
    out = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % fold == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            if len(low) >= min_length:
                out[low] += 1
    return out


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def slow_group(counts, ratio=10):
    """Near words by all words that lack one character: two words are near if one is such a word of the other, or both share one at the same place."""
    lacking = collections.defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            lacking[w[:k], w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            near[w] |= lacking[w[:k], w[k + 1 :]] - {w}
            if w[:k] + w[k + 1 :] in counts:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query(spark):
    got = as_dict(registry.QUERIES["op12_spelling_variants"](spark, SF))
    counts = slow_counts((r.doc_id, r.text) for r in table(spark, SF, "documents").collect())
    want = slow_group({w: n for w, n in counts.items() if n >= 2})
    assert got == want and sum(x[0] is not None for x in want.values()) >= 10


def words_frame(spark, counts):
    return Written(spark.createDataFrame(sorted(counts.items()), "word string, n long"), "test_words").df


@pytest.mark.parametrize("letters, sizes, block", [("ab", (7, 9), 4096), ("ab", (7, 9), 5), ("aàÿ", (7, 8), 16), ("ab", (4, 6), 4096), ("abcdefghij", (12, 14), 3)])
def test_near_words(spark, letters, sizes, block):
    """Few letters bring repeats, where an edit has many places; small blocks split every shard."""
    draw = random.Random(block + sizes[0])
    words = {"".join(draw.choices(letters, k=draw.randint(*sizes))) for _ in range(250)}
    if len(letters) == 10:  # far apart but for planted variants
        words |= {w[:k] + c + w[k + d :] for w in list(words)[:60] for k, c, d in [(draw.randrange(len(w)), draw.choice(["", "x"]), draw.randint(0, 1))]}
    counts = {w: draw.choice([2, 3, 25, 400, 5000]) for w in sorted(words)}
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling_variants.near_words(words_frame(spark, counts), block).collect()}
    best = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in near.items() if x}
    assert got == {w: (len(near[w]), counts[b], b) for w, b in best.items()}
    assert as_dict(spelling_variants.group(words_frame(spark, counts), block=block)) == slow_group(counts)


def test_long_chain_of_forms(spark):
    counts = {"a" * 7 + "b" * k: 10**k for k in range(12)}
    got = as_dict(spelling_variants.group(words_frame(spark, counts)))
    assert got == slow_group(counts) and got["aaaaaaa"][1] == "a" * 7 + "b" * 11


def test_odd_inputs(spark):
    long = "x" * 3000
    rows = [(1, None), (2, ""), (3, "Straßenbahn STRASSENBAHN naïveté×÷ĀĀabcdefgh"), (3, "Straßenbahn STRASSENBAHN naïveté×÷ĀĀabcdefgh"), (None, "strassenbahn " * 40), (4, f"{long} {long}y"), (5, "日本語 ¿ß? 😀 a-b c_d éèÿÀÞþð")]
    docs = spark.createDataFrame([(*r, "w", 9, "l") for r in rows], "doc_id long, text string, word string, n long, longer string")
    got = {r.word: r.n for r in spelling_variants.word_counts(docs).collect()}
    assert got == slow_counts(rows) and sum(got.values()) > 40
    every = {r.word: r.n for r in spelling_variants.word_counts(docs, 1, 2).collect()}
    assert every == slow_counts(rows, 1, 2)
    none = docs.where("false")
    words = Written(spelling_variants.word_counts(none), "test_words").df
    assert spelling_variants.group(words).count() == 0
    assert as_dict(spelling_variants.group(words_frame(spark, got))) == slow_group(got)


def test_tables_that_fill_up(spark, monkeypatch):
    """A task that sends its table on early counts the same."""
    monkeypatch.setattr(spelling_variants, "MAX_WORDS", 10)
    docs = table(spark, SF, "documents")
    got = {r.word: r.n for r in spelling_variants.word_counts(docs.repartition(2)).collect()}
    assert got == slow_counts((r.doc_id, r.text) for r in docs.select("doc_id", F.col("text")).collect())
