"""Grouping of spelling variants: words one edit apart, by a positional q-gram index with a count filter.

1. Words are counted within tasks first: whole Arrow batches are cut into runs of letters at once, and each task sends a
   word once (more often only if its table fills up). Then the counts are added up and written once.
2. Postings. The index is cut into shards that need no view of each other. Let M be the length of the longer word of a
   pair. One edit falls into one third of it, so both words share the other two thirds, one from the start and one from the
   end. For M = its own length, and for M one more, each word therefore goes to three shards, named by M, the third that is left out
   and the rest. A shard with more than BLOCK words is cut into blocks, and pairs of blocks are shards of their own, so that no
   task holds all words of a frequent key.
3. Within a shard, a posting list for each (gram, position, length) holds the words met so far, in order. For a word,
   the lists of its grams, within the position that the two lengths allow, are merged by a heap; one edit destroys at
   most q of the M + q - 1 grams of a word with marked ends, so only words met M - 1 times or more (q = 2) are verified.
   Grams within the shared parts are common to all, so they are counted without lists.
4. A pair is kept in the shard of the third where the words begin to differ, which is one, so no pair counts twice. Each shard
   sends one row for a word (how many near ones, the best of them), and these are added up.
5. Forms are followed by self-joins that double their reach. A form is ten times as frequent as its word, so the
   largest count bounds the number of joins.

Cases: null text has no words; a null doc_id stands as empty text in the fold of a word; repeated rows count as often as they stand;
of equally frequent near words the smallest in code-point order is the form; an empty table gives an empty result; other
columns, whatever their names, are not read. Runs of any length are words (memory follows the longest text of a batch).
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import Written, table

MIN_LENGTH, MIN_COUNT, RATIO, FOLD = 7, 2, 10, 31
#: Entries and bytes that a task's table of counts holds before it is sent on.
MAX_WORDS, MAX_BYTES = 1_000_000, 64 << 20
#: Words of one shard that a task compares at once.
BLOCK = 4096
#: Large shards that are broadcast at most; more are joined.
MAX_BROADCAST = 20_000

#: A-Z to small letters; other bytes stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that begin a letter once A-Z are gone: a-z, and the lead byte of U+00C0 to U+00FF.
_LETTER = np.isin(np.arange(256), [*range(97, 123), 0xC3])


def _crc_table() -> np.ndarray:
    """The remainder of each byte under the CRC-32 polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _runs(texts: list[bytes], min_length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in small letters, and (first byte, end, number of its text) of each run of at least min_length bytes."""
    joined = (b" ".join(texts) + b" ").translate(_LOWER)
    raw = np.frombuffer(joined, np.uint8)
    letter = _LETTER[raw]
    letter[1:] |= (raw[1:] >> 6 == 2) & (raw[:-1] == 0xC3)
    edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= min_length
    start, end = start[long], end[long]
    return joined, start, end, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")


def _folded(joined: bytes, start: np.ndarray, end: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each run after its seed (the CRC-32 of what stands before it)."""
    raw, n = np.frombuffer(joined, np.uint8), end - start
    order = np.argsort(-n, kind="stable")
    at, crc, shorter = start[order], ~seeds[order], -n[order]
    for k in range(int(n.max(initial=0))):
        live = np.searchsorted(shorter, -k, "left")  # runs longer than k bytes stand first
        part = crc[:live]
        crc[:live] = _CRC[(part ^ raw[at[:live] + k]) & 255] ^ (part >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def count_batch(ids: list, texts: list[bytes], into: Counter, min_length: int = MIN_LENGTH, fold: int = FOLD) -> None:
    """Add the words of a batch (UTF-8) to a table. A run whose checksum with its document's id is divisible by `fold` loses a code point."""
    joined, start, end, doc = _runs(texts, min_length)
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = _folded(joined, start, end, seeds[doc])
    hit = crc % fold == 0
    into.update([joined[i:j] for i, j in zip(start[~hit].tolist(), end[~hit].tolist(), strict=True)])
    for i, j, h in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), strict=True):
        word = joined[i:j].decode()
        k = h % len(word)
        into[(word[:k] + word[k + 1 :]).encode()] += 1


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, fold: int = FOLD) -> DataFrame:
    """(word, n): the words of at least min_length code points in all texts of docs (doc_id, text), and how often each stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def full() -> pa.RecordBatch:
            kept = [(w, n) for w, n in ((w.decode(), n) for w, n in held.items()) if len(w) >= min_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [t or b"" for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                count_batch(part.column(0).to_pylist(), texts, held, min_length, fold)
                size += sum(map(len, texts))
                if len(held) > MAX_WORDS or size > MAX_BYTES and sum(map(len, held)) > MAX_BYTES:
                    yield full()
                if size > MAX_BYTES:
                    size = 0
        yield full()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _postings(words: DataFrame) -> DataFrame:
    """(longer, third, rest, word, n): the shards of each word."""
    size = F.length("word")
    shards = []
    for longer in (size, size + 1):
        cuts = [F.lit(0), F.floor(longer / 3).cast("int"), F.floor(2 * longer / 3).cast("int"), longer]
        for t in range(3):
            tail = longer - cuts[t + 1]
            rest = F.concat(F.substring("word", F.lit(1), cuts[t]), F.substring("word", size - tail + 1, tail))
            shards.append(F.struct(longer.alias("longer"), F.lit(t).alias("third"), rest.alias("rest")))
    return words.select(F.explode(F.array(*shards)).alias("shard"), "word", "n").select("shard.*", "word", "n")


def _blocks(postings: DataFrame, block: int) -> DataFrame:
    """Adds (side, lo, hi): shards beyond `block` words are cut into blocks, and each word goes to all pairs of blocks that hold its own."""
    key = ["longer", "third", "rest"]
    large = Written(postings.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block), "large_shards").df
    few = large.count() <= MAX_BROADCAST
    dealt = postings.join(F.broadcast(large) if few else large, key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block).cast("int"), F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*key, "word", "n", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))


def _first_edit(a: str, b: str) -> int | None:
    """Where b differs from a by one replaced character, or lacks one; None if it is not so near."""
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k if k < len(a) and a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:]) else None


class Shard:
    """A positional index of words that share all but one third; each pair met is told to `near`."""

    def __init__(self, longer: int, third: int, near: dict[str, list]):
        self.longer, self.near = longer, near
        self.lo, self.hi = third * longer // 3, (third + 1) * longer // 3
        self.bound = self.hi - self.lo - 1  # of the grams that touch the third, M - 1 less those that don't
        self.lists: dict[tuple[str, int, int], list[int]] = defaultdict(list)
        self.words: list[tuple[str, int, str]] = []

    def parts(self, word: str) -> tuple[str, list[str]]:
        """A word's part within the third, and the grams that touch it."""
        end = len(word) - (self.longer - self.hi)
        marked = f"#{word}#"[self.lo : end + 2]
        return word[self.lo : end], [marked[i : i + 2] for i in range(len(marked) - 1)]

    def add(self, number: int, word: str, n: int, part: str, grams: list[str]) -> None:
        for i, g in enumerate(grams):
            self.lists[g, i, len(word)].append(number)
        self.words.append((word, n, part))

    def probe(self, word: str, n: int, part: str, grams: list[str]) -> None:
        """Merge the lists that may hold near words, and verify those met often enough."""
        own, lists = len(word), self.lists
        if self.bound < 1:  # words under six characters share no gram for certain
            for other in self.words:
                if self.longer in (own, len(other[0])):
                    self.verify(word, n, part, other)
            return
        found = []
        for length, shifts in ((self.longer, (0,) if own == self.longer else (0, 1)), *(((self.longer - 1, (0, -1)),) if own == self.longer else ())):
            found += [x for i, g in enumerate(grams) for s in shifts if (x := lists.get((g, i + s, length)))]
        if not found:
            return
        last, met = -1, 0
        for number in heapq.merge(*found) if len(found) > 1 else found[0]:
            last, met = number, met + 1 if number == last else 1
            if met == self.bound:
                self.verify(word, n, part, self.words[number])

    def verify(self, word: str, n: int, part: str, other: tuple[str, int, str]) -> None:
        word_b, n_b, part_b = other
        long, short = (part, part_b) if len(part) >= len(part_b) else (part_b, part)
        at = _first_edit(long, short)
        if at is None:
            return
        if len(long) != len(short) and at == len(short):  # the words may go on alike into the next third, and count there
            whole = word if len(word) > len(word_b) else word_b
            if self.hi < len(whole) and whole[self.hi] == long[-1]:
                return
        for w, other_word, other_n in ((word, word_b, n_b), (word_b, word, n)):
            seen = self.near.setdefault(w, [0, 0, ""])
            seen[0] += 1
            if other_n > seen[1] or other_n == seen[1] and other_word < seen[2]:
                seen[1:] = other_n, other_word


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (longer, third, rest, lo, hi, side, word): what each shard finds."""
    key: tuple | None = None
    held: list[tuple[str, int, int]] = []
    near: dict[str, list] = {}

    def close() -> None:
        longer, third, _, lo, hi = key
        if len(held) < 2 or all(len(w) < longer for w, _, _ in held):
            return
        shard = Shard(longer, third, near)
        for word, n, side in held:
            part, grams = shard.parts(word)
            if lo == hi or side == hi:
                shard.probe(word, n, part, grams)
            if lo == hi or side == lo:
                shard.add(len(shard.words), word, n, part, grams)

    def told() -> pa.RecordBatch:
        rows = [(w, *x) for w, x in near.items()]
        near.clear()
        cols = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("longer", "third", "rest", "lo", "hi", "word", "n", "side")]
        for longer, third, rest, lo, hi, word, n, side in zip(*cols, strict=True):
            now = (longer, third, rest, lo, hi)
            if now != key:
                if key is not None:
                    close()
                key, held = now, []
            held.append((word, n, side))
        if len(near) > MAX_WORDS // 10:
            yield told()
    if key is not None:
        close()
    yield told()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n), each once, that have others within one edit; best is the most frequent, then the smallest."""
    order = ["longer", "third", "rest", "lo", "hi"]
    dealt = _blocks(_postings(words), block).repartition(*(F.col(c) for c in order)).sortWithinPartitions(*order, "side", "word")
    found = dealt.mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    # the largest count first, then the smallest word: the minimum of (-count, word)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def group(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for written words (word, n)."""
    found = words.join(near_words(words, block), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = Written(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
        "forms",
    ).df
    most = words.agg(F.max("n")).first()[0] or 1
    steps = 0
    while ratio**steps <= most:  # more steps than any chain of forms has
        steps += 1
    jump = formed.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        jump = jump.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))
        reach *= 2
    return formed.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= MIN_COUNT)
    return group(Written(words, "words").df)
