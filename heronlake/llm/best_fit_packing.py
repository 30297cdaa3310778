"""Best-fit packing of documents into sequences, by linear grouping.

1. Every document is tokenised (whole), closed with the end id and cut into pieces of one sequence's length.
   The pieces (ids stay behind, their lengths and checksums go on) are written once to the shared folder.
2. Only the histogram of piece lengths goes to the driver: one count for each length and salt. A length has up to SALTS salts, and more beyond PER_SALT pieces for each.
3. The plan is made on the histogram. Large lengths are sorted and cut into groups of equal cardinality, and
   each is rounded up to its group's largest. For these few sizes, configurations (how many of each size fill a
   sequence) are optimised as a linear programme by column generation, whole multiples are taken and the rest
   is packed by best fit. The slots of each configuration then take actual lengths, largest first; the last two slots take
   the pair of lengths that leaves the least room, so what rounding up lost is found again. Small lengths go, largest first, to the sequences with the tightest room that holds them.
   The plan lists, for each length, ranges of ranks and the sequences that they fill; its size
   follows the number of lengths and configurations, not of documents.
4. Each piece gets its rank among those of its length: a row number within (length, salt of the document id and piece) plus the
   counts of the salts before, so a length that holds a third of all pieces is spread over as many tasks as it needs.
   The rank looks up its place in the plan.

Cases: null text counts as empty (one piece, the end id alone); ties rank by document id and piece; rows that repeat a
document id get one place each; an empty table gives an empty result; other columns are not read; a very long text needs
memory in proportion to its own length, beside the word tables of a worker, which are bounded by words and bytes.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import Written, map_batches, table
from heronlake.llm.words import coded_together, column, gather, holding, marked, split

LENGTH = 2048
END_ID = 0
#: Salts of a frequent length at least (a rare one has fewer), and pieces of one length that one task ranks at most, about.
SALTS, PER_SALT = 64, 200_000
#: A worker remembers the words of its last tables, two of about so many words each.
MAX_WORDS = 900_000
#: Bytes that one of the two tables holds at most, and the length of words that are kept.
MAX_BYTES, LONG = 128 << 20, 64


class WordCoder:
    """Ids of texts as bytes (little-endian unsigned 32-bit), through a table of words.

    The vocabulary's rules never join characters across a space or line feed, so a text's ids are its words' ids in a row. A
    text that may hold a special token's string goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = sorted({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        if self.library.encode("a b\nc", add_special_tokens=False).ids != [i for w in "abc" for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this vocabulary keeps white space")
        self.ends = marked(self.library, lambda t: t.endswith("</w>"))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    @staticmethod
    def _small(parts: list[str]) -> list[str]:
        """Parts in small letters, with a space before each."""
        joined = "\n".join(parts)
        low = joined.lower().split("\n")
        if "Σ" in joined or "İ" in joined:  # their small letters depend on what stands around
            low = [p if "Σ" in p or "İ" in p else x for p, x in zip(parts, low, strict=True)]
        return [x if x[:1] == " " else f" {x}" for x in low]

    def _coded(self, words: list[str]) -> dict[str, bytes]:
        """The library's ids of words. Those of letters alone (Latin ones, which no normal form changes) end with their only token that ends a word, so many are coded as one text."""
        letters = [w for w in words if w[1:].isalpha() and max(w) < "\u0250"]
        out = dict(zip(letters, coded_together(self.library, letters, self._bytes, self.ends, first=False), strict=True))
        others = [w for w in words if w not in out]
        return out | {w: self._bytes(e.ids) for w, e in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True)}

    def _learn(self, parts: list[str]) -> None:
        """Code the parts that aren't in the table."""
        low = self._small(parts)
        self.words.update(self._coded([x for x in set(low) if x not in self.words]))
        self.words.update(zip(parts, map(self.words.__getitem__, low), strict=True))
        self.held += 5 * len("\n".join(parts).encode("utf-8", "replace"))  # a byte has one id at most

    def encode_batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = column(texts)
        whole = holding(texts, self.special)
        plain = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        parts, numbers, starts = split(pc.replace_substring(plain, "\n", " "))
        if len(self.words) > MAX_WORDS or self.held > MAX_BYTES:
            self.words, self.older, self.held = {}, self.words, 0
        ids = list(map(self.words.get, parts))
        unknown = [k for k, x in enumerate(ids) if x is None]
        if self.older:
            self.words.update([(parts[k], self.older[parts[k]]) for k in unknown if parts[k] in self.older])
        fresh = [parts[k] for k in unknown if parts[k] not in self.words]
        if fresh:
            self._learn(fresh)
        for k in unknown:
            ids[k] = self.words[parts[k]]
        out = gather(ids, numbers, starts)
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._bytes(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids)
        long = [p for p in fresh if len(p) >= LONG]
        for p in [*long, *(self._small(long) if long else [])]:  # words that hardly come again aren't kept
            self.words.pop(p, None)
        return out


_coders: dict[str, WordCoder] = {}


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _coders:
            _coders[tokenizer] = WordCoder(tokenizer)
        coder, end = _coders[tokenizer], np.array([end_id], "<u4").tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode_batch(batch.column(1)), strict=True):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[lo : lo + 4 * length]
                    rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most valuable configuration: by number of items, then by room."""
    best, picks = [np.zeros(capacity + 1)], []
    for _ in range(capacity // min(sizes)):
        top, pick = best[-1].copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            with_i = best[-1][: capacity + 1 - s] + values[i]
            better = with_i > top[s:] + 1e-12
            top[s:][better], pick[s:][better] = with_i[better], i
        if (pick < 0).all():
            break
        best.append(top)
        picks.append(pick)
    new, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            new[pick[room]] += 1
            room -= sizes[pick[room]]
    return new, float(best[-1][capacity])


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in the linear programme's optimum: at least counts[i] of sizes[i] in all."""
    k = len(sizes)
    basis = np.zeros((k, k))
    for i, s in enumerate(sizes):
        basis[i, i] = capacity // s
    need = np.array(counts, float)
    used = need / basis.diagonal()
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        new, value = _knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        into = np.linalg.solve(basis, new)
        ratio = np.where(into > 1e-9, used / np.where(into > 1e-9, into, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        used = np.maximum(used - step * into, 0)
        basis[:, out], used[out] = new, step
    return [(basis[:, j].astype(int), used[j]) for j in range(k)]


class Plan:
    """Where the pieces of each length go: ranks [from, to) of a length fill, `per` at a time, the sequences from `sequence` on, at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int = LENGTH, small: int | None = None, groups: int = 96):
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, from, to, per, sequence, offset
        self.taken: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
        left = {n: c for n, c in counts.items() if c > 0}
        if left and not 0 < min(left) <= max(left) <= capacity:
            raise ValueError("piece lengths must lie between 1 and the sequence length")
        small = max(1, capacity // 8) if small is None else small
        if capacity in left:
            self._put(capacity, left.pop(capacity), self._new(counts[capacity]), 1)
        large = {n: c for n, c in left.items() if n > small}
        if large:
            self._large(large, groups)
        for n in sorted(left, reverse=True):
            self._best_fit(n, left[n] - self.taken[n])

    def _new(self, many: int) -> tuple[int, int]:
        first, self.sequences = self.sequences, self.sequences + many
        return first, many

    def _put(self, length: int, many: int, run: tuple[int, int], per: int, room: int | None = None) -> None:
        """`many` pieces of a length into the sequences of run, which all have `room` left."""
        room = self.capacity if room is None else room
        at = self.taken[length]
        self.rows.append((length, at, at + many, per, run[0], self.capacity - room))
        self.taken[length] += many
        full, rest = divmod(many, per)
        for first, n, k in ((run[0], full, per), (run[0] + full, 1 if rest else 0, rest), (run[0] + full + bool(rest), run[1] - full - bool(rest), 0)):
            if n > 0 and room - k * length > 0:
                self.open[room - k * length].append((first, n))

    def _large(self, large: dict[int, int], groups: int) -> None:
        lengths = np.array(sorted(large), np.int64)
        have = np.array([large[n] for n in lengths], np.int64)
        most, group, held = -(-int(have.sum()) // groups), np.zeros(len(lengths), np.int64), 0
        for i in reversed(range(len(lengths) - 1)):  # from the longest; a frequent length has a group of its own, and so has each where they are few
            held += have[i + 1]
            new = len(lengths) <= groups or held + have[i] > most
            group[i], held = group[i + 1] + new, 0 if new else held
        sizes = [int(lengths[group == g].max()) for g in np.unique(group)]
        counts = [int(have[group == g].sum()) for g in np.unique(group)]
        for config, used in sorted(configurations(sizes, counts, self.capacity), key=lambda x: -x[1]):
            whole = int(used + 1e-6)
            if whole and config.sum():
                self._fill([s for s, k in zip(sizes, config, strict=True) for _ in range(k)], whole, lengths, have)

    def _fill(self, slots: list[int], many: int, lengths: np.ndarray, have: np.ndarray) -> None:
        """A configuration's sequences: each slot but the last two takes the largest length left up to its size, and those two take what fills the room best."""
        states = [(self._new(many), self.capacity)]
        for size in slots[:-2]:
            out = []
            for (first, n), room in states:
                while n and have[: (top := np.searchsorted(lengths, size, "right"))].any():
                    length = int(lengths[np.flatnonzero(have[:top])[-1]])
                    take = min(n, int(have[np.searchsorted(lengths, length)]))
                    self._take(length, take, first, room, lengths, have)
                    out.append(((first, take), room - length))
                    first, n = first + take, n - take
                if n:
                    out.append(((first, n), room))
            states = out
        for (first, n), room in states:
            while n and (ends := self._ends(slots[-2:], room, lengths, have)):
                take = min(n, *(int(have[np.searchsorted(lengths, x)]) // ends.count(x) for x in ends))
                left = room
                for x in ends:
                    self._take(x, take, first, left, lengths, have)
                    left -= x
                if left:
                    self.open[left].append((first, take))
                first, n = first + take, n - take
            if n:
                self.open[room].append((first, n))

    def _take(self, length: int, many: int, first: int, room: int, lengths: np.ndarray, have: np.ndarray) -> None:
        """One piece of a length for each of `many` sequences, which have `room` left."""
        at = self.taken[length]
        self.rows.append((length, at, at + many, 1, first, self.capacity - room))
        self.taken[length] += many
        have[np.searchsorted(lengths, length)] -= many

    @staticmethod
    def _ends(sizes: list[int], room: int, lengths: np.ndarray, have: np.ndarray) -> list[int]:
        """Lengths for the last one or two slots that leave the least room: the first of two up to its size, the other any. Of equals, those with the largest first one."""
        left = lengths[(have > 0) & (lengths <= room)]
        first = left[left <= sizes[0]] if len(sizes) > 1 else left[:0]
        if not len(first):
            return [int(left[-1])] if len(left) else []
        other = np.searchsorted(left, room - first, "right") - 1  # the largest that still fits beside it
        twice = (other >= 0) & (left[other] == first)
        other -= twice & (have[np.searchsorted(lengths, first)] < 2)
        total = first + np.where(other >= 0, left[other], 0)
        k = len(total) - 1 - int(total[::-1].argmax())
        return [int(first[k]), *([int(left[other[k]])] if other[k] >= 0 else [])]

    def _best_fit(self, length: int, many: int) -> None:
        rooms = sorted(r for r in self.open if r >= length and self.open[r])
        while many and rooms:
            room = rooms[0]
            first, n = self.open[room].pop()
            per = room // length
            take = min(many, n * per)
            self._put(length, take, (first, n), per, room)
            many -= take
            if not self.open[room]:
                rooms.pop(0)
        if many:
            per = self.capacity // length
            self._put(length, many, self._new(-(-many // per)), per)


def pack(piece_table: DataFrame, length: int = LENGTH, per_salt: int = PER_SALT) -> DataFrame:
    """Adds sequence_id and offset to written pieces (doc_id, piece, length, ...)."""
    spark = piece_table.sparkSession
    counts = {r["length"]: r["count"] for r in piece_table.groupBy("length").count().collect()}  # at most `length` rows
    places = sorted(Plan(counts, length).rows)
    many = np.array([counts.get(n, 0) for n in range(length + 1)], np.int64)
    salts = np.maximum(np.minimum(-(-many // SALTS), SALTS), -(-many // per_salt))
    first = np.concatenate(([0], np.cumsum(salts)))  # where a length's salts begin
    how_many = F.get(F.array(*(F.lit(max(1, int(s))) for s in salts)), F.col("length").cast("int"))
    salted = piece_table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), how_many).cast("int"))
    base = np.zeros(int(first[-1]) + 1, np.int64)
    if salts.max(initial=0) > 1:  # ranks of a salt start where those before it end; at most SALTS rows a length, and one for each PER_SALT pieces
        at: dict[int, int] = defaultdict(int)
        for r in sorted(salted.groupBy("length", "salt").count().collect(), key=lambda r: (r["length"], r["salt"])):
            base[first[r["length"]] + r["salt"]] = at[r["length"]]
            at[r["length"]] += r["count"]
    wide = 1 << 44
    starts = np.array([n * wide + a for n, a, *_ in places], np.int64)
    place = np.array(places, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((first, base, starts, place))  # its size follows the sequence length, and one number for PER_SALT pieces
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    cols = [c for c in piece_table.columns if c not in ("sequence_id", "offset")]

    def make():
        first, base, starts, place = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank + base[first[n] + salt]
            p = place[np.searchsorted(starts, n * wide + rank, "right") - 1]
            k = rank - p[:, 1]
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in cols), pa.array(p[:, 4] + k // p[:, 3]), pa.array(p[:, 5] + k % p[:, 3] * n)], [*cols, "sequence_id", "offset"])

        return step

    schema = ", ".join(f"{c} {piece_table.schema[c].dataType.simpleString()}" for c in cols)
    return map_batches(ranked.select(*cols, "salt", "rank"), make, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(Written(pieces(docs, tokenizer, length), "pieces").df, length)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
