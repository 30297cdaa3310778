"""Token ids in binary files of directly addressable codes: any token is read without decoding a block.

1. Documents are dealt by ranges of their id (ties: by a hash of the text, then by row), sorted within a range, and coded
   task by task; each task writes files of about FILE_TOKENS ids. A file's name is new for each attempt, and Spark's own commit of the
   list of files (part, number, path, documents, tokens) says which attempt counts, so a lost or repeated task leaves at most
   a file that no list names (`TokenFiles.sweep` deletes those).
2. A file keeps its ids as levels. Level 0 has the lowest bits of every id; a bitmap says which ids go on, and only those have bits in
   the next level. Where an id goes on is the rank of its bit, found by a directory of counts (one for RANK_BITS bits) and
   the bits after it. The widths of the levels are those that need the fewest bits for the file's own ids (dynamic programming on their bit lengths).
3. To read token i, one window of bits, one block of the bitmap and one count are read for each level. Tokens in a row
   are in a row in every level too, so a document is a few ranges.
4. Sections of a file: magic, length of header, header (JSON: places of all sections), levels (bits, bitmap, counts), where each document starts, document ids, which ids are not null.

Files are opened through pyarrow's file systems by the address of the shared folder (file, hdfs, s3 or s3a, gs, abfs).

Cases: null text counts as empty (the end id alone); rows with a null id come first; rows that repeat an id have a place each, those of equal texts in
any order; an empty table gives no files and an empty result; other columns, whatever their names, are not read. Memory follows
the longest text and FILE_TOKENS; a worker's table of words is bounded by words and bytes.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import Written, shared_dir, table
from heronlake.llm.words import coded_together, column, gather, holding, marked, split

END_ID = 0
#: Ids after which a file is closed, and ids that are decoded at once when files are read back.
FILE_TOKENS, RUN = 2 << 20, 1 << 20
#: Bits of a continuation bitmap for each count of its directory.
RANK_BITS = 512
#: A worker's table of words holds about so many words and bytes, and starts anew when it is full; longer words aren't kept.
MAX_WORDS, MAX_BYTES, LONG = 900_000, 128 << 20, 64
#: Rows, and bytes about, whose words are looked up together: the more, the fewer words come twice.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
MAGIC = b"HLTOKEN1"
_IRREGULAR = "[ \n]{3}"
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _bound(words: Iterable[str]) -> int:
    """Bytes that words and their ids take, about: a byte has one id at most."""
    return 5 * len("\n".join(words).encode("utf-8", "replace"))


class ByteCoder:
    """Ids of texts with a byte-level vocabulary, as bytes of `kind`, through a table of words.

    The vocabulary's rule for cutting texts never joins what stands on both sides of a place where a run of white space
    begins, nor of one before the last character of such a run. So texts are cut before each space and line feed if no run of them is longer than
    two, and each part is coded once. Other texts, and those that may hold a special token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.special = sorted({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        probe = "a  b\nc \nd\n\ne's f."
        if self.library.encode(probe, add_special_tokens=False).ids != [i for w in ("a", " ", " b", "\n", "c", " ", "\n", "d", "\n", "\n", "e", "'s", " f", ".") for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("only byte-level vocabularies without a prefix space are supported")
        self.begins = marked(self.library, lambda t: t.startswith("\u0120"))  # how byte-level vocabularies write a space
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, parts: list[str]) -> set[str]:
        """Code parts that aren't in the table. Gives those whose ids may depend on what stands around."""
        odd = set()
        if _OTHER_SPACE.search("".join(parts)):  # without one, parts hold no white space but a first space or line feed
            inner = [p[1:] if p[0] in " \n" else p for p in parts]
            odd = {p for p, x in zip(parts, inner, strict=True) if x and (x[0].isspace() or x[-1].isspace())}
        fine = [p for p in parts if p not in odd] if odd else parts
        words, others = [p for p in fine if p[0] == " " and p != " "], [p for p in fine if p[0] != " " or p == " "]
        self.words.update(zip(words, coded_together(self.library, words, self._bytes, self.begins, first=True), strict=True))
        self.words.update(zip(others, [self._bytes(e.ids) for e in self.library.encode_batch_fast(others, add_special_tokens=False)], strict=True))
        self.held += _bound(fine)
        return odd

    def encode_batch(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = column(texts)
        whole = holding(texts, self.special) | pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        whole |= np.array([len(end) > 1 and end.isspace() for end in pc.utf8_slice_codeunits(texts, -2).to_pylist()], bool)
        parts, numbers, starts = split(texts.filter(pa.array(~whole)) if whole.any() else texts)
        ids = list(map(self.words.get, parts))
        if len(self.words) > MAX_WORDS or self.held > MAX_BYTES:  # a new table begins with the batch's own words
            self.words = {p: x for p, x in zip(parts, ids, strict=True) if x is not None}
            self.held = _bound(self.words)
        fresh = [k for k, x in enumerate(ids) if x is None]
        odd = self._learn([parts[k] for k in fresh]) if fresh else set()
        for k in fresh:
            ids[k] = self.words.get(parts[k], b"")
            if len(parts[k]) > LONG:
                self.words.pop(parts[k], None)
        coded = gather(ids, numbers, starts)
        if odd:
            hit = np.flatnonzero(np.array([p in odd for p in parts])[numbers.to_numpy()])
            again = np.unique(np.searchsorted(starts, hit, "right") - 1)
            whole[np.flatnonzero(~whole)[again]] = True
            coded = np.delete(np.array(coded, object), again).tolist()
        if not whole.any():
            return coded
        rest, alone = iter(coded), iter(texts.filter(pa.array(whole)).to_pylist())
        return [self._bytes(self.library.encode(next(alone), add_special_tokens=False).ids) if w else next(rest) for w in whole]


def level_widths(bit_lengths: np.ndarray) -> list[int]:
    """Widths of levels, lowest bits first, that need the fewest bits in all. bit_lengths[k]: how many values have k bits (0 and 1: one bit)."""
    top = max(1, int(np.flatnonzero(bit_lengths).max(initial=1)))
    above = [int(bit_lengths[b + 1 :].sum()) if b else int(bit_lengths.sum()) for b in range(top)]  # values with bits from b on
    cost, width = [0] * (top + 1), [0] * (top + 1)
    for b in reversed(range(top)):
        cost[b], width[b] = min((above[b] * (w + (b + w < top)) + cost[b + w], w) for w in range(1, top - b + 1))
    out, b = [], 0
    while b < top:
        out.append(width[b])
        b += width[b]
    return out


def _packed(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, one after the other: eight values are `width` bytes, so each byte has the same shifts all along."""
    eights = np.zeros((-(-len(values) // 8), 8), np.uint64)
    eights.reshape(-1)[: len(values)] = values & values.dtype.type((1 << width) - 1)
    out = np.zeros((len(eights), width), np.uint8)
    for byte in range(width):
        for k in range(8 * byte // width, min(8, -(-8 * (byte + 1) // width))):  # the values that reach into it
            shift = k * width - 8 * byte
            out[:, byte] |= ((eights[:, k] << np.uint64(shift)) if shift >= 0 else (eights[:, k] >> np.uint64(-shift))).astype(np.uint8)
    return out.tobytes()[: (len(values) * width + 7) // 8]


def _fields(data: bytes, first: int, count: int, width: int) -> np.ndarray:
    """`count` fields of `width` bits from the first-th (below 8) of data on; data has 8 bytes more than they need."""
    eights = -(-(first + count) // 8)
    out = np.empty((eights, 8), np.uint32)
    data = data + bytes(max(0, eights * width + 8 - len(data)))
    for k in range(8):  # the k-th of each eight begins at the same bit of every `width` bytes
        bit = k * width
        windows = np.ndarray((eights,), "<u8", data, bit // 8, (width,))
        out[:, k] = (windows >> np.uint64(bit % 8)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[first : first + count]


def encode_file(doc_ids: list[int | None], ids: list[bytes], kind: str = "<u4") -> bytes:
    """A file's bytes: doc_ids in order, and each one's token ids as bytes of `kind`."""
    values = np.frombuffer(b"".join(ids), kind)
    values = values.astype(np.uint16 if values.dtype.itemsize == 2 else np.uint32, copy=False)
    size = np.dtype(kind).itemsize
    starts = np.concatenate(([0], np.cumsum([len(x) // size for x in ids], dtype=np.int64)))
    bits = np.frexp(values.astype(np.float64))[1]
    head = {"documents": len(doc_ids), "tokens": len(values), "levels": []}
    sections: list[bytes] = []

    def section(data: bytes) -> list[int]:
        """[place after the header, length]; 8 bytes of rest let windows reach beyond the end."""
        at = sum(map(len, sections))
        sections.append(data + bytes(8 + -len(data) % 8))
        return [at, len(data)]

    widths = level_widths(np.bincount(bits, minlength=2))
    for k, width in enumerate(widths):
        level = {"width": width, "count": len(values), "bits": section(_packed(values, width))}
        if k < len(widths) - 1:
            values = values >> width
            on = values > 0
            blocks = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
            level |= {"more": section(np.packbits(on, bitorder="little").tobytes()), "counts": section(np.concatenate(([0], np.cumsum(blocks))).astype("<u8").tobytes())}
            values = values[on]
        head["levels"].append(level)
    head["starts"] = section(starts.astype("<u8").tobytes())
    head["ids"] = section(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    head["known"] = section(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return MAGIC + len(text).to_bytes(8, "little") + text + b"".join(sections)


def file_system(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """pyarrow's file system and path of an address as Spark writes it."""
    address = re.sub("^file:/(?!/)", "file:///", re.sub("^s3[an]://", "s3://", address))
    return pyarrow.fs.FileSystem.from_uri(address)


class TokenFile:
    """Random access to one file; only what is asked for is read."""

    def __init__(self, address: str):
        system, path = file_system(address)
        self.file = system.open_input_file(path)
        self.bytes_read = 0
        start = self._at(0, 16)
        if start[:8] != MAGIC:
            raise ValueError(f"{address} is not a token file")
        length = int.from_bytes(start[8:], "little")
        self.head, self.base = json.loads(self._at(16, length)), 16 + length
        self.documents, self.tokens, self.levels = (self.head[k] for k in ("documents", "tokens", "levels"))

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, place: int, length: int) -> bytes:
        self.bytes_read += length
        return self.file.read_at(length, place)

    def _part(self, section: list[int], lo: int, hi: int) -> bytes:
        return self._at(self.base + section[0] + lo, hi - lo)

    def _array(self, name: str, kind: str, lo: int, hi: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._part(self.head[name], lo * size, hi * size), kind)

    def rank(self, level: dict, i: int) -> int:
        """How many of the first i values of a level go on."""
        block = i // RANK_BITS
        before = int.from_bytes(self._part(level["counts"], 8 * block, 8 * block + 8), "little")
        if not i % RANK_BITS:
            return before
        rest = int.from_bytes(self._part(level["more"], block * RANK_BITS // 8, (i + 7) // 8), "little")
        return before + (rest & ((1 << i % RANK_BITS) - 1)).bit_count()

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi."""
        if not 0 <= lo <= hi <= self.tokens:
            raise IndexError(f"tokens {lo} to {hi} of {self.tokens}")
        out, at, shift = np.zeros(hi - lo, np.uint32), np.arange(hi - lo), 0
        for k, level in enumerate(self.levels):
            if lo == hi:
                break
            width, first = level["width"], lo // 8 * level["width"]
            data = self._part(level["bits"], first, hi * width // 8 + 9)
            out[at] |= _fields(data, lo % 8, hi - lo, width) << np.uint32(shift)
            if k == len(self.levels) - 1:
                break
            on = np.unpackbits(np.frombuffer(self._part(level["more"], lo // 8, (hi + 7) // 8), np.uint8), bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            at = at[on]
            lo = self.rank(level, lo)
            hi, shift = lo + len(at), shift + width
        return out

    def token(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        lo, hi = self._array("starts", "<u8", k, k + 2).tolist()
        return self.range(lo, hi)

    def doc_ids(self) -> list[int | None]:
        known = self._array("known", "u1", 0, self.documents)
        return [d if k else None for d, k in zip(self._array("ids", "<i8", 0, self.documents).tolist(), known.tolist(), strict=True)]

    def digests(self, run: int = RUN) -> Iterator[tuple[list, list[int], list[int], list[int]]]:
        """(doc_ids, starts, lengths, CRC-32 of the ids as 32-bit numbers) of documents in order, about `run` tokens at a time."""
        names, starts = self.doc_ids(), self._array("starts", "<u8", 0, self.documents + 1).astype(np.int64)
        k = 0
        while k < self.documents:
            end = max(k + 1, int(np.searchsorted(starts, starts[k] + run, "right")) - 1)
            lo, hi = int(starts[k]), int(starts[end])
            if end == k + 1:  # one document, of any length
                crc = 0
                for a in range(lo, hi, run):
                    crc = zlib.crc32(self.range(a, min(hi, a + run)).astype("<u4", copy=False), crc)
                crcs = [crc]
            else:
                ids = self.range(lo, hi).astype("<u4", copy=False)
                cuts = (starts[k : end + 1] - lo).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield names[k:end], starts[k:end].tolist(), np.diff(starts[k : end + 1]).tolist(), crcs
            k = end


_coders: dict[str, ByteCoder] = {}


class TokenFiles:
    """All files of a table of documents, and the list that names them."""

    def __init__(self, folder: str, listed: DataFrame):
        self.folder, self.listed = folder, listed

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> TokenFiles:
        """Code the texts of docs (doc_id, text) and write them in ascending order of doc_id."""

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            if tokenizer not in _coders:
                _coders[tokenizer] = ByteCoder(tokenizer)
            coder, part = _coders[tokenizer], TaskContext.get().partitionId()
            end, size = np.array([end_id], coder.kind).tobytes(), np.dtype(coder.kind).itemsize
            system, path = file_system(folder)
            names, held, number, tokens = [], [], 0, 0

            def close() -> pa.RecordBatch:
                nonlocal number, tokens
                name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
                system.create_dir(path, recursive=True)
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(encode_file(names, held, coder.kind))
                row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "file": name, "documents": len(names), "tokens": tokens}], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))
                names.clear()
                held.clear()
                number, tokens = number + 1, 0
                return row

            for batch in batches:
                many = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
                for lo in range(0, batch.num_rows, many):
                    some = batch.slice(lo, many)
                    for doc, ids in zip(some.column(0).to_pylist(), coder.encode_batch(some.column(1)), strict=True):
                        names.append(doc)
                        held.append(ids + end)
                        tokens += len(ids) // size + 1
                        if tokens >= file_tokens:
                            yield close()
            if names:
                yield close()

        text = F.coalesce("text", F.lit(""))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"), F.monotonically_increasing_id().alias("row"))
        order = [F.col("doc_id").asc_nulls_first(), F.col("same").asc(), F.col("row").asc()]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
        return cls(folder, Written(dealt.mapInArrow(code, "part int, number int, file string, documents long, tokens long"), "token_files").df)

    def placed(self) -> DataFrame:
        """The list with `base`, the tokens of all files before. One short row a file, so one task can add them up."""
        before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
        return self.listed.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
        folder = self.folder

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with TokenFile(f"{folder}/{name}") as file:
                        for names, starts, lengths, crcs in file.digests():
                            cols = [pa.array(names, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

        files = self.placed().select("file", "base")
        many = max(1, min(self.listed.count(), 100_000))
        return files.repartition(many, "file").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def sweep(self) -> list[str]:
        """Delete the files that the list doesn't name, left by tasks that were lost or repeated. To be called when no writer is at work."""
        system, path = file_system(self.folder)
        found = [x.base_name for x in system.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))]
        spare = self.listed.sparkSession.createDataFrame([(x,) for x in found], "file string").join(self.listed, "file", "left_anti")
        gone = [r.file for r in spare.collect()]
        for name in gone:
            system.delete_file(f"{path}/{name}")
        return gone


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return TokenFiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder).read()
