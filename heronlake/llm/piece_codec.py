"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text is normalised as the model says (identity map, one leading mark, spaces as marks), cut where no
piece of the vocabulary can reach across, and each part is merged by an agenda: a heap of adjacent symbol
pairs ordered by score, then by position. What stays outside the vocabulary is spelled in byte pieces.
Parts repeat, so each Arrow batch encodes only those that its worker has not met (a bounded table), and
checks them all at once against the sentencepiece library; decoded texts are checked against it too. A difference raises.

Cases: null text counts as empty; empty text has no ids and decodes to empty; ties between equal scores go
to the leftmost pair; repeated rows give repeated results; an empty table gives an empty result; other
columns, whatever their names, are not read. Very long texts need memory in proportion to their own size, beside the table of
parts, which is bounded by parts and bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import map_batches, table

MARK = "▁"
#: Parts and bytes that a worker remembers at most (the table starts anew when it is full), and the length of parts that are kept.
MAX_PARTS, MAX_BYTES, LONG = 800_000, 128 << 20, 64
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>$")


def _bad_byte(e: UnicodeError):
    """The library writes one replacement character for each byte that is not UTF-8."""
    return "�", e.start + 1


codecs.register_error("heronlake-byte", _bad_byte)


class PieceCodec:
    """Encoder and decoder of one merge-type vocabulary."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.spelled: list[bytes] = []
        plain: dict[str, int] = {}
        for i, name in enumerate(names):
            if sp.is_byte(i):
                value = int(BYTE_PIECE.match(name)[1], 16)
                self.byte_ids[value] = i
                self.spelled.append(bytes([value]))
            elif sp.is_control(i):
                self.spelled.append(b"")
            elif sp.is_unknown(i):
                self.spelled.append(" ⁇ ".encode())
            else:
                plain[name] = i
                self.spelled.append(name.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in plain) or any("\n" in p for p in plain):
            raise ValueError("pieces of this vocabulary reach across words or lines")
        if any(sp.is_unused(i) for i in plain.values()):
            raise ValueError("unused pieces are not supported")
        if sp.normalize("AÅ ﬁ") != f"{MARK}AÅ{MARK}ﬁ":
            raise ValueError("only the identity normaliser with a leading mark is supported")
        self.ids = plain
        self.marked = {i for p, i in plain.items() if p[0] == MARK}
        self.order = {p: (-sp.get_score(i), i) for p, i in plain.items()}
        self.parts: dict[str, bytes] = {}
        self.held = 0
        self.decimal = [str(i) for i in range(n)]

    def merge(self, part: str) -> list[int]:
        """Ids of one part, by the agenda of adjacent pairs."""
        whole = self.ids.get(part) if len(part) == 1 else None
        if whole is not None:
            return [whole]
        symbols = list(part)
        n, order = len(symbols), self.order
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in order:
                agenda.append((order[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i] if symbols[i] else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                if wider in order:
                    heapq.heappush(agenda, (order[wider][0], i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                if wider in order:
                    heapq.heappush(agenda, (order[wider][0], h, wider))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts that no piece joins: a run of marks with the word after it, and line feeds."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " " or " \n" in text:
            return re.findall(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n", MARK + text.replace(" ", MARK))
        out = (MARK + text.replace("\n", " \n ").replace(" ", f" {MARK}").replace(f"{MARK}\n {MARK}", "\n ")).split(" ")
        return [p for p in out if p] if "" in out else out

    def learn(self, parts: set[str]) -> None:
        """Encode parts and check them against the library."""
        fresh = list(parts)
        coded = [self.merge(p) for p in fresh]
        head = [self.ids[MARK], self.byte_ids[10]]
        for lo in range(0, len(fresh), 2000):
            own, want = fresh[lo : lo + 2000], list(head)
            for ids in coded[lo : lo + 2000]:
                want += ids
                want.append(head[1])
            if self.library.encode("\n" + "".join(f"{p.replace(MARK, ' ')}\n" for p in own), num_threads=1) != want:
                raise AssertionError(f"ids differ from the library's in one of {own}")
        self.parts.update(zip(fresh, (array("I", ids).tobytes() for ids in coded), strict=True))
        self.held += 5 * len("".join(fresh).encode("utf-8", "replace"))  # a byte has one id at most

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t or "") for t in texts]
        met = set().union(*split)
        if len(self.parts) > MAX_PARTS or self.held > MAX_BYTES:
            self.parts, self.held = {}, 0
        met = {p for p in met if p not in self.parts}  # set methods would go through the whole table
        self.learn(met)
        known = self.parts.__getitem__
        out = [np.frombuffer(b"".join(map(known, parts)), np.uint32) for parts in split]
        for p in [p for p in met if len(p) > LONG]:  # parts that hardly come again aren't kept
            del self.parts[p]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes in a row, without the mark that stands before a text."""
        raw = b"".join(map(self.spelled.__getitem__, ids))
        text = raw.decode("utf-8", "heronlake-byte")
        first = next((i for i in ids if self.spelled[i]), 0)  # control ids have no text
        return text[1:] if first in self.marked else text

    def decode_batch(self, coded: list[list[int]]) -> list[str]:
        """Texts of lists of ids, each checked against the library."""
        out = [self.decode(ids) for ids in coded]
        if out != self.library.decode(coded):
            raise AssertionError("a decoded text differs from the library's")
        return out


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a worker and model."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_column(df: DataFrame, id_col: str, text_col: str, model_file: str) -> DataFrame:
    """(id, ids, decoded) for each row of df."""

    def make():
        own = codec(model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [x.tolist() for x in own.encode_batch(batch.column(1).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(own.decode_batch(ids), pa.string())], [id_col, "ids", "decoded"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), make, f"{id_col} {kind}, ids array<int>, decoded string")


def digest_column(df: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of what encode_column gives, without moving it."""

    def make():
        own = codec(model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [x.tolist() for x in own.encode_batch(batch.column(1).to_pylist())]
            n = [len(ids) for ids in found]
            coded = [hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest() for ids in found]
            decoded = [hashlib.sha256(text.encode()).hexdigest() for text in own.decode_batch(found)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(df.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_column(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
