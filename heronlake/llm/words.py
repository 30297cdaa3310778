"""Words of a batch of texts as numbers, and the ids of words gathered into those of texts, in Arrow: Python meets each distinct word of a batch once."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: New words that the library codes as one text.
JOINED = 200
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def column(texts: pa.Array | list[str | None]) -> pa.Array:
    """Texts as an Arrow column without nulls, with offsets that no replacement outgrows."""
    out = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    return pc.fill_null(out.cast(pa.large_string()), "")


def holding(texts: pa.Array, strings: list[str]) -> np.ndarray:
    """Which texts hold one of the strings."""
    out = np.zeros(len(texts), bool)
    for s in strings:
        out |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return out


def split(texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
    """The distinct parts of texts, each part's number among them, and where each text's parts begin (and the last one's end).

    A part begins with each text, space and line feed, and with a stop or comma that stands between an ASCII letter and one of these (or a text's end).
    """
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    cut = np.append((raw == 32) | (raw == 10), True)
    cut[ends] = True
    stops = np.flatnonzero((raw[1:] == 46) | (raw[1:] == 44)) + 1
    cut[stops[_LETTER[raw[stops - 1]] & cut[stops + 1]]] = True
    places = np.flatnonzero(cut).astype(np.int64)  # the last is the end of all
    parts = pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
    return parts.dictionary.to_pylist(), parts.indices, np.searchsorted(places, ends)


def gather(ids: list[bytes], numbers: pa.Array, starts: np.ndarray) -> list[bytes]:
    """Each text's ids, from those of the distinct parts."""
    found = pa.array(ids, pa.large_binary()).take(numbers)
    if not len(found):
        return [b""] * (len(starts) - 1)
    _, offsets, data = found.buffers()
    bounds = np.frombuffer(offsets, np.int64)[starts + found.offset].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(whole[a:b]) for a, b in pairwise(bounds)]


def coded_together(library, words: list[str], code, marks: np.ndarray, first: bool) -> list[bytes]:
    """The library's ids of words with a space before each, as code() makes them bytes; marks: ids that stand first (or last) in each word, once and nowhere else.

    The library gets JOINED words at a time, which costs less than a call's result for each word. If
    the marks don't give a place for each word, words are coded one by one.
    """
    if not words:
        return []
    lines = ["".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
    raw, size = b"".join([code(e.ids) for e in library.encode_batch_fast(lines, add_special_tokens=False)]), len(code([0]))
    at = np.flatnonzero(marks[np.frombuffer(raw, f"<u{size}")])
    if len(at) != len(words):
        return [code(e.ids) for e in library.encode_batch_fast(words, add_special_tokens=False)]
    bounds = [*(at * size).tolist(), len(raw)] if first else [0, *((at + 1) * size).tolist()]
    return [raw[a:b] for a, b in pairwise(bounds)]


def marked(library, test) -> np.ndarray:
    """By id: whether the vocabulary's token passes the test."""
    vocabulary = library.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if test(t)]] = True
    return out
