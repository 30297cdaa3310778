"""Coders of words: batches of odd and plain texts against the library, and how little of a batch reaches it."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from heronlake.llm import best_fit_packing, token_files, words

ODD = [None, "", " ", ".", "\n", "a", "a.", "a.\n", " a, b.", "a. .b", "a..", "3.", "é.", "a.\tb", "\tb. c", "c \t", "x\x85", "a   b.", "a \n b.", "Word, word. WORD.", "it's. s'd,", "<|endoftext|>", "a <|endoftext|>.", "日本. ok,", "é. ́", "ΣΑΣ. İx.", "\xa0 b", "end. ", "end.\n"]


class Counted:
    """The library, with how many strings it was given."""

    def __init__(self, library):
        self.library, self.given = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode_batch_fast(self, texts, **how):
        self.given += len(texts)
        return self.library.encode_batch_fast(texts, **how)


def batches(seed):
    """Batches of texts in which odd ones stand among plain ones, some of them slices of a column."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", "", ".", ",", ".,", "9", "-"]) for _ in range(400)]
    for _ in range(20):
        texts = [rng.choice(ODD) if rng.random() < 0.4 else rng.choice(["", " "]) + rng.choice([" ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(30))) for _ in range(rng.randrange(1, 40))]
        yield pa.array(texts, rng.choice([pa.string(), pa.large_string()])).slice(rng.randrange(len(texts)))


def agree(coder, kind):
    for seed in range(5):
        for batch in batches(seed):
            want = [np.array(coder.library.encode(t or "", add_special_tokens=False).ids, kind).tobytes() for t in batch.to_pylist()]
            assert coder.encode_batch(batch) == want


def reach(coder):
    """Strings that the library is given for 4,000 new words that end with an ASCII letter, each with and without a stop."""
    rng = random.Random(1)
    new = list({"".join(rng.choice("bcdefgñß") for _ in range(9)) + "g" for _ in range(4000)})
    coder.library = Counted(coder.library)
    coder.encode_batch([" ".join(new), " ".join(f"{w}." for w in new), " ".join(f"{w}," for w in new)])
    return coder.library.given


@pytest.mark.parametrize("limit", [900_000, 50])
def test_byte_batches_are_the_librarys(monkeypatch, limit):
    monkeypatch.setattr(token_files, "MAX_WORDS", limit)
    coder = token_files.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"))
    agree(coder, coder.kind)


def test_byte_words_reach_the_library_together():
    coder = token_files.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert reach(coder) < 100 and len(coder.words) < 4100


def test_words_that_marks_cannot_part_are_coded_one_by_one():
    coder = token_files.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"))
    given = [" ab", " cd"]
    want = [coder._bytes(coder.library.encode(w, add_special_tokens=False).ids) for w in given]
    assert words.coded_together(coder.library, given, coder._bytes, coder.begins, first=True) == want
    assert words.coded_together(coder.library, given, coder._bytes, np.zeros_like(coder.begins), first=True) == want


@pytest.mark.parametrize("limit", [900_000, 50])
def test_word_batches_are_the_librarys(monkeypatch, limit):
    monkeypatch.setattr(best_fit_packing, "MAX_WORDS", limit)
    agree(best_fit_packing.WordCoder(public_tokenizers.path("word_bpe_49k.json")), "<u4")


def test_words_reach_the_library_together():
    coder = best_fit_packing.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    assert reach(coder) < 100 and len(coder.words) < 4100
