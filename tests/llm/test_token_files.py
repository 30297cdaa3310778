"""Token files: ids against the library, random access, optimal levels, order and places, lost tasks."""

import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from heronlake.llm import registry, token_files
from heronlake.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return token_files.ByteCoder(PATH)


PIECES = ["a", "word", "Word.", "it's", " ", " ", "\n", "\t", "\r", "\xa0", " ", "\x1c", "é", "日本", "😀", "12", "...", "<|endoftext|>", "<|", "'ll", ",", "x."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@example("a   b")
@example("\n\n\na")
@example("a \n b  ")
@example("a\t \tb")
@example(" <|endoftext|> b")
def test_ids_are_the_librarys(library, coder, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode_batch([text])[0], coder.kind).tolist() == want


def slow_rows(rows, library):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, library):
    got = registry.QUERIES["op13_token_files"](spark, SF)
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted(slow_rows(rows, library))


def test_small_files_and_odd_inputs(spark, library, tmp_path):
    long = " ".join(f"word{i} of it" for i in range(30_000))
    rows = [(7, None), (3, ""), (None, "no id"), (5, long), (-2, " \n\t\n"), (4, "日本語 ¿ß? 😀 <|endoftext|>"), (9, "twice"), (9, "twice"), (9, "a third text"), (6, "a b\nc " * 500)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row long, same string, start long").repartition(3)
    files = token_files.TokenFiles.write(docs, PATH, f"file://{tmp_path}/out", file_tokens=50)
    got = files.read().collect()
    assert files.listed.count() >= 3 and len(got) == len(rows)
    want = slow_rows(rows, library)
    by_place = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in got)
    assert [d for *_, d, _ in by_place] == [w[0] for w in want]  # ascending, null first
    assert [s for s, *_ in by_place] == [0, *itertools.accumulate(n for _, n, *_ in by_place)][:-1]  # no gaps
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, n, c) for d, _, n, c in want)
    spare = tmp_path / "out" / "000000-000000-of-a-lost-task.tok"
    spare.write_bytes(b"HLTOK")
    assert files.sweep() == [spare.name] and not spare.exists()
    assert files.read().count() == len(rows) and len(os.listdir(tmp_path / "out")) == files.listed.count()
    none = token_files.TokenFiles.write(docs.where("false"), PATH, f"file://{tmp_path}/none")
    assert none.read().count() == 0 and none.sweep() == []


@pytest.mark.parametrize("kind, top", [("<u2", 1), ("<u2", 50_256), ("<u4", 70_000), ("<u4", 2**32 - 1)])
def test_random_access(tmp_path, kind, top):
    draw = random.Random(top)
    docs = [[min(top, int(top ** draw.random())) for _ in range(draw.choice([1, 1, 3, 40, 2500]))] for _ in range(40)]
    every = [i for d in docs for i in d]
    (tmp_path / "a.tok").write_bytes(token_files.encode_file([*range(1, 40), None], [np.array(d, kind).tobytes() for d in docs], kind))
    with token_files.TokenFile(f"{tmp_path}/a.tok") as file:
        assert (file.documents, file.tokens) == (40, len(every)) and file.doc_ids() == [*range(1, 40), None]
        assert file.range(0, len(every)).tolist() == every
        for k in draw.sample(range(40), 10):
            assert file.document(k).tolist() == docs[k]
        before = file.bytes_read
        for i in (places := draw.sample(range(len(every)), 300)):
            assert file.token(i) == every[i]
        # a window of bits for each level, and one block and one count for each bitmap
        assert (file.bytes_read - before) / len(places) <= len(file.levels) * (12 + 8 + token_files.RANK_BITS // 8 + 1)
        for a, b in [sorted(draw.choices(range(len(every) + 1), k=2)) for _ in range(60)]:
            assert file.range(a, b).tolist() == every[a:b]
        with pytest.raises(IndexError):
            file.range(0, len(every) + 1)
        whole = [c for *_, crcs in file.digests(run=200) for c in crcs]
        assert whole == [zlib.crc32(np.array(d, "<u4").tobytes()) for d in docs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=2, max_size=8))
def test_widths_need_the_fewest_bits(counts):
    def cost(widths):
        out, b = 0, 0
        for k, w in enumerate(widths):
            reach = sum(counts) if b == 0 else sum(counts[b + 1 :])
            out += reach * (w + (k < len(widths) - 1))
            b += w
        return out

    top = max([1, *(k for k, n in enumerate(counts) if n)])
    ways = [[b - a for a, b in itertools.pairwise([0, *cuts, top])] for n in range(top) for cuts in itertools.combinations(range(1, top), n)]
    got = token_files.level_widths(np.array(counts))
    assert sum(got) == top and cost(got) == min(map(cost, ways))


def test_other_files_are_refused(tmp_path):
    (tmp_path / "b").write_bytes(bytes(64))
    with pytest.raises(ValueError):
        token_files.TokenFile(f"{tmp_path}/b")
