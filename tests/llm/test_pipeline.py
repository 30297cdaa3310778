"""The stages of the corpus pipeline, with planted cases."""

import random

import corpus_pipeline
from heronlake.llm import near_copies
from heronlake.llm.simhash_neardup import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], SCHEMA)


def edited(words, places):
    return " ".join(f"edit{k}" if k in places else w for k, w in enumerate(words))


def test_near_copies_of_similarity_080_to_095_go(spark):
    rng = random.Random(7)
    rows, near, far = [], [], []
    for g in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(300)]
        copy = edited(words, set(rng.sample(range(300), 1 + g % 6)))  # each edit changes up to 5 of 296 shingles
        other = edited(words, set(range(0, 300, 30)))
        rows += [(10 * g, " ".join(words)), (10 * g + 1, copy), (10 * g + 2, other)]
        near.append((" ".join(words), copy))
        far.append((" ".join(words), other))
    like = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(set(near_copies.shingles(a).tolist()), set(near_copies.shingles(b).tolist()))
    assert all(0.8 <= like(*p) < 1 for p in near) and all(like(*p) < 0.8 for p in far)
    assert max((fingerprint(a) ^ fingerprint(b)).bit_count() for a, b in near) > 4
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect())
    # an `other` may be near the copy, if they share edits; here none is
    assert got == sorted(10 * g + k for g in range(40) for k in (0, 2))


def test_near_copies_keep_links_within_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 8)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, edited(words, set(rng.sample(range(120), rng.randrange(1, 7))))) for k in range(90)]
    found = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    root = list(range(90))
    for i in range(90):
        for j in range(i):
            if len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 1 < len(set(root)) < 90
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()) == sorted(set(root))


def test_quality_takes_failing_lines_out_of_kept_documents(spark):
    body = [f"this is line {k}, " + " ".join(f"with{k} word{j}{k}" for j in range(6)) + ", and here it ends." for k in range(6)]
    rows = [(1, "\n".join([*body[:3], "Home | News | About | Contact", *body[3:], "All rights reserved by nobody at all."])), (2, "\n".join(body)), (3, "Home | News | About")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality(spark, frame(spark, rows), "").collect()}
    assert got == {1: ("\n".join(body), len("\n".join(body))), 2: ("\n".join(body), len("\n".join(body)))}


def test_near_copies_keep_one_row_of_null_and_repeated_ids(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(None, one), (None, one), (5, two), (5, two), (None, two), (3, None), (None, "")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect()), key=str)
    assert got == sorted([(None, one), (5, two), (3, None)], key=str)


def test_run_end_to_end(spark, tmp_path):
    """All stages on planted cases: what stays, with which text, and what the packing makes of it, by plain Python and the tokenizer's library."""
    import collections
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = lambda: "\n".join(" ".join(rng.choices(vocabulary, k=12)) + "." for _ in range(8))
    own = {i: prose() for i in range(40)}
    shared = "this very line stands on all the sites of ours."
    given = {i: f"{t}\n{shared}" if i < 10 else t for i, t in own.items()}
    want = {i: f"{t}\n{shared}" if i == 0 else t for i, t in own.items()}  # its first place stays
    kept = prose()
    given |= {100: "too short.", 101: kept.replace("\n", "\nHome | News | About | Contact\n", 1), 300: "\n".join("12345 67890 2468 13579 42." for _ in range(1, 9)).replace("42", "43", 1), 301: None}
    want[101] = kept
    words = own[20].split(" ")
    words[30] = "changed"
    given |= {200: " ".join(words), 201: own[21]}
    rows = [(i, t, "en", f"s{i}", None if t is None else len(t)) for i, t in given.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = collections.defaultdict(list)
    places = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in want.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want[i] = [(k, lo, len(ids[lo : lo + 2048]), zlib.crc32(np.array(ids[lo : lo + 2048], "<u4").tobytes())) for k, lo in enumerate(range(0, len(ids), 2048))]
    assert {i: sorted(p) for i, p in found.items()} == want
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048


def test_tables_of_a_stage_are_deleted(spark, tmp_path):
    import os

    from heronlake.llm.common import Scratch, Written, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with Scratch() as own:
        Written(spark.range(3), "inner")
        kept = own.keep(Written(spark.range(4), "kept"))
    assert len(set(os.listdir(folder)) - before) == 1 and kept.df.count() == 4
    kept.drop()
    assert set(os.listdir(folder)) == before
