"""Chunking as properties over generated documents."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronlake.operators import chunking as C

PROSE = st.text(alphabet="uv.\n？ ", max_size=240)


def flat(size, overlap=0, **more):
    return C.ChunkingConfig(enable_parent_child=False, chunk_size=size, chunk_overlap=overlap, **more)


@st.composite
def documents(draw):
    """Blocks of random kinds, with the heading path that stands above each and lines that follow each other."""
    path, out, line = [], [], 1
    for _ in range(draw(st.integers(1, 7))):
        kind = draw(st.sampled_from(["heading", "paragraph", "paragraph", "code", "list"]))
        text = draw(st.text(alphabet="klm. \n", min_size=1, max_size=90).filter(str.strip))
        if kind == "heading":
            path = [*path[: draw(st.integers(0, len(path)))], f"H{line}"]
        out.append({"kind": kind, "text": text, "heading_path": list(path), "anchor": {"source_type": "x", "line_start": line, "line_end": line + text.count("\n")}})
        line += text.count("\n") + 2
    return out


def slow_end(text, low, high):
    """The rule by trying every place."""
    for ends in (lambda p: text[p - 2 : p] == "\n\n", lambda p: text[p - 1] == "\n", lambda p: text[p - 1] in C.SENTENCE_ENDS):
        for p in range(high, low, -1):
            if p >= 2 and ends(p) or p == 1 and ends(p) and text[:1] != "":
                return p
    return high


@settings(max_examples=300, deadline=None)
@given(PROSE, st.integers(2, 40), st.data())
def test_windows_cover_the_text(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = list(C.windows(text, size, overlap))
    assert got == [] if not text else (got[0][0], got[-1][1]) == (0, len(text))
    for (a, b), (c, d) in zip(got, got[1:], strict=False):
        assert a < c <= b and b - c <= overlap and 0 < d - c <= size
        assert b == slow_end(text, a + size // 2, a + size)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 30), st.integers(1, 29), st.integers(1, 60))
def test_windows_leave_a_covered_heading(size, overlap, heading):
    text = "w" * 120
    covered = False
    for a, b in C.windows(text, size, min(overlap, size - 1), heading):
        assert not covered or a >= heading
        covered |= b >= heading


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="rs", max_size=14), st.text(alphabet="rs", max_size=14), st.integers(0, 16))
def test_border_and_joined(left, right, limit):
    want = max(n for n in range(min(limit, len(left), len(right)) + 1) if left[len(left) - n :] == right[:n])
    assert C.border(left, right, limit) == want
    assert C.joined(left, right, limit) == (left + right[want:] if want else f"{left}\n\n{right}")


@settings(max_examples=120, deadline=None)
@given(documents(), st.integers(10, 60))
def test_flat_chunks_hold_all_words(blocks, size):
    got = C.chunk_document(blocks, flat(size, size // 4), "Doc")
    assert [c["sequence"] for c in got] == list(range(len(got)))
    assert all(0 < len(c["content"]) <= size and c["content"] == c["content"].strip() for c in got)
    kept = "".join(c["content"] for c in got)
    assert all(ch in kept for b in blocks for ch in b["text"].replace("\n", "").replace(" ", ""))
    for c in got:
        assert c["context_header"].split(" > ")[0] == "Doc" and c["context_header"] == " > ".join(["Doc", *c["heading_path"]])
        assert c["anchor"]["line_start"] <= c["anchor"]["line_end"]


@settings(max_examples=120, deadline=None)
@given(documents(), st.integers(40, 160), st.integers(0, 20))
def test_parents_hold_their_children(blocks, size, lead):
    config = C.ChunkingConfig(parent_chunk_size=size, child_chunk_size=size // 3, chunk_size=100, chunk_overlap=lead)
    got = C.chunk_document(blocks, config)
    parents, children = [c for c in got if c["role"] == "parent"], [c for c in got if c["role"] == "child"]
    assert [c["sequence"] for c in children] == list(range(len(children)))
    assert sorted({c["parent"] for c in children}) == [p["sequence"] for p in parents]
    for n, p in enumerate(parents):
        own = [c for c in children if c["parent"] == p["sequence"]]
        assert own[0]["sequence"] == p["sequence"] and p["anchor"] == own[0]["anchor"] and {tuple(c["heading_path"]) for c in own} == {tuple(p["heading_path"])}
        assert p["content"].endswith(own[-1]["content"][-5:])
        assert len(own) == 1 or len(p["content"]) <= size + lead
        if n and lead and parents[n - 1]["heading_path"] == p["heading_path"]:
            assert p["content"].startswith(parents[n - 1]["content"][-lead:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=12), st.integers(20, 80))
def test_tables_repeat_their_header(widths, size):
    header = {"kind": "table_header", "text": "| h |\n| --- |", "table_id": "q", "anchor": {"header_row": 4}}
    rows = [{"kind": "table_row", "text": f"|{'z' * n}|", "table_id": "q", "anchor": {"header_row": 4, "row_start": 5 + k, "row_end": 5 + k}} for k, n in enumerate(widths)]
    got = C.chunk_document([header, *rows], flat(size))
    assert all(c["content"].startswith(header["text"]) and c["anchor"]["header_row"] == 4 for c in got)
    assert [r for c in got for r in c["content"].split("\n\n")[1:]] == [r["text"] for r in rows]
    for c in got:
        alone = c["content"].count("\n\n") == 1
        assert len(c["content"]) <= size or alone
        assert c["oversized"] == (bool(rows) and len(c["content"]) > size)
        assert c["metadata"] == {"block_kind": "table"}


def test_details_of_windows():
    one = {"kind": "code", "text": "c" * 50, "sequence": 7, "anchor": {}}
    other = {"kind": "paragraph", "text": "short", "anchor": {}}
    cut = C.chunk_document([one], flat(20))
    assert {json.dumps(c["metadata"], sort_keys=True) for c in cut} == {'{"anchor_granularity": "block", "block_kind": "code", "code_block_sequence": 7}'}
    assert [c["metadata"] for c in C.chunk_document([other, other], flat(100, strategy="recursive"))] == [{"block_kind": "mixed"}]
    assert [c["metadata"] for c in C.chunk_document([other], flat(100))] == [{"block_kind": "paragraph"}]


@pytest.mark.parametrize(
    "line, starts",
    [("# any", True), ("第七部分 其他", True), ("12、x", True), ("4) x", True), ("===", True), ("--", False), ("ÄB", False), ("RED-BLUE: X", True), ("Red Blue", False), ("\fpage", True), ("", False), ("plain words, no rule", False)],
)
def test_heuristic_boundaries(line, starts):
    assert C.is_boundary(line) is starts
    assert C.is_boundary(line, "heading") and C.is_boundary(line, "thematic_break")


@pytest.mark.parametrize(
    "left, right, want",
    [
        ({"line_start": 2, "line_end": 3}, {"line_start": 5, "line_end": 6, "offset_start": 9}, {"line_start": 2, "line_end": 6, "offset_start": 9}),
        ({"row_start": 2, "row_end": 3}, {"row_start": 4, "row_end": 4}, {"row_start": 2, "row_end": 4}),
        ({"row_start": 2, "row_end": 3}, {"row_start": 5, "row_end": 5}, None),
        ({"offset_start": 9, "offset_end": 10}, {"offset_start": 1, "offset_end": 2}, None),
        ({"sheet": "p"}, {"sheet": "q"}, None),
        ({"header_row": 1}, {}, None),
    ],
)
def test_anchors(left, right, want):
    if want is None:
        with pytest.raises(ValueError):
            C.merge_anchors(left, right)
    else:
        assert C.merge_anchors(left, right) == want


def test_strategies_fall_back_where_anchors_clash():
    blocks = [{"kind": "paragraph", "text": "1. one", "anchor": {"sheet": "a"}, "heading_path": ["x"]}, {"kind": "paragraph", "text": "2. two", "anchor": {"sheet": "b"}, "heading_path": ["x"]}]
    assert [c["content"] for c in C.chunk_document(blocks, flat(50))] == ["1. one", "2. two"]  # by headings they are one section, whose anchors clash
    clash = [b | {"text": b["text"][3:]} for b in blocks]
    with pytest.raises(ValueError):
        C.chunk_document(clash, flat(50))


def test_configurations():
    assert C.ChunkingConfig.decode("{}") == C.ChunkingConfig() and C.ChunkingConfig.decode('{"child_chunk_size": 9}').child_chunk_size == 9
    for bad in ('{"size": 3}', '{"strategy": "best"}', '{"chunk_overlap": 512}', '{"parent_chunk_size": 3}'):
        with pytest.raises(ValueError):
            C.ChunkingConfig.decode(bad)
    assert C.ChunkingConfig().set_hash() != C.ChunkingConfig(chunk_size=9, chunk_overlap=1).set_hash()


@pytest.mark.parametrize("size, overlap", [(5, 0), (5, 2), (4, 3), (100, 99)])
def test_fixed_windows(spark, size, overlap):
    texts = ["", "x", "abcde", "abcdef", "0123456789" * 7 + "日本語😀", None]
    got = {(r.doc_id, r.sequence): r.content for r in C.fixed_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, overlap).collect()}
    want, step = {}, size - overlap
    for k, t in enumerate(texts):
        for n, at in enumerate(range(0, max(len(t or "") - overlap, 1 if t else 0), step)):
            want[k, n] = t[at : at + size]
    assert got == want


def test_fixed_windows_are_linear(spark):
    import time

    took = []
    for n in (400_000, 400_000, 1_600_000):
        began = time.monotonic()
        C.fixed_windows(spark.range(1).selectExpr("id AS doc_id", f"repeat('word ', {n // 5}) AS text"), 512, 80).write.format("noop").mode("overwrite").save()
        took.append(time.monotonic() - began)
    assert took[2] < 8 * took[1] + 2
