"""Parsers: documents are generated from blocks, and parsed back."""

import io
import json
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronlake.sources import parsers
from heronlake.sources.parsers import ParseError, default_registry, escape_line, parse, parse_markdown

R = default_registry()
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def sheet(rows):
    cells = lambda n, r: "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{n}">{cells(n, r)}</row>' for n, r in rows)
    return archive({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="urn:r"><sheets><sheet name="Stock" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/one.xml"/></Relationships>',
        "xl/worksheets/one.xml": f'<worksheet xmlns="{S}"><sheetData>{body}</sheetData></worksheet>',
    })


def paragraph(text, style=None, number=None, extra=""):
    pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:numId w:val="{number}"/></w:numPr>' if number else "")
    return f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{text}</w:t>{extra}</w:r></w:p>"


def word(body):
    style = f'<w:styles xmlns:w="{W}"><w:style w:styleId="X2"><w:name w:val="heading 2"/></w:style></w:styles>'
    return archive({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/styles.xml": style})


# --- text -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="gh *#_-1.)", min_size=1, max_size=12).filter(str.strip), min_size=1, max_size=4), min_size=1, max_size=5), st.sampled_from(["\n", "\r\n", "\r"]))
def test_text_paragraphs(paragraphs, feed):
    """Lines keep their places, and an escaped line reads as a paragraph of the same words in Markdown."""
    plain = "\n\n".join("\n".join(p) for p in paragraphs)
    _, blocks, warnings = R.parse("TXT", ("\ufeff" + plain.replace("\n", feed)).encode())
    assert len(blocks) == len(paragraphs) and not warnings
    for b, p in zip(blocks, paragraphs, strict=True):
        text = "\n".join(p)
        assert b["text"] == "\n".join(map(escape_line, p))
        assert plain[b["anchor"]["offset_start"] : b["anchor"]["offset_end"]] == text
        assert b["anchor"]["line_end"] - b["anchor"]["line_start"] == len(p) - 1
        assert b["metadata"] == ({} if b["text"] == text else {"anchor_granularity": "block"})
        for line in p:
            got = list(parse_markdown(escape_line(line).encode()))
            assert [x["kind"] for x in got] == ["paragraph"]


# --- Markdown --------------------------------------------------------------------------------------------------------------

MAKERS = {
    "paragraph": lambda r, n: f"text {n}\nand more",
    "list": lambda r, n: f"- item {n}\n  - inner\n- last",
    "quote": lambda r, n: f"> said {n}\n> so",
    "code": lambda r, n: f"```py\n# no heading {n}\n| no | table |\n\n- no list\n```",
    "thematic_break": lambda r, n: r.choice(["***", "- - -", "___"]),
    "heading": lambda r, n: f"{'#' * r.randrange(1, 5)} Title {n}",
}


@pytest.mark.parametrize("seed", range(25))
def test_markdown_blocks_come_back(seed):
    r = random.Random(seed)
    kinds = [r.choice(list(MAKERS)) for _ in range(r.randrange(1, 12))]
    kinds = [k for n, k in enumerate(kinds) if n == 0 or k != kinds[n - 1] or k in ("paragraph", "heading")]
    made = [MAKERS[k](r, n) for n, k in enumerate(kinds)]
    markdown, blocks, _ = R.parse(".md", "\n\n".join(made).encode())
    assert markdown == "\n\n".join(made) and [b["kind"] for b in blocks] == kinds
    path = []
    for b, text in zip(blocks, made, strict=True):
        if b["kind"] == "heading":
            level = text.index(" ")
            path = [(x, t) for x, t in path if x < level] + [(level, text[level + 1 :])]
        assert b["text"] == text and b["heading_path"] == [t for _, t in path]
        assert markdown.encode()[b["start"] : b["end"]].decode() == text
        assert markdown.split("\n")[b["anchor"]["line_start"] - 1 : b["anchor"]["line_end"]] == text.split("\n")


def test_markdown_tables_give_a_block_a_row():
    _, blocks, _ = R.parse("md", b"before\n\n| p | q |\n|:-:|---|\n| 1 | 2 |\n| 3 | 4 |\n\nafter")
    assert [b["kind"] for b in blocks] == ["paragraph", "table_header", "table_row", "table_row", "paragraph"]
    assert len({b["table_id"] for b in blocks[1:4]}) == 1


# --- tables ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='no",|\n ', max_size=6), min_size=1, max_size=4), min_size=1, max_size=6))
def test_csv_records(records):
    import csv

    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(records)
    filled = [k for k, r in enumerate(records) if any(c.strip() for c in r)]
    if not filled:
        with pytest.raises(ParseError):
            R.parse("csv", out.getvalue().encode())
        return
    used = records[filled[0] :]
    _, blocks, _ = R.parse("csv", out.getvalue().encode())
    width = max(map(len, used))
    assert [b["kind"] for b in blocks] == ["table_header"] + ["table_row"] * (len(used) - 1)
    assert [b["anchor"]["row_start"] for b in blocks] == list(range(filled[0] + 1, len(records) + 1)) and {b["anchor"]["column_end"] for b in blocks} == {width}
    for b, record in zip(blocks[1:], used[1:], strict=True):
        cells = [c.replace("|", "\\|").replace("\n", "<br>") for c in record] + [""] * (width - len(record))
        assert b["text"] == f"| {' | '.join(cells)} |"


def test_csv_fields_of_any_length():
    _, blocks, _ = R.parse("csv", b"name\n" + b"y" * 300_000)
    assert len(blocks[1]["text"]) == 300_004


def test_xlsx_rows():
    markdown, blocks, _ = R.parse("xlsx", sheet([(2, ["part", "n"]), (3, [None, "4"]), (5, ["nut", None])]))
    assert markdown.split("\n\n")[0] == "## Stock" and [b["anchor"].get("row_start") for b in blocks] == [None, 2, 3, 5]
    assert [b["text"] for b in blocks[2:]] == ["|  | 4 |", "| nut |  |"]


# --- Word --------------------------------------------------------------------------------------------------------------------


def test_docx_blocks_and_warnings():
    body = paragraph("a*b_c [x]", "X2") + paragraph("plain", extra="<w:drawing/>") + paragraph("first", number=1) + paragraph("second", number=1) + paragraph("other", number=2)
    body += f"<w:tbl><w:tr><w:tc>{paragraph('k')}</w:tc><w:tc>{paragraph('v')}</w:tc></w:tr><w:tr><w:tc>{paragraph('1')}</w:tc></w:tr></w:tbl>"
    markdown, blocks, warnings = R.parse("docx", word(body))
    assert blocks[0]["text"] == r"## a\*b\_c \[x\]" and blocks[0]["heading_path"] == ["a*b_c [x]"]
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "list", "list", "table_header", "table_row"] and blocks[2]["text"] == "- first\n- second"
    assert warnings == ["image"] and "image" not in markdown and all(b["heading_path"] == ["a*b_c [x]"] for b in blocks)


# --- faults -------------------------------------------------------------------------------------------------------------------


def damaged(content):
    """The archive with one byte of a stored part changed, so that its checksum fails."""
    at = content.index(b"w:body") if b"w:body" in content else content.index(b"sheetData")
    return content[:at] + b"#" + content[at + 1 :]


FAULTS = [
    ("exe", b"x"), ("txt", b"\xff\xfe"), ("txt", b" \n"), ("csv", b""), ("csv", b'a\n"open'), ("xlsx", b"no archive"), ("docx", archive({"other.xml": "<a/>"})), ("docx", damaged(word(paragraph("t")))),
    ("docx", archive({"word/document.xml": "<not closed"})), ("xlsx", sheet([("x", ["a"])])), ("pdf-zip", archive({"a.txt": "t"})),
]


@pytest.mark.parametrize("kind, content", FAULTS)
def test_faults_are_refusals(kind, content):
    with pytest.raises(ParseError):
        R.parse(kind, content)


def test_limits_on_archives(monkeypatch):
    monkeypatch.setattr(parsers, "MAX_ENTRIES", 1)
    with pytest.raises(ParseError):
        R.parse("xlsx", sheet([(1, ["a"])]))


def test_a_bad_document_ends_no_job(spark):
    rows = [(str(k), kind, content, None) for k, (kind, content) in enumerate(FAULTS)] + [("ok", "docx", word(paragraph("fine", extra="<w:pict/>")), "t"), ("none", "txt", None, None)]
    got = {r.document_id: r for r in parse(spark.createDataFrame(rows, "document_id string, file_type string, content binary, title string")).collect()}
    assert len(got) == len(rows) and got["ok"].markdown == "fine" and json.loads(got["ok"].warnings) == ["image"] and got["ok"].error is None
    assert all(got[str(k)].error and got[str(k)].markdown is None for k in range(len(FAULTS))) and got["none"].error


def test_result_archives_prefer_named_files():
    _, blocks, _ = R.parse("pdf-zip", archive({"x/notes.md": "no", "x/full.md": "# yes"}))
    assert blocks[0]["text"] == "# yes" and blocks[0]["anchor"]["source_type"] == "pdf"


def test_registry():
    with pytest.raises(ValueError):
        default_registry().add("again", [".MD"], parse_markdown)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# one")
    (tmp_path / "b.TXT").write_bytes(b"two")
    (tmp_path / "noext").write_bytes(b"three")
    docs = parsers.read_documents(spark, str(tmp_path))
    assert {(r.title, r.file_type) for r in docs.collect()} == {("a.md", "md"), ("b.TXT", "TXT"), ("noext", "")}
    assert {r.markdown for r in parse(docs).collect()} == {"# one", "two", None}
