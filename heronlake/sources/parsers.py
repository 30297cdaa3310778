"""Parsers of document formats into normal Markdown and blocks with source anchors.

A parser is a function of (content bytes, title) that yields blocks; `parse` joins them by blank lines into a manifest with
byte spans. The DataFrame operator runs the registry over (document_id, file_type, content) rows in Arrow batches: one pass, no shuffle.
A document that can't be parsed, whatever is wrong with its bytes, gives a row with its error instead.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Archive limits and the version of manifests.
MAX_ENTRIES, MAX_EXPANDED, MAX_XML = 10_000, 512 << 20, 128 << 20
MANIFEST_VERSION = 1
csv.field_size_limit(1 << 31)  # a field may be as long as its document
#: Names of the Markdown file in a converter's result archive, best first.
RESULT_NAMES = ["full.md", "result.md", "main.md", "content.md"]


class ParseError(ValueError):
    """A document that its parser refuses."""


def block(kind: str, text: str, anchor: dict, heading_path: list[str] | None = None, **metadata) -> dict:
    return {"kind": kind, "text": text, "heading_path": list(heading_path or []), "anchor": anchor, "metadata": metadata, **({"table_id": metadata["table_id"]} if "table_id" in metadata else {})}


def manifest(parser: str, blocks: list[dict]) -> tuple[str, list[dict]]:
    """Markdown of the blocks, and the blocks with sequence and byte span."""
    out, at = [], 0
    for k, b in enumerate(b for b in blocks if b["text"]):
        n = len(b["text"].encode())
        out.append(b | {"sequence": k, "parser": parser, "start": at, "end": at + n})
        at += n + 2
    if not out:
        raise ParseError("nothing to parse")
    return "\n\n".join(b["text"] for b in out), out


def check_manifest(markdown: str, blocks: list[dict]) -> None:
    """Raise where sequence or spans are wrong."""
    raw, last = markdown.encode(), 0
    if not blocks:
        raise ParseError("a manifest has at least one block")
    for k, b in enumerate(blocks):
        if b["sequence"] != k or not last <= b["start"] < b["end"] <= len(raw):
            raise ParseError(f"block {k} is out of sequence or place")
        try:
            raw[b["start"] : b["end"]].decode()
        except UnicodeDecodeError as e:
            raise ParseError(f"block {k} cuts a character") from e
        last = b["end"]


def _text_of(content: bytes) -> str:
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ParseError("not UTF-8") from e
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.strip():
        raise ParseError("empty document")
    return text


# --- plain text ----------------------------------------------------------------------------------------------------------

_INLINE = re.compile(r"([\\`*_\[\]<>|~])")
_MARKER = re.compile(r"( {0,3})(#{1,6}(?:[ \t]|$)|[-+](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$)|=+[ \t]*$|(?:[ \t]*-){3}[-\t ]*$)")


def escape_line(line: str) -> str:
    """A line of plain text that reads as itself in Markdown."""
    line = _INLINE.sub(r"\\\1", line)
    if line[:1] == "\t":
        return f"&#9;{line[1:]}"
    if line[:4] == "    ":
        return f"&#32;{line[1:]}"
    m = _MARKER.match(line)
    return f"{m[1]}\\{line[len(m[1]):]}" if m else line


def parse_text(content: bytes, title: str = "") -> Iterator[dict]:
    """Paragraphs between blank lines; offsets are code points, lines count from 1."""
    text, at, held = _text_of(content), 0, []
    for number, line in enumerate([*text.split("\n"), ""], 1):
        if line.strip():
            held.append((number, at, line))
        elif held:
            plain = "\n".join(x for _, _, x in held)
            shown = "\n".join(escape_line(x) for _, _, x in held)
            anchor = {"source_type": "txt", "offset_start": held[0][1], "offset_end": held[-1][1] + len(held[-1][2]), "line_start": held[0][0], "line_end": held[-1][0]}
            yield block("paragraph", shown, anchor, **({"anchor_granularity": "block"} if shown != plain else {}))
            held = []
        at += len(line) + 1


# --- Markdown ------------------------------------------------------------------------------------------------------------

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}>")
_TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _cells(line: str) -> int:
    inner = re.sub(r"\\\|", "", line.strip())
    return inner.strip("|").count("|") + 1


def _spans(lines: list[str]) -> Iterator[tuple[str, int, int, int, str]]:
    """(kind, first line, line after the last, heading level, heading title) of top-level blocks."""
    i, n = 0, len(lines)
    starts = lambda s: bool(_ATX.match(s) or _FENCE.match(s) or _RULE.match(s) or _QUOTE.match(s) or _ITEM.match(s))
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        j = i + 1
        if m := _FENCE.match(line):
            while j < n and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[j]):
                j += 1
            yield "code", i, min(j + 1, n), 0, ""
            i = min(j + 1, n)
            continue
        if m := _ATX.match(line):
            yield "heading", i, j, len(m[1]), (m[2] or "").strip()
        elif _RULE.match(line):
            yield "thematic_break", i, j, 0, ""
        elif _QUOTE.match(line):
            while j < n and lines[j].strip() and not (starts(lines[j]) and not _QUOTE.match(lines[j])):
                j += 1
            yield "quote", i, j, 0, ""
        elif _ITEM.match(line):
            while j < n:
                if lines[j].strip():
                    inside = lines[j][:2] in ("  ", "\t") or lines[j][:1] == "\t" or _ITEM.match(lines[j])
                    if not inside and (not lines[j - 1].strip() or starts(lines[j])) or _RULE.match(lines[j]):
                        break
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            yield "list", i, j, 0, ""
        elif re.match(r"(?: {4}|\t)", line):
            while j < n and (not lines[j].strip() or re.match(r"(?: {4}|\t)", lines[j])):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            yield "code", i, j, 0, ""
        elif j < n and "|" in line and _TABLE_RULE.match(lines[j]) and _cells(line) == _cells(lines[j]):
            j += 1
            while j < n and lines[j].strip() and not starts(lines[j]):
                j += 1
            yield "table", i, j, 0, ""
        else:
            kind, level, name = "paragraph", 0, ""
            while j < n and lines[j].strip():
                if m := _SETEXT.match(lines[j]):
                    kind, level, name = "heading", 1 if m[1][0] == "=" else 2, " ".join(x.strip() for x in lines[i:j])
                    j += 1
                    break
                if starts(lines[j]) and not re.match(r" {0,3}(?:[02-9]|1[0-9])[0-9]*[.)]", lines[j]):
                    break
                j += 1
            yield kind, i, j, level, name
        i = j


def parse_markdown(content: bytes, title: str = "", source_type: str = "markdown") -> Iterator[dict]:
    """Top-level blocks with the path of headings above them; a table gives its header and a block for each row."""
    text = _text_of(content)
    lines = text.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line) + 1)
    path: list[tuple[int, str]] = []
    sequence = 0

    def one(kind: str, a: int, z: int, **metadata) -> dict:
        anchor = {"source_type": source_type, "offset_start": offsets[a], "offset_end": offsets[z] - 1, "line_start": a + 1, "line_end": z}
        return block(kind, "\n".join(lines[a:z]), anchor, [name for _, name in path], **metadata)

    for kind, a, z, level, name in _spans(lines):
        if kind == "heading":
            path = [*((x, y) for x, y in path if x < level), (level, name)]
        if kind == "table":
            table_id = f"table-{sequence}"
            yield one("table_header", a, a + 2, table_id=table_id)
            for r in range(a + 2, z):
                yield one("table_row", r, r + 1, table_id=table_id)
            sequence += z - a - 1
        else:
            yield one(kind, a, z)
            sequence += 1


# --- tables --------------------------------------------------------------------------------------------------------------


def table_blocks(source_type: str, table_id: str, rows: list[tuple[int, list[str], int | None, int | None]], sheet: str | None = None, heading_path: list[str] | None = None, **metadata) -> Iterator[dict]:
    """Blocks of a table: rows are (number, cells, first line, last line), the first is the header."""
    width = max(len(cells) for _, cells, _, _ in rows)
    clean = lambda c: re.sub(r"\r\n?|\n", "<br>", c).replace("|", "\\|")
    header = rows[0][0]
    for k, (number, cells, first, last) in enumerate(rows):
        full = [clean(c) for c in cells] + [""] * (width - len(cells))
        if k == 0:
            full = [c if c.strip() else f"Column {n}" for n, c in enumerate(full, 1)]
        text = f"| {' | '.join(full)} |"
        anchor = {"source_type": source_type, "sheet": sheet, "header_row": header, "row_start": number, "row_end": number, "column_start": 1, "column_end": width, "line_start": first, "line_end": last}
        yield block("table_row" if k else "table_header", text if k else f"{text}\n|{' --- |' * width}", {n: v for n, v in anchor.items() if v is not None}, heading_path, table_id=table_id, **metadata)


def parse_csv(content: bytes, title: str = "") -> Iterator[dict]:
    """Records by logical number; the first that isn't empty is the header."""
    text = _text_of(content)
    reader = csv.reader(io.StringIO(text), strict=True)
    rows, first = [], 1
    try:
        for number, cells in enumerate(reader, 1):
            if rows or any(c.strip() for c in cells):
                if cells:
                    rows.append((number, cells, first, reader.line_num))
            first = reader.line_num + 1
    except csv.Error as e:
        raise ParseError(f"bad CSV: {e}") from e
    if not rows:
        raise ParseError("empty document")
    return table_blocks("csv", "table-0", rows)


# --- office archives -----------------------------------------------------------------------------------------------------


def open_archive(content: bytes) -> zipfile.ZipFile:
    """An archive within the limits on entries and sizes."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ParseError("not an archive") from e
    infos = z.infolist()
    if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_EXPANDED or any(i.file_size > MAX_XML for i in infos if i.filename.endswith((".xml", ".rels"))):
        raise ParseError("the archive is beyond the limits")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise ParseError("document types are not allowed")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise ParseError(f"bad XML in {name}") from e


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _find(e: ElementTree.Element, *names: str) -> ElementTree.Element | None:
    for name in names:
        e = next((c for c in e if _local(c) == name), None)
        if e is None:
            return None
    return e


def _relations(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    root = _xml(z, name)
    return {} if root is None else {r.get("Id"): r.get("Target") for r in root}


def parse_xlsx(content: bytes, title: str = "") -> Iterator[dict]:
    """Each sheet with a value: a heading and a table; values as they are stored, empty rows and cells at the end left out."""
    z = open_archive(content)
    book = _xml(z, "xl/workbook.xml")
    if book is None:
        raise ParseError("no workbook")
    strings_root = _xml(z, "xl/sharedStrings.xml")
    strings = [] if strings_root is None else ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in strings_root]
    targets = _relations(z, "xl/_rels/workbook.xml.rels")
    found = False
    for index, sheet in enumerate(e for e in book.iter() if _local(e) == "sheet"):
        target = targets.get(_attr(sheet, "id") or "", "")
        root = _xml(z, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"))
        if root is None:
            continue
        rows = []
        for place, row in enumerate((e for e in root.iter() if _local(e) == "row"), 1):
            cells: list[str] = []
            for c in row:
                letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                at = at - 1 if letters else len(cells)
                value = _find(c, "v")
                kind, text = c.get("t"), (value.text or "") if value is not None else ""
                if kind == "s":
                    text = strings[int(text)] if text.isdigit() and int(text) < len(strings) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                cells += [""] * (at + 1 - len(cells))
                cells[at] = text
            while cells and not cells[-1].strip():
                cells.pop()
            number = row.get("r") or str(place)
            if not number.isdigit():
                raise ParseError(f"bad row number {number!r}")
            rows.append((int(number), cells, None, None))
        filled = [k for k, r in enumerate(rows) if r[1]]
        if not filled:
            continue
        found = True
        name, hidden = sheet.get("name") or "", sheet.get("state") in ("hidden", "veryHidden")
        yield block("heading", f"## {name}", {"source_type": "xlsx", "sheet": name}, [name], hidden=hidden)
        yield from table_blocks("xlsx", f"xlsx-sheet-{index}", [(n, c or [""], a, b) for n, c, a, b in rows[filled[0] : filled[-1] + 1]], name, [name], hidden=hidden)
    if not found:
        raise ParseError("empty document")


_HEADING_STYLE = re.compile(r"(?:heading|标题)\s*([1-9])$", re.I)
_UNSUPPORTED = {"drawing": "image", "pict": "image", "object": "object", "footnoteReference": "footnote", "endnoteReference": "endnote", "commentReference": "comment", "oMath": "formula", "txbxContent": "text_box"}


def parse_docx(content: bytes, title: str = "") -> Iterator[dict]:
    """Headings (outline level or style name), paragraphs, lists of one number id, and tables; a warning block kind for what is left out."""
    z = open_archive(content)
    root = _xml(z, "word/document.xml")
    if root is None:
        raise ParseError("no document")
    styles_root = _xml(z, "word/styles.xml")
    levels: dict[str, int] = {}
    for s in styles_root if styles_root is not None else ():
        if _local(s) == "style":
            name, outline = _find(s, "name"), _find(s, "pPr", "outlineLvl")
            m = _HEADING_STYLE.match((_attr(name, "val") or "").strip()) if name is not None else None
            if outline is not None and (_attr(outline, "val") or "").isdigit() and int(_attr(outline, "val")) < 9:
                levels[_attr(s, "styleId")] = int(_attr(outline, "val")) + 1
            elif m:
                levels[_attr(s, "styleId")] = int(m[1])
    path: list[tuple[int, str]] = []
    held: list[tuple[str, int, str]] = []  # number id, place, text
    table = 0

    def text_of(p: ElementTree.Element) -> str:
        parts = {"tab": "\t", "br": "\n", "cr": "\n"}
        return "".join((e.text or "") if _local(e) == "t" else parts.get(_local(e), "") for e in p.iter() if _local(e) in ("t", "tab", "br", "cr")).strip()

    def flush() -> Iterator[dict]:
        if held:
            yield block("list", "\n".join(f"- {escape_line(t)}" for _, _, t in held), {"source_type": "docx", "paragraph_start": held[0][1], "paragraph_end": held[-1][1]}, [x for _, x in path])
            held.clear()

    warned: dict[str, int] = {}
    for e in root.iter():
        if (kind := _UNSUPPORTED.get(_local(e))) is not None:
            warned[kind] = warned.get(kind, 0) + 1
    number = 0
    body = _find(root, "body")
    for e in [] if body is None else body:
        if _local(e) == "p":
            number += 1
            text = text_of(e)
            if not text:
                continue
            outline, style, num = _find(e, "pPr", "outlineLvl"), _find(e, "pPr", "pStyle"), _find(e, "pPr", "numPr", "numId")
            level = levels.get(_attr(style, "val") or "") if style is not None else None
            if outline is not None and (_attr(outline, "val") or "9").isdigit() and int(_attr(outline, "val") or 9) < 9:
                level = int(_attr(outline, "val")) + 1
            elif level is None and style is not None and (m := _HEADING_STYLE.match(_attr(style, "val") or "")):
                level = int(m[1])
            anchor = {"source_type": "docx", "paragraph_start": number, "paragraph_end": number}
            if level:
                yield from flush()
                path = [*((x, y) for x, y in path if x < level), (level, text)]
                yield block("heading", f"{'#' * min(level, 6)} {escape_line(text.replace(chr(10), ' '))}", anchor, [x for _, x in path])
            elif num is not None:
                if held and held[-1][0] != _attr(num, "val"):
                    yield from flush()
                held.append((_attr(num, "val"), number, text))
            else:
                yield from flush()
                yield block("paragraph", "\n".join(map(escape_line, text.split("\n"))), anchor, [x for _, x in path])
        elif _local(e) == "tbl":
            yield from flush()
            rows = [[text_of(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            if rows and any(rows):
                for b in table_blocks("docx", f"docx-table-{table}", [(k, r or [""], None, None) for k, r in enumerate(rows, 1)], None, [x for _, x in path]):
                    b["anchor"]["table_index"] = table
                    yield b
                table += 1
    yield from flush()
    if warned:
        yield block("warning", "", {"source_type": "docx"}, [], warnings=sorted(warned))


def parse_result_zip(content: bytes, title: str = "") -> Iterator[dict]:
    """A converter's result archive: its Markdown file, anchored as the original format."""
    z = open_archive(content)
    names = sorted(z.namelist())
    best = next((n for want in RESULT_NAMES for n in names if posixpath.basename(n) == want), next((n for n in names if n.lower().endswith(".md")), None))
    if best is None:
        raise ParseError("no Markdown in the archive")
    return parse_markdown(z.read(best), title, "pdf")


class Registry:
    """Parsers by normal file type."""

    def __init__(self):
        self._by: dict[str, tuple[str, Callable[[bytes, str], Iterator[dict]]]] = {}

    @staticmethod
    def normal(file_type: str) -> str:
        t = file_type.strip().lower().removeprefix(".")
        return "markdown" if t == "md" else t

    def add(self, name: str, types: list[str], parser: Callable[[bytes, str], Iterator[dict]]) -> Registry:
        for t in map(self.normal, types):
            if t in self._by:
                raise ValueError(f"{t} has a parser")
            self._by[t] = (name, parser)
        return self

    def parse(self, file_type: str, content: bytes, title: str = "") -> tuple[str, list[dict], list[str]]:
        """Markdown, blocks and warnings. Every fault of the bytes (a damaged archive, bad XML, a number that isn't one) is a ParseError."""
        got = self._by.get(self.normal(file_type))
        if got is None:
            raise ParseError(f"unsupported file type: {file_type}")
        try:
            found = list(got[1](content, title))
        except ParseError:
            raise
        except (ValueError, KeyError, IndexError, EOFError, OSError, NotImplementedError, RuntimeError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError) as e:
            raise ParseError(f"damaged document: {type(e).__name__}: {e}") from e
        warnings = [w for b in found if b["kind"] == "warning" for w in b["metadata"]["warnings"]]
        markdown, blocks = manifest(got[0], found)
        check_manifest(markdown, blocks)
        return markdown, blocks, warnings


def default_registry() -> Registry:
    return Registry().add("text", ["txt"], parse_text).add("markdown", ["markdown"], parse_markdown).add("csv", ["csv"], parse_csv).add("xlsx", ["xlsx"], parse_xlsx).add("docx", ["docx"], parse_docx).add("pdf", ["pdf-zip"], parse_result_zip)


def parse(docs: DataFrame, registry: Callable[[], Registry] = default_registry) -> DataFrame:
    """(document_id, markdown, blocks as JSON, warnings as JSON, error). docs: document_id, file_type, content (binary), title."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = registry()
        for batch in batches:
            rows = []
            for doc, kind, content, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    markdown, blocks, warnings = own.parse(kind or "", content or b"", title or "")
                    rows.append((doc, markdown, json.dumps(blocks, ensure_ascii=False), json.dumps(warnings), None))
                except ParseError as e:
                    rows.append((doc, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["document_id", "markdown", "blocks", "warnings", "error"])

    given = docs.select(F.col("document_id").cast("string"), "file_type", F.col("content").cast("binary"), "title")
    return given.mapInArrow(run, "document_id string, markdown string, blocks string, warnings string, error string")


def read_documents(spark, path: str) -> DataFrame:
    """Files of a folder as (document_id, file_type, content, title); the file system may be any that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.sha2("path", 256).alias("document_id"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("file_type"), "content", name.alias("title"))
