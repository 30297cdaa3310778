"""Deterministic chunks of parsed documents.

Each document is cut on its own, so the work is one pass of Arrow batches without a shuffle. A chunk window
starts where the last one ended less the overlap; it ends at the last paragraph break, line break or end of sentence in the
second half of its size, or else at its size. Lengths are code points.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SENTENCE_ENDS = "。！？.!?；;"
ANCHOR_FIELDS = [
    "offset_start", "offset_end", "line_start", "line_end", "header_row", "row_start", "row_end", "column_start", "column_end", "paragraph_start", "paragraph_end", "table_index",
]
CHUNKER_VERSION = 3
STRATEGIES = ("auto", "heading", "heuristic", "recursive")


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "auto"
    enable_parent_child: bool = True
    parent_chunk_size: int = 4096
    child_chunk_size: int = 384
    chunk_size: int = 512
    chunk_overlap: int = 80

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if min(self.parent_chunk_size, self.child_chunk_size, self.chunk_size) < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("sizes must be positive and the overlap smaller than the chunk")
        if self.enable_parent_child and self.child_chunk_size >= self.parent_chunk_size:
            raise ValueError("children must be smaller than parents")

    @classmethod
    def decode(cls, text: str) -> ChunkingConfig:
        """From JSON; unknown fields are an error, absent ones have their defaults."""
        given = json.loads(text)
        if odd := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {sorted(odd)}")
        return cls(**given)

    def set_hash(self) -> str:
        """Natural key of a chunking product."""
        return hashlib.sha256(json.dumps(asdict(self) | {"version": CHUNKER_VERSION}, sort_keys=True).encode()).hexdigest()


# --- spans: windows of a text, and what they cover -----------------------------------------------------------------------


class Breaks:
    """The places of a text where a window had better end, by rank: after paragraphs, after lines, after sentences. They are looked for backwards from a window's end."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)

    def before(self, low: int, high: int) -> int:
        """The last break of the best rank in (low, high], or high."""
        text = self.text
        at = text.rfind("\n\n", max(low - 1, 0), high)  # a paragraph ends behind both line feeds
        if at >= 0:
            return at + 2
        at = text.rfind("\n", low, high)
        if at < 0:
            at = max(text.rfind(c, low, high) for c in SENTENCE_ENDS)
        return at + 1 if at >= 0 else high

    def windows(self, size: int, overlap: int, heading: int = 0) -> Iterator[tuple[int, int]]:
        """[start, end) of each window. The next one starts `overlap` before the end, but not within the first `heading` characters once these are covered."""
        at = 0
        while at + size <= self.size:
            end = self.before(at + size // 2, at + size)
            yield at, end
            if end == self.size:
                return
            again = max(end - overlap, heading if heading <= end else 0)
            at = again if again > at else end
        if at < self.size:
            yield at, self.size


def windows(text: str, size: int, overlap: int, heading: int = 0) -> Iterator[tuple[int, int]]:
    return Breaks(text).windows(size, overlap, heading)


#: Coordinates of anchors by which two spans are known to follow each other, the first pair that both have.
COORDINATES = ("row", "offset", "paragraph", "line")
#: Fields that must be equal, absence included.
PLACE = ("source_type", "sheet", "header_row", "table_index")


def merge_anchors(left: dict, right: dict) -> dict:
    """The span of two source anchors, the first before the second; ValueError where they lie in different places or don't follow each other."""
    for name in PLACE:
        if left.get(name) != right.get(name):
            raise ValueError(f"anchors differ in {name}")
    for c in COORDINATES:
        a, z, b, y = (x.get(f"{c}_{end}") for x in (left, right) for end in ("start", "end"))
        if None not in (a, z, b, y):
            if b < a or (c == "row" and b > z + 1):
                raise ValueError(f"anchors don't follow each other by {c}")
            break
    out = {}
    for name in dict.fromkeys([*left, *right]):
        given = [x[name] for x in (left, right) if x.get(name) is not None]
        if given:
            out[name] = min(given) if name.endswith("_start") else max(given) if name.endswith("_end") else given[0]
    return out


_NUMBERED = re.compile(r"[0-9]+[.、)]")
_CHAPTER = re.compile(r"第.*(?:章|节|部分)")


def is_boundary(text: str, kind: str = "paragraph") -> bool:
    """Whether a block starts a section by the heuristic rule: by its kind, or by its first line."""
    if kind in ("heading", "thematic_break"):
        return True
    line = text.strip(" \t\r\n").partition("\n")[0].strip(" \t\r")
    if not line:
        return False
    if line[0] in "\f#" or _CHAPTER.match(line) or _NUMBERED.match(line):
        return True
    if len(line.encode()) >= 3 and not line.strip("-_=*"):
        return True
    return re.fullmatch(r"[A-Z _:-]*", line) is not None and sum(c.isupper() for c in line) >= 3


def strategies(blocks: list[dict], config: ChunkingConfig) -> list[str]:
    """The strategy to try first, then those to fall back on."""
    order = ["heading", "heuristic", "recursive"]
    first = config.strategy
    if first == "auto":
        first = "heading" if any(b["kind"] == "heading" or b.get("heading_path") for b in blocks) else "heuristic"
    return [first, *(s for s in order if s != first)]


def sections(blocks: list[dict], strategy: str) -> list[list[dict]]:
    """Runs of blocks that are cut into windows together; a table (header and rows of one id) is a run of its own."""
    out: list[list[dict]] = []
    for b in blocks:
        table = b.get("table_id") if b["kind"] in ("table_header", "table_row") else None
        last = out[-1][-1] if out else None
        was = last.get("table_id") if last and last["kind"] in ("table_header", "table_row") else None
        new = last is None or table != was or b["kind"] == "table_header"
        if not new and table is None:
            if strategy == "heading":
                new = b["kind"] == "heading" or b.get("heading_path", []) != last.get("heading_path", [])
            elif strategy == "heuristic":
                new = is_boundary(b["text"], b["kind"])
        if new:
            out.append([b])
        else:
            out[-1].append(b)
    return out


def span_of(anchors: list[dict]) -> dict:
    return functools.reduce(merge_anchors, anchors) if anchors else {}


def table_pieces(header: dict, rows: list[dict], size: int) -> list[dict]:
    """Rows packed under repeated headers. A piece takes rows while their running length stays within size; one that doesn't fit even alone is marked."""
    head, room = header["text"], size - len(header["text"])
    packs: list[list[dict]] = [[]]
    left = room
    for r in rows:
        need = 2 + len(r["text"])
        if packs[-1] and need > left:
            packs.append([])
            left = room
        packs[-1].append(r)
        left -= need
    out = []
    for pack in packs:
        content = "\n\n".join([head, *(r["text"] for r in pack)])
        anchor = span_of([r.get("anchor", {}) for r in pack]) if pack else dict(header.get("anchor", {}))
        if (n := header.get("anchor", {}).get("header_row")) is not None:
            anchor.setdefault("header_row", n)
        out.append({"content": content, "heading_path": header.get("heading_path", []), "anchor": anchor, "oversized": bool(pack) and len(content) > size, "metadata": {"block_kind": "table"}})
    return out


def section_pieces(blocks: list[dict], size: int, overlap: int) -> list[dict]:
    """Windows over a section's blocks, joined by blank lines; each window knows the blocks that it covers by their intervals."""
    text = "\n\n".join(b["text"] for b in blocks)
    begins = [0, *itertools.accumulate(len(b["text"]) + 2 for b in blocks[:-1])]
    ends = [a + len(b["text"]) for a, b in zip(begins, blocks, strict=True)]
    heading = 0 if blocks[0]["kind"] != "heading" else begins[1] if len(blocks) > 1 else ends[0]
    out = []
    for start, end in Breaks(text).windows(size, overlap, heading):
        content = text[start:end].strip()
        if not content:
            continue
        first, last = bisect_right(ends, start), bisect_left(begins, end)
        met = blocks[first:last]
        details = {"block_kind": met[0]["kind"] if len(met) == 1 else "mixed"}
        if met and (begins[first] < start or ends[last - 1] > end):
            details["anchor_granularity"] = "block"
            if len(met) == 1 and met[0]["kind"] == "code":
                details["code_block_sequence"] = met[0].get("sequence", first)
        out.append({"content": content, "heading_path": blocks[0].get("heading_path", []), "anchor": span_of([b.get("anchor", {}) for b in met]), "oversized": False, "metadata": details})
    return out


def border(left: str, right: str, limit: int) -> int:
    """The length of the longest text, up to limit, that ends left and starts right."""
    n = min(limit, len(left), len(right))
    at = left.find(right[0], len(left) - n) if n > 0 else -1
    while at >= 0 and not right.startswith(left[at:]):
        at = left.find(right[0], at + 1)
    return len(left) - at if at >= 0 else 0


def joined(left: str, right: str, limit: int) -> str:
    """Two texts in a row; their common border, up to limit, stands once, and without one a blank line stands between."""
    n = border(left, right, limit)
    return left + right[n:] if n else f"{left}\n\n{right}"


def parents_of(children: list[dict], size: int, overlap: int, lead: int) -> Iterator[tuple[int, int, str]]:
    """(first, behind the last, content) of each parent: as many children of one heading path in a row as size holds, led by the end of the parent before it."""
    for _, run in itertools.groupby(range(len(children)), key=lambda k: children[k]["heading_path"]):
        run, before, at = list(run), None, 0
        while at < len(run):
            content, many = children[run[at]]["content"], 1
            while at + many < len(run):
                longer = joined(content, children[run[at + many]]["content"], overlap)
                if len(longer) > size:
                    break
                content, many = longer, many + 1
            if before is not None:
                tail = before[max(len(before) - lead, 0) :] if lead else ""
                content = tail + content[border(tail, content, overlap) :]
            yield run[at], run[at + many - 1] + 1, content
            at, before = at + many, content


def header_of(title: str | None, headings: list[str], sheet: str | None) -> str:
    seen, out = set(), []
    for p in [title, *headings, sheet]:
        p = (p or "").strip()
        if p and p.casefold() not in seen:
            seen.add(p.casefold())
            out.append(p)
    return " > ".join(out)


def chunk_document(blocks: list[dict], config: ChunkingConfig, title: str | None = None) -> list[dict]:
    """Chunks of one document's blocks (kind, text, heading_path, anchor, table_id)."""
    nested = config.enable_parent_child
    size, overlap = (config.child_chunk_size, config.child_chunk_size // 5) if nested else (config.chunk_size, config.chunk_overlap)
    blocks = [b for b in blocks if b["text"]]

    def by(strategy: str) -> list[dict]:
        return [p for part in sections(blocks, strategy) for p in (table_pieces(part[0], part[1:], size) if part[0]["kind"] == "table_header" else section_pieces(part, size, overlap))]

    *tried, last = strategies(blocks, config)
    pieces = None
    for strategy in tried:
        with contextlib.suppress(ValueError):  # anchors that don't go together: the next strategy cuts elsewhere
            pieces = by(strategy)
            break
    if pieces is None:
        pieces = by(last)
    for k, p in enumerate(pieces):
        p |= {"context_header": header_of(title, p["heading_path"], p["anchor"].get("sheet")), "role": "child" if nested else "flat", "sequence": k, "parent": None}
    if not nested:
        return pieces
    out: list[dict] = []
    for first, behind, content in parents_of(pieces, config.parent_chunk_size, overlap, config.chunk_overlap):
        out.append(pieces[first] | {"content": content, "role": "parent"})
        out += [p | {"parent": first} for p in pieces[first:behind]]
    return out


# --- DataFrame operators -----------------------------------------------------------------------------------------------

CHUNK_SCHEMA = "document_id string, chunk_id string, role string, parent_chunk_id string, sequence int, content string, context_header string, embedding_content string, block_kind string, oversized boolean, anchor string, metadata string"


def chunk(parsed: DataFrame, config: ChunkingConfig, id_col: str = "document_id", text_col: str = "text", title_col: str | None = None, blocks_col: str | None = None) -> DataFrame:
    """Chunks of every document. Blocks are a JSON array in blocks_col, or the whole text is one paragraph."""
    given = parsed.select(F.col(id_col).cast("string"), text_col, (F.col(title_col) if title_col else F.lit(None).cast("string")).alias("_title"), (F.col(blocks_col) if blocks_col else F.lit(None).cast("string")).alias("_blocks"))
    key = config.set_hash()
    names = [x.split(" ")[0] for x in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, title, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = json.loads(blocks) if blocks else [{"kind": "paragraph", "text": text or ""}]
                for c in chunk_document(parts, config, title):
                    name = lambda role, n: hashlib.sha256(f"{doc}\n{key}\n{role}\n{n}".encode()).hexdigest()
                    whole = f"{c['context_header']}\n\n{c['content']}" if c["context_header"] else c["content"]
                    rows.append((doc, name(c["role"], c["sequence"]), c["role"], name("parent", c["parent"]) if c["parent"] is not None else None, c["sequence"], c["content"], c["context_header"], whole, c["metadata"]["block_kind"], c["oversized"], json.dumps(c["anchor"], sort_keys=True), json.dumps(c["metadata"], sort_keys=True)))
            if rows:
                kinds = [pa.int32() if n == "sequence" else pa.bool_() if n == "oversized" else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return given.mapInArrow(run, CHUNK_SCHEMA)


def fixed_windows(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of one size and step, natively: id, sequence, content.

    The text is cut into steps in one pass, and a window is its step with the beginning of those that follow, so the work follows the text's length.
    """
    from heronlake.functions.text import trim_all

    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    n, step = F.length(text_col), size - overlap
    many = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    steps = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    window = lambda parts, k: F.substring(F.array_join(F.slice(parts, k + 1, F.lit(-(-size // step))), ""), 1, size)
    # the steps are bound to a variable, so that they are made once a text
    windows = F.get(F.transform(F.array(steps), lambda parts: F.transform(F.sequence(F.lit(0), many - 1), lambda k: window(parts, k))), F.lit(0))
    cut = docs.where(n > 0).select(id_col, F.posexplode(windows).alias("sequence", "content"))
    return cut.select(id_col, "sequence", trim_all(F.col("content")).alias("content")).where("content <> ''")


def faq_chunks(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """One chunk an aggregate. questions: key, sequence, question; answers: key, answer. Repeated questions (by normal form) count once."""
    from heronlake.functions.text import faq_question, trim_all

    norm = questions.where(F.length(trim_all(F.col("question"))) > 0).withColumn("normal", faq_question(F.col("question")))
    first = norm.groupBy(key, "normal").agg(F.min_by(F.struct("sequence", trim_all(F.col("question")).alias("question")), "sequence").alias("q"))
    joined = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["question"]).alias("questions"))
    rows = joined.join(answers, key)
    lines = F.array_join(F.transform("questions", lambda q: F.concat(F.lit("Q: "), q)), "\n")
    return rows.select(key, F.size("questions").cast("long").alias("n_questions"), F.col("answer").alias("content"), F.array_join("questions", "\n").alias("embedding_content"), F.concat(lines, F.lit("\nA: "), F.col("answer")).alias("source"))


def boundary_column(block: Column) -> Column:
    """The heuristic boundary rule on text blocks as a native predicate."""
    line = F.btrim(F.split(F.btrim(block, F.lit(" \t\r\n")), "\n")[0], F.lit(" \t\r"))
    return line.rlike(r"^(#|\f|第.*(章|节|部分)|[0-9]+[.、)]|[-_=*]{3,}$)") | (line.rlike(r"^[A-Z _:-]+$") & line.rlike(r"[A-Z][^A-Z]*[A-Z][^A-Z]*[A-Z]"))
