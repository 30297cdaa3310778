"""Text and scalar expressions: native columns unless the name says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because regex engines differ on \s.
WHITE = r"[ \t\n\x0B\f\r\x85\xA0  -     　]"


def trim_all(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def non_blank(text: Column) -> Column:
    return F.length(trim_all(F.coalesce(text, F.lit("")))) > 0


def tokens(text: Column) -> Column:
    """The `simple` full-text rule: small letters, split at all that is neither letter nor digit."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def normalize_newlines(text: Column) -> Column:
    """No byte-order mark, line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def faq_question(text: Column) -> Column:
    """A question as it is compared: one space between words, small letters."""
    return F.lower(trim_all(F.regexp_replace(text, rf"{WHITE}+", " ")))


def file_type(name: Column, content_type: Column) -> Column:
    """Type by the name's extension, else by the content type's subtype; `md` is `markdown`."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    sub = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"/([A-Za-z0-9.+-]+)", 1))
    return normalize_type(F.coalesce(F.nullif(ext, F.lit("")), F.nullif(sub, F.lit(""))))


def normalize_type(kind: Column) -> Column:
    short = F.regexp_replace(F.lower(trim_all(kind)), r"^\.", "")
    return F.when(short == "md", "markdown").otherwise(short)


def web_uri(uri: Column) -> Column:
    """Identity of a web source: scheme and host in small letters, no default port, no fragment, `/` for an empty path.

    Null for anything but http(s) with a host, and for addresses with credentials.
    """
    m = lambda k: F.regexp_extract(trim_all(uri), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", k)
    scheme, authority, path, query = F.lower(m(1)), F.lower(m(2)), m(3), m(4)
    host = F.when(scheme == "http", F.regexp_replace(authority, ":(80)?$", "")).otherwise(F.regexp_replace(authority, ":(443)?$", ""))
    good = scheme.isin("http", "https") & (host != "") & ~authority.contains("@")
    return F.when(good, F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def sync_root(url: Column) -> Column:
    """Kind of a sync root's address: a drive folder, or a wiki node (also for documents and bare tokens); null if neither."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+(/[^?#]*)?", 1)
    return (
        F.when(path.rlike("/drive/folder/[A-Za-z0-9_-]+"), "drive_folder")
        .when(path.rlike("/(wiki|docx)/[A-Za-z0-9_-]+"), "wiki_node")
        .when(url.rlike("^[A-Za-z0-9_-]+$"), "wiki_node")
    )


def sync_token(url: Column) -> Column:
    """The token in a sync root's address."""
    found = F.regexp_extract(url, r"/(?:drive/folder|wiki|docx)/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found).when(url.rlike("^[A-Za-z0-9_-]+$"), url)


def context_header(title: Column, headings: Column, sheet: Column) -> Column:
    """Title, headings and sheet joined by ` > `; blank parts and parts that differ only in case from one before are left out."""
    parts = F.transform(F.filter(F.concat(F.array(title), F.coalesce(headings, F.array().cast("array<string>")), F.array(sheet)), lambda p: p.isNotNull()), trim_all)
    once = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(once, " > ")


def embedding_text(header: Column, content: Column) -> Column:
    return F.when(header == "", content).otherwise(F.concat(header, F.lit("\n\n"), content))


IMAGE_REF = r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"
HTML_IMAGE_REF = r"""<img[^>]*\ssrc=["']([^"']+)["']"""


def asset_refs(markdown: Column) -> Column:
    """Addresses of images in Markdown and HTML form, each once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(markdown, F.lit(IMAGE_REF), 1), F.regexp_extract_all(markdown, F.lit(HTML_IMAGE_REF), 1)))


def relative_path(path: Column) -> Column:
    """A reference's path: slashes forward, percent codes decoded, no leading `./`."""
    forward = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.url_decode(F.replace(forward, F.lit("+"), F.lit("%2B"))), r"^(\./)+", "")


def data_uri(uri: Column, max_bytes: int) -> Column:
    """Bytes of a base64 data address; null if it is none or would be larger than max_bytes."""
    body = F.regexp_extract(uri, r"^data:[A-Za-z0-9.+/-]+;base64,([A-Za-z0-9+/=\s]*)$", 1)
    return F.when((body != "") & (F.length(body) * 3 / 4 <= max_bytes + 2), F.unbase64(body))


MIME_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp"}


def mime_extension(mime: Column) -> Column:
    out = F.lit("bin")
    for k, v in MIME_EXTENSIONS.items():
        out = F.when(F.lower(trim_all(mime)) == k, v).otherwise(out)
    return out


def object_key(*parts: Column) -> Column:
    """Deterministic key of a stored object: its parts with odd characters replaced."""
    return F.concat_ws("/", *(F.regexp_replace(p.cast("string"), "[^A-Za-z0-9._-]", "_") for p in parts))


def task_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def api_key_status(revoked_at: Column, expires_at: Column, now: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "revoked").when(expires_at <= now, "expired").otherwise("active")


def sync_state(candidate_ready: Column, failed: Column, updating: Column) -> Column:
    return F.when(candidate_ready, "candidate_ready").when(failed, "failed").when(updating, "updating").otherwise("synced")


def delete_policy(text: Column) -> Column:
    """`keep` or `remove`, leniently read; anything else is `keep`."""
    return F.when(F.lower(trim_all(text)) == "remove", "remove").otherwise("keep")


def millis(text: Column) -> Column:
    """Epoch milliseconds as text to a timestamp; null if it isn't one."""
    return F.timestamp_millis(text.try_cast("bigint"))


def display_name(*names: Column, default: str = "-") -> Column:
    """The first name that isn't blank, trimmed, else the default."""
    return F.coalesce(*(F.nullif(trim_all(n), F.lit("")) for n in names), F.lit(default))


def strict_delete_policy(text: Column) -> Column:
    """`keep` or `remove`, strictly read: null, empty and other values end the query."""
    read = F.lower(trim_all(F.coalesce(text, F.lit(""))))
    return F.when(read.isin("keep", "remove"), read).otherwise(F.raise_error(F.concat(F.lit("unknown source delete policy: "), F.coalesce(text, F.lit("null")))).cast("string"))


#: Fixed pattern of a time with date, seconds and zone.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(text: Column) -> Column:
    """A time in RFC 3339 form; null for anything else, also for times without a zone."""
    return F.when(trim_all(text).rlike(RFC3339), F.try_to_timestamp(F.upper(trim_all(text))))


#: What users read of job types, generation states, job errors and blockers.
JOB_LABELS = {"document_parse_start": "导入文件", "document_index": "更新 FAQ", "chunk_revision_index": "修订分块", "index_generation_build": "构建索引版本"}
JOB_LABEL = "处理任务"
GENERATION_LABELS = {"building": "构建中", "ready": "待激活", "stale": "已过期", "failed": "构建失败", "retired": "已退役"}
GENERATION_LABEL, ACTIVE_LABEL = "状态未知", "当前生效"
JOB_ERRORS = {
    "invalid_document": "任务参数无效，请检查相关内容。",
    "validation_error": "任务参数无效，请检查相关内容。",
    "provider_error": "外部处理服务返回错误，请检查模型或解析配置。",
    "embedding_error": "外部处理服务返回错误，请检查模型或解析配置。",
    "parse_error": "外部处理服务返回错误，请检查模型或解析配置。",
    "enqueue_error": "任务暂未成功进入队列，请稍后重新执行相关操作。",
    "generation_stale": "内容已更新，此索引版本需要重新构建。",
}
JOB_ERROR = "任务执行失败，请检查相关资源后重试。"
BLOCKER_MESSAGES = {
    "document_processing_failed": "内容处理失败，请查看任务并重新导入或删除内容。",
    "generation_build_failed": "索引版本构建失败，请检查模型配置后重新构建。",
    "generation_stale": "内容已更新，此索引版本已经过期，请重新构建。",
    "active_model_unavailable": "当前索引使用的模型不可用，请启用模型或构建新的索引版本。",
}
BLOCKER_MESSAGE = "此资源当前阻止知识库完成同步，请检查相关配置。"


def lookup(value: Column, labels: dict[str, str], default: str) -> Column:
    """The label of a value, else the default."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.element_at(table, value), F.lit(default))


def job_label(kind: Column) -> Column:
    return lookup(kind, JOB_LABELS, JOB_LABEL)


def generation_label(status: Column, active: Column) -> Column:
    return F.when(active & (status == "ready"), ACTIVE_LABEL).otherwise(lookup(status, GENERATION_LABELS, GENERATION_LABEL))


def job_error(error_class: Column, error: Column) -> Column:
    """What a user reads of a job's error; empty where there is none. The error itself isn't shown."""
    none = ~non_blank(error_class) & ~non_blank(error)
    return F.when(none, "").otherwise(lookup(error_class, JOB_ERRORS, JOB_ERROR))


def document_title(fetched: Column, listed: Column, token: Column) -> Column:
    """A synced document's title: as fetched, else as listed, else its token."""
    return F.coalesce(F.nullif(trim_all(fetched), F.lit("")), F.nullif(trim_all(listed), F.lit("")), token)


def cjk_tokens(text: Column, dictionary: list[str] | None = None) -> Column:
    """The `cjk` full-text rule: as `simple`, with runs of Han characters cut into the dictionary's words (the longest first) and, between
    these, into overlapping pairs of characters; a single character stands alone. The dictionary is a parameter of modest size."""
    words = "|".join(sorted((re.escape(w) for w in dictionary or []), key=lambda w: (-len(w), w)))
    known = F.array(*map(F.lit, dictionary or [])).cast("array<string>")

    def pairs(run: Column) -> Column:
        n = F.length(run)
        return F.when((n < 2) | F.array_contains(known, run), F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))))

    def cut(token: Column) -> Column:
        runs = F.regexp_extract_all(token, F.lit(r"\p{IsHan}+|[^\p{IsHan}]+"), F.lit(0))
        split = F.flatten(F.transform(runs, lambda r: F.filter(F.split(F.regexp_replace(r, f"({words})", " $1 ") if words else r, " "), lambda x: x != "")))
        return F.flatten(F.transform(split, lambda r: F.when(r.rlike(r"^\p{IsHan}"), pairs(r)).otherwise(F.array(r))))

    return F.flatten(F.transform(tokens(text), cut))


_MARKS = r"([\\`*_\[\]<>|~])"
#: A heading, a list's item, or a line that underlines a heading or rules a page off.
_STARTS = r"#{1,6}(?:[ \t]|$)|[-+](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$)|=+[ \t]*$|(?:[ \t]*-){3}[-\t ]*$"


def escape_markdown(text: Column) -> Column:
    """Plain text whose lines, ended by a line feed, read as themselves in Markdown: the parsers' rule (parsers.escape_line) for a whole column."""
    inline = F.regexp_replace(text, _MARKS, r"\\$1")
    code = F.regexp_replace(F.regexp_replace(inline, "(?md)^\t", "&#9;"), "(?md)^ (?=   )", "&#32;")
    return F.regexp_replace(code, f"(?md)^( {{0,3}})(?={_STARTS})", r"$1\\")
