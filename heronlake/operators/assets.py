"""Images that documents refer to: their references, checks and stored objects, and the references rewritten to these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import HTML_IMAGE_REF, IMAGE_REF, MIME_EXTENSIONS, asset_refs, data_uri, mime_extension, object_key, relative_path

#: Most images of one document, and bytes of one image.
MAX_ASSETS, MAX_BYTES = 200, 20 << 20


def references(docs: DataFrame, id_col: str, markdown_col: str) -> DataFrame:
    """(id, n, ref, kind, path): the distinct image references of each document in order; kind is data, remote or relative, path the normal form of a relative one."""
    each = docs.select(id_col, F.posexplode(asset_refs(F.col(markdown_col))).alias("n", "ref"))
    kind = F.when(F.lower("ref").startswith("data:"), "data").when(F.col("ref").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "remote").otherwise("relative")
    return each.withColumn("kind", kind).withColumn("path", F.when(F.col("kind") == "relative", relative_path(F.col("ref"))))


def resolve(refs: DataFrame, files: DataFrame, id_col: str, max_assets: int = MAX_ASSETS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, n, ref, key, mime, content, problem): the bytes of each data or relative reference, or why there are none.

    files: id, path, mime, content, of the documents' archives. Problems: remote (not fetched here), missing, type (not one of MIME_EXTENSIONS), size, or
    count (a reference beyond the document's max_assets, which takes no other document's place).
    """
    known = files.select(id_col, "path", F.col("mime").alias("_mime"), F.col("content").alias("_content"))
    met = refs.join(known, [id_col, "path"], "left")
    inline = F.col("kind") == "data"
    mime = F.lower(F.when(inline, F.regexp_extract("ref", r"^[Dd]ata:([^;,]*)", 1)).otherwise(F.col("_mime")))
    content = F.when(inline, data_uri(F.col("ref"), max_bytes)).otherwise(F.col("_content"))
    encoded = F.length(F.regexp_extract("ref", r",(.*)$", 1))
    problem = (
        F.when(F.col("n") >= max_assets, "count").when(F.col("kind") == "remote", "remote").when(~inline & F.col("_mime").isNull(), "missing").when(~mime.isin(*MIME_EXTENSIONS), "type")
        .when(F.when(inline, encoded * 3 / 4 > max_bytes + 2).otherwise(F.octet_length("_content") > max_bytes), "size").when(content.isNull(), "missing")
    )
    rows = met.select(id_col, "n", "ref", mime.alias("mime"), content.alias("content"), problem.alias("problem"))
    key = F.when(F.col("problem").isNull(), F.concat(object_key(F.lit("assets"), F.col(id_col), F.sha2("content", 256)), F.lit("."), mime_extension(F.col("mime"))))
    return rows.select(id_col, "n", "ref", key.alias("key"), F.when(F.col("problem").isNull(), F.col("mime")).alias("mime"), F.when(F.col("problem").isNull(), F.col("content")).alias("content"), "problem")


def rewrite(docs: DataFrame, resolved: DataFrame, id_col: str, markdown_col: str, prefix: str = "asset://") -> DataFrame:
    """docs whose resolved references point to their stored objects; others stay as they are.

    Only the address within an image reference is replaced: the same words elsewhere in the text stay.
    """
    table = resolved.where("key is not null").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("ref", "key"))).alias("_keys"))

    def place(text: Column, pattern: str) -> Column:
        """The text with each reference's address replaced, by the pieces between references and the references themselves."""
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        between = F.split(text, pattern, -1)
        refs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        new = F.zip_with(found, refs, lambda whole, ref: F.when(F.element_at("_keys", ref).isNull(), whole).otherwise(F.replace(whole, ref, F.concat(F.lit(prefix), F.element_at("_keys", ref)))))
        return F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    both = place(place(F.col(markdown_col), IMAGE_REF), HTML_IMAGE_REF)
    named = docs.join(table, id_col, "left")
    return named.select(*(F.when(F.col("_keys").isNull(), F.col(c)).otherwise(both).alias(c) if c == markdown_col else F.col(c) for c in docs.columns))


def archived(old: DataFrame, resolved: DataFrame, id_col: str) -> DataFrame:
    """Asset rows (id, n, key, mime, size) after documents are archived again: theirs are replaced, those of other documents stay."""
    new = resolved.where("key is not null").select(id_col, "n", "key", "mime", F.octet_length("content").cast("long").alias("size"))
    return old.join(resolved.select(id_col).distinct(), id_col, "left_anti").select(*new.columns).unionByName(new)
