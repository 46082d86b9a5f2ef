"""Content-addressed attachments and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_safe_relative_path

#: The types that may be stored, and the largest size.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp"}
LARGEST = 10 * 1024 * 1024
LINK = r"!\[[^\]]*\]\((attachments/[^)]+)\)"
SOURCE = r"<img[^>]*\ssrc=[\"'](attachments/[^\"']+)[\"']"


def body_refs(body: Column, include_html: bool = False) -> Column:
    """Distinct safe attachment paths of a body."""
    found = F.regexp_extract_all(body, F.lit(LINK), F.lit(1))
    if include_html:
        found = F.concat(found, F.regexp_extract_all(body, F.lit(SOURCE), F.lit(1)))
    return F.array_distinct(F.filter(found, is_safe_relative_path))


def extract_refs(notes: DataFrame, include_html: bool = False) -> DataFrame:
    return notes.select(F.explode(body_refs(F.coalesce("body", F.lit("")), include_html)).alias("path"), F.col("id").alias("note_id"))


def build_refs(notes: DataFrame) -> DataFrame:
    """The reference table, one row a path and note."""
    return extract_refs(notes).distinct()


def sync_refs(refs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, emptied paths) after bodies changed; edits is (note_id, old_body, new_body)."""
    old, new = (body_refs(F.coalesce(c, F.lit(""))) for c in ("old_body", "new_body"))
    gone = edits.select("note_id", F.explode(F.array_except(old, new)).alias("path"))
    more = edits.select(F.explode(F.array_except(new, old)).alias("path"), "note_id")
    after = refs.join(gone, ["path", "note_id"], "left_anti").select("path", "note_id").union(more).distinct()
    return after, gone.select("path").distinct().join(after, "path", "left_anti")


def drop_refs(refs: DataFrame, note_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, emptied paths) after notes (note_id) went."""
    after = refs.join(note_ids, "note_id", "left_anti").select("path", "note_id")
    touched = refs.join(note_ids, "note_id", "left_semi").select("path").distinct()
    return after, touched.join(after, "path", "left_anti")


def orphan_attachments(stored: DataFrame, notes: DataFrame) -> DataFrame:
    """Stored paths that no live body refers to."""
    return stored.join(extract_refs(notes).select("path"), "path", "left_anti")


def sweep(stored: DataFrame, refs: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orphans, refs): stored paths that no live body refers to, and the reference rows without those of the orphans."""
    orphans = orphan_attachments(stored, notes)
    return orphans, refs.join(orphans.select("path"), "path", "left_anti").select("path", "note_id")


def with_policy(blobs: DataFrame) -> DataFrame:
    """blobs (mime, content) with ext, size and the reason for a rejection."""
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    size = F.octet_length("content")
    reason = F.when(kinds[F.col("mime")].isNull(), "type not allowed").when(F.col("content").isNull(), "no content").when(size > LARGEST, "too large")
    return blobs.withColumns({"ext": kinds[F.col("mime")], "size": size, "reason": reason})


def store_attachments(blobs: DataFrame) -> DataFrame:
    """(path, sha256, ext, n_copies): one stored copy for each content and type."""
    hashed = with_policy(blobs).filter("reason is null").select(F.sha2("content", 256).alias("sha256"), "ext")
    one = hashed.groupBy("sha256", "ext").agg(F.count(F.lit(1)).alias("n_copies"))
    return one.select(F.concat(F.lit("attachments/"), "sha256", F.lit("."), "ext").alias("path"), "sha256", "ext", "n_copies")


def harvest_inline_images(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, n, mime, content) of allowed data-URI images in HTML, numbered a page."""
    pattern = r"<img[^>]*\ssrc=[\"']data:(image/[a-z+.-]+);base64,([A-Za-z0-9+/=\s]+)[\"']"
    found = pages.select(id_col, F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("mime"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("data")).alias("z"))
    allowed = found.withColumn("z", F.filter("z", lambda x: x["mime"].isin(*EXTENSIONS)))
    return allowed.select(id_col, F.posexplode("z").alias("n", "x")).select(id_col, "n", "x.mime", F.try_to_binary("x.data", F.lit("base64")).alias("content"))
