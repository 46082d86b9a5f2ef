"""Incremental upkeep of the vector index."""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_fingerprint
from corpusloom.operators.chunking import plan_chunks
from corpusloom.operators.embedding import Embedder, embed_chunks
from corpusloom.sources.tables import stored

SCHEMA_VERSION = 3
KINDS = ("title", "body")


@dataclass
class Profile:
    model_id: str
    dimensions: int
    schema_version: int = SCHEMA_VERSION


def fingerprints(notes: DataFrame) -> DataFrame:
    return notes.withColumn("content_hash", content_fingerprint(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))


def plan_reindex(notes: DataFrame, indexed: DataFrame, profile: Profile) -> DataFrame:
    """(id, content_hash, stale) for notes (id, title, body) against indexed (note_id, content_hash, model_id, dimensions, schema_version)."""
    own = fingerprints(notes).select("id", "content_hash")
    old = indexed.select(F.col("note_id").alias("id"), F.col("content_hash").alias("_hash"), "model_id", "dimensions", "schema_version")
    current = F.col("content_hash").eqNullSafe(F.col("_hash")) & F.col("model_id").eqNullSafe(F.lit(profile.model_id)) & F.col("dimensions").eqNullSafe(F.lit(profile.dimensions)) & F.col("schema_version").eqNullSafe(F.lit(profile.schema_version))
    return own.join(old, "id", "left").select("id", "content_hash", (~current).alias("stale"))


def headers(planned: DataFrame, profile: Profile) -> DataFrame:
    return planned.select(F.col("id").alias("note_id"), "content_hash", F.lit(profile.model_id).alias("model_id"), F.lit(profile.dimensions).alias("dimensions"), F.lit(profile.schema_version).alias("schema_version"))


def reindex_stored(notes: DataFrame, path: str, embedder: Embedder, store: Callable[[DataFrame], DataFrame] = stored, texts: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """(plan, buckets written): bring the index stored at path up to date with notes (id, title, body).

    Stale notes are cut and embedded anew, notes that are gone leave the index, and a note without text keeps a header. Only
    the buckets of such notes are read for their chunks and written. texts are the same notes dealt to the tasks that cut and embed;
    hashes and ids are taken from notes, where they lie.
    """
    from corpusloom.sources.index_store import read_stored, update_index

    profile = Profile(embedder.id, embedder.dimensions)
    (held,) = read_stored(notes.sparkSession, path, tables=("headers",))
    plan = store(plan_reindex(notes, held, profile))
    stale = plan.filter("stale").select("id", "content_hash")
    fresh = embed_chunks(plan_chunks(_only(texts or notes, stale), embedder.passage_prefix), embedder).withColumn("model_id", F.lit(embedder.id))
    removed = store(prune_orphans(held, notes)[1].select("note_id").distinct())
    return plan, update_index(headers(stale, profile), fresh, removed, path)


def _only(notes: DataFrame, stale: DataFrame) -> DataFrame:
    return notes.join(stale.select("id"), "id", "left_semi")


def reindex(notes: DataFrame, indexed: DataFrame, chunks: DataFrame, embedder: Embedder, store: Callable[[DataFrame], DataFrame] = stored, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, chunks, plan): only stale notes are cut and embedded anew; a note without text keeps a header alone. The plan is
    stored, as all three need it: notes are hashed once. texts as in reindex_stored()."""
    profile = Profile(embedder.id, embedder.dimensions)
    plan = store(plan_reindex(notes, indexed, profile))
    stale = plan.filter("stale").select("id", "content_hash")
    fresh = embed_chunks(plan_chunks(_only(texts or notes, stale), embedder.passage_prefix), embedder)
    fresh = fresh.select("note_id", "idx", "kind", "text", "offset", "length", "embedding").withColumn("model_id", F.lit(embedder.id))
    gone = stale.select(F.col("id").alias("note_id"))
    kept = chunks.join(gone, "note_id", "left_anti").select(*fresh.columns)
    new_headers = indexed.join(gone, "note_id", "left_anti").select("note_id", "content_hash", "model_id", "dimensions", "schema_version").unionByName(headers(stale, profile))
    return new_headers, kept.unionByName(fresh), plan


def prune_orphans(indexed: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows of an index table by the ids of live notes."""
    ids = live.select(F.col("id").alias("note_id"))
    return indexed.join(ids, "note_id", "left_semi"), indexed.join(ids, "note_id", "left_anti")


def ensure_manifest(indexed: DataFrame, profile: Profile) -> DataFrame:
    """The rows that belong to the profile's model; rows of another are left out, never mixed."""
    return indexed.filter((F.col("model_id") == profile.model_id) & (F.col("dimensions") == profile.dimensions) & (F.col("schema_version") == profile.schema_version))


def validate_index(df: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """df (note_id, idx, kind, offset, length, dimensions, embedding, inline_embedding) in the current shape, with a reason
    where a record is not valid. Older records hold their vectors inline."""
    vector = F.coalesce("embedding", "inline_embedding")
    reason = (
        F.when(F.col("note_id").isNull() | F.col("idx").isNull() | F.col("offset").isNull() | F.col("length").isNull(), "field missing")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(vector.isNull(), "no vector")
        .when(F.size(vector) != F.col("dimensions"), "vector length")
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "vector value")
    )
    upgraded = F.col("embedding").isNull() & F.col("inline_embedding").isNotNull()
    return df.select("note_id", "idx", "kind", *others, "offset", "length", "dimensions", vector.alias("embedding"), upgraded.alias("upgraded"), reason.alias("reason"))


def progress_percent(done: int, total: int) -> int:
    return 100 if total <= 0 else min(100, max(0, round(100 * done / total)))


def full_reindex(notes: DataFrame, indexed: DataFrame, chunks: DataFrame, attachments: DataFrame, embedder: Embedder, store: Callable[[DataFrame], DataFrame] = stored, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(headers, chunks, orphans, report) of a full pass: records of notes that are gone are pruned, stale notes embedded
    anew, attachments without a reference swept. The report is one row of counts of what was done. texts as in reindex_stored()."""
    from corpusloom.operators.attachments import orphan_attachments

    kept, dropped = prune_orphans(indexed, notes)
    new_headers, new_chunks, plan = reindex(notes, kept, prune_orphans(chunks, notes)[0], embedder, store, texts)
    new_headers, new_chunks, orphans = store(new_headers), store(new_chunks), store(orphan_attachments(attachments, notes))
    n = lambda df, name, kind=None: df.agg((F.count(F.lit(1)) if kind is None else F.count_if(kind)).alias(name))
    counts = [n(dropped, "n_pruned"), n(plan, "n_embedded", F.col("stale")), n(plan, "n_skipped", ~F.col("stale")), n(orphans, "n_orphans"), n(new_headers, "n_headers"), n(new_chunks, "n_chunks")]
    report = counts[0]
    for c in counts[1:]:
        report = report.join(F.broadcast(c))  # one row each
    return new_headers, new_chunks, orphans, report
