"""Catalogue of notes: deduplication, reconciliation, rebuilding, changes and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import note_path, trim_white
from corpusloom.operators.attachments import build_refs
from corpusloom.operators.spaces import recover_spaces


def dedupe_by_id(records: DataFrame) -> DataFrame:
    """One record an id: the greatest updated_at as text, of equal ones the first path."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("updated_at"), "path"))
    return records.withColumn("_n", place).filter("_n = 1").drop("_n")


def reconcile_diff(prior: DataFrame, new: DataFrame) -> DataFrame:
    """One row: ids added, removed and common."""
    a, b = prior.select(F.col("id").alias("a")).distinct(), new.select(F.col("id").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("a").isNull()).alias("n_added"), F.count_if(F.col("b").isNull()).alias("n_removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"))


def snapshot_changed(prior: DataFrame | None, new: DataFrame) -> bool:
    """Whether two snapshots hold other rows: by their number and two sums of 64-bit digests, so that no row leaves its task. Unlike snapshots
    have the same sums once in 2^128."""
    if prior is None:
        return True
    columns = sorted(new.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})  # a digest of columns takes a null for an empty list
    rows = [F.xxhash64(F.lit(k), text).cast("decimal(20, 0)") for k in (1, 2)]
    told = [df.select(*columns).agg(F.count(F.lit(1)), *(F.sum(r) for r in rows)).first() for df in (prior, new)]
    return told[0] != told[1]


def reconcile(parsed: DataFrame, rejected: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, skipped): files are the truth; a file that can't be read keeps its prior record, else it is skipped.

    A prior that is bucketed by path (sources.tables.bucketed) stays where it is: only the rejected files are sent to it.
    """
    columns = ["id", "title", "path", "created_at", "updated_at", "space_ids"]
    kept = prior.join(rejected.select("path"), "path", "left_semi").select(*columns)
    skipped = rejected.join(prior.select("path"), "path", "left_anti")
    return dedupe_by_id(parsed.select(*columns).unionByName(kept)), skipped


def reconcile_report(prior: DataFrame, kept: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: records added, removed and changed by a reconciliation, and files skipped."""
    columns = [c for c in kept.columns if c in prior.columns and c != "id"]
    old = prior.select(F.col("id").alias("_id"), F.struct(*columns).alias("_old"))
    both = kept.select("id", F.struct(*columns).alias("_new")).join(old, F.col("id") == F.col("_id"), "full_outer")
    counts = both.agg(F.count_if(F.col("_id").isNull()).alias("n_added"), F.count_if(F.col("id").isNull()).alias("n_removed"), F.count_if(F.col("id").isNotNull() & F.col("_id").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))).alias("n_changed"))
    return counts.join(F.broadcast(skipped.agg(F.count(F.lit(1)).alias("n_skipped"))))  # one row each


def rebuild_catalog(parsed: DataFrame, rejected: DataFrame) -> dict[str, DataFrame]:
    """Catalogue, references, recovered spaces and skipped files from the files alone, and a report of one row."""
    notes = dedupe_by_id(parsed)
    refs, spaces = build_refs(parsed), recover_spaces(parsed)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = [n(notes, "n_notes"), n(parsed, "n_files"), n(rejected, "n_skipped"), n(spaces, "n_spaces"), n(refs.select("path").distinct(), "n_paths"), n(refs, "n_refs")]
    report = counts[0]
    for c in counts[1:]:
        report = report.join(F.broadcast(c))  # one row each
    report = report.select("n_notes", (F.col("n_files") - F.col("n_notes")).alias("n_duplicates"), "n_skipped", "n_spaces", "n_paths", "n_refs")
    return {"catalog": notes, "refs": refs, "spaces": spaces, "skipped": rejected, "report": report}


def apply_changes(notes: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, unknown ids) after changes (op, id, new_id, title, body, space_ids).

    update keeps what is omitted and never moves the path; duplicate copies title, body and spaces under new_id;
    create adds; delete removes. An id can have one change of each kind.
    """
    columns = ["id", "title", "body", "path", "created_at", "updated_at", "space_ids"]
    of = lambda op: changes.filter(F.col("op") == op)
    patch = of("update").select("id", *(F.col(c).alias(f"_{c}") for c in ("title", "body", "space_ids")), F.lit(True).alias("_hit"))
    new = lambda c: F.coalesce(f"_{c}", c).alias(c)
    updated = notes.join(patch, "id", "left").select("id", new("title"), new("body"), "path", "created_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")).alias("updated_at"), new("space_ids"))
    left = updated.join(of("delete").select("id"), "id", "left_anti")
    copy_title = F.when(trim_white(F.col("title")) != "", F.concat("title", F.lit(" (copy)"))).otherwise("Untitled (copy)")
    copies = notes.join(of("duplicate").select("id", "new_id"), "id").select(F.col("new_id").alias("id"), copy_title.alias("title"), "body", "space_ids")
    made = copies.unionByName(of("create").select(F.col("new_id").alias("id"), "title", "body", "space_ids"))
    made = made.select("id", "title", "body", note_path(F.col("title"), F.col("id"), now).alias("path"), now.alias("created_at"), now.alias("updated_at"), "space_ids")
    unknown = of("update").select("id").join(notes.select("id"), "id", "left_anti")
    return left.select(*columns).unionByName(made), unknown


def by_recency(notes: DataFrame) -> DataFrame:
    return notes.orderBy(F.desc("updated_at"), "id")


def most_recent(notes: DataFrame) -> DataFrame:
    return by_recency(notes).limit(1)


def lookup(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id) with the note's columns and whether it is missing."""
    found = notes.withColumn("_found", F.lit(True))
    return wanted.join(found, "id", "left").withColumn("missing", F.col("_found").isNull()).drop("_found")
