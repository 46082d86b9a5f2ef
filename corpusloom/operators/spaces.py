"""Spaces: a many-to-many relation of tags and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.numbering import numbered
from corpusloom.functions.text import WHITE, trim_white
from corpusloom.operators.ranking import title_matches

GENERAL = "general"
COLORS = ("blue", "green", "amber", "red", "purple")


def parse_space_ids(c: Column) -> Column:
    """Distinct valid ids of a comma list, in order, without the built-in space."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_white)
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.rlike(f"[,{WHITE}]") & (x != GENERAL)))


def serialize_space_ids(ids: Column) -> Column:
    kept = F.filter(ids, lambda x: x != GENERAL)
    return F.when(F.size(kept) > 0, F.array_join(kept, ","))


def notes_in_space(notes: DataFrame, space_id: str) -> DataFrame:
    """notes (with space_ids as an array) of a space, newest first."""
    held = F.size("space_ids") == 0 if space_id == GENERAL else F.array_contains("space_ids", space_id)
    return notes.filter(held).orderBy(F.desc("updated_at"), "id")


def space_counts(spaces: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, name, n_notes): General and every stored space, also with no note; ids of no space are not listed."""
    ids = notes.select(F.explode_outer("space_ids").alias("id"))
    counts = ids.groupBy(F.coalesce("id", F.lit(GENERAL)).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    listed = spaces.select("id", "name").union(spaces.sparkSession.createDataFrame([(GENERAL, "General")], "id string, name string"))
    return listed.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_notes"))


def resolve_spaces(notes: DataFrame, spaces: DataFrame, omit_general: bool = False) -> DataFrame:
    """(id, space_names): names in the note's order; an id of no space is its own name; no ids mean General."""
    ids = notes.select("id", F.posexplode_outer("space_ids").alias("pos", "space_id"))
    named = ids.join(spaces.select(F.col("id").alias("space_id"), F.col("name").alias("space_name")), "space_id", "left")
    name = F.when(F.col("space_id").isNull(), F.lit(None if omit_general else "General")).otherwise(F.coalesce("space_name", "space_id"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", name.alias("name"))))
    return named.groupBy("id").agg(F.array_compact(F.transform(pairs, lambda p: p["name"])).alias("space_names"))


def delete_spaces(notes: DataFrame, spaces: DataFrame, ids: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, spaces) after spaces were deleted: their ids leave the notes, and touched notes are updated at `now`."""
    gone = F.array(*(F.lit(i) for i in ids if i != GENERAL)).cast("array<string>")
    touched = F.arrays_overlap("space_ids", gone)
    out = notes.withColumns({"touched": touched, "updated_at": F.when(touched, now).otherwise(F.col("updated_at")), "space_ids": F.array_except("space_ids", gone)})
    return out, spaces.filter(~F.array_contains(gone, F.col("id")))


def validate_spaces(df: DataFrame) -> DataFrame:
    """(id, name, description, reason): the cleaned name and why it can't be used."""
    name = trim_white(F.coalesce("name", F.lit("")))
    cleaned = df.withColumn("name", F.when(name == "", "Untitled").otherwise(name)).withColumn("description", F.nullif(trim_white(F.col("description")), F.lit("")))
    place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))
    numbered = cleaned.withColumn("_place", place)
    reason = F.when(F.lower("name") == GENERAL, "reserved name").when(F.col("_place") > 1, "duplicate name").when(~F.col("color_id").isin(*COLORS), "unknown colour")
    return numbered.select("id", "name", "description", "color_id", reason.alias("reason"))


def apply_space_patch(spaces: DataFrame, patches: DataFrame) -> DataFrame:
    """spaces with the present fields of patches (id, name, color_id, description, clear_description)."""
    p = patches.select(F.col("id"), *(F.col(c).alias(f"_{c}") for c in ("name", "color_id", "description", "clear_description")))
    j = spaces.join(p, "id", "left")
    described = F.when(F.coalesce("_clear_description", F.lit(False)), None).otherwise(F.coalesce(F.nullif(trim_white(F.col("_description")), F.lit("")), F.col("description")))
    return j.select("id", F.coalesce(F.nullif(trim_white(F.col("_name")), F.lit("")), "name").alias("name"), F.coalesce("_color_id", "color_id").alias("color_id"), described.alias("description"))


def recover_spaces(notes: DataFrame) -> DataFrame:
    """(id, name, color_id, updated_at) of the spaces that notes name, for a lost space list."""
    seen = notes.select("path", "updated_at", F.explode("space_ids").alias("id"))
    first = seen.groupBy("id").agg(F.min_by("updated_at", "path").alias("updated_at"))
    palette = F.array(*(F.lit(c) for c in COLORS))
    return numbered(first, "id").select("id", F.concat(F.lit("Recovered space "), F.col("n").cast("string")).alias("name"), palette[((F.col("n") - 1) % len(COLORS)).cast("int")].alias("color_id"), "updated_at")


def space_suggestions(queries: DataFrame, spaces: DataFrame, assigned: DataFrame) -> DataFrame:
    """(qid, kind, id, name): spaces not on the note yet whose name holds the query, and a `create` row without an exact
    match. An empty query finds every space. queries is (qid, q, note_id), assigned (note_id, space_id)."""
    asked = queries.withColumn("trimmed", trim_white(F.col("q"))).withColumn("low", F.lower("trimmed"))
    custom = spaces.filter(F.col("id") != GENERAL).select("id", "name")
    named = custom.select(F.col("id").alias("note_id"), F.lower("name").alias("tc"))
    pairs = title_matches(asked.select("qid", F.col("low").alias("qc")), named).select("qid", F.col("note_id").alias("id"))
    every = custom.select("id", F.lit("").alias("low")).join(asked.filter("low = ''").select("qid", "low"), "low").select("qid", "id")
    met = pairs.union(every).join(custom, "id").join(asked.select("qid", "note_id"), "qid")
    free = met.join(assigned.select("note_id", F.col("space_id").alias("id")), ["note_id", "id"], "left_anti")
    exact = custom.select(F.lower("name").alias("low")).distinct()
    create = asked.filter((F.col("low") != "") & (F.col("low") != GENERAL)).join(exact, "low", "left_anti")
    found = free.select("qid", F.lit("space").alias("kind"), "id", "name")
    return found.union(create.select("qid", F.lit("create").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("trimmed").alias("name")))
