"""Fusion of rankings, title and space signals, and the merged ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, tokenize, trim_white


def fuse_rankings(rankings: list[DataFrame], k: int = 60, key: str = "note_id") -> DataFrame:
    """(qid, id, score, rank) from rankings (qid, id, rank), which are the firsts of each query; ties go to the ranking passed first."""
    names = [f"r{i}" for i in range(len(rankings))]
    one = lambda i, df: df.select("qid", key, *(F.col("rank").alias(n) if j == i else F.lit(None).cast("int").alias(n) for j, n in enumerate(names)))
    everything = reduce(DataFrame.unionByName, (one(i, df) for i, df in enumerate(rankings)))
    joined = everything.groupBy("qid", key).agg(*(F.min(n).alias(n) for n in names))
    total = sum((F.coalesce(1 / (k + F.col(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    summed = joined.withColumn("score", F.round(total, 12))
    scored = summed.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    order = [F.desc("score"), *(F.asc_nulls_last(n) for n in names), F.asc(key)]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def title_bonus(q: Column, title: Column) -> Column:
    a, b = collapse(q), collapse(F.coalesce(title, F.lit("")))
    terms = tokenize(q)
    all_in = (F.size(terms) > 0) & (F.size(F.array_except(terms, tokenize(title))) == 0)
    tiers = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.2).when(F.startswith(b, a), 0.8).when(F.contains(b, a), 0.5)
    return tiers.when(all_in, 0.35).otherwise(0.0)


def space_signal(q: Column, names: Column) -> Column:
    """(bonus, whole): how much of a query is names of a note's spaces."""
    terms = F.array_distinct(tokenize(q))
    known = F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), tokenize))
    n = F.size(F.array_intersect(terms, known))
    whole = (n > 0) & (n == F.size(terms))
    return F.struct(F.when(whole, 0.2).when(n > 0, 0.1).otherwise(0.0).alias("bonus"), whole.alias("whole"))


GRAM = 3


def grams(c: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def title_matches(q: DataFrame, t: DataFrame) -> DataFrame:
    """(qid, note_id) where the title tc contains the query qc, which isn't empty: an equi-join on the query's first three
    characters, or on all of a shorter one, and a check of the whole."""
    q = q.filter("qc <> ''")
    sizes = [r["n"] for r in q.select(F.least(F.lit(GRAM), F.length("qc")).alias("n")).distinct().collect()]  # three at most
    found = None
    for n in sizes:
        asked = q.filter(F.length("qc") >= n if n == GRAM else F.length("qc") == n).select("qid", "qc", F.left("qc", F.lit(n)).alias("gram"))
        held = t.select("note_id", "tc", F.explode(grams(F.col("tc"), n)).alias("gram"))
        some = held.join(asked, "gram").filter(F.contains("tc", "qc")).select("qid", "note_id")
        found = some if found is None else found.union(some)
    return t.limit(0).select(F.lit(0).cast("long").alias("qid"), "note_id") if found is None else found


def note_bonuses(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """(qid, note_id, title_bonus, space_bonus, whole) where any is not nothing.

    Texts are folded and split once a note and once a query. Notes and queries meet by equi-joins on what they share, a term of
    the title or of the spaces' names or a part of the title; distinct lists of space names are joined once instead of once a note.
    """
    q = queries.filter(trim_white(F.col("q")) != "").select("qid", collapse(F.col("q")).alias("qc"), F.array_distinct(tokenize(F.col("q"))).alias("qt"))
    t = notes.select(F.col("id").alias("note_id"), collapse(F.coalesce("title", F.lit(""))).alias("tc"), F.array_distinct(tokenize(F.coalesce("title", F.lit("")))).alias("tt"), F.coalesce("space_names", F.array().cast("array<string>")).alias("names"))
    terms = q.select("qid", F.explode("qt").alias("term"))
    n_terms = q.select("qid", F.size("qt").alias("n_terms"), "qc")
    by_term = t.select("note_id", F.explode("tt").alias("term")).join(terms, "term").groupBy("qid", "note_id").agg(F.count(F.lit(1)).alias("in_title"))
    by_part = title_matches(q, t).withColumn("part", F.lit(True))
    titled = by_term.join(by_part, ["qid", "note_id"], "full_outer").join(n_terms, "qid").join(t.select("note_id", "tc"), "note_id")
    tiers = F.when((F.col("qc") == "") | (F.col("tc") == ""), 0.0).when(F.col("qc") == F.col("tc"), 1.2).when(F.startswith("tc", "qc"), 0.8).when(F.col("part"), 0.5)
    titled = titled.select("qid", "note_id", tiers.when(F.col("in_title") == F.col("n_terms"), 0.35).otherwise(0.0).alias("title_bonus")).filter("title_bonus > 0")
    lists = t.select("names").distinct()
    spaced = lists.select("names", F.explode(F.array_distinct(F.flatten(F.transform("names", tokenize)))).alias("term")).join(terms, "term")
    spaced = spaced.groupBy("qid", "names").agg(F.count(F.lit(1)).alias("n")).join(n_terms.drop("qc"), "qid")
    spaced = t.select("note_id", "names").join(spaced, "names").select("qid", "note_id", F.when(F.col("n") == F.col("n_terms"), 0.2).otherwise(0.1).alias("space_bonus"), (F.col("n") == F.col("n_terms")).alias("whole"))
    both = titled.join(spaced, ["qid", "note_id"], "full_outer")
    return both.select("qid", "note_id", F.coalesce("title_bonus", F.lit(0.0)).alias("title_bonus"), F.coalesce("space_bonus", F.lit(0.0)).alias("space_bonus"), F.coalesce("whole", F.lit(False)).alias("whole"))


def rank_notes(bonuses: DataFrame, content: DataFrame, notes: DataFrame, limit: int | None = None) -> DataFrame:
    """(qid, note_id, score, match_kind, rank): content hits (qid, note_id, pos, score, match_kind) and title and space
    matches in one ranking. notes has (id, note_pos); ties keep content order, then note order."""
    first = content.groupBy("qid", "note_id").agg(F.min_by(F.struct("pos", "score", "match_kind"), "pos").alias("c")).select("qid", "note_id", "c.*")
    both = first.join(bonuses, ["qid", "note_id"], "full_outer")
    both = both.filter("pos is not null or title_bonus > 0 or whole")
    extra = F.coalesce("title_bonus", F.lit(0.0)) + F.coalesce("space_bonus", F.lit(0.0))
    kind = F.when(F.col("title_bonus") > 0, "title").when(F.col("space_bonus") > 0, "space").otherwise(F.col("match_kind"))
    placed = both.join(notes.select(F.col("id").alias("note_id"), "note_pos"), "note_id", "left")
    scored = placed.select("qid", "note_id", "pos", "note_pos", F.round(F.coalesce("score", F.lit(0.0)) + extra, 9).alias("score"), kind.alias("match_kind"))
    order = [F.desc("score"), F.asc_nulls_last("pos"), F.asc_nulls_last("note_pos"), F.asc("note_id")]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    ranked = ranked.select("qid", "note_id", "score", "match_kind", "rank")
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def recency_positions(notes: DataFrame) -> DataFrame:
    """notes with note_pos: a sortable key of recency (newest first) instead of a global numbering."""
    return notes.withColumn("note_pos", F.struct((-F.unix_micros("updated_at")).alias("t"), F.col("id").alias("i")))


def recent_notes(notes: DataFrame, k: int = 8) -> DataFrame:
    return notes.orderBy(F.desc("updated_at"), "id").limit(k).select("id", "title", "updated_at", F.lit("recent").alias("match_kind"))
