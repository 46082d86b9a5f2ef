"""Hybrid and full search over a chunk index, many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold_text, tokenize, trim_white
from corpusloom.operators.dense import best_of, search_cells, top_k
from corpusloom.operators.lexical import lexical_search, postings_of_chunks
from corpusloom.operators.ranking import fuse_rankings, note_bonuses, rank_notes, recency_positions
from corpusloom.sources.tables import stored

LEXICAL_CANDIDATES = 32


def pick_snippet(hits: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """hits (qid, note_id, best_idx, is_lexical) with chunk_idx and snippet: for lexical hits the first chunk with a query
    term in it, else the best chunk."""
    terms = queries.select("qid", tokenize(F.col("q")).alias("terms"))
    chunks = index.select("note_id", "idx", "text")
    met = hits.join(chunks, "note_id").join(terms, "qid")
    has = F.exists("terms", lambda t: F.contains(F.col("folded"), t)) & F.col("is_lexical")
    met = met.withColumn("folded", fold_text(F.col("text"))).withColumn("order", F.when(has, 0).when(F.col("idx") == F.col("best_idx"), 1))
    chosen = met.filter("order is not null").groupBy("qid", "note_id").agg(F.min_by(F.struct("idx", "text"), F.struct("order", "idx")).alias("s"))
    return hits.join(chosen, ["qid", "note_id"]).select(*hits.columns, F.col("s.idx").alias("chunk_idx"), F.col("s.text").alias("snippet"))


def hybrid_search(
    index: DataFrame, queries: DataFrame, *, store: Callable[[DataFrame], DataFrame] = stored, top_k_notes: int = 10, min_score: float = 0.0, cutoff: float = 0.0, postings: DataFrame | None = None, vocab: DataFrame | None = None, n_docs: DataFrame | None = None
) -> DataFrame:
    """(qid, note_id, rank, score, match_kind, best_idx, is_lexical) for queries (qid, q, vector); blank queries have no rows.

    Of the dense ranking only the firsts and the lexical hits can be among the first `top_k_notes`. The lexical hits are
    scored first, by their ids; they go along with the queries, and the one pass over the index sends the firsts of each
    cell and, for each hit, how many notes of the cell rank before it. No pair of a query and a note is stored else.
    """
    asked = queries.filter(trim_white(F.col("q")) != "")
    postings = postings_of_chunks(index) if postings is None else postings
    n_docs = index.agg(F.count_distinct("note_id").alias("n")) if n_docs is None else n_docs
    lexical = store(lexical_search(postings, asked, n_docs, LEXICAL_CANDIDATES, vocab=vocab).select("qid", "note_id", "rank"))
    own = store(best_of(lexical, index, asked))  # LEXICAL_CANDIDATES rows a query at most
    probes = own.filter(F.col("score") >= min_score).groupBy("qid").agg(F.collect_list(F.struct("note_id", "score")).alias("probes"))
    found = store(search_cells(index, asked.select("qid", "vector").join(probes, "qid", "left"), min_score, top_k_notes + LEXICAL_CANDIDATES))
    firsts = top_k(found.filter("n_before is null").drop("n_before"), top_k_notes + LEXICAL_CANDIDATES)
    ranks = found.filter("n_before is not null").groupBy("qid", "note_id").agg((F.sum("n_before") + 1).cast("int").alias("rank"))
    other = own.join(ranks, ["qid", "note_id"]).join(firsts.select("qid", "note_id"), ["qid", "note_id"], "left_anti")
    dense = store(firsts.unionByName(other.select(*firsts.columns)))
    tops = dense.filter("rank = 1").select("qid", F.col("score").alias("top"))
    fused = fuse_rankings([lexical, dense.select("qid", "note_id", "rank")])
    met = fused.withColumnRenamed("score", "fused").withColumnRenamed("rank", "place").join(dense.select("qid", "note_id", "idx", F.col("score").alias("dense")), ["qid", "note_id"], "left").join(tops, "qid", "left")
    near = F.lit(True) if cutoff <= 0 else (F.col("top") <= min_score) | (F.col("dense") >= min_score + cutoff * (F.col("top") - min_score))
    shown = met.filter(F.col("r0").isNotNull() | F.coalesce(near, F.lit(False)))
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).filter(F.col("rank") <= top_k_notes)
    is_lexical = F.col("r0").isNotNull()
    # a lexical hit below the floor has no dense row, but a best chunk all the same
    out = ranked.join(own.select("qid", "note_id", F.col("idx").alias("own")), ["qid", "note_id"], "left")
    return out.select("qid", "note_id", "rank", F.round("fused", 9).alias("score"), F.when(is_lexical, "text").otherwise("semantic").alias("match_kind"), F.coalesce("idx", "own").alias("best_idx"), is_lexical.alias("is_lexical"))


def search_notes(index: DataFrame, notes: DataFrame, queries: DataFrame, *, store: Callable[[DataFrame], DataFrame] = stored, top_k_notes: int = 8, cutoff: float = 0.6, min_score: float = 0.0, limit: int | None = None, **stored: DataFrame) -> DataFrame:
    """The full search: hybrid hits and title and space matches of notes (id, title, updated_at, space_names) in one ranking."""
    hits = hybrid_search(index, queries, store=store, top_k_notes=top_k_notes, min_score=min_score, cutoff=cutoff, **stored)
    content = hits.select("qid", "note_id", F.col("rank").alias("pos"), "score", "match_kind")
    return rank_notes(note_bonuses(queries, notes), content, recency_positions(notes), limit)
