"""Lexical search that reads the blocks of postings that can matter, with the rows of lexical.lexical_search().

The postings of a term with one frequency are a class, all of one contribution to a score; large classes are dealt by note into
blocks of about `BLOCK` postings. A search first reads the strongest blocks of each term: what they give is a lower bound of the
score of the last place. A query's weakest terms whose best contributions together stay below it can put no note among the
first alone; of the others only classes are read that can reach the bound together with the best of all other terms. The
weak terms are then looked up for the notes found, each in the one block of a class that could hold it. A class with far fewer
blocks than there are notes to look up is read once instead of being asked note by note: so the work never exceeds a
few rows a block and a row a posting of the query's terms, whatever the number of notes and of terms that a query's begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lexical import SATURATION, begun, expand_terms, idf, query_terms
from corpusloom.sources.tables import stored

BLOCK = 128
#: Scores are rounded to 9 places; what is nearer to a bound counts as reaching it.
CLOSE = 1e-8
#: With so many notes to look up for each block of a class, no block is left out but one in e^16.
FULL = 16


def posting_blocks(postings: DataFrame, block: int = BLOCK, store: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(blocks, classes): blocks (term, tf, sub, size, held) with held an array of (note_id, in_title); classes (term, tf, n, subs).

    Postings are sent once and by block, so that no task gets a whole class of a frequent term.
    """
    classes = store(postings.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n")).withColumn("subs", F.ceil(F.col("n") / block).cast("int")))
    large = store(classes.filter("subs > 1").select("term", "tf", "subs"))  # a row for `block` postings at most
    rows = postings.join(large, ["term", "tf"], "left").withColumn("sub", block_of("note_id", F.coalesce("subs", F.lit(1)))).repartition("term", "tf", "sub")
    blocks = rows.groupBy("term", "tf", "sub").agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.struct("note_id", "in_title")).alias("held"))
    return store(blocks), classes


def block_of(note_id, subs):
    return F.pmod(F.xxhash64(note_id), subs).cast("int")


def bounded_search(blocks: DataFrame, classes: DataFrame, queries: DataFrame, n_docs: DataFrame, limit: int, vocab: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """(found, read): (qid, note_id, score, in_title, rank) of the first `limit` notes of each query, best first and equal scores by
    note id, and (qid, postings, postings_read) of its terms."""
    terms = store(query_terms(queries))
    asked = terms.select("qterm").distinct()
    expanded = store(expand_terms(asked, vocab))
    tf = F.col("tf")
    blocks, classes = (df.join(asked, begun(), "left_semi") for df in (blocks, classes))  # those of other terms aren't sent
    blocks = store(blocks)
    pieces = store(expanded.join(classes, "term").withColumn("part", F.col("idf") * F.col("weight") * tf / (tf + SATURATION)))
    mass = store(terms.join(expanded.groupBy("qterm").agg(F.max("idf").alias("mass")), "qterm"))
    weighed = terms.join(mass, ["qid", "qterm"], "left").join(F.broadcast(n_docs))  # one row
    whole = store(weighed.groupBy("qid").agg(F.sum(F.coalesce("mass", idf(F.col("n"), F.lit(1)))).alias("whole")))

    def opened(wanted: DataFrame) -> DataFrame:
        """The postings of wanted classes (term, tf, first_subs and any other columns), of each its first blocks."""
        met = wanted.join(blocks.drop("size"), ["term", "tf"]).filter("sub < first_subs")
        return met.select(*(c for c in wanted.columns if c not in ("term", "tf", "first_subs")), F.explode("held").alias("x")).select("*", "x.note_id", "x.in_title").drop("x")

    def scored(hits: DataFrame) -> DataFrame:
        by_term = hits.groupBy("qid", "qterm", "note_id").agg(F.sum("part").alias("part"), F.max("in_title").alias("in_title"))
        by_note = by_term.join(mass, ["qid", "qterm"]).groupBy("qid", "note_id").agg(F.sum("part").alias("sum"), F.sum("mass").alias("got"), F.max("in_title").alias("in_title"))
        return by_note.join(whole, "qid").withColumn("score", F.round(F.col("sum") * F.col("got") / F.col("whole"), 9))

    # the strongest blocks of each term: `limit` postings or a few more
    strong = Window.partitionBy("qterm", "term").orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.withColumn("ahead", F.coalesce(F.sum("n").over(strong), F.lit(0))).filter(F.col("ahead") < limit)
    need = F.least(F.col("subs"), F.ceil((limit - F.col("ahead")) * F.col("subs") / F.col("n"))).cast("int")
    seeds = store(ahead.withColumn("first_subs", need).select("qterm", "term", "tf", "part", "first_subs"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "note_id"))
    seeded = opened(seeds).groupBy("qterm", "note_id").agg(F.sum("part").alias("part"), F.max("in_title").alias("in_title"))  # once for all queries of a term
    bound = scored(seeded.join(terms, "qterm")).withColumn("place", place).filter(F.col("place") == limit).select("qid", F.col("score").alias("bound"))

    # terms that can't put a note among the first by themselves: the weakest, as long as their best sums stay below the bound
    best = pieces.groupBy("qterm", "term").agg(F.max("part").alias("best"))
    tops = mass.join(best.groupBy("qterm").agg(F.sum("best").alias("top")), "qterm").join(whole, "qid").join(bound, "qid", "left")
    upto = Window.partitionBy("qid").orderBy("top", "qterm").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = tops.withColumn("reach", F.sum("top").over(upto) * F.sum("mass").over(upto) / F.col("whole")).withColumn("all_tops", F.sum("top").over(Window.partitionBy("qid")))
    tops = store(tops.withColumn("weak", F.coalesce(F.col("reach") + CLOSE < F.col("bound"), F.lit(False))).select("qid", "qterm", "top", "weak", "bound", "all_tops"))
    known = pieces.withColumn("best", F.max("part").over(Window.partitionBy("qterm", "term"))).join(tops, "qterm")
    needed = ~F.coalesce(F.col("all_tops") - F.col("best") + F.col("part") + CLOSE < F.col("bound"), F.lit(False))
    leading = store(known.filter(~F.col("weak") & needed).select("qid", "qterm", "term", "tf", "part", F.col("subs").alias("first_subs")))
    hits = store(opened(leading))

    # notes that can still reach the bound are looked up in the weak terms
    rest = tops.groupBy("qid").agg(F.sum(F.when(F.col("weak"), F.col("top")).otherwise(0.0)).alias("rest"), F.max("bound").alias("bound"))
    notes = hits.groupBy("qid", "note_id").agg(F.sum("part").alias("sum")).join(rest, "qid").filter(F.col("bound").isNull() | (F.col("sum") + F.col("rest") + CLOSE >= F.col("bound")))
    notes = store(notes.select("qid", "note_id"))
    weak = known.filter("weak").select("qid", "qterm", "term", "tf", "part", "subs").join(notes.groupBy("qid").agg(F.count(F.lit(1)).alias("due")), "qid")
    read_whole = (F.col("subs") == 1) | (F.col("due") >= FULL * F.col("subs"))
    entire = store(weak.filter(read_whole).select("qid", "qterm", "term", "tf", "part", F.col("subs").alias("first_subs")))
    single = store(notes.join(weak.filter(~read_whole).drop("due"), "qid").withColumn("sub", block_of("note_id", F.col("subs"))).drop("subs"))
    looked = single.join(blocks.drop("size"), ["term", "tf", "sub"]).withColumn("x", F.filter("held", lambda x: x["note_id"] == F.col("note_id"))).filter(F.size("x") > 0)
    looked = looked.select("qid", "qterm", "part", "note_id", F.col("x")[0]["in_title"].alias("in_title"))
    kept = hits.unionByName(opened(entire)).join(notes, ["qid", "note_id"], "left_semi").select(*looked.columns)
    found = scored(kept.union(looked)).withColumn("rank", place).filter(F.col("rank") <= limit).select("qid", "note_id", "score", "in_title", "rank")

    sizes, block = blocks.select("term", "tf", "sub", "size"), ["qid", "term", "tf", "sub", "size"]
    first = seeds.join(terms, "qterm").select(*leading.columns).union(leading).union(entire.select(*leading.columns)).groupBy("qid", "term", "tf").agg(F.max("first_subs").alias("first_subs"))
    used = first.join(sizes, ["term", "tf"]).filter("sub < first_subs").select(*block)
    used = used.union(single.select("qid", "term", "tf", "sub").distinct().join(sizes, ["term", "tf", "sub"]).select(*block)).distinct()
    there = terms.join(pieces.select("qterm", "term", "tf", "n"), "qterm").select("qid", "term", "tf", "n").distinct().groupBy("qid").agg(F.sum("n").alias("postings"))
    read = there.join(used.groupBy("qid").agg(F.sum("size").alias("postings_read")), "qid", "left").select("qid", "postings", F.coalesce("postings_read", F.lit(0)).alias("postings_read"))
    return found, read
