"""Inverted index and BM25-shaped scoring for many queries at once."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold_inflection, folded_words, spaced, stem, tokenize, words
from corpusloom.sources.tables import stored

TITLE_WEIGHT, SATURATION, PREFIX_WEIGHT, PREFIX_LENGTH = 3, 1.2, 0.5, 3


def build_postings(docs: DataFrame) -> DataFrame:
    """(term, note_id, tf, in_title) from (id, title, body)."""
    field = lambda column, weight, title: docs.select(F.explode(words(F.col(column))).alias("word"), F.col("id").alias("note_id"), F.lit(weight).alias("w"), F.lit(title).alias("t"))
    tokens = field("title", TITLE_WEIGHT, True).union(field("body", 1, False))
    return tokens.groupBy(fold_inflection(F.col("word")).alias("term"), "note_id").agg(F.sum("w").alias("tf"), F.max("t").alias("in_title"))


class Stems(dict):
    """Words and their terms; each word is stemmed once."""

    def __missing__(self, word: str) -> str:
        self[word] = term = stem(word)
        return term


#: Words whose terms a worker keeps from batch to batch.
MOST_STEMS = 200_000
NOTE_POSTINGS = "terms string, tf string, titled int"
_stems = Stems()


def note_postings(docs: DataFrame) -> DataFrame:
    """(note_id, terms, tf, titled): the postings of build_postings() as a row a note, for docs (id, title, body) of a row a note.

    Terms and their tf are joined by blanks; the first `titled` of them are the title's. A note's words are counted where its text lies: no row
    a posting is made and nothing is sent. Folding stays with the column functions, which also settle what is a letter or a number
    beyond ASCII. A note without words has no row.
    """
    rows = docs.select(F.col("id").alias("note_id"), spaced(F.col("title")).alias("title"), spaced(F.col("body")).alias("body"))

    def run(batches):
        for batch in batches:
            yield counted(batch)

    return rows.mapInArrow(run, f"note_id {rows.schema['note_id'].dataType.simpleString()}, {NOTE_POSTINGS}").filter("terms <> ''")


def counted(batch):
    """note_postings() of a record batch of (note_id, title, body), texts as spaced() gives them."""
    import pyarrow as pa

    terms, tf, titled = [], [], []
    for title, body in zip(batch.column("title").to_pylist(), batch.column("body").to_pylist(), strict=True):
        if len(_stems) > MOST_STEMS:
            _stems.clear()
        n = Counter(map(_stems.__getitem__, folded_words(title)))
        for term in n:
            n[term] *= TITLE_WEIGHT
        titled.append(len(n))
        n.update(map(_stems.__getitem__, folded_words(body)))
        terms.append(" ".join(n))
        tf.append(" ".join(map(str, n.values())))
    return pa.RecordBatch.from_arrays([batch.column("note_id"), pa.array(terms, pa.string()), pa.array(tf, pa.string()), pa.array(titled, pa.int32())], ["note_id", "terms", "tf", "titled"])


def posting_rows(notes: DataFrame) -> DataFrame:
    """note_postings() as rows (note_id, term, tf, in_title)."""
    pairs = F.arrays_zip(F.split("terms", " ").alias("term"), F.split("tf", " ").cast("array<bigint>").alias("tf"))
    return notes.select("note_id", "titled", F.posexplode(pairs).alias("at", "x")).select("note_id", "x.term", "x.tf", (F.col("at") < F.col("titled")).alias("in_title"))


def postings_of_chunks(chunk_index: DataFrame) -> DataFrame:
    """The same from stored chunks (note_id, kind, text); words in the overlap of two windows count twice."""
    title = F.col("kind") == "title"
    tokens = chunk_index.select("note_id", title.alias("t"), F.explode(words(F.col("text"))).alias("word"))
    weight = F.when(F.col("t"), TITLE_WEIGHT).otherwise(1)
    return tokens.groupBy(fold_inflection(F.col("word")).alias("term"), "note_id").agg(F.sum(weight).alias("tf"), F.max("t").alias("in_title"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def vocabulary(postings: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf); n_docs is a table of the one number n, which counts documents without terms too."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n_docs)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, qterm): the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("q")))).alias("qterm"))


def expand_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """terms (qterm and any other columns) with (term, idf, weight): a term itself, and the longer terms it begins where it has three characters."""
    exact = terms.join(vocab, F.col("qterm") == F.col("term")).select(*terms.columns, "term", "idf", F.lit(1.0).alias("weight"))
    longer = terms.filter(F.length("qterm") >= PREFIX_LENGTH).join(vocab, begun() & (F.col("term") != F.col("qterm"))).select(*terms.columns, "term", "idf", F.lit(PREFIX_WEIGHT).alias("weight"))
    return exact.union(longer)


def begun() -> Column:
    """Whether qterm begins term; of less than three characters it must be all of it."""
    head = lambda c: F.left(F.col(c), F.lit(PREFIX_LENGTH))
    return (head("qterm") == head("term")) & F.startswith(F.col("term"), F.col("qterm"))


def lexical_search(postings: DataFrame, queries: DataFrame, n_docs: DataFrame, limit: int | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """(qid, note_id, score, in_title, rank), best first; equal scores by note id. vocab is vocabulary(postings, n_docs), kept with them.

    A term that many queries have is expanded and met with its postings once; its parts of scores then go to all of these queries. The
    terms that begin with one of the queries' grow with the vocabulary, so postings are first cut to those that any query's term begins
    by the queries' terms alone. What is left is sent once, by note: parts and sums of a note are made in one task.
    """
    terms = stored(query_terms(queries))
    asked = terms.select("qterm").distinct()
    expanded = stored(expand_terms(asked, vocabulary(postings, n_docs) if vocab is None else vocab))
    mass = expanded.groupBy("qterm").agg(F.max("idf").alias("mass"))
    due = stored(terms.join(mass, "qterm", "left").join(F.broadcast(n_docs)).select("qid", "qterm", "mass", F.coalesce("mass", idf(F.col("n"), F.lit(1))).alias("due")))
    whole = due.groupBy("qid").agg(F.sum("due").alias("whole"))
    tf = F.col("tf")
    met = postings.join(asked, begun(), "left_semi").join(expanded, "term")
    hits = met.select("qterm", "note_id", (F.col("idf") * F.col("weight") * tf / (tf + SATURATION)).alias("part"), "in_title").repartition("note_id")
    parts = hits.groupBy("qterm", "note_id").agg(F.sum("part").alias("part"), F.max("in_title").alias("in_title"))
    found = parts.join(due.select("qid", "qterm", "mass"), "qterm").groupBy("qid", "note_id").agg(F.sum("part").alias("sum"), F.sum("mass").alias("got"), F.max("in_title").alias("in_title"))
    scored = found.join(whole, "qid").select("qid", "note_id", F.round(F.col("sum") * F.col("got") / F.col("whole"), 9).alias("score"), "in_title")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "note_id")))
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def apply_postings_delta(postings: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """postings after documents (id, title, body) changed and ids were deleted; unknown ids do nothing."""
    gone = changed.select(F.col("id").alias("note_id")).union(deleted.select(F.col("id").alias("note_id"))).distinct()
    return postings.join(gone, "note_id", "left_anti").unionByName(build_postings(changed))


def rebuild_pays(n_changed: int, n_docs: int) -> bool:
    """Beyond a quarter of the documents a new index is cheaper than a delta."""
    return n_changed > n_docs / 4


def maintain(postings: DataFrame, df: DataFrame, n_docs: int, docs: DataFrame, changed: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(postings, df, n_docs) after documents (id, title, body) changed and ids were deleted; df is (term, df).

    Up to a quarter of the documents the change is applied: their postings are replaced, df and the number of documents follow by what went
    and what came. Beyond it everything is built again from docs, all documents as they now are.
    The ids are stored: as their size is known, the postings held aren't sent to meet a few of them.
    """
    ids = stored(changed.select(F.col("id").alias("note_id")).union(deleted.select(F.col("id").alias("note_id"))).distinct())
    if rebuild_pays(ids.count(), n_docs):
        postings = build_postings(docs)
        return postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), docs.count()
    made = stored(build_postings(changed))
    after = postings.join(ids, "note_id", "left_anti").unionByName(made)
    lost = postings.join(ids, "note_id", "left_semi").select("term", F.lit(-1).alias("d"))
    won = made.select("term", F.lit(1).alias("d"))
    counts = df.select("term", F.col("df").alias("d")).union(lost).union(won).groupBy("term").agg(F.sum("d").alias("df")).filter("df > 0")
    return after, counts, docs.count()
