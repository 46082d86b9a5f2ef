"""Search by blocks against the search over all postings."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import bounded, lexical
from corpusloom.sources.tables import stored


def both(spark, docs, queries, limit, block):
    df = spark.createDataFrame(docs, "id string, title string, body string")
    postings = stored(lexical.build_postings(df))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    vocab = stored(lexical.vocabulary(postings, n))
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, q string")
    rows = lambda d: sorted((r["qid"], r["rank"], r["note_id"], r["score"], r["in_title"]) for r in d.collect())
    blocks, classes = (stored(x) for x in bounded.posting_blocks(postings, block))
    found, read = bounded.bounded_search(blocks, classes, q, n, limit, vocab)
    return rows(lexical.lexical_search(postings, q, n, limit, vocab=vocab)), rows(found), {r["qid"]: (r["postings"], r["postings_read"]) for r in read.collect()}


def test_rows_equal_the_search_over_all_postings(spark):
    draw = random.Random(7)
    words = ["the", "river", "riverbank", "stone", "stones", "cloud", "clouded", "green", "zinc"]
    weight = [40, 9, 5, 7, 3, 2, 2, 1, 0.4]
    docs = [(f"n{i:03d}", " ".join(draw.choices(words, weight, k=draw.randint(0, 2))), " ".join(draw.choices(words, weight, k=draw.randint(0, 25)))) for i in range(250)]
    queries = ["the", "river", "the zinc", "riv clou stone", "the river stone cloud green", "zzz", "  ", "zzz the", "the the"]
    for limit, block in ((3, 4), (5, 16), (400, 8)):
        want, got, read = both(spark, docs, queries, limit, block)
        assert got == want
        assert all(0 <= r <= n for n, r in read.values())


def test_less_is_read_of_frequent_terms(spark):
    docs = [(f"n{i:04d}", "rare" if i % 100 == 7 else "", "the " * (1 + i % 5 + (9 if i % 97 == 0 else 0)) + f"w{i}") for i in range(1600)]
    want, got, read = both(spark, docs, ["the", "the rare", "rare"], 5, 8)
    assert got == want
    share = {q: r / n for q, (n, r) in read.items()}
    assert share[0] < 0.1 and share[1] < 0.5 and share[2] == 1


def test_no_row_is_made_for_each_note_and_class(spark):
    """Notes to look up in a weak term of many classes: what is stored stays below the postings there are."""
    docs = [(f"n{i:03d}", "", "the " * (1 + i % 40) + ("zinc " if i % 2 else "") + f"w{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "id string, title string, body string")
    postings, n, sizes = stored(lexical.build_postings(df)), df.agg(F.count(F.lit(1)).alias("n")), []

    def counted(d):
        sizes.append((d := stored(d)).count())
        return d

    vocab = stored(lexical.vocabulary(postings, n))
    q = spark.createDataFrame([(1, "the zinc")], "qid long, q string")
    found, read = bounded.bounded_search(*bounded.posting_blocks(postings), q, n, 5, vocab, counted)
    rows = lambda d: sorted((r["rank"], r["note_id"], r["score"]) for r in d.collect())
    assert rows(found) == rows(lexical.lexical_search(postings, q, n, 5, vocab=vocab)) and read.first()["postings"] == 600
    assert max(sizes) <= 600


def test_stored_tables_are_written_small(spark):
    df = stored(spark.range(3))
    assert all(f.endswith(".zstd.parquet") for f in df.inputFiles()) and df.count() == 3
