"""What a search over a small collection has to give: one case for each behaviour."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, embedding, evaluate, search

NOTES = [
    ("crumble", "Rhubarb crumble", "Rub butter into flour and sugar. Bake the fruit under it until the juice bubbles at the rim.", ["Kitchen"]),
    ("pickles", "Pickling cucumbers", "Salt them overnight. Dill, mustard seed and a hot brine go over them in the jar.", ["Kitchen"]),
    ("train", "Night train to Malmö", "The sleeper leaves at ten and is there before breakfast. Bring ear plugs.", ["Journeys"]),
    ("ferry", "Crossing in June", "From Malmö the small boat runs twice a day. Tickets are sold on board.", ["Journeys"]),
    ("budget", "Quarterly budget", "Travel is over by a tenth, licences are under. The board meets on Thursday.", ["Office"]),
    ("beds", "Budget for the garden", "Timber for two raised beds, compost, and a water butt.", ["Garden"]),
    ("handover", "Übergabe an Jana", "Zugänge, offene Punkte und die Liste der Lieferanten.", ["Office"]),
    ("untitled", "", "Stalks of rhubarb keep for a week if they are wrapped in a damp cloth.", None),
    ("sowing", "What to sow in April", "Beans under glass, peas outside. Divide the old rhubarb crown.", ["Garden"]),
    ("numbers", "Meter readings 2023", "Gas 4711, water 815, power 90210.", None),
    ("empty", "", "", ["Office"]),
]
#: query, note that comes first, notes among the first three, notes in the results, notes below these, notes that don't come, most results
CASES = {
    "the whole title": ("rhubarb crumble", "crumble", ["crumble"], ["crumble", "untitled", "sowing"], None, ["budget"], None),
    "the case doesn't matter": ("QUARTERLY BUDGET", "budget", ["budget", "beds"], None, None, None, None),
    "nor do accents": ("malmo", "train", ["train", "ferry"], ["train", "ferry"], None, ["crumble"], None),
    "nor where the query has them": ("übergabe", "handover", ["handover"], None, None, ["train"], None),
    "the begin of a word": ("pickl", "pickles", ["pickles"], None, None, None, None),
    "one of many": ("cucumber", "pickles", ["pickles"], None, None, None, None),
    "a part of a title": ("train to", "train", ["train"], None, None, None, None),
    "the words of a title in another order": ("garden budget", "beds", ["beds"], None, ["budget"], None, None),
    "words of the text": ("mustard brine", "pickles", ["pickles"], None, None, ["numbers"], None),
    "both words before one": ("rhubarb crown", "sowing", ["sowing"], ["sowing", "untitled", "crumble"], None, None, None),
    "a space": ("kitchen", None, ["crumble", "pickles"], ["crumble", "pickles"], None, ["ferry", "empty"], None),
    "a number": ("90210", "numbers", ["numbers"], None, None, None, None),
    "a note without a title": ("damp cloth", "untitled", ["untitled"], None, None, ["empty"], None),
    "nothing like it": ("zzyzx", None, None, None, None, None, 0),
    "a blank query": (" \t ", None, None, None, None, None, 0),
}


@pytest.fixture(scope="module")
def ranked(spark):
    model = embedding.HashingEmbedder(512, 0.2)
    notes = spark.createDataFrame(NOTES, "id string, title string, body string, space_names array<string>").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    index = embedding.embed_chunks(chunking.plan_chunks(notes), model)
    queries = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES.values())], "qid long, q string")
    asked = embedding.embed_chunks(queries, model, "q").withColumnRenamed("embedding", "vector")
    return search.search_notes(index, notes, asked, min_score=model.min_score).cache()


def test_every_case_is_met(spark, ranked):
    names = list(CASES)
    rankings = ranked.select(F.col("qid").alias("case_id"), F.col("note_id").alias("key"), "rank")
    columns = "case_id long, first string, expected_top array<string>, expected_all array<string>, ranked_below array<string>, excluded array<string>, max_results int"
    cases = spark.createDataFrame([(i, *c[1:]) for i, c in enumerate(CASES.values())], columns)
    failed = [(names[r["case_id"]], r["check"]) for r in evaluate.evaluate(rankings, cases).collect() if not r["passed"]]
    assert not failed, (failed, [(names[r["qid"]], r["rank"], r["note_id"], r["score"]) for r in ranked.orderBy("qid", "rank").collect()])


def test_kinds_tell_why_a_note_is_there(ranked):
    kinds = {(list(CASES)[r["qid"]], r["note_id"]): r["match_kind"] for r in ranked.collect()}
    assert kinds["the whole title", "crumble"] == "title" and kinds["the whole title", "untitled"] == "text"
    assert kinds["a space", "pickles"] == "space" and kinds["nor do accents", "ferry"] == "text"
