"""Lexical, dense and merged rankings on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, dense, embedding, evaluate, lexical, ranking, search
from corpusloom.sources.tables import stored

NOTES = [
    ("n1", "Tiradito de pescado", "Corta el pescado en láminas y añade limón.", ["Recetas"]),
    ("n2", "Viaje a Lima", "Comimos pescados frescos cerca del mar.", ["Viajes"]),
    ("n3", "Carbonara", "Huevos, queso y pimienta para la pasta.", ["Recetas"]),
    ("n4", "Reunión de marzo", "Presupuesto y calendario del proyecto.", ["Trabajo"]),
    ("n5", "", "", None),
]


@pytest.fixture(scope="module")
def notes(spark):
    df = spark.createDataFrame(NOTES, "id string, title string, body string, space_names array<string>")
    return df.withColumn("updated_at", F.timestamp_seconds(F.substring("id", 2, 1).cast("int") * 100)).cache()


def postings(notes):
    return lexical.build_postings(notes)


def found(notes, spark, *queries):
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, q string")
    n = notes.agg(F.count(F.lit(1)).alias("n"))
    out = {i: [] for i in range(len(queries))}
    for r in sorted(lexical.lexical_search(postings(notes), q, n).collect(), key=lambda r: (r["qid"], r["rank"])):
        out[r["qid"]].append(r["note_id"])
    return list(out.values())


def test_lexical_search(notes, spark):
    title, accents, prefix, short, nothing, blank = found(notes, spark, "pescado", "REUNIÓN", "pesc", "pe", "xyz", "  ")
    assert title == ["n1", "n2"] and accents == ["n4"] and prefix == ["n1", "n2"] and short == [] and nothing == [] and blank == []


def test_coverage_prefers_the_note_with_both_terms(notes, spark):
    assert found(notes, spark, "pescado limon")[0][0] == "n1"


def test_delta_equals_rebuild(notes, spark):
    changed = spark.createDataFrame([("n2", "Otro", "texto nuevo"), ("n9", "Nueva", "nota")], "id string, title string, body string")
    deleted = spark.createDataFrame([("n3",), ("none",)], "id string")
    delta = lexical.apply_postings_delta(postings(notes), changed, deleted)
    whole = notes.filter("id not in ('n2', 'n3')").select("id", "title", "body").union(changed)
    rebuilt = lexical.build_postings(whole)
    columns = ["term", "note_id", "tf", "in_title"]
    assert delta.select(columns).exceptAll(rebuilt.select(columns)).isEmpty() and rebuilt.select(columns).exceptAll(delta.select(columns)).isEmpty()
    assert lexical.rebuild_pays(3, 10) and not lexical.rebuild_pays(2, 10)


def test_fusion_ties_go_to_the_first_ranking(spark):
    make = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "qid long, note_id string, rank int")
    rows = ranking.fuse_rankings([make(["a", "b", "c"]), make(["b", "a"])]).orderBy("rank").collect()
    assert [r["note_id"] for r in rows] == ["a", "b", "c"] and rows[0]["score"] == 1.0


def test_relative_cutoff(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.75), (2, "d", 0.7)], "qid long, note_id string, score double")
    keep = lambda *a: sorted(r["note_id"] for r in dense.relative_cutoff(df, *a).collect())
    assert keep(0.6, 0.7) == ["a", "d"] and keep(0, 0.7) == ["a", "b", "c", "d"] and keep(0.5, 0.7) == ["a", "b", "d"]


@pytest.mark.parametrize(("q", "title", "bonus"), [("carbonara", "Carbonara", 1.2), ("carbo", "Carbonara", 0.8), ("bonar", "Carbonara", 0.5), ("pescado tiradito", "Tiradito de pescado", 0.35), ("pasta", "Carbonara", 0.0), ("", "x", 0.0), ("x", "", 0.0)])
def test_title_bonus(spark, q, title, bonus):
    row = spark.createDataFrame([(q, title)], "q string, t string").select(ranking.title_bonus(F.col("q"), F.col("t")).alias("b")).first()
    assert row["b"] == bonus


@pytest.mark.parametrize(("q", "names", "want"), [("recetas", ["Recetas"], (0.2, True)), ("receta vegana", ["Recetas"], (0.1, False)), ("mar", ["Recetas"], (0.0, False)), ("", ["Recetas"], (0.0, False)), ("x", None, (0.0, False))])
def test_space_signal(spark, q, names, want):
    row = spark.createDataFrame([(q, names)], "q string, n array<string>").select(ranking.space_signal(F.col("q"), F.col("n")).alias("s")).first()["s"]
    assert (row["bonus"], row["whole"]) == want


def test_full_search_meets_expectations(notes, spark):
    model = embedding.HashingEmbedder(256, 0.2)
    index = embedding.embed_chunks(chunking.plan_chunks(notes), model)
    queries = spark.createDataFrame(list(enumerate(["pescado", "carbonara", "recetas", "   ", "zzz"])), "qid long, q string")
    asked = embedding.embed_chunks(queries, model, "q").withColumnRenamed("embedding", "vector")
    ranked = search.search_notes(index, notes, asked, min_score=model.min_score)
    rankings = ranked.select(F.col("qid").alias("case_id"), F.col("note_id").alias("key"), "rank")
    cases = spark.createDataFrame(
        [(0, "n1", ["n1", "n2"], ["n1", "n2"], None, ["n4"], 3), (1, "n3", None, ["n3"], None, ["n2"], None), (2, None, None, ["n1", "n3"], None, ["n4"], None), (3, None, None, None, None, ["n1"], 0), (4, None, None, None, None, None, 0)],
        "case_id long, first string, expected_top array<string>, expected_all array<string>, ranked_below array<string>, excluded array<string>, max_results int",
    )
    verdicts = evaluate.evaluate(rankings, cases).collect()
    assert len(verdicts) == 13 and all(r["passed"] for r in verdicts), [r for r in verdicts if not r["passed"]]
    kinds = {(r["qid"], r["note_id"]): r["match_kind"] for r in ranked.collect()}
    assert kinds[(1, "n3")] == "title" and kinds[(2, "n3")] == "space" and kinds[(0, "n2")] == "text"
    assert ranking.recent_notes(notes, 2).collect()[0]["id"] == "n5"


def plain_best(rows, vectors):
    """{(qid, note_id): (idx, score)} by loops."""
    out = {}
    for q, v in vectors:
        for n, i, e in rows:
            score = round(sum(a * b for a, b in zip(v, e)), 9)
            if (q, n) not in out or (-score, i) < (-out[q, n][1], out[q, n][0]):
                out[q, n] = i, score
    return out


def test_best_chunks_and_ranks_equal_loops(spark):
    draw = random.Random(5)
    rows = [(n, i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for n in range(60) for i in range(4)]
    index = spark.createDataFrame(rows, "note_id long, idx int, embedding array<double>").repartition(5)
    vectors = [(q, [draw.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for q in range(7)]
    queries = spark.createDataFrame(vectors, "qid long, vector array<double>")
    want = plain_best(rows, vectors)
    def rows_of(df):
        return {(r["qid"], r["note_id"]): (r["idx"], r["score"]) for r in df.collect()}

    for sizes in ({"cell_chunks": 30, "group_queries": 2}, {}):  # the numbers of cells and groups change nothing
        assert rows_of(dense.best_chunk(index, queries, **sizes)) == want
        assert rows_of(dense.best_chunk(index, queries, 0.5, **sizes)) == {k: v for k, v in want.items() if v[1] >= 0.5}
        firsts = dense.top_k(dense.best_chunk(index, queries, None, 4, **sizes), 4).collect()
        pairs = spark.createDataFrame([(q, n) for q, _ in vectors for n in range(1, 60, 7)], "qid long, note_id long")
        own = dense.best_of(pairs, index, queries)
        assert rows_of(own) == {(q, n): v for (q, n), v in want.items() if n % 7 == 1}
        probes = own.groupBy("qid").agg(F.collect_list(F.struct("note_id", "score")).alias("probes"))
        for floor in (None, 0.5):
            counted = dense.search_cells(index, queries.join(probes, "qid", "left"), floor, 4, **sizes).filter("n_before is not null").groupBy("qid", "note_id").agg(F.sum("n_before").alias("n"))
            before = {(r["qid"], r["note_id"]): r["n"] for r in counted.collect()}
            for q, _ in vectors:
                order = sorted((-s, n) for (k, n), (_, s) in want.items() if k == q)
                assert [(-r["score"], r["note_id"]) for r in sorted(firsts, key=lambda r: r["rank"]) if r["qid"] == q] == order[:4]
                shown = [x for x in order if floor is None or -x[0] >= floor]
                assert all(before[q, n] == sum(x < (-want[q, n][1], n) for x in shown) for n in range(1, 60, 7))
    assert dense.best_chunk(index, queries.limit(0)).count() == 0 and dense.best_chunk(index.limit(0), queries).count() == 0


def test_vectors_that_are_null_or_of_unlike_length(spark):
    rows = [("a", -1, [1.0, 0.0, 2.0]), ("a", 0, None), ("b", 0, [1.0]), ("c", 0, []), ("d", 0, [None, 3.0, 0.0, 9.0]), ("e", 0, None), ("f", 0, [float("nan"), 1.0])]
    index = spark.createDataFrame(rows, "note_id string, idx int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, [2.0]), (3, None)], "qid long, vector array<double>")
    want = {(1, "a"): 3.0, (1, "b"): 1.0, (1, "c"): 0.0, (1, "d"): 3.0, (1, "f"): 1.0, (2, "a"): 2.0, (2, "b"): 2.0, (2, "c"): 0.0, (2, "d"): 0.0, (2, "f"): 0.0}
    for k in (None, 9):
        for cell_chunks in (1, 100):
            got = dense.best_chunk(index, queries, k=k, cell_chunks=cell_chunks, group_queries=1).collect()
            assert {(r["qid"], r["note_id"]): r["score"] for r in got} == want
    firsts = dense.top_k(dense.best_chunk(index, queries, None, 2), 2).collect()
    assert sorted((r["qid"], r["rank"], r["note_id"]) for r in firsts) == [(1, 1, "a"), (1, 2, "d"), (2, 1, "a"), (2, 2, "b")]


def test_title_matches_by_parts(spark):
    q = spark.createDataFrame([(1, "ion der"), (2, "a"), (3, "ab"), (4, ""), (5, "xyz"), (6, "tion derby")], "qid long, qc string")
    t = spark.createDataFrame([("n1", "station derby"), ("n2", "ab"), ("n3", "")], "note_id string, tc string")
    assert sorted(map(tuple, ranking.title_matches(q, t).collect())) == [(1, "n1"), (2, "n1"), (2, "n2"), (3, "n2"), (6, "n1")]
    assert ranking.title_matches(q.limit(0), t).count() == 0


def test_spread_deals_a_table_of_several_splits_to_parts(spark, tmp_path):
    """A table that has as many splits as there are cores is dealt to smaller parts all the same, so that tasks don't grow with it."""
    from corpusloom.plans import views

    spark.range(4000).repartition(4).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    splits = table.rdd.getNumPartitions()
    dealt = views.spread(table)
    assert dealt.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, views.PARTS * splits if splits > 1 else 1)
    assert sorted(r[0] for r in dealt.collect()) == list(range(4000))
    most = max(len(p) for p in dealt.rdd.glom().collect())
    assert most <= 4000 // splits // 2


def test_a_cell_of_all_pairs_leaves_a_million_rows_at_most():
    from corpusloom.operators import dense

    assert dense.CELL_CHUNKS[False] * dense.GROUP_QUERIES[False] <= 1 << 20


def test_postings_are_not_sent_to_the_terms_of_few_queries(spark):
    """The terms of the queries are a stored table of known size, so that the join with all postings needs no exchange of them."""
    docs = spark.createDataFrame([(f"n{i}", "alpha beta", f"gamma word{i}") for i in range(20)], "id string, title string, body string")
    postings = stored(lexical.build_postings(docs))
    n = spark.createDataFrame([(20,)], "n long")
    found = lexical.lexical_search(postings, spark.createDataFrame([(1, "word1 gamma")], "qid long, q string"), n)
    assert found.filter("rank = 1").first()["note_id"] == "n1"
    plan = found._jdf.queryExecution().sparkPlan().toString()
    at = plan.index("note_id")
    joins = [line for line in plan[: plan.rindex("note_id")].splitlines() if "Join" in line and "[term#" in line]
    assert at and joins and all("BroadcastHashJoin" in line for line in joins)


def test_a_term_of_many_queries_is_expanded_once(spark, monkeypatch):
    """Queries that share a term share its expansion and the parts of scores that it gives, and each gets its own rows."""
    docs = spark.createDataFrame([(f"n{i:02d}", "alpha beta", f"gamma word{i}") for i in range(20)], "id string, title string, body string")
    n = spark.createDataFrame([(20,)], "n long")
    kept = []
    monkeypatch.setattr(lexical, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    found = lexical.lexical_search(lexical.build_postings(docs), spark.createDataFrame([(i, "word") for i in range(30)], "qid long, q string"), n, 5)
    assert [r["count"] for r in found.groupBy("qid").count().collect()] == [5] * 30
    assert [t.count() for t in kept if "term" in t.columns] == [20]


def test_the_stored_index_holds_each_text_once(spark):
    from corpusloom.plans import search_queries

    assert "input" not in search_queries.chunk_index(spark, "/root/testdata/sf0.001").columns


def test_upkeep_does_not_send_the_postings_held(spark):
    docs = spark.createDataFrame([(f"n{i:02d}", "alpha", f"beta word{i}") for i in range(20)], "id string, title string, body string")
    held = stored(lexical.build_postings(docs))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    changed = docs.filter("id = 'n03'").withColumn("body", F.lit("gamma"))
    now = docs.filter("id <> 'n03'").union(changed)
    after, counts, n = lexical.maintain(held, df, 20, now, changed, docs.filter("id = 'zz'").select("id"))
    assert n == 20 and after.filter("note_id = 'n03'").count() == 2 and {r["term"]: r["d"] for r in counts.withColumnRenamed("df", "d").collect()}["beta"] == 19
    plan = after._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
