"""Upkeep of an index by micro-batches, and answers out of order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.embedding import HashingEmbedder
from corpusloom.operators.lexical import build_postings, note_postings, posting_rows
from corpusloom.sources import versions
from corpusloom.streaming import streams

SCHEMA = "id string, title string, body string, updated_at long, deleted boolean"


def counting(counter):
    """An embedder that counts the texts it embeds, over all tasks; made here so that its class goes along to them."""

    class Counting(HashingEmbedder):
        def embed(self, texts):
            counter.add(len(texts))
            return HashingEmbedder.embed(self, texts)

    return Counting(8)


@pytest.fixture
def where(tmp_path):
    return f"file://{tmp_path}/ix"


def saves(spark, *rows):
    return spark.createDataFrame([(*r, False)[:5] for r in rows], SCHEMA)


def state(spark, where):
    live = streams.live_index(spark, where)
    postings = sorted((r["term"], r["note_id"], r["tf"]) for r in live["postings"].collect())
    return postings, {r["term"]: r["df"] for r in live["df"].collect()}, live["n_docs"].first()["n"], sorted(r["note_id"] for r in live["headers"].collect()), sorted((r["note_id"], r["idx"]) for r in live["chunks"].collect())


def test_the_last_save_stays_whatever_comes_later(spark, where):
    save = streams.index_batch(where, HashingEmbedder(8))
    save(saves(spark, ("a", "One", "first words", 1), ("b", "Two", "other words", 1), ("a", "One", "second words", 2)), 0)
    later = saves(spark, ("b", "Two", "newer text", 3), ("a", "One", "stale words", 0))
    save(later, 1)
    before = state(spark, where)
    save(later, 1)  # a batch that is repeated
    assert state(spark, where) == before
    terms = {t for t, n, _ in before[0]}
    assert {"second", "newer"} <= terms and not terms & {"first", "stal", "other"} and before[2] == 2 and len(before[4]) == 4


def test_emptied_and_deleted_notes_go(spark, where):
    save = streams.index_batch(where, HashingEmbedder(8))
    save(saves(spark, ("a", "One", "words", 1), ("b", "Two", "words", 1), ("c", "Three", "words", 1)), 0)
    save(saves(spark, ("a", "", " ", 2), ("b", "", "", 2, True), ("none", "", "", 2, True)), 1)
    postings, df, n, notes, chunks = state(spark, where)
    assert {x[1] for x in postings} == {"c"} == {x[0] for x in chunks} and set(df.values()) == {1} and n == 1 and notes == ["a", "c"]
    save(saves(spark, ("b", "Two", "again words", 3)), 2)  # a deleted note comes back
    assert state(spark, where)[2:4] == (2, ["a", "b", "c"])


def test_an_older_save_does_not_bring_a_deleted_note_back(spark, where):
    save = streams.index_batch(where, HashingEmbedder(8))
    for number in range(streams.FAN):  # the deletion is merged with all there is
        save(saves(spark, ("a", "", "", 5, True), (f"n{number}", "One", "words", 1)), number)
    assert len(versions.current(spark, where)["folders"]) == 1
    save(saves(spark, ("a", "One", "late words", 3)), streams.FAN)
    assert "a" not in state(spark, where)[3]


def test_unchanged_saves_embed_nothing(spark, where):
    counter = spark.sparkContext.accumulator(0)
    save = streams.index_batch(where, counting(counter))
    save(saves(spark, ("a", "One", "words", 1), ("b", "Two", "words", 1)), 0)
    made, before = counter.value, state(spark, where)
    save(saves(spark, ("a", "One", "words", 5), ("b", "Two", "words\\n\\n", 6)), 1)
    assert counter.value == made + 2 and made == 4  # b's text changed: its title and its body
    save(saves(spark, ("a", "One", "words", 7)), 2)
    assert counter.value == made + 2 and state(spark, where)[4] == before[4]


def test_many_batches_equal_one_build_and_leave_few_folders(spark, where):
    draw, save, held = random.Random(3), streams.index_batch(where, HashingEmbedder(4)), {}
    for number in range(18):
        rows = []
        for i in draw.sample(range(12), 3):
            text, deleted = " ".join(draw.choices(["red", "green", "blue", "grey", ""], k=3)), draw.random() < 0.2
            rows.append((f"n{i}", draw.choice(["", "title"]), text, number, deleted))
            held[f"n{i}"] = None if deleted else rows[-1]
        save(saves(spark, *rows), number)
    folders = versions.current(spark, where)["folders"]
    assert len(folders) == 3 and [f["level"] for f in folders] == [2, 0, 0]
    live = [(i, t, b) for i, t, b, *_ in filter(None, held.values())]
    want = build_postings(spark.createDataFrame(live, "id string, title string, body string"))
    want = sorted((r["term"], r["note_id"], r["tf"]) for r in want.collect())
    postings, df, n, notes, _ = state(spark, where)
    assert postings == want and notes == sorted(i for i, *_ in live)
    assert n == sum(bool((t + b).strip()) for _, t, b in live)
    assert df == {t: sum(x[0] == t for x in want) for t in {x[0] for x in want}}
    assert len([x for x in versions.names(spark, where) if x.startswith(("batch-", "merged-"))]) <= len(folders) + streams.FAN


def test_answers_to_replaced_queries_are_dropped(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [
        [("s", "query", 1, at(0), ""), ("s", "query", 2, at(2), ""), ("s", "answer", 1, at(3), "late"), ("t", "query", 1, at(1), "")],
        [("s", "answer", 2, at(4), "two"), ("s", "answer", 2, at(5), "again"), ("t", "query", 2, at(6), ""), ("t", "answer", 2, at(6), "tie")],
        [("s", "query", 3, at(8), ""), ("s", "answer", 2, at(9), "old"), ("t", "answer", 1, at(9), "old"), ("s", "answer", 3, at(7), "before its query")],
    ]
    schema = "session string, kind string, number long, at timestamp, payload string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.fresh_answers(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["session"], r["number"], r["payload"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("s", 2, "two"), ("t", 2, "tie")]


@pytest.mark.parametrize(("name", "files"), [("stream_reindex", 5), ("fresh_answers", 3)])
def test_the_files_of_a_stream_grow_in_number(spark, monkeypatch, name, files):
    """A micro-batch is written and read by more tasks where a table has more parts."""
    from pathlib import Path

    from corpusloom.plans import catalog_queries
    from corpusloom.plans import views as V

    made, scratch = [], V.scratch
    monkeypatch.setattr(V, "scratch", lambda s: made.append(scratch(s)) or made[-1])
    small = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list(Path(made[0].removeprefix("file://")).glob("*.parquet"))) > files


def test_postings_of_a_note_are_one_row_and_nothing_is_sent(spark, where):
    words = ["Red", "reds", "ÎLES", "Straße", "ΣΑΣ", "a^b", "x`y", "naïve", "４２", "漢字", "“quoted”", "été", "İx", "pass​word", "½", "🙂", "boxes", "oes"]
    draw = random.Random(8)
    rows = [(f"n{i}", " ".join(draw.choices(words, k=draw.randint(0, 4))), draw.choice([" ", "-", "\n", "\x00"]).join(draw.choices(words[: draw.choice([2, 18])], k=draw.randint(0, 40)))) for i in range(80)]
    rows += [("none", None, None), ("signs", "—", "... ¿?"), ("blank", "", "  ")]
    docs = spark.createDataFrame(rows, "id string, title string, body string")
    found = note_postings(docs)
    assert found.filter("note_id in ('none', 'signs', 'blank')").count() == 0 and found.count() == found.select("note_id").distinct().count()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    columns = ["note_id", "term", "tf", "in_title"]
    assert sorted(posting_rows(found).select(columns).collect()) == sorted(build_postings(docs).select(columns).collect())
    streams.index_batch(where, HashingEmbedder(4))(docs.withColumns({"updated_at": F.lit(1).cast("long")}), 0)
    (folder,) = versions.current(spark, where)["folders"]
    held = spark.read.parquet(f"{folder['path']}/postings")
    assert held.count() == found.count()
