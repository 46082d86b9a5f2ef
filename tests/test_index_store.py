"""The stored index: writing over it, failed writes, buckets that stay, models apart."""

import pytest

from corpusloom.operators import index
from corpusloom.operators.embedding import HashingEmbedder
from corpusloom.sources import index_store as X
from corpusloom.sources import ingest, versions

NOTES = [("a", "One", "first words"), ("b", "Two", "other words"), ("c", "Three", "third words of it"), ("d", "", "")]


def make(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, body string")


def held(spark, path, model=None):
    headers, chunks = X.read_stored(spark, path, model)
    return sorted(r["note_id"] for r in headers.collect()), sorted({r["note_id"] for r in chunks.collect()})


@pytest.fixture
def written(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    index.reindex_stored(make(spark, NOTES), path, HashingEmbedder(8))
    return path


def test_an_index_forgets_what_is_gone(spark, written):
    assert held(spark, written) == (["a", "b", "c", "d"], ["a", "b", "c"])  # a note without text keeps a header
    plan, _ = index.reindex_stored(make(spark, NOTES[:2]), written, HashingEmbedder(8))
    assert held(spark, written) == (["a", "b"], ["a", "b"]) and plan.filter("stale").count() == 0
    plan, _ = index.reindex_stored(make(spark, [("a", "", ""), NOTES[1]]), written, HashingEmbedder(8))
    assert held(spark, written) == (["a", "b"], ["b"]) and [r["id"] for r in plan.filter("stale").collect()] == ["a"]
    headers, chunks = (df.limit(0) for df in X.read_stored(spark, written))
    X.write_index(headers, chunks, written)
    assert held(spark, written) == ([], [])


def test_a_pass_without_changes_writes_nothing(spark, written):
    before = versions.names(spark, written)
    assert index.reindex_stored(make(spark, NOTES), written, HashingEmbedder(8))[1] == [] and versions.names(spark, written) == before


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ix", [(f"n{i}", f"Title {i}", f"body of {i}") for i in range(60)]
    headers, chunks, _ = index.reindex(make(spark, rows), spark.createDataFrame([], X.HEADERS), spark.createDataFrame([], X.CHUNKS), HashingEmbedder(8))
    X.write_index(headers, chunks, path, 5)
    old = versions.current(spark, path)
    assert old["buckets"] == 12
    changed = [(i, t, b + " anew" if i == "n7" else b) for i, t, b in rows if i != "n9"]
    _, touched = index.reindex_stored(make(spark, changed), path, HashingEmbedder(8))
    new = versions.current(spark, path)
    assert 1 <= len(touched) <= 2
    for name in X.TABLES:
        assert {f for f in old[name] if X._bucket(f) not in touched} == {f for f in new[name] if X._bucket(f) not in touched}
        assert not {f for f in old[name] if X._bucket(f) in touched} & set(new[name])
    assert held(spark, path)[0] == sorted(i for i, *_ in changed)
    assert "anew" in X.read_stored(spark, path)[1].filter("note_id = 'n7' and idx = 0").first()["text"]
    X.branch(spark, path, f"{path}2")
    index.reindex_stored(make(spark, rows[:1]), f"{path}2", HashingEmbedder(8))
    assert held(spark, f"{path}2")[0] == ["n0"] and len(held(spark, path)[0]) == 59


def test_a_failed_write_leaves_the_old_state(spark, written, monkeypatch):
    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(versions, "publish", fails)
    with pytest.raises(OSError, match="lost"):
        index.reindex_stored(make(spark, NOTES[:1]), written, HashingEmbedder(8))
    monkeypatch.undo()
    assert held(spark, written)[0] == ["a", "b", "c", "d"]
    assert len(X.clean(spark, written)) == 1 and held(spark, written)[0] == ["a", "b", "c", "d"]
    index.reindex_stored(make(spark, NOTES[:1]), written, HashingEmbedder(8))
    assert held(spark, written)[0] == ["a"]


def test_models_are_kept_apart(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    row = lambda m: [("n", "h", m, 2, 3)]
    for m in ("acme/model: v1=x", "other"):
        X.update_index(spark.createDataFrame([(f"n-{m}", *row(m)[0][1:])], X.HEADERS), spark.createDataFrame([(f"n-{m}", 0, "body", "t", 0, 1, [1.0, 0.0], m)], X.CHUNKS), spark.createDataFrame([], "note_id string"), path)
    assert held(spark, path, "other") == (["n-other"], ["n-other"]) and len(held(spark, path, "acme/model: v1=x")[0]) == 1 and len(held(spark, path)[0]) == 2
    assert held(spark, path, "none") == ([], [])
    assert len(X.read_stored(spark, path, "other")[1].inputFiles()) == 1  # the other model's files aren't opened


def test_an_index_that_grows_gets_more_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    make_headers = lambda a, b: spark.createDataFrame([(f"n{i}", "h", "m", 2, 3) for i in range(a, b)], X.HEADERS)
    none = spark.createDataFrame([], X.CHUNKS)
    X.write_index(make_headers(0, 4), none, path, 4)
    X.update_index(make_headers(4, 40), none, spark.createDataFrame([], "note_id string"), path)
    assert versions.current(spark, path)["buckets"] == 10 and len(held(spark, path)[0]) == 40


def test_files_that_are_passed_over_are_told(spark, tmp_path):
    spark.createDataFrame([("n1", 0, "body", "t", 0, 1, 2, [1.0, 2.0], "m", None)], ingest.INDEX).coalesce(1).write.parquet(f"file://{tmp_path}/index")
    (tmp_path / "index/broken.parquet").write_bytes(b"no parquet at all")
    told = ingest.passed_over(spark, f"file://{tmp_path}/index").collect()
    assert [(r["file"].rsplit("/", 1)[1], r["length"]) for r in told] == [("broken.parquet", 17)]


def counting(spark, rows):
    """(notes, seen): notes whose bodies are counted by seen when they are read."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def read(body):
        seen.add(1)
        return body

    return make(spark, rows).repartition(2).withColumn("body", F.udf(read, "string")("body")), seen


def test_a_full_pass_hashes_notes_once(spark):
    from pyspark.sql import functions as F

    notes, seen = counting(spark, [(f"n{i}", f"t{i}", f"body {i}") for i in range(40)])
    none, paths = (spark.createDataFrame([], X.HEADERS), spark.createDataFrame([], X.CHUNKS)), spark.createDataFrame([("attachments/a.png",)], "path string")
    headers, chunks, orphans, report = index.full_reindex(notes, *none, paths, HashingEmbedder(8))
    assert report.select("n_embedded", "n_headers", "n_chunks", "n_orphans").first() == (40, 40, 80, 1)
    assert seen.value <= 3 * 40  # hashed, cut, asked for references


def test_an_incremental_pass_reads_texts_for_cutting_alone(spark, written):
    plain, seen = make(spark, NOTES[:2] + [("e", "New", "words")]), counting(spark, NOTES[:2] + [("e", "New", "words")])
    plan, _ = index.reindex_stored(plain, written, HashingEmbedder(8), texts=seen[0])
    assert [r["id"] for r in plan.filter("stale").collect()] == ["e"] and held(spark, written) == (["a", "b", "e"], ["a", "b", "e"])
    assert 1 <= seen[1].value <= 3
