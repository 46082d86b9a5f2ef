"""Files, catalogue, spaces, attachments, index upkeep, streams and generation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import attachments, catalog, chunking, embedding, generate, index, spaces
from corpusloom.sources import ingest
from corpusloom.streaming import streams

BODIES = ["plain", "\n\nlead", "trail \n\n", "a\r\nb", "", "---\nnot a header\n---", "# h\n\n- x\n", "tab\tand  spaces", "é ☃ 😀", "x: y"]


def test_parse_of_rendered_notes_gives_canonical_bodies(spark):
    rows = [(f"id{i}", f'T "{i}" \\n \t', b, datetime(2024, 3, 1), datetime(2024, 3, 2), "a, b,general" if i % 2 else None) for i, b in enumerate(BODIES)]
    notes = spark.createDataFrame(rows, "id string, title string, body string, created_at timestamp, updated_at timestamp, space_ids string")
    raw = ingest.render_notes(notes).select("path", F.col("text").alias("raw"))
    parsed, rejected = ingest.parse_notes(raw)
    got = {r["id"]: r for r in parsed.collect()}
    assert rejected.count() == 0 and len(got) == len(rows)
    for i, b in enumerate(BODIES):
        assert got[f"id{i}"]["title"] == rows[i][1] and got[f"id{i}"]["space_ids"] == (["a", "b"] if i % 2 else [])
        assert got[f"id{i}"]["body"] == b.replace("\r\n", "\n").rstrip().lstrip("\n")


@pytest.mark.parametrize(
    ("raw", "reason"),
    [("no header", "no header"), ("---\nid: x\n", "header not closed"), ("---\nid x\n---\n", "header line without a colon"), ("---\nid: x\ntitle: y\n---\n", "missing createdAt, updatedAt"), (None, "no header"), ("---\nid: a\nid: b\ntitle: t\ncreatedAt: c\nupdatedAt: u\nother: z\n---\nbody\n", None)],
)
def test_rejections(spark, raw, reason):
    parsed, rejected = ingest.parse_notes(spark.createDataFrame([("p.md", raw)], "path string, raw string"))
    assert [r["reason"] for r in rejected.collect()] == ([reason] if reason else [])
    assert [(r["id"], r["body"]) for r in parsed.collect()] == ([] if reason else [("b", "body")])


def test_markdown_files(spark, tmp_path):
    rendered = spark.createDataFrame([("notes/2024/01/a.md", "A\nx"), ("notes/2024/02/b.md", "B")], "path string, text string")
    assert ingest.write_markdown(rendered, f"file://{tmp_path}/v") == 2
    (tmp_path / "v/notes/c.txt").write_text("no")
    assert {r["path"]: r["raw"] for r in ingest.read_markdown(spark, f"file://{tmp_path}/v").collect()} == {"notes/2024/01/a.md": "A\nx", "notes/2024/02/b.md": "B"}
    assert ingest.read_markdown(spark, f"file://{tmp_path}/none").count() == 0


def test_json_documents(spark, tmp_path):
    (tmp_path / "c").mkdir()
    good = '{"version": 1, "notes": [{"id": "a", "title": "t", "path": "notes/a.md", "createdAt": "1", "updatedAt": "2"}]}'
    (tmp_path / "c/good.json").write_text(good)
    (tmp_path / "c/bad.json").write_text(good.replace("notes/a.md", "/a.md"))
    (tmp_path / "c/broken.json").write_text("{")
    rows, rejected = ingest.read_catalog(spark, f"file://{tmp_path}/c")
    assert [r["id"] for r in rows.collect()] == ["a"]
    assert sorted(r["reason"] for r in rejected.collect()) == ["not a catalogue", "notes[0]: path is not safe"]
    (tmp_path / "refs.json").write_text('{"version": 1, "refs": {"attachments/x.png": ["a", "b"]}}')
    assert ingest.read_refs(spark, f"file://{tmp_path}/refs.json")[0].count() == 2
    (tmp_path / "spaces.json").write_text('{"version": 1, "spaces": [{"id": "s", "name": "S", "colorId": "red", "createdAt": "1", "updatedAt": "2"}]}')
    assert ingest.read_spaces(spark, f"file://{tmp_path}/spaces.json")[0].first()["name"] == "S"
    assert ingest.write_catalog(rows, f"file://{tmp_path}/out", False) is False and ingest.write_catalog(rows, f"file://{tmp_path}/out", True) is True


def test_dedupe_and_reconcile(spark):
    kind = "id string, title string, path string, created_at string, updated_at string, space_ids array<string>"
    parsed = spark.createDataFrame([("a", "old", "n/1", "c", "2024", []), ("a", "new", "n/2", "c", "2025", []), ("b", "first", "n/3", "c", "2024", []), ("b", "second", "n/4", "c", "2024", [])], kind)
    rejected = spark.createDataFrame([("n/9", "bad"), ("n/8", "bad")], "path string, reason string")
    prior = spark.createDataFrame([("z", "kept", "n/9", "c", "2020", []), ("y", "gone", "n/7", "c", "2020", [])], kind)
    notes, skipped = catalog.reconcile(parsed, rejected, prior)
    assert {r["id"]: r["title"] for r in notes.collect()} == {"a": "new", "b": "first", "z": "kept"}
    assert [r["path"] for r in skipped.collect()] == ["n/8"]
    assert tuple(catalog.reconcile_diff(prior, notes).first()) == (2, 1, 1)
    assert catalog.snapshot_changed(None, notes) and not catalog.snapshot_changed(notes, notes)


def test_spaces(spark):
    kept = spaces.parse_space_ids(F.col("c"))
    row = spark.createDataFrame([(" a,b , a,general,x y,,",)], "c string").select(kept.alias("k"), spaces.serialize_space_ids(kept).alias("s"), spaces.serialize_space_ids(F.array(F.lit("general"))).alias("n")).first()
    assert row["k"] == ["a", "b"] and row["s"] == "a,b" and row["n"] is None
    notes = spark.createDataFrame([("1", ["a", "dangling"], 1), ("2", [], 2)], "id string, space_ids array<string>, updated_at int")
    stored = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    assert {r["id"]: r["n_notes"] for r in spaces.space_counts(stored, notes).collect()} == {"general": 1, "a": 1, "b": 0}
    assert {r["id"]: r["space_names"] for r in spaces.resolve_spaces(notes, stored).collect()} == {"1": ["A", "dangling"], "2": ["General"]}
    assert {r["id"]: r["space_names"] for r in spaces.resolve_spaces(notes, stored, True).collect()}["2"] == []
    after, left = spaces.delete_spaces(notes, stored, ["a", "general"], F.lit(99))
    assert {r["id"]: (r["space_ids"], r["updated_at"]) for r in after.collect()} == {"1": (["dangling"], 99), "2": ([], 2)} and left.count() == 1
    patched = spaces.apply_space_patch(spark.createDataFrame([("a", "A", "red", "d")], "id string, name string, color_id string, description string"), spark.createDataFrame([("a", "New", None, None, True)], "id string, name string, color_id string, description string, clear_description boolean"))
    assert tuple(patched.first()) == ("a", "New", "red", None)


def test_attachments(spark):
    body = "![a](attachments/1.png) ![b](attachments/../2.png) ![a](attachments/1.png) <img src='attachments/3.png'>"
    notes = spark.createDataFrame([("n", body), ("m", None)], "id string, body string")
    assert [r["path"] for r in attachments.extract_refs(notes).collect()] == ["attachments/1.png"]
    assert {r["path"] for r in attachments.extract_refs(notes, True).collect()} == {"attachments/1.png", "attachments/3.png"}
    blobs = spark.createDataFrame([("image/png", bytearray(b"x")), ("image/png", bytearray(b"x")), ("image/jpeg", bytearray(b"x")), ("text/plain", bytearray(b"x")), ("image/gif", None)], "mime string, content binary")
    stored = {(r["ext"], r["n_copies"]) for r in attachments.store_attachments(blobs).collect()}
    assert stored == {("png", 2), ("jpg", 1)}
    refs = attachments.build_refs(notes)
    after, emptied = attachments.sync_refs(refs, spark.createDataFrame([("n", body, "none")], "note_id string, old_body string, new_body string"))
    assert after.count() == 0 and [r["path"] for r in emptied.collect()] == ["attachments/1.png"]
    after, emptied = attachments.drop_refs(refs, spark.createDataFrame([("n",)], "note_id string"))
    assert after.count() == 0 and emptied.count() == 1
    page = spark.createDataFrame([(1, '<img alt="x" src="data:image/png;base64,aGk="><img src="data:image/bmp;base64,aGk="><img src="x.png">')], "page_id long, html string")
    assert [(r["n"], bytes(r["content"])) for r in attachments.harvest_inline_images(page).collect()] == [(0, b"hi")]


def test_incremental_reindex_equals_a_full_one(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, title string, body string")
    model = embedding.HashingEmbedder(8)
    before = make([("a", "A", "one two"), ("b", "B", "x"), ("c", "", ""), ("d", "D", "gone")])
    empty = spark.createDataFrame([], "note_id string, content_hash string, model_id string, dimensions int, schema_version int")
    none = embedding.embed_chunks(chunking.plan_chunks(before.limit(0)), model).withColumn("model_id", F.lit(model.id))
    headers, chunks, plan = index.reindex(before, empty, none, model)
    assert plan.filter("stale").count() == 4 and headers.count() == 4
    headers, chunks = headers.cache(), chunks.cache()
    after = make([("a", "A", "one two  \n"), ("b", "B", "changed"), ("c", "", ""), ("e", "E", "new")])
    headers, _ = index.prune_orphans(headers, after)
    chunks, _ = index.prune_orphans(chunks, after)
    headers, chunks, plan = index.reindex(after, headers, chunks, model)
    assert {r["id"] for r in plan.filter("stale").collect()} == {"b", "e"}
    full_headers, full, _ = index.reindex(after, empty, none, model)
    key = ["note_id", "idx", "kind"]
    assert sorted(map(tuple, chunks.select(key).collect())) == sorted(map(tuple, full.select(key).collect()))
    assert {r["note_id"] for r in headers.collect()} == {r["note_id"] for r in full_headers.collect()}
    assert index.ensure_manifest(headers, index.Profile("other", 8)).count() == 0
    assert [index.progress_percent(*x) for x in ((0, 0), (1, 3), (5, 4))] == [100, 33, 100]


def test_stream_debounce_equals_batch_for_closed_bursts(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1, h, m), n) for n, (k, h, m) in enumerate([(1, 0, 0), (1, 0, 10), (1, 0, 25), (1, 2, 0), (2, 0, 5), (2, 5, 0), (1, 9, 0)])]
    df = spark.createDataFrame(rows, "key long, ts timestamp, n long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {(r["key"], r["burst_start"], r["n_edits"], r["payload"]["n"]) for r in streams.debounce(df, "key", "ts", "30 minutes").collect()}
    assert {(k, c, n) for k, _, c, n in batch} == {(1, 3, 2), (1, 1, 3), (1, 1, 6), (2, 1, 4), (2, 1, 5)}
    stream = streams.debounce(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "key", "ts", "30 minutes", "1 hour")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["key"], r["burst_start"], r["n_edits"], r["payload"]["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got < batch and {x for x in batch - got} == {x for x in batch if x[3] == 6}
    assert streams.first_occurrence(df, ["key"]).count() == 2


def mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (1 | a)) & 0xFFFFFFFF
        t = ((t + ((t ^ (t >> 7)) * (61 | t))) & 0xFFFFFFFF) ^ t
        yield (t ^ (t >> 14)) & 0xFFFFFFFF


def test_generator_is_the_seeded_sequence(spark):
    rows = generate.generate_corpus(spark, 3, 2, 42).orderBy("id").collect()
    draws, pick = mulberry(42), lambda: generate.WORDS[int(next(draws) / 4294967296 * len(generate.WORDS))]
    for i, r in enumerate(rows):
        assert r["title"] == f"Note {i} {pick()}"
        out = []
        for k in range(192):
            out.append(pick())
            if k > 0 and k % 12 == 0:
                out.append(".\n")
        assert r["body"] == " ".join(out)
    again = generate.generate_corpus(spark, 3, 2, 42).collect()
    assert sorted(again) == sorted(rows)


def test_spaces_and_references_are_validated(spark, tmp_path):
    for name, text in {
        "good": '{"version": 1, "spaces": [{"id": "s", "name": "S", "colorId": "red", "createdAt": "1", "updatedAt": "2"}]}',
        "bad": '{"version": 1, "spaces": [{"id": "a", "name": "A", "colorId": "red", "createdAt": "1", "updatedAt": "2"}, {"id": "b", "colorId": "red", "createdAt": "1", "updatedAt": "2"}]}',
        "none": '{"version": 1}',
    }.items():
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / f"s/{name}.json").write_text(text)
    rows, bad = ingest.read_spaces(spark, f"file://{tmp_path}/s")
    assert [r["id"] for r in rows.collect()] == ["s"]
    assert sorted(r["reason"] for r in bad.collect()) == ["no spaces", "spaces[1]: name is missing"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{"version": 1, "refs": {"attachments/x.png": ["a", null]}}')
    (tmp_path / "r/b.json").write_text('{"version": 1, "refs": {"attachments/y.png": ["b"]}}')
    rows, bad = ingest.read_refs(spark, f"file://{tmp_path}/r")
    assert [tuple(r) for r in rows.collect()] == [("attachments/y.png", "b")]
    assert [r["reason"] for r in bad.collect()] == ["refs[0]: an id is missing: attachments/x.png"]


def test_index_reading_passes_over_broken_files(spark, tmp_path):
    record = ("n1", 0, "body", "t", 0, 1, 2, [1.0, 2.0], "m", None)
    (tmp_path / "old").mkdir()
    (tmp_path / "old/x.json").write_text('{"note_id": "n2", "idx": 0, "kind": "body", "text": "t", "offset": 0, "length": 1, "model_id": "m", "inline_embedding": [1.0, 0.0]}\n{"note_id": "n3", "idx": 0, "kind": "odd", "offset": 0, "length": 1, "inline_embedding": [1.0]}')
    spark.createDataFrame([record], ingest.INDEX).coalesce(1).write.parquet(f"file://{tmp_path}/index")
    (tmp_path / "index/broken.parquet").write_bytes(b"no parquet at all")
    good, bad = ingest.read_index(spark, f"file://{tmp_path}/index", f"file://{tmp_path}/old")
    assert sorted((r["note_id"], r["embedding"]) for r in good.collect()) == [("n1", [1.0, 2.0]), ("n2", [1.0, 0.0])]
    assert [(r["note_id"], r["reason"]) for r in bad.collect()] == [("n3", "unknown kind")]


def test_attachment_paths_with_white_space_are_found(spark):
    df = spark.createDataFrame([("n", "![x](attachments/my file.png) and ![y](attachments/b.png)")], "id string, body string")
    assert sorted(r["path"] for r in attachments.build_refs(df).collect()) == ["attachments/b.png", "attachments/my file.png"]
