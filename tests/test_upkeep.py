"""Warm scans, model serving, numbering, kept counts and swept references."""

from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import attachments, embedding, lexical, numbering
from corpusloom.sources import ingest
from corpusloom.sources.tables import stored

NOTE = "---\nid: \"{0}\"\ntitle: \"T\"\ncreatedAt: \"1\"\nupdatedAt: \"2\"\n---\n\n{1}\n"


def test_a_scan_reads_only_what_changed(spark, tmp_path, monkeypatch):
    folder, top = tmp_path / "v/notes/2024", f"file://{tmp_path}/v"
    folder.mkdir(parents=True)
    for i in range(4):
        (folder / f"{i}.md").write_text(NOTE.format(i, "body"))
    (folder / "bad.md").write_text("no header")
    none = spark.createDataFrame([], ingest.HINTS)
    first = stored(ingest.scan_markdown(spark, top, none, stored)[0])
    assert first.filter("was_read").count() == 5 and first.filter("reason is not null").count() == 1
    opened = []
    real = ingest.parse_notes
    monkeypatch.setattr(ingest, "parse_notes", lambda raw, store: opened.append(raw.count()) or real(raw, store))
    again, notes = ingest.scan_markdown(spark, top, first.drop("was_read"), stored)
    assert again.filter("was_read").count() == 0 and opened == [0] and notes.count() == 0
    assert again.drop("was_read").exceptAll(first.drop("was_read")).count() == 0
    (folder / "1.md").write_text(NOTE.format(1, "a longer body"))
    (folder / "2.md").unlink()
    (folder / "9.md").write_text(NOTE.format(9, "new"))
    for most in (10_000, 1):  # few files by name, many in one scan
        later, notes = ingest.scan_markdown(spark, top, first.drop("was_read"), stored, most)
        assert sorted(r["id"] for r in notes.collect()) == ["1", "9"] == sorted(r["id"] for r in later.filter("was_read").collect())
        assert sorted(r["id"] or "-" for r in later.collect()) == ["-", "0", "1", "3", "9"]


def test_a_model_is_loaded_once_a_worker_and_sees_no_text_twice(spark, tmp_path):
    sizes, loads = f"{tmp_path}/sizes", f"{tmp_path}/loads"

    def load():
        import os

        with open(loads, "a") as f:
            f.write(f"{os.getpid()}\n")

        def embed(texts):
            with open(sizes, "a") as f:
                f.write("".join(f"{len(texts)} {t}\n" for t in texts))
            assert sorted(texts, key=len) == texts
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    model = embedding.LoadedEmbedder(f"counting-{tmp_path}", 2, load, batch=16)
    rows = [(i, f"text {i % 50}" + "x" * (i % 7)) for i in range(700)] + [(700, None), (701, "")]
    planned = spark.createDataFrame(rows, "note_id long, input string").repartition(8)
    out = embedding.embed_chunks(planned, model).collect()
    assert sorted((r["note_id"], r["embedding"][0]) for r in out) == sorted((i, float(len(t or ""))) for i, t in rows)
    seen = [line.rstrip("\n").split(" ", 1) for line in open(sizes)]
    assert max(int(n) for n, _ in seen) <= 16 and max(Counter(t for _, t in seen).values()) == 1 and len(seen) == len({t or "" for _, t in rows})
    pids = open(loads).read().split()
    assert len(pids) == len(set(pids))


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("id")).repartition(7)
    got = {r["id"]: r["n"] for r in numbering.numbered(df, "id").collect()}
    assert [got[i] for i in sorted(got)] == list(range(1, 1001))
    assert numbering.numbered(df.limit(0), "id").count() == 0


def test_kept_counts_equal_a_rebuild(spark):
    schema = "id string, title string, body string"
    docs = [(f"n{i}", f"title {i % 3}", " ".join(f"w{k}" for k in range(i % 5))) for i in range(20)]
    old = spark.createDataFrame(docs, schema)
    postings = lexical.build_postings(old)
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for n_changed in (3, 12):  # by the change, and from anew
        changed = [(i, "other", "w1 fresh") for i, *_ in docs[:n_changed]]
        after = [d for d in docs[n_changed:] if d[0] != "n19"] + changed
        now = spark.createDataFrame(after, schema)
        got, counts, n = lexical.maintain(postings, df, 20, now, spark.createDataFrame(changed, schema), spark.createDataFrame([("n19",), ("none",)], "id string"))
        want = lexical.build_postings(now)
        rows = lambda d: sorted((r["term"], r["note_id"], r["tf"]) for r in d.collect())
        assert n == 19 and rows(got) == rows(want)
        assert {r["term"]: r["df"] for r in counts.collect()} == Counter(t for t, *_ in rows(want))


def test_references_of_swept_blobs_go(spark):
    refs = spark.createDataFrame([("attachments/a.png", "gone"), ("attachments/b.png", "n")], "path string, note_id string")
    notes = spark.createDataFrame([("n", "![x](attachments/b.png)")], "id string, body string")
    orphans, left = attachments.sweep(refs.select("path"), refs, notes)
    assert [r["path"] for r in orphans.collect()] == ["attachments/a.png"] and [tuple(r) for r in left.collect()] == [("attachments/b.png", "n")]


def test_a_bucketed_catalogue_is_not_shuffled(spark):
    from corpusloom.operators import catalog
    from corpusloom.sources.tables import bucketed

    columns = "id string, title string, path string, created_at string, updated_at string, space_ids array<string>"
    rows = [(f"n{i}", "t", f"p{i}", "1", "2", []) for i in range(50)]
    prior = bucketed(spark.createDataFrame(rows, columns), "path", 6)
    parsed = stored(spark.createDataFrame([("n1", "new", "p1", "1", "3", [])], columns))
    rejected = stored(spark.createDataFrame([("p2", "no header"), ("q", "no header")], "path string, reason string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, skipped = catalog.reconcile(parsed, rejected, prior)
        assert sorted(r["id"] for r in kept.collect()) == ["n1", "n2"] and [r["path"] for r in skipped.collect()] == ["q"]
        for df in (prior.join(rejected.select("path"), "path", "left_semi"), skipped):
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(path") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changed_snapshots_are_told(spark):
    from corpusloom.operators.catalog import snapshot_changed

    make = lambda *rows: spark.createDataFrame(rows, "id string, tags array<string>")
    a = make(("1", ["x"]), ("2", None))
    assert snapshot_changed(None, a) and not snapshot_changed(a, make(("2", None), ("1", ["x"])))
    for other in (make(("1", ["x"])), make(("1", ["x"]), ("2", [])), make(("1", ["x"]), ("2", None), ("2", None)), make(("1", ["y"]), ("2", None))):
        assert snapshot_changed(a, other)


def test_markdown_is_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    """The driver keeps no entry a file: Spark's readers, which do, aren't asked. Hidden files and others are passed over, bytes stay."""
    from pyspark.sql.readwriter import DataFrameReader

    top = tmp_path / "notes" / "2024"
    for month in ("01", "02", "_old"):
        (top / month).mkdir(parents=True)
        for name in ("a b.md", ".c.md", "d.txt"):
            (top / month / name).write_bytes(b"x\xff\r\n")
    (top / "02" / "e.md").write_bytes(b"")
    for name in ("text", "format", "load"):
        monkeypatch.setattr(DataFrameReader, name, lambda *a, **k: pytest.fail("asked a reader"))
    files = {r["path"]: (r["size"], r["modified"]) for r in ingest.list_markdown(spark, f"file://{tmp_path}").collect()}
    assert sorted(files) == ["notes/2024/01/a b.md", "notes/2024/02/a b.md", "notes/2024/02/e.md"] and files["notes/2024/02/e.md"][0] == 0
    raw = ingest.read_markdown(spark, f"file://{tmp_path}").selectExpr("path", "cast(raw AS binary) AS raw").collect()
    assert {r["path"]: bytes(r["raw"]) for r in raw} == {"notes/2024/01/a b.md": b"x\xff\r\n", "notes/2024/02/a b.md": b"x\xff\r\n", "notes/2024/02/e.md": b""}
