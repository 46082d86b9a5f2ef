"""Queries on files, catalogue, spaces, attachments, index upkeep and streams, each with its comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import attachments, catalog, chunking, embedding, evaluate, generate, index, lexical, spaces
from corpusloom.plans import sqltext as S
from corpusloom.plans import views as V
from corpusloom.sources import index_store, ingest
from corpusloom.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-02-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def with_path(notes: DataFrame) -> DataFrame:
    return notes.withColumn("path", T.note_path(F.col("title"), F.col("id"), F.col("created_at")))


def listed(notes: DataFrame) -> DataFrame:
    """notes with space_ids as an array."""
    return notes.withColumn("space_ids", spaces.parse_space_ids(F.col("space_ids")))


def _raw_files(n: DataFrame) -> DataFrame:
    """(path, raw): rendered notes, every 17th with a header that isn't closed, every 19th without its title."""
    r = ingest.render_notes(n).join(n.select("id", "doc_id"), "id")
    raw = F.when(F.col("doc_id") % 17 == 0, F.replace("text", F.lit("\n---"), F.lit("\n--"))).when(F.col("doc_id") % 19 == 0, F.regexp_replace("text", "\ntitle: [^\n]*", "")).otherwise(F.col("text"))
    return r.select("path", raw.alias("raw"))


#: The files that the queries below parse, written once: making them is no part of any operator.
raw_files = V.kept("raw_files", lambda spark, sf_dir: _raw_files(V.notes(spark, sf_dir)))
raw_files_with_refs = V.kept("raw_files_with_refs", lambda spark, sf_dir: _raw_files(V.with_refs(spark, sf_dir)))
catalog_notes = V.once("catalog_notes", lambda spark, sf_dir: V.bucketed(with_path(V.notes(spark, sf_dir)).drop("body"), "path", 2 * spark.sparkContext.defaultParallelism))


PATH = S.path("title", "id", "created_at")
FILES = f"""
files AS (SELECT *, {PATH} AS path, regexp_replace({S.canonical('body')}, '\\n+$', '') AS parsed_body,
  CASE WHEN doc_id % 17 = 0 THEN 'header not closed' WHEN doc_id % 19 = 0 THEN 'missing title' END AS reason FROM notes)
"""


@query()
def src_markdown(spark, sf_dir):
    folder = V.scratch(spark)
    ingest.write_markdown(ingest.render_notes(V.spread(V.notes(spark, sf_dir))), folder)
    return ingest.read_markdown(spark, folder).select("path", F.length("raw").alias("n_chars"), F.sha2(F.col("raw").cast("binary"), 256).alias("sha256"))


@query(
    S.with_(
        S.NOTES,
        f"q AS (SELECT *, '---' || chr(10) || 'id: \"' || id || '\"' || chr(10) || 'title: \"' || replace(replace(title, '\\', '\\\\'), '\"', '\\\"') || '\"' || chr(10) || 'createdAt: \"' || {S.iso('created_at')} || '\"' || chr(10) || 'updatedAt: \"' || {S.iso('updated_at')} || '\"' || CASE WHEN space_ids IS NULL THEN '' ELSE chr(10) || 'spaceIds: \"' || space_ids || '\"' END || chr(10) || '---' || chr(10) || chr(10) || {S.canonical('body')} || chr(10) AS text FROM notes)",
        body=f"SELECT id, {PATH} AS path, md5(text) AS text FROM q",
    )
)
def render_notes(spark, sf_dir):
    return ingest.render_notes(V.notes(spark, sf_dir)).select("id", "path", F.md5(F.col("text").cast("binary")).alias("text"))


@query(
    S.with_(
        S.NOTES,
        FILES,
        body=f"SELECT path, CASE WHEN reason IS NULL THEN id END AS id, CASE WHEN reason IS NULL THEN title END AS title, CASE WHEN reason IS NULL THEN {S.iso('updated_at')} END AS updated_at, CASE WHEN reason IS NULL THEN coalesce(space_ids, '') END AS space_ids, CASE WHEN reason IS NULL THEN md5(parsed_body) END AS body, reason FROM files",
    )
)
def parse_notes(spark, sf_dir):
    notes, rejected = ingest.parse_notes(V.spread(raw_files(spark, sf_dir)), V.stored)
    good = notes.select("path", "id", "title", "updated_at", F.array_join("space_ids", ",").alias("space_ids"), F.md5(F.col("body").cast("binary")).alias("body"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rejected, allowMissingColumns=True)


@query()
def src_catalog_json(spark, sf_dir):
    """The catalogue written as JSON documents of some thousand notes each, one with a bad row, and read again."""
    n = with_path(V.notes(spark, sf_dir))
    record = F.struct("id", "title", F.when((F.col("doc_id") % 4000 == 777), F.lit("../up.md")).otherwise(F.col("path")).alias("path"), ingest.iso(F.col("created_at")).alias("createdAt"), ingest.iso(F.col("updated_at")).alias("updatedAt"), F.col("space_ids").alias("spaceIds"))
    docs = n.groupBy(F.floor(F.col("doc_id") / 500).alias("part")).agg(F.sort_array(F.collect_list(record)).alias("notes"))
    folder = V.scratch(spark)
    docs.select("part", F.to_json(F.struct(F.lit(1).alias("version"), "notes")).alias("value")).repartition("part").write.partitionBy("part").text(folder)
    good, bad = ingest.read_catalog(spark, f"{folder}/*/")
    return good.select("id", "path", F.lit(None).cast("string").alias("reason")).union(bad.select(F.lit(None).cast("string"), F.lit(None).cast("string"), "reason"))


@query(
    S.with_(
        S.VEC,
        """r AS (SELECT note_id, idx, vec_id, CASE WHEN vec_id % 13 = 0 THEN 'other' ELSE 'body' END AS kind, CASE WHEN vec_id % 11 = 0 THEN 63 ELSE 64 END AS dims,
           vec_id % 3 = 0 AS inline, vec_id % 29 = 0 AS none FROM vec_chunks)""",
        body="""SELECT note_id, idx, NOT none AND inline AS upgraded, CASE WHEN kind = 'other' THEN 'unknown kind' WHEN none THEN 'no vector' WHEN dims <> 64 THEN 'vector length' END AS reason FROM r""",
    )
)
def index_validate(spark, sf_dir):
    v = V.vec_chunks(spark, sf_dir)
    inline, none = F.col("vec_id") % 3 == 0, F.col("vec_id") % 29 == 0
    given = v.select(
        "note_id", "idx", F.when(F.col("vec_id") % 13 == 0, "other").otherwise("body").alias("kind"), F.lit(0).alias("offset"), F.lit(0).alias("length"), F.when(F.col("vec_id") % 11 == 0, 63).otherwise(64).alias("dimensions"),
        F.when(~inline & ~none, F.col("embedding")).alias("embedding"), F.when(inline & ~none, F.col("embedding")).alias("inline_embedding"),
    )
    return index.validate_index(given).select("note_id", "idx", "upgraded", "reason")


# index upkeep

_OLD = f"""
indexed AS (
  SELECT id, CASE WHEN doc_id % 6 = 0 THEN 'stale' ELSE {S.fingerprint('title', 'body')} END AS content_hash,
         CASE WHEN doc_id % 7 = 0 THEN 'old-model' ELSE 'hash-32' END AS model_id FROM notes WHERE doc_id % 5 <> 0),
plan AS (SELECT n.id, n.doc_id, {S.fingerprint('n.title', 'n.body')} AS content_hash, i.id IS NULL OR i.content_hash <> {S.fingerprint('n.title', 'n.body')} OR i.model_id <> 'hash-32' AS stale
  FROM notes n LEFT JOIN indexed i USING (id))
"""


def old_headers(spark, sf_dir, notes=V.notes) -> DataFrame:
    """An index that misses every 5th note, with every 6th out of date and every 7th of another model."""
    n = index.fingerprints(notes(spark, sf_dir)).filter("doc_id % 5 <> 0")
    return n.select(
        F.col("id").alias("note_id"), F.when(F.col("doc_id") % 6 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("doc_id") % 7 == 0, "old-model").otherwise("hash-32").alias("model_id"), F.lit(32).alias("dimensions"), F.lit(index.SCHEMA_VERSION).alias("schema_version"),
    )


PROFILE = index.Profile("hash-32", 32)


@query(S.with_(S.NOTES, _OLD, body="SELECT id, content_hash, stale FROM plan"))
def reindex_plan(spark, sf_dir):
    return index.plan_reindex(V.notes(spark, sf_dir), old_headers(spark, sf_dir), PROFILE)


def _note_folder(spark, sf_dir) -> tuple[str, DataFrame]:
    """A folder of the notes as files, and the hints of a first scan of it."""
    folder = V.scratch(spark)
    ingest.write_markdown(ingest.render_notes(V.spread(V.notes(spark, sf_dir))), folder)
    return folder, V.stored(ingest.scan_markdown(spark, folder, spark.createDataFrame([], ingest.HINTS), V.stored)[0].drop("was_read"))


note_folder = V.once("note_folder", _note_folder)


@query(S.with_(S.NOTES, body=f"SELECT id, CASE WHEN doc_id % 10 = 5 THEN 'as hinted' ELSE {S.fingerprint('title', S.canonical('body'))} END AS content_hash, doc_id % 10 IN (3, 7) AS was_read FROM notes"))
def scan_warm(spark, sf_dir):
    """A scan with hints of which every tenth is missing and every tenth is of an older file: only those files are read, all
    other hashes are as hinted."""
    folder, hints = note_folder(spark, sf_dir)
    last = F.col("id").substr(-1, 1)
    older = F.when(last == "7", F.col("modified") - F.expr("interval 1 minute")).otherwise(F.col("modified"))
    hints = hints.filter(last != "3").withColumns({"modified": older, "content_hash": F.when(last == "5", "as hinted").otherwise(F.col("content_hash"))})
    scanned = ingest.scan_markdown(spark, folder, hints, V.stored)[0]
    return scanned.select("id", "content_hash", "was_read")


def _old_index(spark, sf_dir) -> str:
    """The folder of an index as old_headers() describes it."""
    n, model, folder = V.spread(V.notes(spark, sf_dir)).filter("doc_id % 5 <> 0"), embedding.HashingEmbedder(32), V.scratch(spark)
    chunks = embedding.embed_chunks(chunking.plan_chunks(n), model)
    chunks = chunks.withColumn("model_id", F.when(F.col("note_id").cast("long") % 7 == 0, "old-model").otherwise(model.id))
    index_store.write_index(old_headers(spark, sf_dir), chunks, folder, 500)
    return folder


old_index = V.once("old_index", _old_index)

#: The notes after some were removed and some emptied.
_LATER = S.NOTES.replace("FROM documents)", "FROM documents WHERE doc_id % 9 <> 4)").replace("text AS body", "CASE WHEN doc_id % 11 = 3 THEN '' ELSE text END AS body")


def later_notes(spark, sf_dir) -> DataFrame:
    empty = F.col("doc_id") % 11 == 3
    return V.notes(spark, sf_dir).filter("doc_id % 9 <> 4").withColumns({c: F.when(empty, "").otherwise(F.col(c)) for c in ("title", "body")})


@query(
    S.with_(
        S.NOTES.replace("notes AS", "known AS"),
        _LATER.replace("notes AS", "later AS"),
        "notes AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 3 THEN '' ELSE title END AS title) FROM later)",
        S.CHUNKS,
        f"indexed AS (SELECT id, CASE WHEN doc_id % 6 = 0 THEN 'stale' ELSE {S.fingerprint('title', 'body')} END AS content_hash, doc_id % 7 = 0 AS old FROM known WHERE doc_id % 5 <> 0)",
        f"plan AS (SELECT n.id, {S.fingerprint('n.title', 'n.body')} AS content_hash, i.id IS NULL OR i.content_hash <> {S.fingerprint('n.title', 'n.body')} OR old AS stale FROM notes n LEFT JOIN indexed i USING (id))",
        "per AS (SELECT note_id, count(*) AS n_chunks FROM chunks GROUP BY note_id)",
        body="SELECT id AS note_id, content_hash, 'hash-32' AS model_id, stale AS embedded, coalesce(n_chunks, 0) AS n_chunks FROM plan LEFT JOIN per ON note_id = id",
    )
)
def reindex_incremental(spark, sf_dir):
    """An index that is written over: notes were removed, emptied, added and changed, and only their buckets are written; it is
    read again, one row a note."""
    folder, model = V.scratch(spark), embedding.HashingEmbedder(32)
    index_store.branch(spark, old_index(spark, sf_dir), folder)
    later = later_notes(spark, sf_dir)
    plan = index.reindex_stored(later, folder, model, V.stored, V.spread(later))[0]
    headers, chunks = index_store.read_stored(spark, folder)
    per = chunks.filter(F.col("model_id") == model.id).groupBy("note_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    flags = plan.select(F.col("id").alias("note_id"), F.col("stale").alias("embedded"))
    return headers.join(flags, "note_id", "left").join(per, "note_id", "left").select("note_id", "content_hash", "model_id", "embedded", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query(S.with_(S.NOTES, body="SELECT id AS note_id, doc_id % 9 = 4 AS dropped FROM notes WHERE doc_id % 5 <> 0"))
def prune_orphans(spark, sf_dir):
    live = V.notes(spark, sf_dir).filter("doc_id % 9 <> 4").select("id")
    kept, dropped = index.prune_orphans(old_headers(spark, sf_dir), live)
    return kept.select("note_id", F.lit(False).alias("dropped")).union(dropped.select("note_id", F.lit(True)))


@query(S.with_(S.NOTES, body="SELECT id AS note_id FROM notes WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0"))
def index_model_change(spark, sf_dir):
    return index.ensure_manifest(old_headers(spark, sf_dir), PROFILE).select("note_id")


@query(
    S.with_(
        S.NOTES.replace("text AS body", "text || chr(10) || '![i](attachments/' || sha256(text) || '.png)' AS body"),
        _OLD,
        "live AS (SELECT * FROM plan WHERE doc_id % 9 <> 4)",
        "blob AS (SELECT DISTINCT sha256(text) AS h FROM documents)",
        "used AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 9 <> 4)",
        S.CHUNKS,
        body="SELECT (SELECT count(*) FROM notes WHERE doc_id % 5 <> 0 AND doc_id % 9 = 4) AS n_pruned, (SELECT count(*) FROM live WHERE stale) AS n_embedded, (SELECT count(*) FROM live WHERE NOT stale) AS n_skipped, (SELECT count(*) FROM blob WHERE h NOT IN (SELECT h FROM used)) AS n_orphans, (SELECT count(*) FROM live) AS n_headers, (SELECT count(*) FROM chunks JOIN live ON note_id = live.id) AS n_chunks",
    )
)
def full_reindex_report(spark, sf_dir):
    """A whole pass over an index of four fifths of the notes: pruned, embedded, swept and counted."""
    n, model = V.with_refs(spark, sf_dir), embedding.HashingEmbedder(32)
    dealt, live = V.spread(n), "doc_id % 9 <> 4"
    attached = attachments.extract_refs(n).select("path").distinct()
    old = embedding.embed_chunks(chunking.plan_chunks(dealt.filter("doc_id % 5 <> 0")), model).withColumn("model_id", F.lit(model.id))
    return index.full_reindex(n.filter(live), V.stored(old_headers(spark, sf_dir, V.with_refs)), old, attached, model, V.stored, dealt.filter(live))[3]


# catalogue

_VERSIONS = """
versions AS (
  SELECT id, title, created_at, space_ids, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z') AS updated_at, 'b/' || id AS path FROM notes
  UNION ALL SELECT id, title || ' old', created_at, space_ids, strftime(updated_at - to_days(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END), '%Y-%m-%dT%H:%M:%S.000Z'), 'a/' || id FROM notes WHERE doc_id % 3 = 0)
"""


def versions(spark, sf_dir) -> DataFrame:
    """Notes as text-dated records, every third with a second file: older, or as old with an earlier path."""
    n = V.notes(spark, sf_dir)
    one = n.select("id", "title", "created_at", "space_ids", ingest.iso(F.col("updated_at")).alias("updated_at"), F.concat(F.lit("b/"), "id").alias("path"))
    older = F.col("updated_at") - F.when(F.col("doc_id") % 2 == 0, F.expr("interval 0 days")).otherwise(F.expr("interval 1 days"))
    return one.union(n.filter("doc_id % 3 = 0").select("id", F.concat("title", F.lit(" old")), "created_at", "space_ids", ingest.iso(older), F.concat(F.lit("a/"), "id")))


@query(S.with_(S.NOTES, _VERSIONS, "o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, path) AS n FROM versions)", body="SELECT id, title, updated_at, path FROM o WHERE n = 1"))
def dedupe_notes(spark, sf_dir):
    return catalog.dedupe_by_id(versions(spark, sf_dir)).select("id", "title", "updated_at", "path")


@query("SELECT count_if(doc_id % 5 = 0) AS n_added, count_if(doc_id % 7 = 0) AS n_removed, count_if(doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS n_common FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def reconcile_diff(spark, sf_dir):
    n = V.notes(spark, sf_dir)
    return catalog.reconcile_diff(n.filter("doc_id % 5 <> 0"), n.filter("doc_id % 7 <> 0"))


@query("SELECT 'same' AS pair, count_if(NOT true) > 0 AS changed FROM documents UNION ALL SELECT 'edited', count_if(doc_id % 10 = 3) > 0 FROM documents UNION ALL SELECT 'shorter', count_if(NOT doc_id % 10 <> 3) > 0 FROM documents UNION ALL SELECT 'no prior', true")
def snapshot_changed(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("id", "doc_id", "title", "space_ids")
    edited = n.withColumn("title", F.when(F.col("doc_id") % 10 == 3, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    pairs = [("same", n, V.spread(n)), ("edited", n, edited), ("shorter", n, n.filter("doc_id % 10 <> 3")), ("no prior", None, n)]
    return spark.createDataFrame([(name, catalog.snapshot_changed(a, b)) for name, a, b in pairs], "pair string, changed boolean")


_RECONCILED = f"""
kept AS (SELECT id, title, path, {S.iso('updated_at')} AS updated_at, 'file' AS origin FROM files WHERE reason IS NULL
  UNION ALL SELECT id, 'prior', path, '2023', 'prior' FROM files WHERE reason IS NOT NULL AND doc_id % 2 = 0)
"""


@query(S.with_(S.NOTES, FILES, _RECONCILED, body="SELECT id, title, path, updated_at, NULL AS reason FROM kept UNION ALL SELECT NULL, NULL, path, NULL, reason FROM files WHERE reason IS NOT NULL AND doc_id % 2 <> 0"))
def reconcile(spark, sf_dir):
    """The catalogue after reconciling; its snapshot is written where it changed, and read again."""
    kept, skipped, prior = reconciled(spark, sf_dir)
    folder = V.scratch(spark)
    kept = V.stored(kept)
    if ingest.write_catalog(kept, folder, catalog.snapshot_changed(prior, kept)):
        kept = spark.read.schema(kept.schema).parquet(folder)
    none = F.lit(None).cast("string")
    return kept.select("id", "title", "path", "updated_at", none.alias("reason")).union(skipped.select(none, none, "path", none, "reason"))


def reconciled(spark, sf_dir):
    parsed, rejected = ingest.parse_notes(V.spread(raw_files(spark, sf_dir)), V.stored)
    prior = catalog_notes(spark, sf_dir).filter("doc_id % 2 = 0").select("id", F.lit("prior").alias("title"), "path", F.lit("2022").alias("created_at"), F.lit("2023").alias("updated_at"), spaces.parse_space_ids(F.col("space_ids")).alias("space_ids"))
    return *catalog.reconcile(parsed, rejected, prior), prior


@query(S.with_(S.NOTES, FILES, _RECONCILED, body="SELECT count_if(doc_id % 2 <> 0 AND reason IS NULL) AS n_added, 0 AS n_removed, count_if(doc_id % 2 = 0 AND reason IS NULL) AS n_changed, count_if(reason IS NOT NULL AND doc_id % 2 <> 0) AS n_skipped FROM files"))
def reconcile_report(spark, sf_dir):
    kept, skipped, prior = reconciled(spark, sf_dir)
    return catalog.reconcile_report(prior, kept, skipped)


@query(
    S.with_(
        S.NOTES,
        FILES,
        "good AS (SELECT * FROM files WHERE reason IS NULL)",
        "ids AS (SELECT DISTINCT unnest(string_split(space_ids, ',')) AS s FROM good WHERE space_ids IS NOT NULL)",
        body="SELECT (SELECT count(*) FROM good) AS n_notes, 0 AS n_duplicates, (SELECT count(*) FROM files WHERE reason IS NOT NULL) AS n_skipped, (SELECT count(*) FROM ids) AS n_spaces, (SELECT count(DISTINCT sha256(body)) FROM good) AS n_paths, (SELECT count(*) FROM good) AS n_refs",
    )
)
def rebuild_catalog(spark, sf_dir):
    parsed, rejected = ingest.parse_notes(V.spread(raw_files_with_refs(spark, sf_dir)), V.stored)
    return catalog.rebuild_catalog(parsed, rejected)["report"]


@query(
    S.with_(
        S.NOTES,
        f"r AS (SELECT id, doc_id, {PATH} AS p FROM notes)",
        body="""SELECT id, CASE WHEN doc_id % 4 = 1 THEN 'title is missing' WHEN doc_id % 10 IN (2, 3, 6, 7) THEN 'path is not safe' ELSE '' END AS reasons FROM r""",
    )
)
def catalog_validate(spark, sf_dir):
    n = with_path(V.notes(spark, sf_dir))
    wrong = F.when(F.col("doc_id") % 4 == 1, F.col("path")).when(F.col("doc_id") % 10 == 2, F.lit("/etc/x.md")).when(F.col("doc_id") % 10 == 3, F.lit("notes/../x.md")).when(F.col("doc_id") % 10 == 6, F.lit("c:x.md")).when(F.col("doc_id") % 10 == 7, F.lit("a\\b.md")).otherwise(F.col("path"))
    given = n.select("id", F.when(F.col("doc_id") % 4 != 1, F.col("title")).alias("title"), wrong.alias("path"), ingest.iso(F.col("created_at")).alias("createdAt"), ingest.iso(F.col("updated_at")).alias("updatedAt"))
    return given.select("id", F.array_join(ingest.catalog_reasons(), "; ").alias("reasons"))


_CHANGED = f"""
after AS (
  SELECT id, CASE WHEN doc_id % 10 = 1 THEN 'New title' ELSE title END AS title, {PATH} AS path, space_ids,
         CASE WHEN doc_id % 10 = 1 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM notes WHERE doc_id % 10 <> 2
  UNION ALL
  SELECT 'copy-' || id, title || ' (copy)', {S.path("title || ' (copy)'", "'copy-' || id", f"TIMESTAMP '{NOW}'")}, space_ids, TIMESTAMP '{NOW}' FROM notes WHERE doc_id % 10 = 3
  UNION ALL
  SELECT 'new-' || id, 'Made', {S.path("'Made'", "'new-' || id", f"TIMESTAMP '{NOW}'")}, NULL, TIMESTAMP '{NOW}' FROM notes WHERE doc_id % 10 = 4)
"""


@query(S.with_(S.NOTES, _CHANGED, body=f"SELECT id, title, path, coalesce(space_ids, '') AS space_ids, {S.text_time('updated_at')} AS updated_at, false AS unknown FROM after UNION ALL SELECT 'none-' || id, NULL, NULL, NULL, NULL, true FROM notes WHERE doc_id % 100 = 5"))
def apply_changes(spark, sf_dir):
    n = listed(with_path(V.notes(spark, sf_dir)))
    empty = F.lit(None).cast("string")
    change = lambda rest, op, id_, new_id, title, body: n.filter(f"doc_id % {rest[1]} = {rest[0]}").select(F.lit(op).alias("op"), id_.alias("id"), new_id.alias("new_id"), title.alias("title"), body.alias("body"), F.lit(None).cast("array<string>").alias("space_ids"))
    own, named = F.col("id"), lambda p: F.concat(F.lit(p), "id")
    changes = change((1, 10), "update", own, empty, F.lit("New title"), empty)
    for c in (change((2, 10), "delete", own, empty, empty, empty), change((3, 10), "duplicate", own, named("copy-"), empty, empty), change((4, 10), "create", own, named("new-"), F.lit("Made"), F.lit("text")), change((5, 100), "update", named("none-"), empty, F.lit("x"), empty), change((6, 100), "delete", named("none-"), empty, empty, empty)):
        changes = changes.unionByName(c)
    after, unknown = catalog.apply_changes(n.drop("doc_id"), changes, now())
    out = after.select("id", "title", "path", F.coalesce(F.array_join("space_ids", ","), F.lit("")).alias("space_ids"), stamp("updated_at").alias("updated_at"), F.lit(False).alias("unknown"))
    return out.union(unknown.select("id", empty, empty, empty, empty, F.lit(True)))


@query(S.with_(S.NOTES, body=f"SELECT id, title, {S.text_time('updated_at')} AS updated_at, row_number() OVER (ORDER BY notes.updated_at DESC, id) <= 8 AS newest FROM notes"))
def notes_by_recency(spark, sf_dir):
    n = V.notes(spark, sf_dir).select("id", "title", "updated_at")
    newest = catalog.by_recency(n).limit(8).select("id", F.lit(True).alias("newest"))
    return catalog.by_recency(n.join(F.broadcast(newest), "id", "left")).select("id", "title", stamp("updated_at").alias("updated_at"), F.coalesce("newest", F.lit(False)).alias("newest"))


@query(S.with_(S.NOTES, body=f"SELECT id, title, {S.text_time('updated_at')} AS updated_at FROM notes ORDER BY notes.updated_at DESC, id LIMIT 1"))
def most_recent(spark, sf_dir):
    return catalog.most_recent(V.notes(spark, sf_dir)).select("id", "title", stamp("updated_at").alias("updated_at"))


@query(S.with_(S.NOTES, "w AS (SELECT lpad((item_id * 37)::VARCHAR, 12, '0') AS id FROM benchmark)", body="SELECT w.id, title, n.id IS NULL AS missing FROM w LEFT JOIN notes n USING (id)"))
def notes_lookup(spark, sf_dir):
    wanted = V.read(spark, sf_dir, "benchmark").select(F.lpad((F.col("item_id") * 37).cast("string"), 12, "0").alias("id"))
    return catalog.lookup(V.notes(spark, sf_dir).select("id", "title"), wanted)


# spaces


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN source || ',' || lang ELSE source END AS ids, CASE doc_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN NULL WHEN 2 THEN source || ',' || lang ELSE source END AS csv FROM documents")
def space_ids_parse(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 4 == 0, F.lit(" a , b,a,,x y")).when(F.col("doc_id") % 4 == 1, F.lit("general, ,")).when(F.col("doc_id") % 4 == 2, F.concat("source", F.lit(" , general ,"), "lang")).otherwise(F.concat_ws(",", "source", "source"))
    ids = spaces.parse_space_ids(raw)
    return d.select("doc_id", F.array_join(ids, ",").alias("ids"), spaces.serialize_space_ids(ids).alias("csv"))


@query(S.with_(S.NOTES, body="SELECT 'general' AS space, id FROM notes WHERE space_ids IS NULL UNION ALL SELECT 'de', id FROM notes WHERE space_ids IS NOT NULL AND lang = 'de'"))
def notes_in_space(spark, sf_dir):
    n = listed(V.notes(spark, sf_dir))
    general, german = (spaces.notes_in_space(n, s).select(F.lit(s).alias("space"), "id") for s in ("general", "de"))
    return general.union(german)


@query(S.with_(S.NOTES, S.SPACES, "u AS (SELECT unnest(string_split(space_ids, ',')) AS id FROM notes WHERE space_ids IS NOT NULL)", "c AS (SELECT id, count(*) AS n FROM u GROUP BY id)", body="SELECT s.id, name, coalesce(n, 0) AS n_notes FROM spaces s LEFT JOIN c USING (id) UNION ALL SELECT 'general', 'General', count(*) FROM notes WHERE space_ids IS NULL"))
def space_counts(spark, sf_dir):
    return spaces.space_counts(V.spaces(spark, sf_dir), listed(V.notes(spark, sf_dir)))


@query(S.with_(S.NOTES, S.SPACES, S.SPACE_NAMES.replace("LEFT JOIN spaces s ON", "LEFT JOIN (SELECT * FROM spaces WHERE id <> 'src3') s ON"), body="SELECT id, array_to_string(space_names, '|') AS names FROM resolved"))
def space_resolve(spark, sf_dir):
    known = V.spaces(spark, sf_dir).filter("id <> 'src3'")
    return spaces.resolve_spaces(listed(V.notes(spark, sf_dir)), known).select("id", F.array_join("space_names", "|").alias("names"))


@query(
    S.with_(
        S.NOTES,
        f"t AS (SELECT *, space_ids IS NOT NULL AND (lang = 'fr' OR source = 'src2') AS touched FROM notes)",
        body=f"SELECT id, CASE WHEN space_ids IS NULL THEN '' ELSE concat_ws(',', CASE WHEN lang <> 'fr' THEN lang END, CASE WHEN source <> 'src2' THEN source END) END AS space_ids, touched, CASE WHEN touched THEN '{NOW}' ELSE {S.text_time('updated_at')} END AS updated_at FROM t",
    )
)
def space_delete(spark, sf_dir):
    n, _ = spaces.delete_spaces(listed(V.notes(spark, sf_dir)), V.spaces(spark, sf_dir), ["fr", "src2", "general"], now())
    return n.select("id", F.array_join("space_ids", ",").alias("space_ids"), "touched", stamp("updated_at").alias("updated_at"))


_DRAFTS = """
drafts AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'General' WHEN 2 THEN lower(source) ELSE source || ' ' || doc_id END AS name,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END AS description, CASE WHEN doc_id % 8 = 3 THEN 'pink' ELSE 'blue' END AS color_id FROM documents)
"""


@query(
    S.with_(
        _DRAFTS,
        "c AS (SELECT id, CASE WHEN name = '' THEN 'Untitled' ELSE name END AS name, nullif(description, '') AS description, color_id FROM drafts)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS place FROM c)",
        body="SELECT id, name, description, color_id, CASE WHEN lower(name) = 'general' THEN 'reserved name' WHEN place > 1 THEN 'duplicate name' WHEN color_id = 'pink' THEN 'unknown colour' END AS reason FROM p",
    )
)
def space_validate(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).when(F.col("doc_id") % 5 == 1, F.lit(" General")).when(F.col("doc_id") % 5 == 2, F.lower("source")).otherwise(F.concat_ws(" ", "source", F.col("doc_id").cast("string")))
    drafts = d.select(F.col("doc_id").alias("id"), name.alias("name"), F.when(F.col("doc_id") % 6 == 0, F.lit(" ")).otherwise(F.col("lang")).alias("description"), F.when(F.col("doc_id") % 8 == 3, "pink").otherwise("blue").alias("color_id"))
    return spaces.validate_spaces(drafts)


@query(
    S.with_(
        S.NOTES,
        f"u AS (SELECT unnest(string_split(space_ids, ',')) AS id, {PATH} AS path, updated_at FROM notes WHERE space_ids IS NOT NULL)",
        "f AS (SELECT id, arg_min(updated_at, path) AS updated_at, row_number() OVER (ORDER BY id) AS n FROM u GROUP BY id)",
        body=f"SELECT id, 'Recovered space ' || n AS name, list_extract(['blue', 'green', 'amber', 'red', 'purple'], ((n - 1) % 5 + 1)::INT) AS color_id, {S.text_time('updated_at')} AS updated_at FROM f",
    )
)
def space_recover(spark, sf_dir):
    return spaces.recover_spaces(listed(with_path(V.notes(spark, sf_dir)))).withColumn("updated_at", stamp("updated_at"))


@query(
    S.with_(
        S.NOTES,
        S.SPACES,
        "asked AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'source 1' WHEN 1 THEN 'deutsch' WHEN 2 THEN 'general' ELSE 'brand new' END AS q, lpad((item_id * 3)::VARCHAR, 12, '0') AS note_id FROM benchmark)",
        "assigned AS (SELECT id AS note_id, unnest(string_split(space_ids, ',')) AS space_id FROM notes WHERE space_ids IS NOT NULL)",
        body="""SELECT qid, 'space' AS kind, s.id, s.name FROM asked a JOIN spaces s ON contains(lower(s.name), q) WHERE NOT EXISTS (SELECT 1 FROM assigned x WHERE x.note_id = a.note_id AND x.space_id = s.id)
             UNION ALL SELECT qid, 'create', NULL, CASE WHEN q = 'brand new' THEN 'Brand new' ELSE q END FROM asked WHERE q <> 'general' AND q NOT IN (SELECT lower(name) FROM spaces)""",
    )
)
def space_suggest(spark, sf_dir):
    kind = F.col("item_id") % 4
    q = F.when(kind == 0, "source 1").when(kind == 1, " Deutsch").when(kind == 2, "General").otherwise("Brand new ")
    asked = V.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), q.alias("q"), F.lpad((F.col("item_id") * 3).cast("string"), 12, "0").alias("note_id"))
    assigned = listed(V.notes(spark, sf_dir)).select(F.col("id").alias("note_id"), F.explode("space_ids").alias("space_id"))
    return spaces.space_suggestions(asked, V.spaces(spark, sf_dir), assigned)


# attachments

_REFS = "refs AS (SELECT DISTINCT 'attachments/' || sha256(text) || '.png' AS path, lpad(doc_id::VARCHAR, 12, '0') AS note_id, doc_id FROM documents)"


@query(S.with_(_REFS, body="SELECT path, note_id FROM refs"))
def attachment_refs(spark, sf_dir):
    unsafe = F.concat("body", F.lit(" ![x](attachments/../y.png) ![z](attachments//z.png)"))
    return attachments.extract_refs(V.with_refs(spark, sf_dir).withColumn("body", unsafe))


@query(S.with_(_REFS, body="SELECT path, count(*) AS n_notes, min(note_id) AS first_note FROM refs GROUP BY path"))
def attachment_index(spark, sf_dir):
    return attachments.build_refs(V.with_refs(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n_notes"), F.min("note_id").alias("first_note"))


@query(
    S.with_(
        _REFS,
        "after AS (SELECT path, note_id FROM refs WHERE doc_id % 4 <> 0 UNION SELECT 'attachments/new.png', note_id FROM refs WHERE doc_id % 4 = 0)",
        body="SELECT path, note_id, false AS emptied FROM after UNION ALL SELECT DISTINCT path, NULL, true FROM refs WHERE doc_id % 4 = 0 AND path NOT IN (SELECT path FROM after)",
    )
)
def attachment_sync(spark, sf_dir):
    n = V.with_refs(spark, sf_dir)
    edits = n.filter("doc_id % 4 = 0").select(F.col("id").alias("note_id"), F.col("body").alias("old_body"), F.lit("now ![n](attachments/new.png)").alias("new_body"))
    after, emptied = attachments.sync_refs(attachments.build_refs(n), edits)
    return after.select("path", "note_id", F.lit(False).alias("emptied")).union(emptied.select("path", F.lit(None).cast("string"), F.lit(True)))


@query(S.with_(_REFS, body="SELECT path, note_id, false AS emptied FROM refs WHERE doc_id % 4 <> 0 UNION ALL SELECT DISTINCT path, NULL, true FROM refs WHERE doc_id % 4 = 0 AND path NOT IN (SELECT path FROM refs WHERE doc_id % 4 <> 0)"))
def attachment_drop(spark, sf_dir):
    n = V.with_refs(spark, sf_dir)
    after, emptied = attachments.drop_refs(attachments.build_refs(n), n.filter("doc_id % 4 = 0").select(F.col("id").alias("note_id")))
    return after.select("path", "note_id", F.lit(False).alias("emptied")).union(emptied.select("path", F.lit(None).cast("string"), F.lit(True)))


@query(S.with_(_REFS, body="SELECT DISTINCT path FROM refs WHERE path NOT IN (SELECT path FROM refs WHERE doc_id % 3 <> 0)"))
def attachment_orphans(spark, sf_dir):
    n = V.with_refs(spark, sf_dir)
    stored = attachments.extract_refs(n).select("path").distinct()
    return attachments.orphan_attachments(stored, n.filter("doc_id % 3 <> 0"))


@query(S.with_(_REFS, "orphan AS (SELECT DISTINCT path FROM refs WHERE path NOT IN (SELECT path FROM refs WHERE doc_id % 3 <> 0))", body="SELECT path, note_id FROM refs WHERE path NOT IN (SELECT path FROM orphan)"))
def attachment_sweep(spark, sf_dir):
    """The reference rows that are left when every third note is gone and what only these referred to is swept."""
    n = V.with_refs(spark, sf_dir)
    refs = attachments.build_refs(n)
    return attachments.sweep(refs.select("path").distinct(), refs, n.filter("doc_id % 3 <> 0"))[1]


_BLOB = "blob AS (SELECT doc_id, list_extract(['image/png', 'image/jpeg', 'image/gif', 'image/webp', 'image/bmp'], (doc_id % 5 + 1)::INT) AS mime, list_extract(['png', 'jpg', 'gif', 'webp', NULL], (doc_id % 5 + 1)::INT) AS ext, text FROM documents)"


@query(S.with_(_BLOB, body="SELECT 'attachments/' || sha256(text) || '.' || ext AS path, sha256(text) AS sha256, ext, count(*) AS n_copies FROM blob WHERE ext IS NOT NULL GROUP BY ALL"))
def attachment_dedupe(spark, sf_dir):
    return attachments.store_attachments(V.blobs(spark, sf_dir))


@query(S.with_(_BLOB, body="SELECT doc_id, ext, octet_length(text::BLOB) AS size, CASE WHEN ext IS NULL THEN 'type not allowed' WHEN octet_length(text::BLOB) > 10485760 THEN 'too large' END AS reason FROM blob".replace("octet_length(text::BLOB)", "strlen(text)")))
def attachment_policy(spark, sf_dir):
    return attachments.with_policy(V.blobs(spark, sf_dir)).select("doc_id", "ext", F.col("size").cast("long").alias("size"), "reason")


@query(
    "WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<img[^>]*\\ssrc=[\"'']data:image/(png|jpeg|gif|webp);base64,') AS own FROM pages) SELECT page_id, len(own)::INT AS n, 'image/png' AS mime, url FROM h WHERE len(own) = 0"
)
def inline_images(spark, sf_dir):
    """Pages with two images put in: the page's URL as a PNG, and one of a type that isn't allowed."""
    image = lambda mime: F.concat(F.lit(f'<img class="x" src="data:{mime};base64,'), F.base64(F.col("url").cast("binary")), F.lit('">'))
    pages = V.read(spark, sf_dir, "pages").withColumn("html", F.concat("html", image("image/bmp"), image("image/png")))
    return attachments.harvest_inline_images(pages).select("page_id", "n", "mime", F.col("content").cast("string").alias("url"))


# streams, evaluation, generation


def edits(spark, sf_dir) -> DataFrame:
    return V.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")


@query(
    """WITH e AS (SELECT user_id AS key, ts, event_id, event_type, value FROM events),
g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM e),
b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, event_id) AS burst FROM g)
SELECT key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS burst_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n_edits,
       arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, round(arg_max(value, {'t': ts, 'e': event_id}), 6) AS value FROM b GROUP BY key, burst"""
)
def debounce_events(spark, sf_dir):
    out = streams.debounce(edits(spark, sf_dir), "key", "ts", "30 minutes", tie="event_id")
    return out.select("key", stamp("burst_start").alias("burst_start"), stamp("last_ts").alias("last_ts"), "n_edits", F.col("payload.event_type").alias("event_type"), F.round("payload.value", 6).alias("value"))


@query("SELECT DISTINCT user_id AS key, event_type FROM events")
def first_occurrence(spark, sf_dir):
    return streams.first_occurrence(edits(spark, sf_dir), ["key", "event_type"]).select("key", "event_type")


_STREAMED = S.NOTES.replace("FROM documents)", "FROM documents WHERE doc_id % 13 <> 5)").replace("text AS body", "CASE WHEN doc_id % 11 = 3 THEN '' ELSE text END AS body")


@query(
    S.with_(
        _STREAMED.replace("notes AS", "saved AS"),
        "notes AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 3 THEN '' ELSE title END AS title) FROM saved)",
        S.NOTE_POSTINGS,
        "t AS (SELECT count(*) AS n FROM notes WHERE trim(title) <> '' OR trim(body) <> '')",
        body="SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, any_value(t.n) AS n_docs FROM postings, t GROUP BY term",
    )
)
def stream_reindex(spark, sf_dir):
    """Saves streamed from files in several micro-batches: every third note is saved twice, some are emptied and some deleted
    later. The numbers of notes are those kept up by the stream, the occurrences those of its postings."""
    folder, where, state = V.scratch(spark), V.scratch(spark), V.scratch(spark)
    saved = V.notes(spark, sf_dir).select("id", "title", "body", "updated_at", "doc_id")
    # a note's saves are made from one row, so that documents are read and titles cut once
    kinds = F.array(F.lit("saved"), F.when(F.expr("doc_id % 3 = 0"), "earlier"), F.when(F.expr("doc_id % 11 = 3"), "emptied"), F.when(F.expr("doc_id % 13 = 5"), "deleted"))
    edits = saved.withColumn("kind", F.explode(F.array_compact(kinds)))
    is_ = lambda kind: F.col("kind") == kind
    title = F.when(is_("earlier"), "draft").when(is_("emptied"), " ").otherwise(F.col("title"))
    body = F.when(is_("earlier"), F.concat(F.lit("old words of "), "id")).when(is_("emptied"), "").otherwise(F.col("body"))
    hours = F.when(is_("earlier"), -1).when(is_("emptied"), 1).when(is_("deleted"), 2).otherwise(0)
    edits = edits.select("id", title.alias("title"), body.alias("body"), (F.col("updated_at") + F.make_dt_interval(hours=hours)).alias("updated_at"), is_("deleted").alias("deleted"))
    files = V.read(spark, sf_dir, "documents").rdd.getNumPartitions()  # of a micro-batch: a file's size doesn't grow with the table
    edits.repartition(5 * files, "id", "title", "deleted").write.option("compression", "zstd").parquet(folder)
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", files).parquet(folder)
    streams.stream_reindex(stream, streams.index_batch(where, embedding.HashingEmbedder(32)), state).awaitTermination()
    live = streams.live_index(spark, where)
    tf = live["postings"].groupBy("term").agg(F.sum("tf").alias("tf"))
    return live["df"].join(tf, "term", "full_outer").join(F.broadcast(live["n_docs"])).select("term", "df", "tf", F.col("n").alias("n_docs"))  # one row


@query(
    """WITH q AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, ts + to_seconds((event_id * 7919 % 20000)::INT) AS due, event_id FROM events),
n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY number) AS next FROM q)
SELECT user_id AS session, number, strftime(due, '%Y-%m-%d %H:%M:%S') AS "at", event_id::VARCHAR AS payload FROM n WHERE next IS NULL OR next > due"""
)
def fresh_answers(spark, sf_dir):
    """Events as queries, each answered after a while, streamed in the order of arrival: an answer to a query that was
    replaced before it came is dropped."""
    from pyspark.sql import Window

    e = V.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    q = e.withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    asked = q.select(F.col("user_id").alias("session"), F.lit("query").alias("kind"), "number", F.col("ts").alias("at"), F.lit("").alias("payload"))
    wait = F.make_dt_interval(secs=F.col("event_id") * 7919 % 20000)
    answered = q.select(F.col("user_id").alias("session"), F.lit("answer").alias("kind"), "number", (F.col("ts") + wait).alias("at"), F.col("event_id").cast("string").alias("payload"))
    folder, out, state = V.scratch(spark), V.scratch(spark), V.scratch(spark)
    rows = V.stored(asked.union(answered))
    bounds = rows.select(F.min("at").alias("a"), F.max("at").alias("b")).first()
    steps = 3
    width = (bounds["b"] - bounds["a"]) / steps
    # in the order of arrival: the files of a step are written by many tasks and read as one micro-batch
    for k in range(steps):
        low, high = bounds["a"] + width * k, bounds["a"] + width * (k + 1)
        some = rows.filter((F.col("at") >= low) & ((F.col("at") < high) if k + 1 < steps else F.lit(True)))
        some.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        shown = streams.fresh_answers(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        shown.awaitTermination()
    return spark.read.parquet(out).select("session", "number", stamp("at").alias("at"), "payload")


_CASES = """
ranked AS (SELECT doc_id // 10 AS case_id, 'd' || doc_id AS key, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id * 7919 % 1000003, doc_id) AS rank FROM documents WHERE doc_id % 10 < 8),
cases AS (SELECT DISTINCT doc_id // 10 AS c FROM documents WHERE doc_id % 10 = 0),
r AS (SELECT c, (SELECT rank FROM ranked WHERE case_id = c AND key = 'd' || (c * 10)) AS r0, (SELECT rank FROM ranked WHERE case_id = c AND key = 'd' || (c * 10 + 1)) AS r1, (SELECT rank FROM ranked WHERE case_id = c AND key = 'd' || (c * 10 + 2)) AS r2, (SELECT count(*) FROM ranked WHERE case_id = c) AS n FROM cases)
"""


@query(
    S.with_(
        _CASES,
        body="""SELECT c AS case_id, 'first' AS check, coalesce(r0 = 1, false) AS passed FROM r UNION ALL SELECT c, 'expected_top', coalesce(r0 <= 3, false) AND coalesce(r1 <= 3, false) FROM r
             UNION ALL SELECT c, 'expected_all', r2 IS NOT NULL AND false FROM r UNION ALL SELECT c, 'ranked_below', r2 IS NULL OR r2 > greatest(coalesce(r0, 1073741824), coalesce(r1, 1073741824)) FROM r
             UNION ALL SELECT c, 'excluded', true FROM r UNION ALL SELECT c, 'max_results', n <= 7 FROM r""",
    )
)
def evaluate_rankings(spark, sf_dir):
    from pyspark.sql import Window

    d = V.read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("case_id"))
    order = Window.partitionBy("case_id").orderBy(F.col("doc_id") * 7919 % 1000003, "doc_id")
    rankings = d.filter("doc_id % 10 < 8").select("case_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.row_number().over(order).alias("rank"))
    key = lambda n: F.concat(F.lit("d"), (F.col("doc_id") + n).cast("string"))
    cases = d.filter("doc_id % 10 = 0").select("case_id", key(0).alias("first"), F.array(key(0), key(1)).alias("expected_top"), F.array(key(2), key(9)).alias("expected_all"), F.array(key(2)).alias("ranked_below"), F.array(key(8), key(9)).alias("excluded"), F.lit(7).alias("max_results"))
    return evaluate.evaluate(rankings, cases)


def _mulberry_sql() -> str:
    """The same draws in SQL, whose wide integers need no halves."""
    words = "[" + ", ".join(f"'{w}'" for w in generate.WORDS) + "]"
    step = lambda x, n: f"xor({x}, {x} >> {n})"
    return f"""
WITH n AS (SELECT doc_id AS i FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT i, unnest(range(0, 97)) AS k FROM n),
a AS (SELECT i, k, ((1 + (i * 97 + 1 + k)::HUGEINT * 1831565813) % 4294967296)::BIGINT AS a FROM d),
b AS (SELECT i, k, (({step('a', 15)}::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM a),
c AS (SELECT i, k, xor(((t + ({step('t', 7)}::HUGEINT * (t | 61)) % 4294967296) % 4294967296)::BIGINT, t) AS t FROM b),
w AS (SELECT i, k, list_extract({words}, floor({step('t', 14)}::DOUBLE * {len(generate.WORDS)} / 4294967296.0)::INT + 1) AS w FROM c)
SELECT 'note-' || lpad(i::VARCHAR, 6, '0') AS id, 'Note ' || i || ' ' || any_value(w) FILTER (k = 0) AS title,
       md5(string_agg(CASE WHEN k > 1 AND (k - 1) % 12 = 0 THEN w || ' .' || chr(10) ELSE w END, ' ' ORDER BY k) FILTER (k > 0)) AS body
FROM w GROUP BY i"""


@query(_mulberry_sql())
def generate_corpus(spark, sf_dir):
    """One synthetic note for each document's number."""
    rows = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")).filter("i is not null")
    out = generate.generate_corpus(spark, V.spread(rows), chunks=1, seed=1)
    return out.select("id", "title", F.md5(F.col("body").cast("binary")).alias("body"))
