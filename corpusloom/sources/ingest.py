"""Reading and writing notes, catalogues and indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import canonical_body, is_safe_relative_path, note_path, quote, trim_white, unquote
from corpusloom.operators.index import validate_index
from corpusloom.operators.spaces import COLORS, parse_space_ids, serialize_space_ids

FIELDS = ("id", "title", "createdAt", "updatedAt", "spaceIds")
REQUIRED = FIELDS[:4]
NOTE_RECORD = "id string, title string, path string, createdAt string, updatedAt string, spaceIds string"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw) of every Markdown file below folder; a missing folder gives no rows."""
    files = _listed(spark, folder, missing_ok=True)
    return _contents(spark, folder, files, files.count())


#: Files that a task opens, and bytes of them that are sent on at once.
TASK_FILES, BATCH_BYTES = 4000, 8 << 20


def _shown(name: str) -> bool:
    """Whether Spark's own readers see a file or folder of this name."""
    return not (name.startswith((".", "_")) or name.endswith("._COPYING_"))


def _listed(spark: SparkSession, folder: str, missing_ok: bool = False) -> DataFrame:
    """(path, file, size, modified) of the Markdown files below folder. Only names of folders come to the driver: a folder's files are
    listed in a task."""
    from pyarrow import fs

    def folders(batches):
        import pyarrow as pa

        for batch in batches:
            found = [x.path for top in batch.column("dir").to_pylist() for x in entries(top) if x.type == fs.FileType.Directory and _shown(x.base_name)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["dir"])

    def files(batches):
        import pyarrow as pa

        for batch in batches:
            for top in batch.column("dir").to_pylist():
                found = [x for x in entries(top) if x.type == fs.FileType.File and x.base_name.endswith(".md") and _shown(x.base_name)]
                # times are told to the millisecond, as by Spark's readers
                columns = [pa.array([x.path for x in found], pa.string()), pa.array([x.size for x in found], pa.int64()), pa.array([x.mtime_ns // 1_000_000 for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "size", "ms"])

    def entries(top):
        return fs.FileSystem.from_uri(folder)[0].get_file_info(fs.FileSelector(top, allow_not_found=missing_ok))

    dealt = lambda names: spark.createDataFrame([(d,) for d in names], "dir string").repartition(max(1, min(len(names), 4096)))
    level = every = [fs.FileSystem.from_uri(folder)[1]]
    while level:
        level = [r["dir"] for r in dealt(level).mapInArrow(folders, "dir string").collect()]
        every = every + level
    listed = dealt(every).mapInArrow(files, "file string, size long, ms long")
    return listed.select(F.regexp_extract("file", r"(notes/.*)$", 1).alias("path"), "file", "size", F.timestamp_millis("ms").alias("modified"))


def _contents(spark: SparkSession, folder: str, files: DataFrame, n: int, task_files: int = TASK_FILES) -> DataFrame:
    """(path, raw) of n listed files, each opened in the task that holds its name."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0]
        made = lambda paths, held: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "raw"])
        for batch in batches:
            paths, held, size = [], [], 0
            for path, file in zip(batch.column("path").to_pylist(), batch.column("file").to_pylist(), strict=True):
                with store.open_input_stream(file) as stream:
                    held.append(stream.read())
                paths.append(path)
                size += len(held[-1])
                if size > BATCH_BYTES:
                    yield made(paths, held)
                    paths, held, size = [], [], 0
            yield made(paths, held)

    parts = max(spark.sparkContext.defaultParallelism, -(-n // task_files))
    contents = files.select("path", "file").repartition(parts).mapInArrow(read, "path string, raw binary")
    return contents.select("path", F.col("raw").cast("string").alias("raw"))


HINTS = "path string, size long, modified timestamp, id string, content_hash string, reason string"


def list_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, size, modified) of every Markdown file below folder, from its directory entry alone: no file is opened."""
    return _listed(spark, folder)


def scan_markdown(spark: SparkSession, folder: str, hints: DataFrame, store: Callable[[DataFrame], DataFrame], task_files: int = TASK_FILES) -> tuple[DataFrame, DataFrame]:
    """(scanned, notes): hints of all files as they now are, with whether each was read, and the notes of those that were.

    hints (HINTS) are the scanned of the last pass. A file of the same path, size and modification time is not opened: its id and
    content hash, or why it was rejected, come from its hint. A file that changed without any of these is not noticed. Files are listed and
    opened in tasks, `task_files` in each where there are many: the driver sees names of folders only.
    """
    from corpusloom.operators.index import fingerprints

    held = hints.select("path", "size", "modified", "id", "content_hash", "reason", F.lit(True).alias("hinted"))
    met = store(list_markdown(spark, folder).join(held, ["path", "size", "modified"], "left"))
    changed = met.filter("hinted is null")
    raw = _contents(spark, folder, changed, changed.count(), task_files)
    notes, rejected = parse_notes(raw, store)
    own = fingerprints(notes).select("path", "id", "content_hash", F.lit(None).cast("string").alias("reason")).unionByName(rejected, allowMissingColumns=True)
    read = changed.select("path", "size", "modified").join(own, "path").select("path", "size", "modified", "id", "content_hash", "reason", F.lit(True).alias("was_read"))
    known = met.filter("hinted").select("path", "size", "modified", "id", "content_hash", "reason", F.lit(False).alias("was_read"))
    return known.unionByName(read), notes


def write_markdown(rendered: DataFrame, folder: str) -> int:
    """Write (path, text) as files below folder, from the tasks that hold them; the number written."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        there = set()
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (own := f"{top}/{path}".rsplit("/", 1)[0]) not in there:
                    store.create_dir(own)
                    there.add(own)
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rendered.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def render_notes(notes: DataFrame) -> DataFrame:
    """(id, path, text): a header of quoted values, a blank line, the canonical body and a line end."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), quote(value))
    cleaned = serialize_space_ids(parse_space_ids(F.col("space_ids")))
    header = F.concat_ws("\n", F.lit("---"), line("id", F.col("id")), line("title", F.col("title")), line("createdAt", iso(F.col("created_at"))), line("updatedAt", iso(F.col("updated_at"))), line("spaceIds", cleaned), F.lit("---"))
    text = F.concat(header, F.lit("\n\n"), canonical_body(F.coalesce("body", F.lit(""))), F.lit("\n"))
    return notes.select("id", note_path(F.col("title"), F.col("id"), F.col("created_at")).alias("path"), text.alias("text"))


def _header_value(lines: Column, field: str) -> Column:
    """The unquoted value of a field's last header line; null without one."""
    found = F.filter(lines, lambda x: trim_white(F.substring_index(x, ":", 1)) == field)
    last = F.try_element_at(found, F.lit(-1))
    return unquote(trim_white(F.substring(last, F.instr(last, F.lit(":")) + 1, F.length(last))))


def parse_notes(raw: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(notes, rejected) from (path, raw). A file that can't be read is rejected with a reason and stops nothing. With store, which
    writes a table and reads it again, every file is parsed once for both."""
    text = F.regexp_replace("raw", "\r\n", "\n")
    close = F.locate("\n---", F.col("t"), 4)
    parts = raw.select("path", text.alias("t")).withColumn("close", close)
    parts = parts.withColumn("lines", F.filter(F.split(F.expr("substring(t, 5, close - 5)"), "\n"), lambda x: trim_white(x) != ""))
    after = F.expr("substring(t, close + 4)")
    parts = parts.withColumn("body", F.regexp_replace(F.regexp_replace(after, "^\n+", ""), "\n+$", ""))
    for f in FIELDS:
        parts = parts.withColumn(f, _header_value(F.col("lines"), f))
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED)))
    reason = F.when(F.col("t").isNull() | ~F.startswith("t", F.lit("---\n")), "no header").when(F.col("close") == 0, "header not closed").when(F.exists("lines", lambda x: F.instr(x, F.lit(":")) == 0), "header line without a colon").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    # one row made of one row: the filters below can't be moved under it and parse every file anew
    parts = store(parts.select("path", F.inline(F.array(F.struct(*FIELDS, "body", reason.alias("reason"))))))
    notes = parts.filter("reason is null").select("id", "title", "body", "path", F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"), parse_space_ids(F.col("spaceIds")).alias("space_ids"))
    return notes, parts.filter("reason is not null").select("path", "reason")


def catalog_reasons(prefix: str = "") -> Column:
    """Why a catalogue row is not usable: an empty array where it is."""
    c = lambda n: F.col(prefix + n)
    checks = [F.when(c(n).isNull(), F.lit(f"{n} is missing")) for n in REQUIRED]
    checks.append(F.when(c("path").isNull(), F.lit("path is missing")).when(~is_safe_relative_path(c("path")), F.lit("path is not safe")))
    return F.array_compact(F.array(*checks))


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON documents {version, notes}; one bad row rejects its document, with a reason naming it."""
    docs = spark.read.json(path, multiLine=True, schema=f"version int, notes array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in NOTE_RECORD.split(','))}>>, _corrupt_record string", columnNameOfCorruptRecord="_corrupt_record")
    docs = docs.withColumn("file", F.col("_metadata.file_path"))
    rows = docs.filter("notes is not null").select("file", F.posexplode("notes").alias("pos", "n")).select("file", "pos", "n.*")
    rows = rows.withColumn("reasons", catalog_reasons())
    bad = rows.filter(F.size("reasons") > 0).groupBy("file").agg(F.min_by(F.concat(F.lit("notes["), F.col("pos").cast("string"), F.lit("]: "), F.col("reasons")[0]), "pos").alias("reason"))
    corrupt = docs.filter("notes is null").select("file", F.lit("not a catalogue").alias("reason"))
    good = rows.join(bad.select("file"), "file", "left_anti").select(*FIELDS[:2], "path", *FIELDS[2:])
    return good, bad.union(corrupt)


def _checked(docs: DataFrame, rows: DataFrame, name: str, checks: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows (file, pos, ...) of documents without a bad row, and (file, reason) of the others; the reason names the first bad row."""
    reasons = F.array_compact(F.array(*checks))
    found = rows.withColumn("_reasons", reasons).filter(F.size("_reasons") > 0)
    bad = found.groupBy("file").agg(F.min_by(F.concat(F.lit(f"{name}["), F.col("pos").cast("string"), F.lit("]: "), F.col("_reasons")[0]), "pos").alias("reason"))
    corrupt = docs.filter("rows is null").select("file", F.lit(f"no {name}").alias("reason"))
    return rows.join(bad.select("file"), "file", "left_anti"), bad.union(corrupt)


def _documents(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    docs = spark.read.json(path, multiLine=True, schema=f"version int, {name} {kind}, _corrupt_record string", columnNameOfCorruptRecord="_corrupt_record")
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col(name).alias("rows"))


def read_spaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON documents {version, spaces}; one bad row rejects its document, with a reason naming it."""
    fields = ("id", "name", "colorId", "description", "createdAt", "updatedAt")
    docs = _documents(spark, path, f"array<struct<{','.join(f'{f}:string' for f in fields)}>>", "spaces")
    rows = docs.select("file", F.posexplode("rows").alias("pos", "r")).select("file", "pos", "r.*")
    checks = [F.when(F.col(f).isNull(), F.lit(f"{f} is missing")) for f in fields if f != "description"]
    good, bad = _checked(docs, rows, "spaces", [*checks, F.when(~F.col("colorId").isin(*COLORS), F.lit("colorId is unknown"))])
    return good.select(*fields), bad


def read_refs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, note_id), rejected) of JSON documents {version, refs}; a list that is missing or holds no text rejects its document."""
    docs = _documents(spark, path, "map<string,array<string>>", "refs")
    rows = docs.select("file", F.posexplode("rows").alias("pos", "path", "ids"))
    bad_ids = F.col("ids").isNull() | F.exists("ids", lambda x: x.isNull() | (x == ""))
    good, bad = _checked(docs, rows, "refs", [F.when(bad_ids, F.concat(F.lit("an id is missing: "), "path"))])
    return good.select("path", F.explode("ids").alias("note_id")), bad


def write_catalog(catalog: DataFrame, path: str, changed: bool) -> bool:
    """Rewrite the snapshot where it changed; whether it was written."""
    if changed:
        catalog.write.mode("overwrite").parquet(path)
    return changed


INDEX = "note_id string, idx int, kind string, text string, offset int, length int, dimensions int, embedding array<double>, model_id string, inline_embedding array<double>"


def read_index(spark: SparkSession, path: str, legacy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected): the index below path, with the older JSON records below `legacy`, in the current shape.

    Files that are no Parquet are passed over, records that are not valid are rejected with a reason; vectors that
    older records hold inline are moved to their column. Neither stops the rest.
    """
    records = spark.read.schema(INDEX).option("ignoreCorruptFiles", "true").parquet(path)
    if legacy:
        records = records.unionByName(spark.read.schema(INDEX).json(legacy))
    records = records.withColumn("dimensions", F.coalesce("dimensions", F.size(F.coalesce("embedding", "inline_embedding"))))
    checked = validate_index(records, ["text", "model_id"])
    return checked.filter("reason is null").drop("reason", "upgraded"), checked.filter("reason is not null").select("note_id", "idx", "reason")


def passed_over(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files below path of which read_index() reads no record: those that are no Parquet, and empty ones."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"), "length")
    read = spark.read.schema(INDEX).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return listed.join(read.select(plain("file").alias("_read")), plain("file") == F.col("_read"), "left_anti")
