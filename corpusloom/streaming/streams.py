"""Streams of edits: debouncing, incremental reindexing, first occurrences and answers in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import content_fingerprint, trim_white
from corpusloom.operators.chunking import plan_chunks
from corpusloom.operators.embedding import Embedder, embed_chunks
from corpusloom.operators.lexical import NOTE_POSTINGS, note_postings, posting_rows
from corpusloom.sources import versions
from corpusloom.sources.tables import stored


def debounce(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None, tie: str | None = None) -> DataFrame:
    """(key, burst_start, last_ts, n_edits, payload): a burst ends with a silent gap and only its last edit stays.

    On a stream give a watermark: bursts are sent on once it has passed them, and later rows are dropped. Run as a batch
    it flushes every burst.
    """
    rows = events.withWatermark(ts, watermark) if watermark else events
    others = [c for c in events.columns if c not in (key, ts)]
    last = F.max_by(F.struct(*others), F.struct(ts, tie) if tie else F.col(ts))
    bursts = rows.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_edits"), last.alias("payload"))
    return bursts.select(key, F.col("w.start").alias("burst_start"), "last_ts", "n_edits", "payload")


def first_occurrence(rows: DataFrame, keys: list[str], ts: str | None = None, watermark: str | None = None) -> DataFrame:
    """The first row of each key; with a watermark the state of a stream is bounded and a key may come again after it."""
    if watermark and ts:
        return rows.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def stream_reindex(stream: DataFrame, apply_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of saved notes to an index. apply_batch must give the same result when a batch is repeated."""
    return stream.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HEADERS = "note_id string, updated_at {time}, batch long, version long, content_hash string, model_id string, deleted boolean, has_text boolean"
POSTINGS = f"note_id string, version long, {NOTE_POSTINGS}"
CHUNKS = "note_id string, idx int, kind string, text string, offset int, length int, embedding array<double>, version long"
TERMS = "term string, n long"
#: So many folders of one level become one of the next.
FAN = 4
#: Notes of a batch whose rows are replaced are sent to the postings held, counted first, up to so many; beyond it the join is Spark's choice.
FEW = 100_000


def index_batch(where: str, embedder: Embedder) -> Callable[[DataFrame, int], None]:
    """A function that applies a micro-batch of saves (id, title, body, updated_at and, if there, deleted) to the index below `where`.

    Of several saves of a note the last counts, within a batch and between batches; a save that is older than the one held is passed over.
    Only notes whose text, model or deletion differs from what is held are cut, embedded and counted; a save that changes
    nothing writes a header. A deleted note leaves a header that says so, an emptied one a header without rows. How many notes have
    a term, and how many have text, is kept up by differences.

    Postings are held as a row a note, so that what is met with headers, and merged, is as many rows as there are notes.

    A batch is a folder; FAN folders of one level are merged into one, so that there are at most FAN - 1 for each level and log(batches)
    levels. The list of folders is renamed into place last (versions.py): a batch that is repeated after a failure, or after its end, changes nothing.
    """

    def apply_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = versions.current(spark, where) or {"last": -1, "time": batch.schema["updated_at"].dataType.simpleString(), "folders": [], "retired": []}
        if number <= state["last"]:
            return
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        saves = batch.select("id", F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), gone.alias("deleted"), "updated_at").alias("n"))
        last = saves.groupBy("id").agg(F.max_by("n", F.struct("n.updated_at", "n.deleted", F.xxhash64("n.title", "n.body"))).alias("n")).select("id", "n.*")
        # grouped and met with headers by the same exchange: texts are sent once and stored once; the batch's ids are read by themselves
        last = last.withColumn("content_hash", content_fingerprint(F.col("title"), F.col("body")))
        headers = _table(spark, state, "headers").join(batch.select(F.col("id").alias("note_id")), "note_id", "left_semi")
        held = _latest(headers).select(F.col("note_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("updated_at", "version", "content_hash", "model_id", "deleted", "has_text")))
        met = last.join(held, "id", "left").filter("_updated_at is null or updated_at >= _updated_at")
        same = (F.col("content_hash") == F.col("_content_hash")) & (F.col("_model_id") == embedder.id) & (F.col("deleted") == F.col("_deleted"))
        has_text = ~F.col("deleted") & ((trim_white(F.col("title")) != "") | (trim_white(F.col("body")) != ""))
        met = stored(met.withColumns({"changed": ~F.coalesce(same, F.lit(False)), "has_text": has_text}))
        fresh = met.filter("changed and not deleted").select("id", "title", "body")

        folder = versions.new_folder(where, "batch")
        version = F.lit(number).cast("long").alias("version")
        new_headers = met.select(F.col("id").alias("note_id"), "updated_at", F.lit(number).cast("long").alias("batch"), F.when(F.col("changed"), F.lit(number)).otherwise(F.col("_version")).cast("long").alias("version"), "content_hash", F.lit(embedder.id).alias("model_id"), "deleted", "has_text")
        new_headers.write.parquet(f"{folder}/headers")
        _write(note_postings(fresh).select("note_id", version, "terms", "tf", "titled"), f"{folder}/postings")
        chunks = embed_chunks(plan_chunks(fresh, embedder.passage_prefix), embedder).select("note_id", "idx", "kind", "text", "offset", "length", "embedding", version)
        _write(chunks, f"{folder}/chunks")
        replaced = "changed and _version is not null"
        more = F.coalesce(F.sum(F.col("has_text").cast("long") - F.coalesce(F.col("_has_text").cast("long"), F.lit(0))), F.lit(0))
        count, n_old = met.agg(more, F.count(F.when(F.expr(replaced), 1))).first()
        terms = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").select(F.explode(F.split("terms", " ")).alias("term"), F.lit(1).alias("n"))
        if n_old:
            old = met.filter(replaced).select(F.col("id").alias("note_id"), F.col("_version").alias("version"))
            lost = _table(spark, state, "postings").select("note_id", "version", "terms").join(F.broadcast(old) if n_old <= FEW else old, ["note_id", "version"], "left_semi")
            terms = terms.union(lost.select(F.explode(F.split("terms", " ")), F.lit(-1)))
        _write(terms.groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0").select("term", "n"), f"{folder}/terms")

        for folder_ in state["retired"]:
            versions.delete(spark, folder_)
        state |= {"last": number, "folders": [*state["folders"], {"path": folder, "level": 0, "notes": count}], "retired": []}
        while len(level := [f for f in state["folders"] if f["level"] == state["folders"][-1]["level"]]) == FAN:
            state |= {"folders": [*state["folders"][:-FAN], _merged(spark, state, where, level)], "retired": [*state["retired"], *(f["path"] for f in level)]}
        versions.publish(spark, where, state)

    return apply_batch


def _table(spark: SparkSession, state: dict, name: str, folders: list[dict] | None = None) -> DataFrame:
    schema = {"headers": HEADERS.format(time=state["time"]), "postings": POSTINGS, "chunks": CHUNKS, "terms": TERMS}[name]
    paths = [f"{f['path']}/{name}" for f in (state["folders"] if folders is None else folders)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("r")).select("r.*")


def _write(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def _latest(headers: DataFrame) -> DataFrame:
    """The last header of each note; later batches hold later saves."""
    others = [c for c in headers.columns if c != "note_id"]
    return headers.groupBy("note_id").agg(F.max_by(F.struct(*others), "batch").alias("h")).select("note_id", "h.*")


def _merged(spark: SparkSession, state: dict, where: str, folders: list[dict]) -> dict:
    """One folder with what the given ones, the last of the list, hold of each note; what a later one replaces is left out."""
    folder = versions.new_folder(where, "merged")
    _latest(_table(spark, state, "headers", folders)).write.parquet(f"{folder}/headers")  # deletions too: an older save may still come
    headers = spark.read.schema(HEADERS.format(time=state["time"])).parquet(f"{folder}/headers")
    for name in ("postings", "chunks"):
        _write(_table(spark, state, name, folders).join(headers.filter("not deleted").select("note_id", "version"), ["note_id", "version"], "left_semi"), f"{folder}/{name}")
    _write(_table(spark, state, "terms", folders).groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0"), f"{folder}/terms")
    return {"path": folder, "level": folders[0]["level"] + 1, "notes": sum(f["notes"] for f in folders)}


def live_index(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    """The index as it stands: headers of notes that aren't deleted, their postings and chunks, df (term, df) and n_docs, one row n."""
    state = versions.current(spark, where)
    if state is None:
        raise FileNotFoundError(f"no index below {where}")
    headers = _latest(_table(spark, state, "headers")).filter("not deleted")
    own = headers.select("note_id", "version")
    tables = {name: _table(spark, state, name).join(own, ["note_id", "version"], "left_semi").drop("version") for name in ("postings", "chunks")}
    tables["postings"] = posting_rows(tables["postings"])
    df = _table(spark, state, "terms").groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
    n = spark.range(1).select(F.lit(sum(f["notes"] for f in state["folders"])).cast("long").alias("n"))
    return {"headers": headers.drop("batch", "version", "deleted"), **tables, "df": df, "n_docs": n}


def fresh_answers(events: DataFrame, session: str = "session", kind: str = "kind", number: str = "number") -> DataFrame:
    """The answers of a stream of queries and answers that are to be shown: those to the session's latest query.

    events has, in the order of arrival `at`, rows of kind `query` or `answer` with the number of a query, which grows in a session, and a
    payload. An answer to an older query than the last that came before it is dropped, and so is a second answer. The state of a
    session is two numbers. Within a micro-batch rows are taken in the order of `at`, a query before an answer of the same time.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def show(key, batches, state: GroupState):
        asked, shown = state.get if state.exists else (-1, -1)
        # plain tuples: a session has a few rows, and a data frame's own sorting costs more than they do
        rows = [row for b in batches for row in zip(b["at"], b["kind"] == "answer", b["number"].tolist(), b["payload"], strict=True)]
        kept = []
        for at, answer, number, payload in sorted(rows, key=lambda row: row[:3]):
            if not answer:
                asked = max(asked, number)
            elif number == asked > shown:
                shown = asked
                kept.append((key[0], number, at, payload))
        state.update((asked, shown))
        if kept:
            yield pd.DataFrame(kept, columns=["session", "number", "at", "payload"])

    rows = events.select(F.col(session).alias("session"), F.col(kind).alias("kind"), F.col(number).cast("long").alias("number"), "at", "payload")
    out = f"session {rows.schema['session'].dataType.simpleString()}, number long, at timestamp, payload string"
    return rows.groupBy("session").applyInPandasWithState(show, out, "asked long, shown long", "append", GroupStateTimeout.NoTimeout)
