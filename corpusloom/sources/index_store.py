"""The stored vector index: a header for every note and the chunks of those with text, in buckets of notes by model.

A write makes a new state of the whole index. update_index() writes only the buckets that hold a changed or removed note;
the folders of all others are carried over as they are, and a bucket that has nothing any more is left out. Readers see the
old state or the new one (versions.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import versions

HEADERS = "note_id string, content_hash string, model_id string, dimensions int, schema_version int"
CHUNKS = "note_id string, idx int, kind string, text string, offset int, length int, embedding array<double>, model_id string"
TABLES = {"headers": HEADERS, "chunks": CHUNKS}
#: Notes of a bucket on average, and most buckets of a model.
BUCKET_NOTES, MOST_BUCKETS = 5000, 4096


def bucket_of(note_id: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(note_id), F.lit(buckets)).cast("int")


def _columns(table: str) -> list[str]:
    return [x.split()[0] for x in TABLES[table].split(", ")]


def _write(spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int) -> dict[str, list[str]]:
    """Write the rows to a new folder; the folders written, by table."""
    top, out = versions.new_folder(path, "version"), {}
    for name, df in tables.items():
        rows = df.select(*_columns(name)).withColumns({"model": F.coalesce("model_id", F.lit("")), "bucket": bucket_of("note_id", buckets)})
        rows.repartition("model", "bucket").sortWithinPartitions("model", "bucket", "note_id").write.partitionBy("model", "bucket").parquet(f"{top}/{name}")
        models = [m for m in versions.names(spark, f"{top}/{name}") if m.startswith("model=")]
        out[name] = [f"{top}/{name}/{m}/{b}" for m in models for b in versions.names(spark, f"{top}/{name}/{m}")]
    return out


def _bucket(folder: str) -> int:
    return int(folder.rsplit("bucket=", 1)[1])


def _read(spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).option("recursiveFileLookup", "true").parquet(*folders)


def write_index(headers: DataFrame, chunks: DataFrame, path: str, bucket_notes: int = BUCKET_NOTES) -> None:
    """Make (headers, chunks) the whole index; what it held before is no part of it any more."""
    spark = headers.sparkSession
    buckets = min(MOST_BUCKETS, max(1, -(-headers.count() // bucket_notes)))
    versions.publish(spark, path, {"buckets": buckets, "bucket_notes": bucket_notes} | _write(spark, path, {"headers": headers, "chunks": chunks}, buckets))


def update_index(headers: DataFrame, chunks: DataFrame, removed: DataFrame, path: str) -> list[int]:
    """Put the notes of headers, with all their chunks, in place of what the index holds of them, and take out removed (note_id).

    Returns the buckets that were written. An index that has outgrown its buckets is written anew.
    """
    spark, state = headers.sparkSession, versions.current(headers.sparkSession, path)
    if state is None:
        write_index(headers, chunks, path)
        return list(range(versions.current(spark, path)["buckets"]))
    buckets = state["buckets"]
    gone = headers.select("note_id").union(removed.select("note_id")).distinct()
    touched = {r[0] for r in gone.select(bucket_of("note_id", buckets)).distinct().collect()}  # a number a bucket
    if not touched:
        return []
    old = {name: _read(spark, name, [f for f in state[name] if _bucket(f) in touched]).join(gone, "note_id", "left_anti") for name in TABLES}
    tables = {"headers": old["headers"].unionByName(headers.select(*_columns("headers"))), "chunks": old["chunks"].unionByName(chunks.select(*_columns("chunks")))}
    if buckets < MOST_BUCKETS and tables["headers"].count() > 4 * state["bucket_notes"] * len(touched):
        far = {name: _read(spark, name, [f for f in state[name] if _bucket(f) not in touched]) for name in TABLES}
        write_index(tables["headers"].unionByName(far["headers"]), tables["chunks"].unionByName(far["chunks"]), path, state["bucket_notes"])
        return list(range(buckets))
    written = _write(spark, path, tables, buckets)
    versions.publish(spark, path, state | {name: [f for f in state[name] if _bucket(f) not in touched] + written[name] for name in TABLES})
    return sorted(touched)


def read_stored(spark: SparkSession, path: str, model_id: str | None = None, tables: Sequence[str] = tuple(TABLES)) -> tuple[DataFrame, ...]:
    """(headers, chunks) of the index, of one model alone where it is named: folders of other models, and of tables that aren't asked for,
    aren't opened."""
    state = versions.current(spark, path) or {name: [] for name in TABLES}
    out = []
    for name in tables:
        df = _read(spark, name, [f for f in state[name] if model_id is None or f"/model={escaped(model_id)}/" in f])
        out.append(df if model_id is None else df.filter(F.col("model_id") == model_id))
    return tuple(out)


def escaped(value: str) -> str:
    """A value as Spark writes it in the name of a folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or ord(c) < 32 else c for c in value) or "__HIVE_DEFAULT_PARTITION__"


def branch(spark: SparkSession, path: str, new: str) -> None:
    """A new index that begins as what the index at path holds now; no data is copied, and neither changes the other."""
    versions.publish(spark, new, versions.current(spark, path))


def clean(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders below path that the newest list doesn't name, and return them. No reader of an older list, no branch and no
    writer may be at work."""
    used = {f.split("/version-", 1)[1].split("/", 1)[0] for name in TABLES for f in (versions.current(spark, path) or {name: []})[name] if f.startswith(f"{path}/version-")}
    dead = [n for n in versions.names(spark, path) if n.startswith("draft-") or (n.startswith("version-") and n.split("-", 1)[1] not in used)]
    for n in dead:
        versions.delete(spark, f"{path}/{n}")
    return dead
