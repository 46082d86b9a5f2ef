"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters of a batch that a worker handles at once. Texts can hold megabytes, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of an Arrow batch, where the session doesn't say otherwise. It is all that is set in a session.
ARROW_BYTES = 16 << 20
#: A table of one row a group is broadcast up to so many rows, counted first; beyond it is joined by shuffle.
SMALL_ROWS = 20_000

_shipped: set[str] = set()
#: Paths that stored() wrote: all that is ever deleted, and those of the settled() call at hand.
_written: set[str] = set()
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python workers import it anywhere."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))  # rows of megabytes would fill a worker
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{package.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Only a local master may leave it unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    _written.add(path)
    if (within := _within.get()) is not None:
        within.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, stored. What else was stored on the way is deleted, as nothing reads it any more."""
    outer, own = _within.get(), []
    token = _within.set(own)
    try:
        out = stored(make())
        kept = own.pop()
    finally:
        _within.reset(token)
        for path in own:
            delete(spark, path)
    if outer is not None:
        outer.append(kept)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that stored() wrote."""
    if path in _written:
        _written.discard(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote and nothing reads any more; a table of other files stays."""
    folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in folders]:
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_count(df: DataFrame, rows: int = 4000) -> int:
    """Blocks to deal df into so that each has about so many rows; grows with the input."""
    return max(1, -(-df.count() // rows))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def keep_only(docs: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in kept, null equal to null; all columns of docs stay as they are."""
    name = free_name(docs, "kept_key")
    ids = kept.select(F.col(key).alias(name)).distinct()
    return docs.join(ids, same(docs[key], ids[name]), "left_semi")


#: Rows that may share a key in a plain shuffle join.
FEW = 1000


def members_join(rows: DataFrame, nodes: DataFrame, key: str, copies: str, salts: int = 64) -> DataFrame:
    """Left join of rows to a stored table of one row a key, of which `copies` rows have each key.

    Keys of more than FEW rows, of which there are few, are joined by small_join(), so that no task meets all their rows.
    """
    many = stored(nodes.filter(F.col(copies) > FEW))
    n = many.count()
    if not n:
        return rows.join(nodes, key, "left")
    far = small_join(rows, many, key, salts, F.xxhash64(*rows.columns), "left", size=n)
    own = [c for c in nodes.columns if c != key]
    rest = far.filter(F.col(copies).isNull()).select(*rows.columns).join(nodes.filter(F.col(copies) <= FEW), key, "left")
    return far.filter(F.col(copies).isNotNull()).select(*rows.columns, *own).union(rest.select(*rows.columns, *own))


def salted_join(rows: DataFrame, small: DataFrame, on: Column, salts: int, key: str | Column, how: str = "left") -> DataFrame:
    """Join a table of one row a group to rows: rows are dealt by group and salt, and the small side is repeated for each salt.

    It is a merge join always: Spark would size the small side by its compressed files, without all of the copies, and broadcast it.
    """
    salt, salt2 = f"_salt_{uuid.uuid4().hex}", f"_salt_{uuid.uuid4().hex}"
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(key) if isinstance(key, str) else key, F.lit(salts)).cast("int"))
    small = small.withColumn(salt2, F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return rows.join(small.hint("merge"), on & (F.col(salt) == F.col(salt2)), how).drop(salt, salt2)


def small_join(rows: DataFrame, small: DataFrame, group: str, salts: int, key: str | Column, how: str = "inner", size: int | None = None) -> DataFrame:
    """Join a table of few rows a group to rows by the column `group` of both: broadcast up to SMALL_ROWS rows, else dealt by
    group and salt. `size` is a bound of its rows; without it small has to be a stored table and is counted."""
    if (small.count() if size is None else size) <= SMALL_ROWS:
        return rows.join(F.broadcast(small), group, how)
    own = f"_group_{uuid.uuid4().hex}"
    small = small.withColumnRenamed(group, own)
    return salted_join(rows, small, rows[group] == F.col(own), salts, key, how).drop(own)


def positional(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ... in order, and the new names of some: any names may stand in df, with dots or twice but for case."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), [f"c{df.columns.index(c)}" for c in columns]


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df begins like it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def bounded(batches: Iterable[pa.RecordBatch], column: str | int, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and, but for single rows, about `size` bytes of a text column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start] - lengths[start]
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop
