"""The views over the supplied tables that the queries read."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import bucketed, scratch, stored  # noqa: F401

#: Display names of the spaces that stand for languages.
LANGUAGES = {"es": "Español", "fr": "Français", "de": "Deutsch", "en": "English"}
EDGE_QUERIES = ((-1, "   "), (-2, "Deutsch"), (-3, "zzqqxx"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts of a file split, which is 128 MB of compressed text at most.
PARTS = 8


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, and to PARTS parts of each file split where there are several: what a task holds and how long it
    takes stay the same for a table of any size."""
    splits = df.rdd.getNumPartitions()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, PARTS * splits if splits > 1 else 1))


_kept: dict[tuple[str, str, str], Any] = {}


def once(name: str, make: Callable[[SparkSession, str], Any]) -> Callable[[SparkSession, str], Any]:
    """What make gives, made once for each application and folder; files of that folder that change later aren't seen."""

    def get(spark: SparkSession, sf_dir: str) -> Any:
        key = spark.sparkContext.applicationId, sf_dir, name
        if key not in _kept:
            _kept[key] = make(spark, sf_dir)
        return _kept[key]

    return get


def kept(name: str, make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A view that is stored once: indexes and inputs that many queries read."""
    return once(name, lambda spark, sf_dir: stored(make(spark, sf_dir)))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    head = F.regexp_extract("text", r"^(?:\s*+\S++){1,8}", 0)  # the other words of the text aren't cut
    words = F.regexp_extract_all(head, F.lit(r"\S+"), F.lit(0))
    epoch = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda seconds: F.timestamp_seconds(F.unix_timestamp(epoch) + seconds)
    return d.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"),
        "doc_id",
        F.array_join(words, " ").alias("title"),
        F.col("text").alias("body"),
        at(F.col("doc_id") % 366 * 86400).alias("created_at"),
        at(F.col("doc_id") * 7919 % 2592000).alias("updated_at"),
        F.when(F.col("doc_id") % 5 != 0, F.concat_ws(",", "lang", "source")).alias("space_ids"),
    )


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    lang = d.select(F.col("lang").alias("id")).distinct().withColumn("name", F.coalesce(names[F.col("id")], F.col("id")))
    source = d.select(F.col("source").alias("id")).distinct().withColumn("name", F.concat(F.lit("Source "), F.substring("id", 4, 9)))
    return lang.union(source).filter("id is not null")


def note_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    q = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 2), " ")
    edge = spark.createDataFrame(EDGE_QUERIES, "qid long, q string")
    return b.select(F.col("item_id").alias("qid"), q.alias("q")).union(edge)


def vec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    idx = (F.col("vec_id") % 5 - 1).cast("int")
    return e.select(F.floor(F.col("vec_id") / 5).cast("long").alias("note_id"), idx.alias("idx"), F.when(idx == -1, "title").otherwise("body").alias("kind"), F.col("embedding"), F.col("vec_id"))


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.floor(F.col("vec_id") / 5).cast("long").alias("own"), F.col("embedding").alias("vector"))


def with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    link = F.concat(F.lit("![i](attachments/"), F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256), F.lit(".png)"))
    return n.withColumn("body", F.concat(F.coalesce("body", F.lit("")), F.lit("\n"), link))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    kinds = F.array(*(F.lit(x) for x in ("image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp")))
    return d.select("doc_id", kinds[(F.col("doc_id") % 5).cast("int")].alias("mime"), F.col("text").cast("binary").alias("content"))
