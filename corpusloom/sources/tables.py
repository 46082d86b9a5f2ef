"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Only a local master may leave it unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/notes-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """An index table: written once as Parquet and read by every step that needs it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """df as a table of Spark's own buckets by a column, sorted in them: joins and groupings by that column need no exchange of it."""
    name = f"corpusloom_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", scratch(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)
