"""Numbers in the order of a column, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored


def numbered(df: DataFrame, by: str, name: str = "n", store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """df with numbers from 1 in the order of `by`, whose values are distinct: rows are numbered in ranges, and a range begins after
    the rows of the ranges before it. Only the ranges' sizes come to the driver."""
    rows = store(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in rows.groupBy("_range").count().collect())  # a row a partition
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "_range int, _start long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return rows.withColumn(name, own).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")
