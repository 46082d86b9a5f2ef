"""Clustering of whole-number vectors round centroids, with distances from scalar lookup tables.

Every component x becomes the integer floor(scale * x). The first centroids are the vectors whose ids have the smallest
seeded SHA-256, in that order. In a round each vector goes to the nearest centroid by squared Euclidean distance, of
equally near ones to the smallest number, and every centroid that has vectors moves to the floor of their mean. After
the last round vectors are assigned once more. All arithmetic is exact.

Distances come from tables: for each dimension a task tabulates the squared difference of every integer value that occurs
and every centroid, and keeps the table for the round. The distances of a batch are gathers from these tables and their
sums; no difference is computed a second time. Dimensions whose values spread too widely for a dense table have one of the
distinct values of the batch.

Between rounds only counts and sums by cluster and dimension leave a task, and the driver holds the centroids: their
size doesn't depend on the number of vectors, and a cluster with a third of all vectors is summed where they lie.

Vectors that are null, of another length, or hold a null, NaN or infinite component are left out; so are those with a component of
2^27 or more after scaling, whose squared distances need not fit a long. Repeated rows are vectors of their own; of those
with one id the smaller vector starts first. Null ids are hashed as an empty string. Fewer vectors than centroids give as
many clusters as vectors; an empty table has no rows. Sums of distances beyond a long are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Components reach this at most.
LIMIT = 1 << 27
#: Values that a dense table spans at most; beyond it a table has the distinct values only.
SPAN = 4096
RESULT = "vec_id long, cluster int, distance long"


class DistanceTables:
    """Squared differences of values and centroids, a table a dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids  # clusters, dimensions
        self.dense: dict[int, tuple[int, np.ndarray]] = {}

    def table(self, values: np.ndarray, dimension: int) -> np.ndarray:
        return (values.astype(np.int64)[:, None] - self.centroids[:, dimension]) ** 2

    def gather(self, column: np.ndarray, dimension: int) -> np.ndarray:
        low, high = int(column.min()), int(column.max())
        if high - low >= SPAN:
            values, place = np.unique(column, return_inverse=True)
            return self.table(values, dimension)[place]
        start, known = self.dense.get(dimension, (low, np.zeros((0, len(self.centroids)), np.int64)))
        if low < start or high >= start + len(known):
            first, last = (min(low, start), max(high + 1, start + len(known))) if len(known) else (low, high + 1)
            if last - first > SPAN:
                first, last = low, high + 1
            start, known = self.dense[dimension] = first, self.table(np.arange(first, last), dimension)
        return known[column - start]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row."""
        total = np.zeros((len(vectors), len(self.centroids)), np.int64)
        for d in range(vectors.shape[1]):
            total += self.gather(vectors[:, d], d)
        cluster = total.argmin(1)
        return cluster, total[np.arange(len(vectors)), cluster]


def integers(vectors: DataFrame, dimensions: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part; x are integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    usable = F.expr(f"coalesce(size(e) = {dimensions} and forall(e, v -> v is not null and not isnan(v) and abs(v) < {LIMIT / scale!r}D), false)")
    return rows.filter(usable).select("vec_id", F.expr(f"transform(e, v -> cast(floor(v * {float(scale)!r}D) as int))").alias("x"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round."""
    tables = np.array(centroids, np.int64)
    k, dimensions = tables.shape

    def run(batches):
        lookup, n, total = DistanceTables(tables), np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), dimensions)
                cluster = lookup.nearest(x)[0]
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(0, dtype=np.int64)
        c, d = (i.ravel() for i in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(n[c]), pa.array(total.ravel())], ["c", "d", "n", "total"])

    sums = rows.select("x").mapInArrow(run, "c int, d int, n long, total long").groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [list(c) for c in centroids]
    for r in sums.filter("n > 0").collect():  # clusters times dimensions
        out[r["c"]][r["d"]] = int(r["total"]) // r["n"]
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    tables = np.array(centroids, np.int64)

    def run(batches):
        lookup = DistanceTables(tables)
        for batch in batches:
            if batch.num_rows:
                cluster, distance = lookup.nearest(matrix(batch.column("x"), tables.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, RESULT)


def cluster(vectors: DataFrame, *, clusters: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = common.stored(integers(vectors, dimensions, scale, id_col, vector_col))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["x"]) for r in rows.orderBy(drawn, "x").limit(clusters).collect()]
    if not centroids:
        return spark.createDataFrame([], RESULT), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return assigned(rows, centroids), centroids


def digests(centroids: list[list[int]]) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with the summed distance of its cluster and of all vectors, and its centroid's digest."""
    spark, found = found.sparkSession, common.stored(found)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row a cluster
    total = None if None in sums.values() else sum(sums.values())
    total = total if total is None or total < 1 << 63 else None
    rows = [(c, sums[c], total, d) for c, d in enumerate(digests(centroids)) if c in sums]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(rounds: int = 3, clusters: int = 16) -> str:
    """The same rows in SQL, a table of centroids a round."""
    near = """a{r} AS (SELECT v.i, arg_min(c.c, (c.distance, c.c)) AS c, min(c.distance) AS distance FROM v,
  LATERAL (SELECT c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM c{r}) c GROUP BY v.i)"""
    move = """m{r} AS (SELECT c, list(m ORDER BY d) AS x FROM (
  SELECT c, d, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT c, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS d FROM v JOIN a{r} USING (i)) GROUP BY c, d) GROUP BY c),
c{s} AS (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))"""
    steps = ",\n".join(f"{near.format(r=r)},\n{move.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
s AS (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT {clusters}),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM s),
{steps},
{near.format(r=rounds)}
SELECT vec_id, a{rounds}.c::INT AS cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (i) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


ORACLE_SQL = oracle_sql()


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters."""
    return with_inertia(*cluster(common.table(spark, sf_dir, "embeddings")))
