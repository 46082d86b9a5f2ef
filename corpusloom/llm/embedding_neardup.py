"""Near-duplicate embeddings by an inverted multi-index.

Each vector is scaled to length 1 and cut in two halves. Each half has a codebook of its own (k-means on a bounded
sample), and the product of both codebooks is a grid of cells; every vector is indexed in the cell of its nearest
codes. A vector looks for its neighbours by multi-sequence traversal: both codebooks are ordered by how far beyond
the vector's own region their regions lie, and cells are visited in the order of the summed squares, nearest first.

It stops where the target recall is reached: the stopping distance is calibrated on the sample, with a vector at
exactly the threshold drawn for each sampled one and with every true pair of the sample, as the distance within which
the share `recall` of them lies. In the visited cells all vectors are compared by cosine in double precision.

Of two cells only the vectors of one ask in the other, and a link found there counts for both. Equal vectors are one node with a number of copies. Cells of more than `block` vectors are dealt into blocks and each
pair of blocks is a task; per vector a task sends on a count and one edge of a spanning forest, never pairs. The number
of cells grows with the number of vectors, so a cell's size doesn't.

Vectors of each length have an index of their own, and those of unlike lengths link with nothing; up to `cell_rows` vectors of one
length are one cell. Vectors that are null, zero or hold null or non-finite components link with nothing. Rows without an id have no links and no
component; rows with the same id are one vector, the smallest. An empty table has no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.graph import connected_components, forest, group_bounds, whole_groups


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, as squares of tiny or huge ones are not finite numbers above 0."""
    rows = rows / np.abs(rows).max(1, initial=0.0, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = (np.square(centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Two codebooks, and the distance at which a traversal stops."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.half = sample.shape[1] // 2 or 1
        self.books = [k_means(part, k) for part in (sample[:, : self.half], sample[:, self.half :]) if part.shape[1]]
        self.k = k
        self.apart = [np.sqrt(np.maximum(np.square(b[:, None] - b[None]).sum(2), 1e-30)) for b in self.books]
        self.stop = self._calibrate(sample, threshold, recall)

    def beyond(self, rows: np.ndarray) -> list[np.ndarray]:
        """Per half, the squared distance from each row to the bisector between its own code and every code."""
        out = []
        for book, apart, part in zip(self.books, self.apart, (rows[:, : self.half], rows[:, self.half :]), strict=False):
            far = np.square(part).sum(1)[:, None] + np.square(book).sum(1) - 2 * part @ book.T
            own = far.argmin(1)
            gap = (far - far[np.arange(len(far)), own][:, None]) / (2 * apart[own])
            gap[np.arange(len(far)), own] = 0
            out.append(np.square(gap))
        return out

    def home(self, rows: np.ndarray) -> np.ndarray:
        codes = [b.argmin(1) for b in self.beyond(rows)]
        return codes[0] * self.k + (codes[1] if len(codes) > 1 else 0)

    def to_cells(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Squared distance beyond a row's own cell of one cell for each row."""
        parts = self.beyond(rows)
        at = np.arange(len(rows))
        return parts[0][at, cells // self.k] + (parts[1][at, cells % self.k] if len(parts) > 1 else 0)

    def _calibrate(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        draw = np.random.default_rng(11)
        aside = draw.standard_normal(sample.shape)
        aside -= (aside * sample).sum(1)[:, None] * sample
        size = np.sqrt(np.square(aside).sum(1))[:, None]
        other = unit(threshold * sample + np.sqrt(1 - threshold**2) * aside / np.maximum(size, 1e-30))
        found = [self.to_cells(sample, self.home(other))]
        cells = self.home(sample)
        for at in range(0, len(sample), 1000):
            a, b = np.nonzero(sample[at : at + 1000] @ sample.T >= threshold)
            if len(a):
                found.append(self.to_cells(sample[at + a], cells[b]))
        return max(float(np.quantile(x, recall)) for x in found)

    def traverse(self, rows: np.ndarray) -> list[list[int]]:
        """The cells each row visits, nearest first."""
        parts = self.beyond(rows)
        if len(parts) == 1:
            return [[int(c) * self.k for c in np.flatnonzero(p <= self.stop)] for p in parts[0]]
        orders = [np.argsort(p, 1, kind="stable") for p in parts]
        values = [np.take_along_axis(p, o, 1) for p, o in zip(parts, orders, strict=True)]
        out = []
        for first, second, i_codes, j_codes in zip(*(v.tolist() for v in values), *(o.tolist() for o in orders), strict=True):
            cells, queue = [], [(first[0] + second[0], 0, 0)]
            while queue:
                far, i, j = heapq.heappop(queue)
                if far > self.stop:
                    break
                cells.append(i_codes[i] * self.k + j_codes[j])
                if j + 1 < self.k:
                    heapq.heappush(queue, (first[i] + second[j + 1], i, j + 1))
                if j == 0 and i + 1 < self.k:
                    heapq.heappush(queue, (first[i + 1] + second[0], i + 1, 0))
            out.append(cells)
        return out


def asks_in(own: int, cell: int) -> bool:
    """Of two unlike cells each pair of vectors is compared in one: this tells whether those of `own` ask in `cell`."""
    return own == cell or (own < cell) != bool((own + cell) & 1)


def build_indexes(nodes: DataFrame, threshold: float, recall: float, sample_rows: int, cell_rows: int) -> dict[int, MultiIndex]:
    """An index for each length of more than cell_rows vectors, each fitted on a sample; all samples together are bounded."""
    sizes = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows).collect()}
    out = {}
    for size, n in sizes.items():
        own = nodes.filter(F.col("size") == size).select("vector").orderBy(F.xxhash64("vector")).limit(max(200, sample_rows // len(sizes)))
        sample = matrix(own.toArrow().column("vector"))
        out[size] = MultiIndex(unit(sample), max(1, min(round((n / cell_rows) ** 0.5), len(sample) // 8)), threshold, recall)
    return out


def links_of_nodes(one: DataFrame, threshold: float, recall: float, sample_rows: int, cell_rows: int, block: int) -> DataFrame:
    """(vector, copies, component, links) of every distinct vector of a stored table (vec_id, vector); links are those to unlike vectors."""
    nodes = common.stored(one.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("vector")))
    indexes = build_indexes(nodes, threshold, recall, sample_rows, cell_rows)

    def visit(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            for n in np.unique(size).tolist():
                part = batch.filter(pa.array(size == n))
                index = indexes.get(n)
                if index:
                    x = unit(matrix(part.column("vector")))
                    own = index.home(x)
                    visited = [[c for c in {*cells, home} if asks_in(home, c)] for home, cells in zip(own.tolist(), index.traverse(x), strict=True)]
                else:
                    own = np.zeros(part.num_rows, np.int64)
                    visited = [[0]] * part.num_rows
                many = np.array([len(v) for v in visited])
                at = np.concatenate((np.arange(len(own)), np.repeat(np.arange(len(own)), many)))
                cell = np.concatenate((own, np.fromiter((c for v in visited for c in v), np.int64, many.sum()))).astype(np.int64)
                asks = np.arange(len(at)) >= len(own)
                taken = part.take(pa.array(at))
                columns = [pa.array(cell), pa.array(asks), pa.array(asks & (cell == own[at])), *(taken.column(c) for c in ("size", "node", "copies", "vector"))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "asks", "home", "size", "node", "copies", "vector"])

    kind = nodes.schema["vector"].dataType.simpleString()
    places = nodes.select("size", "node", "copies", "vector").mapInArrow(visit, f"cell long, asks boolean, home boolean, size int, node long, copies long, vector {kind}")
    places = common.stored(places)
    sizes = places.groupBy("size", "cell").agg(F.count_if("asks").alias("n_asks"), F.count_if(~F.col("asks")).alias("n_held"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    large = common.stored(sizes.filter(f"n_asks > {block} or n_held > {block}").select("size", "cell", blocks("n_asks").alias("of_asks"), blocks("n_held").alias("of_held")))
    # a row a cell over `block` rows: cells of the usual size need no join
    cell_key = lambda df: df.withColumn("place", F.struct("size", "cell"))
    dealt = common.small_join(cell_key(places), cell_key(large).drop("size", "cell"), "place", 16, F.xxhash64("node"), "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(1))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("asks"), of("of_asks")).otherwise(of("of_held"))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), of("of_held")).otherwise(of("of_asks")) - 1)))
    i, j = F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))
    dealt = dealt.select("size", "cell", i.alias("i"), j.alias("j"), "asks", "home", "node", "copies", "vector")
    keys = ["size", "cell", "i", "j"]

    def compare(batches):
        for table in whole_groups(batches, keys, 4096):
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size, bounds = table.column("size").to_numpy(), group_bounds(table, keys)
            begins = np.concatenate(([0], np.cumsum(size)))
            asks, home = (table.column(c).to_numpy() for c in ("asks", "home"))
            node, local = np.unique(table.column("node").to_numpy(), return_inverse=True)
            copies, links, label = table.column("copies").to_numpy(), np.zeros(len(node), np.int64), np.arange(len(node))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x = unit(flat[begins[low] : begins[high]].reshape(high - low, -1))
                a, b = np.flatnonzero(asks[low:high]), np.flatnonzero(~asks[low:high])
                for at in range(0, len(a), 512):
                    some = a[at : at + 512]
                    near = (x[some] @ x[b].T >= threshold) & (local[low + some][:, None] != local[low + b])
                    p, q = np.nonzero(near)
                    if not len(p):
                        continue
                    asking, held = local[low + some[p]], local[low + b[q]]
                    np.add.at(links, asking, copies[low + b[q]])
                    far = ~home[low + some[p]]  # the other vector doesn't ask here
                    np.add.at(links, held[far], copies[low + some[p[far]]])
                    label = forest(len(node), np.concatenate((np.arange(len(node)), asking)), np.concatenate((label, held)))
            some = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]])], ["node", "links", "root"])

    found = common.stored(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, links long, root long"))
    common.discard(places)
    components = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(components, "node")
    return nodes.join(links, "node", "left").select("vector", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, recall: float = 0.9995, sample_rows: int = 10_000, cell_rows: int = 300, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    sound = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    one = common.stored(sound.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    per_node = common.settled(spark, lambda: links_of_nodes(one, threshold, recall, sample_rows, cell_rows, block))
    per_id = common.members_join(one, per_node, "vector", "copies").select(F.col("vec_id").alias("_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.select("vec_id").join(per_id, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: The same rows in SQL: every pair compared, links closed by recursion.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM d WHERE v IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.v, b.v) >= 0.95 * a.norm * b.norm),
r AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN k ON x = vec_id
"""


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at cosine 0.95."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
