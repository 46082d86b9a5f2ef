"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of word shingles (five words; a text of fewer words is one shingle). All pairs of documents with
Jaccard similarity >= threshold are links. The result has a row for each document: its class (smallest id reached by
links), its number of links, and whether it is the document that stays.

1. Texts with the same words are one node, represented by the smallest id, with a number of copies.
2. A node has MinHash values. Bands of four values make buckets: a pair at the threshold shares one of 40 buckets but
   for a chance of 1 in 10^9, closer pairs more surely still.
3. In a bucket pairs are compared 16, 32, 64, then all 160 values at a time, by a byte mixed from each value. Under a uniform prior the similarity has a
   beta posterior; a pair whose posterior probability of reaching the threshold is under `tolerance` is dropped. What
   remains connects nodes to candidate groups; from each task only a spanning forest is sent on.
4. In a candidate group all pairs are pruned in the same way and the remaining ones verified exactly on their
   shingles. Per node a task sends on a count of links and one edge of a spanning forest.

Buckets and groups larger than `block` nodes are dealt into blocks, and each pair of blocks is a task of its own: no
group is gathered in one task, and no pairs are written. Nothing is capped.

Null and empty texts and texts without a word link with nothing. Rows without an id have no class and no links. Rows
with the same id are one document, with the text of the smallest digest. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.graph import connected_components, forest, group_bounds, whole_groups

BANDS, ROWS = 40, 4
VALUES = BANDS * ROWS
STEPS = (16, 32, 64, VALUES)
SLICE_ROWS = 20_000


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    key = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return np.unique(key)


def permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(0, 1 << 31, VALUES, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, VALUES, np.uint32)


def min_hashes(shingles: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values, as 32-bit integers."""
    x, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        mixed = x[at : at + 256, None] * by[0]
        mixed += by[1]
        np.minimum(low, mixed.min(0), out=low)
    return low


def short_values(values: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value. A minimum over many shingles is a small number, so its bits are mixed first."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def digest(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, signature, bands): key is a digest of the words, null without a word."""

    def run(batches):
        by = permutations()
        for batch in common.bounded(batches, "text"):
            keys, values = [], np.zeros((batch.num_rows, VALUES), np.uint32)
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                keys.append(digest(words) if words else None)
                if words:
                    values[i] = min_hashes(shingle_hashes(words, width), by)
            bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (batch.num_rows, 1))
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    bands = (bands ^ (bands >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + values[:, k::ROWS].astype(np.uint64)
                bands = (bands ^ (bands >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            ends = pa.array(np.arange(0, batch.num_rows * BANDS + 1, BANDS, dtype=np.int32))
            listed = pa.ListArray.from_arrays(ends, pa.array(bands.view(np.int64).ravel()))
            short = short_values(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in short], pa.binary()), listed], ["doc_id", "key", "signature", "bands"])

    return docs.mapInArrow(run, "doc_id long, key binary, signature binary, bands array<long>")


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values the fewest matches at which P(similarity >= threshold) is still `tolerance` or more.

    Bytes of unlike values are equal by chance once in 256, so at similarity s a match has probability s + (1 - s) / 256.
    With a uniform prior of s the posterior of that probability after m of n matches is Beta(m + 1, n - m + 1) above
    1 / 256, and both tails are binomial sums.
    """
    chance = 1 / 256
    reached = threshold + (1 - threshold) * chance
    out = {}
    for n in STEPS:
        tail = possible = 0.0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * reached**m * (1 - reached) ** (n + 1 - m)
            possible += math.comb(n + 1, m) * chance**m * (1 - chance) ** (n + 1 - m)
            if tail >= tolerance * possible:
                out[n] = m
                break
    return out


def prune(signature: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay, comparing more and more values."""
    matches, done = np.zeros(len(a), np.int64), 0
    for n in STEPS:
        if not len(a):
            break
        matches = matches + (signature[a, done:n] == signature[b, done:n]).sum(1)
        stay = matches >= least[n]
        a, b, matches, done = a[stay], b[stay], matches[stay], n
    return a, b


def pairs_of(bounds: np.ndarray, side: np.ndarray, most: int = 200_000):
    """All pairs within groups, in arrays of at most about so many; side 0 marks a group that is paired with itself,
    1 and 2 the two blocks of a group whose pairs are those across."""
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)
    rows = np.arange(len(end))
    left, right, held = [], [], 0
    for shift in range(1, int(size.max(initial=0))):
        rows = rows[rows + shift < end[rows]]
        a, b = rows, rows + shift
        across = (side[a] == 0) | (side[a] != side[b])
        left.append(a[across])
        right.append(b[across])
        held += len(left[-1])
        if held >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def in_blocks(rows: DataFrame, group: str, size: Column, node: str) -> DataFrame:
    """rows repeated for each pair of blocks they take part in; a group of one block is not repeated. Adds i, j and side."""
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(size)).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    i, j = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return rows.withColumns({"i": i.cast("int"), "j": j.cast("int"), "side": side.cast("int")}).drop("_blocks", "_own", "_other")


KEYS = ["i", "j"]


def buckets(nodes: DataFrame, block: int) -> DataFrame:
    """(band, node, n) of the buckets of n > 1 nodes; no task sees more than `block` nodes of one bucket together.

    Buckets are counted with partial sums first. Rows of those over `block`, one for `block` rows at most, are told by
    common.small_join(); the others are small enough for a window.
    """
    from pyspark.sql import Window

    rows = nodes.select(F.explode("bands").alias("band"), "node")
    large = common.stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block))
    told = common.small_join(rows, large, "band", 64, F.xxhash64("node"), "left")
    small = told.filter("n is null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).filter("n > 1")
    return small.select("band", "node", "n").union(told.filter("n is not null").select("band", "node", "n"))


def candidates(nodes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the pairs that pruning leaves."""
    least = least_matches(threshold, tolerance)
    rows = buckets(nodes, block)
    rows = in_blocks(rows, "band", F.col("n") / block, "node").join(nodes.select("node", "signature"), "node")

    def run(batches):
        for table in whole_groups(batches, ["band", *KEYS], SLICE_ROWS):
            ids, local = np.unique(table.column("node").to_numpy(), return_inverse=True)
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, VALUES)
            label = np.arange(len(ids))
            for a, b in pairs_of(group_bounds(table, ["band", *KEYS]), table.column("side").to_numpy()):
                # copies of a pair in other buckets, and pairs already connected here, need no comparison
                open_ = label[local[a]] != label[local[b]]
                a, b = prune(signature, a[open_], b[open_], least)
                label = forest(len(ids), np.concatenate((np.arange(len(ids)), local[a])), np.concatenate((label, local[b])))
            tied = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[tied]]), pa.array(ids[tied])], ["a", "b"])

    return rows.repartition("band", *KEYS).sortWithinPartitions("band", *KEYS).mapInArrow(run, "a long, b long")


def common_counts(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared shingles of the pairs a, b of rows: by products of 0-1 matrices where pairs are dense, else pair by pair."""
    if not len(a):
        return np.zeros(0, np.int64)
    left, right = np.unique(a), np.unique(b)
    if len(a) * 20 < len(left) * len(right):
        return np.array([len(np.intersect1d(rows[x], rows[y], True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    used = np.union1d(left, right)
    flat = np.concatenate([rows[x] for x in used])
    owner = np.repeat(np.arange(len(used)), [len(rows[x]) for x in used])
    _, shingle, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[shingle]
    owner, shingle = owner[keep], number[shingle[keep]]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    total, width = np.zeros((len(left), len(right)), np.float32), max(256, (1 << 22) // len(used))
    to_left, to_right = np.searchsorted(used, left), np.searchsorted(used, right)
    for at in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(shingle, [at, at + width])
        part = np.zeros((len(used), width), np.float32)
        part[owner[low:high], shingle[low:high] - at] = 1
        total += part[to_left] @ part[to_right].T
    return total[np.searchsorted(left, a), np.searchsorted(right, b)].astype(np.int64)


def verify(rows: DataFrame, width: int, threshold: float, tolerance: float) -> DataFrame:
    """(node, links, root) by task from rows (component, i, j, side, node, copies, signature, text)."""
    least, exact = least_matches(threshold, tolerance), Fraction(threshold).limit_denominator(10_000)
    keys = ["component", *KEYS]

    def run(batches):
        for table in whole_groups(batches, keys, 500):
            bounds, side = group_bounds(table, keys), table.column("side").to_numpy()
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, VALUES)
            texts, nodes, copies = table.column("text"), table.column("node").to_numpy(), table.column("copies").to_numpy()
            links, label = np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
            digests = table.column("key").to_pylist()
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                words = [words_of(t.as_py()) for t in texts.slice(low, high - low)]
                # an id can have several rows: the first one with the node's words stands for it
                right = {nodes[low + k]: k for k in range(high - low - 1, -1, -1) if digest(words[k]) == digests[low + k]}
                stands = np.zeros(high - low, bool)
                stands[list(right.values())] = True
                sets = [shingle_hashes(w, width) if ok else np.zeros(0, np.uint64) for w, ok in zip(words, stands, strict=True)]
                size = np.array([len(s) for s in sets], np.int64)
                for a, b in pairs_of(np.array([0, high - low]), side[low:high]):
                    real = stands[a] & stands[b]
                    a, b = prune(signature[low:high], a[real], b[real], least)
                    both = common_counts(sets, a, b)
                    # both / (|a| + |b| - both) >= threshold, in whole numbers
                    near = both * (exact.denominator + exact.numerator) >= exact.numerator * (size[a] + size[b])
                    a, b = a[near] + low, b[near] + low
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    label = forest(len(label), np.concatenate((np.arange(len(label)), a)), np.concatenate((label, b)))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[label[some]])], ["node", "links", "root"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, links long, root long")


def jaccard_join(docs: DataFrame, *, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-8, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links and kept of every row."""
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = common.stored(signatures(texts, width))
    named = signed.filter("doc_id is not null and key is not null")
    texts_of = common.stored(named.groupBy("doc_id").agg(F.min("key").alias("key")))

    def classes_of_nodes() -> DataFrame:
        nodes = common.stored(texts_of.groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
        own = named.join(nodes.select("node", F.col("key").alias("own")), (F.col("doc_id") == F.col("node")) & (F.col("key") == F.col("own"))).select("node", "key", "signature", "bands")
        own = common.stored(own.dropDuplicates(["key"]))
        groups = common.settled(spark, lambda: connected_components(common.stored(candidates(own, threshold, tolerance, block))))
        sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        rows = in_blocks(groups.join(sizes, "component"), "component", F.col("n") / block, "node")
        rows = rows.join(own.select("node", "key", "signature"), "node").join(nodes.select("key", "copies"), "key")
        rows = rows.join(texts.withColumnRenamed("doc_id", "node"), "node").select("component", *KEYS, "side", "node", "key", "copies", "signature", "text")
        found = common.stored(verify(rows, width, threshold, tolerance))
        classes = connected_components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
        links = found.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node")
        return nodes.join(links, "node", "left").select("key", "copies", F.coalesce("component", "node").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))

    per_node = common.settled(spark, classes_of_nodes)
    rows = signed.filter("doc_id is not null").select("doc_id").join(texts_of, "doc_id", "left")
    with_key, without = rows.filter("key is not null"), rows.filter("key is null").select("doc_id")
    rows = common.members_join(with_key, per_node, "key", "copies").drop("key")
    rows = rows.unionByName(without, allowMissingColumns=True)
    class_id = F.coalesce("class", "doc_id")
    alone = signed.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return alone.union(rows.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), (F.col("doc_id") == class_id).alias("kept")))


#: The same rows in SQL: all shared shingles counted, links closed by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 10 * c >= 8 * (u.n + v.n - c)),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.other),
c AS (SELECT node, min(other) AS class_id FROM r GROUP BY node),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM documents JOIN c ON node = doc_id LEFT JOIN k ON x = doc_id
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents joined by shingle similarity."""
    return jaccard_join(common.table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each class is kept, with all their columns.

    Of rows with one id the one of smallest text digest stays; rows without an id all stay. Nulls, empty texts, repeated
    rows and empty tables are as in jaccard_join().
    """
    plain, (own, text) = common.positional(docs, id_col, text_col)
    named, unnamed = plain.filter(F.col(own).isNotNull()), plain.filter(F.col(own).isNull())
    kept = jaccard_join(named, id_col=own, text_col=text).filter("kept").select(F.col("doc_id").alias(own))
    stay = common.keep_only(named, kept, own)
    repeated = named.groupBy(own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(own).alias("id"))
    if repeated.isEmpty():
        return stay.union(unnamed).toDF(*docs.columns)
    repeated = common.stored(repeated)
    # partial sums keep one row an id in each task, so that an id of many rows is gathered nowhere
    row = F.struct(*plain.columns)
    order = F.struct(F.md5(F.col(text).cast("string").cast("binary")), F.md5(F.to_json(row).cast("binary")))  # maps have a text, but no hash
    first = common.keep_only(stay, repeated.withColumnRenamed("id", own), own).groupBy(F.col(own).alias("id")).agg(F.min_by(row, order).alias("r")).select("r.*")
    once = stay.join(repeated, F.col(own) == F.col("id"), "left_anti")
    return once.union(first).union(unnamed).toDF(*docs.columns)
