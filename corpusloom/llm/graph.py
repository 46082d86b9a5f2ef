"""Groups of rows in tasks, and connected components of distributed links."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of about so many rows from batches sorted by keys; a group is never cut."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != x for c, x in zip(columns, last, strict=True))
        last = [c[-1] for c in columns]
        cuts = np.flatnonzero(change)
        if len(cuts) and size + cuts[-1] >= rows:
            held.append(batch.slice(0, cuts[-1]))
            yield pa.Table.from_batches(held)
            batch = batch.slice(cuts[-1])
            held, size = [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which groups begin, and the end."""
    change = np.zeros(table.num_rows + 1, bool)
    change[[0, -1]] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b connect it with."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reached.

    Large-star and small-star steps: each node's larger neighbours, then its smaller ones, are tied to the smallest.
    Every round is written to the shared folder and compared with the last by a count and a checksum; a chain of n
    links takes about log n rounds. Links of a node with itself count as nodes without links.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b"))).distinct()
    tied = common.stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    told = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = told(tied)
    while before[0]:
        both = tied.union(tied.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(low, "b")
        small = joined.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        new = common.stored(small)
        common.discard(tied)
        tied, now = new, told(new)
        if now == before:
            break
        before = now
    found = tied.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
