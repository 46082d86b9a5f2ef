"""Centroid clustering: tables against plain differences, and rounds against a plain version."""

import hashlib
import math
import random

import numpy as np

from corpusloom.llm import centroid_clustering as C


def plain(rows, k, rounds, scale, dimensions):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centroids = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        found = [near(x)[1] for _, x in kept]
        for n in set(found):
            own = [x for (_, x), c in zip(kept, found, strict=True) if c == n]
            centroids[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted((str(i), near(x)[1], near(x)[0]) for i, x in kept), centroids


def test_tables_give_the_squared_distances():
    draw = np.random.default_rng(1)
    for spread in (5, 3000, 1_000_000, C.LIMIT - 1):
        centroids = draw.integers(-spread, spread, (7, 9))
        tables = C.DistanceTables(centroids)
        for shift in (0, spread // 3, -spread // 3):
            x = np.clip(draw.integers(-spread, spread, (200, 9)) + shift, -C.LIMIT + 1, C.LIMIT - 1).astype(np.int32)
            want = ((x.astype(np.int64)[:, None, :] - centroids[None]) ** 2).sum(2)
            cluster, distance = tables.nearest(x)
            assert (cluster == want.argmin(1)).all() and (distance == want.min(1)).all()
        assert all(len(t) <= C.SPAN for _, t in tables.dense.values())


def test_rounds_equal_the_plain_version(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(i % 4, 0.7) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0] * 6) for i in range(400, 500)]  # equal vectors with a third of all rows
    rows += [(7, [9.0] * 6), (7, [9.0] * 6), (None, [0.25] * 6), (600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7), (604, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (605, [float("nan")] * 6), (606, [float("-inf")] * 6), (607, [0.0] * 6), (608, [-0.0001] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    found, centroids = C.cluster(df, clusters=5, dimensions=6, scale=64)
    want, final = plain(rows, 5, 3, 64, 6)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want and centroids == final
    out = C.with_inertia(found, centroids).collect()
    assert {r["inertia"] for r in out} == {sum(d for *_, d in want)}
    assert all(r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["centroid_sha256"] == hashlib.sha256(",".join(map(str, final[r["cluster"]])).encode()).hexdigest() for r in out)


def test_empty_few_and_huge(spark):
    schema = "vec_id long, embedding array<float>"
    assert C.with_inertia(*C.cluster(spark.createDataFrame([], schema))).count() == 0
    out = C.with_inertia(*C.cluster(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (3, [3e38] * 64)], schema))).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in out) == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_an_empty_centroid_stays(spark):
    rows = [(1, [0.0]), (1, [0.0]), (2, [1.0]), (3, [2.0])]
    found, centroids = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=4, dimensions=1, rounds=2, scale=1)
    assert sorted(c[0] for c in centroids) == [0, 0, 1, 2] and sorted(r["distance"] for r in found.collect()) == [0] * 4
