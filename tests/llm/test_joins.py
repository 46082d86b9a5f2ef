"""Jaccard join, embedding near-duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import embedding_neardup, graph, jaccard_join

VECTORS = "vec_id long, embedding array<float>, label int, node long, copies int, vector string"


def shingles(text, width=5):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(ids, links):
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in ids}
        if new == label:
            return label
        label = new


def expected(texts, threshold=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = {i: set() for i in texts}
    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i].add(j)
                links[j].add(i)
    return links, components(list(texts), links)


def varied(seed=2, groups=12):
    """Groups of copies with more and more changed words, so that similarities lie on both sides of the threshold."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 500)}"
    texts = {}
    for _ in range(groups):
        base = [word() for _ in range(draw.randint(30, 120))]
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = word()
            texts[len(texts) * 3] = " ".join(copy)
    return texts


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_join_finds_every_link(spark, block):
    texts = varied()
    links, label = expected(texts)
    assert sum(map(len, links.values())) > 60
    rows = jaccard_join.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"], r["kept"]) for r in rows} == {i: (len(links[i]), label[i], label[i] == i) for i in texts}


def test_jaccard_join_on_messy_rows(messy, messy_rows, no_docs):
    rows = jaccard_join.jaccard_join(messy).collect()
    texts = {i: t for i, t, *_ in messy_rows if i is not None}
    links, label = expected(texts)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in messy_rows)
    for r in rows:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["n_links"] == 0
        else:
            assert (r["n_links"], r["class_id"]) == (len(links[r["doc_id"]]), label[r["doc_id"]])
    stay = jaccard_join.keep_one(messy)
    assert stay.columns == messy.columns
    ids = [r["doc_id"] for r in stay.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({label[i] for i in texts}) and ids.count(None) == 2
    assert jaccard_join.jaccard_join(no_docs).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches(0.8, 1e-8)
    draw = np.random.default_rng(0)
    matches = draw.random((200_000, jaccard_join.VALUES)) < 0.8
    for n in jaccard_join.STEPS:
        assert (matches[:, :n].sum(1) < least[n]).mean() < 1e-4
    assert all(least[n] > 0.1 * n for n in jaccard_join.STEPS)


@pytest.mark.parametrize("n", [100, 500, 1000, 3000])
def test_pruning_drops_long_texts_without_a_common_shingle(n):
    draw, by = np.random.default_rng(n), jaccard_join.permutations()
    sets = [draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(k % 2) for k in range(8)]
    signature = jaccard_join.short_values(np.stack([jaccard_join.min_hashes(x, by) for x in sets]))
    a, b = np.triu_indices(8, 1)
    assert len(jaccard_join.prune(signature, a, b, jaccard_join.least_matches(0.8, 1e-8))[0]) == 0


def test_large_buckets_meet_in_no_window(spark):
    rows = [(i, [7, 100 + i // 2, 1000 + i]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node long, bands array<long>")
    found = jaccard_join.buckets(nodes, 8)
    got = sorted((r["band"], r["node"], r["n"]) for r in found.collect())
    assert got == sorted([(7, i, 40) for i in range(40)] + [(100 + i // 2, i, 2) for i in range(40)])
    windowed = found._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert re.search(r"Filter isnull\(n#", windowed)  # rows that found a large bucket are taken out before the window


def test_common_counts_both_ways():
    draw = random.Random(1)
    rows = [np.unique(np.array([draw.randrange(60) for _ in range(40)], np.uint64)) for _ in range(30)]
    pairs = [(i, j) for i in range(30) for j in range(i)]
    want = [len(np.intersect1d(rows[i], rows[j])) for i, j in pairs]
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    assert jaccard_join.common_counts(rows, a, b).tolist() == want
    few = slice(0, None, 40)
    assert jaccard_join.common_counts(rows, a[few], b[few]).tolist() == want[few]


def vectors(seed, n=240, d=10):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((40, d))
    x = centres[draw.integers(0, 40, n)] + draw.standard_normal((n, d)) * draw.choice([0.02, 0.1, 0.25], n)[:, None]
    return x.astype(np.float32)


@pytest.mark.parametrize("block", [2048, 8])
def test_embedding_links(spark, block):
    x = vectors(4)
    x[17] = x[9]
    rows = [(i, [float(c) for c in v], 0, 1, 2, "v") for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 10), (902, [float("nan")] + [1.0] * 9), (903, [None] + [1.0] * 9), (904, [1.0] * 3), (None, rows[0][1]), (905, [float("inf")] * 10), (906, [])]
    rows += [(i, v, None, None, None, None) for i, v in bad] + [rows[30]]
    df = spark.createDataFrame(rows, VECTORS)
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(x))}
    label = components(list(links), links)
    found = embedding_neardup.near_duplicates(df, cell_rows=10, block=block).collect()
    assert len(found) == len(rows)
    total = sum(len(v) for v in links.values())
    got = sum(r["n_links"] for r in found) - next(r["n_links"] for r in found if r["vec_id"] == 30)
    assert total > 100 and got <= total and got >= 0.99 * total
    for r in found:
        if r["vec_id"] is None or r["vec_id"] >= 900:
            assert r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"]
        else:
            assert r["n_links"] <= len(links[r["vec_id"]]) and r["kept"] == (r["component_id"] == r["vec_id"])
    same = sum(r["component_id"] == label[r["vec_id"]] for r in found if r["vec_id"] is not None and r["vec_id"] < 900)
    assert same >= 0.97 * len(x)
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


def test_traversal_visits_cells_in_order():
    x = embedding_neardup.unit(vectors(1, 400).astype(float))
    index = embedding_neardup.MultiIndex(x, 6, 0.95, 0.999)
    for row, cells in zip(x[:40], index.traverse(x[:40]), strict=True):
        far = np.array([index.to_cells(row[None], np.array([c]))[0] for c in range(36)])
        assert sorted(cells) == np.flatnonzero(far <= index.stop).tolist()
        assert (np.diff(far[cells]) >= -1e-12).all() and cells[0] == index.home(row[None])[0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8)]
    random.Random(0).shuffle(edges)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 560)}, 7: 7, 9: 8, 8: 8}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_groups_never_cuts_a_group(spark):
    df = spark.range(5000).select((F.col("id") % 37 * (F.col("id") % 3)).alias("g"), F.lit(1).alias("x"))

    def run(batches):
        import pyarrow as pa

        for table in graph.whole_groups(batches, ["g"], 300):
            bounds = graph.group_bounds(table, ["g"])
            yield pa.RecordBatch.from_arrays([pa.array(table.column("g").to_numpy()[bounds[:-1]]), pa.array(np.diff(bounds))], ["g", "n"])

    sizes = df.repartition(3, "g").sortWithinPartitions("g").mapInArrow(run, "g long, n long")
    want = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    rows = sizes.collect()
    assert len(rows) == len(want) and {r["g"]: r["n"] for r in rows} == want


def test_vectors_of_several_lengths_and_sizes_of_numbers(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [1e200, 2e200]), (4, [-1e-200, 2e-200]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0, 0.0]), (8, [2.0]), (9, [1e-320])]
    found = embedding_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (1, 8), 9: (1, 8)}


def test_each_pair_of_cells_is_compared_in_one():
    for own in range(12):
        for cell in range(12):
            assert embedding_neardup.asks_in(own, cell) != embedding_neardup.asks_in(cell, own) or own == cell


def test_keys_of_many_rows_are_joined_whole(spark, monkeypatch):
    from corpusloom.llm import common

    monkeypatch.setattr(common, "FEW", 3)
    rows = spark.range(200).select(F.col("id"), F.when(F.col("id") < 90, "a").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    nodes = common.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")).filter("key <> 'k7'"))
    for small in (20_000, 0):  # the large keys by broadcast and by salts
        monkeypatch.setattr(common, "SMALL_ROWS", small)
        got = common.members_join(rows, nodes, "key", "copies").collect()
        want = rows.join(nodes, "key", "left").collect()
        key = lambda r: (r["id"], r["key"], r["copies"], r["least"])
        assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "x"), (2, text, "y"), (3, "other words here", "z"), (3, "still other words", "z"), (3, "still other words", "z"), (None, text, "n"), (None, text, "n"), (4, None, "e"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _first string").withColumn("kept_key", F.lit(1))
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["_first"]) for r in out.collect())
    assert got == [(0, "n"), (0, "n"), (1, "x"), (3, "z"), (4, "e"), (5, "e")]
    assert jaccard_join.keep_one(df.limit(0)).count() == 0
