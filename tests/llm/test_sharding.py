"""Stratified shards: against a plain version, on messy rows, and with one row that repeats."""

import hashlib
import zlib
from collections import Counter, defaultdict

from corpusloom.llm import sharding as S


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain(rows, n_shards, seed=S.SEED):
    """(doc_id, shard, slot) by the definition, for rows (doc_id, text, source) without repeats."""
    by = defaultdict(list)
    for i, text, source in rows:
        crc = zlib.crc32((text or "").encode())
        by["" if source is None else f"={source}"].append((number(seed, "" if i is None else i, crc), i))
    order = sorted(((rank + number(seed, "source", s) / 2.0**60) / len(own), s, rank, i) for s, own in by.items() for rank, (_, i) in enumerate(sorted(own)))
    shard = [p * n_shards // len(order) for p in range(len(order))]
    return {(i, shard[p], p - shard.index(shard[p])) for p, (*_, i) in enumerate(order)}


def test_shards_equal_the_plain_version(spark):
    rows = [(i, f"text {i} é", f"s{i % 3 if i % 7 else i}") for i in range(500)] + [(1000, None, None), (1001, "", "s0"), (1002, "text 1 é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for group_rows in (5, 1000):
        out = S.assignment(df, 7, group_rows=group_rows).collect()
        assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == plain(rows, 7)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    mixture = defaultdict(Counter)
    for r in out:
        mixture[r["shard"]][dict((i, s) for i, _, s in rows)[r["doc_id"]]] += 1
    assert all(abs(mixture[k]["s1"] - sum(s == "s1" for *_, s in rows) / 7) <= 2 for k in range(7))
    got = {r["doc_id"]: r for r in out}
    assert got[1000]["size"] == 1 and got[1000]["text_crc32"] == 0 and got[1]["size"] == len("text 1 é".encode()) + 1 and got[1]["text_crc32"] == zlib.crc32("text 1 é".encode())
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in out)


def gapless(rows, n_shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1


def test_messy_few_and_no_rows(spark, messy, messy_rows, no_docs):
    out = S.assignment(messy.withColumnsRenamed({"rank": "_rank", "key": "shard"})).collect()
    gapless(out, 16)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in messy_rows)
    gapless(S.assignment(messy.limit(5)).collect(), 16)
    assert S.assignment(no_docs).count() == 0


def test_one_row_that_repeats_is_dealt(spark):
    same = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'again' as text", "'a' as source")
    df = same.union(spark.range(300).selectExpr("id", "concat('t', id)", "if(id % 2 = 0, 'a', 'b')"))
    out = S.assignment(df, 16, group_rows=100).collect()
    assert len(out) == 3300
    gapless(out, 16)
    assert all(abs(n - 3300 / 16 / 22) <= 2 for n in Counter(r["shard"] for r in out if r["doc_id"] is not None and r["doc_id"] % 2).values())
    rows = S.interleaved(df, group_rows=100)[0]
    assert sorted(r["_position"] for r in rows.collect()) == list(range(3300))


def test_sums_of_many_places(spark):
    counts = spark.range(5000).selectExpr("id % 2 as g", "id * 900 as at", "id % 5 as n")
    got = {(r["g"], r["at"]): r["start"] for r in S.starts(counts, ["g"], "at").collect()}
    total = Counter()
    for i in range(5000):
        assert got[(i % 2, i * 900)] == total[i % 2]
        total[i % 2] += i % 5


def test_files_hold_all_columns(spark, tmp_path):
    df = spark.range(100).selectExpr("id as doc_id", "concat('t', id) as text", "'s' as source", "'x' as shard", "id as `a.b`")
    names = S.write_shards(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert names == ("_shard", "slot") and set(back.columns) == {*df.columns, *names} and back.select(*(f"`{c}`" for c in df.columns)).exceptAll(df).count() == 0
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in S.assignment(df, 3).collect()}
    assert {(r["doc_id"], r["_shard"], r["slot"]) for r in back.collect()} == want
