"""Collocations against a plain count, and stripes of portions and batches of any size."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from corpusloom.llm import collocations as C
from corpusloom.llm import common

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain(rows, longest, least, share=50, top=None):
    """(lang, rank, phrase, a, l, r, n, score) by the definition."""
    f, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            words[lang or "und"] += len(w)
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * inside[p] < share * a or not inside[p]:
                score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


def corpus(draw, n):
    words = [f"w{k}" for k in range(30)] + ["The", "the", "É", "x\x00y", "it's"]
    marks = [" "] * 8 + [", ", ".", "\n", "\t", " \r\n"]
    weight = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for i in range(n):
        text = "".join(draw.choices(words, weight)[0] + draw.choice(marks) for _ in range(draw.randint(0, 80)))
        rows.append((text + ("new york city " if i % 3 == 0 else ""), (None, "en", "de")[i % 3]))
    return rows + [(None, "en"), ("", "en"), ("one", "fr"), ("...", "xx")]


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("longest, least, top", [(3, 10, 40), (2, 3, None), (5, 4, None)])
def test_rows_equal_the_plain_count(spark, longest, least, top):
    rows = corpus(random.Random(longest), 150)
    df = spark.createDataFrame([(i, *r, "p", 1) for i, r in enumerate(rows)], SCHEMA).repartition(7)
    assert collected(C.collocations(df, longest=longest, least=least, top=top)) == plain(rows, longest, least, top=top)


def test_portions_and_batches_change_nothing(spark, monkeypatch):
    rows = corpus(random.Random(9), 60)
    batches = [pa.record_batch([pa.array([b or "und" for _, b in rows]), pa.array([None if a is None else a.encode() for a, _ in rows], pa.binary())], ["lang", "text"])]
    want = {(r[0], r[2]): r[3] for r in plain(rows, 3, 1, share=10**9)}
    for size in (1, 50, 1 << 20):
        stripes = pa.concat_tables(C.stripes_of(lang, pieces, 3, 4, frozenset([b"w0", b"the", b"none"])) for lang, pieces in C.portions(batches, size)).sort_by([("lang", "ascending"), ("first", "ascending"), ("part", "ascending")])
        for step in (1, 7, 10_000):  # rows of a stripe lie in several batches
            found = Counter()
            for b in C.merge(stripes.combine_chunks().to_batches(max_chunksize=step), 3, 1):
                for r in b.to_pylist():
                    found[r["kind"], r["lang"], r["phrase"].decode()] += r["f"]
            assert {k[1:]: n for k, n in found.items() if k[0] == C.COUNT and " " in k[2]} == want
            assert {k[1]: n for k, n in found.items() if k[0] == C.WORDS} == {r[0]: r[6] for r in plain(rows, 3, 1, share=10**9)} | {"fr": 1}


def test_messy_and_empty_tables(spark, messy, messy_rows, no_docs):
    rows = [(r[1], r[2]) for r in messy_rows]
    assert collected(C.collocations(messy, least=3)) == plain(rows, 3, 3, top=2000)
    assert C.collocations(no_docs).count() == 0


def test_large_counts_are_exact(spark):
    from decimal import Decimal

    a, left, right = 999_999_999_999_999, 10**15 - 1, 10**15
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    score = df.selectExpr("cast(a as decimal(16, 0)) * 1000000 * cast(a as decimal(15, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))").first()[0]
    assert score == Decimal(10**6 * a * a // (left * right))


def test_a_word_with_a_third_of_all_rows(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "concat('the w', id, ' the pair') as text", "'en' as lang")
    got = {r["phrase"]: r["a"] for r in C.collocations(df).collect()}
    assert got == {"the pair": 2000}


def test_tables_that_grow_with_the_corpus_are_not_broadcast(spark, monkeypatch):
    """Their files are small here, as those of a compressed table of many rows are for their rows."""
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    rows = corpus(random.Random(5), 150)
    found = C.collocations(spark.createDataFrame([(i, *r, "p", 1) for i, r in enumerate(rows)], SCHEMA), top=40)
    got = collected(found)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert got == plain(rows, 3, 10, top=40) and "SortMergeJoin" in plan and "Broadcast" not in plan
