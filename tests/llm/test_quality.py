"""Quality rules, classifier and language-model scores against plain computations."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import lm_scoring, quality_classifier, quality_rules
from corpusloom.llm.lattice import SPACE, Lattice, pieces

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def slow_counts(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#x|", "\n", " \t", "é\x1c", "\x85"]), max_size=60).map(" ".join))
def test_text_counts(text):
    assert quality_rules.text_counts(text)[:5] == slow_counts(text)


def test_rules_on_messy_rows(messy, messy_rows):
    rows = quality_rules.judge(messy).collect()
    assert len(rows) == len(messy_rows)
    want = Counter()
    for doc_id, text, *_ in messy_rows:
        n, *_, repeated = counts = slow_counts(text)
        want[(doc_id, *counts, n < 20 or 100 * repeated > 30 * n)] += 1
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == want
    assert all(not r["kept"] for r in rows if r["base_failed"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(kept) > 50
    stay = quality_rules.keep_good(messy)
    assert stay.columns == messy.columns and {r["doc_id"] for r in stay.collect()} == kept


def test_rules_reject_outliers_of_a_group_and_keep_the_rest(spark):
    draw = random.Random(1)
    words = ["there", "river", "along", "simple", "garden", "yellow", "stone"]
    rows = [(i, " ".join(draw.choice(words) + str(draw.randint(0, 999)) for _ in range(draw.randint(40, 400))), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(draw.choice(words) + str(draw.randint(0, 999)) + "###$$" for _ in range(100)), "en", "s") for i in range(20)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(400)) and not any(out[1000 + i] for i in range(20))


def test_no_rows(no_docs, spark):
    assert quality_rules.judge(no_docs).count() == 0
    assert lm_scoring.lm_scores(no_docs, PIECE).count() == 0
    assert quality_classifier.score(no_docs, None).count() == 0


def test_chi_square():
    assert abs(quality_rules.chi_square_quantile(2, 0.05) - 5.991465) < 1e-5
    assert abs(quality_rules.chi_square_quantile(6, 0.01) - 16.811894) < 1e-5


def rated(spark):
    draw = random.Random(3)
    bad, poor = ["awful", "nasty", "vile"], ["###", "$$$"]
    base = [f"w{i}" for i in range(300)]
    rows, ratings = [], []
    for i in range(900):
        words = [draw.choice(base) for _ in range(60)]
        grade = (0, 1, 2, 2)[i % 4]
        if grade == 0:
            words[draw.randrange(60)] = draw.choice(bad)
        if grade == 1:
            words = [w + draw.choice(poor) for w in words]
        rows.append((i, " ".join(words)))
        ratings.append((i, grade))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*ratings, (None, 1), (5, None)], "doc_id long, grade int")


def test_classifier_orders_grades_and_holds_out(spark, messy):
    docs, ratings = rated(spark)
    model = quality_classifier.train(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    rows = quality_classifier.score(docs, model).join(ratings, "doc_id").filter("grade is not null").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([r["kept"] == (r["grade"] == 2) for r in held]) > 0.97
    means = [np.mean([r["expected_grade"] for r in held if r["grade"] == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    again = quality_classifier.train(docs.repartition(7), ratings.repartition(3))
    assert np.allclose(again.weights, model.weights)
    stay = quality_classifier.keep_good(messy, model)
    assert stay.columns == messy.columns
    verdict = quality_classifier.score(messy, model).collect()
    assert stay.count() == sum(r["kept"] for r in verdict)
    assert not any(r["kept"] for r in verdict if r["doc_id"] in (105, 106, 107))


def test_classifier_without_ratings_keeps_texts_with_words(messy, spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality_classifier.train(messy, none)
    assert model is None
    rows = quality_classifier.score(messy, model).collect()
    assert {r["kept"] for r in rows if r["doc_id"] == 106} == {False} and {r["kept"] for r in rows if r["doc_id"] == 1} == {True}


def test_lattice_sum_is_the_sum_over_all_segmentations():
    v = pieces(PIECE)
    table = dict(zip(v.texts, v.scores, strict=True))

    def total(s):
        out = [0.0] + [-np.inf] * len(s)
        for i in range(len(s)):
            if s[i] not in table:
                out[i + 1] = np.logaddexp(out[i + 1], out[i] + v.byte_score * len(s[i].encode()))
            for n in range(1, v.longest + 1):
                if i + n <= len(s) and s[i : i + n] in table:
                    out[i + n] = np.logaddexp(out[i + n], out[i] + table[s[i : i + n]])
        return out[-1]

    words = [SPACE + w for w in ("the", "thought", "日本☃x", "q", "anderstanding", "ab" * 150)]
    lattice = Lattice(v, words)
    got = lattice.totals(lattice.edge_scores(v.scores, v.byte_score))
    assert np.allclose(got, [total(w) for w in words])
    uses = lattice.expected(lattice.edge_scores(v.scores, v.byte_score), np.ones(len(words)))
    assert abs((uses * lattice.length).sum() - sum(map(len, words))) < 1e-6


def test_lm_scores(messy, messy_rows):
    rows = lm_scoring.lm_scores(messy, PIECE, block_docs=25).collect()
    assert len(rows) == len(messy_rows)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [w for w in (t or "").encode().lower().split()] + [None]
    c = Counter(w for i, t, *_ in messy_rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t, *_ in messy_rows:
        ts = tokens(t)
        want.setdefault(i, []).append((len(ts), sum(c[w] > 0 for w in ts), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts), 6)))
    got = {}
    for r in rows:
        assert r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) and r["score"] < 0
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def plain_spelling(word, model, v):
    """Probability of a word's spelling and the expected number of its pieces, by a loop over prefixes."""
    s, table = SPACE + word, dict(zip(v.texts, np.exp(model.scores), strict=True))
    total, many = [1.0] + [0.0] * len(s), [0.0] * (len(s) + 1)
    for i in range(len(s)):
        edges = [(n, table[s[i : i + n]], 1) for n in range(1, v.longest + 1) if i + n <= len(s) and s[i : i + n] in table]
        if s[i] not in table:
            k = len(s[i].encode())
            edges.append((1, math.exp(k * model.byte_score), k))
        for n, p, k in edges:
            total[i + n] += total[i] * p
            many[i + n] += p * (many[i] + k * total[i])
    return total[-1] * math.exp(model.stop), many[-1] / total[-1]


def test_scores_equal_brute_force(spark):
    draw = random.Random(2)
    parts = ["the", "an", "er", "ing", "日本", "☃", "q", "Tion"]
    rows = [(i, " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(draw.randint(0, 12)))) for i in range(40)] + [(None, None)]
    tokens = [[w.lower() for w in (t or "").split()] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens, strict=True) if not lm_scoring.is_held_out(i)]
    c = Counter(w for t in train for w in t)
    ends, n = len(train), sum(c.values()) + len(train)
    v = pieces(PIECE)
    first = lm_scoring.PieceModel(v)
    used = sum(plain_spelling(w, first, v)[1] for w in c)
    model = lm_scoring.PieceModel(v, (used - len(c) + 1) / (used + 2))
    end = (ends + 1) / (n + 2)
    spelling = {w: (1 - end) * plain_spelling(w, model, v)[0] for t in tokens for w in t} | {None: end}
    c[None] = ends

    def score(text, counts, total, share, strength):
        seen, out = Counter(), 0.0
        for i, w in enumerate([*text, None]):
            out += math.log10((strength * ((1 - share) * counts[w] / total + share * spelling[w]) + seen[w]) / (strength + i))
            seen[w] += 1
        return out

    best = max(lm_scoring.GRID, key=lambda g: sum(score(t, c - Counter([*t, None]), max(n - len(t) - 1, 1), *g) for t in train))
    want = [score(t, c, n, *best) for t in tokens]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_docs in (7, 4000):
        got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(df, PIECE, block_docs=block_docs).collect()}
        assert np.allclose([got[i] for i, _ in rows], want)


def test_scores_of_words_too_long_for_a_double(spark):
    held = next(i for i in range(9, 99) if lm_scoring.is_held_out(i))
    rows = [(i, "common words of all") for i in range(8)] + [(held, "z" * 5000 + " common")]
    out = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECE).collect()
    assert all(math.isfinite(r["score"]) for r in out) and min(r["score"] for r in out) < -1000


def test_texts_of_known_words_score_above_the_base(spark):
    draw = random.Random(6)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "green") for b in ("s", "ed", "ing", "ly", "er")]
    rows = [(i, " ".join(draw.choices(draw.sample(words, 6), k=60))) for i in range(120)]
    out = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), PIECE).collect()
    for held in (False, True):
        own = [r for r in out if r["held_out"] == held and r["n_known"] == r["n_tokens"]]
        assert len(own) > 5 and sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_word_probabilities_sum_to_one_at_most():
    """G over all strings of a tiny vocabulary: the first and further pieces and the stop make a distribution."""
    v = pieces(PIECE)
    model = lm_scoring.PieceModel(v)
    first = np.array([t.startswith(SPACE) for t in v.texts])
    begin, going = np.exp(model.scores[first]).sum(), np.exp(model.scores[~first]).sum() + 256 * math.exp(model.byte_score)
    assert abs(begin - 1) < 1e-9 and abs(going + math.exp(model.stop) - 1) < 1e-9


def test_held_out_rule_matches_spark(spark):
    ids = spark.range(50)
    rows = ids.select("id", (F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(7)) == 2).alias("h")).collect()
    assert all(r["h"] == lm_scoring.is_held_out(r["id"]) for r in rows)


def plain_mcd(x, ids, m0, t, d, coverage, strength, own):
    """Minimum covariance determinant of one group by the definition, over the same starts."""
    n, p = x.shape

    def est(rows, m0=m0, t=t):
        k = len(rows) + strength
        mean = (rows.sum(0) + strength * m0) / k
        s = (rows.T @ rows + strength * (np.diag(t) + np.outer(m0, m0))) / k - np.outer(mean, mean) + np.diag(d**2)
        return mean, np.linalg.inv(s), np.linalg.slogdet(s)[1]

    far = lambda e: np.einsum("ij,jk,ik->i", x - e[0], e[1], x - e[0])
    draws = math.ceil(n / quality_rules.DRAW_ROWS)
    chosen = [[zlib.crc32(f"{i}:{k}".encode()) % draws == 0 for i in ids] for k in range(2, quality_rules.STARTS)]
    best = None
    for e in [est(x[:0], *own), est(x[:0]), *(est(x[np.array(c)]) for c in chosen)]:
        while True:
            dist, last = far(e), e[2]
            e = est(x[dist <= np.sort(dist)[math.ceil(coverage * n) - 1]])
            if e[2] > last - 1e-3:
                break
        if best is None or e[2] < best[2]:
            best = e
    near = far(best) <= quality_rules.chi_square_quantile(p, 0.025) * quality_rules.consistency(coverage)
    return far(est(x[near])) / quality_rules.consistency(0.975)


def test_verdicts_equal_a_plain_minimum_covariance_determinant(spark):
    draw = random.Random(12)
    words = ["there", "river", "along", "simple", "Garden", "yellow", "stone", "a"]
    rows = []
    for i in range(330):
        n = draw.randint(25, 300)
        junk = "##$" if i % 11 == 0 else ""
        text = " ".join(draw.choice(words) + str(draw.randint(0, 999)) + junk + ("\n" if draw.random() < 0.05 else "") for _ in range(n))
        rows.append((i, text, "en" if i % 3 else "de", "s" if i < 300 else f"t{i % 7}"))
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    counts = np.array([quality_rules.text_counts(t) for _, t, _, _ in rows], float)
    w, c, s, dup, rep, li, up = counts.T
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    x = np.stack([np.log1p(w), np.log1p(c / np.maximum(w, 1)), share(s, c), share(dup, li), share(rep, w), share(up, c)], 1)
    ok = ~((w < 20) | (100 * rep > 30 * w))
    at = lambda v, q: np.sort(v, 0)[max(0, math.ceil(q * len(v)) - 1)]
    mid = lambda v: (at(v, 0.5), ((at(v, 0.75) - at(v, 0.25)) / 1.349) ** 2)
    words_, chars, lines = (at(counts[ok][:, k], 0.5) for k in (0, 1, 5))
    d = np.array([1 / words_, 1 / chars, chars**-0.5, lines**-0.5, (16 / words_) ** 0.5, chars**-0.5])
    every, strength = mid(x[ok]), 20.0
    for lang, source in {(r[2], r[3]) for r in rows}:
        in_lang = ok & np.array([r[2] == lang for r in rows])
        m, v = mid(x[in_lang])
        k = in_lang.sum()
        prior = [(k * a + strength * b) / (k + strength) for a, b in zip((m, v), every, strict=True)]
        own = in_lang & np.array([r[3] == source for r in rows])
        far = plain_mcd(x[own], np.flatnonzero(own), *prior, d, 0.75, strength, mid(x[own]))
        assert np.allclose([got[i]["distance"] for i in np.flatnonzero(own)], far, rtol=1e-6)
        assert [got[i]["kept"] for i in np.flatnonzero(own)] == (far <= quality_rules.chi_square_quantile(6, 1e-9)).tolist()


def test_verdicts_belong_to_rows(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, "en", "s"), (1, "short", "en", "s"), (None, good, None, "s"), (None, None, None, None), (None, "short", "en", "s")]
    out = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("counts", F.lit(1)))
    assert sorted((r["doc_id"] or 0, r["text"], r["counts"]) for r in out.collect()) == [(0, good, 1), (1, good, 1)]


def test_every_set_of_grades_has_a_verdict(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more text") for i in range(40)] + [(3, "another text of three")], "doc_id long, text string")
    kept = lambda grades: [r["kept"] for r in quality_classifier.score(docs, quality_classifier.train(docs, spark.createDataFrame(grades, "doc_id long, grade int"))).collect()]
    assert not any(kept([(i, i % 2) for i in range(40)]))  # no text reaches grade 2
    assert not any(kept([(i, 0) for i in range(40)])) and not any(kept([(i, 1) for i in range(40)]))
    assert all(kept([(i, 2) for i in range(40)])) and all(kept([(i, 3) for i in range(40)]))
    assert len(kept([(i, i % 5 - 1) for i in range(40)])) == 41
    assert all(kept([(999, 1)]))  # a rating of no text


def test_fit_equals_a_plain_optimiser():
    draw = np.random.default_rng(4)
    n, m = 400, 12
    x = draw.random((n, m)) < 0.3
    s = x @ draw.standard_normal(m) + draw.logistic(size=n)
    grades = np.digitize(s, [-0.5, 1.0])
    row, flat = np.nonzero(x)
    model = quality_classifier.fit_ordinal(flat * 7, row, grades, least_documents=1)

    def objective(w, t):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        p = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), 1)
        return np.log(p[np.arange(n), grades] - p[np.arange(n), grades + 1]).mean() - 0.01 / 20 * (w @ w)

    theta = np.zeros(m + 2)
    theta[m:] = -1, 1
    value = lambda v: objective(v[:m], v[m:])
    for _ in range(1500):  # plain gradient steps by differences
        slope = np.array([(value(theta + e) - value(theta - e)) / 2e-5 for e in 1e-5 * np.eye(m + 2)])
        theta = theta + 2.0 * slope
    assert abs(objective(model.weights, model.thresholds) - value(theta)) < 1e-4
    assert np.abs(model.weights - theta[:m]).max() < 0.05 and np.abs(model.thresholds - theta[m:]).max() < 0.05
