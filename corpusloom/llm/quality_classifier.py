"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words without punctuation, ASCII letters in lower case, the beginnings of words
(five and seven bytes), and a few bins of its shape (signs, capitals, repeated words). One weight a feature gives one score s for all grades, and ordered thresholds
cut it: P(grade > k) = logistic(s - threshold k). The expected grade and the tail probability P(grade >= select)
follow; a text is kept if that probability is `least_probability` or more.

Fitting: of the rated documents, those with crc32(id) % 5 = 0 are left out for measuring; of the others at most
`sample_rows`, in the order of a hash of the id, are taken. That bound is the documented limit of what meets in one task for the fit (texts aren't cut, so that long ones weigh more in it); only the model comes to the
driver. Features in fewer than `least_documents` of them are dropped; weights have an L2 penalty and are found by
gradient steps over the whole sample (Adam). Scoring covers every row in its own task and shuffles nothing.

Grades are integers from 0 (lower ones count as 0); a document rated more than once has its lowest grade; null grades and ids don't count. Of
several texts of one rated id the one with the smallest digest is taken. Null and empty texts and texts without a word are not
kept. Without any rated text every text with a word is kept and its grade is null. Ratings of one grade only tell nothing of
texts: every text then has that grade. A grade that no rated text reaches has the tail probability 0, so that nothing is kept where
`select` is beyond all ratings. Repeated rows get the same verdict each; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

BUCKETS = 1 << 26
PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
SPLIT = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
SIGNS = "#*$%&|<>"
SCORED = "doc_id long, score double, expected_grade double, tail_probability double, kept boolean"


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed features of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(SPLIT).lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    distinct = set(words)
    kinds = len(distinct)
    distinct |= {b"\x02" + w[:5] for w in distinct if len(w) > 5} | {b"\x03" + w[:7] for w in distinct if len(w) > 7}
    n, chars = len(words), max(1, len(text))
    share = lambda part, whole: b"%d" % min(9, int(20 * part / whole))
    distinct.add(b"\x01sign" + share(sum(map(text.count, SIGNS)), chars))
    distinct.add(b"\x01shout" + share(text.count("!"), n))
    distinct.add(b"\x01upper" + share(sum(map(text.count, "AEIOUNRST")), chars))
    distinct.add(b"\x01repeat" + b"%d" % int(10 * kinds / n) if n >= 20 else b"\x01short")
    hashed = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    return np.unique(hashed & (BUCKETS - 1))


@dataclass
class OrdinalModel:
    """Weights of sorted feature buckets, and ordered thresholds between grades."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, found)
        at[at == len(self.buckets)] = 0
        return float(self.weights[at][self.buckets[at] == found].sum()) if len(self.buckets) else 0.0

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -500, 500)))

    def tail(self, scores: np.ndarray, select: int) -> np.ndarray:
        """P(grade >= select) for each score."""
        if select < 1 or select > len(self.thresholds):
            return np.full(len(scores), float(select < 1))
        return self.beyond(scores)[:, select - 1]


def fit_ordinal(flat: np.ndarray, row: np.ndarray, grades: np.ndarray, *, least_documents: int = 5, penalty: float = 0.01, steps: int = 400, rate: float = 0.05) -> OrdinalModel:
    """Mean log likelihood less penalty / 20 times the squared weights, at its largest, from feature buckets and the row of each. Thresholds are a first value and logs of the gaps, so they stay ordered."""
    grades = np.maximum(grades, 0)
    n, levels = len(grades), int(grades.max())
    if len(set(grades.tolist())) == 1:  # thresholds far below or above every score
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.full(levels, -np.inf))
    buckets, seen = np.unique(flat, return_counts=True)
    buckets = buckets[(seen >= least_documents) & (seen < n)]
    at = np.searchsorted(buckets, flat)
    use = at < len(buckets)
    use[use] = buckets[at[use]] == flat[use]
    row, at = row[use], at[use]
    share = np.array([(grades > k).mean() for k in range(levels)])
    start = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    theta = np.concatenate((np.zeros(len(buckets)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    mean, square, w = np.zeros(len(theta)), np.zeros(len(theta)), len(buckets)
    for t in range(1, steps + 1):
        gaps = np.exp(theta[w + 1 :])
        limits = theta[w] + np.concatenate(([0.0], np.cumsum(gaps)))
        s = np.bincount(row, theta[:w][at], n)
        above = 1 / (1 + np.exp(-np.clip(s[:, None] - limits, -30, 30)))
        slope = above * (1 - above)
        padded = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), 1)
        own = np.maximum(padded[np.arange(n), grades] - padded[np.arange(n), grades + 1], 1e-12)
        # derivative of log P(grade) by P(grade > k) for the two bounds of the grade
        by = np.zeros((n, levels))
        low, high = grades > 0, grades < levels
        by[np.flatnonzero(low), grades[low] - 1] += 1 / own[low]
        by[np.flatnonzero(high), grades[high]] -= 1 / own[high]
        by *= slope / n
        pull = by.sum(0)
        later = np.cumsum(pull[::-1])[::-1]
        step = np.concatenate((np.bincount(at, by.sum(1)[row], w) - penalty * theta[:w] / 10, [-pull.sum()], -later[1:] * gaps))
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
        theta = theta + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    limits = theta[w] + np.concatenate(([0.0], np.cumsum(np.exp(theta[w + 1 :]))))
    return OrdinalModel(buckets, theta[:w], limits)


def train(docs: DataFrame, ratings: DataFrame, *, sample_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> OrdinalModel | None:
    common.ship(docs.sparkSession)
    ids, grade = F.col(id_col).cast("long").alias("doc_id"), F.col(grade_col).cast("int").alias("grade")
    rated = ratings.select(ids, grade).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(ids, F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # sample_rows at most

    def run(batches):
        for batch in common.bounded(batches, "text"):
            own = batch.column("text").to_pylist()
            digests = [hashlib.md5((t or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in own]
            found = pa.array([features(t).astype(np.int32) for t in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(digests), found], ["doc_id", "grade", "digest", "features"])

    read = texts.mapInArrow(run, "doc_id long, grade int, digest binary, features array<int>")
    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        found = rows.column("features").combine_chunks()
        model = fit_ordinal(found.flatten().to_numpy(), np.repeat(np.arange(len(found), dtype=np.int32), found.value_lengths().to_numpy()), rows.column("grade").to_numpy().astype(int))
        return pa.table([pa.array([x], pa.list_(t)) for x, t in ((model.buckets, pa.int64()), (model.weights, pa.float64()), (model.thresholds, pa.float64()))], ["buckets", "weights", "thresholds"])

    # the bounded sample meets in one task, and only the model comes to the driver
    one = read.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("features", "digest").alias("features")).withColumn("one", F.lit(0))
    got = one.groupBy("one").applyInArrow(fit, "buckets array<long>, weights array<double>, thresholds array<double>").first()
    return got and OrdinalModel(*(np.array(x, t) for x, t in zip(got, (np.int64, float, float), strict=True)))


def judge_texts(texts: list[str | None], model: OrdinalModel | None, select: int, least: float):
    """score, expected grade, tail probability and verdict of each text."""
    found = [features(t) for t in texts]
    some = np.array([len(f) > 0 for f in found], bool)
    if model is None:
        return None, None, None, some
    scores = np.array([model.score(f) for f in found])
    beyond = model.beyond(scores)
    tail = model.tail(scores, select)
    return scores, beyond.sum(1), tail, some & (tail >= least)


def score(docs: DataFrame, model: OrdinalModel | None, *, select: int = 2, least_probability: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade, tail_probability and kept of every row."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.bounded(batches, "text"):
            parts = judge_texts(batch.column("text").to_pylist(), model, select, least_probability)
            columns = [pa.nulls(batch.num_rows, pa.float64()) if p is None else pa.array(p) for p in parts[:3]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(parts[3])], ["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model: OrdinalModel | None, *, select: int = 2, least_probability: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    common.ship(docs.sparkSession)
    plain, (text,) = common.positional(docs, text_col)

    def run(batches):
        for batch in common.bounded(batches, text):
            yield batch.filter(pa.array(judge_texts(batch.column(text).to_pylist(), model, select, least_probability)[3]))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from labels of quality and toxicity: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 0).otherwise(1 + F.col("quality")).cast("int").alias("grade"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model fitted to the labels."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, graded(common.table(spark, sf_dir, "labels"))))
