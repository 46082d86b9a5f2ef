"""Quality rules: base rules, then robust multivariate outliers by language and source.

Each text gets counts (TextCounts) and from them a vector of transformed statistics. For every language and source the
minimum-covariance-determinant estimate is sought: the mean and covariance of that share `coverage` of the group's rows
whose covariance has the least determinant. From several starts (the group's medians, its language's, and small draws
of rows) concentration steps keep the rows of smallest Mahalanobis distance, until the determinant of no start falls any
more; the start with the least determinant is taken. The estimate is then made again from all rows within the 0.975
quantile of its distances (the reweighting step), and a text beyond the chi-square quantile of `tail` is rejected.

Every group has an estimate of its own, whatever its size. To each `strength` made-up rows are added that lie
as the language's medians and spreads say, and a language's medians and spreads are drawn to those of all rows in the same
way: a group of few rows is judged much as its language, one of many rows as itself, and there is no border in
between. Most texts have no sign and no repeated line at all, so that the best subset would have no spread in these
statistics; the square of a statistic's resolution, which is its change by one more sign, line or window in a text of
median size, is therefore added to its variance. Nothing else is set by hand but coverage, strength and tail.

A step is one aggregation to moments by group and start (a fixed number of sums, summed in the map tasks first) and a join of
the estimates to rows. That table has a row a group and start: up to `common.SMALL_ROWS` rows it is broadcast, beyond that rows
are dealt by group and salt, so that a group with a third of all rows is spread over many tasks. All rows take part
in all counts, quantiles and moments.

Null texts are empty and fail the base rules. A null language or source is a group of its own. Repeated rows are rows
of their own and get the same verdict. Verdicts belong to rows, not to ids, which may be null or repeated. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

SIGNS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
STATS = ("log_words", "log_word_length", "sign_share", "dup_line_share", "repeat_share", "upper_share")
STARTS, DRAW_ROWS = 4, 14


def repeated_window_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in windows of `width` words found at least twice, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(key, twice))
    # the windows are compared word by word, so that equal keys of unlike windows don't count
    seen = Counter(tuple(words[i : i + width]) for i in starts.tolist())
    covered = np.zeros(len(words) + 1, np.int64)
    for i in starts.tolist():
        if seen[tuple(words[i : i + width])] > 1:
            covered[i] += 1
            covered[i + width] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six characters of WHITE
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, sum(map(text.count, SIGNS)), len(lines) - len(set(lines)), repeated_window_words(words), len(lines), upper


def with_counts(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a column `name` of the COUNTS of each row."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.bounded(batches, text_col):
            rows = list(zip(*map(text_counts, batch.column(text_col).to_pylist()), strict=True)) or [[]] * len(COUNTS)
            found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rows], COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    kind = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


#: The transformed statistics, in the order of STATS, and the base rules; {p} stands before the names of counts.
STATISTICS = (
    "ln(1 + {p}n_words)",
    "ln(1 + {p}word_chars / greatest({p}n_words, 1))",
    "sqrt({p}n_symbols / greatest({p}word_chars, 1))",
    "sqrt({p}n_dup_lines / greatest({p}n_lines, 1))",
    "sqrt({p}n_repeat_words / greatest({p}n_words, 1))",
    "sqrt({p}n_upper / greatest({p}word_chars, 1))",
)
FAILED = "({p}n_words < 20 or 100 * {p}n_repeat_words > 30 * {p}n_words)"


def chi_square_beyond(degrees: int, x: float) -> float:
    """P(chi-square > x), in closed form for even degrees."""
    if degrees % 2:
        raise ValueError("an even number of degrees is needed")
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(degrees: int, tail: float) -> float:
    """x with P(chi-square > x) = tail, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_beyond(degrees, mid) > tail else (low, mid)
    return high


SIZE = len(STATS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
CENTRE, INVERSE = [f"m{i}" for i in range(SIZE)], [f"w{i}{j}" for i, j in PAIRS]
ESTIMATE = ", ".join(f"{c} double" for c in (*CENTRE, *INVERSE, "logdet"))


def distance(statistics: Sequence[str] = STATS, prefix: str = "") -> Column:
    """Squared Mahalanobis distance of the statistics, from means m and inverse covariance w; one expression of text, which is built fast."""
    off = [f"({c} - {prefix}m{i})" for i, c in enumerate(statistics)]
    return F.expr(" + ".join(f"{1 if i == j else 2}D * {prefix}w{i}{j} * {off[i]} * {off[j]}" for i, j in PAIRS))


def consistency(kept: float) -> float:
    """The covariance of the nearest share `kept` of normal rows is too small by this factor."""
    return kept / (1 - chi_square_beyond(SIZE + 2, chi_square_quantile(SIZE, 1 - kept)))


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products of the statistics by group."""
    sums = [f"sum({s}) as s{i}" for i, s in enumerate(STATS)] + [f"sum({STATS[i]} * {STATS[j]}) as p{i}{j}" for i, j in PAIRS]
    return rows.groupBy(*keys).agg(*map(F.expr, ["count(1) as n", *sums]))


def invert(found: DataFrame, priors: DataFrame, resolution: np.ndarray, strength: float, factor: float = 1.0) -> DataFrame:
    """(group, start, ESTIMATE) from moments by group and start and the groups' priors: one small matrix a row.

    The inverse covariance is divided by `factor`. A group without moments has its prior's estimate.
    """
    names = [f"s{i}" for i in range(SIZE)] + [f"p{i}{j}" for i, j in PAIRS]
    rows = priors.join(found, ["group", "start"], "left").selectExpr("group", "start", "prior", *(f"coalesce(cast({c} as double), 0D) as {c}" for c in ("n", *names)))

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            prior = batch.column("prior").flatten().to_numpy().reshape(rows, 2, SIZE)
            n = batch.column("n").to_numpy() + strength
            mean = (np.stack([batch.column(f"s{i}").to_numpy() for i in range(SIZE)], 1) + strength * prior[:, 0]) / n[:, None]
            spread = np.zeros((rows, SIZE, SIZE))
            for i, j in PAIRS:
                own = strength * (prior[:, 0, i] * prior[:, 0, j] + (prior[:, 1, i] if i == j else 0.0))
                spread[:, i, j] = spread[:, j, i] = (batch.column(f"p{i}{j}").to_numpy() + own) / n - mean[:, i] * mean[:, j]
            spread += np.diag(np.square(resolution))
            inverse = np.linalg.inv(spread) / factor
            columns = [batch.column("group"), batch.column("start"), *(pa.array(mean[:, i]) for i in range(SIZE)), *(pa.array(inverse[:, i, j]) for i, j in PAIRS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.linalg.slogdet(spread)[1])], ["group", "start", *CENTRE, *INVERSE, "logdet"])

    return rows.mapInArrow(run, f"group string, start int, {ESTIMATE}")


def middles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, and the median and squared robust spread of each statistic."""
    found = rows.groupBy(*keys).agg(F.expr("count(1) as n"), *(F.expr(f"percentile_approx({s}, array(0.25D, 0.5D, 0.75D), 10000) as q{i}") for i, s in enumerate(STATS)))
    centre = ", ".join(f"q{i}[1]" for i in range(SIZE))
    spread = ", ".join(f"pow((q{i}[2] - q{i}[0]) / 1.349D, 2)" for i in range(SIZE))
    return found.selectExpr(*keys, "n", f"array({centre}) as centre", f"array({spread}) as spread")


def estimates(sound: DataFrame, *, coverage: float = 0.75, strength: float = 20.0, least_fall: float = 1e-3, salts: int = 16) -> DataFrame:
    """(group, ESTIMATE) from rows (doc_id, group, g1, n_words, word_chars, n_lines, STATS): the reweighted estimate of least determinant.

    sound must be a stored table: it is read several times.
    """
    sizes = sound.agg(*(F.percentile_approx(c, 0.5, 10_000) for c in ("n_words", "word_chars", "n_lines"))).first()
    words, chars, lines = (max(1, x or 1) for x in sizes)
    resolution = np.array([1 / words, 1 / chars, math.sqrt(1 / chars), math.sqrt(1 / lines), math.sqrt(16 / words), math.sqrt(1 / chars)])
    every = middles(sound, []).first()
    drawn = ", ".join(f"(n * {c}[{i}] + {strength * (every[c][i] or 0.0)!r}D) / (n + {strength!r}D)" for c in ("centre", "spread") for i in range(SIZE))
    languages = middles(sound, ["g1"]).selectExpr("g1 as l1", f"array({drawn}) as prior")
    groups = middles(sound, ["group", "g1"]).join(languages, common.same(F.col("g1"), F.col("l1"))).withColumn("draws", F.ceil(F.col("n") / DRAW_ROWS))
    groups = common.stored(groups.select("group", "draws", "prior", F.flatten(F.array("centre", "spread")).alias("own")))
    tries = lambda *starts: groups.withColumn("start", F.explode(F.array(*map(F.lit, starts))))
    priors = tries(*range(STARTS)).select("group", "start", "prior")
    most = STARTS * groups.count()
    joined = lambda small: common.small_join(sound, small, "group", salts, "doc_id", size=most)
    # starts: 0 the group's medians and spreads, 1 its prior, others a draw of some rows each
    medians = tries(0).select("group", "start", F.col("own").alias("prior"))
    place = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string")).cast("binary"))
    drawn_rows = joined(tries(*range(2, STARTS)).select("group", "start", "draws")).filter(F.pmod(place, F.col("draws")) == 0)
    none = moments(sound.limit(0).withColumn("start", F.lit(0)), ["group", "start"])
    active = common.stored(
        invert(none, medians, resolution, strength).union(invert(moments(drawn_rows, ["group", "start"]), priors.filter("start > 0"), resolution, strength))
    )
    ended: list[DataFrame] = []
    while True:
        cuts = joined(active).groupBy("group", "start").agg(F.percentile_approx(distance(), coverage, 10_000).alias("cut"))
        limits = active.join(cuts, ["group", "start"])
        near = joined(limits).filter(distance() <= F.col("cut"))
        before = active.select("group", "start", F.col("logdet").alias("before"))
        new = common.stored(invert(moments(near, ["group", "start"]), priors.join(before, ["group", "start"], "left_semi"), resolution, strength).join(before, ["group", "start"]))
        falls = F.col("logdet") <= F.col("before") - least_fall
        ended.append(new.filter(~falls).drop("before"))
        active = new.filter(falls).drop("before")
        if active.isEmpty():
            break
    best = ended[0]
    for more in ended[1:]:
        best = best.union(more)
    best = best.groupBy("group").agg(F.min_by(F.struct(*CENTRE, *INVERSE), F.struct("logdet", "start")).alias("e")).select("group", "e.*")
    raw = consistency(coverage) if coverage < 1 else 1.0
    near = joined(best).withColumn("start", F.lit(0)).filter(distance() <= chi_square_quantile(SIZE, 0.025) * raw)
    return invert(moments(near, ["group", "start"]), priors.filter("start = 0"), resolution, strength, consistency(0.975)).drop("start")


def with_verdicts(counted: DataFrame, name: str, groups: tuple[str, str], id_col: str, *, coverage: float, strength: float, tail: float, salts: int) -> DataFrame:
    """counted, a stored table with counts in column `name`, with columns {name}_failed, {name}_kept and {name}_distance for every row."""
    g1, g2 = (F.col(c).cast("string") for c in groups)
    sound = counted.select(F.col(id_col).cast("long").alias("doc_id"), g1.alias("g1"), F.to_json(F.struct(g1.alias("a"), g2.alias("b"))).alias("group"), f"{name}.*")
    sound = sound.filter("not " + FAILED.format(p="")).selectExpr("doc_id", "group", "g1", "n_words", "word_chars", "n_lines", *(f"{f.format(p='')} as {s}" for f, s in zip(STATISTICS, STATS, strict=True)))
    found = common.settled(counted.sparkSession, lambda: estimates(common.stored(sound), coverage=coverage, strength=strength, salts=salts))
    small = found.select(F.col("group").alias(f"{name}_group"), F.struct(*CENTRE, *INVERSE).alias(f"{name}_estimate"))
    rows = counted.withColumn(f"{name}_group", F.to_json(F.struct(g1.alias("a"), g2.alias("b"))))
    rows = common.small_join(rows, small, f"{name}_group", salts, F.xxhash64(id_col, name), "left")
    d = F.coalesce(distance([f.format(p=f"{name}.") for f in STATISTICS], f"{name}_estimate."), F.lit(0.0))
    failed = F.expr(FAILED.format(p=f"{name}."))
    return rows.withColumns({f"{name}_failed": failed, f"{name}_distance": d, f"{name}_kept": ~failed & (d <= chi_square_quantile(SIZE, tail))})


def judge(docs: DataFrame, *, coverage: float = 0.75, strength: float = 20.0, tail: float = 1e-9, salts: int = 16, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, COUNTS, base_failed, distance and kept of every row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_cols[0]).alias("g1"), F.col(group_cols[1]).alias("g2"), F.col(text_col).cast("string").alias("text"))
    counted = common.stored(with_counts(narrow, "text", "c").drop("text"))
    rows = with_verdicts(counted, "c", ("g1", "g2"), "doc_id", coverage=coverage, strength=strength, tail=tail, salts=salts)
    return rows.select("doc_id", *(f"c.{c}" for c in COUNTS[:5]), F.col("c_failed").alias("base_failed"), F.col("c_kept").alias("kept"), F.col("c_distance").alias("distance"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, the base rules' verdict and the final verdict for every document."""
    return judge(common.table(spark, sf_dir, "documents"))


def keep_good(docs: DataFrame, *, coverage: float = 0.75, strength: float = 20.0, tail: float = 1e-9, salts: int = 16, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of docs that judge() keeps, each by its own verdict, with all their columns. Texts are written once and not shuffled."""
    plain, (own_id, text, *own_groups) = common.positional(docs, id_col, text_col, *group_cols)
    counted = common.stored(with_counts(plain, text, "counts"))
    rows = with_verdicts(counted, "counts", tuple(own_groups), own_id, coverage=coverage, strength=strength, tail=tail, salts=salts)
    return rows.filter("counts_kept").select(*plain.columns).toDF(*docs.columns)
