"""A repeatable synthetic corpus, made in parallel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the words that make a corpus byte-for-byte repeatable.
WORDS = (
    "note idea project meeting plan search index vector query chunk memory disk vault semantic model embedding token cache "
    "latency bottleneck performance data growth scale user document folder markdown title body tag space attachment image "
    "render editor keyboard shortcut palette recent draft archive review release feature bug fix refactor test benchmark report "
    "baseline budget regression proyecto reunión idea nota búsqueda índice rendimiento crecimiento datos"
).split(" ")
WORDS_PER_CHUNK = 96
MASK = 0xFFFFFFFF


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c computed once, however often use names it."""
    return F.transform(F.array(c), use)[0]


def multiply32(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of unsigned 32-bit values, in 16-bit halves so that no product overflows a bigint."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftright(a, 16).bitwiseAND(F.lit(0xFFFF)) * b.bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def draw(number: Column, seed: int) -> Column:
    """The `number`-th output (from 1) of the seeded generator as an unsigned 32-bit value: its state is a counter.

    Each step is bound: it is named several times by the next, and the steps before it would be computed so many times over.
    """
    shifted = lambda x, n: x.bitwiseXOR(F.shiftrightunsigned(x, n))
    product = lambda x, y: bound(x, lambda a: bound(y, lambda b: multiply32(a, b)))
    start = F.pmod(F.lit(seed & MASK) + number * F.lit(0x6D2B79F5), F.lit(1 << 32))
    first = bound(start, lambda a: product(shifted(a, 15), a.bitwiseOR(F.lit(1))))
    second = bound(first, lambda t: (t + product(shifted(t, 7), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)).bitwiseXOR(t))
    return bound(second, lambda t: shifted(t, 14))


def generate_corpus(spark: SparkSession, n: int | DataFrame, chunks: int = 4, seed: int = 1) -> DataFrame:
    """(id, title, body) of n notes, or of one note for each row of a table with a number `i`."""
    rows = spark.range(n).withColumnRenamed("id", "i") if isinstance(n, int) else n
    words = F.array(*(F.lit(w) for w in WORDS))
    count = max(1, chunks) * WORDS_PER_CHUNK
    first = F.col("i") * (count + 1) + 1
    pick = lambda number: words[F.floor(draw(number, seed).cast("double") * len(WORDS) / float(1 << 32)).cast("int")]
    part = lambda k: F.when((k > 0) & (k % 12 == 0), F.concat(pick(first + 1 + k), F.lit(" .\n"))).otherwise(pick(first + 1 + k))
    body = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), part), " ")
    return rows.select(F.concat(F.lit("note-"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("id"), F.concat(F.lit("Note "), F.col("i").cast("string"), F.lit(" "), pick(first)).alias("title"), body.alias("body"))
