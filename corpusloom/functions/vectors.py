"""Column functions on vectors and the hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import WORD


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """v by its length; a vector of zeros stays as it is."""

    def scaled(x: Column) -> Column:
        # vector and length are bound once: inside a lambda a named expression is computed for each component
        return F.transform(F.array(F.sqrt(dot(x, x))), lambda norm: F.transform(x, lambda c: F.when(norm == 0, c.cast("double")).otherwise(c.cast("double") / norm)))[0]

    return F.transform(F.array(v), scaled)[0]


def djb2(word: Column) -> Column:
    """Unsigned 32-bit hash: h = h * 33 + character, from 5381."""
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + F.ascii(c), F.lit(4294967296)))


def hash_embed(text: Column, dims: int) -> Column:
    """A unit vector of signed word counts in hashed buckets."""
    hashes = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), djb2)
    zero = F.array_repeat(F.lit(0.0), dims)
    counts = F.aggregate(hashes, zero, lambda acc, h: F.transform(acc, lambda x, i: x + F.when(F.pmod(h, F.lit(dims)) == i, F.when(h.bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    return l2_normalize(counts)
