"""Embedding of chunks through a pluggable model."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corpusloom.functions.text import WORD


class Embedder(Protocol):
    """What a model has to offer: an id, its dimensions, its input prefixes, its floor, and vectors for texts."""

    id: str
    dimensions: int
    query_prefix: str
    passage_prefix: str
    min_score: float
    #: Most texts of a call of the model.
    batch: int
    #: Whether equal texts of the whole table are worth a shuffle, so that each is embedded once.
    costly: bool

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LoadedEmbedder:
    """An embedder whose model is loaded where it is used: once a worker, by a factory that gives texts to vectors.

    Only the factory and the profile are sent to the executors. Handles stay in the worker's process by id, for all tasks that it runs.
    """

    costly = True

    def __init__(self, id: str, dimensions: int, load: Callable[[], Callable[[list[str]], list[list[float]]]], *, batch: int = 16, min_score: float = 0.0, query_prefix: str = "", passage_prefix: str = ""):
        self.id, self.dimensions, self.load, self.batch, self.min_score = id, dimensions, load, batch, min_score
        self.query_prefix, self.passage_prefix = query_prefix, passage_prefix

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.id not in _handles:
            _handles[self.id] = self.load()
        return _handles[self.id](texts)


_handles: dict[str, Callable[[list[str]], list[list[float]]]] = {}


class HashingEmbedder:
    """Bag of words hashed to signed buckets; deterministic, no model file."""

    batch, costly = 4096, False

    def __init__(self, dimensions: int = 32, min_score: float = 0.0):
        self.id, self.dimensions, self.min_score = f"hash-{dimensions}", dimensions, min_score
        self.query_prefix = self.passage_prefix = ""

    def counts(self, texts: list[str]):
        """A row of signed word counts by bucket for each text."""
        import numpy as np

        out, start = np.zeros((len(texts), self.dimensions, 2), np.int64), 0
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        while start < len(texts):
            before = ends[start] - len(texts[start])
            stop = max(start + 1, int(np.searchsorted(ends, before + GROUP, "right")))
            row, codes = self.coded(texts[start:stop])
            out[start:stop] = np.bincount(row * 2 * self.dimensions + codes, minlength=(stop - start) * 2 * self.dimensions).reshape(stop - start, self.dimensions, 2)
            start = stop
        return (out[:, :, 0] - out[:, :, 1]).astype(float)

    def coded(self, texts: list[str]):
        """The text's number and the code of each word: texts with characters from NEAR on are cut by WORD, and their words' codes are kept."""
        import numpy as np
        import regex

        words, far, rows, codes = regex.compile(WORD), re.compile(f"[{chr(NEAR)}-\U0010ffff]"), [], []
        known = _codes.setdefault(self.dimensions, _Codes(self.dimensions))
        if len(known) > MOST_CODES:
            known.clear()
        near = [t.lower() for t in texts]
        for i, text in enumerate(near):
            if not text.isascii() and far.search(text):
                found, near[i] = words.findall(text), ""
                rows.extend([i] * len(found))
                codes.extend(map(known.__getitem__, found))
        row, hashes = hashed_words(near)
        return np.append(row, np.array(rows, int)), np.append((hashes % self.dimensions * 2 + hashes % 2).astype(int), np.array(codes, int))

    def embed(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = self.counts(texts)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norm == 0, 1, norm)).tolist()


#: Words whose codes a worker keeps from batch to batch.
MOST_CODES = 200_000


class _Codes(dict):
    """Twice a word's bucket, and one more where its sign is minus; each word is hashed once."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, word: str) -> int:
        h = 5381
        for c in word:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        self[word] = code = h % self.dimensions * 2 + h % 2
        return code


_codes: dict[int, _Codes] = {}
#: Characters of texts that are hashed at once, but for single longer texts. Characters before NEAR are looked up in a table of those that WORD has.
GROUP, NEAR = 1 << 20, 0x2100


def hashed_words(texts: list[str]):
    """The text's number and the hash of _Codes of each word of lower-case texts without characters from NEAR on.

    All words are hashed at once. 33 is odd and so has an inverse in 32 bits: by running sums of each character times the inverse's power at
    its place, a word's hash is a difference of two sums times a power of 33.
    """
    import numpy as np

    # each text is followed by a line end, so that words end with it
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 1, bool)
    inside[1:] = _letters()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    row = np.searchsorted(np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1), starts, "right")
    powers = lambda x: np.cumprod(np.append(1, np.full(len(points), x)).astype(np.uint32), dtype=np.uint32)
    of_33, sums = powers(33), np.zeros(len(points) + 1, np.uint32)
    np.cumsum(points * powers(pow(33, -1, 1 << 32))[:-1], dtype=np.uint32, out=sums[1:])
    return row, np.uint32(5381) * of_33[ends - starts] + of_33[ends - 1] * (sums[ends] - sums[starts])


@cache
def _letters():
    """Whether WORD has a character, for those before NEAR."""
    import numpy as np
    import regex

    return np.array([bool(regex.fullmatch(WORD, chr(c))) for c in range(NEAR)])


def embed_chunks(planned: DataFrame, embedder: Embedder, text_column: str = "input") -> DataFrame:
    """planned with an embedding column.

    For a costly model each different text of the table is embedded once and its vector joined to all rows that have it, by a digest.
    In a task equal texts of an Arrow batch are embedded once, and texts go to the model in the order of their length, at most
    `batch` at a time, so that little is padded. A null text is embedded as an empty one.
    """
    if embedder.costly:
        key = F.sha2(F.coalesce(text_column, F.lit("")).cast("binary"), 256)
        texts = planned.groupBy(key.alias("_text")).agg(F.first(F.coalesce(text_column, F.lit(""))).alias("_input"))
        vectors = _embedded(texts, embedder, "_input", StructType([*texts.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))
        return planned.withColumn("_text", key).join(vectors.select("_text", "embedding"), "_text", "left").drop("_text")
    return _embedded(planned, embedder, text_column, StructType([*planned.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def _embedded(df: DataFrame, embedder: Embedder, text_column: str, schema) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            order = sorted(dict.fromkeys(texts), key=len)
            vectors: dict[str, list[float]] = {}
            for at in range(0, len(order), embedder.batch):
                some = order[at : at + embedder.batch]
                vectors.update(zip(some, embedder.embed(some), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([vectors[t] for t in texts], pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def hash_embedded(planned: DataFrame, dims: int, keep: list[str]) -> DataFrame:
    """keep and the hashing embedder's vector of the words of all rows with the same keep.

    A task counts its own rows' words; what is sent is a row of `dims` numbers a row of planned, never a word.
    """
    from corpusloom.functions.vectors import l2_normalize

    model = HashingEmbedder(dims)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = model.counts([t or "" for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(n[:, i]) for i in range(dims))], [*keep, *buckets])

    buckets = [f"_b{i}" for i in range(dims)]
    rows = planned.select(*keep, F.col("input").alias("_text"))
    schema = StructType([*(f for f in rows.schema.fields if f.name != "_text"), *(StructField(b, DoubleType()) for b in buckets)])
    summed = rows.mapInArrow(run, schema).groupBy(*keep).agg(*(F.sum(b).alias(b) for b in buckets))
    return summed.select(*keep, l2_normalize(F.array(*buckets)).alias("embedding"))
