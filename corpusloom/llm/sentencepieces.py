"""SentencePiece encoding and decoding by suffix-array matching.

Texts are encoded as SentencePiece does without normalisation: a space is put before the text, spaces become the
piece marker, characters outside the vocabulary become byte pieces. The ids are the library's own: edges are relaxed in the order of
position, each from nodes whose last piece it may follow under the merge order that the file's scores give (lattice.py).

Chunks already matched are remembered by the worker up to a bound of characters, then forgotten, and texts are matched in
batches bounded in bytes: memory is bounded and results are not touched. Null texts have null ids and decode to null, empty
texts have no ids. A text that holds the marker
character itself decodes with a space in its place, as in SentencePiece; every other text comes back whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.lattice import SPACE, Lattice, chunks_of, pieces, portions

#: Characters of the chunks a worker remembers.
CACHE_CHARS = 3_000_000

_known: dict[str, dict[str, bytes]] = {}
_held: dict[str, int] = {}


def encode_texts(texts: list[str | None], model_file: str) -> list[bytes | None]:
    """ids of each text, as little-endian signed 32-bit integers."""
    cache = _known.setdefault(model_file, {})
    if _held.get(model_file, 0) > CACHE_CHARS:
        cache.clear()
        _held[model_file] = 0
    split = [None if t is None else chunks_of(" " + t) if t else [] for t in texts]
    new = sorted({c for chunks in split if chunks for c in chunks}.difference(cache))
    vocabulary = pieces(model_file)
    _held[model_file] = _held.get(model_file, 0) + sum(map(len, new))
    for some in portions(new):
        lattice = Lattice(vocabulary, [c.replace(" ", SPACE) for c in some])
        for c, ids in zip(some, lattice.best_paths(), strict=True):
            cache[c] = ids.astype("<i4").tobytes()
    return [None if chunks is None else b"".join(map(cache.__getitem__, chunks)) for chunks in split]


def listed(found: list[bytes | None], sizes: list[int]) -> pa.Array:
    """Lists of ids as an Arrow array; null stays null."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x or b"" for x in found), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([x is None for x in found], pa.bool_()))


def decode_ids(ids, model_file: str) -> str:
    data = b"".join(map(pieces(model_file).spelled.__getitem__, ids))
    return data.decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and n_tokens of every row."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.bounded(batches, "text"):
            found = encode_texts(batch.column("text").to_pylist(), model_file)
            sizes = [len(x or b"") // 4 for x in found]
            ids = listed(found, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([None if x is None else len(x) // 4 for x in found], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    common.ship(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.values.to_pylist(), ids.offsets.to_pylist()
            texts = [decode_ids(flat[a:b], model_file) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_verify(docs: DataFrame, model_file: str) -> DataFrame:
    """encode(), with a column that tells whether decoding gives the text back."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in common.bounded(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = encode_texts(texts, model_file)
            sizes = [len(x or b"") // 4 for x in found]
            back = [None if x is None else decode_ids(memoryview(x).cast("i"), model_file) for x in found]
            ids = listed(found, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array([None if x is None else n for x, n in zip(found, sizes, strict=True)], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                ["doc_id", "ids", "n_tokens", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, with its ids, and decoded again."""
    import public_tokenizers

    return encode_and_verify(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
