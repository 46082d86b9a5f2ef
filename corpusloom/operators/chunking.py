"""Overlapping word windows of notes, and the plan of what is embedded."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import WHITE, WHITES, trim_white


def chunks(c: Column, size: int = 120, overlap: int = 24) -> Column:
    """An array of (idx, text, offset, length): windows of `size` words every `size - overlap`, as exact slices of the text.

    The text is cut once into pieces of the common divisor's number of words; windows are runs of pieces.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("a window must be longer than its overlap")
    unit = gcd(size, step)
    width, stride = size // unit, step // unit
    pieces = F.regexp_extract_all(c, F.lit(f"(?:[^{WHITE}]++[{WHITE}]*+){{1,{unit}}}"), F.lit(0))
    lead = F.length(c) - F.length(F.regexp_replace(c, f"^[{WHITE}]+", ""))

    def windows(p: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(p) - width) / stride)).cast("int")
        # characters before each piece, so that a window's offset is looked up and not summed anew
        before = F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x)))

        def window(k: Column, before: Column) -> Column:
            text = F.regexp_replace(F.array_join(F.slice(p, k * stride + 1, F.lit(width)), ""), f"[{WHITE}]+$", "")
            return F.struct(k.alias("idx"), text.alias("text"), (lead + F.element_at(before, k * stride + 1)).alias("offset"), F.length(text).alias("length"))

        listed = F.transform(F.array(before), lambda b: F.transform(F.sequence(F.lit(0), last), lambda k: window(k, b)))
        return F.when(F.size(p) > 0, listed[0])

    # the pieces are bound once: a column named twice would be split twice
    return F.transform(F.array(pieces), windows)[0]


def windows(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a text."""
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _in_word[points if points.itemsize == 1 else np.minimum(points, len(_in_word) - 1)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends, step = edges[::2], edges[1::2], size - overlap
    if not len(starts):
        return []
    first = np.arange(max(0, -(-(len(starts) - size) // step)) + 1) * step
    return list(zip(starts[first].tolist(), ends[np.minimum(first + size, len(starts)) - 1].tolist(), strict=True))


#: Whether a character is part of a word, by its code; the last one stands for all that follow. White space lies before it.
_in_word = np.ones(1 << 16, bool)
_in_word[[ord(c) for c in WHITES]] = False


def chunk_text(df: DataFrame, column: str, keep: list[str], size: int = 120, overlap: int = 24) -> DataFrame:
    """keep and (idx, text, offset, length) of the windows of a text, with the same rows as inline(chunks()).

    Windows are cut by the places of words over Arrow batches: the arrays of words that column functions build for it cost several times the
    cutting itself.
    """
    if size <= overlap:
        raise ValueError("a window must be longer than its overlap")
    rows = df.select(*keep, F.coalesce(F.col(column), F.lit("")).alias("_text"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "_text"), *T._parse_datatype_string("idx int, text string, offset int, length int").fields])

    def run(batches):
        for batch in batches:
            row, idx, texts, offset = [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                for k, (start, end) in enumerate(windows(text, size, overlap)):
                    row.append(i)
                    idx.append(k)
                    texts.append(text[start:end])
                    offset.append(start)
                if len(row) > 4000:
                    yield made(batch, row, idx, texts, offset)
                    row, idx, texts, offset = [], [], [], []
            yield made(batch, row, idx, texts, offset)

    def made(batch, row, idx, texts, offset):
        import pyarrow as pa

        kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in keep]
        columns = [pa.array(idx, pa.int32()), pa.array(texts, pa.string()), pa.array(offset, pa.int32()), pa.array(list(map(len, texts)), pa.int32())]
        return pa.RecordBatch.from_arrays([*kept, *columns], [*keep, "idx", "text", "offset", "length"])

    return rows.mapInArrow(run, schema)


def plan_chunks(notes: DataFrame, passage_prefix: str = "") -> DataFrame:
    """(note_id, idx, kind, text, offset, length, input): the title by itself as number -1, then the body's windows."""
    title = trim_white(F.coalesce("title", F.lit("")))
    n = notes.select(F.col("id").alias("note_id"), title.alias("title"), "body")
    head = n.filter("title <> ''").select("note_id", F.lit(-1).alias("idx"), F.lit("title").alias("kind"), F.col("title").alias("text"), F.lit(0).alias("offset"), F.lit(0).alias("length"), F.concat(F.lit(passage_prefix), "title").alias("input"))
    body = chunk_text(n, "body", ["note_id", "title"])
    given = F.when(F.col("title") != "", F.concat_ws("\n\n", "title", "text")).otherwise(F.col("text"))
    return head.unionByName(body.select("note_id", "idx", F.lit("body").alias("kind"), "text", "offset", "length", F.concat(F.lit(passage_prefix), given).alias("input")))
