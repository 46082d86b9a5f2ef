"""Packing documents into token sequences by minimum bin slack.

Documents are encoded and cut into pieces of at most `capacity` tokens; only longer documents are cut. Packing sees
nothing but the number of pieces of each length, at most `capacity` numbers whatever the corpus size. A bin is begun
with the longest piece left; a subset-sum dynamic programme over the available lengths, its states the bits of one
integer, finds the fullest combination for the rest of the bin. That combination is taken as often as the counts
allow and removed. Each choice is a recipe: which ranks of which length go to which sequences, at which offset.

Pieces get ranks within their length without gathering a length in one task: numbers within (length, salt), shifted
by the counts of the salts before. The recipes then place every piece in its own task.

Null texts are empty documents: one piece that holds the end id. Repeated rows are documents of their own. An empty
table has no pieces.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.pretokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of every document's ids, the end id included."""
    common.ship(docs.sparkSession)
    end, width = struct.pack("<I", end_id), 4 * capacity

    def cut(batches):
        encode = encoder(tokenizer_path).encode
        for batch in common.bounded(batches, "text"):
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                rows += [(key, at // width, at // 4, len(part) // 4, zlib.crc32(part)) for at in range(0, len(ids), width) if (part := ids[at : at + width])]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination of the counted lengths with the largest sum up to room."""
    states, stages = [1], []
    reach, within = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            step = min(step, left)
            reach |= (reach << length * step) & within
            stages.append((length, step))
            states.append(reach)
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for (length, step), before in zip(reversed(stages), reversed(states[:-1]), strict=True):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + step
            total -= length * step
    return sorted(chosen.items(), reverse=True)


def recipes(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies a sequence, first offset), ordered by length and rank."""
    counts, used, out, sequence = {k: n for k, n in counts.items() if n}, {}, [], 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = dict(fullest({k: n for k, n in counts.items() if n}, capacity - seed))
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times, offset = min(counts[k] // n for k, n in chosen.items()), 0
        for length, copies in sorted(chosen.items(), reverse=True):
            out.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
            counts[length] -= copies * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, *, rows_per_salt: int = 2000) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a stored table: it is read several times."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(common.split_count(pieces, rows_per_salt))).cast("int"))
    groups = common.stored(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = recipes(counts, capacity)
    first = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "salt", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches):
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            past = rank - row[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 2] + past // row[:, 3]), pa.array(row[:, 4] + past % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(common.stored(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col=id_col, text_col=text_col)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
