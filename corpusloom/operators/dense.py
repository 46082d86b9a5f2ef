"""Exact vector search for query sets of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import dot

#: Chunks of a cell and queries of a group that meet in one task, where all pairs are asked and where only the first k are. Where all
#: are, up to a million rows of some 40 bytes leave a task, and are held twice while they are joined to a table.
CELL_CHUNKS, GROUP_QUERIES = {False: 4096, True: 65_536}, {False: 256, True: 4096}


def same_model(index: DataFrame, model_id: str, dimensions: int) -> DataFrame:
    return index.filter((F.col("model_id") == model_id) & (F.col("dimensions") == dimensions))


def _grid(index: DataFrame, queries: DataFrame, bounded: bool, cell_chunks: int | None, group_queries: int | None):
    """index and queries dealt to cells and groups: every chunk meets every query in the task of its cell and the query's group.

    All chunks of a note lie in one cell. The index is sent once for each group of queries, the queries once for each cell.
    """
    cells = max(1, -(-index.count() // (cell_chunks or CELL_CHUNKS[bounded])))
    groups = max(1, -(-queries.count() // (group_queries or GROUP_QUERIES[bounded])))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunks = index.withColumn("_cell", F.pmod(F.xxhash64("note_id"), F.lit(cells)).cast("int")).withColumn("_group", every(groups))
    asked = queries.withColumn("_group", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")).withColumn("_cell", every(cells))
    return chunks.groupBy("_cell", "_group").cogroup(asked.groupBy("_cell", "_group"))


def _vectors(index: DataFrame, name: str) -> DataFrame:
    return index.filter(F.col(name).isNotNull()).withColumn(name, F.transform(name, lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def best_chunk(index: DataFrame, queries: DataFrame, min_score: float | None = None, k: int | None = None, *, cell_chunks: int | None = None, group_queries: int | None = None) -> DataFrame:
    """(qid, note_id, idx, score): each note's best chunk for each query (qid, vector), of equal ones the first.

    Cells of the index and groups of queries meet by one matrix product a task; nothing is collected. Only a note's best chunk
    at min_score or above leaves a task, with k only the best k notes of each query. Scores are sums over the shorter length,
    rounded to 9 places before they are compared, so that equal chunks stay equal. Null vectors have no score; null and NaN
    components count as zero.
    """
    return search_cells(index, queries, min_score, k, cell_chunks=cell_chunks, group_queries=group_queries).filter("n_before is null").drop("n_before")


def search_cells(index: DataFrame, queries: DataFrame, min_score: float | None = None, k: int | None = None, *, cell_chunks: int | None = None, group_queries: int | None = None) -> DataFrame:
    """best_chunk() and, for queries with `probes`, an array of (note_id, score), rows (qid, note_id, n_before) that count the
    notes of a cell that rank before a probe: at min_score or above, of a better score or of the same and a smaller id."""
    kind = index.schema["note_id"].dataType.simpleString()
    columns = ["qid", "vector", *(["probes"] if "probes" in queries.columns else [])]
    chunks = _vectors(index.select("note_id", F.col("idx").cast("int").alias("idx"), "embedding"), "embedding")
    asked = _vectors(queries.select(*columns), "vector")
    grid = _grid(chunks, asked, k is not None, cell_chunks, group_queries)
    return grid.applyInArrow(_scorer(min_score, k), f"qid long, note_id {kind}, idx int, score double, n_before long")


def _matrix(column, width: int):
    """Lists of doubles as rows of a matrix, cut or filled with zeros to the width."""
    import numpy as np

    column = column.combine_chunks()
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
    values = column.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(width)
    inside = place < np.diff(ends)[:, None]
    out = np.zeros(inside.shape)
    out[inside] = values[(ends[:-1, None] + place)[inside]]
    return out


def _width(column) -> int:
    return max(column.combine_chunks().value_lengths().to_pylist(), default=0)


def _scorer(min_score: float | None, k: int | None):
    def run(chunks, queries):
        import numpy as np
        import pyarrow as pa

        names, kinds = ["qid", "note_id", "idx", "score", "n_before"], [pa.int64(), chunks.column("note_id").type, pa.int32(), pa.float64(), pa.int64()]
        chunks = chunks.sort_by([("note_id", "ascending"), ("idx", "ascending")])
        qids, idx = queries.column("qid").to_numpy(), chunks.column("idx").to_numpy()
        notes = chunks.column("note_id").combine_chunks().dictionary_encode()  # in the order of ids
        code = notes.indices.to_numpy(zero_copy_only=False)
        notes = notes.dictionary
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
        many = np.diff(np.append(first, len(code)))
        width = min(_width(chunks.column("embedding")), _width(queries.column("vector")))
        vectors, asked = _matrix(chunks.column("embedding"), width), _matrix(queries.column("vector"), width)
        probes = queries.column("probes").to_pylist() if "probes" in queries.column_names else [None] * len(qids)
        floor = -np.inf if min_score is None else min_score
        order_of = {n: i for i, n in enumerate(notes.to_pylist())} if any(probes) else {}
        ordered = list(order_of)
        out = []

        def place(note) -> int:
            """The number of notes of the cell with a smaller id."""
            from bisect import bisect_left

            return order_of[note] if note in order_of else bisect_left(ordered, note)

        for at in range(0, len(qids) if len(first) else 0, 256):
            scores = np.round(vectors @ asked[at : at + 256].T, 9)
            best = np.maximum.reduceat(scores, first, 0)  # notes, queries
            shown = best >= floor
            for q, own in enumerate(probes[at : at + 256]):
                for p in own or ():
                    column, n = best[:, q], place(p["note_id"])
                    before = np.count_nonzero(shown[:, q] & (column > p["score"])) + np.count_nonzero((shown[:, q] & (column == p["score"]))[:n])
                    out.append((np.array([at + q]), pa.array([p["note_id"]], kinds[1]), np.array([-1]), np.array([p["score"]]), np.array([before])))
            if k is not None:
                for q in range(best.shape[1]):
                    column = np.where(shown[:, q], best[:, q], -np.inf)
                    if (n := int(shown[:, q].sum())) > k:
                        # the k-th score, and of those that have it the smallest ids
                        level = np.partition(column, len(column) - k)[len(column) - k]
                        above, same = column > level, np.flatnonzero(column == level)
                        shown[:, q] = above
                        shown[same[: k - int(above.sum())], q] = True
            note, q = np.nonzero(shown)
            score = best[note, q]
            # the first chunk that has the note's score
            pair = np.repeat(np.arange(len(note)), many[note])
            row = first[note][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many[note]) - many[note], many[note])
            equal = np.flatnonzero(scores[row, q[pair]] == score[pair])
            chunk = row[equal[np.unique(pair[equal], return_index=True)[1]]]
            out.append((q + at, notes.take(pa.array(note)), idx[chunk], score, None))
        if not out:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        q = np.concatenate([o[0] for o in out])
        counts = pa.concat_arrays([pa.nulls(len(o[0]), pa.int64()) if o[4] is None else pa.array(o[4], pa.int64()) for o in out])
        columns = [pa.array(qids[q], pa.int64()), pa.concat_arrays([o[1] for o in out]), pa.array(np.concatenate([o[2] for o in out]), pa.int32()), pa.array(np.concatenate([o[3] for o in out]), pa.float64()), counts]
        return pa.table(columns, names=names)

    return run


def best_of(pairs: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, note_id, idx, score) of the best chunk for stated pairs (qid, note_id), by equi-joins and column functions alone."""
    met = pairs.select("qid", "note_id").join(_vectors(index.select("note_id", F.col("idx").cast("int").alias("idx"), "embedding"), "embedding"), "note_id")
    met = met.join(_vectors(queries.select("qid", "vector"), "vector"), "qid").withColumn("score", F.round(dot(F.col("embedding"), F.col("vector")), 9))
    return met.groupBy("qid", "note_id").agg(F.max_by("idx", F.struct("score", -F.col("idx"))).alias("idx"), F.max("score").alias("score"))


def top_k(best: DataFrame, k: int) -> DataFrame:
    """best (qid, note_id, score, ...) with a rank, the first k of each query; Spark cuts to the first k in each task before the shuffle."""
    order = [F.desc("score"), F.asc("note_id")]
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= k)


def dense_search(best: DataFrame, min_score: float, k: int) -> DataFrame:
    """The first k notes of each query with a rank, from the floor up."""
    return top_k(best.withColumn("score", F.round("score", 9)).filter(F.col("score") >= min_score), k)


def relative_cutoff(scored: DataFrame, ratio: float, floor: float = 0.0, by: str = "qid") -> DataFrame:
    """Rows whose score reaches floor + ratio * (top - floor)."""
    if ratio <= 0:
        return scored
    tops = scored.groupBy(F.col(by).alias("_by")).agg(F.max("score").alias("_top"))
    met = scored.join(tops, F.col(by) == F.col("_by"))
    return met.filter((F.col("_top") <= floor) | (F.col("score") >= floor + ratio * (F.col("_top") - floor))).drop("_top", "_by")
