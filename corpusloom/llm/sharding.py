"""Shards by proportional stratified interleaving, with DataFrame functions only.

Every source is a stratum. Its rows are shuffled by a seeded digest of id and text checksum and ranked; a row of rank r in
a source of n rows has the fractional rank (r + phase) / n, phase being a seeded number of the source in [0, 1), so that
small sources don't all fall on one place. All rows sorted by fractional rank are cut into shards of equal length: every
stretch of the order, and so every shard, holds each source in proportion, up to one or two rows a source. The law that
holds is `rows`: the counts of two shards are at most one apart.

No task sees a whole source or the whole order. A source is cut by the digest into buckets of about `group_rows` rows,
and the order by fractional rank into cells of about as many; rows are ranked inside these, and sums of the counts before
them, in two levels, give the rest. Ids, sizes and digests are shuffled twice; texts only where columns are carried.

A null source is a stratum of its own. A null text has no bytes: size 1 and the checksum of the empty string. Equal texts
and repeated rows are rows of their own; rows alike in id and checksum follow the order in which they were read, and where
they fill a bucket it is dealt by row number. Null ids are shuffled by their checksum. Fewer rows than shards leave some
shards empty; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common

SEED = 20240229
LAW = "rows"
#: Buckets or cells that one number of the upper level of sums stands for.
STEP = 1024


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from an md5 of the parts."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts).cast("binary")), F.lit(15)), 16, 10).cast("long") / F.lit(2.0**60)


def starts(counts: DataFrame, group: list[str], place: str, *then: str) -> DataFrame:
    """counts (group, place, then, n) with `start`, the sum of n before each row in its group; no window holds more than STEP places."""
    counts = counts.withColumn("_block", F.expr(f"{place} div {STEP}"))
    blocks = counts.groupBy(*group, "_block").agg(F.sum("n").alias("_n")).withColumn("_upper", F.expr(f"_block div {STEP}"))
    uppers = blocks.groupBy(*group, "_upper").agg(F.sum("_n").alias("_m"))

    def ahead(value: str, by: list[str], order: Sequence[str]) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    uppers = uppers.select(*group, "_upper", ahead("_m", group or [F.lit(0)], ["_upper"]).alias("_far"))  # one row for STEP * STEP places
    blocks = blocks.withColumn("_near", ahead("_n", [*group, "_upper"], ["_block"])).join(uppers, [*group, "_upper"]).select(*group, "_block", (F.col("_near") + F.col("_far")).alias("_before"))
    counts = counts.withColumn("_own", ahead("n", [*group, "_block"], [place, *then]))
    return counts.join(blocks, [*group, "_block"]).select(*group, place, *then, (F.col("_own") + F.col("_before")).alias("start"))


def dealt(rows: DataFrame, group_rows: int) -> DataFrame:
    """rows with `_bucket` and `_sub`: parts of a source in the order of its draws, of about group_rows rows."""
    rows = rows.withColumn("_bucket", F.floor(F.col("_draw") * F.ceil(F.col("_of") / group_rows)))
    # unlike draws spread evenly: only repeated rows fill a bucket far beyond its share
    heavy = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_full")).filter(F.col("_full") > 4 * group_rows)
    heavy = common.stored(heavy.select(F.concat_ws(":", "_bucket", "_source").alias("_key"), "_full"))
    if not (n := heavy.count()):
        return rows.withColumn("_sub", F.lit(0).cast("long"))
    rows = common.small_join(rows.withColumn("_key", F.concat_ws(":", "_bucket", "_source")), heavy, "_key", 64, "_row", "left", size=n)
    return rows.withColumn("_sub", F.coalesce(F.pmod(F.xxhash64("_row"), F.ceil(F.col("_full") / group_rows)), F.lit(0))).drop("_key", "_full")


def interleaved(docs: DataFrame, *, seed: int = SEED, group_rows: int = 1000, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, int]:
    """(_id, _size, _crc, _source, _position, and the carried columns as _c0, _c1, ...) of every row, and the number of rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        source.alias("_source"),
        *(F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)),
    )
    own = draw(F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_crc").cast("string"))
    # written once, so that a row keeps its number when a task is run again
    rows = common.stored(rows.withColumns({"_draw": own, "_row": F.monotonically_increasing_id()}))
    sizes = common.stored(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_of")).withColumn("_phase", draw(F.lit(str(seed)), F.lit("source"), F.col("_source"))))
    total = sizes.agg(F.coalesce(F.sum("_of"), F.lit(0))).first()[0]
    rows = dealt(common.small_join(rows, sizes, "_source", 64, "_row"), group_rows)

    keys = ["_source", "_bucket", "_sub"]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", "_row")))
    ranked = ranked.join(starts(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), ["_source"], "_bucket", "_sub"), keys)
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("start")).withColumn("_share", (F.col("_rank") + F.col("_phase")) / F.col("_of"))
    cells = max(1, -(-total // group_rows))
    ranked = ranked.withColumn("_cell", F.least(F.floor(F.col("_share") * cells), F.lit(cells - 1))).drop("start")
    placed = common.stored(ranked.select("_id", "_size", "_crc", "_source", "_rank", "_share", "_cell", *(f"_c{k}" for k in range(len(carry)))))

    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_share", "_source", "_rank"))
    placed = placed.withColumn("_position", place - 1).join(starts(placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")), [], "_cell"), "_cell")
    return placed.withColumn("_position", F.col("_position") + F.col("start")).drop("start", "_cell", "_share", "_rank"), total


def cut(n_shards: int, total: int) -> tuple[Column, Column]:
    """Shard and slot of a position: shard s begins at the least position p with p * n_shards >= s * total."""
    shard = F.expr(f"(_position * {n_shards}L) div {max(1, total)}L")
    return shard.cast("int"), F.col("_position") - F.expr(f"((_position * {n_shards}L) div {max(1, total)}L * {total}L + {n_shards - 1}L) div {n_shards}L")


def assignment(docs: DataFrame, n_shards: int = 16, **named) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; a shard more moves rows of all shards, so that grown_shard is null."""
    rows, total = interleaved(docs, **named)
    shard, slot = cut(n_shards, total)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit(LAW).alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, **named) -> tuple[str, str]:
    """Write all columns of docs as Parquet, one folder a shard, in the order of slots; the names given to the columns shard and slot."""
    rows, total = interleaved(docs, carry=docs.columns, **named)
    shard, slot = cut(n_shards, total)
    names = common.free_name(docs, "shard"), common.free_name(docs, "slot")
    out = rows.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)), shard.alias(names[0]), slot.alias(names[1]))
    out.repartitionByRange(*names).sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)
    return names


#: The same rows in SQL. The checksum is the bytewise one over the table of the reversed polynomial 0xEDB88320.
ORACLE_SQL = f"""
WITH t AS (
  SELECT list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v, b
  FROM (SELECT unnest(range(256))::BIGINT AS b)),
lut AS (SELECT list(v ORDER BY b) AS lut FROM t),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, size, source,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, lut[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM d, lut),
r AS (
  SELECT *, ('0x' || left(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || crc::VARCHAR), 15))::BIGINT AS drawn,
         ('0x' || left(md5('{SEED}:source:' || source), 15))::BIGINT / pow(2::DOUBLE, 60) AS phase, count(*) OVER (PARTITION BY source) AS n
  FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY drawn) - 1 AS rank FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + phase) / n, source, rank) - 1 AS p, count(*) OVER () AS total FROM f)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, '{LAW}' AS law, (p * 16 // total)::INT AS shard,
       (p - (p * 16 // total * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p
"""


def op12_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of the same mixture."""
    return assignment(common.table(spark, sf_dir, "documents"))
