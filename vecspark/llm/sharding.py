"""Rendezvous hashing of record keys over weighted shards, in DataFrame expressions only.

For a key and a shard, md5 of "key:shard" gives a number u in (0, 1), and the shard's cost is -ln(u) / weight; the key
belongs to the shard of least cost. A shard that is added can only win keys for itself, and one that goes only gives its own
away. Every row is placed from its own key, so hot sources or groups of copies never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.common import checkpointed, free_name, table

#: Hex digits of md5 that make u; 13 digits are 52 bits, exact in a double.
DIGITS = 13


def cost(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, DIGITS)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The struct (cost, shard) of the winner among shards 0 to len(weights) - 1. Equal costs: the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(cost(key, s.id, s.weight).alias("cost"), s.id.alias("shard"))))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], extra_weight: float | None = None) -> DataFrame:
    """df with shard int and, if extra_weight is given, grown_shard int: the shard once one more of that weight is there.

    A null key counts as an empty string; equal keys share a shard. Columns of df named shard or grown_shard are replaced.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    best = free_name(df, "_won")
    won = df.withColumn(best, shard_of(text, weights)).withColumn("shard", F.col(f"{best}.shard"))
    if extra_weight is not None:
        new = F.struct(cost(text, F.lit(len(weights)), F.lit(float(extra_weight))).alias("cost"), F.lit(len(weights)).alias("shard"))
        won = won.withColumn("grown_shard", F.least(F.col(best), new).shard)
    return won.drop(best)


def number_rows(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """df with slot long: 0, 1, 2 ... within each value of `by`, in the order of `order`, without gaps.

    Rows are dealt out by ranges of (by, order), so no task has to hold a whole shard; each range is numbered by itself, from
    where those before it end. Rows that agree in `order` may be parted too, and take their slots in any order among
    themselves. What is numbered is written once, so a lost task finds the same ranges. A column slot of df is replaced.
    """
    df = df.drop("slot")
    tie, part, row, start = (free_name(df, f"_{n}") for n in ("tie", "part", "row", "start"))
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(by, *order, tie)
    dealt = checkpointed(ranged.withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(by, part).agg(F.count("*").alias(row))
    starts = sizes.withColumn(start, F.coalesce(F.sum(row).over(before), F.lit(0))).drop(row)
    inside = Window.partitionBy(by, part).orderBy(*order, tie)
    return dealt.withColumn(row, F.row_number().over(inside)).join(starts, [by, part]).withColumn("slot", F.col(start) + F.col(row) - 1).drop(tie, part, row, start)


def op7_rendezvous(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents over equal shards under the law `key`; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = number_rows(assign_shards(rows, "doc_id", [1.0] * shards, 1.0), "shard", ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_TABLE = "list_transform(range(0, 256), lambda i: list_reduce([i] || range(0, 8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
_COST = "-ln((('0x' || substr(md5(key || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
OP7_SQL = f"""
WITH crc AS (SELECT {_TABLE} AS t), docs AS (
    SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS text FROM documents
), placed AS (
    SELECT doc_id, min_by(j, {_COST}) FILTER (j < 40) AS shard, min_by(j, {_COST}) AS grown_shard
    FROM docs, (SELECT unnest(range(0, 41)) AS j) GROUP BY doc_id
), sized AS (
    SELECT doc_id, octet_length(encode(text)) + 16 AS size, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM docs, crc
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed JOIN sized USING (doc_id)
"""
