"""Sharding by rendezvous hashing over weighted shards.

A record's shard is the one with the largest weight / -ln(u), where u in (0, 1) comes from the md5 of the key
and the shard's number. A new shard can only win records, never move them between old ones.

The law is `key`: the key and the shards decide, nothing else about the record. Text only travels as its size and
checksum. A record's slot is its rank in its shard by (block, key, size, checksum): blocks are hash buckets of
the key, so a shard is ranked by many tasks, and the ranks of the blocks before it come from a table of counts.

Defined cases: a null key is hashed as the string "null"; a null text has size 8 and checksum 0; repeated rows
go to one shard and get slots of their own; an empty table gives no rows; a text of any length is one size and checksum; further columns are kept apart by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BITS = 13  # hexadecimal digits of the digest behind u


def _unit(key: Column, what: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{what}:"), key).cast("binary")), 1, BITS)
    return F.conv(digits, 16, 10).cast("bigint")


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (_unit(key, str(shard)).cast("double") + 0.5) / F.lit(float(16**BITS))
    return F.lit(-float(weight)) / F.ln(u)


def assign(df: DataFrame, key: str, weights: list[float], out: str = "shard", grown: str | None = None, new_weight: float = 1.0) -> DataFrame:
    """df with the shard of each row, and in `grown` the shard it has once one more joins."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    scored = lambda s, w: F.struct(_score(k, s, w).alias("score"), F.lit(-s).alias("s"))
    df = df.withColumn("_best", F.array_max(F.array(*[scored(s, w) for s, w in enumerate(weights)])))
    if grown:
        df = df.withColumn(grown, -F.greatest(F.col("_best"), scored(len(weights), new_weight))["s"])
    return df.withColumn(out, -F.col("_best")["s"]).drop("_best")


def slots(df: DataFrame, key: str, order: list[str], shards: int, rows_per_block: int = 65536, shard: str = "shard") -> DataFrame:
    """df with each row's gapless rank in its shard."""
    blocks = max(16, -(-df.select(key).count() // (shards * rows_per_block)))
    df = df.withColumn("_block", _unit(F.coalesce(F.col(key).cast("string"), F.lit("null")), "block") % blocks)
    counts = df.groupBy(shard, "_block").count()
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order)))
    joined = ranked.join(counts, [shard, "_block"])
    return joined.withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("bigint")).drop("_block", "_before", "_rank")


def write_shards(df: DataFrame, path: str, key: str, weights: list[float]) -> None:
    """The rows themselves, one folder a shard."""
    assign(df, key, weights).write.partitionBy("shard").mode("overwrite").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = assign(rows, "doc_id", [1.0] * 24, grown="grown_shard")
    rows = slots(rows, "doc_id", ["doc_id", "size", "text_crc32"], 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_U = lambda what: f"('0x' || substr(md5('{what}:' || k), 1, {BITS}))::BIGINT"
SQL = f"""
WITH tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS i))),
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS raw FROM documents),
c AS (SELECT doc_id, k, (octet_length(raw) + 8)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, tbl),
s AS (SELECT *, {_U("block")} % greatest(16, ((SELECT count(*) FROM documents) + 24 * 65536 - 1) // (24 * 65536)) AS block,
  [{", ".join(f"-1.0::DOUBLE / ln(({_U(i)}::DOUBLE + 0.5) / {float(16**BITS)}::DOUBLE)" for i in range(25))}] AS sc FROM c),
w AS (SELECT *, list_position(sc[:24], list_max(sc[:24])) - 1 AS shard, list_position(sc, list_max(sc)) - 1 AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM w
"""
