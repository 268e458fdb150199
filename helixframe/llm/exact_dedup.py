"""Exact dedup by content sort.

Sampled splitters (a range partitioning, sampled on a short key so that no whole text reaches the driver) deal the
normalised texts out by content; within a partition Spark's external sort puts equal texts next to each other, and a
window compares each whole text with its neighbour's and names the row that stays.

A text of very many copies would make one partition large. A first pass counts texts by a 64-bit hash (eight bytes a
row, combined before the shuffle); the copies of texts above the limit are sorted in salted chunks, and the chunks'
winners, of which there are few, are combined by text digest. The limit grows with rows / partitions, which bounds
the number of such texts by 8 x partitions.

Defined cases: a null text equals an empty one, and a text of only white space too; of equal candidates the smallest id
stays (null ids last); repeated rows are counted and returned one by one, and of rows alike in id and length exactly
one is kept (by keep_first the smallest in order of its columns); an empty table gives no rows; a text of any length is sorted and compared whole. Further columns of the input are kept as they are
by `keep_first`, whatever their names, and not read otherwise.

Splitters are drawn on (the first 32 characters, a hash of the whole, salt), and partitions are in order of these and, within a hash, of the
normalised text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, checkpoint, shuffle_partitions, table


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = 256) -> DataFrame:
    """One row per row of docs: key, cp (code points of the text), keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    norm = normalised(F.col(text))
    base = docs.select(F.col(key).alias("id"), norm.alias("norm"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("cp"))
    base = base.withColumn("h", F.xxhash64("norm"))
    limit = max(hot_rows, docs.count() // (8 * parts))
    hot = base.groupBy("h").count().where(F.col("count") > limit).select("h", F.ceil(F.col("count") / limit).cast("int").alias("chunks"))
    base = base.join(F.broadcast(hot), "h", "left")  # at most 8 x partitions rows
    base = base.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "cp"), F.col("chunks")), F.lit(0)).cast("int"))
    ranged = base.withColumn("lead", F.substring("norm", 1, 32)).repartitionByRange(parts, "lead", "h", "salt")
    same = Window.partitionBy("lead", "h", "salt", "norm")
    first = same.orderBy(F.col("cp").desc(), F.col("id").asc_nulls_last())
    near = ranged.select(
        "id", "cp", F.col("chunks").isNotNull().alias("hot"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "salt",
        F.row_number().over(first).alias("row"), F.count(F.lit(1)).over(same).alias("n"),
        F.first(F.struct(F.col("cp"), F.col("id"), F.col("salt"))).over(first).alias("best"),
    )
    near = checkpoint(near)
    order = F.struct(-F.col("best.cp"), F.col("best.id").isNull(), F.col("best.id"), F.col("best.salt"))
    whole = near.where("hot AND row = 1").groupBy("text_sha256").agg(F.sum("n").alias("all_n"), F.min_by("best", order).alias("all_best"))
    out = near.join(F.broadcast(whole), "text_sha256", "left")
    best = F.coalesce("all_best", "best")
    return out.select(
        F.col("id").alias(key), "cp", best["id"].alias("keep_id"), F.coalesce("all_n", "n").cast("bigint").alias("group_size"),
        ((F.col("row") == 1) & (F.col("salt") == best["salt"])).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, their columns untouched."""
    stay = groups(docs, key, text).where("kept").select(F.col(key).alias("id"), F.col("cp").alias("cp1"), F.col("text_sha256").alias("sha1"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(whole, F.col(key).alias("key"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("sha"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("cp"))
    found = own.join(stay, (F.col("sha") == F.col("sha1")) & (F.col("cp") == F.col("cp1")) & F.col("key").eqNullSafe(F.col("id")), "left_semi")
    # rows alike in id and length: the smallest row, with columns that have no order as JSON
    loose = {c for c, kind in docs.dtypes if "map<" in kind or "variant" in kind}
    order = F.struct(*[F.to_json(F.col("row")[c]) if c in loose else F.col("row")[c] for c in docs.columns])
    least = F.min_by("row", order) if loose else F.min("row")
    return found.groupBy("key", "cp", "sha").agg(least.alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop("cp")


SQL = rf"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY norm) AS c,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST) AS keep_id FROM n)
SELECT doc_id, keep_id, c AS group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
