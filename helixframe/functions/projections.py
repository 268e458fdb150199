"""Sequences, peptides, points and permutations made from the driver's tables, and the same as DuckDB text.

All tables are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_BASE = "ACGTACGTACGTACGTACGTACGTAC"
DIGITS = "0123456789"
DIGIT_BASE = "ACGTTGCATC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text):
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), UPPER, TO_BASE)


#: `dna` of UTF-8 bytes, as arguments of bytes.translate: every byte of another character than A to Z and a to z is left out.
DNA_BYTES = bytes.maketrans((UPPER + UPPER.lower()).encode(), (TO_BASE * 2).encode()), bytes(x for x in range(256) if not chr(x).isascii() or not chr(x).isalpha())


def dna_sql(text: str) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{UPPER}', '{TO_BASE}')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq."""
    return table(spark, sf_dir, "documents").select("doc_id", dna(F.col("text")).alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, seq from benchmark."""
    return table(spark, sf_dir, "benchmark").select("item_id", dna(F.col("text")).alias("seq"))


def short_dna(text):
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")), UPPER + DIGITS, TO_BASE + DIGIT_BASE)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, region, seq: 25 short sequences from nation names and their numbers."""
    n = table(spark, sf_dir, "nation")
    spelled = F.concat("n_name", F.lit("X"), (F.col("n_nationkey") * 7919 + 13).cast("string"), F.lit("Q"), (F.col("n_nationkey") * 104729 + 7).cast("string"))
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"), short_dna(spelled).alias("seq"))


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, pep from part names: 22 residues, other letters dropped."""
    pep = F.regexp_replace(F.upper("p_name"), "[^GASPVTCILNDKQEMOHFRYUW]", "")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), pep.alias("pep")).where("pep <> ''")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spec_id, pep from regions and market segments: peptides behind the spectra."""
    pep = F.regexp_replace(F.upper("p_type"), "[^GASPVTCILNDKQEMOHFRYUW]", "")
    return table(spark, sf_dir, "part").select(pep.alias("pep")).distinct().where("pep <> ''").select(F.col("pep").alias("spec_id"), "pep")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, label, features."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def single_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`points` as they are stored, in half as many bytes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("features"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, genome, chrom, ord, block: an order's lines as blocks; P in line order, Q by part with the sign of the return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", *LINE_ORDER)
    p = lines.withColumn("block", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    q = p.withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "block")))
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    one = q.select(F.col("l_orderkey").alias("o"), F.explode(F.array(F.struct(F.lit("P").alias("genome"), F.col("block").alias("ord"), F.col("block").alias("block")), F.struct(F.lit("Q").alias("genome"), F.col("ord"), (sign * F.col("block")).alias("block")))).alias("x"))
    return one.select("o", "x.genome", F.lit(0).alias("chrom"), "x.ord", "x.block")


def permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, perm: Q's blocks in order."""
    q = order_blocks(spark, sf_dir).where("genome = 'Q'")
    return q.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("perm"))


_SPELLED = "n_name || 'X' || (n_nationkey * 7919 + 13)::VARCHAR || 'Q' || (n_nationkey * 104729 + 7)::VARCHAR"
#: The projections as common table expressions.
SQL = {
    "dna": f"dna AS (SELECT doc_id, {dna_sql('text')} AS seq FROM documents)",
    "items": f"items AS (SELECT item_id, {dna_sql('text')} AS seq FROM benchmark)",
    "nations": f"nations AS (SELECT n_nationkey AS id, n_regionkey AS region, translate(upper(regexp_replace({_SPELLED}, '[^A-Za-z0-9]', '', 'g')), '{UPPER + DIGITS}', '{TO_BASE + DIGIT_BASE}') AS seq FROM nation)",
    "peptides": "peptides AS (SELECT p_partkey AS ordinal, regexp_replace(upper(p_name), '[^GASPVTCILNDKQEMOHFRYUW]', '', 'g') AS pep FROM part WHERE regexp_replace(upper(p_name), '[^GASPVTCILNDKQEMOHFRYUW]', '', 'g') <> '')",
    "segments": "segments AS (SELECT DISTINCT regexp_replace(upper(p_type), '[^GASPVTCILNDKQEMOHFRYUW]', '', 'g') AS pep, pep AS spec_id FROM part WHERE regexp_replace(upper(p_type), '[^GASPVTCILNDKQEMOHFRYUW]', '', 'g') <> '')",
    "points": "points AS (SELECT vec_id AS point_id, label, embedding::DOUBLE[] AS features FROM embeddings)",
    "blocks": f"""lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS block FROM lineitem),
qs AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, block) AS ord, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM lines),
blocks AS (SELECT l_orderkey AS o, 'P' AS genome, block AS ord, block FROM lines UNION ALL SELECT l_orderkey, 'Q', ord, sign * block FROM qs),
perms AS (SELECT o, list(block ORDER BY ord) AS perm FROM blocks WHERE genome = 'Q' GROUP BY o)""",
}


def with_(*names: str, more: str = "") -> str:
    return "WITH RECURSIVE " + ",\n".join([SQL[n] for n in names] + ([more] if more else [])) + "\n"
