"""Job: where passages of a reference set stand in a collection of sequences, letters changed here and there.

    python -m jobs.pattern_screen --documents PATH --items PATH --out PATH [--config jobs/pattern_screen.json]

Reads documents (doc_id, text, source) and items (item_id, text), both Parquet; texts are taken as sequences of ACGT. Writes Parquet below OUT,
partitioned by source: doc_id, item_id, item_length, pos (from 0), mismatches. The whole output is written anew, so a rerun gives the same rows.

Config: mismatches (letters that may differ), min_length (shorter items are not looked for), files (output files a source at most).
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.projections import dna
from helixframe.operators import patterns

LOG = logging.getLogger("pattern_screen")
DEFAULTS = {"mismatches": 2, "min_length": 36, "files": 8}


def places(documents: DataFrame, items: DataFrame, config: dict) -> DataFrame:
    """source, doc_id, item_id, item_length, pos, mismatches."""
    seq = documents.select("source", "doc_id", dna(F.col("text")).alias("seq"))
    wanted = items.select("item_id", dna(F.col("text")).alias("pattern")).where(F.length("pattern") >= config["min_length"])
    found = patterns.near_matches(seq, wanted, config["mismatches"], ["source", "doc_id"])
    return found.join(wanted.select("item_id", F.length("pattern").alias("item_length")), "item_id").select("source", "doc_id", "item_id", "item_length", "pos", "mismatches")


def run(spark: SparkSession, documents: str, items: str, out: str, config: dict | None = None) -> dict[str, int]:
    """The job; returns what it logs."""
    config = DEFAULTS | (config or {})
    if config["mismatches"] < 0 or config["min_length"] <= config["mismatches"]:
        raise ValueError("min_length must be above mismatches, and these not below 0")
    docs, known = spark.read.parquet(documents), spark.read.parquet(items)
    short = known.where(F.coalesce(F.length(dna(F.col("text"))), F.lit(0)) < config["min_length"])
    told = {"documents": docs.count(), "items": known.count(), "items_too_short": short.count()}
    LOG.info("read %(documents)d documents and %(items)d items, %(items_too_short)d too short", told)
    found = places(docs, known, config)
    # a source of many rows is dealt to several tasks, a small one to one
    dealt = found.repartition(F.col("source"), F.pmod(F.xxhash64("doc_id"), F.lit(config["files"])))
    dealt.write.mode("overwrite").partitionBy("source").parquet(out)
    told["places"] = output(spark, out).count()
    LOG.info("wrote %(places)d places", told)
    LOG.info("output: %s, partitioned by source", out)
    return told


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("doc_id long, item_id long, item_length int, pos int, mismatches int, source string").parquet(out)


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "items", "out"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    args = a.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("pattern_screen").getOrCreate()
    try:
        run(spark, args.documents, args.items, args.out, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
