"""Job, incremental: a ledger of k-mers over files of sequences that keep arriving.

    python -m jobs.kmer_ledger --documents PATH --out PATH --checkpoint PATH [--config jobs/kmer_ledger.json]

Reads documents (text, source) as a stream of Parquet files, of which the checkpoint knows those taken, until none is left; texts are taken as
sequences of ACGT. A k-mer and its reverse complement are one, written as the smaller. Each batch's counts are a partition of OUT/parts that carries the
batch's number: a batch that Spark runs again after a failure replaces its own partition, and nothing is counted twice. OUT/ledger
(source, kmer, n; partitioned by source) is the sum of all parts and written anew at the end, so a run without new files, or after one that broke off, gives the
same rows. There are no more than 4 ** k k-mers of a source, so parts and ledger stay small whatever is read.

Config: k (12 at most), files_per_batch.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.projections import dna
from helixframe.operators import kmers

LOG = logging.getLogger("kmer_ledger")
DEFAULTS = {"k": 7, "files_per_batch": 1000}


def counts(documents: DataFrame, k: int) -> DataFrame:
    """source, kmer, n: counted by the task first, and both strands put together where few rows are left."""
    seq = documents.select("source", dna(F.col("text")).alias("seq"))
    each = kmers.kmer_totals(seq, k, by=["source"])
    one = F.least("kmer", kmers.reverse_complement(F.col("kmer")))
    return each.groupBy("source", one.alias("kmer")).agg(F.sum("n").alias("n"))


def parts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("source string, kmer string, n long, batch long").parquet(f"{out}/parts")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """The job; returns what it logs."""
    config = DEFAULTS | (config or {})
    if not 0 < config["k"] <= 12:
        raise ValueError("k must be in 1..12")
    told = {"batches": 0, "documents": 0, "part_rows": 0, "ledger_rows": 0}

    def take(batch: DataFrame, number: int) -> None:
        n = batch.count()
        rows = counts(batch, config["k"]).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/parts")
        wrote = parts(spark, out).where(F.col("batch") == number).count()
        told.update(batches=told["batches"] + 1, documents=told["documents"] + n, part_rows=told["part_rows"] + wrote)
        LOG.info("batch %d: read %d documents, wrote %d rows of OUT/parts", number, n, wrote)

    schema = spark.read.parquet(documents).schema
    place = documents.rstrip("/")
    place = f"{place[:-1]}[{place[-1]}]"  # as a pattern it may be a folder or a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(place)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    ledger = parts(spark, out).groupBy("source", "kmer").agg(F.sum("n").alias("n"))
    ledger.write.mode("overwrite").partitionBy("source").parquet(f"{out}/ledger")
    told["ledger_rows"] = output(spark, out).count()
    LOG.info("took %(batches)d batches with %(documents)d documents, wrote a ledger of %(ledger_rows)d rows", told)
    LOG.info("output: %s/ledger, partitioned by source; checkpoint: %s", out, checkpoint)
    return told


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("kmer string, n long, source string").parquet(f"{out}/ledger")


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    args = a.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("kmer_ledger").getOrCreate()
    try:
        run(spark, args.documents, args.out, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
