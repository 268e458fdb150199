"""Cutting lineage in storage that outlives executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, as in tests, a new one of this machine if the session is local, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, small: bool = False) -> DataFrame:
    """df as written to the shared folder and read again: smaller than a checkpoint, but how it was partitioned is lost.

    small: it may hold little for the partitions it comes in, and is dealt into as few files as its size asks for."""
    path = scratch(df.sparkSession)
    (df.hint("rebalance") if small else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
