"""Sources and sinks. Files are read by Spark's readers, so any path that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import stored


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))


PIECES = "file string, block long, part long, local long, header string, lines long, seq string"


def fasta_pieces(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """file, block, part, local, header, lines, seq: the files as Spark splits them, in pieces of records.

    A split (block: where it starts) is read line by line in its own task; which of its lines a header starts is counted from 1 within it (local), and
    0 is what still belongs to a record of an earlier split, or to none. A piece holds the lines of one record that came in one batch, so
    neither a record of gigabytes nor a million short ones are more to a task than its split."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    value = F.col("value")
    body = F.upper(F.replace(value, F.lit(" "), F.lit(""))) if normalise else F.trim(value)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.startswith(">").alias("starts"),
        F.when(value.startswith(">"), F.trim(F.substring(value, 2, 1 << 30))).otherwise(body).alias("line"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, local, part = None, 0, 0
        for b in batches:
            file, block = b.column("file").to_pylist(), b.column("block").to_pylist()
            starts, line = b.column("starts").to_numpy(zero_copy_only=False), b.column("line").to_pylist()
            new = np.array([x != y or f != g for x, y, f, g in zip(block, [None, *block], file, [None, *file])], bool)
            cuts = [*np.flatnonzero(new | starts.astype(bool)).tolist(), len(line)]
            out = []
            for a, z in zip(cuts, cuts[1:]):
                if (file[a], block[a]) != at:
                    at, local, part = (file[a], block[a]), 0, 0
                header = None
                if starts[a]:
                    local, header = local + 1, line[a]
                first = a + bool(starts[a])
                out.append((file[a], block[a], part, local, header, z - first, "".join(line[first:z])))
                part += 1
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], PIECES.replace("string", "").replace("long", "").replace(" ", "").split(","))

    return lines.mapInArrow(run, PIECES)


def _joined(pieces: str = "p") -> Column:
    """The letters of pieces in order."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x["seq"]), "")


def single_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, seq: all lines but headers, as one sequence a file."""
    return fasta_pieces(spark, path).groupBy("file").agg(F.collect_list(F.struct("block", "part", "seq")).alias("p")).select("file", _joined().alias("seq"))


def fasta_chunks(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """file, record (from 0; text before the first header is record 0 and headers count from 1), block, part, header, lines, seq: pieces with the
    record that they belong to. Only small rows are shuffled: how many headers each split has, added up over the splits before it."""
    pieces = stored(fasta_pieces(spark, path, normalise))
    return _numbered(pieces, "local", "headers").select("file", (F.col("local") + F.col("before")).alias("record"), "block", "part", "header", "lines", "seq")


def _numbered(rows: DataFrame, most: str, name: str) -> DataFrame:
    """rows with before: the sum, over the splits of the file before the row's own, of the largest value of a column in each."""
    splits = rows.groupBy("file", "block").agg(F.max(most).alias(name))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(splits.select("file", "block", F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias("before")), ["file", "block"])


def multi_fasta(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    """file, ordinal, header, seq. A record ends where the next header begins; text before the first header is a record
    without one; a header without a body line is dropped, one with a blank body line has an empty sequence. normalise skips
    blank lines, deletes inner spaces and upper-cases. Files are split wherever Spark splits them; a record is put together whole, so it must
    fit a row (fasta_chunks gives longer ones in pieces)."""
    chunks = fasta_chunks(spark, path, normalise)
    first = F.min(F.struct("block", "part"))["block"].alias("block")
    rows = chunks.groupBy("file", "record").agg(first, F.max("header").alias("header"), F.sum("lines").alias("lines"), F.collect_list(F.struct("block", "part", "seq")).alias("p"))
    rows = rows.where("lines > 0").select("file", "block", "record", "header", _joined().alias("seq"))
    if normalise:
        rows = rows.where("seq <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("record")))
    return _numbered(stored(rows), "n", "kept").select("file", (F.col("before") + F.col("n") - 1).alias("ordinal"), "header", "seq")


def reads(spark: SparkSession, path: str) -> DataFrame:
    """read: the tokens of a file, white space between."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("read")).where("read <> ''")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """point_id, features from one nested list of numbers, written as JSON or as a Python literal."""
    rows = _whole(spark, path).select(F.posexplode(F.from_json(F.regexp_replace(F.translate("value", "()", "[]"), r",\s*\]", "]"), "array<array<double>>")).alias("point_id", "features"))
    return rows


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """file, spec_id, mass: one list of whole numbers a line, numbered within the file; headers and blank lines are skipped."""
    lines = _whole(spark, path).select("file", F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith(">")).alias("l"))
    return lines.select("file", F.posexplode("l").alias("spec_id", "t")).select("file", "spec_id", F.explode(F.from_json(F.trim("t"), "array<int>")).alias("mass"))


def parse_spectrum(text: Column) -> Column:
    """An array of numbers from text with spaces between."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def write_fasta(df: DataFrame, path: str, name: str = "seq_id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """A result as files, in place of what was there."""
    df.write.mode("overwrite").format(form).save(path)


def write_reads(kmers: DataFrame, pairs: DataFrame, path: str) -> None:
    """Simulated reads and read pairs, side by side."""
    kmers.write.mode("overwrite").parquet(f"{path}/reads")
    pairs.write.mode("overwrite").parquet(f"{path}/pairs")


def append_model(transition: DataFrame, emission: DataFrame, path: str, model: str) -> None:
    """A model's tables, added to those of others under its name. A model of that name is replaced, so a job that runs again adds nothing."""
    for rows, part in ((transition, "transition"), (emission, "emission")):
        named = rows.withColumn("model", F.lit(model)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        named.partitionBy("model").parquet(f"{path}/{part}")
