"""The corpus pipeline: quality rules, exact dedup, near dedup, repeated-passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and rereads it
as the next one's docs. All but the last return the columns of documents.

Defined cases, by stage: an empty table gives an empty one in each. Null texts: rejected by the first stage; on its own the second counts
them as empty texts, the third keeps them (they link with nothing), the fourth keeps them null, the fifth packs the end token
alone. Repeated rows and ties: the second stage keeps one row of rows alike in everything; the third keeps of a component the rows that
have its smallest id, and rows without an id; texts of rows that share an id are judged one by one only by the other stages. Further columns, of whatever
names, go through the first four stages as they are (n_chars follows the text). Texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from helixframe.llm.common import lean, table
from helixframe.llm.exchange import bloom, bloom_bits, in_bloom
from helixframe.operators.lineage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return quality_rules.filter_documents(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents (sets of five words, similarity of 0.8 or more), the one with the smallest id."""
    found = stored(jaccard_join.join(docs, n=5, percent=80), small=True)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    words, size = bloom(gone, "doc_id")
    known = spark.sparkContext.broadcast(words)  # of bounded size
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), bloom_bits(F.col("doc_id"), size).alias("bits"))
    shape = marked.select("row", "doc_id").schema

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_bloom(known.value, b.column("bits")) == inside)).select(["row", "doc_id"])

        return marked.mapInArrow(lean(run), shape)

    # only documents in the filter, hardly more than those that go, are joined
    stay = part(False).union(part(True).join(gone, "doc_id", "left_anti").select("row", "doc_id"))
    return stay.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; a character of which a part goes, goes."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select("doc_id", "text", F.struct(others.alias("own"), F.col("text").isNull().alias("none")).alias("row"))
    found = suffix_dedup.dedup(rows, keep="string")
    kept = F.when(~F.col("row.none"), F.col("kept"))
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("row")["own"][c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", copies), ("jaccard_join", near_copies), ("suffix_dedup", passages), ("packing", pack)]
ORACLE_SQL = None  # stages 3 to 5 are beyond SQL; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
