"""The jobs as registered queries: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.functions.projections import dna_sql
from helixframe.operators.lineage import scratch

from . import kmer_ledger, pattern_screen


def job1_pattern_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch(spark)}/places"
    for _ in range(2):
        pattern_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return pattern_screen.output(spark, out)


def job2_kmer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    for _ in range(2):
        kmer_ledger.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return kmer_ledger.output(spark, f"{folder}/out")


QUERIES = {f.__name__: f for f in (job1_pattern_screen, job2_kmer_ledger)}
#: A placement with two changed letters has one third of the item as it is, whose first twelve letters are looked up.
ORACLE_SQL = {
    "job1_pattern_screen": f"""WITH docs AS (SELECT doc_id, source, {dna_sql('text')} AS seq FROM documents), items AS (SELECT item_id, {dna_sql('text')} AS item FROM benchmark WHERE length({dna_sql('text')}) >= 36),
seeds AS (SELECT item_id, item, x * length(item) // 3 AS shift, substr(item, x * length(item) // 3 + 1, 12) AS seed FROM items, (SELECT unnest([0, 1, 2]) AS x)),
w AS (SELECT doc_id, source, seq, unnest(range(0, length(seq) - 11)) AS place FROM docs),
c AS (SELECT DISTINCT doc_id, source, item_id, item, place - shift AS pos, substr(seq, (place - shift + 1)::BIGINT, length(item)) AS part FROM w JOIN seeds ON substr(seq, place + 1, 12) = seed WHERE place >= shift AND place - shift + length(item) <= length(seq)),
m AS (SELECT *, hamming(part, item) AS mismatches FROM c)
SELECT doc_id, item_id, length(item)::INT AS item_length, pos::INT AS pos, mismatches::INT AS mismatches, source FROM m WHERE mismatches <= 2""",
    "job2_kmer_ledger": f"""WITH docs AS (SELECT source, {dna_sql('text')} AS seq FROM documents), w AS (SELECT source, seq, unnest(range(0, length(seq) - 6)) AS place FROM docs),
k AS (SELECT source, substr(seq, place + 1, 7) AS kmer FROM w)
SELECT least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS kmer, count(*) AS n, source FROM k GROUP BY ALL""",
}
