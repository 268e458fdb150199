"""Queries that are SQL texts over the library's registered functions."""

from __future__ import annotations

from ..functions import projections as P
from ..functions import sql
from .alignment_queries import _GLOBAL
from .registry import query
from .sequence_queries import RC, kmer_cte


@query("sql_kmer_hits", P.with_("dna", "items", more=kmer_cte("k", "items", "item_id", 12) + ", " + kmer_cte("d", "dna", "doc_id", 12)) + f"""SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs, sum(hamming(kmer, {RC.format('kmer')}))::BIGINT AS twist FROM kk JOIN dk USING (kmer) GROUP BY item_id""")
def kmer_hits(spark, d):
    """How often, and in how many documents, an item's k-mers stand, and how far they are from their other strands."""
    sql.register(spark)
    text = """WITH i AS (SELECT item_id, hf_kmers(hf_dna(text), 12) AS ks FROM {items}), c AS (SELECT doc_id, hf_kmers(hf_dna(text), 12) AS ks FROM {documents}),
k AS (SELECT item_id, x.kmer FROM i LATERAL VIEW explode(ks) AS x), d AS (SELECT doc_id, x.kmer FROM c LATERAL VIEW explode(ks) AS x)
SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs, sum(hf_hamming(kmer, hf_reverse_complement(kmer))) AS twist FROM k JOIN d USING (kmer) GROUP BY item_id"""
    return spark.sql(text, items=P.table(spark, d, "benchmark"), documents=P.table(spark, d, "documents"))


@query("sql_alignments", P.with_("items", more="pairs AS (SELECT a.item_id AS id, b.item_id AS id2, a.seq AS v, b.seq AS w FROM items a JOIN items b ON b.item_id = a.item_id + 1), " + _GLOBAL) + "SELECT id AS item_id, r[-1] AS score FROM t WHERE i = length(v)")
def alignments(spark, d):
    """Each item aligned with the next."""
    sql.register(spark)
    text = """WITH i AS (SELECT item_id, hf_dna(text) AS seq FROM {items}), p AS (SELECT a.item_id, a.seq AS v, b.seq AS w FROM i a JOIN i b ON b.item_id = a.item_id + 1)
SELECT item_id, s.score FROM p, LATERAL hf_align(v, w, 'global') s"""
    return spark.sql(text, items=P.table(spark, d, "benchmark"))


@query("sql_spectra", P.with_("peptides", more="""mass AS (SELECT unnest(['G', 'A', 'S', 'P', 'V', 'T', 'C', 'I', 'L', 'N', 'D', 'K', 'Q', 'E', 'M', 'O', 'H', 'F', 'R', 'Y', 'U', 'W']) AS aa, unnest([57, 71, 87, 97, 99, 101, 103, 113, 113, 114, 115, 128, 128, 129, 131, 132, 137, 147, 156, 163, 168, 186]) AS m),
pl AS (SELECT ordinal, pep, unnest(range(1, length(pep) + 1)) AS i FROM peptides), pm AS (SELECT ordinal, i, sum(m) OVER (PARTITION BY ordinal ORDER BY i) AS s FROM pl JOIN mass ON aa = pep[i] UNION ALL SELECT ordinal, 0, 0 FROM peptides),
lin AS (SELECT a.ordinal, b.s - a.s AS mass FROM pm a JOIN pm b ON a.ordinal = b.ordinal AND a.i < b.i UNION ALL SELECT ordinal, 0 FROM peptides)""") + "SELECT ordinal, max(mass)::INT AS whole, count(*) AS parts, sum(mass)::BIGINT AS total FROM lin GROUP BY ordinal")
def spectra(spark, d):
    """Each peptide's mass, and the number and sum of the masses in its spectrum."""
    sql.register(spark)
    text = """WITH s AS (SELECT ordinal, hf_peptide_mass(pep) AS whole, hf_linear_spectrum(pep) AS parts FROM {peptides})
SELECT ordinal, max(whole) AS whole, count(*) AS parts, sum(mass) AS total FROM s LATERAL VIEW explode(parts) AS mass GROUP BY ordinal"""
    return spark.sql(text, peptides=P.peptides(spark, d))
