"""Queries of the sources and sinks: tables written to the shared folder in a form, and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import assembly, hmm, kmers
from ..operators.lineage import scratch
from ..sources import fasta
from .alignment_queries import MODEL
from .registry import query
from .sequence_queries import _PAIRS, kmer_cte
from .spectrum_queries import _SEG, segment_spectra


@query("io1_single_fasta", P.with_("nations") + "SELECT id, seq FROM nations")
def io1(spark, d):
    path = scratch(spark)
    lines = F.concat(F.lit(">one\n"), F.regexp_replace("seq", "(.{10})", "$1\n"))
    P.nations(spark, d).select("id", lines.alias("value")).write.partitionBy("id").text(path)
    return fasta.single_fasta(spark, f"{path}/*").select(F.regexp_extract("file", "id=([0-9]+)", 1).cast("int").alias("id"), "seq")


@query("io2_multi_fasta", P.with_("items") + "SELECT item_id, seq FROM items")
def io2(spark, d):
    path = scratch(spark)
    fasta.write_fasta(P.items(spark, d), path, "item_id")
    return fasta.multi_fasta(spark, path).select(F.col("header").cast("long").alias("item_id"), "seq")


@query("io3_normalising_fasta", P.with_("items") + "SELECT item_id, seq FROM items")
def io3(spark, d):
    path = scratch(spark)
    worn = F.lower(F.regexp_replace("seq", "(.{9})", "$1 \n\n"))
    fasta.write_fasta(P.items(spark, d).withColumn("seq", worn), path, "item_id")
    return fasta.multi_fasta(spark, path, normalise=True).select(F.col("header").cast("long").alias("item_id"), "seq")


@query("io4_reads", P.with_("items", more=kmer_cte("k", "items", "item_id", 10)) + "SELECT kmer AS read FROM kk")
def io4(spark, d):
    path = scratch(spark)
    kmers.kmers(P.items(spark, d), 10).groupBy("item_id").agg(F.array_join(F.collect_list("kmer"), "  ").alias("value")).select("value").write.text(path)
    return fasta.reads(spark, path)


@query("io5_matrix", P.with_("nations") + "SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS point_id, id::DOUBLE AS x, region + 0.5::DOUBLE AS y FROM nations")
def io5(spark, d):
    """One nested list, as a Python literal."""
    path = scratch(spark)
    point = F.concat(F.lit("("), F.col("id").cast("string"), F.lit(", "), (F.col("region") + 0.5).cast("string"), F.lit(")"))
    rows = P.nations(spark, d).select("id", point.alias("t")).agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("all"))  # 25 rows
    rows.select(F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["t"]), ", "), F.lit("]")).alias("value")).write.text(path)
    return fasta.matrix(spark, path).select("point_id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


@query("io6_spectra", P.with_("segments", more=_SEG) + "SELECT spec_id, mass FROM spec")
def io6(spark, d):
    path = scratch(spark)
    lists = segment_spectra(spark, d).groupBy("spec_id").agg(F.collect_list("mass").alias("m"))
    line = F.concat(F.lit(">"), F.col("spec_id"), F.lit("\n["), F.array_join("m", ", "), F.lit("]\n"))
    lists.select("spec_id", line.alias("value")).withColumn("name", F.col("spec_id")).drop("spec_id").write.partitionBy("name").text(path)
    return fasta.spectra(spark, f"{path}/*").select(F.regexp_extract("file", "name=([^/]*)", 1).alias("spec_id"), "mass")


@query("io7_spectrum_text", P.with_("segments", more=_SEG) + "SELECT spec_id, mass FROM spec")
def io7(spark, d):
    text = segment_spectra(spark, d).groupBy("spec_id").agg(F.concat(F.lit("  "), F.array_join(F.collect_list("mass"), "   ")).alias("t"))
    return text.select("spec_id", F.explode(fasta.parse_spectrum(F.col("t"))).alias("mass")).withColumn("mass", F.col("mass").cast("int"))


@query("io8_paired_reads", P.with_("items", more=_PAIRS) + "SELECT item_id, a, b FROM q")
def io8(spark, d):
    pairs = kmers.read_pairs(P.items(spark, d), 10, 20).groupBy("item_id").agg(F.array_join(F.collect_list(F.concat(F.lit("("), "a", F.lit(","), "b", F.lit(")"))), " ").alias("t"))
    return pairs.select("item_id", F.inline(assembly.parse_pairs(F.col("t"))))


_NEIGHBOURS = "w AS (SELECT seq, unnest(range(1, length(seq))) AS i FROM items), nb AS (SELECT seq[i] AS a, seq[i + 1] AS b, count(*)::DOUBLE AS score FROM w GROUP BY ALL)"


@query("io9_substitution_matrix", P.with_("items", more=_NEIGHBOURS) + "SELECT a, b, score FROM nb")
def io9(spark, d):
    """A matrix of how often letters follow one another in the items, written as text and parsed."""
    from ..operators.align import parse_matrix

    pairs = kmers.kmer_totals(P.items(spark, d), 2).collect()  # one for each pair of letters
    n, used = {(r["kmer"][0], r["kmer"][1]): r["n"] for r in pairs}, sorted({c for r in pairs for c in r["kmer"]})
    lines = ["# follows", "   " + "  ".join(used), *(f"{a}  " + " ".join(str(n.get((a, b), 0)) for b in used) for a in used)]
    found = parse_matrix("\n".join(lines) + "\n")
    return spark.createDataFrame([(k[0], k[1], x) for k, x in found.items() if x], "a string, b string, score double")


@query("io11_report", P.with_("items") + "SELECT item_id, seq FROM items")
def io11(spark, d):
    path = scratch(spark)
    for _ in range(2):  # in place of what was there
        fasta.write_report(P.items(spark, d), path)
    return spark.read.schema("item_id long, seq string").json(path)


@query("io12_reads_sink", P.with_("items", more=kmer_cte("k", "items", "item_id", 10) + ", " + _PAIRS) + "SELECT 'read' AS kind, item_id, kmer AS a, NULL AS b FROM kk UNION ALL SELECT 'pair', item_id, a, b FROM q")
def io12(spark, d):
    path = scratch(spark)
    items = P.items(spark, d)
    fasta.write_reads(kmers.kmers(items, 10).select("item_id", "kmer"), kmers.read_pairs(items, 10, 20).select("item_id", "a", "b"), path)
    one = spark.read.parquet(f"{path}/reads").select(F.lit("read").alias("kind"), "item_id", F.col("kmer").alias("a"), F.lit(None).cast("string").alias("b"))
    return one.union(spark.read.parquet(f"{path}/pairs").select(F.lit("pair"), "item_id", "a", "b"))


_SHARES = """l AS (SELECT region, id % 2 AS state, unnest(string_split(seq, '')) AS c FROM nations), c4 AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), st AS (SELECT DISTINCT region, state FROM l),
ct AS (SELECT st.region, st.state, c4.c, (SELECT count(*) FROM l WHERE l.region = st.region AND l.state = st.state AND l.c = c4.c) + 1 AS n FROM st, c4),
sh AS (SELECT region, state, c, round(n / sum(n) OVER (PARTITION BY region, state), 6) AS p FROM ct)"""


@query("io13_model_sink", P.with_("nations", more=_SHARES) + """SELECT region::VARCHAR AS model, 'E' AS kind, state AS row, c AS col, p FROM sh UNION ALL
SELECT DISTINCT region::VARCHAR, 'T', r::INT, c, p FROM nations, (VALUES (0, '0', 0.8::DOUBLE), (0, '1', 0.2), (1, '0', 0.3), (1, '1', 0.7)) b(r, c, p)""")  # fmt: skip
def io13(spark, d):
    """A model for each region, with the letters of its even and odd sequences as emissions; one is written twice."""
    path = scratch(spark)
    seen = P.nations(spark, d).select("region", (F.col("id") % 2).alias("state"), F.explode(kmers.letters(F.col("seq"))).alias("c")).groupBy("region", "state", "c").count().collect()
    n = {(r["region"], r["state"], r["c"]): r["count"] for r in seen}  # five regions at every scale
    regions = sorted({k[0] for k in n})
    for g in [*regions, regions[0]]:
        counts = np.array([[n.get((g, s, c), 0) + 1 for c in "ACGT"] for s in (0, 1)])
        own = hmm.Model(MODEL.states, MODEL.transition, np.round(counts / counts.sum(1, keepdims=True), 6), "ACGT")
        fasta.append_model(*hmm.model_rows(spark, own), path, str(g))
    t, e = (spark.read.schema(f"{c}, p double, model string").parquet(f"{path}/{x}") for x, c in (("transition", "`from` int, `to` int"), ("emission", "state int, sym string")))
    return t.select("model", F.lit("T").alias("kind"), F.col("from").alias("row"), F.col("to").cast("string").alias("col"), "p").union(e.select("model", F.lit("E"), "state", "sym", "p"))
