"""Queries of the spectrum and peptide operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import spectra as S
from ..operators.lineage import stored
from ..operators.pairs import all_pairs
from .registry import query

#: Residues and their decimasses, written out apart from the operators' own table.
_DECI = """mass AS (SELECT unnest(['G', 'A', 'S', 'P', 'V', 'T', 'C', 'I', 'L', 'N', 'D', 'K', 'Q', 'E', 'M', 'O', 'H', 'F', 'R', 'Y', 'U', 'W']) AS aa,
unnest([570, 710, 870, 970, 990, 1011, 1030, 1131, 1131, 1141, 1151, 1281, 1281, 1291, 1312, 1322, 1371, 1472, 1562, 1632, 1681, 1862]) AS m, unnest(range(0, 22)) AS o)"""
_INT = """mass AS (SELECT unnest(['G', 'A', 'S', 'P', 'V', 'T', 'C', 'I', 'L', 'N', 'D', 'K', 'Q', 'E', 'M', 'O', 'H', 'F', 'R', 'Y', 'U', 'W']) AS aa,
unnest([57, 71, 87, 97, 99, 101, 103, 113, 113, 114, 115, 128, 128, 129, 131, 132, 137, 147, 156, 163, 168, 186]) AS m, unnest(range(0, 22)) AS o)"""


def lin(source: str, key: str) -> str:
    return f"""pl AS (SELECT {key}, pep, unnest(range(1, length(pep) + 1)) AS i FROM {source}),
pm AS (SELECT {key}, pep, i, sum(m) OVER (PARTITION BY {key} ORDER BY i) AS s FROM pl JOIN mass ON aa = pep[i] UNION ALL SELECT {key}, pep, 0, 0 FROM {source}),
lin AS (SELECT a.{key}, a.pep, (b.s - a.s)::INT AS mass FROM pm a JOIN pm b ON a.{key} = b.{key} AND a.i < b.i)"""


_CYC = """cyc AS (SELECT ordinal, 0 AS mass FROM peptides UNION ALL SELECT ordinal, mass FROM lin UNION ALL
SELECT a.ordinal, (t.s - (b.s - a.s))::INT FROM pm a JOIN pm b ON a.ordinal = b.ordinal AND a.i < b.i AND a.i > 0 AND b.i < length(b.pep) JOIN pm t ON t.ordinal = a.ordinal AND t.i = length(t.pep))"""


@query("ps1_mass_table", P.with_("peptides", more=_DECI + ", rs AS (SELECT unnest(string_split(pep, '')) AS aa FROM peptides)") + "SELECT aa, o::INT AS ord, (m // 10)::INT AS mass_int, m AS mass_decida, count(rs.aa) AS n FROM mass LEFT JOIN rs USING (aa) GROUP BY ALL")
def ps1(spark, d):
    """The residues, and how often each is in the peptides."""
    seen = P.peptides(spark, d).select(F.explode(F.split("pep", "")).alias("aa")).where("aa <> ''").groupBy("aa").agg(F.count(F.lit(1)).alias("n"))
    return S.mass_table(spark).join(seen, "aa", "left").select("aa", "ord", "mass_int", "mass_decida", F.coalesce("n", F.lit(0)).alias("n"))


@query("ps2_cyclic_spectrum", P.with_("peptides", more=", ".join([_DECI, lin("peptides", "ordinal"), _CYC])) + "SELECT * FROM cyc")
def ps2(spark, d):
    return S.cyclic_spectrum(P.peptides(spark, d)).select("ordinal", "mass")


@query("ps2_cyclic_spectrum_with_error", P.with_("peptides", more=", ".join([_DECI, lin("peptides", "ordinal"), _CYC, """ix AS (SELECT ordinal, mass, row_number() OVER (PARTITION BY ordinal ORDER BY mass) - 1 AS i, count(*) OVER (PARTITION BY ordinal) AS n FROM cyc),
dr AS (SELECT ordinal, mass, n, row_number() OVER (PARTITION BY ordinal ORDER BY md5('5:' || pep || ':' || i)) AS r FROM ix JOIN peptides USING (ordinal))"""])) + "SELECT ordinal, mass FROM dr WHERE r <= n - round_even(n * 0.1::DOUBLE, 0)")
def ps2_error(spark, d):
    return S.cyclic_spectrum(P.peptides(spark, d), drop_share=0.1, seed=5).select("ordinal", "mass")


@query("ps3_linear_spectrum", P.with_("peptides", more=", ".join([_DECI, lin("peptides", "ordinal")])) + "SELECT ordinal, mass FROM lin UNION ALL SELECT ordinal, 0 FROM peptides")
def ps3(spark, d):
    return S.linear_spectrum(P.peptides(spark, d), masses=S.DECI).select("ordinal", "mass")


@query("ps4_peptide_mass", P.with_("peptides", more=", ".join([_DECI, lin("peptides", "ordinal")])) + "SELECT ordinal, max(s)::INT AS mass FROM pm GROUP BY ordinal")
def ps4(spark, d):
    return P.peptides(spark, d).select("ordinal", S.peptide_mass(F.col("pep"), S.DECI).alias("mass"))


@query("ps5_expand", P.with_("peptides", more=_DECI) + "SELECT ordinal, pep || aa AS pep, o::INT AS last FROM peptides, mass")
def ps5(spark, d):
    grown = S.expand(P.peptides(spark, d).withColumn("path", F.array().cast("array<int>")), S.mass_table(spark))
    return grown.select("ordinal", "pep", F.element_at("path", -1).alias("last"))


_LISTS = ", ".join([_DECI, lin("peptides", "ordinal"), lin("segments", "spec_id").replace("lin AS", "slin AS").replace("pl AS", "spl AS").replace("FROM pl ", "FROM spl ").replace("pm AS", "spm AS").replace("FROM pm a JOIN pm b", "FROM spm a JOIN spm b"),
"""la AS (SELECT ordinal, list(mass ORDER BY mass) AS a FROM (SELECT ordinal, mass FROM lin UNION ALL SELECT ordinal, 0 FROM peptides) GROUP BY ordinal), lb AS (SELECT spec_id, list(mass ORDER BY mass) AS b FROM (SELECT spec_id, mass FROM slin UNION ALL SELECT spec_id, 0 FROM segments) GROUP BY spec_id),
tw AS (SELECT ordinal, spec_id, a, b, 1 AS i, 1 AS j, 0 AS n FROM la, lb UNION ALL SELECT ordinal, spec_id, a, b, i + (a[i] - b[j] <= 5)::INT, j + (b[j] - a[i] <= 5)::INT, n + (abs(a[i] - b[j]) <= 5)::INT FROM tw WHERE i <= len(a) AND j <= len(b)),
ts AS (SELECT ordinal, spec_id, max(n) AS score FROM tw GROUP BY ALL)"""])  # fmt: skip


def tolerant_scores(spark, d):
    lists = S.linear_spectrum(P.peptides(spark, d), masses=S.DECI).groupBy("ordinal").agg(F.array_sort(F.collect_list("mass")).alias("a"))
    spec = S.linear_spectrum(P.segments(spark, d), masses=S.DECI).groupBy("spec_id").agg(F.array_sort(F.collect_list("mass")).alias("b"))
    return all_pairs(lists, spec, "ordinal", "spec_id").select("ordinal", "spec_id", S.tolerant_score(F.col("a"), F.col("b"), 5).alias("score"))


@query("ps6_tolerant_score", P.with_("peptides", "segments", more=_LISTS) + "SELECT ordinal, spec_id, score FROM ts")
def ps6(spark, d):
    return tolerant_scores(spark, d)


@query("ps7_consistent", P.with_("peptides", "segments", more=", ".join([_DECI, "p AS (SELECT DISTINCT pep AS k, pep FROM peptides)", lin("p", "k"), """own AS (SELECT k, mass, count(*) AS need FROM (SELECT k, mass FROM lin UNION ALL SELECT k, 0 FROM p) GROUP BY ALL),
spec AS (SELECT mass, sum(need)::BIGINT AS n FROM own WHERE length(k) <= 12 GROUP BY mass)"""])) + "SELECT k AS pep FROM p WHERE NOT EXISTS (SELECT 1 FROM own LEFT JOIN spec USING (mass) WHERE own.k = p.k AND (n IS NULL OR need > n))")  # fmt: skip
def ps7(spark, d):
    """Peptides whose masses all occur in the joint spectrum of those of up to 12 residues: these, and whichever longer ones it explains."""
    pep = P.peptides(spark, d).select("pep").distinct()
    spec = S.linear_spectrum(pep.where("length(pep) <= 12"), masses=S.DECI).groupBy("mass").agg(F.count(F.lit(1)).alias("n"))
    return S.consistent(pep, spec)


@query("ps8_branch_and_bound", P.with_("segments", more=", ".join([_DECI, lin("segments", "spec_id"), _CYC.replace("ordinal", "spec_id").replace("FROM peptides", "FROM segments")])) + "SELECT spec_id, mass FROM cyc")
def ps8(spark, d):
    """The peptide found has the spectrum it was found from."""
    found = S.sequence_spectra(S.cyclic_spectrum(P.segments(spark, d))).select("spec_id", "pep")
    return S.cyclic_spectrum(found).select("spec_id", "mass")


_SEG = ", ".join([_DECI, lin("segments", "spec_id"), "spec AS (SELECT spec_id, mass FROM lin UNION ALL SELECT spec_id, 0 FROM segments)"])
_CONV = _SEG + """, r AS (SELECT spec_id, mass, row_number() OVER (PARTITION BY spec_id ORDER BY mass) AS i FROM spec),
cv AS (SELECT a.spec_id, b.mass - a.mass AS diff, count(*) AS n FROM r a JOIN r b ON a.spec_id = b.spec_id AND a.i < b.i WHERE b.mass - a.mass BETWEEN 570 AND 2000 GROUP BY ALL),
conv AS (SELECT spec_id, diff, n FROM (SELECT *, rank() OVER (PARTITION BY spec_id ORDER BY n DESC) AS r FROM cv) WHERE r <= 20)"""


def segment_spectra(spark, d):
    return S.linear_spectrum(P.segments(spark, d), masses=S.DECI).select("spec_id", "mass")


@query("ps9_convolution", P.with_("segments", more=_CONV) + "SELECT spec_id, diff, n FROM conv")
def ps9(spark, d):
    return S.convolution(segment_spectra(spark, d), ["spec_id"], 20)


@query("ps10_residues_near", P.with_("segments", more=_CONV) + "SELECT DISTINCT spec_id, aa, o::INT AS ord FROM conv JOIN mass ON abs(m - diff) <= 5")
def ps10(spark, d):
    return S.residues_near(S.convolution(segment_spectra(spark, d), ["spec_id"], 20), S.mass_table(spark), by=["spec_id"])


_PV = ", ".join([_INT, "p AS (SELECT pep AS k, min(ordinal) AS ordinal, pep FROM peptides GROUP BY pep)", lin("p", "k").replace("lin AS", "plin AS").replace("pl AS", "ppl AS").replace("FROM pl ", "FROM ppl ").replace("pm AS", "ppm AS").replace("FROM pm a JOIN pm b", "FROM ppm a JOIN ppm b"), lin("segments", "spec_id"), """pv AS (SELECT k, mass, count(*) AS c FROM plin GROUP BY ALL),
sv AS (SELECT spec_id, mass, count(*) AS c FROM (SELECT spec_id, mass FROM lin UNION ALL SELECT spec_id, 0 FROM segments) GROUP BY ALL),
sc AS (SELECT spec_id, k AS pep, sum(least(pv.c, sv.c))::BIGINT AS score FROM pv JOIN sv USING (mass) GROUP BY ALL),
best AS (SELECT spec_id, pep, score FROM (SELECT sc.*, row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, ordinal) AS r FROM sc JOIN p ON p.k = sc.pep WHERE score > 3) WHERE r = 1)"""])  # fmt: skip


@query("ps11_trim", P.with_("peptides", "segments", more=_LISTS) + "SELECT spec_id, ordinal, score FROM (SELECT *, rank() OVER (PARTITION BY spec_id ORDER BY score DESC) AS r FROM ts) WHERE r <= 5")
def ps11(spark, d):
    return S.trim(tolerant_scores(spark, d), 5, by=["spec_id"])


@query("ps12_leaderboard", P.with_("segments") + "SELECT spec_id, true AS near, true AS counted FROM segments")
def ps12(spark, d):
    """The peptide found weighs what the spectrum says, within the tolerance, and its score is what matching the two spectra gives."""
    noisy = stored(S.cyclic_spectrum(P.segments(spark, d), drop_share=0.1, seed=3), small=True)
    found = stored(S.sequence_spectra(noisy, method="leaderboard", top=10, m=20), small=True)  # else searched anew for each part of its spectrum
    lists = noisy.groupBy("spec_id").agg(F.array_sort(F.collect_list("mass")).alias("b"))
    own = S.cyclic_spectrum(found).groupBy("spec_id", "pep", "score").agg(F.array_sort(F.collect_list("mass")).alias("a"))
    return own.join(lists, "spec_id").select("spec_id", (F.abs(S.peptide_mass(F.col("pep"), S.DECI) - F.array_max("b")) <= 5).alias("near"), (S.tolerant_score(F.col("a"), F.col("b"), 5) == F.col("score")).alias("counted"))


def pv_tables(spark, d):
    order = S.first_of_each(P.peptides(spark, d))
    pep = S.spectrum_vector(S.linear_spectrum(order.select("pep"), zero=False), ["pep"])
    spec = S.spectrum_vector(S.linear_spectrum(P.segments(spark, d)).select("spec_id", "mass"), ["spec_id"])
    return spec, pep, order


def pv_scores(spark, d):
    spec, pep, _ = pv_tables(spark, d)
    return S.match_scores(spec, pep)


@query("pv1_match_scores", P.with_("peptides", "segments", more=_PV) + "SELECT * FROM sc")
def pv1(spark, d):
    return pv_scores(spark, d)


@query("pv2_peptide_vector", P.with_("peptides", "segments", more=_PV) + "SELECT k AS pep, mass, c AS n FROM pv")
def pv2(spark, d):
    return pv_tables(spark, d)[1]


@query("pv3_spectrum_vector", P.with_("peptides", "segments", more=_PV) + "SELECT spec_id, mass, c AS n FROM sv")
def pv3(spark, d):
    return pv_tables(spark, d)[0]


@query("pv4_distinct_peptides", P.with_("peptides") + "SELECT pep, min(ordinal) AS ordinal FROM peptides GROUP BY pep")
def pv4(spark, d):
    return S.first_of_each(P.peptides(spark, d))


@query("pv6_psm_search", P.with_("peptides", "segments", more=_PV) + "SELECT spec_id, best.pep, coalesce(score, 0)::BIGINT AS score FROM segments LEFT JOIN best USING (spec_id)")
def pv6(spark, d):
    return S.best_matches(*pv_tables(spark, d), 3)


@query("pv6_pruned_search", P.with_("peptides", "segments", more=_PV) + "SELECT spec_id, best.pep, coalesce(score, 0)::BIGINT AS score FROM segments LEFT JOIN best USING (spec_id)")
def pv6_pruned(spark, d):
    return S.best_matches_pruned(*pv_tables(spark, d), 3)


@query("pv5_best_peptide", P.with_("peptides", "segments", more=_PV.replace("score > 3", "score > -1")) + "SELECT spec_id, coalesce(best.pep, (SELECT pep FROM peptides ORDER BY ordinal LIMIT 1)) AS pep, coalesce(score, 0)::BIGINT AS score FROM segments LEFT JOIN best USING (spec_id)")
def pv5(spark, d):
    return S.best_matches(*pv_tables(spark, d), -1)


_TAIL = _PV + """, vs AS (SELECT spec_id, list(DISTINCT mass ORDER BY mass) AS ms, count(DISTINCT mass) + 2 AS w, max(mass) AS top FROM sv GROUP BY spec_id),
dp AS (SELECT spec_id, ms, w, top, 0 AS x, 0.0::DOUBLE AS tail, [[CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END FOR q IN range(0, w)]::DOUBLE[]] || [[0.0 FOR q IN range(0, w)]::DOUBLE[] FOR y IN range(0, 186)] AS l FROM vs UNION ALL
SELECT spec_id, ms, w, top, x + 1, tail + list_sum(v[4:]), [v] || l[:186] FROM (SELECT spec_id, ms, w, top, x, tail, l, CASE WHEN list_contains(ms, x + 1) THEN [0.0::DOUBLE] || c[:w - 1] ELSE c END AS v FROM
(SELECT spec_id, ms, w, top, x, tail, l, [list_sum([l[a][q] FOR a IN [57, 71, 87, 97, 99, 101, 103, 113, 113, 114, 115, 128, 128, 129, 131, 132, 137, 147, 156, 163, 168, 186]]) / 22 FOR q IN range(1, w + 1)] AS c FROM dp WHERE x < top))),
pr AS (SELECT spec_id, round(least(1.0, tail), 4) AS p FROM dp WHERE x = top)"""


def significant(spark, d):
    spec = S.linear_spectrum(P.segments(spark, d)).select("spec_id", "mass")
    return S.significance(S.best_matches(*pv_tables(spark, d), 3), spec, 3, 1)


@query("pv7_significance", P.with_("peptides", "segments", more=_TAIL) + "SELECT spec_id, best.pep, CASE WHEN best.pep IS NOT NULL THEN p END AS probability FROM segments LEFT JOIN best USING (spec_id) LEFT JOIN pr USING (spec_id)")
def pv7(spark, d):
    return significant(spark, d).select("spec_id", "pep", "probability")


@query("pv8_spectral_alignment", P.with_("peptides", "segments", more=_PV + """, pk AS (SELECT k, max(s) AS total FROM ppm GROUP BY k), lr AS (SELECT k, max(m) AS largest FROM ppl JOIN mass ON aa = pep[i] GROUP BY k), tp AS (SELECT spec_id, max(mass) AS top FROM sv GROUP BY spec_id),
can AS (SELECT spec_id, best.pep, top, top = total OR largest + top - total >= 1 AS fits FROM best JOIN pk ON pk.k = best.pep JOIN lr ON lr.k = best.pep JOIN tp USING (spec_id))""") + "SELECT spec_id, CASE WHEN fits THEN pep END AS pep, CASE WHEN fits THEN top END::INT AS mass, CASE WHEN fits THEN true END AS few FROM can")
def pv8(spark, d):
    """Without its shifts an alignment is the peptide, with them it weighs what the spectrum does, and it has as many shifts as allowed; where no one shift is
    large enough there is none."""
    shifts = F.regexp_extract_all("modified", F.lit(r"\(([+-]\d+)\)"))
    plain = F.regexp_replace("modified", r"\([^)]*\)", "")
    mass = S.peptide_mass(plain, S.DALTON) + F.aggregate(shifts, F.lit(0), lambda s, x: s + x.cast("int"))
    return significant(spark, d).where("pep IS NOT NULL").select("spec_id", plain.alias("pep"), mass.alias("mass"), F.when(F.col("modified").isNotNull(), F.size(shifts) <= 1).alias("few"))
