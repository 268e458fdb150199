"""Queries of the alignment, phylogeny, clustering and HMM operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import agglomerate
from ..operators import align as A
from ..operators import cluster as C
from ..operators import hmm as H
from ..operators import kmers as K
from ..operators import phylo as T
from ..operators import profiles, tiles
from ..operators.lineage import stored
from ..operators.pairs import all_pairs
from .registry import query
from .sequence_queries import PAIRS, nation_pairs

PAM = A.PAM250
_PAM = "CASE " + " ".join(f"WHEN v[i + 1] || w[x[1]::INT] IN ('{k}', '{k[::-1]}') THEN {x}" for k, x in {"AA": 2.0, "CC": 12.0, "GG": 5.0, "TT": 3.0, "AC": -2.0, "AG": 1.0, "AT": 1.0, "CG": -3.0, "CT": -2.0, "GT": 0.0}.items()) + " END"
_UNIT = "CASE WHEN v[i + 1] = w[x[1]::INT] THEN 1.0 ELSE -1.0 END"


def dp(first_row: str, first_cell: str, sub: str = _UNIT, gap: str = "1.0", floor: str = "") -> str:
    """The table of a pair, row by row, as a list; t holds every row."""
    best = f"greatest({floor}r[x[1]::INT] + {sub}, r[x[1]::INT + 1] - {gap}, acc[-1] - {gap})"
    return f"""t AS (SELECT id, id2, v, w, 0 AS i, [{first_row} FOR j IN range(0, length(w) + 1)]::DOUBLE[] AS r FROM pairs UNION ALL
SELECT id, id2, v, w, i + 1, list_reduce([[{first_cell}]::DOUBLE[]] || [[j]::DOUBLE[] FOR j IN range(1, length(w) + 1)], lambda acc, x: acc || [{best}]) FROM t WHERE i < length(v))"""


def scores(spark, d, kind, **options):
    return A.align(nation_pairs(spark, d), kind, **options).select("id", "id2", F.round("alignment.score", 6).alias("score"))


_GLOBAL = dp("-1.0 * j", "-1.0 * (i + 1)")


@query("sa1_score_matrix", P.with_("items", more="w AS (SELECT seq, unnest(range(1, length(seq))) AS i FROM items), nb AS (SELECT seq[i] AS a, seq[i + 1] AS b, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT unnest(['A','C','G','T','-']) AS a)") + "SELECT l.a, m.a AS b, CASE WHEN l.a = '-' OR m.a = '-' THEN -1.0 WHEN l.a = m.a THEN 1.0 ELSE -1.0 END::DOUBLE AS score, coalesce(n, 0) AS n FROM l CROSS JOIN l m LEFT JOIN nb ON nb.a = l.a AND nb.b = m.a")
def sa1(spark, d):
    """The scores of letter pairs, and how often each pair stands side by side in the items."""
    seen = K.kmer_totals(P.items(spark, d), 2).select(F.left("kmer", F.lit(1)).alias("a"), F.right("kmer", F.lit(1)).alias("b"), "n")
    return A.score_matrix(spark).join(seen, ["a", "b"], "left").select("a", "b", "score", F.coalesce("n", F.lit(0)).alias("n"))


@query("sa3_needleman_wunsch", P.with_("nations", more=PAIRS + ", " + _GLOBAL) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa3(spark, d):
    return scores(spark, d, "global")


def traced(pairs, *more, **recount):
    """The texts that an alignment aligns, its score, and the score counted anew from its columns."""
    plain = lambda c: F.translate(F.col(f"alignment.{c}"), "-", "")
    counted = A.recounted(F.col("alignment.a"), F.col("alignment.b"), **recount)
    return pairs.select(*more, plain("a").alias("v"), plain("b").alias("w"), F.round("alignment.score", 6).alias("score"), F.round(counted, 6).alias("recount"))


@query("sa2_traceback", P.with_("nations", more=PAIRS + ", " + _GLOBAL) + "SELECT id, id2, v, w, r[-1] AS score, r[-1] AS recount FROM t WHERE i = length(v)")
def sa2(spark, d):
    return traced(A.align(nation_pairs(spark, d), "global"), "id", "id2")


@query("sa4_needleman_wunsch_pam250", P.with_("nations", more=PAIRS + ", " + dp("-1.0 * j", "-1.0 * (i + 1)", _PAM)) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa4(spark, d):
    return scores(spark, d, "global", scoring=A.Scoring(matrix=PAM))


@query("sa4_pam250_gap_adds", P.with_("nations", more=PAIRS + ", " + dp("1.0 * j", "1.0 * (i + 1)", _PAM, "-1.0")) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa4_compat(spark, d):
    return scores(spark, d, "global", scoring=A.Scoring(matrix=PAM, gap_adds=True))


_LOW = "-1e18::DOUBLE"
_AFFINE = f"""t AS (SELECT id, id2, v, w, 0 AS i, [0.0::DOUBLE] || [-1.0 - 0.5 * j FOR j IN range(0, length(w))]::DOUBLE[] AS m, [{_LOW}] || [-1.0 - 0.5 * j FOR j IN range(0, length(w))]::DOUBLE[] AS x, [{_LOW} FOR j IN range(0, length(w) + 1)] AS y FROM pairs UNION ALL
SELECT id, id2, v, w, i + 1, m2, list_reduce([[{_LOW}]] || [[j]::DOUBLE[] FOR j IN range(1, length(w) + 1)], lambda acc, k: acc || [greatest(m2[k[1]::INT] - 1.0, acc[-1] - 0.5)]), y2 FROM
(SELECT id, id2, v, w, i, [-1.0 - 0.5 * i]::DOUBLE[] || [greatest(m[j], x[j], y[j]) + CASE WHEN v[i + 1] = w[j] THEN 1.0 ELSE -1.0 END FOR j IN range(1, length(w) + 1)] AS m2,
[-1.0 - 0.5 * i]::DOUBLE[] || [greatest(m[j + 1] - 1.0, y[j + 1] - 0.5) FOR j IN range(1, length(w) + 1)] AS y2 FROM t WHERE i < length(v)))"""


@query("sa5_affine_gap", P.with_("nations", more=PAIRS + ", " + _AFFINE) + "SELECT id, id2, v, w, greatest(m[-1], x[-1], y[-1]) AS score, greatest(m[-1], x[-1], y[-1]) AS recount FROM t WHERE i = length(v)")
def sa5(spark, d):
    return traced(A.align(nation_pairs(spark, d), "affine"), "id", "id2", extend=0.5)


@query("sa5_middle_only", P.with_("nations", more=PAIRS + ", " + _AFFINE) + "SELECT id, id2, trunc(m[-1]) AS score FROM t WHERE i = length(v)")
def sa5_middle(spark, d):
    return A.align(nation_pairs(spark, d), "affine", middle_only=True).select("id", "id2", "alignment.score")


@query("sa6_linear_space", P.with_("nations", more=PAIRS + ", " + _GLOBAL) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa6(spark, d):
    return scores(spark, d, "linear_space")


@query("sa8_smith_waterman", P.with_("nations", more=PAIRS + ", " + dp("0.0", "0.0", floor="0.0, ")) + "SELECT id, id2, max(list_max(r)) AS score FROM t GROUP BY id, id2")
def sa8(spark, d):
    return scores(spark, d, "local")


_LONGER = "pairs AS (SELECT id, id2, CASE WHEN length(v) >= length(w) THEN v ELSE w END AS v, CASE WHEN length(v) >= length(w) THEN w ELSE v END AS w FROM p0)"


@query("sa9_fitting", P.with_("nations", more=PAIRS.replace("pairs AS", "p0 AS") + ", " + _LONGER + ", " + dp("-1.0 * j", "0.0")) + "SELECT id, id2, max(r[-1]) AS score FROM t GROUP BY id, id2")
def sa9(spark, d):
    return scores(spark, d, "fitting")


_ITEM_PAIRS = "pairs AS (SELECT a.item_id AS id, b.item_id AS id2, a.seq AS v, b.seq AS w FROM items a JOIN items b ON a.item_id < b.item_id)"


def item_pairs(spark, d):
    a = P.items(spark, d).select(F.col("item_id").alias("id"), F.col("seq").alias("v"))
    return all_pairs(a, a.select(F.col("id").alias("id2"), F.col("v").alias("w")), "id", "id2").where("id < id2")


def next_items(spark, d):
    a = P.items(spark, d).select(F.col("item_id").alias("id"), F.col("seq").alias("v"))
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("id").alias("id2"), F.col("v").alias("w")), "id")


@query("sa3_items_alignment", P.with_("items", more=_ITEM_PAIRS + ", " + _GLOBAL) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa3_items(spark, d):
    """All pairs of benchmark sequences, for throughput."""
    return A.align(item_pairs(spark, d), "global").select("id", "id2", "alignment.score")


@query("sa5_items_affine", P.with_("items", more=_ITEM_PAIRS + ", few AS (SELECT * FROM pairs WHERE id2 = id + 1), " + _AFFINE.replace("FROM pairs UNION", "FROM few UNION")) + "SELECT id, id2, greatest(m[-1], x[-1], y[-1]) AS score FROM t WHERE i = length(v)")
def sa5_items(spark, d):
    """Each benchmark sequence and the next."""
    return A.align(next_items(spark, d), "affine").select("id", "id2", "alignment.score")


@query("sa5_items_tiled", P.with_("items", more=_ITEM_PAIRS + ", few AS (SELECT * FROM pairs WHERE id2 = id + 1), " + _AFFINE.replace("FROM pairs UNION", "FROM few UNION")) + "SELECT id, id2, greatest(m[-1], x[-1], y[-1]) AS score FROM t WHERE i = length(v)")
def sa5_tiled(spark, d):
    """The same by tiles, as for sequences beyond one task; here of 64 letters, so that most pairs have several."""
    return tiles.tiled_scores(next_items(spark, d), ["id", "id2"], "affine", size=64)


@query("sa6_items_linear_space", P.with_("items", more=_ITEM_PAIRS + ", few AS (SELECT * FROM pairs WHERE id2 = id + 1), " + _GLOBAL.replace("FROM pairs UNION", "FROM few UNION")) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa6_items(spark, d):
    return A.align(next_items(spark, d), "linear_space").select("id", "id2", "alignment.score")


#: PAM250 by pairs of letters.
_PAM250 = "MAP {" + ", ".join(f"'{k}': {x}" for k, x in A.PAM250.items()) + "}"
_TYPES = "segs AS (SELECT DISTINCT regexp_replace(pep, '[OU]', '', 'g') AS pep FROM segments), pairs AS (SELECT a.pep AS id, b.pep AS id2, a.pep AS v, b.pep AS w FROM segs a JOIN segs b ON a.pep < b.pep)"


@query("sa4_pam250_peptides", P.with_("segments", more=_TYPES + f", pam AS (SELECT {_PAM250} AS s), " + dp("-1.0 * j", "-1.0 * (i + 1)", "pam.s[v[i + 1] || w[x[1]::INT]]").replace("FROM t WHERE", "FROM t, pam WHERE")) + "SELECT id, id2, r[-1] AS score FROM t WHERE i = length(v)")
def sa4_peptides(spark, d):
    a = P.segments(spark, d).select(F.translate("pep", "OU", "").alias("id")).distinct().withColumn("v", F.col("id"))
    pairs = all_pairs(a, a.select(F.col("id").alias("id2"), F.col("v").alias("w")), "id", "id2").where("id < id2")
    return A.align(pairs, "global", scoring=A.Scoring(matrix=A.PAM250)).select("id", "id2", "alignment.score")


_COLS = "c AS (SELECT region, unnest(range(0, length(seq))) AS col, unnest(string_split(seq, '')) AS ch, id FROM g), cols AS (SELECT region, col, list(ch ORDER BY id) AS chars FROM c GROUP BY region, col)"
_GAPPED = "g AS (SELECT id, region, translate(seq, 'T', '-') AS seq FROM nations)"


def gapped(spark, d):
    """Nation sequences with T as a gap."""
    return P.nations(spark, d).withColumn("seq", F.translate("seq", "T", "-"))


@query("sa10_pair_sum", P.with_("nations", more=_GAPPED + ", " + _COLS + ", q AS (SELECT a.region, a.col, CASE WHEN '-' IN (a.ch, b.ch) THEN -1.0 WHEN a.ch = b.ch THEN 1.0 ELSE -1.0 END AS s FROM c a JOIN c b ON a.region = b.region AND a.col = b.col AND a.id < b.id)") + "SELECT region, col::INT AS col, coalesce(sum(s), 0)::DOUBLE AS score FROM cols LEFT JOIN q USING (region, col) GROUP BY ALL")
def sa10(spark, d):
    return A.alignment_columns(gapped(spark, d), ["region"], order="id").select("region", "col", A.pair_sum(F.col("chars")).alias("score"))


@query("sa11_entropy", P.with_("nations", more=_GAPPED + ", " + _COLS + """, n AS (SELECT region, col, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY region, col) AS t FROM c GROUP BY region, col, ch)""") + "SELECT region, col::INT AS col, round(-sum(CASE WHEN ch = '-' THEN n ELSE -(n / t) * log2(n / t) END), 6) + 0.0 AS score FROM n GROUP BY region, col")
def sa11(spark, d):
    return A.alignment_columns(gapped(spark, d), ["region"], order="id").select("region", "col", (F.round(A.entropy(F.col("chars")), 6) + 0.0).alias("score"))


def thirds(spark, d):
    return P.nations(spark, d).select((F.col("id") / 3).cast("int").alias("g"), F.col("id").alias("ordinal"), "seq")


def ungapped(aligned, by):
    """by, place, seq, width of the rows of alignments (arrays)."""
    return aligned.select(*by, F.posexplode("aligned").alias("place", "x")).select(*by, "place", F.translate("x", "-", "").alias("seq"), (F.length("x") == F.max(F.length("x")).over(Window.partitionBy(*by))).alias("even"))


#: The best score of up to three sequences by every cell of their table, level by level; a working row is a cell of the last three levels.
_THREE = """tri AS (SELECT g, count(*) AS n, list(seq ORDER BY id)[1] AS s1, coalesce(list(seq ORDER BY id)[2], '') AS s2, coalesce(list(seq ORDER BY id)[3], '') AS s3 FROM third GROUP BY g),
mv AS (SELECT * FROM (VALUES (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)) t(d1, d2, d3)),
cell AS (SELECT g, 0 AS lv, 0 AS now, 0 AS i, 0 AS j, 0 AS k, 0.0::DOUBLE AS x FROM tri UNION ALL SELECT g, lv, now + 1, i, j, k, x FROM (
SELECT c.g, c.lv, c.now, c.i, c.j, c.k, c.x FROM cell c JOIN tri USING (g) WHERE lv >= now - 1 AND now < length(s1) + length(s2) + length(s3) UNION ALL
SELECT c.g, now + 1 AS lv, now, i + d1 AS i, j + d2 AS j, k + d3 AS k, max(x + CASE WHEN n < 2 THEN 0 WHEN d1 = 1 AND d2 = 1 AND s1[i + 1] = s2[j + 1] THEN 1 ELSE -1 END
+ CASE WHEN n < 3 THEN 0 WHEN d1 = 1 AND d3 = 1 AND s1[i + 1] = s3[k + 1] THEN 1 ELSE -1 END + CASE WHEN n < 3 THEN 0 WHEN d2 = 1 AND d3 = 1 AND s2[j + 1] = s3[k + 1] THEN 1 ELSE -1 END) AS x
FROM cell c JOIN tri USING (g) JOIN mv ON lv + d1 + d2 + d3 = now + 1 AND i + d1 <= length(s1) AND j + d2 <= length(s2) AND k + d3 <= length(s3) GROUP BY ALL)),
top AS (SELECT g, max(x) AS score FROM cell JOIN tri USING (g) WHERE lv = length(s1) + length(s2) + length(s3) GROUP BY g)"""
_BEST = "SELECT g, (row_number() OVER (PARTITION BY g ORDER BY id) - 1)::INT AS place, seq, true AS even, score, score AS added, 'exact' AS status FROM third JOIN top USING (g)"


def scored(rows):
    """The rows of each group's best alignment, its score, and what its columns add up to."""
    got = stored(A.multiple_alignment(rows, ["g"]), small=True)
    shapes = got.select("aligned").distinct()
    columns = A.alignment_columns(shapes.select("aligned", F.posexplode("aligned").alias("ordinal", "seq")), ["aligned"])
    added = columns.groupBy("aligned").agg(F.sum(A.pair_sum(F.col("chars"))).alias("added"))
    return ungapped(got.join(added, "aligned"), ["g", "score", "added", "status"]).select("g", "place", "seq", "even", "score", "added", "status")


@query("sa12_multiple_alignment", P.with_("nations", more="third AS (SELECT id // 3 AS g, id, seq FROM nations), " + _THREE) + _BEST)
def sa12(spark, d):
    return scored(thirds(spark, d))


@query("sa12_peptides", P.with_("peptides", more="third AS (SELECT ordinal // 3 AS g, ordinal AS id, pep AS seq FROM peptides), " + _THREE) + _BEST)
def sa12_peptides(spark, d):
    """Peptides of all parts, by three of their numbers."""
    return scored(P.peptides(spark, d).select(F.floor(F.col("ordinal") / 3).alias("g"), "ordinal", F.col("pep").alias("seq")))


@query("ph1_drop_gap_columns", P.with_("nations", more=_GAPPED + ", " + _COLS + ", bad AS (SELECT DISTINCT region, col FROM c WHERE ch = '-')") + "SELECT id, coalesce(string_agg(ch, '' ORDER BY col) FILTER (WHERE bad.col IS NULL), '') AS seq FROM c LEFT JOIN bad USING (region, col) GROUP BY id")
def ph1(spark, d):
    return T.drop_gap_columns(gapped(spark, d), ["region"]).select("id", "seq")


_REGION = "rp AS (SELECT a.region, a.id AS i, b.id AS j, a.seq AS v, b.seq AS w FROM nations a JOIN nations b ON a.region = b.region AND a.id < b.id)"
_HAM = "h AS (SELECT region, i, j, list_sum([CASE WHEN v[x] <> w[x] THEN 1.0 ELSE 0.0 END FOR x IN range(1, least(length(v), length(w)) + 1)])::DOUBLE AS d FROM rp)"


def region_distances(spark, d):
    return T.distances(P.nations(spark, d), ["region"], order="id")


@query("ph2_hamming_matrix", P.with_("nations", more=_REGION + ", " + _HAM) + "SELECT * FROM h")
def ph2(spark, d):
    return region_distances(spark, d)


_K = """k AS (SELECT region, i, j, unnest(range(1, least(length(v), length(w)) + 1)) AS x, v, w FROM rp),
z AS (SELECT region, i, j, count(*) AS n, count(*) FILTER (WHERE v[x] <> w[x] AND (v[x] IN ('A', 'G')) = (w[x] IN ('A', 'G'))) / count(*) AS p,
count(*) FILTER (WHERE (v[x] IN ('A', 'G')) <> (w[x] IN ('A', 'G'))) / count(*) AS q FROM k GROUP BY ALL)"""


@query("ph3_kimura", P.with_("nations", more=_REGION + ", " + _K) + "SELECT region, i, j, CASE WHEN 1 - 2 * p - q <= 0 OR 1 - 2 * q <= 0 THEN -1.0 ELSE round(-0.5 * ln((1 - 2 * p - q) * sqrt(greatest(1 - 2 * q, 0))), 2) END::DOUBLE AS d FROM z")
def ph3(spark, d):
    k = T.distances(P.nations(spark, d), ["region"], order="id", kind="kimura")
    return k.withColumn("d", F.when(F.col("d") == float("inf"), -1.0).otherwise(F.col("d")))  # infinite: saturated



#: UPGMA by mean distance over all pairs of leaves, as a state of clusters; m: places of a cluster's leaves.
_MATRIX = """nm AS (SELECT region, list(id ORDER BY id) AS names FROM nations GROUP BY region), hh AS (SELECT region, i, j, d FROM h UNION ALL SELECT region, j, i, d FROM h UNION ALL SELECT region, id, id, 0.0 FROM nations),
hr AS (SELECT region, i, list(d ORDER BY j) AS r FROM hh GROUP BY region, i), dm AS (SELECT region, list(r ORDER BY i) AS dm FROM hr GROUP BY region)"""


def merges(first: str, digits: int = 9, join: str = "list_avg", key: str = "region") -> str:
    """first: the states to start from (key, dm, cl, new)."""
    far = f"round({join}(flatten([[dm[x][y] FOR y IN cl[j].m] FOR x IN cl[i].m])), {digits})"
    return f"""{first}, u AS (SELECT {key}, dm, cl, new, 0 AS step, NULL::STRUCT(d DOUBLE, i BIGINT, j BIGINT) AS pr, cl[1] AS a, cl[1] AS b FROM st UNION ALL
SELECT {key}, dm, [cl[k] FOR k IN range(1, len(cl) + 1) IF k <> pr.i AND k <> pr.j] || [{{'l': new, 'm': cl[pr.i].m || cl[pr.j].m, 'age': pr.d / 2}}], new + 1, step + 1, pr, cl[pr.i], cl[pr.j] FROM
(SELECT {key}, dm, cl, new, step, list_sort(flatten([[{{'d': {far}, 'i': i, 'j': j}} FOR j IN range(i + 1, len(cl) + 1)] FOR i IN range(1, len(cl))]))[1] AS pr FROM u WHERE len(cl) > 1)),
ue AS (SELECT {key}, new - 1 AS parent, a.l AS child, 0 AS child_ord, pr.d / 2 - a.age AS length, pr.d / 2 AS age FROM u WHERE step > 0 UNION ALL SELECT {key}, new - 1, b.l, 1, pr.d / 2 - b.age, pr.d / 2 FROM u WHERE step > 0)"""


def _text_sql(merged: str, key: str) -> str:
    """The text of a tree as a list of lines, built as clusters merge."""
    child = lambda k: f"['  |-- ' || cl[pr.{k}].l || ' (len=' || printf('%.4f', pr.d / 2 - cl[pr.{k}].age) || ')'] || ['    ' || x FOR x IN cl[pr.{k}].t]"
    with_lines = merged.replace("{'l': new, ", f"{{'t': [new::VARCHAR] || {child('i')} || {child('j')}, 'l': new, ").replace("{'l': names[k], ", "{'t': [names[k]::VARCHAR], 'l': names[k], ").replace("{'l': x, 'm'", "{'t': [x::VARCHAR], 'l': x, 'm'")
    return f"{with_lines}, tx AS (SELECT {key}, array_to_string(cl[1].t, chr(10)) AS text FROM u WHERE len(cl) = 1)"


_START = "st AS (SELECT region, dm, [{'l': names[k], 'm': [k], 'age': 0.0::DOUBLE} FOR k IN range(1, len(names) + 1)] AS cl, list_max(names) + 1 AS new FROM nm JOIN dm USING (region))"
_UPGMA = _REGION + ", " + _HAM + ", " + _MATRIX + ", " + merges(_START)
_NJ = _REGION + ", " + _HAM + ", " + _MATRIX + """, u AS (SELECT region, [x::VARCHAR FOR x IN names] AS l, dm AS d, 0 AS i, 0 AS j, NULL::VARCHAR[] AS before, NULL::DOUBLE[][] AS was FROM nm JOIN dm USING (region) UNION ALL
SELECT region, [l[k] FOR k IN range(1, len(l) + 1) IF k <> i AND k <> j] || ['(' || l[i] || ',' || l[j] || ')'],
[[d[x][y] FOR y IN range(1, len(l) + 1) IF y <> i AND y <> j] || [(d[i][x] + d[j][x] - d[i][j]) / 2] FOR x IN range(1, len(l) + 1) IF x <> i AND x <> j] || [[(d[i][x] + d[j][x] - d[i][j]) / 2 FOR x IN range(1, len(l) + 1) IF x <> i AND x <> j] || [0.0::DOUBLE]], i, j, l, d FROM
(SELECT region, l, d, pr.i::INT AS i, pr.j::INT AS j FROM (SELECT region, l, d, list_sort(flatten([[{'q': round((len(l) - 2) * d[x][y] - list_sum(d[x]) - list_sum(d[y]), 9), 'i': x, 'j': y} FOR y IN range(x + 1, len(l) + 1)] FOR x IN range(1, len(l))]))[1] AS pr FROM u WHERE len(l) > 2))),
pl AS (SELECT region, l[-1] AS parent, before, was, i, j, (list_sum(was[i]) - list_sum(was[j])) / (len(before) - 2) AS delta FROM u WHERE i > 0),
ne AS (SELECT region, parent, before[i] AS child, 0 AS child_ord, (was[i][j] + delta) / 2 AS length FROM pl UNION ALL SELECT region, parent, before[j], 1, (was[i][j] - delta) / 2 FROM pl
UNION ALL SELECT region, '(' || l[1] || ',' || l[2] || ')', l[k], k - 1, d[1][2] / 2 FROM (SELECT region, l, d, unnest([1, 2]) AS k FROM u WHERE len(l) = 2))"""


def rounded(tree, digits=6):
    return tree.withColumn("length", F.round("length", digits) + 0.0)


@query("ph5_newick", P.with_("nations", more=_UPGMA.replace("{'l': new, ", "{'t': '(' || cl[pr.i].t || ':' || printf('%.2f', pr.d / 2 - cl[pr.i].age) || ',' || cl[pr.j].t || ':' || printf('%.2f', pr.d / 2 - cl[pr.j].age) || ')' || new, 'l': new, ").replace("[{'l': names[k], ", "[{'t': names[k]::VARCHAR, 'l': names[k], ")) + "SELECT region, cl[1].t || ';' AS newick FROM u WHERE len(cl) = 1")
def ph5(spark, d):
    return T.newicks(T.trees(region_distances(spark, d), ["region"]), ["region"])


@query("ph7_upgma", P.with_("nations", more=_UPGMA) + "SELECT region, parent::VARCHAR AS parent, child::VARCHAR AS child, child_ord, round(length, 6) + 0.0 AS length FROM ue")
def ph7(spark, d):
    return rounded(T.trees(region_distances(spark, d), ["region"]))


@query("ph8_neighbor_joining", P.with_("nations", more=_NJ) + "SELECT region, parent, child, child_ord::INT AS child_ord, round(length, 6) + 0.0 AS length FROM ne")
def ph8(spark, d):
    return rounded(T.trees(region_distances(spark, d), ["region"], "neighbor_joining"))


_TENS = """tn AS (SELECT item_id // 10 AS region, item_id AS id, seq FROM items)"""


def item_distances(spark, d):
    """Benchmark sequences in groups of ten by their numbers."""
    rows = P.items(spark, d).select(F.floor(F.col("item_id") / 10).alias("region"), F.col("item_id").alias("id"), "seq")
    return T.distances(rows, ["region"], order="id")


@query("ph7_items_upgma", P.with_("items", more=_TENS + ", " + _UPGMA.replace("nations", "tn")) + "SELECT region, parent::VARCHAR AS parent, child::VARCHAR AS child, child_ord, round(length, 6) + 0.0 AS length FROM ue")
def ph7_items(spark, d):
    return rounded(T.trees(item_distances(spark, d), ["region"]))


@query("ph8_items_neighbor_joining", P.with_("items", more=_TENS + ", " + _NJ.replace("nations", "tn")) + "SELECT region, parent, child, child_ord::INT AS child_ord, round(length, 6) + 0.0 AS length FROM ne")
def ph8_items(spark, d):
    return rounded(T.trees(item_distances(spark, d), ["region"], "neighbor_joining"))


@query("ph11_internal_edges", P.with_("nations", more=_UPGMA) + "SELECT region, parent::VARCHAR AS parent, child::VARCHAR AS child, child_ord, round(length, 6) + 0.0 AS length FROM ue x WHERE EXISTS (SELECT 1 FROM ue y WHERE y.region = x.region AND y.parent = x.child)")
def ph11(spark, d):
    return rounded(T.internal_edges(T.trees(region_distances(spark, d), ["region"]), ["region"]))


def even_lengths(spark, d):
    """region, ordinal, seq: a region's sequences filled up with gaps to its longest, as an alignment."""
    return T.padded(P.nations(spark, d).select("region", F.col("id").alias("ordinal"), "seq"), ["region"])


_EVEN = "ev AS (SELECT id, region, rpad(seq, (max(length(seq)) OVER (PARTITION BY region))::INT, '-') AS seq FROM nations)"
_EVEN_TREE = _EVEN + ", " + _REGION.replace("nations", "ev") + ", " + _HAM + ", " + _MATRIX.replace("nations", "ev") + ", nq AS (SELECT region, list(seq ORDER BY id) AS seqs FROM ev GROUP BY region), "
_COSTS = "[[least(list_min(cl[pr.i].c[k]) + 1, cl[pr.i].c[k][b]) + least(list_min(cl[pr.j].c[k]) + 1, cl[pr.j].c[k][b]) FOR b IN range(1, 6)] FOR k IN range(1, len(cl[1].c) + 1)]"
_PARSIMONY = _EVEN_TREE + merges(_START.replace("FROM nm JOIN dm USING (region)", "FROM nm JOIN dm USING (region) JOIN nq USING (region)").replace("[{'l'", "[{'c': [[CASE WHEN seqs[k][x] = b THEN 0.0 ELSE 1e9 END FOR b IN ['-', 'A', 'C', 'G', 'T']] FOR x IN range(1, length(seqs[1]) + 1)], 'l'")).replace("[{'l': new", f"[{{'c': {_COSTS}, 'l': new")


@query("ph9_small_parsimony", P.with_("nations", more=_PARSIMONY) + "SELECT region, (SELECT list_sum([list_min(x) FOR x IN cl[1].c]))::INT AS score, 9::BIGINT AS nodes, 5::BIGINT AS leaves FROM u WHERE len(cl) = 1")
def ph9(spark, d):
    """The score is the least possible on the tree, and the leaves keep their sequences."""
    rows = even_lengths(spark, d)
    found = T.small_parsimony(T.trees(T.distances(rows, ["region"]), ["region"]), rows, ["region"], alphabet="-ACGT")
    own = rows.select("region", F.col("ordinal").cast("string").alias("node"), F.col("seq").alias("label"))
    leaves = found.join(own, ["region", "node", "label"], "left_semi").groupBy("region").agg(F.count(F.lit(1)).alias("leaves"))
    return found.groupBy("region", "score").agg(F.count(F.lit(1)).alias("nodes")).join(leaves, "region")


@query("ph14_parsimony_search", P.with_("nations") + "SELECT region, unnest(range(0, 8))::INT AS seed, string_agg(id::VARCHAR, ' ' ORDER BY id::VARCHAR) AS leaves FROM nations GROUP BY region")
def ph14(spark, d):
    """Every search ends with a tree over all the sequences."""
    found = T.parsimony_trees(even_lengths(spark, d), ["region"], seeds=8, alphabet="-ACGT")
    return found.select("region", "seed", F.array_join(F.array_sort(F.regexp_extract_all("newick", F.lit(r"(\d+)"))), " ").alias("leaves"))


_PP = "pp AS (SELECT a.point_id AS i, b.point_id AS j, a.features AS x, b.features AS y FROM points a JOIN points b ON a.label = b.label AND a.point_id < b.point_id)"


@query("cl1_euclidean", P.with_("points", more=_PP) + "SELECT i, j, round(list_distance(x, y), 6) AS d FROM pp")
def cl1(spark, d):
    return C.distance_rows(P.single_points(spark, d), ["label"], digits=6).select("i", "j", "d")


@query("cl2_mean_point", P.with_("points", more="c AS (SELECT label, unnest(range(0, len(features))) AS k, unnest(features) AS x FROM points)") + "SELECT label, k::INT AS place, round(avg(x), 6) AS m FROM c GROUP BY ALL")
def cl2(spark, d):
    return C.mean_point(P.points(spark, d), ["label"]).select("label", F.posexplode("centre").alias("place", "m")).withColumn("m", F.round("m", 6))


@query("cl3_pearson", P.with_("points", more=_PP + ", pc AS (SELECT i, j, unnest(x) AS x, unnest(y) AS y FROM pp)") + "SELECT i, j, round(1 - corr(x, y), 6) AS d FROM pc GROUP BY i, j")
def cl3(spark, d):
    return C.distance_rows(P.single_points(spark, d), ["label"], "pearson", digits=6).select("i", "j", "d")


def first_points(spark, d, k):
    return [list(r["features"]) for r in P.points(spark, d).orderBy("point_id").limit(k).collect()]


_FIRST = "c0 AS (SELECT row_number() OVER (ORDER BY point_id) - 1 AS c, features AS m FROM (SELECT * FROM points ORDER BY point_id LIMIT 3))"


def _round(n: int) -> str:
    a = f"a{n} AS (SELECT point_id, features, c FROM (SELECT p.*, c, row_number() OVER (PARTITION BY point_id ORDER BY round(list_distance(features, m), 12), c) AS r FROM points p, c{n}) WHERE r = 1)"
    e = f"e{n} AS (SELECT c, unnest(range(0, len(features))) AS k, unnest(features) AS x FROM a{n}), f{n} AS (SELECT c, k, avg(x) AS x FROM e{n} GROUP BY ALL), c{n + 1} AS (SELECT c, list(x ORDER BY k) AS m FROM f{n} GROUP BY c)"
    return a + ", " + e


@query("cl5_k_centres", P.with_("points", more="""k1 AS (SELECT features AS m FROM points ORDER BY point_id LIMIT 1),
k2 AS (SELECT features AS m FROM points, k1 ORDER BY list_distance(features, m) DESC, point_id LIMIT 1),
k3 AS (SELECT p.features AS m FROM points p, k1, k2 ORDER BY least(list_distance(p.features, k1.m), list_distance(p.features, k2.m)) DESC, point_id LIMIT 1),
ks AS (SELECT 0 AS c, m FROM k1 UNION ALL SELECT 1, m FROM k2 UNION ALL SELECT 2, m FROM k3)""") + "SELECT point_id, c::INT AS cluster FROM (SELECT point_id, c, row_number() OVER (PARTITION BY point_id ORDER BY list_distance(features, m), c) AS r FROM points, ks) WHERE r = 1")  # fmt: skip
def cl5(spark, d):
    pts = P.points(spark, d).cache()
    return C.nearest(pts, C.k_centres(pts, 3, first_points(spark, d, 1)[0])).select("point_id", "cluster")


@query("cl6_lloyd", P.with_("points", more=", ".join([_FIRST, _round(0), _round(1), _round(2)])) + "SELECT c::INT AS cluster, k::INT AS place, round(x, 6) AS m FROM f2")
def cl6(spark, d):
    centres = C.lloyd(P.points(spark, d).cache(), first_points(spark, d, 3), rounds=3)
    return spark.createDataFrame([(i, j, round(float(x), 6)) for i, c in enumerate(centres) for j, x in enumerate(c)], "cluster int, place int, m double").withColumn("m", F.round("m", 6))


def _soft(n: int) -> str:
    return f"w{n} AS (SELECT point_id, features, c, exp(-list_distance(features, m)) AS w FROM points, c{n}), r{n} AS (SELECT *, w / sum(w) OVER (PARTITION BY point_id) AS rho FROM w{n}), e{n} AS (SELECT c, rho, unnest(range(0, len(features))) AS k, unnest(features) AS x FROM r{n}), f{n} AS (SELECT c, k, sum(rho * x) / sum(rho) AS x FROM e{n} GROUP BY ALL), c{n + 1} AS (SELECT c, list(x ORDER BY k) AS m FROM f{n} GROUP BY c)"


@query("cl7_soft_k_means", P.with_("points", more=", ".join([_FIRST, _soft(0), _soft(1)])) + "SELECT c::INT AS cluster, k::INT AS place, round(x, 6) AS m FROM f1")
def cl7(spark, d):
    centres = C.soft_k_means(P.points(spark, d).cache(), first_points(spark, d, 3), rounds=2)
    return spark.createDataFrame([(i, j, float(x)) for i, c in enumerate(centres) for j, x in enumerate(c)], "cluster int, place int, m double").withColumn("m", F.round("m", 6))


def label_distances(spark, d, kind):
    return C.distance_rows(P.points(spark, d), ["label"], kind)


@query("cl8_cast", P.with_("points") + "SELECT label, point_id, 1::BIGINT AS clusters FROM points")
def cl8(spark, d):
    """Each point is in one cluster."""
    found = C.cast_points(P.points(spark, d), ["label"], 0.3)
    return found.groupBy("label", "point_id").agg(F.countDistinct("cluster").alias("clusters"))


def aged(tree):
    return tree.withColumns({c: F.round(c, 6) + 0.0 for c in ("length", "age")})


@query("cl9_hierarchical", P.with_("nations", more=_REGION + ", " + _HAM + ", " + _MATRIX + ", " + merges(_START, 12)) + "SELECT region, parent::INT AS parent, child::INT AS child, round(length, 6) + 0.0 AS length, round(age, 6) + 0.0 AS age FROM ue")
def cl9(spark, d):
    return aged(C.hierarchy(region_distances(spark, d), ["region"])).drop("child_ord")


_EIGHT = """pts AS (SELECT point_id // 8 AS g, point_id, features FROM points), pp AS (SELECT a.g, a.point_id AS i, b.point_id AS j, a.features AS x, b.features AS y FROM pts a JOIN pts b ON a.g = b.g),
pu AS (SELECT g, i, j, unnest(x) AS x, unnest(y) AS y FROM pp), pd AS (SELECT g, i, j, CASE WHEN i = j THEN 0.0 ELSE round(1 - corr(x, y), 9) END AS d FROM pu GROUP BY g, i, j), pr AS (SELECT g, i, list(d ORDER BY j) AS r FROM pd GROUP BY g, i),
st AS (SELECT g, list(r ORDER BY i) AS dm, list_transform(list(i ORDER BY i), lambda x, k: {'l': x, 'm': [k], 'age': 0.0::DOUBLE}) AS cl, max(i) + 1 AS new FROM pr GROUP BY g)"""


def eights(spark, d, linkage):
    """The points in groups of eight by their numbers, clustered by Pearson distance."""
    pts = P.points(spark, d).withColumn("g", F.floor(F.col("point_id") / 8))
    dist = C.distance_rows(pts, ["g"], "pearson").withColumn("d", F.round("d", 9))
    return aged(C.hierarchy(dist, ["g"], linkage)).select("g", "parent", "child", "length", "age")


@query("cl4_tree_text", P.with_("points", more=_text_sql(merges(_EIGHT, 12, "list_avg", "g"), "g")) + "SELECT g, text FROM tx")
def cl4_tree(spark, d):
    pts = P.points(spark, d).withColumn("g", F.floor(F.col("point_id") / 8))
    return T.tree_text(C.hierarchy(C.distance_rows(pts, ["g"], "pearson").withColumn("d", F.round("d", 9)), ["g"]), ["g"])


def _linked(join: str) -> str:
    return P.with_("points", more=merges(_EIGHT, 12, join, "g")) + "SELECT g, parent::INT AS parent, child::INT AS child, round(length, 6) + 0.0 AS length, round(age, 6) + 0.0 AS age FROM ue"


@query("cl9_pearson_average", _linked("list_avg"))
def cl9_average(spark, d):
    return eights(spark, d, "avg")


@query("cl9_pearson_complete", _linked("list_max"))
def cl9_complete(spark, d):
    return eights(spark, d, "complete")


@query("cl9_pearson_single", _linked("list_min"))
def cl9_single(spark, d):
    return eights(spark, d, "single")


#: One dataset's clusters as sums of distances (m) and sizes (z); the merged cluster takes the place of the one with the smaller leaf.
_WHOLE = """qn AS (SELECT list(i ORDER BY i) AS l, list(1::BIGINT) AS z FROM leaf), qa AS (SELECT i, j, d FROM pair UNION ALL SELECT j, i, d FROM pair UNION ALL SELECT i, i, 0.0 FROM leaf),
qm AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(d ORDER BY j) AS r FROM qa GROUP BY i)), u AS (SELECT l, z, m, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS height FROM qn, qm UNION ALL
SELECT [l[k] FOR k IN range(1, len(l) + 1) IF k <> y], [CASE WHEN k = x THEN z[x] + z[y] ELSE z[k] END FOR k IN range(1, len(l) + 1) IF k <> y],
[[CASE WHEN k = x AND g = x THEN 0.0 WHEN k = x THEN m[x][g] + m[y][g] WHEN g = x THEN m[k][x] + m[k][y] ELSE m[k][g] END FOR g IN range(1, len(l) + 1) IF g <> y] FOR k IN range(1, len(l) + 1) IF k <> y], l[x], l[y], v FROM
(SELECT l, z, m, pr.v AS v, pr.x AS x, pr.y AS y FROM (SELECT l, z, m, list_min(flatten([[{'v': round(m[x][y] / (z[x] * z[y]), 9), 'x': x, 'y': y} FOR y IN range(x + 1, len(l) + 1)] FOR x IN range(1, len(l))])) AS pr FROM u WHERE len(l) > 1)))"""
_MERGES = "SELECT a, b, round(height, 6) + 0.0 AS height FROM u WHERE a IS NOT NULL"


@query("cl9_table_average", P.with_("points", more="leaf AS (SELECT point_id AS i FROM points WHERE features IS NOT NULL), pair AS (SELECT a.point_id AS i, b.point_id AS j, list_distance(a.features, b.features) AS d FROM points a JOIN points b ON a.point_id < b.point_id AND len(a.features) = len(b.features)), " + _WHOLE) + _MERGES)
def cl9_table(spark, d):
    """All points as one dataset, by average linkage of their Euclidean distances."""
    merged = agglomerate.agglomerate_points(P.points(spark, d))
    return merged.select("a", "b", (F.round("height", 6) + 0.0).alias("height"))


@query("ph7_table_upgma", P.with_("items", more="leaf AS (SELECT item_id AS i FROM items WHERE seq IS NOT NULL), pair AS (SELECT a.item_id AS i, b.item_id AS j, list_sum([CASE WHEN a.seq[x] <> b.seq[x] THEN 1.0 ELSE 0.0 END FOR x IN range(1, least(length(a.seq), length(b.seq)) + 1)])::DOUBLE AS d FROM items a JOIN items b ON a.item_id < b.item_id), " + _WHOLE + """,
s AS (SELECT a, b, height / 2 AS age, len(l) AS left_over FROM u WHERE a IS NOT NULL), e AS (SELECT b, age, left_over, 0 AS child_ord, a AS side FROM s UNION ALL SELECT b, age, left_over, 1, b FROM s),
f AS (SELECT e.b, e.age, e.child_ord, e.side, max_by(s.b, -s.left_over) AS inner_b, max_by(s.age, -s.left_over) AS inner_age FROM e LEFT JOIN s ON s.a = e.side AND s.left_over > e.left_over GROUP BY ALL)
""") + "SELECT 'm' || b AS parent, CASE WHEN inner_b IS NULL THEN side::VARCHAR ELSE 'm' || inner_b END AS child, child_ord, round(age - coalesce(inner_age, 0), 6) + 0.0 AS length FROM f")
def ph7_table(spark, d):
    """All sequences as one dataset, by their Hamming distances. Empty ones have none: they join last, without a height."""
    rows = P.items(spark, d).where("seq IS NOT NULL")
    apart = rows.groupBy(F.when(F.col("seq") == "", F.col("item_id")).alias("_e")).agg(F.min("item_id").alias("b"))
    late = apart.crossJoin(F.broadcast(apart.agg(F.min("b").alias("a")))).where("a < b").select("a", "b", F.lit(None).cast("double").alias("height"), F.lit(2**31 - 1).alias("round"))
    edges = agglomerate.tree(agglomerate.agglomerate_points(rows, "item_id", "seq").unionByName(late))
    return edges.select("parent", "child", "child_ord", (F.round("length", 6) + 0.0).alias("length"))


@query("hm1_alphabet", P.with_("dna") + "SELECT doc_id, coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS alphabet FROM (SELECT doc_id, unnest(CASE WHEN seq = '' THEN [NULL] ELSE string_split(seq, '') END) AS c FROM dna) GROUP BY doc_id")
def hm1(spark, d):
    return P.documents(spark, d).select("doc_id", F.array_join(H.alphabet_of(F.col("seq")), "").alias("alphabet"))


MODEL = H.Model(["A", "B"], np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]), "ACGT")
_T = "[[ln(0.8 + 1e-12), ln(0.2 + 1e-12)], [ln(0.3 + 1e-12), ln(0.7 + 1e-12)]]"
_E = "[[ln(0.4 + 1e-12), ln(0.3 + 1e-12), ln(0.2 + 1e-12), ln(0.1 + 1e-12)], [ln(0.1 + 1e-12), ln(0.2 + 1e-12), ln(0.3 + 1e-12), ln(0.4 + 1e-12)]]"
_FWD = f"""hm AS (SELECT {_T} AS t, {_E} AS e), fw AS (SELECT item_id, seq, 1 AS i, [e[1][strpos('ACGT', seq[1])] - ln(2), e[2][strpos('ACGT', seq[1])] - ln(2)] AS a FROM items, hm UNION ALL
SELECT item_id, seq, i + 1, [e[j][strpos('ACGT', seq[i + 1])] + greatest(a[1] + t[1][j], a[2] + t[2][j]) + ln(1 + exp(least(a[1] + t[1][j], a[2] + t[2][j]) - greatest(a[1] + t[1][j], a[2] + t[2][j]))) FOR j IN [1, 2]] FROM fw, hm WHERE i < length(seq))"""


@query("hm3_forward", P.with_("items", more=_FWD) + "SELECT item_id, round(greatest(a[1], a[2]) + ln(1 + exp(least(a[1], a[2]) - greatest(a[1], a[2]))), 5) AS ll FROM fw WHERE i = length(seq)")
def hm3(spark, d):
    return H.likelihoods(P.items(spark, d), MODEL).select("item_id", F.round("log_likelihood", 5).alias("ll"))


_HM4 = """k AS (SELECT region, col, sum((ch = '-')::INT) < count(*) * 0.5::DOUBLE AS keep FROM c GROUP BY ALL), l AS (SELECT region, col, keep, sum(keep::INT) OVER (PARTITION BY region ORDER BY col) AS lv FROM k),
s AS (SELECT region, id, col, ch, CASE WHEN keep THEN CASE WHEN ch = '-' THEN 3 * lv ELSE 3 * lv - 1 END WHEN ch <> '-' THEN CASE WHEN lv = 0 THEN 1 ELSE 3 * lv + 1 END END AS st FROM c JOIN l USING (region, col)),
p AS (SELECT region, id, col, st, lag(st, 1, 0) OVER (PARTITION BY region, id ORDER BY col) AS b, lead(st) OVER (PARTITION BY region, id ORDER BY col) AS a FROM s WHERE st IS NOT NULL),
m AS (SELECT region, 3 * max(lv) + 2 AS e FROM l GROUP BY region)"""


@query("hm4_profile_counts", P.with_("nations", more=_GAPPED + ", " + _COLS + ", " + _HM4) + "SELECT region, src::INT AS src, dst::INT AS dst, count(*) AS n FROM (SELECT region, b AS src, st AS dst FROM p UNION ALL SELECT region, st, e FROM p JOIN m USING (region) WHERE a IS NULL) GROUP BY ALL")
def hm4(spark, d):
    return H.profile_counts(gapped(spark, d), ["region"], 0.5, order="id").select("region", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "n")


_HM7 = """, al AS (SELECT m.region, i AS src, unnest(CASE WHEN f + 2 <= e THEN [f, f + 1, f + 2] ELSE [e - 1, e] END) AS dst FROM (SELECT region, e, i, CASE WHEN i = 0 THEN 1 WHEN i % 3 = 1 THEN i WHEN i % 3 = 2 THEN i + 2 ELSE i + 1 END AS f FROM (SELECT region, e, unnest(range(0, e::BIGINT)) AS i FROM m)) m),
tc AS (SELECT region, src, dst, count(*) AS n FROM (SELECT region, b AS src, st AS dst FROM p UNION ALL SELECT region, st, e FROM p JOIN m USING (region) WHERE a IS NULL) GROUP BY ALL),
t1 AS (SELECT region, src, dst, sum(p) AS p FROM (SELECT region, src, dst, n / sum(n) OVER (PARTITION BY region, src) AS p FROM tc UNION ALL SELECT region, src, dst, 0.01::DOUBLE FROM al) GROUP BY ALL),
ec AS (SELECT region, st AS src, strpos('ACGT', ch) - 1 AS dst, count(*) AS n FROM s WHERE st IS NOT NULL AND ch <> '-' GROUP BY ALL),
e1 AS (SELECT region, src, dst, sum(p) AS p FROM (SELECT region, src, dst, n / sum(n) OVER (PARTITION BY region, src) AS p FROM ec UNION ALL SELECT region, i, unnest([0, 1, 2, 3]), 0.01::DOUBLE FROM (SELECT region, unnest(range(0, e::BIGINT)) AS i FROM m) WHERE i % 3 <> 0) GROUP BY ALL)"""


@query("hm7_profile_models", P.with_("nations", more=_GAPPED + ", " + _COLS + ", " + _HM4 + _HM7) + "SELECT region, 'T' AS kind, src::INT AS src, dst::INT AS dst, round(p / sum(p) OVER (PARTITION BY region, src), 6) AS p FROM t1 UNION ALL SELECT region, 'E', src::INT, dst::INT, round(p / sum(p) OVER (PARTITION BY region, src), 6) FROM e1")
def hm7(spark, d):
    m = H.profile_model(gapped(spark, d), ["region"], order="id")
    return m.select("region", "kind", F.col("src").cast("int").alias("src"), F.col("to").cast("int").alias("dst"), F.round("p", 6).alias("p"))


@query("hm5_state_names", P.with_("nations", more="k AS (SELECT region, count(*) AS k FROM nations GROUP BY region), n AS (SELECT region, ['S', 'I0'] || flatten([['M' || i, 'D' || i, 'I' || i] FOR i IN range(1, k + 1)]) || ['E'] AS n FROM k)") + "SELECT region, unnest(range(0, len(n)))::INT AS idx, unnest(n) AS name FROM n")
def hm5(spark, d):
    """The states of a model with a level for each sequence of a region."""
    levels = P.nations(spark, d).groupBy("region").count().collect()  # five regions at every scale
    return spark.createDataFrame([(r["region"], i, name) for r in levels for i, name in enumerate(H.state_names(r["count"]))], "region int, idx int, name string")


@query("hm8_profile_path", P.with_("nations") + "SELECT id, length(seq) AS emitted, true AS in_order FROM nations")
def hm8(spark, d):
    """A path's matches and insertions emit the sequence, and it goes through the levels in order."""
    rows = sorted((r["id"], r["seq"]) for r in P.nations(spark, d).collect())  # training sequences: 25 at every scale
    model = H.build_profile(A.progressive([s for _, s in rows]))
    path = F.split("path", " ")
    level = F.transform(F.filter(path, lambda x: ~x.startswith("I")), lambda x: F.substring(x, 2, 9).cast("int"))
    emitted = F.size(F.filter(path, lambda x: ~x.startswith("D"))).cast("long")
    return H.decode(P.nations(spark, d), model).select("id", emitted.alias("emitted"), (level == F.sequence(F.lit(1), F.lit((len(model.states) - 3) // 3))).alias("in_order"))


def _lse(x: str, y: str) -> str:
    return f"greatest({x}, {y}) + ln(1 + exp(least({x}, {y}) - greatest({x}, {y})))"


def _sums(k: int, model: str, last: bool = False) -> str:
    """From model (g, t, e: logarithms) and xs (g, item_id, seq): forward and backward sums of each sequence, expected transitions
    xi (g, item_id, s, j, n) and emissions ga (g, s, c, n)."""
    e = f"e[j][strpos('ACGT', seq[i + 1])]"
    fw = f"""fw{k} AS (SELECT g, item_id, seq, t, e, 1 AS i, [e[1][strpos('ACGT', seq[1])] - ln(2), e[2][strpos('ACGT', seq[1])] - ln(2)] AS a FROM xs JOIN {model} USING (g) WHERE seq <> '' UNION ALL
SELECT g, item_id, seq, t, e, i + 1, [{e} + {_lse('a[1] + t[1][j]', 'a[2] + t[2][j]')} FOR j IN [1, 2]] FROM fw{k} WHERE i < length(seq))"""
    step = "t[s][{0}] + e[{0}][strpos('ACGT', seq[i])] + b[{0}]"
    bw = f"""bw{k} AS (SELECT g, item_id, seq, t, e, length(seq) AS i, [0.0::DOUBLE, 0.0] AS b FROM xs JOIN {model} USING (g) WHERE seq <> '' UNION ALL
SELECT g, item_id, seq, t, e, i - 1, [{_lse(step.format(1), step.format(2))} FOR s IN [1, 2]] FROM bw{k} WHERE i > 1)"""
    ll = f"ll{k} AS (SELECT g, item_id, {_lse('a[1]', 'a[2]')} AS ll FROM fw{k} WHERE i = length(seq))"
    xi = f"""xc{k} AS (SELECT f.g, f.item_id, f.i, s, j, exp(f.a[s] + f.t[s][j] + f.e[j][strpos('ACGT', f.seq[f.i + 1])] + b.b[j] - ll) AS n FROM fw{k} f JOIN bw{k} b ON b.g = f.g AND b.item_id = f.item_id AND b.i = f.i + 1 JOIN ll{k} l ON l.g = f.g AND l.item_id = f.item_id, (VALUES (1), (2)) x(s), (VALUES (1), (2)) y(j)),
xi{k} AS (SELECT g, item_id, s, j, sum(n) AS n FROM (SELECT g, item_id, i, s, j, n / sum(n) OVER (PARTITION BY g, item_id, i) AS n FROM xc{k}) GROUP BY ALL)"""
    ga = f"""ga{k} AS (SELECT f.g, s, strpos('ACGT', f.seq[f.i]) AS c, sum(exp(f.a[s] + b.b[s] - ll)) AS n FROM fw{k} f JOIN bw{k} b ON b.g = f.g AND b.item_id = f.item_id AND b.i = f.i JOIN ll{k} l ON l.g = f.g AND l.item_id = f.item_id, (VALUES (1), (2)) x(s) GROUP BY f.g, s, c)"""
    return ", ".join([fw, bw, ll, xi, ga])


def _new_model(k: int, transitions: str, emissions: str) -> str:
    """hm{k} from transitions (g, s, j, n) and emissions (g, s, c, n), with its shares in pt{k} and pe{k}."""
    return f"""pt{k} AS (SELECT g, s, j, coalesce(n / nullif(sum(n) OVER (PARTITION BY g, s), 0), 0) AS p FROM (SELECT g, s, j, coalesce(sum(n), 0) AS n FROM (SELECT g, s, j FROM (SELECT DISTINCT g FROM xs) x, (VALUES (1), (2)) a(s), (VALUES (1), (2)) b(j)) q LEFT JOIN {transitions} USING (g, s, j) GROUP BY ALL)),
pe{k} AS (SELECT g, s, c, coalesce(n / nullif(sum(n) OVER (PARTITION BY g, s), 0), 0) AS p FROM (SELECT g, s, c, coalesce(sum(n), 0) AS n FROM (SELECT g, s, c FROM (SELECT DISTINCT g FROM xs) x, (VALUES (1), (2)) a(s), (VALUES (1), (2), (3), (4)) b(c)) q LEFT JOIN {emissions} USING (g, s, c) GROUP BY ALL)),
hm{k} AS (SELECT g, t, e FROM (SELECT g, list(r ORDER BY s) AS t FROM (SELECT g, s, list(ln(p + 1e-12) ORDER BY j) AS r FROM pt{k} GROUP BY g, s) GROUP BY g) JOIN (SELECT g, list(r ORDER BY s) AS e FROM (SELECT g, s, list(ln(p + 1e-12) ORDER BY c) AS r FROM pe{k} GROUP BY g, s) GROUP BY g) USING (g))"""


def _best_path(k: int, model: str) -> str:
    """vp{k} (g, item_id, seq, p): the states of the best path, and their counts vt{k} and ve{k}."""
    return f"""vi{k} AS (SELECT g, item_id, seq, t, e, 1 AS i, [e[1][strpos('ACGT', seq[1])] - ln(2), e[2][strpos('ACGT', seq[1])] - ln(2)] AS a, [[1], [2]] AS p FROM xs JOIN {model} USING (g) WHERE seq <> '' UNION ALL
SELECT g, item_id, seq, t, e, i + 1, [greatest(a[1] + t[1][j], a[2] + t[2][j]) + e[j][strpos('ACGT', seq[i + 1])] FOR j IN [1, 2]], [(CASE WHEN a[1] + t[1][j] >= a[2] + t[2][j] THEN p[1] ELSE p[2] END) || [j] FOR j IN [1, 2]] FROM vi{k} WHERE i < length(seq)),
vp{k} AS (SELECT g, item_id, seq, CASE WHEN a[1] >= a[2] THEN p[1] ELSE p[2] END AS p FROM vi{k} WHERE i = length(seq)),
vs{k} AS (SELECT g, item_id, seq, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s, p FROM vp{k}), vt{k} AS (SELECT g, s, p[i + 1] AS j, count(*) AS n FROM vs{k} WHERE i < len(p) GROUP BY ALL), ve{k} AS (SELECT g, s, strpos('ACGT', seq[i]) AS c, count(*) AS n FROM vs{k} GROUP BY ALL)"""


_ALL = f"xs AS (SELECT 0 AS g, item_id, seq FROM items), hm0 AS (SELECT 0 AS g, {_T} AS t, {_E} AS e)"
_EACH = f"xs AS (SELECT item_id AS g, item_id, seq FROM items), hm0 AS (SELECT item_id AS g, {_T} AS t, {_E} AS e FROM items)"
_ROUND = lambda k: _sums(k, f"hm{k}") + ", " + _new_model(k + 1, f"xi{k}", f"ga{k}")
_HARD = lambda k: _best_path(k, f"hm{k}") + ", " + _new_model(k + 1, f"vt{k}", f"ve{k}")


def _model_sql(more: str, k: int) -> str:
    return P.with_("items", more=more) + f"SELECT 'T' AS kind, (s - 1)::INT AS row, (j - 1)::VARCHAR AS col, round(p, 6) AS p FROM pt{k} UNION ALL SELECT 'E', (s - 1)::INT, 'ACGT'[c], round(p, 6) FROM pe{k}"


@query("hm9_log_sum_exp", P.with_("points") + "SELECT point_id, round(ln(list_sum([exp(x) FOR x IN features])), 6) AS v FROM points")
def hm9(spark, d):
    return P.points(spark, d).select("point_id", F.round(H.log_sum_exp(F.col("features")), 6).alias("v"))


def _model_rows(spark, m):
    t, e = H.model_rows(spark, m)
    return t.select(F.lit("T").alias("kind"), F.col("from").alias("row"), F.col("to").cast("string").alias("col"), F.round("p", 6).alias("p")).union(e.select(F.lit("E"), "state", "sym", F.round("p", 6)))


@query("hm11_baum_welch", _model_sql(", ".join([_ALL, *map(_ROUND, range(5))]), 5))
def hm11(spark, d):
    return _model_rows(spark, H.train(P.items(spark, d), MODEL))


@query("hm12_viterbi_decode", P.with_("items", more=_ALL + ", " + _best_path(0, "hm0")) + "SELECT item_id, array_to_string(['AB'[x] FOR x IN p], ' ') AS path FROM vp0")
def hm12(spark, d):
    return H.decode(P.items(spark, d), MODEL, "plain").select("item_id", "path")


@query("hm13_viterbi_training", _model_sql(", ".join([_ALL, *map(_HARD, range(5))]), 5))
def hm13(spark, d):
    return _model_rows(spark, H.train(P.items(spark, d), MODEL, hard=True))


@query("hm14_most_divergent", P.with_("items", more=", ".join([_EACH, *map(_ROUND, range(5)), _sums(5, "hm5")])) + "SELECT item_id, round(ll, 4) AS log_likelihood FROM ll5 ORDER BY ll, item_id LIMIT 1")
def hm14(spark, d):
    return H.most_divergent(P.items(spark, d), MODEL, order="item_id").withColumn("log_likelihood", F.round("log_likelihood", 4))


@query("ph10_random_trees", P.with_("nations") + "SELECT region, id::VARCHAR AS leaf, 8::BIGINT AS edges FROM nations")
def ph10(spark, d):
    """A random tree has each sequence as a leaf, once, and twice as many edges as it has joins."""
    found = T.random_trees(even_lengths(spark, d), ["region"], seed=4)
    inner = found.select("region", F.col("parent").alias("child")).distinct()
    size = found.groupBy("region").agg(F.count(F.lit(1)).alias("edges"))
    return found.join(inner, ["region", "child"], "left_anti").join(size, "region").select("region", F.col("child").alias("leaf"), "edges")


@query("ph13_nni_variants", P.with_("nations", more=_UPGMA + """, uw AS (SELECT a.region, a.parent AS pu, a.child AS pv, s.child AS sib, c.child AS kid FROM ue a JOIN ue s ON s.region = a.region AND s.parent = a.parent AND s.child <> a.child JOIN ue c ON c.region = a.region AND c.parent = a.child),
nv AS (SELECT w.region, e.parent, CASE WHEN e.parent = pu AND e.child = sib THEN kid WHEN e.parent = pv AND e.child = kid THEN sib ELSE e.child END AS child FROM uw w JOIN ue e ON e.region = w.region)""") + "SELECT region, parent::VARCHAR AS parent, child::VARCHAR AS child, count(*) AS n FROM nv GROUP BY ALL")
def ph13(spark, d):
    """How many of a tree's NNI neighbours have an edge."""
    found = T.tree_variants(T.trees(region_distances(spark, d), ["region"]), ["region"])
    return found.groupBy("region", "parent", "child").agg(F.count(F.lit(1)).alias("n"))


@query("ph5_tree_text", P.with_("nations", more=_text_sql(_UPGMA, "region")) + "SELECT region, text FROM tx")
def ph5_text(spark, d):
    return T.tree_text(T.trees(region_distances(spark, d), ["region"]), ["region"])


@query("cl4_format", P.with_("points", more=_FIRST + ", a0 AS (SELECT point_id, features, c FROM (SELECT p.*, c, row_number() OVER (PARTITION BY point_id ORDER BY round(list_distance(features, m), 12), c) AS r FROM points p, c0) WHERE r = 1), f0 AS (SELECT c, point_id, '(' || array_to_string([printf('%.1f', x) FOR x IN features], ', ') || ')' AS t FROM a0)") + "SELECT c::INT AS cluster, 'Cluster ' || (c + 1) || ': [' || string_agg(t, ', ' ORDER BY point_id) || '] and centre = (' || (SELECT array_to_string([printf('%.1f', x) FOR x IN m], ', ') FROM c0 WHERE c0.c = f0.c) || ')' AS text FROM f0 GROUP BY c")
def cl4(spark, d):
    centres = first_points(spark, d, 3)
    return C.format_clusters(C.nearest(P.points(spark, d), centres), centres)


@query("hm2_model_text", P.with_("items", more="""l AS (SELECT item_id % 2 AS state, unnest(string_split(seq, '')) AS c FROM items), c4 AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c),
n AS (SELECT s.state, c4.c, (SELECT count(*) FROM l WHERE l.state = s.state AND l.c = c4.c) + 1 AS n FROM (VALUES (0), (1)) s(state), c4), sh AS (SELECT state, c, round(n / sum(n) OVER (PARTITION BY state), 3) AS p FROM n),
ln AS (SELECT state, string_agg(p::VARCHAR, ' ' ORDER BY c) AS e FROM sh GROUP BY state)""") + """SELECT 'States:' || chr(10) || 'A B' || chr(10) || chr(10) || 'Transition Matrix:' || chr(10) || '0.8 0.2' || chr(10) || '0.3 0.7' || chr(10) || chr(10) || 'Emission Matrix:' || chr(10) || string_agg(e || chr(10), '' ORDER BY state) AS text FROM ln""")  # fmt: skip
def hm2(spark, d):
    """A model whose states emit the letters of the even and of the odd items, as text."""
    seen = P.items(spark, d).select((F.col("item_id") % 2).alias("state"), F.explode(K.letters(F.col("seq"))).alias("c")).groupBy("state", "c").count().collect()
    n = {(r["state"], r["c"]): r["count"] for r in seen}
    counts = np.array([[n.get((s, c), 0) + 1 for c in "ACGT"] for s in (0, 1)])
    own = H.Model(MODEL.states, MODEL.transition, np.round(counts / counts.sum(1, keepdims=True), 3), "ACGT")
    return spark.createDataFrame([(H.model_text(own),)], "text string")


@query("hm10_expected_transitions", P.with_("items", more=", ".join([_ALL, _sums(0, "hm0")])) + "SELECT item_id, (s - 1)::INT AS src, (j - 1)::INT AS dst, round(n, 6) AS n FROM xi0")
def hm10(spark, d):
    e = H.expected(P.items(spark, d), MODEL, "item_id")
    return e.select("item_id", "src", "dst", F.round("n", 6).alias("n"))


@query("io10_profile_alignment", P.with_("items", more=_TENS + ", pw AS (SELECT region, count(*) AS rows FROM tn GROUP BY region)") + "SELECT region, id, seq, true AS even, true AS adds_up, true AS not_below_consensus, rows FROM tn JOIN pw USING (region)")
def io10_profiles(spark, d):
    """Sequences by tens: whole, in rows of one length, whose columns add up to the score, which is no less than that of the alignment to a consensus."""
    rows = P.items(spark, d).select(F.floor(F.col("item_id") / 10).alias("region"), F.col("item_id").alias("id"), "seq")
    got = stored(profiles.profile_alignment(rows, ["region"], "id"), small=True)
    plain = profiles.column_totals(A.progressive_alignment(rows, ["region"], "id"), ["region"]).withColumnRenamed("total", "consensus")
    whole = Window.partitionBy("region")
    out = got.join(profiles.column_totals(got, ["region"]), "region").join(plain, "region")
    size = F.length("aligned")
    return out.select("region", "id", F.translate("aligned", "-", "").alias("seq"), (F.min(size).over(whole) == F.max(size).over(whole)).alias("even"), (F.abs(F.col("total") - F.col("score")) < 1e-6).alias("adds_up"), (F.col("score") >= F.col("consensus")).alias("not_below_consensus"), F.count("*").over(whole).alias("rows"))


@query("io10_progressive_alignment", P.with_("nations") + "SELECT region, id, seq, true AS even FROM nations")
def io10(spark, d):
    found = A.progressive_alignment(P.nations(spark, d), ["region"], order="id")
    found = found.withColumnRenamed("aligned", "x")
    return found.select("region", "id", F.translate("x", "-", "").alias("seq"), (F.length("x") == F.max(F.length("x")).over(Window.partitionBy("region"))).alias("even"))
