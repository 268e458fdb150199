"""Queries of the rearrangement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import kmers as K
from ..operators import rearrange as R
from .registry import query
from .sequence_queries import RC, kmer_cte


@query("gr1_base4", P.with_("items", more=kmer_cte("k", "items", "item_id", 10)) + "SELECT item_id, pos::INT AS pos, " + " + ".join(f"(strpos('ACGT', kmer[{i}]) - 1) * {4 ** (10 - i)}::BIGINT" for i in range(1, 11)) + " AS number FROM kk")
def gr1(spark, d):
    return K.kmers(P.items(spark, d), 10).select("item_id", "pos", K.base4(F.col("kmer")).alias("number"))


@query("gr2_base4_reverse_complement", P.with_("items", more=kmer_cte("k", "items", "item_id", 10) + f", r AS (SELECT item_id, pos, {RC.format('kmer')} AS kmer FROM kk)") + "SELECT item_id, pos::INT AS pos, " + " + ".join(f"(strpos('ACGT', kmer[{i}]) - 1) * {4 ** (10 - i)}::BIGINT" for i in range(1, 11)) + " AS number FROM r")
def gr2(spark, d):
    return K.kmers(P.items(spark, d), 10).select("item_id", "pos", K.base4_reverse_complement(K.base4(F.col("kmer")), 10).alias("number"))


def _genomes(spark, d):
    """Each item against the next one."""
    items = P.items(spark, d)
    return items.withColumnRenamed("item_id", "g"), items.select((F.col("item_id") - 1).alias("g"), "seq")


_P = "p AS (SELECT item_id AS g, seq FROM items), q AS (SELECT item_id - 1 AS g, seq FROM items)"


def _shared(k: int, reversal: bool = False) -> str:
    strands = f"SELECT g, pos AS j, kmer, '+' AS orient FROM qkk UNION ALL SELECT g, pos, {RC.format('kmer')}, '-' FROM qkk" + (" UNION ALL SELECT g, pos, reverse(kmer), '-' FROM qkk" if reversal else "")
    return f"{_P}, {kmer_cte('pk', 'p', 'g', k)}, {kmer_cte('qk', 'q', 'g', k)}, qs2 AS ({strands}), mt AS (SELECT g, pkk.pos::INT AS i, qs2.j::INT AS j, orient FROM pkk JOIN qs2 USING (g, kmer))"


@query("gr3_shared_kmers", P.with_("items", more=_shared(6)) + "SELECT * FROM mt")
def gr3(spark, d):
    return R.shared_kmers(*_genomes(spark, d), 6, ["g"])


@query("gr5_shared_kmers_three_strands", P.with_("items", more=_shared(6, True)) + "SELECT * FROM mt")
def gr5(spark, d):
    return R.shared_kmers(*_genomes(spark, d), 6, ["g"], reversed_too=True)


def _chromosomes(spark, d):
    items = P.items(spark, d).withColumnRenamed("item_id", "ordinal")
    return items.where("ordinal % 2 = 0"), items.where("ordinal % 2 = 1")


_CHROM = "o AS (SELECT item_id AS c, item_id % 2 AS side, seq, coalesce(sum(length(seq)) OVER (PARTITION BY item_id % 2 ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sh FROM items), ok AS (SELECT c, side, sh, seq, unnest(range(0, length(seq) - 8)) AS pos FROM o), km AS (SELECT c, side, (pos + sh)::BIGINT AS place, substr(seq, pos + 1, 9) AS kmer FROM ok)"
_CHROM += f", st AS (SELECT c, place, kmer, '+' AS orient FROM km WHERE side = 1 UNION ALL SELECT c, place, {RC.format('kmer')}, '-' FROM km WHERE side = 1 UNION ALL SELECT c, place, reverse(kmer), '-' FROM km WHERE side = 1), cm AS (SELECT a.c AS p_chrom, b.c AS q_chrom, a.place AS i, b.place AS j, b.orient FROM km a JOIN st b USING (kmer) WHERE a.side = 0)"


@query("gr4_shared_kmers_chromosomes", P.with_("items", more=_CHROM) + "SELECT * FROM cm")
def gr4(spark, d):
    return R.shared_kmers_chromosomes(*_chromosomes(spark, d), 9)


@query("io14_dot_plot", P.with_("items", more=_CHROM) + "SELECT i / 1000.0::DOUBLE AS x, j / 1000.0::DOUBLE AS y, orient AS strand FROM cm")
def io14(spark, d):
    return R.dot_plot(R.shared_kmers_chromosomes(*_chromosomes(spark, d), 9)).select("x", "y", "strand")


_D = 8
_EDGES = _shared(6) + f", dm AS (SELECT DISTINCT * FROM mt), ed AS (SELECT a.g, a.i AS ai, a.j AS aj, a.orient AS ao, b.i AS bi, b.j AS bj, b.orient AS bo FROM dm a JOIN dm b ON a.g = b.g AND abs(a.i - b.i) <= {_D} AND abs(a.j - b.j) <= {_D} AND (a.i, a.j, a.orient) <> (b.i, b.j, b.orient))"
_COMP = _EDGES + """, rc AS (SELECT DISTINCT g, ai AS i, aj AS j, ao AS o, ai AS ri, aj AS rj, ao AS ro FROM ed UNION SELECT ed.g, bi, bj, bo, ri, rj, ro FROM rc JOIN ed ON ed.g = rc.g AND ai = i AND aj = j AND ao = o),
cp AS (SELECT g, i, j, o, min((ri, rj, ro)) AS c FROM rc GROUP BY g, i, j, o), sz AS (SELECT *, count(*) OVER (PARTITION BY g, c) AS n FROM cp)"""


def _matches(spark, d):
    return R.shared_kmers(*_genomes(spark, d), 6, ["g"])


@query("gr6_synteny_edges", P.with_("items", more=_EDGES) + "SELECT g, ai, aj, ao, bi, bj, bo FROM ed WHERE (ai, aj, ao) < (bi, bj, bo)")
def gr6(spark, d):
    e = R.synteny_edges(_matches(spark, d), _D, ["g"])
    return e.select("g", *[F.col(f"{s}.{c}").alias(f"{t}{n}") for s, t in (("src", "a"), ("dst", "b")) for c, n in (("i", "i"), ("j", "j"), ("orient", "o"))])


def _blocks(spark, d, n):
    return R.synteny_blocks(_matches(spark, d), _D, n, ["g"])


@query("gr7_components", P.with_("items", more=_COMP) + "SELECT g, i, j, o AS orient, c.ri AS ci, c.rj AS cj FROM (SELECT g, i, j, o, {'ri': c[1], 'rj': c[2]} AS c FROM sz)")
def gr7(spark, d):
    return _blocks(spark, d, 1).select("g", "i", "j", "orient", F.col("block.m.i").alias("ci"), F.col("block.m.j").alias("cj"))


@query("gr8_synteny_blocks", P.with_("items", more=_COMP) + "SELECT g, i, j, o AS orient FROM sz WHERE n >= 3")
def gr8(spark, d):
    return _blocks(spark, d, 3).select("g", "i", "j", "orient")


@query("gr9_signed_permutations", P.with_("items", more=_COMP + ", mb AS (SELECT g, c, avg(i) AS p, avg(j) AS q, sum(CASE o WHEN '+' THEN 1 ELSE -1 END) AS s FROM sz WHERE n >= 3 GROUP BY g, c)") + "SELECT g, (row_number() OVER (PARTITION BY g ORDER BY p, c))::INT AS id, (row_number() OVER (PARTITION BY g ORDER BY q, c))::INT AS q_rank, CASE WHEN s >= 0 THEN 1 ELSE -1 END AS sign FROM mb")
def gr9(spark, d):
    return R.signed_permutation(_blocks(spark, d, 3), ["g"])


_COMP10 = _CHROM.replace("length(seq) - 8)", "length(seq) - 7)").replace("pos + 1, 9)", "pos + 1, 8)") + """, dm AS (SELECT DISTINCT p_chrom AS p, q_chrom AS q, i, j, orient FROM cm),
ed AS (SELECT a.p, a.q, a.i AS ai, a.j AS aj, a.orient AS ao, b.i AS bi, b.j AS bj, b.orient AS bo FROM dm a JOIN dm b ON a.p = b.p AND a.q = b.q AND abs(a.i - b.i) <= 12 AND abs(a.j - b.j) <= 12 AND (a.i, a.j, a.orient) <> (b.i, b.j, b.orient)),
rc AS (SELECT DISTINCT p, q, ai AS i, aj AS j, ao AS o, ai AS ri, aj AS rj, ao AS ro FROM ed UNION SELECT ed.p, ed.q, bi, bj, bo, ri, rj, ro FROM rc JOIN ed ON ed.p = rc.p AND ed.q = rc.q AND ai = i AND aj = j AND ao = o),
cp AS (SELECT p, q, i, j, o, min((ri, rj, ro)) AS c FROM rc GROUP BY p, q, i, j, o),
mb AS (SELECT p, q, c, avg(i) AS x, avg(j) AS y, sum(CASE o WHEN '+' THEN 1 ELSE -1 END) AS s FROM cp GROUP BY p, q, c HAVING count(*) >= 3),
nb AS (SELECT *, row_number() OVER (ORDER BY p, x, q, c) AS id FROM mb)"""


@query("gr10_permutations_by_chromosome", P.with_("items", more=_COMP10) + """SELECT 'P' AS genome, p AS chrom, (row_number() OVER (PARTITION BY p ORDER BY x, q, c))::INT AS ord, id::INT AS block FROM nb
UNION ALL SELECT 'Q', q, (row_number() OVER (PARTITION BY q ORDER BY y, p, c))::INT, (CASE WHEN s >= 0 THEN id ELSE -id END)::INT FROM nb""")  # fmt: skip
def gr10(spark, d):
    m = R.shared_kmers_chromosomes(*_chromosomes(spark, d), 8)
    p, q = R.permutations_by_chromosome(R.synteny_blocks(m, 12, 3, ["p_chrom", "q_chrom"]))
    return p.select(F.lit("P").alias("genome"), "chrom", "ord", "block").union(q.select(F.lit("Q"), "chrom", "ord", "block"))


@query("gr11_breakpoints", P.with_("blocks") + "SELECT o, list_sum([CASE WHEN (perm || [len(perm) + 1])[x] - ([0] || perm)[x] <> 1 THEN 1 ELSE 0 END FOR x IN range(1, len(perm) + 2)])::INT AS n FROM perms")
def gr11(spark, d):
    return P.permutations(spark, d).select("o", R.breakpoints(F.col("perm")).alias("n"))


@query("gr12_reversal", P.with_("blocks") + "SELECT o, array_to_string(perm[:len(perm) // 3] || [-x FOR x IN list_reverse(perm[len(perm) // 3 + 1:len(perm) // 2 + 1])] || perm[len(perm) // 2 + 2:], ' ') AS perm FROM perms")
def gr12(spark, d):
    n = F.size("perm")
    return P.permutations(spark, d).select("o", F.array_join(R.reversal(F.col("perm"), (n / 3).cast("int"), (n / 2).cast("int")).cast("array<string>"), " ").alias("perm"))


_GAIN = "(p[i + 1] - p[i] <> 1)::INT + (p[j + 2] - p[j + 1] <> 1)::INT - (-p[j + 1] - p[i] <> 1)::INT - (p[j + 2] + p[i + 1] <> 1)::INT"


@query("gr13_breakpoint_sort", P.with_("blocks", more=f"""z AS (SELECT o, [0] || perm || [len(perm) + 1] AS p, 0 AS n, true AS go FROM perms UNION ALL
SELECT o, CASE WHEN c IS NULL THEN p ELSE p[:c.i] || [-x FOR x IN list_reverse(p[c.i + 1:c.j + 1])] || p[c.j + 2:] END, n + (c IS NOT NULL)::INT, c IS NOT NULL FROM (SELECT o, p, n, list_sort(list_filter(flatten([[{{'g': -({_GAIN}), 'i': i, 'j': j}} FOR j IN range(i, len(p) - 1)] FOR i IN range(1, len(p) - 1)]), lambda x: x.g < 0))[1] AS c FROM z WHERE go))""") + "SELECT o, max(n)::INT AS n_reversals FROM z GROUP BY o")
def gr13(spark, d):
    return R.breakpoint_sort(P.permutations(spark, d)).select("o", "n_reversals")


@query("gr14_cycle_codec", P.with_("blocks") + "SELECT o, array_to_string(list_reduce([]::BIGINT[][] || [CASE WHEN x > 0 THEN [2 * x - 1, 2 * x] ELSE [-2 * x, -2 * x - 1] END FOR x IN perm], lambda a, b: a || b), ' ') AS cycle, array_to_string(perm, ' ') AS back FROM perms")
def gr14(spark, d):
    c = P.permutations(spark, d).withColumn("c", R.chromosome_to_cycle(F.col("perm")))
    text = lambda x: F.array_join(x.cast("array<string>"), " ")
    return c.select("o", text(F.col("c")).alias("cycle"), text(R.cycle_to_chromosome(F.col("c"))).alias("back"))


_CE = """nd AS (SELECT o, genome, ord, CASE WHEN block > 0 THEN 2 * block - 1 ELSE -2 * block END AS i, CASE WHEN block > 0 THEN 2 * block ELSE -2 * block - 1 END AS a FROM blocks),
ce AS (SELECT o, genome, a, coalesce(lead(i) OVER w, first_value(i) OVER w) AS b FROM nd WINDOW w AS (PARTITION BY o, genome ORDER BY ord))"""


@query("gr15_colored_edges", P.with_("blocks", more=_CE) + "SELECT o, genome, a::INT AS a, b::INT AS b FROM ce")
def gr15(spark, d):
    e = R.colored_edges(P.order_blocks(spark, d), ["o", "genome"])
    return e.select("o", "genome", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


@query("gr16_two_break_edges", P.with_("nations") + "SELECT a, b FROM (SELECT id * 2 + 2 AS a, (id + 1) % 25 * 2 + 1 AS b FROM nations) WHERE (a, b) NOT IN ((2, 3), (10, 11)) UNION ALL VALUES (2, 11), (3, 10)")
def gr16(spark, d):
    ring = P.nations(spark, d).select((F.col("id") * 2 + 2).alias("a"), ((F.col("id") + 1) % 25 * 2 + 1).alias("b"))
    return R.two_break_edges(ring, 2, 3, 11, 10)


_GRAPH = _CE + """, bi AS (SELECT o, a, b FROM ce UNION ALL SELECT o, b, a FROM ce), rr AS (SELECT DISTINCT o, a AS n, a AS r FROM bi UNION SELECT rr.o, b, r FROM rr JOIN bi ON bi.o = rr.o AND bi.a = rr.n),
lb AS (SELECT o, n, min(r) AS c FROM rr GROUP BY o, n)"""


_TWO = """tb AS (SELECT o, CASE WHEN block > 0 THEN 2 * block - 1 ELSE -2 * block END AS i, CASE WHEN block > 0 THEN 2 * block ELSE -2 * block - 1 END AS a, ord, abs(block) AS x FROM blocks WHERE genome = 'Q'),
te AS (SELECT o, a, coalesce(lead(i) OVER w, first_value(i) OVER w) AS b FROM tb WINDOW w AS (PARTITION BY o, ord % 2 ORDER BY ord) UNION ALL SELECT o, 2 * x - 1, 2 * x FROM tb),
ti AS (SELECT o, a, b FROM te UNION ALL SELECT o, b, a FROM te),
tr AS (SELECT DISTINCT o, a AS n, a AS r FROM ti UNION SELECT tr.o, b, r FROM tr JOIN ti ON ti.o = tr.o AND ti.a = tr.n)"""


@query("gr18_node_groups", P.with_("blocks", more=_TWO) + "SELECT o, n AS node, min(r) AS component FROM tr GROUP BY o, n")
def gr18(spark, d):
    """Q's blocks dealt to two chromosomes, whose nodes are two groups."""
    return R.node_groups(P.order_blocks(spark, d).where("genome = 'Q'").withColumn("chrom", F.col("ord") % 2), ["o"])


@query("gr21_two_break_distance", P.with_("blocks", more=_GRAPH) + "SELECT o, (count(*) // 2 - count(DISTINCT c))::BIGINT AS distance FROM lb GROUP BY o")
def gr21(spark, d):
    return R.two_break_distance(P.order_blocks(spark, d), ["o"])


@query("gr21_two_break_scenarios", P.with_("blocks", more=_GRAPH) + """SELECT q.o, (len(q.c) - coalesce(l.c, 0))::INT AS steps, q.e AS last_edges FROM
(SELECT o, list(least(a, b)) AS c, string_agg(least(a, b) || '-' || greatest(a, b), ' ' ORDER BY least(a, b), greatest(a, b)) AS e FROM ce WHERE genome = 'Q' GROUP BY o) q
LEFT JOIN (SELECT o, count(DISTINCT c) AS c FROM lb GROUP BY o) l USING (o)""")  # fmt: skip
def gr21_steps(spark, d):
    """A shortest scenario has as many steps as the distance, and ends with Q's edges."""
    steps = R.two_break_scenarios(P.order_blocks(spark, d), ["o"])
    last = steps.groupBy("o").agg(F.max(F.struct("step", "genome")).alias("x")).select("o", F.col("x.step").alias("steps"), F.col("x.genome").alias("genome"))
    edge = F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda x: F.concat_ws("-", x["a"], x["b"]))
    return R.with_edges(last).groupBy("o", "steps").agg(F.array_join(edge, " ").alias("last_edges"))


@query("gr22_format", P.with_("blocks") + "SELECT o, '[' || array_to_string([CASE WHEN x > 0 THEN '+' ELSE '' END || x FOR x IN perm], ' ') || ']' AS text FROM perms")
def gr22(spark, d):
    return P.permutations(spark, d).select("o", R.format_permutation(F.col("perm")).alias("text"))


_RED = _CE + """, ne AS (SELECT o, genome, least(a, b) AS a, greatest(a, b) AS b FROM ce), p2 AS (SELECT o, a, b FROM ce WHERE genome = 'P' UNION ALL SELECT o, b, a FROM ce WHERE genome = 'P'),
me AS (SELECT o, a, b FROM (SELECT o, a, b, row_number() OVER (PARTITION BY o ORDER BY a, b) AS r FROM ne q WHERE genome = 'Q' AND NOT EXISTS (SELECT 1 FROM ne p WHERE p.genome = 'P' AND p.o = q.o AND p.a = q.a AND p.b = q.b)) WHERE r = 1),
rd AS (SELECT me.o, me.a, me.b, x.b AS a_red, y.b AS b_red FROM me JOIN p2 x ON x.o = me.o AND x.a = me.a JOIN p2 y ON y.o = me.o AND y.a = me.b)"""


@query("gr19_first_two_break", P.with_("blocks", more=_RED) + """SELECT o, a::INT AS a, b::INT AS b FROM rd UNION ALL SELECT o, least(a_red, b_red)::INT, greatest(a_red, b_red)::INT FROM rd
UNION ALL SELECT o, ne.a::INT, ne.b::INT FROM ne JOIN rd USING (o) WHERE genome = 'P' AND (ne.a, ne.b) NOT IN ((least(rd.a, a_red), greatest(rd.a, a_red)), (least(rd.b, b_red), greatest(rd.b, b_red)))""")  # fmt: skip
def gr19(spark, d):
    """The edges of P after its first 2-break."""
    return R.with_edges(R.first_two_breaks(P.order_blocks(spark, d), ["o"])).select("o", "a", "b")


@query("gr20_missing_edge", P.with_("blocks", more=_RED) + "SELECT * FROM rd")
def gr20(spark, d):
    return R.missing_edges(P.order_blocks(spark, d), ["o"])
