"""Queries of the k-mer, assembly, pattern and motif operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import projections as P
from ..operators import assembly, euler, index, kmers, motifs, patterns
from ..operators.lineage import stored
from ..operators.pairs import all_pairs
from .registry import query

RC = "translate(reverse({}), 'ACGT', 'TGCA')"


def kmer_cte(name: str, source: str, key: str, k: int) -> str:
    return f"{name} AS (SELECT {key}, unnest(range(0, length(seq) - {k} + 1)) AS pos, seq FROM {source}), {name}k AS (SELECT {key}, pos, substr(seq, pos + 1, {k}) AS kmer FROM {name})"


@query("of1_reverse_complement", P.with_("dna") + f"SELECT doc_id, {RC.format('seq')} AS rc FROM dna")
def of1(spark, d):
    return P.documents(spark, d).select("doc_id", kmers.reverse_complement(F.col("seq")).alias("rc"))


@query("of2_hamming", P.with_("items") + """SELECT a.item_id AS i, b.item_id AS j,
list_sum([CASE WHEN a.seq[x] <> b.seq[x] THEN 1 ELSE 0 END FOR x IN range(1, least(length(a.seq), length(b.seq)) + 1)])::INT AS d FROM items a JOIN items b ON a.item_id < b.item_id""")  # fmt: skip
def of2(spark, d):
    a = P.items(spark, d)
    b = a.select(F.col("item_id").alias("j"), F.col("seq").alias("w"))
    return all_pairs(a, b, "item_id", "j").where("item_id < j").select(F.col("item_id").alias("i"), "j", kmers.hamming(F.col("seq"), F.col("w")).alias("d"))


@query("of3_neighbours", P.with_("nations", more="b AS (SELECT unnest(['A','C','G','T']) AS c), n AS (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM nations)") + "SELECT DISTINCT id, left(seq, i - 1) || c || substr(seq, i + 1) AS neighbour FROM n, b")
def of3(spark, d):
    n = P.nations(spark, d)
    one = F.flatten(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.transform(F.array(*map(F.lit, "ACGT")), lambda b: F.overlay("seq", b, i, F.lit(1)))))
    return n.select("id", F.explode(F.array_distinct(one)).alias("neighbour"))


@query("of4_kmer_count", P.with_("dna", more=kmer_cte("k", "dna", "doc_id", 9)) + "SELECT kmer, count(*) AS n FROM kk GROUP BY kmer")
def of4(spark, d):
    return kmers.kmer_totals(P.documents(spark, d), 9)


@query("of5_gc_skew", P.with_("dna", more="""c AS (SELECT doc_id, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS ch FROM dna WHERE seq <> ''),
s AS (SELECT doc_id, pos, sum(CASE ch WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM c),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) AS r FROM s)""") + "SELECT doc_id, coalesce(pos, -1)::INT AS skew_pos FROM dna LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (doc_id)")  # fmt: skip
def of5(spark, d):
    return P.documents(spark, d).select("doc_id", kmers.skew_minimum(F.col("seq")).alias("skew_pos"))


_TOTALS = kmer_cte("k", "items", "item_id", 7) + f""",
cnt AS (SELECT item_id, kmer, count(*) AS n FROM kk GROUP BY ALL), b AS (SELECT unnest(['A','C','G','T']) AS c), i AS (SELECT unnest(range(1, 8)) AS i),
nb AS (SELECT DISTINCT item_id, kmer AS u, left(kmer, i - 1) || c || substr(kmer, i + 1) AS x FROM cnt, b, i),
al AS (SELECT item_id, u, x AS y FROM nb UNION ALL SELECT item_id, u, {RC.format('x')} FROM nb WHERE {RC.format('x')} <> x),
tot AS (SELECT al.item_id, u AS kmer, sum(n)::BIGINT AS total FROM al JOIN cnt ON cnt.item_id = al.item_id AND cnt.kmer = al.y GROUP BY ALL)"""


@query("of6_mismatch_totals", P.with_("items", more=_TOTALS) + "SELECT * FROM tot")
def of6_totals(spark, d):
    return kmers.mismatch_totals(P.items(spark, d), 7, 1, ["item_id"]).select("item_id", "kmer", "total")


@query("of6_frequent_all", P.with_("items", more=_TOTALS) + "SELECT item_id, kmer, total FROM (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY total DESC) AS r FROM tot) WHERE r = 1")
def of6_all(spark, d):
    return kmers.frequent_kmers(P.items(spark, d), 7, 1, ["item_id"], dedupe=False)


_FREQUENT = _TOTALS + """, fp AS (SELECT item_id, kmer, min(pos) AS p FROM kk GROUP BY ALL), nl AS (SELECT item_id, u, list(y) AS ys FROM al GROUP BY ALL),
od AS (SELECT f.item_id, f.kmer, ys, row_number() OVER (PARTITION BY f.item_id ORDER BY p) AS r FROM fp f JOIN nl ON nl.item_id = f.item_id AND nl.u = f.kmer),
gd AS (SELECT DISTINCT item_id, 0::BIGINT AS r, []::VARCHAR[] AS cov, NULL::VARCHAR AS pick FROM od UNION ALL
SELECT gd.item_id, od.r, CASE WHEN list_contains(cov, kmer) THEN cov ELSE cov || ys END, CASE WHEN list_contains(cov, kmer) THEN NULL ELSE kmer END FROM gd JOIN od ON od.item_id = gd.item_id AND od.r = gd.r + 1)"""
_CHOSEN = """SELECT item_id, kmer, total FROM
(SELECT t.item_id, t.kmer, total, rank() OVER (PARTITION BY t.item_id ORDER BY total DESC) AS q FROM gd JOIN tot t ON t.item_id = gd.item_id AND t.kmer = pick) WHERE q = 1"""  # fmt: skip


@query("of6_frequent_kmers", P.with_("items", more=_FREQUENT) + _CHOSEN)
def of6(spark, d):
    return kmers.frequent_kmers(P.items(spark, d), 7, 1, ["item_id"])


_SKEW = """c AS (SELECT doc_id, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS ch FROM dna WHERE seq <> ''),
s AS (SELECT doc_id, pos, sum(CASE ch WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM c),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) AS r FROM s)"""


@query("of7_origin_windows", P.with_("dna", more=_SKEW + """, p AS (SELECT doc_id, seq, pos AS p, length(seq) AS n FROM dna JOIN r USING (doc_id) WHERE r = 1)""") + """SELECT doc_id, 'before' AS window, greatest(p - 500, 0)::INT AS start, substr(seq, (greatest(p - 500, 0) + 1)::BIGINT, (p - greatest(p - 500, 0))::BIGINT) AS part FROM p
UNION ALL SELECT doc_id, 'around', greatest(p - 250, 0)::INT, substr(seq, (greatest(p - 250, 0) + 1)::BIGINT, (least(p + 250, n) - greatest(p - 250, 0))::BIGINT) FROM p
UNION ALL SELECT doc_id, 'after', p::INT, substr(seq, (p + 1)::BIGINT, (least(p + 500, n) - p)::BIGINT) FROM p""")  # fmt: skip
def of7(spark, d):
    """Three windows around the skew's minimum, as frequent k-mers are sought in."""
    docs = P.documents(spark, d).where("seq <> ''").withColumn("skew_pos", kmers.skew_minimum(F.col("seq")))
    return kmers.origin_windows(docs, 500).select("doc_id", "window", "start", "part")


_ORIGIN = _SKEW.replace("doc_id", "item_id").replace("FROM dna", "FROM items") + """, p AS (SELECT item_id, seq, pos AS p, length(seq) AS n FROM items JOIN r USING (item_id) WHERE r = 1),
wi AS (SELECT item_id * 3 AS item_id, substr(seq, (greatest(p - 60, 0) + 1)::BIGINT, (p - greatest(p - 60, 0))::BIGINT) AS seq FROM p UNION ALL SELECT item_id * 3 + 1, substr(seq, (greatest(p - 30, 0) + 1)::BIGINT, (least(p + 30, n) - greatest(p - 30, 0))::BIGINT) FROM p
UNION ALL SELECT item_id * 3 + 2, substr(seq, (p + 1)::BIGINT, (least(p + 60, n) - p)::BIGINT) FROM p), """


@query("of_origin_search", P.with_("items", more=_ORIGIN + _FREQUENT.replace("FROM items", "FROM wi")) + _CHOSEN.replace("SELECT item_id, kmer, total FROM", "SELECT item_id // 3 AS item_id, (item_id % 3)::INT AS place, kmer, total FROM", 1))
def of_origin(spark, d):
    """The whole search: the skew's minimum, three windows around it, the frequent k-mers of each."""
    at = P.items(spark, d).where("seq <> ''").withColumn("skew_pos", kmers.skew_minimum(F.col("seq")))
    windows = kmers.origin_windows(at, 60).withColumn("place", F.array_position(F.array(*map(F.lit, ("before", "around", "after"))), F.col("window")).cast("int") - 1)
    return kmers.frequent_kmers(windows.select("item_id", "place", F.col("part").alias("seq")), 7, 1, ["item_id", "place"])


@query("gs1_path_to_genome", P.with_("dna") + "SELECT doc_id, seq AS genome FROM dna WHERE length(seq) >= 5")
def gs1(spark, d):
    docs = P.documents(spark, d).where("length(seq) >= 5")
    nodes = docs.withColumn("nodes", F.transform(F.expr(kmers.kmer_array("seq", 5)), lambda x: x["kmer"]))
    return nodes.select("doc_id", assembly.path_to_genome(F.col("nodes")).alias("genome"))


@query("gs2_composition", P.with_("items", more=kmer_cte("k", "items", "item_id", 10)) + "SELECT item_id, kmer FROM kk")
def gs2(spark, d):
    return kmers.kmers(P.items(spark, d), 10).select("item_id", "kmer")


@query("gs3_read_pairs", P.with_("dna", more="p AS (SELECT doc_id, seq, unnest(range(0, length(seq) - 69)) AS pos FROM dna)") + "SELECT substr(seq, pos + 1, 10) AS a, substr(seq, pos + 61, 10) AS b, count(*) AS n FROM p GROUP BY ALL")
def gs3(spark, d):
    return kmers.read_pair_totals(P.table(spark, d, "documents"), 10, 50, "text", letters=P.DNA_BYTES)


@query("gs4_degrees", P.with_("dna", more=kmer_cte("k", "dna", "doc_id", 10) + ", e AS (SELECT left(kmer, 9) AS src, right(kmer, 9) AS dst FROM kk)") + """SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM
(SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node""")  # fmt: skip
def gs4(spark, d):
    return assembly.degrees(assembly.edges(kmers.kmer_totals(P.documents(spark, d), 10)), [], "n")


@query("gs5_euler_genome", P.with_("items", more=kmer_cte("k", "items", "item_id", 12)) + "SELECT item_id, kmer FROM kk")
def gs5(spark, d):
    """The genome that an Eulerian path spells has each k-mer as often as the reads."""
    found = assembly.euler_genome(kmers.kmers(P.items(spark, d), 12), ["item_id"]).where("status = 'complete'")
    return kmers.kmers(found, 12, "genome", ["item_id"]).select("item_id", "kmer")


@query("gs5_table_paths", P.with_("items", more=kmer_cte("k", "items", "item_id", 12)) + "SELECT kmer, count(*) AS n, true AS joined FROM kk GROUP BY kmer")
def gs5_table(spark, d):
    """The paths of one graph of all items: each k-mer as often as it is read, each overlapping the one before it on its path."""
    found = stored(euler.kmer_paths(kmers.kmer_totals(P.items(spark, d), 12)))
    before = found.select("path", (F.col("pos") + 1).alias("pos"), F.col("kmer").alias("earlier"))
    fits = F.coalesce(F.left("kmer", F.lit(11)) == F.right("earlier", F.lit(11)), F.col("pos") == 0)
    return found.join(before, ["path", "pos"], "left").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.bool_and(fits).alias("joined"))


_PAIRS = "p AS (SELECT item_id, seq, unnest(range(0, length(seq) - 39)) AS pos FROM items), q AS (SELECT item_id, substr(seq, pos + 1, 10) AS a, substr(seq, pos + 31, 10) AS b FROM p)"


@query("gs6_paired_degrees", P.with_("items", more=_PAIRS) + """SELECT item_id, x AS node_a, y AS node_b, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM
(SELECT item_id, left(a, 9) AS x, left(b, 9) AS y, 1 AS o, 0 AS i FROM q UNION ALL SELECT item_id, right(a, 9), right(b, 9), 0, 1 FROM q) GROUP BY ALL""")  # fmt: skip
def gs6(spark, d):
    g = assembly.degrees(assembly.paired_edges(kmers.read_pairs(P.items(spark, d), 10, 20)), ["item_id"])
    return g.select("item_id", F.col("node.a").alias("node_a"), F.col("node.b").alias("node_b"), "out_degree", "in_degree")


@query("gs7_start_node", P.with_("items", more=_PAIRS + """, g AS (SELECT item_id, x, y, sum(o) AS o, sum(i) AS i FROM
(SELECT item_id, left(a, 9) AS x, left(b, 9) AS y, 1 AS o, 0 AS i FROM q UNION ALL SELECT item_id, right(a, 9), right(b, 9), 0, 1 FROM q) GROUP BY ALL)""") + """SELECT item_id, x AS start_a, y AS start_b FROM
(SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY (o - i <> 1), x, y) AS r FROM g WHERE o > 0) WHERE r = 1""")  # fmt: skip
def gs7(spark, d):
    g = assembly.degrees(assembly.paired_edges(kmers.read_pairs(P.items(spark, d), 10, 20)), ["item_id"])
    return assembly.start_node(g, ["item_id"]).select("item_id", F.col("start.a").alias("start_a"), F.col("start.b").alias("start_b"))


@query("gs8_paired_genome", P.with_("items", more=_PAIRS) + "SELECT item_id, a, b FROM q")
def gs8(spark, d):
    """The genome that a paired Eulerian path spells has each read pair as often as the reads."""
    found = assembly.paired_genome(kmers.read_pairs(P.items(spark, d), 10, 20), ["item_id"], 10, 20).where("status = 'complete'")
    return kmers.read_pairs(found.select("item_id", F.col("genome").alias("seq")), 10, 20).select("item_id", "a", "b")


@query("gs8_table_paths", P.with_("items", more=_PAIRS) + "SELECT a, b, count(*) AS n, true AS joined FROM q GROUP BY a, b")
def gs8_table(spark, d):
    """The same for read pairs of all items."""
    found = stored(euler.paired_paths(kmers.read_pairs(P.items(spark, d), 10, 20).select("a", "b")))
    before = found.select("path", (F.col("pos") + 1).alias("pos"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    end = lambda x, y: F.left(x, F.lit(9)) == F.right(y, F.lit(9))
    fits = F.coalesce(end("a", "a0") & end("b", "b0"), F.col("pos") == 0)
    return found.join(before, ["path", "pos"], "left").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.bool_and(fits).alias("joined"))


@query("gs9_contigs", P.with_("items", more=kmer_cte("k", "items", "item_id", 8) + """, e AS (SELECT item_id AS g, left(kmer, 7) AS src, right(kmer, 7) AS dst FROM kk),
dg AS (SELECT g, node, sum(o) AS o, sum(i) AS i FROM (SELECT g, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT g, dst, 0, 1 FROM e) GROUP BY ALL), inn AS (SELECT g, node FROM dg WHERE o = 1 AND i = 1),
w AS (SELECT e.g, e.dst, e.src || right(e.dst, 1) AS contig, 1 AS n FROM e ANTI JOIN inn ON inn.g = e.g AND inn.node = e.src UNION ALL
SELECT w.g, e.dst, contig || right(e.dst, 1), n + 1 FROM w JOIN inn ON inn.g = w.g AND inn.node = w.dst JOIN e ON e.g = w.g AND e.src = w.dst),
y AS (SELECT e.g, e.src AS s, e.dst, e.src || right(e.dst, 1) AS contig, 1 AS n FROM e JOIN inn ON inn.g = e.g AND inn.node = e.src UNION ALL
SELECT y.g, s, e.dst, contig || right(e.dst, 1), n + 1 FROM y JOIN inn ON inn.g = y.g AND inn.node = y.dst JOIN e ON e.g = y.g AND e.src = y.dst WHERE y.dst > s)""") + """SELECT g AS item_id, contig, n AS n_edges FROM w ANTI JOIN inn ON inn.g = w.g AND inn.node = w.dst
UNION ALL SELECT g, contig, n FROM y WHERE dst = s""")  # fmt: skip
def gs9(spark, d):
    return assembly.contigs(kmers.kmers(P.items(spark, d), 8), ["item_id"]).select("item_id", "contig", "n_edges")


@query("gs9_circular_contigs", P.with_("nations", more="ring AS (SELECT id, seq || left(seq, 5) AS seq FROM nations), " + kmer_cte("k", "ring", "id", 6) + """, e AS (SELECT id AS g, left(kmer, 5) AS src, right(kmer, 5) AS dst FROM kk),
dg AS (SELECT g, node, sum(o) AS o, sum(i) AS i FROM (SELECT g, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT g, dst, 0, 1 FROM e) GROUP BY ALL), inn AS (SELECT g, node FROM dg WHERE o = 1 AND i = 1),
w AS (SELECT e.g, e.dst, e.src || right(e.dst, 1) AS contig, 1 AS n FROM e ANTI JOIN inn ON inn.g = e.g AND inn.node = e.src UNION ALL
SELECT w.g, e.dst, contig || right(e.dst, 1), n + 1 FROM w JOIN inn ON inn.g = w.g AND inn.node = w.dst JOIN e ON e.g = w.g AND e.src = w.dst),
y AS (SELECT e.g, e.src AS s, e.dst, e.src || right(e.dst, 1) AS contig, 1 AS n FROM e JOIN inn ON inn.g = e.g AND inn.node = e.src UNION ALL
SELECT y.g, s, e.dst, contig || right(e.dst, 1), n + 1 FROM y JOIN inn ON inn.g = y.g AND inn.node = y.dst JOIN e ON e.g = y.g AND e.src = y.dst WHERE y.dst <> s)""") + """SELECT g AS id, contig, n AS n_edges FROM w ANTI JOIN inn ON inn.g = w.g AND inn.node = w.dst UNION ALL SELECT g, contig, n FROM y WHERE dst = s""")  # fmt: skip
def gs9_circular(spark, d):
    """Circular sequences, whose cycles are spelled from each of their nodes."""
    ring = P.nations(spark, d).select("id", F.concat("seq", F.left("seq", F.lit(5))).alias("seq"))
    return assembly.contigs(kmers.kmers(ring, 6), ["id"], cycle_per_node=True).select("id", "contig", "n_edges")


@query("pm1_burrows_wheeler", P.with_("items", more="r AS (SELECT item_id, seq, unnest(range(0, length(seq))) AS i FROM items), s AS (SELECT item_id, i, substr(seq, i + 1) || left(seq, i) AS rot FROM r)") + "SELECT item_id, string_agg(right(rot, 1), '' ORDER BY rot, i) AS bwt FROM s GROUP BY item_id")
def pm1(spark, d):
    return patterns.burrows_wheeler(P.items(spark, d)).select("item_id", "bwt")


_SUFFIX = "f AS (SELECT item_id, seq, unnest(range(0, length(seq))) AS pos FROM items), sa AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY substr(seq, pos + 1)) - 1 AS rank, substr(seq, pos + 1) AS suffix FROM f)"


@query("pm2_suffix_array", P.with_("items", more=_SUFFIX) + "SELECT item_id, rank::INT AS rank, pos FROM sa")
def pm2(spark, d):
    return patterns.suffix_arrays(P.items(spark, d)).select("item_id", F.posexplode("sa").alias("rank", "pos"))


_BWT = "r AS (SELECT item_id, seq || '$' AS seq, unnest(range(0, length(seq) + 1)) AS i FROM items), s AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY substr(seq, i + 1) || left(seq, i)) - 1 AS rank, CASE WHEN i = 0 THEN '$' ELSE substr(seq, i, 1) END AS ch FROM r)"


@query("pm3_occurrences", P.with_("items", more=_BWT) + "SELECT item_id, rank::INT AS rank, ch, count(*) OVER (PARTITION BY item_id, ch ORDER BY rank) AS occ FROM s")
def pm3(spark, d):
    """Each text is indexed by itself; counts come from the checkpoints."""
    return index.occurrences(index.fm_index(P.items(spark, d), ["item_id"], block=0))


def words_cte(name: str, n: int) -> str:
    return f"{name} AS (SELECT DISTINCT substr(seq, i, {n}) AS pattern FROM (SELECT seq, unnest(range(1, length(seq) - {n - 2})) AS i FROM nations))"


_WORDS = words_cte("w", 6)


def words(spark, d, n=6):
    """All parts of nation sequences of n letters."""
    return kmers.kmers(P.nations(spark, d), n, keep=[]).select(F.col("kmer").alias("pattern")).distinct()


@query("pm4_exact_matches", P.with_("dna", "nations", more=_WORDS + ", " + kmer_cte("k", "dna", "doc_id", 6)) + "SELECT doc_id, pattern, pos::INT AS pos FROM kk JOIN w ON kmer = pattern")
def pm4(spark, d):
    """Backward search over an index of all documents."""
    return index.fm_search(stored(index.fm_index(P.documents(spark, d), ["doc_id"])), words(spark, d))


@query("pm5_suffix_array_matches", P.with_("items", more=_SUFFIX) + "SELECT item_id, pos + 1 AS pos FROM sa WHERE starts_with(suffix, 'ACG')")
def pm5(spark, d):
    return patterns.suffix_array_matches(P.items(spark, d), "ACG").select("item_id", F.explode("places").alias("pos"))


@query("pm6_trie", P.with_("nations", more="x AS (SELECT DISTINCT seq FROM nations), i AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM x)") + "SELECT left(seq, i) AS node, left(seq, i - 1) AS parent, right(left(seq, i), 1) AS ch, bool_or(i = length(seq)) AS ends FROM i GROUP BY ALL")
def pm6(spark, d):
    return patterns.trie(P.nations(spark, d).withColumnRenamed("seq", "pattern"))


@query("pm7_multi_pattern", P.with_("dna", "nations", more=words_cte("w6", 6) + ", " + words_cte("w8", 8) + ", w AS (SELECT pattern FROM w6 UNION SELECT pattern FROM w8 UNION SELECT seq FROM nations), " + kmer_cte("k", "dna", "doc_id", 6) + ", " + kmer_cte("l", "dna", "doc_id", 8)) + """SELECT pattern, count(doc_id) AS hits, coalesce(sum(pos), 0)::BIGINT AS places FROM w LEFT JOIN
(SELECT doc_id, kmer AS found, pos + 1 AS pos FROM kk UNION ALL SELECT doc_id, kmer, pos + 1 FROM lk UNION ALL
SELECT doc_id, w.pattern, pos + 1 FROM w JOIN lk ON left(w.pattern, 8) = kmer JOIN dna USING (doc_id) WHERE length(w.pattern) > 8 AND substr(dna.seq, pos + 1, length(w.pattern)) = w.pattern) ON found = pattern GROUP BY pattern""")  # fmt: skip
def pm7(spark, d):
    """Patterns of all the lengths that there are."""
    p = words(spark, d).union(words(spark, d, 8)).union(P.nations(spark, d).select("seq"))
    hits = patterns.exact_matches(P.documents(spark, d), p, ["doc_id"], base=1, keep_zero=True)
    return hits.groupBy("pattern").agg(F.count("doc_id").alias("hits"), F.coalesce(F.sum("pos"), F.lit(0)).cast("long").alias("places"))


@query("pm8_approximate", P.with_("items", "nations", more=words_cte("w", 8) + ", " + kmer_cte("k", "items", "item_id", 8)) + """SELECT item_id, pattern, pos::INT AS pos FROM kk, w
WHERE list_sum([CASE WHEN kmer[x] <> pattern[x] THEN 1 ELSE 0 END FOR x IN range(1, 9)]) <= 2""")  # fmt: skip
def pm8(spark, d):
    return patterns.approximate_matches(P.items(spark, d), words(spark, d, 8), 8, 2, ["item_id"])


_LCP = _SUFFIX + """, l AS (SELECT item_id, suffix, lag(suffix) OVER (PARTITION BY item_id ORDER BY rank) AS before FROM sa),
x AS (SELECT item_id, list_max([0] || [i FOR i IN range(1, least(length(suffix), length(before)) + 1) IF left(suffix, i) = left(before, i)])::INT AS n FROM l WHERE before IS NOT NULL)"""


@query("pm9_longest_repeat_length", P.with_("items", more=_LCP) + "SELECT item_id, max(n) AS n FROM x GROUP BY item_id")
def pm9(spark, d):
    return patterns.repeats(P.items(spark, d)).select("item_id", F.length("repeat").alias("n"))


@query("pm9_longest_repeat", P.with_("items", more=_LCP.replace("::INT AS n FROM l", "::INT AS n, suffix FROM l") + """, b AS (SELECT DISTINCT item_id, left(suffix, n) AS s, n, rank() OVER (PARTITION BY item_id ORDER BY n DESC) AS r FROM x WHERE n > 0),
o AS (SELECT b.item_id, s, row_number() OVER (PARTITION BY b.item_id ORDER BY [strpos(seq, left(s, k)) FOR k IN range(1, n + 1)]) AS q FROM b JOIN items USING (item_id) WHERE r = 1)""") + "SELECT item_id, coalesce(s, '') AS repeat FROM items LEFT JOIN (SELECT * FROM o WHERE q = 1) USING (item_id)")  # fmt: skip
def pm9_text(spark, d):
    return patterns.repeats(P.items(spark, d)).select("item_id", "repeat")


_TREE = """t AS (SELECT item_id, 1 AS source, seq FROM items UNION ALL SELECT a.item_id, 2, b.seq FROM items a JOIN items b ON b.item_id = a.item_id + 1),
f AS (SELECT item_id, source, seq, unnest(range(1, length(seq) + 1)) AS i FROM t), u AS (SELECT item_id, source, seq, i, unnest(range(1, length(seq) - i + 2)) AS n FROM f),
v AS (SELECT item_id, source, substr(seq, i, n) AS label, CASE WHEN i + n <= length(seq) THEN seq[i + n] ELSE source::VARCHAR END AS next FROM u UNION ALL SELECT item_id, source, '', seq[i] FROM f),
nd AS (SELECT item_id, label, count(*) AS leaves, min(source) AS a, max(source) AS b FROM v GROUP BY item_id, label HAVING count(DISTINCT next) > 1 OR label = ''),
ev AS (SELECT item_id, false AS leaf, label, leaves, a, b, label AS upper FROM nd UNION ALL SELECT item_id, true, substr(seq, i), 1, source, source, substr(seq, i) || '.' FROM f),
pf AS (SELECT *, unnest(range(0, greatest(length(upper), 1))) AS k FROM ev)"""


@query("pm10_suffix_tree", P.with_("items", more=_TREE) + """SELECT pf.item_id, leaf, pf.label, max(CASE WHEN nd.label IS NULL THEN 0 ELSE k END)::BIGINT AS parent_depth, any_value(pf.leaves) AS leaves,
any_value(CASE WHEN pf.a <> pf.b THEN 'purple' WHEN pf.a = 1 THEN 'blue' ELSE 'red' END) AS colour, pf.a AS of FROM pf LEFT JOIN nd ON nd.item_id = pf.item_id AND nd.label = left(upper, k) GROUP BY pf.item_id, leaf, pf.label, pf.a""")  # fmt: skip
def pm10(spark, d):
    """The tree of each item and the next: inner nodes and leaves with where they hang, and whose suffixes are below."""
    items = P.items(spark, d)
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.lit(2).alias("source"), "seq").join(items.select("item_id"), "item_id")
    found = index.suffix_tree(items.select("item_id", F.lit(1).alias("source"), "seq").union(after), ["item_id"], labels=True)
    colour = F.when(F.col("source_min") != F.col("source_max"), "purple").when(F.col("source_min") == 1, "blue").otherwise("red")
    return found.select("item_id", "leaf", "label", "parent_depth", "leaves", colour.alias("colour"), F.col("source_min").cast("int").alias("of"))


@query("pm11_prefix_colours", P.with_("nations", more="g AS (SELECT region, id % 2 + 1 AS source, seq, unnest(range(1, length(seq) - 2)) AS i FROM nations), k AS (SELECT region, source, substr(seq, i, 4) AS kmer FROM g WHERE i <= length(seq) - 3)") + "SELECT region, kmer, CASE WHEN min(source) <> max(source) THEN 'purple' WHEN min(source) = 1 THEN 'blue' ELSE 'red' END AS colour FROM k GROUP BY ALL")
def pm11(spark, d):
    n = P.nations(spark, d).withColumn("source", F.col("id") % 2 + 1)
    return patterns.prefix_colours(n, 4, ["region"])


def nation_pairs(spark, d):
    a = P.nations(spark, d).select("id", F.col("seq").alias("v"))
    b = a.select(F.col("id").alias("id2"), F.col("v").alias("w"))
    return a.join(b, F.col("id") < F.col("id2"))


PAIRS = "pairs AS (SELECT a.id, b.id AS id2, a.seq AS v, b.seq AS w FROM nations a JOIN nations b ON a.id < b.id)"


@query("pm12_longest_shared_length", P.with_("nations", more=PAIRS + """, s AS (SELECT id, id2, w, v, unnest(range(1, length(v) + 1)) AS i FROM pairs), t AS (SELECT id, id2, w, i, v, unnest(range(1, length(v) - i + 2)) AS n FROM s)""") + """SELECT id, id2, max(CASE WHEN contains(w, substr(v, i, n)) THEN n ELSE 0 END)::INT AS n FROM t GROUP BY ALL""")
def pm12(spark, d):
    return patterns.shared_substrings(nation_pairs(spark, d)).select("id", "id2", F.length("shared").alias("n"))


@query("pm13_shortest_unshared", P.with_("nations", more=PAIRS + """, s AS (SELECT id, id2, w, v, unnest(range(1, length(v) + 1)) AS i FROM pairs), t AS (SELECT id, id2, w, i, v, unnest(range(1, length(v) - i + 2)) AS n FROM s),
u AS (SELECT id, id2, substr(v, i, n) AS x, row_number() OVER (PARTITION BY id, id2 ORDER BY n, i) AS r FROM t WHERE NOT contains(w, substr(v, i, n)))""") + "SELECT p.id, p.id2, x AS unshared FROM pairs p LEFT JOIN (SELECT * FROM u WHERE r = 1) USING (id, id2)")  # fmt: skip
def pm13(spark, d):
    return patterns.shared_substrings(nation_pairs(spark, d)).select("id", "id2", "unshared")


@query("pm14_shared_substrings", P.with_("nations", more=PAIRS + """, s AS (SELECT id, id2, w, v, unnest(range(1, length(v) + 1)) AS i FROM pairs), t AS (SELECT id, id2, w, v, i, unnest(range(1, length(v) - i + 2)) AS n FROM s),
x AS (SELECT id, id2, v, w, i, n, substr(v, i, n) AS x, contains(w, substr(v, i, n)) AS common FROM t),
m AS (SELECT DISTINCT id, id2, v, x, n, rank() OVER (PARTITION BY id, id2 ORDER BY n DESC) AS r FROM x WHERE common),
sh AS (SELECT id, id2, x, row_number() OVER (PARTITION BY id, id2 ORDER BY [strpos(v, left(x, k)) FOR k IN range(1, n + 1)]) AS q FROM m WHERE r = 1),
u AS (SELECT id, id2, x, row_number() OVER (PARTITION BY id, id2 ORDER BY n, i) AS q FROM x WHERE NOT common)""") + """SELECT p.id, p.id2, coalesce(sh.x, '') AS shared, u.x AS unshared FROM pairs p LEFT JOIN sh ON sh.id = p.id AND sh.id2 = p.id2 AND sh.q = 1 LEFT JOIN u ON u.id = p.id AND u.id2 = p.id2 AND u.q = 1""")  # fmt: skip
def pm14(spark, d):
    return patterns.shared_substrings(nation_pairs(spark, d)).select("id", "id2", "shared", "unshared")


_MOTIF = "m AS (SELECT region, substr(seq, i, 8) AS motif FROM (SELECT region, seq, unnest(range(1, length(seq) - 6)) AS i FROM nations)), c AS (SELECT region, unnest(range(0, 8)) AS pos, unnest(string_split(motif, '')) AS nuc FROM m)"


def region_motifs(spark, d):
    """All parts of eight letters as instances of a motif."""
    return kmers.kmers(P.nations(spark, d), 8, keep=["region"]).select("region", F.col("kmer").alias("motif"))


@query("ms1_profile", P.with_("nations", more=_MOTIF) + "SELECT region, pos::INT AS pos, " + ", ".join(f"round((count(*) FILTER (WHERE nuc = '{b}') + 1) / (count(*) + 4), 9) AS {b.lower()}" for b in "ACGT") + " FROM c GROUP BY region, pos")
def ms1(spark, d):
    return motifs.profile(region_motifs(spark, d), ["region"]).select("region", "pos", *[F.round(c, 9).alias(c) for c in "acgt"])


@query("ms2_score", P.with_("nations", more=_MOTIF + ", n AS (SELECT region, pos, nuc, count(*) AS n FROM c GROUP BY ALL)") + "SELECT region, sum(s)::BIGINT AS score FROM (SELECT region, pos, sum(n) - max(n) AS s FROM n GROUP BY ALL) GROUP BY region")
def ms2(spark, d):
    return motifs.score(region_motifs(spark, d), ["region"])


@query("ms3_consensus", P.with_("nations", more=_MOTIF + ", n AS (SELECT region, pos, nuc, row_number() OVER (PARTITION BY region, pos ORDER BY count(*) DESC, nuc) AS r FROM c GROUP BY region, pos, nuc)") + "SELECT region, string_agg(nuc, '' ORDER BY pos) AS consensus FROM n WHERE r = 1 GROUP BY region")
def ms3(spark, d):
    return motifs.consensus(region_motifs(spark, d), ["region"])


_PROFILE = _MOTIF + ", p AS (SELECT pos, " + ", ".join(f"(count(*) FILTER (WHERE nuc = '{b}') + 1) / (count(*) + 4) AS {b}" for b in "ACGT") + " FROM c GROUP BY pos), pl AS (SELECT list([A, C, G, T] ORDER BY pos) AS p FROM p)"


@query("ms4_most_probable", P.with_("nations", "items", more=_PROFILE + ", " + kmer_cte("k", "items", "item_id", 8) + """,
s AS (SELECT item_id, pos, kmer, list_reduce([1.0::DOUBLE] || [p[x][strpos('ACGT', kmer[x])] FOR x IN range(1, 9)], lambda a, b: a * b) AS s FROM kk, pl)""") + "SELECT item_id, kmer, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, pos) AS r FROM s) WHERE r = 1")  # fmt: skip
def ms4(spark, d):
    return motifs.most_probable(P.items(spark, d), motifs.profile(region_motifs(spark, d), []), 8, ["item_id"])


@query("ms5_random_kmer", P.with_("dna") + "SELECT doc_id, CASE WHEN length(seq) >= 15 THEN substr(seq, (('0x' || substr(md5('1:' || seq), 1, 13))::BIGINT % (length(seq) - 14) + 1)::BIGINT, 15) END AS motif FROM dna")
def ms5(spark, d):
    return motifs.random_kmers(P.documents(spark, d), 15, seed=1).select("doc_id", "motif")


def _groups(spark, d):
    return P.items(spark, d).select((F.col("item_id") % 10).alias("g"), F.col("item_id").alias("ordinal"), "seq")


_SETS = "sq AS (SELECT item_id % 10 AS g, item_id AS ordinal, row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) AS r, seq FROM items WHERE length(seq) >= 12)"
_GREEDY = _SETS + """, gr AS (SELECT g, 1::BIGINT AS r, st, [substr(seq, st + 1, 12)] AS ms FROM (SELECT g, seq, unnest(range(0, length(seq) - 11)) AS st FROM sq WHERE r = 1) UNION ALL
SELECT g, r, st, ms || [substr(seq, list_sort([{'s': -list_reduce([1.0::DOUBLE] || [p[x][strpos('ACGT', seq[i + x])] FOR x IN range(1, 13)], lambda a, b: a * b), 'i': i} FOR i IN range(0, length(seq) - 11)])[1].i + 1, 12)] FROM
(SELECT gr.g, sq.r, st, ms, seq, [[(len(list_filter(ms, lambda m: m[x] = b)) + 1) / (len(ms) + 4) FOR b IN ['A', 'C', 'G', 'T']] FOR x IN range(1, 13)] AS p FROM gr JOIN sq ON sq.g = gr.g AND sq.r = gr.r + 1)),
al AS (SELECT g, st, ms FROM gr JOIN (SELECT g, max(r) AS r FROM sq GROUP BY g) USING (g, r) UNION ALL SELECT g, -1, list(left(seq, 12) ORDER BY r) FROM sq GROUP BY g),
sc AS (SELECT g, st, ms, list_sum([len(ms) - list_max([len(list_filter(ms, lambda m: m[x] = b)) FOR b IN ['A', 'C', 'G', 'T']]) FOR x IN range(1, 13)]) AS score FROM al)"""


@query("ms6_greedy_motifs", P.with_("items", more=_GREEDY) + "SELECT g, score::INT AS score, array_to_string(ms, ' ') AS motifs FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score, st) AS q FROM sc) WHERE q = 1")
def ms6(spark, d):
    return motifs.search(_groups(spark, d), 12, ["g"]).select("g", "score", F.array_join("motifs", " ").alias("motifs"))


def _checked(found, spark, d):
    """A row a sequence: whether its motif is part of it, and whether the set's score is what its columns give."""
    each = found.select("g", "score", F.posexplode("motifs").alias("r", "motif"))
    own = _groups(spark, d).where("length(seq) >= 12")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("ordinal")) - 1)
    counted = motifs.score(each.select("g", "motif"), ["g"]).withColumnRenamed("score", "recount")
    return own.join(each, ["g", "r"]).join(counted, "g").select("g", "ordinal", F.col("seq").contains(F.col("motif")).alias("own"), (F.col("score") == F.col("recount")).alias("counted"))


_CHECKED = P.with_("items", more=_SETS) + "SELECT g, ordinal, true AS own, true AS counted FROM sq"


@query("ms7_randomized_motifs", _CHECKED)
def ms7(spark, d):
    return _checked(motifs.search(_groups(spark, d), 12, ["g"], "randomized"), spark, d)


@query("ms9_gibbs_motifs", _CHECKED)
def ms9(spark, d):
    return _checked(motifs.search(_groups(spark, d), 12, ["g"], "gibbs"), spark, d)


@query("ms8_profile_random", P.with_("nations", "items", more=_PROFILE + ", " + kmer_cte("k", "items", "item_id", 8) + """,
s AS (SELECT item_id, pos, kmer, list_reduce([1.0::DOUBLE] || [p[x][strpos('ACGT', kmer[x])] FOR x IN range(1, 9)], lambda a, b: a * b) AS s, (('0x' || substr(md5('2:' || item_id || ':' || pos), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM kk, pl)""") + "SELECT item_id, kmer, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY -ln(u) / s, pos) AS r FROM s) WHERE r = 1")  # fmt: skip
def ms8(spark, d):
    return motifs.profile_random(P.items(spark, d), motifs.profile(region_motifs(spark, d), []), 8, ["item_id"], seed=2)
