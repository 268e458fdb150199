"""Eulerian paths of a graph that is a whole table: trails by pairing edges at nodes, merged along a spanning forest, ranked by doubling.

1. At each node the i-th edge in is paired with the i-th edge out. That cuts the edges into trails: closed ones, and open ones between nodes of unequal degrees.
2. Two trails that meet at a node become one if their next edges there are exchanged. This is done along a forest over trails and nodes, as a second
   exchange between the same two would part them again: in each round trails toss a coin, and a tail joins one head that it meets, so that the rounds are as
   many as the logarithm of the number of trails. What is left is finished by one task once it is no more than `rest` rows, one for each
   trail at a node.
3. Places along the trails come from pointer doubling: log2 of the longest trail's length, in rounds.

Each round is a join whose lineage is cut in shared storage; no step gathers a node, a trail or the graph in one place but the bounded rest.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint, stored

REST = 1_000_000
BUCKETS = 16  # that number a node's edges


def _counted(ends: DataFrame) -> DataFrame:
    """node, e and i: the edge's number at the node, from 1, counted in buckets."""
    b = ends.withColumn("b", F.pmod(F.xxhash64("e"), F.lit(BUCKETS)))
    before = F.sum("m").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    base = b.groupBy("node", "b").agg(F.count(F.lit(1)).alias("m")).select("node", "b", F.coalesce(before, F.lit(0)).alias("base"))
    inside = b.withColumn("k", F.row_number().over(Window.partitionBy("node", "b").orderBy("e")))
    return inside.join(base, ["node", "b"]).select("node", "e", (F.col("base") + F.col("k")).alias("i"))


def paired(edges: DataFrame) -> DataFrame:
    """e, node (its end) and next: the edge that follows, null where a trail ends. edges: e, src, dst."""
    into = _counted(edges.select(F.col("dst").alias("node"), "e"))
    out = _counted(edges.select(F.col("src").alias("node"), "e")).withColumnRenamed("e", "next")
    return into.join(out, ["node", "i"], "left").select("e", "node", "next")


def walked(follow: DataFrame) -> DataFrame:
    """e, far, left, low, done of follow (e, next): the trail's last edge, and how many edges come after e, if done; if not, the trail is closed
    and low is its smallest edge."""
    far = F.coalesce("next", "e")
    walk = checkpoint(follow.select("e", far.alias("far"), F.col("next").isNotNull().cast("long").alias("left"), F.least("e", far).alias("low"), F.col("next").isNull().alias("done")))
    open_ = walk.where("NOT done").count()
    while open_:
        ahead = walk.select(F.col("e").alias("far"), F.col("far").alias("far2"), F.col("left").alias("left2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        step = walk.where("NOT done").join(ahead, "far").select("e", F.col("far2").alias("far"), (F.col("left") + F.col("left2")).alias("left"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"), (F.col("low2") < F.col("low")).alias("moved"))
        walk = checkpoint(walk.where("done").select("*", F.lit(False).alias("moved")).unionByName(step))
        now, moved = walk.agg(F.count_if(~F.col("done")), F.count_if("moved")).first()
        walk = walk.drop("moved")
        if now == open_ and not moved:
            break  # whatever is still open goes round
        open_ = now
    return walk


def _finished(reps: DataFrame) -> DataFrame:
    """kind, a, b: changed next edges (0, e, next; a missing next is -1) and joined trails (1, trail, its new name), by one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        pdf = pdf.sort_values(["node", "trail"])
        new = dict(zip(pdf["e"], pdf["next"]))
        for _, group in pdf.groupby("node", sort=False):
            (e, trail), *others = zip(group["e"], group["trail"])
            for f, other in others:
                x, y = find(trail), find(other)
                if x != y:
                    top[max(x, y)] = min(x, y)
                    new[e], new[f] = new[f], new[e]
        out = [(0, a, b) for a, b in new.items()] + [(1, x, find(x)) for x in list(top)]
        return pd.DataFrame(out, columns=["kind", "a", "b"])

    # a node of several columns comes to pandas as a dict, which groups by nothing
    named = reps.withColumn("node", F.to_json(F.struct("node")))
    return named.groupBy(F.lit(0).alias("_one")).applyInPandas(run, "kind int, a long, b long")


def merged(follow: DataFrame, walk: DataFrame, rest: int = REST) -> tuple[DataFrame, DataFrame]:
    """(e, next) of the edges whose next edge changes, and (trail, top): what each trail that met others belongs to. follow: e, node, next."""
    trail = F.when(F.col("done"), F.col("far")).otherwise(F.col("low"))
    at = follow.join(walk.select("e", trail.alias("trail")), "e").groupBy("node", "trail").agg(F.min(F.struct("e", F.coalesce("next", F.lit(-1)).alias("next"))).alias("x"))
    at = at.select("node", "trail", "x.e", "x.next")
    shared = lambda r: r.groupBy("node").agg(F.min("trail").alias("lo"), F.max("trail").alias("hi")).where("lo < hi").select("node")
    reps = stored(at.join(shared(at), "node"))
    moved, names, k = [], reps.select("trail", F.col("trail").alias("top")).distinct(), 0
    while reps.count() > rest:
        k += 1
        tossed = reps.withColumn("head", F.pmod(F.xxhash64("trail", F.lit(k)), F.lit(2)) == 0)
        heads = tossed.where("head").groupBy("node").agg(F.min("trail").alias("to"))
        joins = tossed.where("NOT head").join(heads, "node").groupBy("trail").agg(F.min(F.struct("node", "to")).alias("x")).select("trail", "x.node", "x.to")
        joins = stored(joins, small=True)
        part = joins.select("node", "trail").union(joins.select("node", F.col("to")).distinct()).withColumn("turns", F.lit(True))
        turn = Window.partitionBy("node", "turns").orderBy("trail")
        turned = reps.join(part, ["node", "trail"], "left")
        after = F.coalesce(F.lead("next").over(turn), F.first("next").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        turned = turned.withColumn("next", F.when(F.col("turns"), after).otherwise(F.col("next")))
        named = turned.join(joins.select("trail", "to"), "trail", "left").select("node", F.coalesce("to", "trail").alias("trail"), "e", "next")
        named = stored(named)
        first = F.row_number().over(Window.partitionBy("node", "trail").orderBy("e"))
        ranked = stored(named.withColumn("r", first))
        kept = ranked.where("r = 1").drop("r")
        now = stored(kept.join(shared(kept), "node", "left_semi"))
        moved.append(ranked.join(now.select("e"), "e", "left_anti").select("e", "next"))
        names = checkpoint(names.join(joins.select(F.col("trail").alias("top"), "to"), "top", "left").select("trail", F.coalesce("to", "top").alias("top")))
        reps = now
    end = stored(_finished(reps))
    moved.append(end.where("kind = 0").select(F.col("a").alias("e"), F.col("b").alias("next")))
    last = end.where("kind = 1").select(F.col("a").alias("top"), F.col("b").alias("to"))
    names = names.join(last, "top", "left").select("trail", F.coalesce("to", "top").alias("top"))
    return reduce(DataFrame.unionAll, moved), names


def euler_paths(edges: DataFrame, rest: int = REST) -> DataFrame:
    """path, pos and the columns of edges (src, dst and others): each edge once, along as few paths as there can be.

    A component all of whose nodes have as many edges in as out gives one closed path; any other gives as many as its nodes have edges out more than in.
    path is a number of no further meaning, pos counts from 0. Rows without src or dst are left out; equal rows are edges of their own."""
    own = stored(edges.where("src IS NOT NULL AND dst IS NOT NULL").withColumn("e", F.monotonically_increasing_id()))
    follow = stored(paired(own.select("e", "src", "dst")))
    walk = walked(follow.select("e", "next"))
    change, names = merged(follow, walk, rest)
    change = change.select("e", F.when(F.col("next") >= 0, F.col("next")).alias("new"), F.lit(True).alias("turns"))
    then = follow.join(change, "e", "left").select("e", F.when(F.col("turns"), F.col("new")).otherwise(F.col("next")).alias("next"))
    # closed trails that met no open one are cut before their smallest edge
    trails = walk.select(F.when(F.col("done"), F.col("far")).otherwise(F.col("low")).alias("trail"), "done").distinct()
    trails = trails.join(names, "trail", "left").select("trail", "done", F.coalesce("top", "trail").alias("top"))
    cut = trails.groupBy("top").agg(F.bool_or("done").alias("open"), F.min("trail").alias("next")).where("NOT open").select("next", F.lit(True).alias("cuts"))
    line = stored(then.join(cut, "next", "left").select("e", F.when(F.col("cuts"), None).otherwise(F.col("next")).alias("next")))
    ranked = stored(walked(line).select("e", F.col("far").alias("path"), "left"))
    length = ranked.groupBy("path").agg(F.max("left").alias("most"))
    placed = ranked.join(length, "path").select("e", "path", (F.col("most") - F.col("left")).alias("pos"))
    return own.join(placed, "e").select("path", "pos", *edges.columns)


def kmer_paths(kmers: DataFrame, rest: int = REST) -> DataFrame:
    """path, pos, kmer: the paths of the graph of all k-mers of a table (kmer, n: as often as they are read); consecutive ones overlap by all but a letter."""
    k = F.col("kmer")
    each = kmers.select("kmer", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return euler_paths(each.select("kmer", F.left(k, F.length(k) - 1).alias("src"), F.right(k, F.length(k) - 1).alias("dst")), rest).select("path", "pos", "kmer")


def paired_paths(pairs: DataFrame, rest: int = REST) -> DataFrame:
    """path, pos, a, b: the same for read pairs (a, b), whose nodes are pairs too."""
    cut = lambda f: F.struct(*[f(F.col(c), F.length(c) - 1).alias(c) for c in ("a", "b")])
    return euler_paths(pairs.select("a", "b", cut(F.left).alias("src"), cut(F.right).alias("dst")), rest).select("path", "pos", "a", "b")
