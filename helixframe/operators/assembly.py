"""de Bruijn graphs, Eulerian reconstruction and contigs."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .euler import walked
from .lineage import stored


def path_to_genome(nodes: Column) -> Column:
    """The first node and the last letter of each later one; empty for no nodes."""
    later = F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0)))
    return F.concat(F.coalesce(F.get(nodes, F.lit(0)), F.lit("")), F.array_join(F.transform(later, lambda x: F.right(x, F.lit(1))), ""))


def parse_pairs(text: Column) -> Column:
    """An array of (a, b) from text like "(ACG,TTA) (CGT,TAA)"."""
    get = lambda g: F.regexp_extract_all(text, F.lit(r"\((\w+),(\w+)\)"), F.lit(g))
    return F.transform(F.arrays_zip(get(1).alias("a"), get(2).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))


def edges(kmers: DataFrame, kmer: str = "kmer") -> DataFrame:
    """Prefix to suffix, one row for each k-mer row."""
    k = F.col(kmer)
    return kmers.withColumns({"src": F.left(k, F.length(k) - 1), "dst": F.right(k, F.length(k) - 1)})


def paired_edges(pairs: DataFrame) -> DataFrame:
    cut = lambda f: F.struct(*[f(F.col(c), F.length(c) - 1).alias(c) for c in ("a", "b")])
    return pairs.withColumns({"src": cut(F.left), "dst": cut(F.right)})


def degrees(edge_rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Each node's out- and in-degree, from one pass over both ends. weight: a column that counts equal edges."""
    n = F.col(weight) if weight else F.lit(1)
    none = F.lit(0).cast("long")
    n = n.cast("long")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), n.alias("o"), none.alias("i")), F.struct(F.col("dst").alias("node"), none.alias("o"), n.alias("i"))))
    return edge_rows.select(*by, ends.alias("e")).groupBy(*by, "e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def start_node(degree_rows: DataFrame, by: list[str]) -> DataFrame:
    """The smallest node with one more edge out than in, else the smallest with an edge out."""
    choice = F.struct((F.col("out_degree") - F.col("in_degree") != 1).alias("x"), F.col("node").alias("n"))
    return degree_rows.where("out_degree > 0").groupBy(*by).agg(F.min(choice)["n"].alias("start"))


def euler_path(pairs: list[tuple], start) -> list:
    """Hierholzer's walk; edges leave a node in the order given."""
    out, at = defaultdict(list), defaultdict(int)
    for a, b in pairs:
        out[a].append(b)
    stack, path = [start], []
    while stack:
        v = stack[-1]
        if at[v] < len(out[v]):
            at[v] += 1
            stack.append(out[v][at[v] - 1])
        else:
            path.append(stack.pop())
    return path[::-1]


def euler_genome(kmers: DataFrame, by: list[str]) -> DataFrame:
    """The sequence that a group's k-mers spell along an Eulerian path; status tells whether every edge was used."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        es = sorted((k[:-1], k[1:]) for k in pdf["kmer"])
        balance: dict = defaultdict(int)
        for a, b in es:
            balance[a] += 1
            balance[b] -= 1
        starts = [n for n, x in balance.items() if x == 1] or [a for a, _ in es]
        path = euler_path(es, min(starts))
        genome = path[0] + "".join(n[-1] for n in path[1:])
        return pd.DataFrame([(*key, genome, "complete" if len(path) == len(es) + 1 else "partial")])

    shape = ", ".join(f"{c} {kmers.schema[c].dataType.simpleString()}" for c in by) + ", genome string, status string"
    return kmers.groupBy(*by).applyInPandas(solve, shape)


def paired_genome(pairs: DataFrame, by: list[str], k: int, gap: int) -> DataFrame:
    """The sequence that read pairs spell; status says whether its two halves agree."""

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        es = sorted(((a[:-1], b[:-1]), (a[1:], b[1:])) for a, b in zip(pdf["a"], pdf["b"]))
        balance: dict = defaultdict(int)
        for a, b in es:
            balance[a] += 1
            balance[b] -= 1
        path = euler_path(es, min([n for n, x in balance.items() if x == 1] or [a for a, _ in es]))
        first, second = (path[0][s] + "".join(n[s][-1] for n in path[1:]) for s in (0, 1))
        agree = first[k + gap :] == second[: -(k + gap)] if len(path) == len(es) + 1 else None
        status = "partial" if agree is None else "complete" if agree else "inconsistent"
        return pd.DataFrame([(*key, first + second[-(k + gap) :] if agree else None, status)])

    shape = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by) + ", genome string, status string"
    return pairs.groupBy(*by).applyInPandas(solve, shape)


def contigs(kmers: DataFrame, by: list[str], cycle_per_node: bool = False) -> DataFrame:
    """Maximal non-branching paths as (by, contig, n_edges).

    Edges are linked to the next edge through nodes with one edge in and one out. Where an edge lies on its path comes from pointer doubling over numbers, log2 of
    the longest path's edges in rounds; each path is spelled once, at the end. Isolated cycles are what the doubling finds to go round; they are spelled from
    their smallest node, once, or once for each of their nodes with cycle_per_node.
    """
    own = [f"_by{i}" for i in range(len(by))]  # apart from the names used here
    found = _contigs(kmers.select(*[F.col(b).alias(o) for b, o in zip(by, own)], "kmer"), own, cycle_per_node)
    return found.select(*[F.col(o).alias(b) for b, o in zip(by, own)], "contig", "n_edges")


def _contigs(kmers: DataFrame, by: list[str], cycle_per_node: bool) -> DataFrame:
    e = stored(edges(kmers).select(*by, "src", "dst").withColumn("e", F.monotonically_increasing_id()))
    inner = degrees(e, by).where("in_degree = 1 AND out_degree = 1").select(*by, F.col("node").alias("dst"))
    follow = e.select(*by, F.col("src").alias("dst"), F.col("e").alias("next")).join(inner, [*by, "dst"])
    follow = stored(e.join(follow, [*by, "dst"], "left").select("e", "next"))
    walk = walked(follow)
    path = e.join(walk.where("done").select("e", F.col("far").alias("trail"), "left"), "e")
    found = _spelled(path, by)
    rings = stored(e.join(walk.where("NOT done").select("e", F.col("low").alias("trail")), "e"), small=True)
    if rings.isEmpty():
        return found.select(*by, "contig", "n_edges")
    first = rings.groupBy("trail").agg(F.min_by("e", "src").alias("next")).select("next", F.lit(True).alias("cuts"))
    line = rings.select("e", "trail").join(follow, "e").join(first, "next", "left").select("e", "trail", F.when(F.col("cuts"), None).otherwise(F.col("next")).alias("next"))
    turn = rings.drop("trail").join(walked(line.select("e", "next")).select("e", F.col("far").alias("trail"), "left"), "e")
    ring = _spelled(turn, by)
    if cycle_per_node:
        size = F.length("contig") - F.col("n_edges")  # letters of a node
        whole = F.concat(F.col("contig"), F.substring("contig", size + 1, F.col("n_edges")))
        ring = ring.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_edges")))).withColumn("contig", F.substring(whole, F.col("at"), F.length("contig")))
    return found.unionByName(ring, allowMissingColumns=True).select(*by, "contig", "n_edges")


def _spelled(edge_rows: DataFrame, by: list[str]) -> DataFrame:
    """by, contig, n_edges of edges with their trail and how many edges are left after each."""
    last = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), F.right("dst", F.lit(1)).alias("c")))), lambda x: x["c"])
    rows = edge_rows.groupBy(*by, "trail").agg(F.max_by("src", "left").alias("src"), F.array_join(last, "").alias("tail"), F.count(F.lit(1)).cast("int").alias("n_edges"))
    return rows.select(*by, F.concat("src", "tail").alias("contig"), "n_edges")
