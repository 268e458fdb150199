"""Shared k-mers, synteny blocks, signed permutations, reversals and 2-breaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kmers import kmers, reverse_complement


def shared_kmers(p: DataFrame, q: DataFrame, k: int, by: list[str] = (), seq: str = "seq", reversed_too: bool = False) -> DataFrame:
    """by, i, j, orient: + for equal k-mers, - for reverse complements (and, with reversed_too, for plain reversals).

    One equi-join: the right side offers each k-mer under every strand, so the left is shuffled once."""
    left = kmers(p, k, seq, list(by)).withColumnRenamed("pos", "i")
    strands = [F.struct(F.col("kmer").alias("kmer"), F.lit("+").alias("orient")), F.struct(reverse_complement(F.col("kmer")).alias("kmer"), F.lit("-").alias("orient"))]
    if reversed_too:
        strands.append(F.struct(F.reverse("kmer").alias("kmer"), F.lit("-").alias("orient")))
    right = kmers(q, k, seq, list(by)).select(*by, F.col("pos").alias("j"), F.inline(F.array(*strands)))
    return left.join(right, [*by, "kmer"]).select(*by, "i", "j", "orient")


def global_offsets(chromosomes: DataFrame, order: str = "ordinal", by: list[str] = (), seq: str = "seq") -> DataFrame:
    """chromosomes with the total length of those before. Only lengths are put in order, not sequences."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = chromosomes.select(*by, order, F.length(seq).alias("_n"))
    return chromosomes.join(sizes.select(*by, order, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("shift")), [*by, order])


def shared_kmers_chromosomes(p: DataFrame, q: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """p_chrom, q_chrom, i, j, orient with positions in the whole genomes. Genomes have (ordinal, seq)."""
    a = kmers(global_offsets(p, seq=seq).withColumnRenamed("ordinal", "p_chrom"), k, seq).withColumn("i", F.col("pos") + F.col("shift")).drop("pos", "shift")
    b = kmers(global_offsets(q, seq=seq).withColumnRenamed("ordinal", "q_chrom"), k, seq).withColumn("j", F.col("pos") + F.col("shift")).drop("pos", "shift")
    strands = F.array(F.struct(F.col("kmer").alias("kmer"), F.lit("+").alias("orient")), F.struct(reverse_complement(F.col("kmer")).alias("kmer"), F.lit("-").alias("orient")), F.struct(F.reverse("kmer").alias("kmer"), F.lit("-").alias("orient")))
    return a.join(b.select("q_chrom", "j", F.inline(strands)), "kmer").select("p_chrom", "q_chrom", "i", "j", "orient")


def dot_plot(matches: DataFrame, scale: float = 1000.0) -> DataFrame:
    return matches.withColumns({"x": F.col("i") / F.lit(scale), "y": F.col("j") / F.lit(scale)}).withColumnRenamed("orient", "strand")


def synteny_edges(matches: DataFrame, distance: int, by: list[str] = ()) -> DataFrame:
    """by, src, dst (structs of i, j, orient): pairs of different matches within the distance in both directions.

    Each match goes to its own cell and the cells it could neighbour, so the band join is an equi-join on cells. A pair is
    made in the one direction src < dst."""
    m = matches.select(*by, F.struct("i", "j", "orient").alias("m")).distinct()
    cell = lambda c: F.floor(F.col(c) / distance)
    home = m.withColumns({"bx": cell("m.i"), "by_": cell("m.j")}).withColumnRenamed("m", "src")
    around = F.array(*[F.struct((cell("m.i") + x).alias("bx"), (cell("m.j") + y).alias("by_")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    near = m.select(*by, F.col("m").alias("dst"), F.inline(around))
    close = (F.abs(F.col("src.i") - F.col("dst.i")) <= distance) & (F.abs(F.col("src.j") - F.col("dst.j")) <= distance)
    return home.join(near, [*by, "bx", "by_"]).where(close & (F.col("src") < F.col("dst"))).select(*by, "src", "dst")


def synteny_blocks(matches: DataFrame, distance: int, min_size: int, by: list[str] = ()) -> DataFrame:
    """by, i, j, orient, block: matches in components of min_size or more. A match without a neighbour is in none."""
    e = synteny_edges(matches, distance, by)
    node = lambda c: F.struct(*by, F.col(c).alias("m"))
    label = components(e.select(node("src").alias("src"), node("dst").alias("dst")))
    size = F.count(F.lit(1)).over(Window.partitionBy("component"))
    return label.withColumn("_n", size).where(F.col("_n") >= min_size).select(*[F.col(f"node.{b}").alias(b) for b in by], "node.m.i", "node.m.j", "node.m.orient", F.col("component").alias("block"))


def signed_permutation(blocks: DataFrame, by: list[str] = (), p: str = "i", q: str = "j") -> DataFrame:
    """by, id, q_rank, sign: blocks numbered along p; where each comes along q and which way."""
    mean = blocks.groupBy(*by, "block").agg(F.avg(p).alias("p_at"), F.avg(q).alias("q_at"), F.sum(F.when(F.col("orient") == "+", 1).otherwise(-1)).alias("votes"))
    along = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(c, "block"))
    return mean.select(*by, along("p_at").alias("id"), along("q_at").alias("q_rank"), F.when(F.col("votes") >= 0, 1).otherwise(-1).alias("sign"))


def permutations_by_chromosome(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chrom, ord, block) of both genomes, from blocks with p_chrom, q_chrom: numbered through along p."""
    mean = blocks.groupBy("p_chrom", "q_chrom", "block").agg(F.avg("i").alias("p_at"), F.avg("j").alias("q_at"), F.sum(F.when(F.col("orient") == "+", 1).otherwise(-1)).alias("votes"))
    # numbered within chromosomes, and on from the chromosomes before, of which there are few
    own = mean.withColumn("_n", F.row_number().over(Window.partitionBy("p_chrom").orderBy("p_at", "block")))
    size = mean.groupBy("p_chrom").agg(F.count(F.lit(1)).alias("_s"))
    before = size.select("p_chrom", F.coalesce(F.sum("_s").over(Window.orderBy("p_chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ids = own.join(before, "p_chrom").withColumn("id", (F.col("_n") + F.col("_before")).cast("int"))
    on = lambda chrom, at: F.row_number().over(Window.partitionBy(chrom).orderBy(at, "block"))
    sign = F.when(F.col("votes") >= 0, 1).otherwise(-1)
    return (
        ids.select(F.col("p_chrom").alias("chrom"), on("p_chrom", "p_at").alias("ord"), F.col("id").alias("block")),
        ids.select(F.col("q_chrom").alias("chrom"), on("q_chrom", "q_at").alias("ord"), (F.col("id") * sign).alias("block")),
    )


def breakpoints(perm: Column) -> Column:
    """Places in 0, perm, n + 1 where the next number isn't one more."""
    n = F.size(perm)
    full = F.concat(F.array(F.lit(0)), perm, F.array(n + 1))
    steps = F.zip_with(F.slice(full, 1, n + 1), F.slice(full, 2, n + 1), lambda a, b: (b - a != 1).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def reversal(perm: Column, i: Column, j: Column) -> Column:
    """perm with places i to j (from 0) in reverse and negated."""
    middle = F.transform(F.reverse(F.slice(perm, i + 1, j - i + 1)), lambda x: -x)
    return F.concat(F.slice(perm, F.lit(1), i), middle, F.slice(perm, j + 2, F.size(perm)))


def sort_by_breakpoints(perm: list[int]) -> tuple[int, list[list[int]]]:
    """Reversals, each the first that removes two breakpoints, else the first that removes one, until none does."""
    p, steps = [0, *perm, len(perm) + 1], []
    while True:
        n, choice = len(p) - 2, None
        for i in range(1, n + 1):
            for j in range(i, n + 1):
                gain = (p[i] - p[i - 1] != 1) + (p[j + 1] - p[j] != 1) - (-p[j] - p[i - 1] != 1) - (p[j + 1] + p[i] != 1)
                if gain == 2 or (gain == 1 and choice is None):
                    choice = (i, j)
                    if gain == 2:
                        break
            else:
                continue
            break
        if choice is None:
            return len(steps), steps
        i, j = choice
        p[i : j + 1] = [-x for x in reversed(p[i : j + 1])]
        steps.append(p[1:-1])


def breakpoint_sort(perms: DataFrame, perm: str = "perm") -> DataFrame:
    """perms with the number of reversals of the greedy sort, and each state on the way."""

    def run(p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sort_by_breakpoints([int(v) for v in x]) for x in p], columns=["n_reversals", "steps"])

    run.__annotations__ = {"p": pd.Series, "return": pd.DataFrame}
    return perms.withColumn("_s", F.pandas_udf(run, "struct<n_reversals:int,steps:array<array<int>>>")(perm)).select("*", "_s.n_reversals", "_s.steps").drop("_s")


def chromosome_to_cycle(chromosome: Column) -> Column:
    return F.flatten(F.transform(chromosome, lambda x: F.when(x > 0, F.array(2 * x - 1, 2 * x)).otherwise(F.array(-2 * x, -2 * x - 1))))


def cycle_to_chromosome(cycle: Column) -> Column:
    at = lambda i: F.element_at(cycle, (2 * i + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), (F.size(cycle) / 2).cast("int") - 1), lambda i: F.when(at(i) < F.element_at(cycle, (2 * i + 2).cast("int")), F.element_at(cycle, (2 * i + 2).cast("int")) / 2).otherwise(-at(i) / 2).cast("int"))


def colored_edges(genomes: DataFrame, by: list[str], chrom: str = "chrom", order: str = "ord", block: str = "block") -> DataFrame:
    """by, a, b: from the second node of a block to the first of the next on the circle."""
    w = Window.partitionBy(*by, chrom).orderBy(order)
    b = F.col(block)
    rows = genomes.withColumns({"_in": F.when(b > 0, 2 * b - 1).otherwise(-2 * b), "a": F.when(b > 0, 2 * b).otherwise(-2 * b - 1)})
    first = F.first("_in").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*by, "a", F.coalesce(F.lead("_in").over(w), first).alias("b"))


def black_edges(genomes: DataFrame, by: list[str], block: str = "block") -> DataFrame:
    """by, a, b: the two nodes of each block."""
    x = F.abs(F.col(block))
    return genomes.select(*by, (2 * x - 1).alias("a"), (2 * x).alias("b"))


def two_break_edges(edge_rows: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Edges i0-i1 and j0-j1 (in either direction) go, i0-j0 and i1-j1 come."""
    ends = lambda x, y: ((F.col("a") == x) & (F.col("b") == y)) | ((F.col("a") == y) & (F.col("b") == x))
    rest = edge_rows.where(~(ends(i0, i1) | ends(j0, j1)))
    new = edge_rows.sparkSession.createDataFrame([(i0, j0), (i1, j1)], "a int, b int")
    return rest.select("a", "b").union(new)


def small_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node that each is joined with, of many small graphs at once."""
    nodes, place = np.unique(np.concatenate((a.ravel(), b.ravel())), return_inverse=True)
    x, y = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _gathered(genomes: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: its blocks in order. One shuffle, and none where genomes are dealt by the group already."""
    block = F.struct("genome", F.col("chrom").cast("long").alias("chrom"), F.col("ord").cast("long").alias("ord"), F.col("block").cast("long").alias("block"))
    return genomes.groupBy(*by).agg(F.array_sort(F.collect_list(block)).alias("_b"))


def _circle_edges(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a batch of groups: row, genome, block and the edge (a, b) from each block to the next on its circle."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    genome, chrom, block = flat.field("genome").to_numpy(zero_copy_only=False), flat.field("chrom").to_numpy(), flat.field("block").to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    q = genome == "Q"
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (q[1:] != q[:-1]) | (chrom[1:] != chrom[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    last = np.append(new[1:], True) if len(row) else new
    follow = np.where(last, first, np.arange(1, len(row) + 1))
    come, leave = np.where(block > 0, 2 * block - 1, -2 * block), np.where(block > 0, 2 * block, -2 * block - 1)
    return row, q, block, leave, come[follow] if len(row) else come


def _grouped(genomes: DataFrame, by: list[str], shape: str, solve) -> DataFrame:
    """by and the columns of shape; solve takes a batch's column of blocks and gives group numbers and columns."""
    names = [c.split()[0] for c in shape.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, *columns = solve(b.column("_b"))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in by), *map(pa.array, columns)], [*by, *names])

    kinds = "".join(f"`{c}` {genomes.schema[c].dataType.simpleString()}, " for c in by)
    return _gathered(genomes, by).mapInArrow(run, kinds + shape)


def two_break_distance(genomes: DataFrame, by: list[str]) -> DataFrame:
    """by, distance: blocks less cycles. genomes: by, genome (P or Q), chrom, ord, block, the same blocks in both.

    A group is one row, and the cycles of many groups are found at once; `two_break_distance_large` is for groups beyond a row."""

    def solve(column: pa.Array) -> tuple:
        row, q, block, a, b = _circle_edges(column)
        width = 2 * int(np.abs(block).max(initial=0)) + 2
        _, label = small_components(row * width + a, row * width + b)
        cycles = np.bincount(np.unique(label) // width, minlength=len(column))
        return np.arange(len(column)), np.bincount(row[~q], minlength=len(column)) - cycles

    return _grouped(genomes, by, "distance long", solve)


def two_break_distance_large(genomes: DataFrame, by: list[str]) -> DataFrame:
    """The same by label propagation over all groups, for groups that are too large for one row."""
    e = colored_edges(genomes, [*by, "genome"])
    node = lambda c: F.struct(*by, F.col(c).alias("n"))
    cycles = components(e.select(node("a").alias("src"), node("b").alias("dst"))).groupBy(*[F.col(f"component.{b}").alias(b) for b in by]).agg(F.countDistinct("component").alias("cycles"))
    n = genomes.where("genome = 'P'").groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"))
    return n.join(cycles, by).select(*by, (F.col("blocks") - F.col("cycles")).alias("distance"))


def node_groups(genomes: DataFrame, by: list[str]) -> DataFrame:
    """by, node, component (its smallest node): what the edges between blocks and those within blocks join, which is a genome's chromosomes."""

    def solve(column: pa.Array) -> tuple:
        row, _, block, a, b = _circle_edges(column)
        width, x = 2 * int(np.abs(block).max(initial=0)) + 2, np.abs(block)
        node, label = small_components(row * width + np.concatenate((a, 2 * x - 1)).reshape(2, -1), row * width + np.concatenate((b, 2 * x)).reshape(2, -1)) if len(row) else (row, row)
        return node // width, node % width, label % width

    return _grouped(genomes, by, "node long, component long", solve)


def _edges(genome: list[list[int]]) -> list[tuple[int, int]]:
    out = []
    for c in genome:
        nodes = [n for x in c for n in ((2 * x - 1, 2 * x) if x > 0 else (-2 * x, -2 * x - 1))]
        out += [(nodes[2 * i + 1], nodes[(2 * i + 2) % len(nodes)]) for i in range(len(c))]
    return out


def _genome(edges: list[tuple[int, int]]) -> list[list[int]]:
    other = {a: b for a, b in edges} | {b: a for a, b in edges}
    partner = lambda n: n + 1 if n % 2 else n - 1
    left, out = set(other), []
    while left:
        n = start = min(left)
        c = []
        while True:
            m = partner(n)
            c.append(m // 2 if m > n else -(n // 2))
            left -= {n, m}
            n = other[m]
            if n == start:
                break
        out.append(c)
    return sorted(out, key=lambda c: abs(c[0]))


def two_break(genome: list[list[int]], i0: int, i1: int, j0: int, j1: int) -> list[list[int]]:
    gone = [{i0, i1}, {j0, j1}]
    return _genome([e for e in _edges(genome) if set(e) not in gone] + [(i0, j0), (i1, j1)])


def two_break_scenario(p: list[list[int]], q: list[list[int]]) -> list[list[list[int]]]:
    """Genomes from p to q, each one 2-break from the one before: the smallest edge of q that p lacks is made."""
    blue = sorted(tuple(sorted(e)) for e in _edges(q))
    steps, now = [p], p
    while True:
        other: dict[int, int] = {}
        for a, b in _edges(now):
            other[a], other[b] = b, a
        missing = next(((a, b) for a, b in blue if other[a] != b), None)
        if missing is None:
            return steps
        a, b = missing
        now = two_break(now, a, other[a], b, other[b])
        steps.append(now)


def _scenario_text(blocks) -> list[str]:
    """blocks: (genome, chrom, ord, block) in order."""
    genomes: dict[str, dict[int, list[int]]] = {"P": {}, "Q": {}}
    for x in blocks:
        genomes[x["genome"]].setdefault(x["chrom"], []).append(int(x["block"]))
    p, q = (list(g.values()) for g in genomes.values())
    if sorted(abs(b) for c in p for b in c) != sorted(abs(b) for c in q for b in c):
        raise ValueError("the genomes have different blocks")
    return [format_genome(s) for s in two_break_scenario(p, q)]


def two_break_scenarios(genomes: DataFrame, by: list[str]) -> DataFrame:
    """by, step, genome (text): one row a state. A group's blocks are gathered into a row, so many groups share a batch."""

    def run(b: pd.Series) -> pd.Series:
        return b.map(_scenario_text)

    run.__annotations__ = {"b": pd.Series, "return": pd.Series}
    rows = genomes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("genome", "chrom", "ord", "block"))).alias("_b"))
    return rows.select(*by, F.posexplode(F.pandas_udf(run, "array<string>")("_b")).alias("step", "genome"))


def format_genome(genome: list[list[int]]) -> str:
    return "".join("[" + " ".join(f"{x:+d}" for x in c) + "]" for c in genome)


def format_permutation(perm: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(perm, lambda x: F.concat(F.when(x > 0, "+").otherwise(""), x.cast("string"))), " "), F.lit("]"))


def missing_edges(genomes: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, a_red, b_red: of Q's edges (smaller node first) that P lacks, the smallest, and the other ends of P's edges at a and b,
    which a 2-break takes away to make it. It lies on a cycle of more than two nodes; groups without one are sorted."""

    def solve(column: pa.Array) -> tuple:
        row, q, block, a, b = _circle_edges(column)
        width = 2 * int(np.abs(block).max(initial=0)) + 2
        low, high = np.minimum(a, b), np.maximum(a, b)
        edge = (row * width + low) * width + high
        own = np.sort(edge[q])
        own = own[~np.isin(own, edge[~q])]
        own = own[np.unique(own // width**2, return_index=True)[1]]
        ends, other = np.concatenate((row, row))[np.tile(~q, 2)] * width + np.concatenate((a, b))[np.tile(~q, 2)], np.concatenate((b, a))[np.tile(~q, 2)]
        order = np.argsort(ends)
        partner = lambda node: other[order[np.searchsorted(ends, node, sorter=order)]] if len(own) else node
        group, x, y = own // width**2, own // width % width, own % width
        return group, x, y, partner(group * width + x), partner(group * width + y)

    return _grouped(genomes, by, "a long, b long, a_red long, b_red long", solve)


def genome_edges(text: str) -> list[tuple[int, int]]:
    """The edges between blocks of a genome as format_genome() writes it, smaller node first, sorted."""
    genome = [[int(x) for x in c.split()] for c in text.strip("[]").split("][")]
    return sorted((min(e), max(e)) for e in _edges(genome))


def first_two_breaks(genomes: DataFrame, by: list[str]) -> DataFrame:
    """by, genome: P after the one 2-break that makes its first missing edge."""
    return two_break_scenarios(genomes, by).where("step = 1").select(*by, "genome")


def with_edges(rows: DataFrame, genome: str = "genome") -> DataFrame:
    """rows, one for each edge (a, b) of the genome text."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"a": a, "b": b} for a, b in genome_edges(t)])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return rows.select("*", F.inline(F.pandas_udf(run, "array<struct<a:int,b:int>>")(genome)))
