"""Distances between aligned sequences, trees from them, and parsimony."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kmers import hamming, letters
from .pairs import all_pairs

EDGES = "parent string, child string, child_ord int, length double"


def drop_gap_columns(rows: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """rows (aligned, one group each) without the columns in which a sequence of the group has a gap."""
    gaps = F.transform(letters(F.col(seq)), lambda c: (c == "-").cast("int"))
    places = rows.select(*by, F.explode(F.array_except(F.transform(gaps, lambda g, i: F.when(g == 1, i)), F.array(F.lit(None).cast("int")))).alias("i")).groupBy(*by).agg(F.collect_set("i").alias("_g"))
    kept = F.filter(F.transform(letters(F.col(seq)), lambda c, i: F.when(~F.array_contains("_g", i), c)), lambda c: c.isNotNull())
    return rows.join(places, by, "left").withColumn("_g", F.coalesce("_g", F.array().cast("array<int>"))).withColumn(seq, F.array_join(kept, "")).drop("_g")


def kimura(v: Column, w: Column) -> Column:
    """Kimura's two-parameter distance to 2 decimals: columns with a gap don't count; 0 if none is left; infinite where saturated."""
    n = F.least(F.length(v), F.length(w))
    pairs = F.filter(F.arrays_zip(letters(F.left(v, n)).alias("a"), letters(F.left(w, n)).alias("b")), lambda p: (p["a"] != "-") & (p["b"] != "-"))
    purine = lambda c: c.isin("A", "G")
    share = lambda f: F.size(F.filter(pairs, f)) / F.size(pairs).cast("double")
    p = share(lambda x: (x["a"] != x["b"]) & (purine(x["a"]) == purine(x["b"])))
    q = share(lambda x: purine(x["a"]) != purine(x["b"]))
    a, b = 1 - 2 * p - q, 1 - 2 * q
    return F.when(F.size(pairs) == 0, 0.0).when((a <= 0) | (b <= 0), float("inf")).otherwise(F.round(-0.5 * F.ln(a * F.sqrt(b)), 2))


def distances(rows: DataFrame, by: list[str], order: str = "ordinal", seq: str = "seq", kind: str = "hamming") -> DataFrame:
    """by, i, j, d for i < j within a group."""
    a = rows.select(*by, F.col(order).alias("i"), F.col(seq).alias("_v"))
    b = rows.select(*by, F.col(order).alias("j"), F.col(seq).alias("_w"))
    pairs = a.join(b, by) if by else all_pairs(a, b, "i", "j")
    d = hamming(F.col("_v"), F.col("_w")).cast("double") if kind == "hamming" else kimura(F.col("_v"), F.col("_w"))
    return pairs.where("i < j").select(*by, "i", "j", d.alias("d"))


def matrix(pdf: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    at = {n: k for k, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for i, j, x in zip(pdf["i"], pdf["j"], pdf["d"]):
        d[at[i], at[j]] = d[at[j], at[i]] = x
    return names, d


def upgma(names: list, d: np.ndarray) -> list[tuple]:
    """(parent, child, child_ord, length). Clusters merge by mean distance, the first smallest in order of creation; new ones are
    numbered on from the largest name. Means are updated by size, which equals the mean over all pairs of leaves."""
    n = len(names)
    ids, age, size = list(range(n)), {k: 0.0 for k in range(n)}, {k: 1 for k in range(n)}
    label = {k: str(names[k]) for k in range(n)}
    dist = {(a, b): float(d[a, b]) for a in range(n) for b in range(n) if a != b}
    edges, new, number = [], n, max((int(x) for x in names), default=-1) + 1
    while len(ids) > 1:
        a, b = min(((x, y) for k, x in enumerate(ids) for y in ids[k + 1 :]), key=lambda p: (round(dist[p], 9), p))
        age[new], label[new] = dist[a, b] / 2, str(number + new - n)
        edges += [(label[new], label[c], o, age[new] - age[c]) for o, c in enumerate((a, b))]
        ids = [x for x in ids if x not in (a, b)]
        for x in ids:
            dist[new, x] = dist[x, new] = (dist[a, x] * size[a] + dist[b, x] * size[b]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        ids.append(new)
        new += 1
    return edges


def neighbor_joining(names: list, d: np.ndarray) -> list[tuple]:
    """(parent, child, child_ord, length). Joined nodes are named by their pair and come last; the last two hang from a root."""
    labels, d, edges = [str(x) for x in names], d.astype(float).copy(), []
    while len(labels) > 2:
        n, r = len(labels), d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(np.round(q, 9).argmin()), n)
        i, j = min(i, j), max(i, j)
        delta = (r[i] - r[j]) / (n - 2)
        name = f"({labels[i]},{labels[j]})"
        edges += [(name, labels[i], 0, (d[i, j] + delta) / 2), (name, labels[j], 1, (d[i, j] - delta) / 2)]
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep, None]], [row[None, keep], np.zeros((1, 1))]])
        labels = [labels[k] for k in keep] + [name]
    if len(labels) == 2:
        root = f"({labels[0]},{labels[1]})"
        edges += [(root, x, o, d[0, 1] / 2) for o, x in enumerate(labels)]
    return edges


def newick(edges: list[tuple], decimals: int = 2) -> str:
    """Children in order; inner nodes by name."""
    below: dict[str, list[tuple]] = {}
    for p, c, o, length in edges:
        below.setdefault(p, []).append((o, c, length))
    root = next(iter(set(below) - {c for _, c, *_ in edges}))

    def text(node: str) -> str:
        kids = sorted(below.get(node, []))
        return node if not kids else "(" + ",".join(f"{text(c)}:{x:.{decimals}f}" for _, c, x in kids) + ")" + node

    return text(root) + ";"


def trees(dist: DataFrame, by: list[str], method: str = "upgma") -> DataFrame:
    """by, parent, child, child_ord, length: a tree for each group's distances (i, j, d)."""
    build = {"upgma": upgma, "neighbor_joining": neighbor_joining}[method]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *e) for e in build(*matrix(pdf))])

    kinds = ", ".join(f"{c} {dist.schema[c].dataType.simpleString()}" for c in by)
    return dist.groupBy(*by).applyInPandas(run, f"{kinds}, {EDGES}")


def newicks(tree_rows: DataFrame, by: list[str], decimals: int = 2) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, newick(list(pdf[["parent", "child", "child_ord", "length"]].itertuples(index=False, name=None)), decimals))])

    kinds = ", ".join(f"{c} {tree_rows.schema[c].dataType.simpleString()}" for c in by)
    return tree_rows.groupBy(*by).applyInPandas(run, f"{kinds}, newick string")


def internal_edges(tree_rows: DataFrame, by: list[str]) -> DataFrame:
    """Edges whose child has children."""
    inner = tree_rows.select(*by, F.col("parent").alias("child")).distinct()
    return tree_rows.join(inner, [*by, "child"], "left_semi")


def parsimony(tree: dict[str, list[str]], root: str, seqs: dict[str, str], alphabet: str = "ACGT") -> tuple[int, dict[str, str]]:
    """Sankoff with unit costs, all columns at once: the score and a sequence for every node, ties to the first letter."""
    size, letters_ = len(next(iter(seqs.values()))), np.array(sorted(alphabet))
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += tree.get(n, [])
    cost: dict[str, np.ndarray] = {}
    for n in reversed(order):
        if n in seqs:
            own = np.array(list(seqs[n]))
            cost[n] = np.where(own[:, None] == letters_[None, :], 0.0, np.inf)
        else:
            cost[n] = sum(np.minimum(cost[c], cost[c].min(1, keepdims=True) + 1) for c in tree[n])
    pick = {root: cost[root].argmin(1)}
    for n in order:
        for c in tree.get(n, []):
            stay = cost[c][np.arange(size), pick[n]]  # against a change, which costs 1
            pick[c] = np.where(stay <= cost[c].min(1) + 1, pick[n], cost[c].argmin(1))
    return int(cost[root].min(1).sum()), {n: "".join(letters_[pick[n]]) for n in order}


def random_tree(names: list[str], seed: int) -> tuple[dict[str, list[str]], str]:
    """Random pairs join until one node is left."""
    r, nodes, tree, k = random.Random(seed), list(names), {}, 0
    while len(nodes) > 1:
        a = nodes.pop(r.randrange(len(nodes)))
        b = nodes.pop(r.randrange(len(nodes)))
        k += 1
        name = f"n{k}"
        tree[name] = [a, b]
        nodes.append(name)
    return tree, nodes[0]


def nni(tree: dict[str, list[str]]) -> list[dict[str, list[str]]]:
    """Two variants for each inner edge (u, v): a child of v changes places with v's sibling."""
    out = []
    for u, kids in tree.items():
        for v in kids:
            if v in tree:
                sibling = kids[1] if kids[0] == v else kids[0]
                for c in tree[v]:
                    t = {n: list(x) for n, x in tree.items()}
                    t[u] = [c if x == sibling else x for x in t[u]]
                    t[v] = [sibling if x == c else x for x in t[v]]
                    out.append(t)
    return out


def parsimony_search(names: list[str], seqs: dict[str, str], seed: int, alphabet: str = "ACGT") -> tuple[int, dict[str, list[str]], str]:
    """From a random tree, the first better NNI variant, until none is."""
    tree, root = random_tree(names, seed)
    best = parsimony(tree, root, seqs, alphabet)[0]
    while True:
        for t in nni(tree):
            s = parsimony(t, root, seqs, alphabet)[0]
            if s < best:
                best, tree = s, t
                break
        else:
            return best, tree, root


def parsimony_trees(rows: DataFrame, by: list[str], seeds: int = 1, order: str = "ordinal", seq: str = "seq", alphabet: str = "ACGT") -> DataFrame:
    """by, seed, score, newick: a search from each of several random trees; the searches run in parallel."""
    many = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        names = [str(x) for x in pdf[order]]
        score, tree, root = parsimony_search(names, dict(zip(names, pdf[seq])), int(key[-1]), alphabet)
        text = lambda n: n if n not in tree else "(" + ",".join(map(text, tree[n])) + ")"
        return pd.DataFrame([(*key, score, text(root) + ";")])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return many.groupBy(*by, "seed").applyInPandas(run, f"{kinds}{', ' if by else ''}seed int, score int, newick string")


def small_parsimony(tree_rows: DataFrame, rows: DataFrame, by: list[str], order: str = "ordinal", seq: str = "seq", alphabet: str = "ACGT") -> DataFrame:
    """by, node, label, score: sequences for all nodes of given trees (parent, child, child_ord; leaves named by order)."""

    def run(key: tuple, edges: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        tree: dict[str, list[str]] = {}
        for p, c in edges.sort_values(["parent", "child_ord"])[["parent", "child"]].itertuples(index=False, name=None):
            tree.setdefault(p, []).append(c)
        root = next(iter(set(tree) - set(edges["child"])))
        score, labels = parsimony(tree, root, {str(n): s for n, s in zip(leaves[order], leaves[seq])}, alphabet)
        return pd.DataFrame([(*key, n, x, score) for n, x in labels.items()])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return tree_rows.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(run, f"{kinds}, node string, label string, score int")


def tree_variants(tree_rows: DataFrame, by: list[str]) -> DataFrame:
    """by, variant, parent, child, child_ord: the NNI neighbours of each tree."""

    def run(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        tree: dict[str, list[str]] = {}
        for p, c in edges.sort_values(["parent", "child_ord"])[["parent", "child"]].itertuples(index=False, name=None):
            tree.setdefault(p, []).append(c)
        rows = [(*key, v, p, c, o) for v, t in enumerate(nni(tree)) for p, cs in t.items() for o, c in enumerate(cs)]
        return pd.DataFrame(rows, columns=[*by, "variant", "parent", "child", "child_ord"])

    kinds = ", ".join(f"{c} {tree_rows.schema[c].dataType.simpleString()}" for c in by)
    return tree_rows.groupBy(*by).applyInPandas(run, f"{kinds}, variant int, parent string, child string, child_ord int")


def padded(rows: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """rows with the sequences of a group filled up with gaps to its longest."""
    size = rows.groupBy(*by).agg(F.max(F.length(seq)).alias("_n"))
    return rows.join(size, by).withColumn(seq, F.rpad(seq, F.col("_n"), F.lit("-"))).drop("_n")


def tree_text(tree_rows: DataFrame, by: list[str]) -> DataFrame:
    """by, text: a node's name, and for each child, two spaces further in, a line "|-- name (len=x)", x to four places, and the child's own text
    another two further in."""

    def run(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list[tuple]] = {}
        for p, c, o, x in edges[["parent", "child", "child_ord", "length"]].itertuples(index=False, name=None):
            below.setdefault(str(p), []).append((o, str(c), x))
        root = next(iter(set(below) - set(map(str, edges["child"]))))
        todo, lines = [(0, root, None)], []  # depth, node, the length above it; a node with a length has its own text still to come
        while todo:
            depth, node, x = todo.pop()
            if x is not None:
                lines.append("  " * depth + f"|-- {node} (len={x:.4f})")
                todo.append((depth + 1, node, None))
            else:
                lines.append("  " * depth + node)
                todo += [(depth + 1, c, y) for _, c, y in sorted(below.get(node, []), reverse=True)]
        return pd.DataFrame([(*key, "\n".join(lines))])

    kinds = ", ".join(f"{c} {tree_rows.schema[c].dataType.simpleString()}" for c in by)
    return tree_rows.groupBy(*by).applyInPandas(run, f"{kinds}, text string")


def random_trees(rows: DataFrame, by: list[str], seed: int, order: str = "ordinal") -> DataFrame:
    """by, parent, child, child_ord."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, _ = random_tree([str(x) for x in sorted(pdf[order])], seed)
        return pd.DataFrame([(*key, p, c, o) for p, cs in tree.items() for o, c in enumerate(cs)], columns=[*by, "parent", "child", "child_ord"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, parent string, child string, child_ord int")
