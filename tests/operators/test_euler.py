"""Paths of whole tables against what any Eulerian decomposition fulfils."""

import random
from collections import Counter

import pytest

from helixframe.operators import euler


def least_paths(edges):
    """How few paths there can be: the surplus of edges out by component, or one for a component without any."""
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        top[find(a)] = find(b)
    surplus = Counter()
    balance = Counter(a for a, _ in edges)
    balance.subtract(Counter(b for _, b in edges))
    for v in top:
        surplus[find(v)] += max(0, balance[v])
    return sum(max(1, n) for n in surplus.values())


def check(found, edges):
    assert Counter((x["src"], x["dst"]) for x in found) == Counter(edges)
    paths = {}
    for x in found:
        paths.setdefault(x["path"], {})[x["pos"]] = (x["src"], x["dst"])
    for p in paths.values():
        assert sorted(p) == list(range(len(p)))
        assert all(p[i][1] == p[i + 1][0] for i in range(len(p) - 1))
    assert len(paths) == least_paths(edges)


def graphs():
    r = random.Random(21)
    yield [("a", "b")]
    yield [("a", "a")] * 5
    yield [("a", "b"), ("b", "a")] * 3 + [("x", "y"), ("y", "x"), ("y", "y")]
    yield [(f"h", f"s{i}") for i in range(30)] + [(f"s{i}", "h") for i in range(30)]  # closed trails around one node
    yield [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(f"c{i + 1}", f"c{i}") for i in range(40)]  # a chain of closed trails
    yield [(r.choice("abcdefgh"), r.choice("abcdefgh")) for _ in range(60)]
    walk = [r.choice("abcdefghijkl") for _ in range(200)]
    yield list(zip(walk, walk[1:]))
    yield [(str(r.randrange(40)), str(r.randrange(40))) for _ in range(50)] + [("p", "q"), ("q", "p")]


@pytest.mark.parametrize("rest", [0, 10**6])
def test_paths_of_several_graphs(spark, rest):
    """All graphs in one table, as components of it."""
    edges = [(f"{n}{a}", f"{n}{b}") for n, g in enumerate(graphs()) for a, b in g]
    rows = [*edges, (None, "x"), ("x", None)]
    found = euler.euler_paths(spark.createDataFrame(rows, "src string, dst string").repartition(3), rest)
    check(found.collect(), edges)


def test_genomes_of_kmers_and_pairs(spark):
    r = random.Random(22)
    genome = "".join(r.choice("ACGT") for _ in range(400))
    k = 12
    counts = Counter(genome[i : i + k] for i in range(len(genome) - k + 1))
    found = euler.kmer_paths(spark.createDataFrame(list(counts.items()), "kmer string, n long")).collect()
    spelled = "".join(x["kmer"] if x["pos"] == 0 else x["kmer"][-1] for x in sorted(found, key=lambda x: x["pos"]))
    assert spelled == genome
    pairs = [(genome[i : i + 6], genome[i + 20 : i + 26]) for i in range(len(genome) - 25)]
    got = sorted(euler.paired_paths(spark.createDataFrame(pairs, "a string, b string")).collect(), key=lambda x: x["pos"])
    assert [(x["a"], x["b"]) for x in got] == pairs
    assert euler.kmer_paths(spark.createDataFrame([], "kmer string, n long")).collect() == []
