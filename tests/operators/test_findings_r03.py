"""What the third review found: work in one task, plans that grow faster than their input."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import sql
from helixframe.operators import cluster, euler, kmers, spectra


def _kept(pep, share, seed):
    """The masses that stay, straight from the definition; whatever ends behind a letter that is no residue is unknown."""
    m = [spectra.DECI.get(c) for c in pep]
    add = lambda x: None if None in x else sum(x)
    n = len(m)
    ring = [0] + [None if None in m[:j] else add(m[i:j]) for i in range(n) for j in range(i + 1, n + 1)]
    ring += [None if add(m) is None else add(m) - add(m[i:j]) for i in range(1, n) for j in range(i + 1, n)]
    order = lambda x: (x is None, x or 0)
    ring.sort(key=order)
    drawn = sorted((hashlib.md5(f"{seed}:{pep}:{i}".encode()).hexdigest(), i) for i in range(len(ring)))
    return sorted((ring[i] for _, i in drawn[: len(ring) - round(len(ring) * share)]), key=order)


def test_dropped_spectra_of_one_partition_are_dealt_out(spark):
    peps = ["NQEL", "NQEL", "", "G", "GX", "GXA", "AW", None, "STANDARDSTEEL", "WWWWWWWWWWWWWWWWWWWWWWWWWWWWWW"]
    df = spark.createDataFrame(list(enumerate(peps)), "id int, pep string").coalesce(1)
    for share, seed in ((0.1, 5), (0.5, 3)):
        found = spectra.cyclic_spectrum(df, drop_share=share, seed=seed)
        assert found.rdd.getNumPartitions() > 1
        assert found.columns == ["id", "pep", "mass"]
        rows = [(r["id"], r["mass"]) for r in found.collect()]
        for i, p in enumerate(peps):
            own = sorted((m for j, m in rows if j == i), key=lambda x: (x is None, x or 0))
            assert own == ([] if p is None else _kept(p, share, seed)), p


def _points(spark, n, shift=0.0):
    rng = random.Random(7)
    rows = [(i, i % 3, [shift + rng.gauss(0, 1) for _ in range(5)]) for i in range(n)]
    rows[3] = (3, 0, list(rows[0][2]))  # a copy, a near copy, one that doesn't vary, one of another length, nulls
    rows[6] = (6, 0, [x + 1e-7 for x in rows[0][2]])
    rows[9], rows[12], rows[15], rows[18] = (9, 0, [2.0] * 5), (12, 0, [1.0]), (15, 0, None), (18, 0, [1.0, None, 2.0, 3.0, 4.0])
    return rows, spark.createDataFrame(rows, "point_id long, g int, features array<double>").coalesce(1)


def test_distances_in_blocks(spark):
    for shift in (0.0, 1e4):
        rows, df = _points(spark, 90, shift)
        for kind in ("euclidean", "pearson"):
            for by in (["g"], []):
                found = cluster.distance_rows(df, by, kind, block=10)
                assert found.columns == [*by, "i", "j", "d"]
                got = {(r["i"], r["j"]): r["d"] for r in found.collect()}
                assert len(got) == found.count() and set(got) == {(i, j) for i in range(90) for j in range(i + 1, 90) if not by or i % 3 == j % 3}
                for (i, j), d in got.items():
                    a, b = rows[i][2], rows[j][2]
                    if a is None or b is None or len(a) != len(b) or None in a + b:
                        assert d is None
                    elif kind == "euclidean":
                        assert abs(d - np.linalg.norm(np.subtract(a, b))) <= 1e-9
                        assert d == 0 or a != b
                    else:
                        want = 1.0 if 9 in (i, j) else 1 - np.corrcoef(a, b)[0, 1]
                        assert abs(d - want) < (1e-7 if shift else 1e-9)
    one = cluster.distance_rows(df.where("g = 0"), ["g"], block=5).groupBy(F.spark_partition_id()).count()
    assert one.count() > 1  # a large group is no task's own


def test_cast_of_points_is_that_of_their_matrix(spark):
    rows, df = _points(spark, 150)
    got = cluster.cast_points(df, ["g"], 0.6).collect()
    assert sorted(r["point_id"] for r in got) == list(range(150))
    for g in range(3):
        ids = [i for i, k, f in rows if k == g and f and len(f) == 5 and None not in f]
        p = np.array([rows[i][2] for i in ids])
        want = cluster.cast_clusters(ids, np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), 0.6)
        own = {}
        for r in got:
            if r["point_id"] in ids:
                own.setdefault(r["cluster"], []).append(r["point_id"])
        assert sorted(map(sorted, own.values())) == sorted(map(sorted, want))
        assert len(want) > 1


def test_paired_paths_whose_trails_meet(spark):
    pair = lambda s, i: (s[i : i + 3], s[i + 4 : i + 7])
    seqs = ["ACGTACGTACGTA", "TTACGTACGTACC", "ACGTACGTACGTA"]
    reads = [pair(s, i) for s in seqs for i in range(len(s) - 6)]
    df = spark.createDataFrame(reads, "a string, b string")
    for rest in (1_000_000, 2):
        rows = euler.paired_paths(df, rest).collect()
        assert sorted((r["a"], r["b"]) for r in rows) == sorted(reads)
        at = {(r["path"], r["pos"]): r for r in rows}
        assert len(at) == len(rows)
        for (path, pos), r in at.items():
            if pos:
                before = at[path, pos - 1]
                assert (before["a"][1:], before["b"][1:]) == (r["a"][:-1], r["b"][:-1])


def _texts():
    rng = random.Random(3)
    return ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 13, 14, 60, 200)] * 2 + [None, "ACGNNACGTACGTTGCAACGTAC", "ACGTÄCGTACGTACGGTACGTAC", "A\nCGTACGTACGTACGTTACG"]


def test_totals_of_kmers_in_small_chunks(spark):
    rows = [(None if i % 5 == 4 else i % 3, t) for i, t in enumerate(_texts())]
    df = spark.createDataFrame(rows, "g int, seq string")
    own = [(g, t or "") for g, t in rows]
    for chunk in (7, 1 << 20):
        for k in (3, 12):
            got = {r["kmer"]: r["n"] for r in kmers.kmer_totals(df, k, chunk=chunk).collect()}
            assert got == Counter(t[i : i + k] for _, t in own for i in range(len(t) - k + 1))
            got = {(r["g"], r["kmer"]): r["n"] for r in kmers.kmer_totals(df, k, chunk=chunk, by=["g"]).collect()}
            assert got == Counter((g, t[i : i + k]) for g, t in own for i in range(len(t) - k + 1))


def test_kmers_of_a_row_without_python_or_shuffle(spark):
    sql.register(spark)
    df = spark.createDataFrame(list(enumerate(_texts())), "id int, seq string")
    df.createOrReplaceTempView("kmer_texts")
    found = spark.sql("SELECT id, hf_kmers(seq, 5) AS ks FROM kmer_texts")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()  # whose batches of arrays took a worker's memory
    for r in found.collect():
        t = _texts()[r["id"]]
        assert (r["ks"] is None) == (t is None)
        assert t is None or [tuple(x) for x in r["ks"]] == [(i, t[i : i + 5]) for i in range(len(t) - 4)]


def test_searches_of_spectra_are_dealt_out(spark):
    peps = ["NQEL", "AW", "G", "GAS", "NQE", "PEP"]
    df = spectra.cyclic_spectrum(spark.createDataFrame([(p, p) for p in peps], "spec_id string, pep string"))
    found = spectra.sequence_spectra(df, method="leaderboard")
    assert found.rdd.getNumPartitions() == 4  # few bytes, but not one task
    assert {r["spec_id"]: r["score"] for r in found.collect()} == {p: len(spectra._cyclic([spectra.DECI[c] for c in p])) for p in peps}


def test_totals_of_read_pairs(spark):
    k, gap = 3, 4
    rows = [(t,) for t in _texts() + ["ACGTNACGTACGTAACGT" * 3, "N" * 30]]
    df = spark.createDataFrame(rows, "seq string").coalesce(1)
    want = Counter((t[i : i + k], t[i + k + gap : i + 2 * k + gap]) for (t,) in rows if t for i in range(len(t) - 2 * k - gap + 1))
    for chunk in (7, 1 << 20):
        found = kmers.read_pair_totals(df, k, gap, chunk=chunk)
        got = found.collect()
        assert {(r["a"], r["b"]): r["n"] for r in got} == want and len(got) == len(want)
    for k in (5, 7, 12):
        got = {(r["a"], r["b"]): r["n"] for r in kmers.read_pair_totals(df, k, 0).collect()}
        assert got == Counter((t[i : i + k], t[i + k : i + 2 * k]) for (t,) in rows if t for i in range(len(t) - 2 * k + 1))
