"""Invariants, and brute force on small inputs."""

import itertools
import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import align, assembly, hmm, kmers, motifs, patterns, phylo, rearrange, spectra
from helixframe.operators.components import components
from helixframe.sources import fasta

DNA = lambda r, n: "".join(r.choice("ACGT") for _ in range(n))


def best_global(v, w, s, g):
    import functools

    @functools.cache
    def f(i, j):
        if not i or not j:
            return -g * (i + j)
        return max(f(i - 1, j - 1) + s(v[i - 1], w[j - 1]), f(i - 1, j) - g, f(i, j - 1) - g)

    return f(len(v), len(w))


def cost(a, b, p):
    return sum(-p.gap if "-" in (x, y) else p.match if x == y else -p.mismatch for x, y in zip(a, b))


def test_alignments_against_recursion():
    r, p = random.Random(2), align.Scoring(mismatch=1, gap=1)
    for _ in range(40):
        v, w = DNA(r, r.randint(0, 12)), DNA(r, r.randint(0, 12))
        unit = lambda x, y: 1 if x == y else -1
        a, b, s = align.needleman_wunsch(v, w, p)
        assert s == best_global(v, w, unit, 1) == cost(a, b, p) and (a.replace("-", ""), b.replace("-", "")) == (v, w)
        a, b, s2 = align.hirschberg(v, w, p)
        assert s2 == s and (a.replace("-", ""), b.replace("-", "")) == (v, w)
        spans = lambda x: [x[i:j] for i in range(len(x) + 1) for j in range(i, len(x) + 1)]
        if len(v) < 8 and len(w) < 8:
            a, b, s3 = align.smith_waterman(v, w, p)
            assert s3 == max(best_global(x, y, unit, 1) for x in spans(v) for y in spans(w)) == cost(a, b, p)
            a, b, s4 = align.fitting(v, w, p)
            assert s4 == max(best_global(x, w, unit, 1) for x in spans(v)) and b.replace("-", "") == w


def test_affine_against_paths():
    r, p = random.Random(4), align.Scoring(open=2, extend=0.5)

    def paths(i, j):
        if not i and not j:
            yield ""
        if i and j:
            yield from (x + "d" for x in paths(i - 1, j - 1))
        if i:
            yield from (x + "v" for x in paths(i - 1, j))
        if j:
            yield from (x + "h" for x in paths(i, j - 1))

    for _ in range(12):
        v, w = DNA(r, r.randint(1, 4)), DNA(r, r.randint(1, 4))
        best = -99
        for path in paths(len(v), len(w)):
            if "vh" in path or "hv" in path:
                continue
            i = j = 0
            s = 0.0
            for k, g in itertools.groupby(path):
                n = len(list(g))
                if k == "d":
                    s += sum(1 if v[i + x] == w[j + x] else -1 for x in range(n))
                else:
                    s -= p.open + (n - 1) * p.extend
                i, j = i + n * (k != "h"), j + n * (k != "v")
            best = max(best, s)
        assert align.affine(v, w, p)[2] == best


def test_neighbourhood_size(spark):
    for k, d in ((4, 1), (5, 2), (3, 3)):
        got = spark.range(1).select(kmers.neighbours(F.lit("ACGTA"[:k]), k, d).alias("n")).first()["n"]
        assert len(set(got)) == len(got) == sum(comb(k, i) * 3**i for i in range(d + 1))


def test_reverse_complement_twice_and_skew(spark):
    r = random.Random(5)
    rows = [(i, DNA(r, r.randint(0, 60))) for i in range(30)] + [(99, "")]
    df = spark.createDataFrame(rows, "id int, seq string")
    for x in df.select("id", "seq", kmers.reverse_complement(kmers.reverse_complement(F.col("seq"))).alias("twice"), kmers.skew_minimum(F.col("seq")).alias("at")).collect():
        assert x["twice"] == x["seq"]
        run = np.cumsum([(c == "G") - (c == "C") for c in x["seq"]])
        assert x["at"] == (int(run.argmin()) if len(run) else -1)
    long = DNA(r, 500)
    parts = spark.createDataFrame([(0, i, long[i * 64 : i * 64 + 64]) for i in range(8)], "g int, chunk int, seq string")
    run = np.cumsum([(c == "G") - (c == "C") for c in long])
    assert kmers.skew_minimum_chunked(parts, ["g"]).first()["skew_pos"] == int(run.argmin())


def test_frequent_kmers_against_plain(spark):
    r = random.Random(6)
    text, k, d = DNA(r, 80), 4, 1
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) <= d
    own = [text[i : i + k] for i in range(len(text) - k + 1)]
    n = {x: own.count(x) for x in own}
    total, done = {}, set()
    for u in dict.fromkeys(own):
        if u in done:
            continue
        around = [x for x in map("".join, itertools.product("ACGT", repeat=k)) if near(x, u)]
        total[u] = sum(sum(n.get(y, 0) for y in {x, rc(x)}) for x in around)
        done |= set(around) | {rc(x) for x in around}
    want = {u: t for u, t in total.items() if t == max(total.values())}
    got = kmers.frequent_kmers(spark.createDataFrame([(1, text)], "g int, seq string"), k, d, ["g"])
    assert {r["kmer"]: r["total"] for r in got.collect()} == want


def test_euler_and_contigs(spark):
    r = random.Random(7)
    genome = DNA(r, 400)
    df = spark.createDataFrame([(1, genome)], "g int, seq string")
    got = assembly.euler_genome(kmers.kmers(df, 12), ["g"]).first()
    assert got["status"] == "complete" and sorted(got["genome"][i : i + 12] for i in range(389)) == sorted(genome[i : i + 12] for i in range(389))
    got = assembly.paired_genome(kmers.read_pairs(df, 12, 20), ["g"], 12, 20).first()
    assert (got["genome"], got["status"]) == (genome, "complete")
    assert [x["contig"] for x in assembly.contigs(kmers.kmers(df, 14), ["g"]).collect()] == [genome]
    rows = [(1, x) for x in ("AAT", "ATG", "ATG", "TGA", "GAC", "CCA", "CAG", "AGC", "GCC")]
    got = sorted(x["contig"] for x in assembly.contigs(spark.createDataFrame(rows, "g int, kmer string"), ["g"]).collect())
    assert got == sorted(["AAT", "ATG", "ATG", "TGAC", "AGCCAG"])


def test_patterns_against_plain(spark):
    r = random.Random(8)
    for _ in range(20):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 30)))
        order = patterns.suffix_order(t).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        assert patterns.bwt(t) == "".join(x[-1] for x in sorted(t[i:] + t[:i] for i in range(len(t))))
        assert patterns.inverse_bwt(patterns.bwt(t + "$")) == t + "$"
        assert patterns.suffix_array_find(t, np.array(order), "ab") == [i + 1 for i in range(len(t)) if t.startswith("ab", i)]
        both = {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        twice = [s for s in both if t.find(s) != t.rfind(s)]
        assert len(patterns.longest_repeat(t)) == max(map(len, twice), default=0)
    text = spark.createDataFrame([(i, c) for i, c in enumerate("banana$banana")], "pos int, ch string")
    got = [x["pos"] for x in patterns.suffix_array_distributed(text).orderBy("rank").collect()]
    assert got == sorted(range(13), key=lambda i: "banana$banana"[i:])


def test_approximate_matches_against_plain(spark):
    r = random.Random(9)
    texts, pats = [(i, DNA(r, 60)) for i in range(5)], [DNA(r, 6) for _ in range(8)]
    got = patterns.approximate_matches(spark.createDataFrame(texts, "id int, seq string"), spark.createDataFrame([(p,) for p in pats], "pattern string"), 6, 2, ["id"])
    want = {(i, p, x) for i, t in texts for p in pats for x in range(55) if sum(a != b for a, b in zip(p, t[x : x + 6])) <= 2}
    assert {tuple(x) for x in got.collect()} == want


def test_components(spark):
    r = random.Random(10)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = components(spark.createDataFrame(edges, "src int, dst int"))
    assert {x["node"]: x["component"] for x in got.collect()} == top


def test_breakpoint_sort_ends_sorted_or_stuck():
    r = random.Random(11)
    for _ in range(30):
        p = [x * r.choice((1, -1)) for x in r.sample(range(1, 8), 7)]
        n, steps = rearrange.sort_by_breakpoints(p)
        assert n == len(steps)
        last = steps[-1] if steps else p
        assert last == list(range(1, 8)) or not any(
            sum(b - a != 1 for a, b in itertools.pairwise([0, *q, 8])) < sum(b - a != 1 for a, b in itertools.pairwise([0, *last, 8]))
            for i in range(7)
            for j in range(i, 7)
            for q in [last[:i] + [-x for x in reversed(last[i : j + 1])] + last[j + 1 :]]
        )


def test_parsimony_against_all_labels():
    tree = {"r": ["u", "v"], "u": ["a", "b"], "v": ["c", "d"]}
    seqs = {"a": "ACG", "b": "ATG", "c": "CTG", "d": "CTA"}
    score, labels = phylo.parsimony(tree, "r", seqs)
    want = 0
    for col in range(3):
        want += min(sum(lab[p] != lab.get(c, seqs.get(c, "   ")[col]) for p, cs in tree.items() for c in cs) for lab in ({"r": x, "u": y, "v": z} for x, y, z in itertools.product("ACGT", repeat=3)))
    assert score == want == sum(x != y for p, cs in tree.items() for c in cs for x, y in zip(labels[p], labels[c]))
    assert len(phylo.nni(tree)) == 4


def test_multiple_alignment_keeps_sequences():
    rows, score = align.multiple(["ACGT", "AGT", "ACT"])
    assert [x.replace("-", "") for x in rows] == ["ACGT", "AGT", "ACT"] and len(set(map(len, rows))) == 1
    assert align.multiple(["ACGT", "AGT"])[1] == align.needleman_wunsch("ACGT", "AGT", align.Scoring())[2]


def test_hmm(spark):
    m = hmm.Model(["A", "B"], np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]), "ACGT")
    x = "ACGTTGCA"
    prob = lambda path: 0.5 * m.emission[path[0], "ACGT".index(x[0])] * np.prod([m.transition[a, b] * m.emission[b, "ACGT".index(c)] for a, b, c in zip(path, path[1:], x[1:])])
    paths = list(itertools.product((0, 1), repeat=len(x)))
    assert abs(hmm.forward(x, m) - np.log(sum(map(prob, paths)))) < 1e-9
    assert tuple(hmm.viterbi(x, m).tolist()) == max(paths, key=prob)
    total = sum(map(prob, paths))
    T = np.zeros((2, 2))
    for p in paths:
        for a, b in zip(p, p[1:]):
            T[a, b] += prob(p) / total
    assert np.allclose(hmm.expected_counts(x, m)[0], T)
    like = [hmm.forward(x, m)]
    for _ in range(4):
        m = hmm.train_one(x, m, 1)
        like.append(hmm.forward(x, m))
    assert all(b >= a - 1e-9 for a, b in zip(like, like[1:]))
    one = hmm.Model(["A", "B"], np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]), "ACGT")
    df = spark.createDataFrame([(0, x)], "ordinal int, seq string")
    assert np.allclose(hmm.train(df, one, 2).transition, hmm.train_one(x, one, 2).transition)
    profile = hmm.build_profile(["AC-GT", "ACAGT", "A--GT"], alphabet="ACGT")
    assert np.allclose(profile.transition[:-1].sum(1), 1, atol=0.01) and hmm.profile_path("ACGT", profile)[0] == ["M1", "M2", "M3", "M4"]


def test_random_motif_searches_are_seeded(spark):
    r = random.Random(12)
    df = spark.createDataFrame([(0, i, DNA(r, 60)) for i in range(5)], "g int, ordinal int, seq string")
    for method in ("randomized", "gibbs"):
        a, b = (motifs.search(df, 8, ["g"], method, seeds=3).first() for _ in range(2))
        assert a == b and len(a["motifs"]) == 5 and a["score"] == motifs._score(np.array([motifs._codes(m) for m in a["motifs"]]))


def test_spectra(spark):
    df = spark.createDataFrame([(0, "NQEL"), (1, "G")], "id int, pep string")
    for x, pep in ((0, "NQEL"), (1, "G")):
        own = [spectra.DECI[a] for a in pep]
        rows = lambda d: sorted(v["mass"] for v in d.where(F.col("id") == x).collect())
        assert rows(spectra.cyclic_spectrum(df)) == spectra._cyclic(own)
        assert rows(spectra.linear_spectrum(df, masses=spectra.DECI)) == spectra._linear(own)
    assert spectra.cyclic_spectrum(df.where("id = 0"), drop_share=0.1, seed=1).count() == 14 - 1


def test_fasta_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text("lead\n>one\nAC GT\nac\n>two\n>three\n\n>four\nTT\n")
    path = str(tmp_path / "a.fa")
    assert fasta.single_fasta(spark, path).first()["seq"] == "leadAC GTacTT"
    got = [(x["header"], x["seq"]) for x in fasta.multi_fasta(spark, path).orderBy("ordinal").collect()]
    assert got == [(None, "lead"), ("one", "AC GTac"), ("three", ""), ("four", "TT")]
    got = [x["seq"] for x in fasta.multi_fasta(spark, path, normalise=True).orderBy("ordinal").collect()]
    assert got == ["LEAD", "ACGTAC", "TT"]
    (tmp_path / "m.txt").write_text("[(1, 2.5),\n [3, 4],]")
    assert [x["features"] for x in fasta.matrix(spark, str(tmp_path / "m.txt")).orderBy("point_id").collect()] == [[1.0, 2.5], [3.0, 4.0]]
    (tmp_path / "s.txt").write_text(">s1\n[0, 57]\n\n>s2\n [0, 71, 71]\n")
    assert sorted((x["spec_id"], x["mass"]) for x in fasta.spectra(spark, str(tmp_path / "s.txt")).collect()) == [(0, 0), (0, 57), (1, 0), (1, 71), (1, 71)]
    (tmp_path / "r.txt").write_text("ACG TTT\n\nGGG  AAA ")
    assert sorted(x["read"] for x in fasta.reads(spark, str(tmp_path / "r.txt")).collect()) == ["AAA", "ACG", "GGG", "TTT"]
    assert spark.range(1).select(fasta.parse_spectrum(F.lit(" 1.5 2 ")).alias("s")).first()["s"] == [1.5, 2.0]


@pytest.mark.parametrize("method", ["greedy", "randomized", "gibbs"])
def test_motif_search_leaves_out_only_short_sequences(spark, method):
    rows = [(1, i, s) for i, s in enumerate(["AC", "GGCGTTCAGGCA", None, "AAGAATCAGTCA", "CAAGGAGTTCGC", "CACGTCAATCAC"])] + [(2, 0, "AC"), (2, 1, None)]
    short = spark.createDataFrame(rows, "g int, ordinal int, seq string")
    long = short.where("length(seq) >= 3 and g = 1")
    got, want = ([tuple(r) for r in motifs.search(x, 3, ["g"], method).collect()] for x in (short, long))
    assert got == want and len(got) == 1 and len(got[0][2]) == 4
