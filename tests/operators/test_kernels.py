"""Kernels against plain versions, with empty, null and odd input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import align, assembly, hmm, kmers, motifs, patterns, phylo, rearrange
from helixframe.operators.pairs import all_pairs

ODD = ["", None, "A", "ACGTNACGTTACG", "acgtACGT", "ACGé日TACGTT", "ACGT" * 40, "N" * 30, "AAAA\nAAAC"]


def sequences(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, seq string")


@pytest.mark.parametrize("k, chunk", [(1, 1 << 20), (4, 7), (11, 1 << 20), (14, 5), (31, 64)])
def test_kmer_totals(spark, k, chunk):
    r = random.Random(k)
    rows = ODD + ["".join(r.choice("ACGT") for _ in range(r.randrange(0, 90))) for _ in range(30)]
    got = {x["kmer"]: x["n"] for x in kmers.kmer_totals(sequences(spark, rows), k, chunk=chunk).collect()}
    assert got == Counter(t[i : i + k] for t in rows if t for i in range(len(t) - k + 1))
    per_row = kmers.kmers(sequences(spark, rows), k).groupBy("kmer").count().collect()
    assert got == {x["kmer"]: x["count"] for x in per_row}


def plain_skew(text):
    run, low, at = 0, None, -1
    for i, c in enumerate(text or ""):
        run += (c == "G") - (c == "C")
        if low is None or run < low:
            low, at = run, i
    return at


def test_skew_in_one_row_and_in_chunks(spark):
    r = random.Random(1)
    rows = [*ODD, "C" * 50, "G" * 50, *("".join(r.choice("ACGT") for _ in range(r.randrange(1, 300))) for _ in range(20))]
    got = sequences(spark, rows).select("id", kmers.skew_minimum(F.col("seq")).alias("at")).collect()
    assert {x["id"]: x["at"] for x in got} == {i: plain_skew(t) for i, t in enumerate(rows)}
    assert kmers._skew_minimum("ACGGC" * 100, chunk=7) == plain_skew("ACGGC" * 100)
    cut = [(i, n, t[a : a + 17]) for i, t in enumerate(rows) if t for n, a in enumerate(range(0, len(t), 17))]
    parts = spark.createDataFrame([*cut, (0, 0, ""), (1, 0, None)], "id long, chunk int, seq string").repartition(4)
    assert {x["id"]: x["skew_pos"] for x in kmers.skew_minimum_chunked(parts, ["id"]).collect()} == {i: plain_skew(t) for i, t in enumerate(rows) if t}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_matches_sent_and_joined(spark, monkeypatch, limit):
    """Patterns give the same hits whether they are sent to executors or joined."""
    monkeypatch.setattr(patterns, "PATTERNS", limit)
    r = random.Random(2)
    texts = ["".join(r.choice("ACé") for _ in range(r.randrange(0, 60))) for _ in range(25)]
    words = ["AC", "CAA", "éC", "AAAA", "CCé", "xyz", "CACAC", "AéAéA"]
    df, p = sequences(spark, texts), spark.createDataFrame([(w,) for w in words], "pattern string")
    got = patterns.exact_matches(df, p, ["id"], [2, 3, 5], keep_zero=True).collect()
    want = [(i, w, a) for i, t in enumerate(texts) for w in words if len(w) != 4 for a in range(len(t)) if t.startswith(w, a)]
    hit = {w for _, w, _ in want}
    assert Counter((x["id"], x["pattern"], x["pos"]) for x in got) == Counter(want + [(None, w, None) for w in words if w not in hit])
    near = patterns.approximate_matches(df, p, 5, 2, ["id"]).collect()
    assert sorted((x["id"], x["pattern"], x["pos"]) for x in near) == sorted((i, w, a) for i, t in enumerate(texts) for w in words if len(w) == 5 for a in range(len(t) - 4) if sum(x != y for x, y in zip(t[a : a + 5], w)) <= 2)


def test_transform_of_periodic_texts():
    for t in ("", "a", "aaaa", "abab", "abaaba", "mississippi$", "ab" * 9 + "a", "cabcab"):
        rotations = sorted(range(len(t)), key=lambda i: (t[i:] + t[:i], i))
        assert patterns.bwt(t) == "".join(t[i - 1] for i in rotations)


def test_all_pairs_once(spark):
    a, b = spark.range(37).withColumnRenamed("id", "x"), spark.range(11).withColumnRenamed("id", "y")
    got = [(r["x"], r["y"]) for r in all_pairs(a, b, "x", "y", 4).collect()]
    assert sorted(got) == [(x, y) for x in range(37) for y in range(11)]


def test_two_breaks_in_batches_and_at_large(spark):
    r = random.Random(3)
    rows = []
    for g in range(30):
        n = r.randrange(1, 9)
        for genome in "PQ":
            blocks = [x * r.choice((1, -1)) for x in r.sample(range(1, n + 1), n)]
            rows += [(g, genome, i % r.randrange(1, 4), i, x) for i, x in enumerate(blocks)]
    df = spark.createDataFrame(rows, "g long, genome string, chrom int, ord int, block int").repartition(5)
    small = {x["g"]: x["distance"] for x in rearrange.two_break_distance(df, ["g"]).collect()}
    assert small == {x["g"]: x["distance"] for x in rearrange.two_break_distance_large(df, ["g"]).collect()}
    steps = rearrange.two_break_scenarios(df, ["g"]).groupBy("g").agg(F.max("step").alias("n")).collect()
    assert small == {x["g"]: x["n"] for x in steps}


MODEL = hmm.Model(["A", "B"], np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]), "ACGT")


def test_models_on_odd_sequences(spark):
    df = sequences(spark, ["", None, "ACNT", "NNN", "ACGT"])
    got = {x["id"]: x for x in hmm.decode(hmm.likelihoods(df, MODEL), MODEL, "plain").collect()}
    assert (got[0]["log_likelihood"], got[0]["path"]) == (0.0, "") and (got[1]["log_likelihood"], got[1]["path"]) == (None, None)
    assert got[2]["log_likelihood"] < got[4]["log_likelihood"] - 20 and len(got[3]["path"].split()) == 3
    profile = hmm.build_profile(["ACGT", "AC-T", "ACGT"])
    assert hmm.decode(df, profile).where("id = 1").first()["path"] is None and all(x["path"] for x in hmm.decode(df, profile).where("id > 1").collect())
    counts = {(x["id"], x["src"], x["dst"]): x["n"] for x in hmm.expected(df, MODEL, "id").collect()}
    assert sum(counts[0, i, j] + counts[1, i, j] for i in (0, 1) for j in (0, 1)) == 0 and abs(sum(counts[4, i, j] for i in (0, 1) for j in (0, 1)) - 3) < 1e-9
    trained = [hmm.train(df, MODEL, 2, hard) for hard in (False, True)]
    assert all(np.isfinite(m.transition).all() and np.isfinite(m.emission).all() for m in trained)
    assert hmm.most_divergent(df, MODEL, 1, order="id").first()["id"] in (2, 3)


def test_profile_models_equal_the_kernel(spark):
    groups = {0: ["ACGT", "A-GT", "AC-T", "--GT"], 1: ["AAC", "A-C", "-AC", "-GC", "T--"]}
    df = spark.createDataFrame([(g, i, s) for g, rows in groups.items() for i, s in enumerate(rows)], "g long, ordinal long, seq string")
    got = {(x["g"], x["kind"], x["src"], x["to"]): x["p"] for x in hmm.profile_model(df, ["g"]).collect()}
    for g, rows in groups.items():
        m = hmm.build_profile(rows, decimals=None)
        want = {(g, k, i, j): a[i, j] for k, a in (("T", m.transition), ("E", m.emission)) for i in range(len(a)) for j in range(a.shape[1]) if a[i, j] > 0}
        own = {k: p for k, p in got.items() if k[0] == g}
        assert own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("method", ["greedy", "randomized", "gibbs"])
def test_motifs_leave_other_letters_out(spark, method):
    rows = [(0, i, s) for i, s in enumerate(["ACGTACNNACGTAA", "TTACGTAN", "NNNNNNN", "CCACGTACC", None, "AC"])] + [(1, 0, "NNNNNNNN")]
    df = spark.createDataFrame(rows, "g long, ordinal long, seq string")
    found = motifs.search(df, 5, ["g"], method, seeds=4).collect()
    assert [x["g"] for x in found] == [0] and all(set(m) <= set("ACGT") and len(m) == 5 for m in found[0]["motifs"]) and len(found[0]["motifs"]) == 3


def test_matrices_and_empty_paths(spark):
    assert len(align.PAM250) == 400 and align.PAM250["WR"] == align.PAM250["RW"] == 2 and align.PAM250["WW"] == 17
    assert align.parse_matrix("# x\n  A R\nA 2 -2\nR -2 6") == {"AA": 2.0, "AR": -2.0, "RA": -2.0, "RR": 6.0}
    empty = spark.createDataFrame([([],), (["ACG", "CGT"],)], "nodes array<string>").select(assembly.path_to_genome(F.col("nodes")).alias("g"))
    assert [x["g"] for x in empty.collect()] == ["", "ACGT"]
    tree = spark.createDataFrame([("r", "a", 0, 1.0), ("r", "b", 1, 0.5), ("b", "c", 0, 2.0)], "parent string, child string, child_ord int, length double").withColumn("g", F.lit(1))
    assert phylo.tree_text(tree, ["g"]).first()["text"] == "r\n  |-- a (len=1.0000)\n    a\n  |-- b (len=0.5000)\n    b\n      |-- c (len=2.0000)\n        c"


def test_trim_of_a_whole_table(spark):
    from helixframe.operators import spectra

    df = spark.createDataFrame([(i, s) for i, s in enumerate([5, 9, 7, 7, 3, 7, 9])], "id long, score int")
    assert sorted(x["id"] for x in spectra.trim(df, 3).collect()) == [1, 2, 3, 5, 6]
    assert sorted(x["id"] for x in spectra.trim(df, 99).collect()) == list(range(7)) and spectra.trim(df.limit(0), 2).count() == 0


def test_automaton_against_search():
    from helixframe.operators import automaton

    r = random.Random(6)
    for _ in range(60):
        letters = r.choice(["ab", "ACGT", "aé日"])
        word = lambda n: "".join(r.choice(letters) for _ in range(n))
        words = sorted({word(r.randint(1, 9)) for _ in range(r.randint(0, 40))} | {word(40)})
        texts = [word(r.choice([0, 1, 5, 60])) + r.choice(["", "x", "ab"]) for _ in range(8)] + [words[0] * 3]
        row, p, place = automaton.Automaton(words).find(texts)
        got = [(i, words[k], a) for i, k, a in zip(row.tolist(), p.tolist(), place.tolist())]
        assert sorted(got) == sorted((i, w, a) for i, t in enumerate(texts) for w in words for a in range(len(t)) if t.startswith(w, a))


def test_automaton_across_rows(monkeypatch):
    from helixframe.operators import automaton

    monkeypatch.setattr(automaton, "CHUNK", 16)
    monkeypatch.setattr(automaton, "ROWS", 3)
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in (0, 15, 16, 17, 100, 333)]
    words = ["a", "ab", "bba", texts[5][10:60], texts[4][:33]]
    row, p, place = automaton.Automaton(words).find(texts)
    assert list(zip(row.tolist(), p.tolist(), place.tolist())) == sorted(((i, k, a) for i, t in enumerate(texts) for k, w in enumerate(words) for a in range(len(t)) if t.startswith(w, a)), key=lambda x: (x[0], x[2], x[1]))
    assert [len(x) for x in automaton.Automaton([]).find(texts)] == [0, 0, 0]


def test_matches_of_any_lengths(spark):
    df = sequences(spark, ODD)
    p = spark.createDataFrame([("A",), ("ACGT",), ("é",), ("",), (None,), ("AAAA\nAAAC",), ("ACGT" * 30,)], "pattern string")
    got = {(x["id"], x["pattern"], x["pos"]) for x in patterns.exact_matches(df, p, ["id"]).collect()}
    assert got == {(i, w, a) for i, t in enumerate(ODD) if t for w in ("A", "ACGT", "é", "AAAA\nAAAC", "ACGT" * 30) for a in range(len(t)) if t.startswith(w, a)}


def some_texts(r):
    letters = r.choice(["ab", "ACGT", "aé日🙂", "a"])
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 9, 40]))) for _ in range(r.randint(1, 5))]
    return texts + r.choice([[], texts[:1], [texts[0] * 3], ["a" * 150], ["ab" * 70]])


def test_suffixes_of_many_texts():
    from helixframe.operators import index

    r = random.Random(12)
    for _ in range(80):
        texts = some_texts(r)
        s = index.Suffixes(texts)
        whole = [(t[i:], n, 0, int(s.starts[n]) + i) for n, t in enumerate(texts) for i in range(len(t) + 1)]
        whole = sorted(whole, key=lambda w: ([ord(c) for c in w[0]], w[1]))
        assert s.order.tolist() == [w[3] for w in whole]
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert s.common().tolist() == [0, *(same(a[0], b[0]) for a, b in zip(whole, whole[1:]))]


def test_backward_search_against_find():
    from helixframe.operators import index

    r = random.Random(13)
    for _ in range(60):
        texts = some_texts(r)
        words = ["a", "ab", "xyz", "ACG", texts[-1][:20] or "q", "日", "", "ba" * 9]
        fm = index.FMIndex.build(texts)
        lo, hi = fm.search(words)
        for w, x, y in zip(words, lo.tolist(), hi.tolist()):
            text, place = fm.locate(np.arange(x, y))
            assert sorted(zip(text.tolist(), place.tolist())) == [(n, i) for n, t in enumerate(texts) for i in range(len(t)) if w and t.startswith(w, i)]


@pytest.mark.parametrize("block, at_once", [(0, 100), (50, 2), (1 << 20, 3)])
def test_index_of_a_table(spark, block, at_once):
    from helixframe.operators import index

    df = sequences(spark, ODD).repartition(2)
    p = spark.createDataFrame([("A",), ("ACGT",), ("CGTA",), ("",), (None,), ("日",), ("zz",)], "pattern string")
    got = index.fm_search(index.fm_index(df, ["id"], block=block), p, at_once=at_once, hits=3).collect()
    assert sorted((x["id"], x["pattern"], x["pos"]) for x in got) == sorted((i, w, a) for i, t in enumerate(ODD) if t for w in ("A", "ACGT", "CGTA", "日") for a in range(len(t)) if t.startswith(w, a))


def plain_tree(texts):
    """Inner nodes: strings that go on in more than one way, ends of texts being ways of their own; and the deepest of them above each suffix."""
    ways, below = {}, {}
    for n, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i, len(t) + 1):
                ways.setdefault(t[i:j], set()).add(t[j] if j < len(t) else n)
                below.setdefault(t[i:j], []).append(n)
    inner = {s for s, w in ways.items() if len(w) > 1} | {""}
    above = lambda s, proper: max((len(p) for p in inner if s.startswith(p) and (not proper or p != s)), default=0)
    rows = [(False, s, above(s, True), len(below.get(s, [])), min(below.get(s, [0])), max(below.get(s, [0]))) for s in inner]
    return sorted(rows + [(True, t[i:], above(t[i:], False), 1, n, n) for n, t in enumerate(texts) for i in range(len(t))])


def test_suffix_tree_against_all_substrings(spark):
    from helixframe.operators import index

    r = random.Random(14)
    for _ in range(60):
        texts = [t[:30] for t in some_texts(r)]
        tree = index.Tree(texts)
        rows = []
        for v in range(len(tree.depth)):
            a, n = int(tree.start[v]), int(tree.depth[v])
            up = int(tree.depth[tree.parent[v]]) if v else 0
            rows.append((v >= tree.inner, texts[int(tree.text[v])][a : a + n], up, int(tree.leaves[v]), int(tree.least[v]), int(tree.most[v])))
        assert sorted(rows) == plain_tree(texts)
    df = spark.createDataFrame([("x", 1, "banana"), ("x", 2, "ananas"), ("y", 1, ""), ("y", 2, None), ("z", 7, "aaa")], "g string, source int, seq string")
    got = index.suffix_tree(df, ["g"], labels=True).collect()
    assert {(x["label"], x["leaves"]) for x in got if x["g"] == "x" and not x["leaf"]} == {("", 12), ("a", 6), ("ana", 4), ("anana", 2), ("na", 4), ("nana", 2)}
    assert [(x["node"], x["depth"], x["leaves"]) for x in got if x["g"] == "y"] == [(0, 0, 0)]
    assert {x["source_min"] for x in got if x["g"] == "z"} == {7}


def test_shared_and_unshared_against_all_substrings():
    r = random.Random(15)
    for _ in range(150):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(0, 14))) for _ in range(2))
        subs = lambda t: {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        assert len(patterns.longest_shared(a, b)) == max(map(len, subs(a) & subs(b)), default=0) and patterns.longest_shared(a, b) in b
        own = sorted(subs(a) - subs(b), key=lambda s: (len(s), a.find(s)))
        assert patterns.shortest_unshared(a, b) == (own[0] if own else None)


def test_training_in_batches():
    r = random.Random(31)
    texts = ["", "A", "N"] + ["".join(r.choice("ACGTN") for _ in range(r.randrange(1, 40))) for _ in range(30)]
    for cells in (1 << 21, 60):
        for part, o, size in hmm._batches(texts, MODEL, cells):
            T, E = hmm.batch_counts(o, size, *(x[None] for x in hmm.logs(MODEL)))
            for k, i in enumerate(part.tolist()):
                t, e = hmm.expected_counts(texts[i], MODEL)
                assert np.allclose(T[k], t) and np.allclose(E[k], e)
    want = [hmm.forward(x, hmm.train_one(x, MODEL, 3)) for x in texts]
    assert np.allclose(hmm.own_likelihoods(texts, MODEL, 3), want)


def test_kernels_are_run_once(spark):
    from helixframe.operators import motifs

    df = spark.createDataFrame([("g", 1, "ACGTACGT"), ("g", 2, "ACGTTT"), ("h", 1, None)], "g string, ordinal int, seq string")
    for found in (motifs.search(df, 3, ["g"]), motifs.search(df, 3, ["g"], "gibbs"), hmm.most_divergent(df, MODEL, 1)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and found.count() == 1
