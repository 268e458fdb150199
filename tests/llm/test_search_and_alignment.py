import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import alignment, neighbours

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# --- alignment of tokens


def whole_tokens(text, libraries):
    """(bytes, id) lists of both, from the libraries over the whole text."""
    a, b = libraries
    byte_of = {c: i for i, c in enumerate(alignment.byte_letters())}
    first = a.encode(" " + text, add_special_tokens=False).ids
    second = b.encode(text)
    one = [(bytes(byte_of[c] for c in a.id_to_token(i)), i) for i in first]
    two = [(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode(), i) for i in second]
    return one, two


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_alignment(rows, libraries):
    """(doc_id, text) rows -> doc_id and the other columns, by comparing every token with every one."""
    found, counts = [], Counter()
    for i, text in rows:
        one, two = whole_tokens(text, libraries) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(x for x, _ in one) != raw or b"".join(x for x, _ in two) != raw:
            one, two = [], []
        spans = []
        for tokens in (one, two):
            at, own = 0, []
            for x, k in tokens:
                own.append((at, at + len(x), k))
                at += len(x)
            spans.append(own)
        links = [(p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
        groups = [tuple([s[2] for s in own if a < s[1] <= z] for own in spans) for a, z in zip([0, *cuts], cuts)]
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        counts.update(links)
        found.append((i, len(one), len(two), len(cuts), links, hashlib.sha256(text_of.encode()).hexdigest() if one else ""))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    return [(i, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha) for i, a, b, g, x, sha in found]


def texts(seed, n):
    r = random.Random(seed)
    bits = ["the", "ing", "é", "naïve", "日本", "🙂", "x" * 30, "!!", ".", ",", "'s", "don't", "1234", "0", " ", "  ", "   ", "\n", "\n\n", "\t", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "᠎", "▁", "　", "​", "<s>", "<|endoftext|>", "<unk>", "<0x0A>", ";", "}", "{", "word", "Token", "ßtraße", "\x00", "́"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 25)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "   "), (n + 4, "\n"), (n + 5, "a"), (n + 5, "a"), (n + 6, "foo "), (n + 7, "foo\n"), (n + 8, "▁"), (None, "foo bar"), (n + 9, "word " * 3000)]


def test_segments_are_tokenised_as_whole_texts_are(libraries):
    both = alignment.Both(A, B)
    assert set(both.safe) >= set(" \n\t") and "\r" not in both.safe
    for _, t in texts(5, 3000):
        if not t:
            continue
        s = both.cut.findall(" " + t)
        assert "".join(s) == " " + t
        got = both.align(s)
        one, two = whole_tokens(t, libraries)
        if None in got:
            assert b"".join(x for x, _ in two) != (" " + t).encode()
            continue
        groups = ";".join(g[3] for g in got).replace(";", ",")
        assert [int(x) for g in ";".join(g[3] for g in got).split(";") for x in g.split("|")[0].split(",")] == [k for _, k in one], repr(t)
        assert [int(x) for g in ";".join(g[3] for g in got).split(";") for x in g.split("|")[1].split(",")] == [k for _, k in two], repr(t)
        assert groups


@pytest.mark.parametrize("block, pairs", [(1 << 20, 10_000), (200, 0)])
def test_alignment_against_every_pair(spark, libraries, block, pairs):
    rows = [r for r in texts(11, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align(docs, A, B, block_chars=block, pairs=pairs).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_alignment(rows, libraries), key=key)
    assert got[0].asDict().keys() == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


def test_alignment_of_long_and_common_texts(spark, libraries):
    word = "".join(random.Random(3).choice("abcdefgh") for _ in range(200_000))
    rows = [(0, word)] + [(i, "the same words, once more and again") for i in range(1, 400)] + [(400, "spoilt ▁ text and the same words")]
    got = {r["doc_id"]: r for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), A, B).collect()}
    one, two = whole_tokens(word, libraries)
    assert (got[0]["n_a"], got[0]["n_b"]) == (len(one), len(two))
    assert {got[i]["count_sum"] for i in range(1, 400)} == {got[1]["n_links"] * 399}  # every link once in each text, none in the spoilt one
    assert (got[400]["n_a"], got[400]["n_links"], got[400]["groups_sha256"]) == (0, 0, "")


def test_other_tokenizers_take_whole_texts():
    both = alignment.Both(P.path("word_bpe_49k.json"), B)  # one that changes texts
    assert both.safe == "" and both.cut.findall(" a b\nc") == [" a b\nc"]


# --- nearest neighbours


def brute_neighbours(rows, k, asks):
    out = []
    for q, x in rows:
        if q is not None and asks(q) and x is not None:
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i is not None and i != q and y is not None and len(y) == len(x))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def rounded(x):
    return [float(v) for v in np.float32(x)]


def test_neighbours_equal_brute_force_on_few_rows(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(300)]  # many ties and equal vectors
    rows = [(i, x) for i, x in rows if any(x)]
    odd = [(None, [1.0, 1.0, 1.0, 1.0]), (1000, None), (1020, []), (1040, [0.0] * 4), (1060, [1.0, None, 0.0, 0.0]), (1080, [float("nan"), 1.0, 1.0, 1.0]), (1100, [float("-inf"), 0.0, 0.0, 0.0])]
    others = [(2000, [1.0, 2.0]), (2001, [3.0, 1.0]), (2020, [5.0])]  # of other lengths
    got = neighbours.nearest(vectors(spark, rows + odd + others).repartition(3), 20, F.col("vec_id") % 20 == 0, shards=3).collect()
    assert sorted(map(tuple, got)) == brute_neighbours(rows + others, 20, lambda q: q % 20 == 0)
    assert got[0].asDict().keys() == {"query_id", "rank", "vec_id", "score"}


def test_neighbours_of_equal_vectors_and_shared_ids(spark):
    same = [(i, [1.0, 0.5]) for i in range(2000)] + [(5000, [2.0, 2.0]), (5000, [0.5, -4.0]), (5001, [0.0, -1.0])]
    got = neighbours.nearest(vectors(spark, same), 3, F.col("vec_id").isin(0, 1999, 5000), shards=2).collect()
    by = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 1999, 5000)}
    assert by[0] == [(5000, 3.0), (1, 1.25), (2, 1.25)] and by[1999] == [(5000, 3.0), (0, 1.25), (1, 1.25)]
    assert by[5000] == [(5001, 4.0), (0, 3.0), (1, 3.0)]  # the best over both its vectors


def test_neighbours_of_few_and_extreme_vectors(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e-30, -1.0]), (2, [3e38, 3e38])]
    rows = [(i, rounded(x)) for i, x in rows]
    got = neighbours.nearest(vectors(spark, rows), 20, F.col("vec_id") >= 0).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(0, 2), (0, 1), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert neighbours.nearest(vectors(spark, rows[:1]), 20, F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("kind", ["spread", "clusters", "lengths"])
def test_neighbours_recall(spark, kind):
    g = np.random.default_rng(4)
    x = g.normal(size=(4000, 24))
    if kind == "clusters":  # a third of the rows nearly alike
        x[:1300] = x[0] + 0.01 * g.normal(size=(1300, 24))
        x[1300:1900] = 3 * x[1300]
        x[1300:1900, 0] += np.arange(600) * 1e-3
    if kind == "lengths":
        x *= g.lognormal(size=(4000, 1))
    rows = [(i, rounded(v)) for i, v in enumerate(x)]
    got = neighbours.nearest(vectors(spark, rows).repartition(4), 20, F.col("vec_id") % 20 == 0, shards=3).collect()
    y = np.array([v for _, v in rows])
    hits = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(by) == 200 and all([n for n, _, _ in sorted(v)] == list(range(1, 21)) for v in by.values())
    for q, v in by.items():
        s = y @ y[q]
        s[q] = -np.inf
        hits += len({i for _, i, _ in v} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        v.sort()
        assert [(-c, i) for _, i, c in v] == sorted((-c, i) for _, i, c in v)
        assert np.allclose([c for _, _, c in v], [s[i] for _, i, _ in v], rtol=1e-12)
    assert hits / 4000 >= 0.95


def test_every_node_can_be_reached_and_edges_are_few():
    g = np.random.default_rng(5)
    y = g.normal(size=(900, 8))
    y /= np.sqrt((y**2).sum(1, keepdims=True))
    y[:400] = y[:1] + 1e-6 * g.normal(size=(400, 8))
    graph = neighbours.Graph(y, degree=12, beam=40)
    assert (graph.edges != np.arange(900)[:, None]).all()
    for e in graph.edges:
        e = e[e >= 0]
        assert len(set(e.tolist())) == len(e)
    found, _ = graph.search(y[:50], 900)
    assert (np.sort(found, axis=1) == np.arange(900)).all()
