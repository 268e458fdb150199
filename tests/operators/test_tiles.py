"""Tiled scores against the kernels that hold a pair's whole table."""

import random

import pytest

from helixframe.operators import align, tiles


@pytest.mark.parametrize("kind, p, size", [("affine", align.Scoring(), 16), ("affine", align.Scoring(mismatch=3.0, open=2.0, extend=0.25), 7), ("global", align.Scoring(mismatch=3.0), 16), ("global", align.Scoring(matrix=align.PAM250, gap=5.0), 9)])
def test_equal_to_whole_tables(spark, kind, p, size):
    r = random.Random(size)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    sizes = [(0, 0), (0, 20), (33, 0), (1, 1), (16, 16), (7, 9), (40, 3), (35, 50)]
    data = [(k, "x" if k % 2 else None, text(n), text(m)) for k, (n, m) in enumerate(sizes)] + [(99, "x", None, "A"), (98, None, "A", None)]
    got = tiles.tiled_scores(spark.createDataFrame(data, "k long, g string, v string, w string"), ["k", "g"], kind, scoring=p, size=size).collect()
    want = {(k, g): align.KERNELS[kind](v, w, p)[2] for k, g, v, w in data if v is not None and w is not None}
    assert {(x.k, x.g): round(x.score, 9) for x in got} == {k: round(x, 9) for k, x in want.items()} and len(got) == len(want)


def test_a_long_pair(spark):
    r = random.Random(1)
    v = "".join(r.choice("ACGT") for _ in range(20_000))
    w = "".join(c for c in v if r.random() < 0.9)[:17_000] + "ACGT" * 700
    df = spark.createDataFrame([(1, v, w)], "k int, v string, w string")
    got = tiles.tiled_scores(df, ["k"], "global", size=5000).first()["score"]
    assert got == align.hirschberg(v, w, align.Scoring())[2]


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "k int, v string, w string")
    assert tiles.tiled_scores(df, ["k"]).count() == 0
    with pytest.raises(ValueError):
        tiles.tiled_scores(df, ["k"], "local")
