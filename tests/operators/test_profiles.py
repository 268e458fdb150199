"""Profile alignments: whole sequences, sums that hold, no worse than a consensus and near the best."""

import itertools
import random

import numpy as np
import pytest

from helixframe.operators import align, profiles


def total(rows, p):
    one = lambda a, b: 0.0 if a == b == "-" else -p.step if "-" in (a, b) else float(p.table(a, b)[0, 0])
    return sum(one(a, b) for c in zip(*rows) for a, b in itertools.combinations(c, 2))


def family(r, n, size, share):
    base = [r.choice("ACGT") for _ in range(size)]
    change = lambda c: "" if r.random() < share / 3 else r.choice("ACGT") if r.random() < share / 3 else c + r.choice(["", r.choice("ACGT")]) if r.random() < share / 3 else c
    return ["".join(map(change, base)) for _ in range(n)]


@pytest.mark.parametrize("p", [align.Scoring(), align.Scoring(mismatch=2.0, gap=1.5), align.Scoring(matrix=align.PAM250, gap=5.0)])
def test_sums_and_sequences(p):
    r = random.Random(1)
    for n in range(30):
        seqs = family(r, r.randrange(1, 7), r.randrange(0, 30), 0.4)
        rows, score = profiles.align_many(seqs, p)
        assert [x.replace("-", "") for x in rows] == seqs and len(set(map(len, rows))) == 1
        assert abs(score - total(rows, p)) < 1e-6
        if len(seqs) == 2:
            assert abs(score - align.needleman_wunsch(*seqs, p)[2]) < 1e-6


def test_not_below_a_consensus():
    r, p = random.Random(2), align.Scoring()
    for share in (0.1, 0.3, 0.6):
        for _ in range(8):
            seqs = family(r, 6, 60, share)
            assert profiles.align_many(seqs, p)[1] >= total(align.progressive(seqs, p), p)


def test_joined_profiles_are_best():
    """Against every path of columns."""
    r, s = np.random.default_rng(3), profiles._full(["A", "C"], align.Scoring())
    for _ in range(20):
        x, y = r.integers(0, 3, (2, r.integers(0, 4))), r.integers(0, 3, (3, r.integers(0, 4)))
        best = {}
        for i in range(x.shape[1] + 1):
            for j in range(y.shape[1] + 1):
                cross = lambda a, b: s[np.ix_(a, b)].sum()
                ways = [0.0] if not i and not j else []
                if i and j:
                    ways.append(best[i - 1, j - 1] + cross(x[:, i - 1], y[:, j - 1]))
                if i:
                    ways.append(best[i - 1, j] + cross(x[:, i - 1], np.full(3, 2)))
                if j:
                    ways.append(best[i, j - 1] + cross(np.full(2, 2), y[:, j - 1]))
                best[i, j] = max(ways)
        a, b = profiles._join(x, y, s)
        assert a.shape[1] == b.shape[1] and abs(sum(s[np.ix_(a[:, k], b[:, k])].sum() for k in range(a.shape[1])) - best[x.shape[1], y.shape[1]]) < 1e-9


def test_groups(spark):
    data = [("a", 1, "ACGT"), ("a", 2, "AGT"), ("a", 2, "AGT"), ("b", 1, None), ("b", 2, ""), (None, 1, "AC"), (None, 2, None)]
    got = profiles.profile_alignment(spark.createDataFrame(data, "g string, ordinal int, seq string"), ["g"]).cache()
    rows = sorted((x.g or "", x.ordinal, x.aligned, x.score) for x in got.collect())
    assert rows == [("", 1, "AC", -2.0), ("", 2, "--", -2.0), ("a", 1, "ACGT", 7.0), ("a", 2, "A-GT", 7.0), ("a", 2, "A-GT", 7.0), ("b", 1, "", 0.0), ("b", 2, "", 0.0)]
    assert {x.g: x.total for x in profiles.column_totals(got, ["g"]).collect()} == {"a": 7.0, None: -2.0}
