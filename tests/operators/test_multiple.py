"""Multiple alignment within bounds against the whole table."""

import itertools
import math
import random

import pytest

from helixframe.operators import align


def every_cell(seqs: list[str], mode: str = "pairs", mismatch: float = 1.0, gap: float = 1.0, whole: bool = False) -> tuple[list[str], float]:
    """The whole t-dimensional table."""
    sizes = [len(s) + 1 for s in seqs]
    moves = [mv for mv in itertools.product((0, 1), repeat=len(seqs)) if any(mv)]

    def column(chars: tuple[str, ...]) -> float:
        if mode == "pairs":
            return sum(-gap if "-" in (x, y) else 1.0 if x == y else -mismatch for x, y in itertools.combinations(chars, 2))
        n, gaps = len(chars), chars.count("-")
        s = -(sum(-(chars.count(c) / n) * math.log2(chars.count(c) / n) for c in sorted(set(chars) - {"-"})) + gap * gaps)
        return float(int(s)) if whole else s

    known: dict[tuple, float] = {}
    best = {tuple([0] * len(seqs)): (0.0, None)}
    for at in itertools.product(*(range(n) for n in sizes)):
        if not any(at):
            continue
        top, how = -math.inf, None
        for mv in moves:
            was = tuple(i - d for i, d in zip(at, mv))
            if min(was) < 0:
                continue
            chars = tuple(s[i - 1] if d else "-" for s, i, d in zip(seqs, at, mv))
            if chars not in known:
                known[chars] = column(chars)
            x = best[was][0] + known[chars]
            if x > top:
                top, how = x, mv
        best[at] = (top, how)
    at, out = tuple(n - 1 for n in sizes), [[] for _ in seqs]
    score = best[at][0]
    while any(at):
        mv = best[at][1]
        for k, d in enumerate(mv):
            out[k].append(seqs[k][at[k] - 1] if d else "-")
        at = tuple(i - d for i, d in zip(at, mv))
    return ["".join(reversed(o)) for o in out], score


def mutated(r: random.Random, s: str, share: float) -> str:
    out = []
    for c in s:
        x = r.random()
        out.append("" if x < share / 3 else r.choice("ACGT") if x < 2 * share / 3 else c + r.choice("ACGT") if x < share else c)
    return "".join(out)


@pytest.mark.parametrize("options", [{}, {"mismatch": 2.0, "gap": 0.5}, {"gap": 3.0}, {"gap": 0.0}, {"gap": -0.5}, {"mode": "entropy"}, {"mode": "entropy", "whole": True}, {"mode": "entropy", "whole": True, "gap": 1.5}])
def test_same_alignment_as_the_whole_table(options):
    r = random.Random(5)
    for n in range(25):
        base = "".join(r.choice("ACG") for _ in range(r.randrange(9)))
        seqs = [mutated(r, base, 0.6) if n % 2 else "".join(r.choice("AC") for _ in range(r.randrange(7))) for _ in range(r.choice([1, 2, 3, 3, 4]))]
        rows, score = every_cell(seqs, **options)
        assert align.multiple_within(seqs, **options) == (rows, score, score), seqs


def test_tables_beyond_any_whole_one():
    r = random.Random(6)
    base = "".join(r.choice("ACGT") for _ in range(300))
    seqs = [mutated(r, base, 0.06) for _ in range(4)]  # 8 billion cells
    rows, score, upper = align.multiple_within(seqs)
    assert score == upper and [x.replace("-", "") for x in rows] == seqs and len(set(map(len, rows))) == 1
    pairs = lambda c: sum(-1.0 if "-" in p else 1.0 if p[0] == p[1] else -1.0 for p in itertools.combinations(c, 2))
    assert sum(map(pairs, zip(*rows))) == score


def test_refusals_are_rows(spark):
    r = random.Random(7)
    data = [("far", k, "".join(r.choice("ACGT") for _ in range(60))) for k in range(4)] + [("near", k, "ACGTACGT") for k in range(3)] + [("none", 0, None), ("none", 1, ""), ("long", 0, "A" * 600), ("long", 1, "C" * 600)]
    got = {x.g: x for x in align.multiple_alignment(spark.createDataFrame(data, "g string, ordinal int, seq string"), ["g"], cells=2000).collect()}
    assert got["near"].status == "exact" and got["near"].score == got["near"].upper == 24.0
    assert got["none"].status == "exact" and got["none"].aligned == ["", ""]
    assert got["far"].status == "bounded" and got["far"].score < got["far"].upper and [x.replace("-", "") for x in got["far"].aligned] == [s for g, _, s in data if g == "far"]
    assert got["long"].status == "refused" and got["long"].aligned is None
    with pytest.raises(ValueError):
        align.multiple([s for g, _, s in data if g == "far"], cells=2000)


def test_equal_groups_are_aligned_once(spark, tmp_path, monkeypatch):
    kinds = [["ACGT", "AGT", "ACT"], ["AGT", "ACGT", "ACT"], ["AC", None], ["TTT"]]
    rows = [(g, place, s) for g in range(40) for place, s in enumerate(kinds[g % 4])]
    plain = align.multiple_within

    def noted(seqs, **options):
        (tmp_path / f"{random.getrandbits(64)}").touch()
        return plain(seqs, **options)

    monkeypatch.setattr(align, "multiple_within", noted)
    got = align.multiple_alignment(spark.createDataFrame(rows, "g int, ordinal int, seq string"), ["g"])
    want = [plain([s or "" for s in k]) for k in kinds]
    assert {r["g"]: (r["aligned"], r["score"], r["status"]) for r in got.collect()} == {g: (want[g % 4][0], want[g % 4][1], "exact") for g in range(40)}
    assert len(list(tmp_path.iterdir())) <= len(kinds)
    assert got.columns == ["g", "aligned", "score", "upper", "status"]
