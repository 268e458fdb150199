"""Pairwise and multiple alignment: one row per pair, parallel over pairs.

A kernel fills its table row by row with numpy: what comes from above and from the diagonal is a vector operation, and what comes
from the left is a running maximum once the gap cost is added back. Ties prefer diagonal, then vertical, then horizontal.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kmers import letters

ALIGNED = "struct<a:string,b:string,score:double>"
NEG = -1e18


@dataclass(frozen=True)
class Scoring:
    """match for equal letters, -mismatch otherwise, or what `matrix` says; a gap of n costs n * gap, or open + (n - 1) * extend."""

    match: float = 1.0
    mismatch: float = 1.0
    gap: float = 1.0
    open: float = 1.0
    extend: float = 0.5
    matrix: dict[str, float] | None = None  # two letters -> score; a pair that is missing cannot be aligned
    gap_adds: bool = False  # a gap adds `gap` to the score instead of costing it

    def table(self, v: str, w: str) -> np.ndarray:
        x, y = np.array(list(v), dtype="U1"), np.array(list(w), dtype="U1")
        if self.matrix is None:
            return np.where(x[:, None] == y[None, :], self.match, -self.mismatch)
        letters = sorted(set(v) | set(w))
        at = {c: i for i, c in enumerate(letters)}
        m = np.array([[self.matrix.get(a + b, self.matrix.get(b + a, NEG)) for b in letters] for a in letters]).reshape(len(letters), len(letters))
        return m[np.array([at[c] for c in v], int)[:, None], np.array([at[c] for c in w], int)[None, :]]

    @property
    def step(self) -> float:
        return -self.gap if self.gap_adds else self.gap


def parse_matrix(text: str) -> dict[str, float]:
    """A substitution matrix in the usual text form: a line of letters, then a letter and its scores a line."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    return {r[0] + c: float(x) for r in rows[1:] for c, x in zip(rows[0], r[1:])}


#: The PAM250 matrix of Dayhoff and others (1978), its lower half in the usual order of residues.
PAM250_ROWS = """
A  2
R -2  6
N  0  0  2
D  0 -1  2  4
C -2 -4 -4 -5 12
Q  0  1  1  2 -5  4
E  0 -1  1  3 -5  2  4
G  1 -3  0  1 -3 -1  0  5
H -1  2  2  1 -3  3  1 -2  6
I -1 -2 -2 -2 -2 -2 -2 -3 -2  5
L -2 -3 -3 -4 -6 -2 -3 -4 -2  2  6
K -1  3  1  0 -5  1  0 -2  0 -2 -3  5
M -1  0 -2 -3 -5 -1 -2 -3 -2  2  4  0  6
F -3 -4 -3 -6 -4 -5 -5 -5 -2  1  2 -5  0  9
P  1  0  0 -1 -3  0 -1  0  0 -2 -3 -1 -2 -5  6
S  1  0  1  0  0 -1  0  1 -1 -1 -3  0 -2 -3  1  2
T  1 -1  0  0 -2 -1  0  0 -1  0 -2  0 -1 -3  0  1  3
W -6  2 -4 -7 -8 -5 -7 -7 -3 -5 -2 -3 -4  0 -6 -2 -5 17
Y -3 -4 -2 -4  0 -4 -4 -5  0 -1 -1 -4 -2  7 -5 -3 -3  0 10
V  0 -2 -2 -2 -2 -2 -2 -1 -2  4  2 -2  2 -1 -1 -1  0 -6 -2  4
"""


def parse_half(text: str) -> dict[str, float]:
    """A symmetric matrix from its lower half: a letter and its scores with the letters so far, a line. Two letters in either order -> score."""
    rows = [line.split() for line in text.splitlines() if line.strip()]
    letters = [r[0] for r in rows]
    return {k: float(x) for r in rows for c, x in zip(letters, r[1:]) for k in (r[0] + c, c + r[0])}


PAM250 = parse_half(PAM250_ROWS)


def recounted(a: Column, b: Column, match: float = 1.0, mismatch: float = 1.0, open_: float = 1.0, extend: float = 1.0) -> Column:
    """The score of two aligned texts, column by column; a run of gaps on one side costs open and then extend a letter."""
    cell = lambda x, y: F.when(x == "-", "v").when(y == "-", "w").when(x == y, "=").otherwise("x")
    kinds = F.zip_with(letters(a), letters(b), cell)
    cost = F.transform(kinds, lambda k, i: F.when(k == "=", match).when(k == "x", -mismatch).when(k == F.get(kinds, i - 1), -extend).otherwise(-open_))
    return F.aggregate(cost, F.lit(0.0), lambda s, x: s + x)


def _run(t: np.ndarray, g: float, slope: np.ndarray) -> np.ndarray:
    """The best of a place and of any before it, each step costing g."""
    return np.maximum.accumulate(t + slope) - slope if g else np.maximum.accumulate(t)


def fill(s: np.ndarray, g: float, kind: str = "global", last_only: bool = False) -> np.ndarray:
    n, m = s.shape
    slope = g * np.arange(m + 1)
    row = np.zeros(m + 1) if kind == "local" else -slope
    out = [row]
    for i in range(1, n + 1):
        new = np.empty(m + 1)
        new[0] = 0.0 if kind != "global" else -g * i
        new[1:] = np.maximum(row[:-1] + s[i - 1], row[1:] - g)
        if kind == "local":
            new = np.maximum(new, 0.0)
        row = _run(new, g, slope)
        if last_only:
            out = [row]
        else:
            out.append(row)
    return np.array(out)


def trace(t: np.ndarray, s: np.ndarray, v: str, w: str, g: float, i: int, j: int, stop: str) -> tuple[str, str]:
    """stop: edge (0, 0), zero (a cell of 0) or row (i may be anything once j is 0)."""
    a, b = [], []
    while i or j:
        if stop == "zero" and (t[i, j] <= 1e-9 or not (i and j)) or stop == "row" and not j:
            break
        if i and j and abs(t[i, j] - (t[i - 1, j - 1] + s[i - 1, j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            a.append(v[i])
            b.append(w[j])
        elif i and (not j or abs(t[i, j] - (t[i - 1, j] - g)) < 1e-9):
            i -= 1
            a.append(v[i])
            b.append("-")
        else:
            j -= 1
            a.append("-")
            b.append(w[j])
    return "".join(reversed(a)), "".join(reversed(b))


def needleman_wunsch(v: str, w: str, p: Scoring) -> tuple[str, str, float]:
    s = p.table(v, w)
    t = fill(s, p.step)
    return *trace(t, s, v, w, p.step, len(v), len(w), "edge"), float(t[-1, -1])


def smith_waterman(v: str, w: str, p: Scoring) -> tuple[str, str, float]:
    s = p.table(v, w)
    t = fill(s, p.step, "local")
    i, j = divmod(int(t.argmax()), t.shape[1])
    return *trace(t, s, v, w, p.step, i, j, "zero"), float(t[i, j])


def fitting(v: str, w: str, p: Scoring) -> tuple[str, str, float]:
    """All of w against a part of v."""
    s = p.table(v, w)
    t = fill(s, p.step, "fit")
    i = int(t[:, -1].argmax())
    return *trace(t, s, v, w, p.step, i, len(w), "row"), float(t[i, -1])


def affine(v: str, w: str, p: Scoring, middle_only: bool = False) -> tuple[str, str, float]:
    """Gotoh's three tables. middle_only scores, and starts from, the table of matches alone, the score cut to a whole number."""
    s, n, m = p.table(v, w), len(v), len(w)
    M, X, Y = (np.full((n + 1, m + 1), NEG) for _ in range(3))  # X ends in a gap in v, Y in a gap in w
    M[0, 0] = 0
    edge = lambda k: -p.open - (np.arange(1, k + 1) - 1) * p.extend
    M[1:, 0] = Y[1:, 0] = edge(n)
    M[0, 1:] = X[0, 1:] = edge(m)
    slope = p.extend * np.arange(m)
    for i in range(1, n + 1):
        M[i, 1:] = np.maximum(np.maximum(M[i - 1, :-1], X[i - 1, :-1]), Y[i - 1, :-1]) + s[i - 1]
        Y[i, 1:] = np.maximum(M[i - 1, 1:] - p.open, Y[i - 1, 1:] - p.extend)
        X[i, 1:] = _run(M[i, :-1] - p.open, p.extend, slope)
    best = [M[n, m], Y[n, m], X[n, m]]
    score = float(int(M[n, m])) if middle_only else float(max(best))
    layer, i, j, a, b = 0 if middle_only else int(np.argmax(best)), n, m, [], []
    while i or j:
        if not i or not j:
            layer = 1 if i else 2
        if layer == 0:
            before = [M[i - 1, j - 1], Y[i - 1, j - 1], X[i - 1, j - 1]]
            layer, i, j = int(np.argmax(before)), i - 1, j - 1
            a.append(v[i])
            b.append(w[j])
        elif layer == 1:
            layer, i = (0 if j and M[i - 1, j] - p.open >= Y[i - 1, j] - p.extend else 1), i - 1
            a.append(v[i])
            b.append("-")
        else:
            layer, j = (0 if i and M[i, j - 1] - p.open >= X[i, j - 1] - p.extend else 2), j - 1
            a.append("-")
            b.append(w[j])
    return "".join(reversed(a)), "".join(reversed(b)), score


def hirschberg(v: str, w: str, p: Scoring) -> tuple[str, str, float]:
    """Global alignment in linear space."""
    todo: list[tuple[str, str]] = [(v, w)]
    a, b = [], []
    while todo:
        x, y = todo.pop()
        if len(x) < 2 or len(y) < 2:
            got = needleman_wunsch(x, y, p)
            a.append(got[0])
            b.append(got[1])
            continue
        h = len(x) // 2
        left = fill(p.table(x[:h], y), p.step, last_only=True)[-1]
        right = fill(p.table(x[h:][::-1], y[::-1]), p.step, last_only=True)[-1][::-1]
        j = int((left + right).argmax())
        todo += [(x[h:], y[j:]), (x[:h], y[:j])]
    one, two = "".join(a), "".join(b)
    s = sum(-p.step if "-" in (c, d) else float(p.table(c, d)[0, 0]) for c, d in zip(one, two))
    return one, two, float(s)


KERNELS: dict[str, Callable] = {"global": needleman_wunsch, "local": smith_waterman, "fitting": fitting, "affine": affine, "linear_space": hirschberg}


def aligner(kind: str, scoring: Scoring = Scoring(), **options):
    """A pandas UDF of two sequence columns that returns their aligned texts and score."""
    kernel = KERNELS[kind]

    def run(v: pd.Series, w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernel(x, y, scoring, **options) if x is not None and y is not None else (None, None, None) for x, y in zip(v, w)], columns=["a", "b", "score"])

    run.__annotations__ = {"v": pd.Series, "w": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, ALIGNED)


def align(pairs: DataFrame, kind: str, v: str = "v", w: str = "w", scoring: Scoring = Scoring(), **options) -> DataFrame:
    """pairs with an `alignment` column. For kind fitting the longer sequence takes the part of v."""
    x, y = F.col(v), F.col(w)
    if kind == "fitting":
        x, y = F.when(F.length(v) >= F.length(w), x).otherwise(y), F.when(F.length(v) >= F.length(w), y).otherwise(x)
    return pairs.withColumn("alignment", aligner(kind, scoring, **options)(x, y))


def score_matrix(spark, mismatch: float = 1.0, gap: float = 1.0) -> DataFrame:
    """a, b, score over ACGT and the gap; a gap against anything, another gap too, costs gap."""
    a = spark.createDataFrame([(c,) for c in "ACGT-"], "a string")
    b = a.withColumnRenamed("a", "b")
    s = F.when((F.col("a") == "-") | (F.col("b") == "-"), F.lit(-gap)).when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.lit(-mismatch))
    return a.crossJoin(F.broadcast(b)).withColumn("score", s)  # 5 x 5


def pair_sum(chars: Column, mismatch: float = 1.0, gap: float = 1.0) -> Column:
    """The sum over all pairs of an array of letters; a pair with a gap costs gap."""
    one = lambda x, y: F.when((x == "-") | (y == "-"), F.lit(-gap)).when(x == y, F.lit(1.0)).otherwise(F.lit(-mismatch))
    rows = F.transform(chars, lambda x, i: F.aggregate(F.slice(chars, i + 2, F.size(chars)), F.lit(0.0), lambda s, y: s + one(x, y)))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x)


def entropy(chars: Column, gap: float = 1.0) -> Column:
    """Minus (entropy of the letters, shares taken of all rows, plus gap for each gap)."""
    n = F.size(chars).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.transform(F.array_sort(F.array_distinct(F.filter(chars, lambda x: x != "-"))), lambda c: -share(c) * F.log2(share(c)))
    return -(F.aggregate(bits, F.lit(0.0), lambda s, x: s + x) + gap * F.size(F.filter(chars, lambda x: x == "-")))


def alignment_columns(rows: DataFrame, by: list[str], seq: str = "seq", order: str = "ordinal") -> DataFrame:
    """by, col, chars: the letters of each column of aligned sequences, in order."""
    cells = rows.select(*by, order, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("col", "ch"))
    return cells.groupBy(*by, "col").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "ch"))), lambda x: x["ch"]).alias("chars"))


def _suffix_best(v: np.ndarray, w: np.ndarray, sub: np.ndarray, gap: float) -> np.ndarray:
    """The best score of the rest of v from i on and of w from j on, for every i and j."""
    out = np.empty((len(v) + 1, len(w) + 1))
    steps = gap * np.arange(len(w) + 1)
    out[-1] = -steps[::-1]
    for i in range(len(v) - 1, -1, -1):
        here = out[i + 1] - gap
        here[:-1] = np.maximum(here[:-1], out[i + 1, 1:] + sub[v[i], w])
        out[i] = np.maximum.accumulate((here - steps)[::-1])[::-1] + steps
    return out


class _Columns:
    """Scores of columns and bounds on what is left, for one group of sequences."""

    def __init__(self, seqs: list[str], mode: str, mismatch: float, gap: float, whole: bool):
        alphabet = sorted(set("".join(seqs)))
        at = {c: k for k, c in enumerate(alphabet)}
        self.codes = [np.array([at[c] for c in s], int) for s in seqs]
        self.pairs = list(itertools.combinations(range(len(seqs)), 2)) if mode == "pairs" else []
        self.mode, self.gap, self.whole, self.known = mode, gap, whole, {}
        self.sub = np.where(np.eye(len(alphabet), dtype=bool), 1.0, -mismatch)
        self.rest = {(p, q): _suffix_best(self.codes[p], self.codes[q], self.sub, gap) for p, q in self.pairs}
        self.sizes = np.array([len(s) for s in seqs])

    def scores(self, at: np.ndarray, move: tuple[int, ...]) -> np.ndarray:
        """The columns that end at the cells `at`."""
        if self.mode == "pairs":
            s = np.zeros(len(at))
            for p, q in self.pairs:
                s += self.sub[self.codes[p][at[:, p] - 1], self.codes[q][at[:, q] - 1]] if move[p] and move[q] else -self.gap
            return s
        moved = [k for k, d in enumerate(move) if d]
        chars, back = np.unique(np.stack([self.codes[k][at[:, k] - 1] for k in moved], 1), axis=0, return_inverse=True)
        return np.array([self._bits(tuple(sorted(c)), len(move)) for c in chars.tolist()])[back.ravel()]

    def _bits(self, chars: tuple[int, ...], n: int) -> float:
        if (chars, n) not in self.known:
            s = -(sum(-(chars.count(c) / n) * math.log2(chars.count(c) / n) for c in sorted(set(chars))) + self.gap * (n - len(chars)))
            self.known[chars, n] = float(int(s)) if self.whole else s
        return self.known[chars, n]

    def left(self, at: np.ndarray) -> np.ndarray:
        """No less than any alignment of what is left can score. A pair's columns in it are an alignment of the two, with columns of two gaps, which only
        cost; under entropies, at least the gaps that even out the lengths are paid."""
        if self.mode == "pairs":
            return sum((self.rest[p, q][at[:, p], at[:, q]] for p, q in self.pairs), np.zeros(len(at)))
        rest = self.sizes - at
        return -(math.floor(self.gap) if self.whole else self.gap) * (rest.max(1) * len(self.sizes) - rest.sum(1)).astype(float)

    def total(self, rows: list[str]) -> float:
        at, s = np.zeros((1, len(rows)), int), 0.0
        for column in zip(*rows):
            move = tuple(int(c != "-") for c in column)
            at = at + move
            s += float(self.scores(at, move)[0])
        return s


def _search(seqs: list[str], columns: _Columns, least: float, cells: int) -> tuple[list[str], float] | int | None:
    """The best alignment that scores `least` or more; None if there is none, the number of cells where more than `cells` would be kept.

    Cells go by the sum of their places, as arrays; one is kept only if its score and the bound on the rest reach `least`."""
    t, ends = len(seqs), columns.sizes
    moves = [mv for mv in itertools.product((0, 1), repeat=t) if any(mv)]
    strides = np.append(np.cumprod((ends + 1)[::-1])[::-1][1:], 1)
    levels = [(np.zeros((1, t), int), np.zeros(1, int), np.zeros(1), np.zeros(1, int))]
    kept = 1
    for level in range(1, int(ends.sum()) + 1):
        at, score, how = [], [], []
        for k, mv in enumerate(moves):
            if sum(mv) > level:
                continue
            was, _, had, _ = levels[level - sum(mv)]
            to = was + mv
            inside = (to <= ends).all(1)
            if inside.any():
                to = to[inside]
                at.append(to)
                score.append(had[inside] + columns.scores(to, mv))
                how.append(np.full(len(to), k))
        if at:
            at, score, how = np.concatenate(at), np.concatenate(score), np.concatenate(how)
            place = at @ strides
            order = np.lexsort((how, -score, place))
            order = order[np.append(True, np.diff(place[order]) > 0)]  # of a cell's best moves the first
            order = order[score[order] + columns.left(at[order]) >= least - 1e-9]
            levels.append((at[order], place[order], score[order], how[order]))
        else:
            levels.append((np.zeros((0, t), int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)))
        kept += len(levels[-1][0])
        if kept > cells:
            return kept
    if not len(levels[-1][0]):
        return None
    place, out, level = int(ends @ strides), [[] for _ in seqs], len(levels) - 1
    while level:
        at, places, _, how = levels[level]
        k = int(np.searchsorted(places, place))
        mv = moves[how[k]]
        for x, d in enumerate(mv):
            out[x].append(seqs[x][at[k, x] - 1] if d else "-")
        place, level = place - int(np.dot(mv, strides)), level - sum(mv)
    return ["".join(reversed(o)) for o in out], float(levels[-1][2][0])


def multiple_within(seqs: list[str], mode: str = "pairs", mismatch: float = 1.0, gap: float = 1.0, whole: bool = False, cells: int = 5_000_000) -> tuple[list[str] | None, float | None, float | None]:
    """aligned, score and a bound that no alignment's score passes: the best alignment where both are equal.

    Cells of the t-dimensional table are visited only where the score so far and the pairwise bounds of the rest (Carrillo and Lipman) reach a least
    score. It starts next to the bound of all and comes down by steps that double, not below the score of a progressive alignment. Where that takes more than `cells`
    cells, the progressive alignment is given, and the lowest score shown to be out of reach as the bound; without either where the pairwise tables alone
    have more than 20 times `cells` cells. Moves are tried in lexicographic order, the first best wins."""
    sizes = [len(s) + 1 for s in seqs]
    if not seqs:
        return [], 0.0, 0.0
    if sum(a * b for a, b in itertools.combinations(sizes, 2)) > 20 * cells:
        return None, None, None
    columns = _Columns(seqs, mode, mismatch, gap, whole)
    rows = progressive(seqs, Scoring(mismatch=mismatch, gap=gap))
    least = columns.total(rows)
    upper = float(columns.left(np.zeros((1, len(seqs)), int))[0]) if gap >= 0 else math.inf
    step = max(1.0, gap, mismatch)
    while math.prod(sizes) < 2**62:
        tried = max(least, upper - step) if gap >= 0 else -math.inf
        found = _search(seqs, columns, tried, cells)
        if isinstance(found, int):
            break
        if found is not None:
            return *found, found[1]
        upper, step = tried, 2 * step
    return rows, least, upper


def multiple(seqs: list[str], **options) -> tuple[list[str], float]:
    """The best alignment and its score, as `multiple_within`; an error where it is out of reach."""
    rows, score, upper = multiple_within(seqs, **options)
    if score is None or score < upper:
        raise ValueError("the table is too large")
    return rows, score


def multiple_alignment(rows: DataFrame, by: list[str], seq: str = "seq", order: str = "ordinal", **options) -> DataFrame:
    """by, aligned (array, in order), score, upper, status: each group's multiple alignment by `multiple_within`. status is exact (score is upper), bounded
    (an alignment, not shown to be the best) or refused (no alignment). A null sequence counts as empty. Groups of the same sequences are aligned once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for seqs in pdf["_s"]:
                got, score, upper = multiple_within(list(seqs), **options)
                rows.append((seqs, got, score, upper, "refused" if got is None else "exact" if score == upper else "bounded"))
            yield pd.DataFrame(rows, columns=["_s", "aligned", "score", "upper", "status"])

    own = F.array_sort(F.collect_list(F.struct(F.col(order).isNull(), F.col(order).alias("o"), F.coalesce(seq, F.lit("")).alias("s"))))
    groups = rows.groupBy(*by).agg(F.transform(own, lambda x: x["s"]).alias("_s"))
    # dealt by number, as a group is much work in few bytes
    dealt = groups.select("_s").distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = dealt.mapInPandas(run, "_s array<string>, aligned array<string>, score double, upper double, status string")
    return groups.join(made, "_s").select(*by, "aligned", "score", "upper", "status")


def progressive(seqs: list[str], p: Scoring = Scoring()) -> list[str]:
    """A stand-in for an external aligner: sequences join, most similar first, by aligning each with the consensus so far."""
    if len(seqs) < 2:
        return list(seqs)
    score = {(i, j): needleman_wunsch(seqs[i], seqs[j], p)[2] for i, j in itertools.combinations(range(len(seqs)), 2)}
    i, j = max(score, key=lambda ij: (score[ij], -ij[0], -ij[1]))
    rows = {i: seqs[i]}
    order = [j] + [k for k in range(len(seqs)) if k not in (i, j)]
    for k in order:
        columns = list(zip(*rows.values()))
        consensus = "".join(max(sorted(set(c) - {"-"}) or ["-"], key=c.count) for c in columns)
        a, b, _ = needleman_wunsch(consensus, seqs[k], p)
        new, at = {x: [] for x in rows}, 0
        for c in a:
            for x, r in rows.items():
                new[x].append("-" if c == "-" else r[at])
            at += c != "-"
        rows = {x: "".join(r) for x, r in new.items()} | {k: b}
    return [rows[k] for k in range(len(seqs))]


def progressive_alignment(rows: DataFrame, by: list[str], order: str = "ordinal", seq: str = "seq", scoring: Scoring = Scoring()) -> DataFrame:
    """by, order, aligned: each group's sequences, progressively aligned."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({**{c: [k] * len(pdf) for c, k in zip(by, key)}, order: pdf[order], "aligned": progressive(pdf[seq].tolist(), scoring)})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, order])
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, aligned string")
