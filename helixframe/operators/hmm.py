"""Profile hidden Markov models.

A model is three small arrays (states, transitions, emissions over an alphabet). Building one from an alignment is relational; decoding and
training run as Arrow functions, one row a sequence, with the model in the closure. Training over many sequences adds their expected
counts with a groupBy, so a round is one distributed pass.

Layout: state 0 is S, 1 is I0, and level L has M = 3L - 1, D = 3L, I = 3L + 1; E is last.

Defined cases: a null sequence has a null likelihood and path and counts for nothing; an empty one has the log-likelihood 0, an empty path
and no counts; a letter outside the alphabet is emitted by every state with the floor's probability (in a profile, like any emission that was
never seen) and counts as no symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored

FLOOR = 1e-12


@dataclass
class Model:
    states: list[str]
    transition: np.ndarray
    emission: np.ndarray
    alphabet: str


def coded(x: str, m: Model) -> np.ndarray:
    """Places in the alphabet; the place after its last for other letters."""
    at = {c: i for i, c in enumerate(m.alphabet)}
    return np.array([at.get(c, len(at)) for c in x], int)


def logs(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of transitions and emissions, the latter with a column for other letters."""
    return np.log(m.transition + FLOOR), np.log(np.column_stack((m.emission, np.zeros(len(m.emission)))) + FLOOR)


def alphabet_of(seq: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(seq, ""), lambda c: c != "")))


def log_sum_exp(values: Column) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, x: s + x))


def state_names(levels: int) -> list[str]:
    return ["S", "I0", *(f"{k}{i}" for i in range(1, levels + 1) for k in "MDI"), "E"]


def profile_states(rows: DataFrame, by: list[str], theta: float, order: str = "ordinal", seq: str = "seq") -> DataFrame:
    """by, order, col, ch, state, _end: the states along the rows of an alignment, and E's number.

    A column is kept if fewer than theta of its places are gaps; a kept column is a level."""
    cells = rows.select(*by, order, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("col", "ch"))
    keep = cells.groupBy(*by, "col").agg((F.sum((F.col("ch") == "-").cast("int")) < F.count(F.lit(1)) * F.lit(theta)).alias("keep"))
    level = keep.withColumn("level", F.sum(F.col("keep").cast("int")).over(Window.partitionBy(*by).orderBy("col")))
    last = level.groupBy(*by).agg((3 * F.max("level") + 2).alias("_end"))
    at = cells.join(level, [*by, "col"]).join(last, by)
    state = F.when(F.col("keep"), F.when(F.col("ch") == "-", 3 * F.col("level")).otherwise(3 * F.col("level") - 1)).when(F.col("ch") != "-", F.when(F.col("level") == 0, 1).otherwise(3 * F.col("level") + 1))
    return at.withColumn("state", state).where("state IS NOT NULL").select(*by, order, "col", "ch", "state", "_end")


def profile_counts(rows: DataFrame, by: list[str], theta: float, order: str = "ordinal", seq: str = "seq") -> DataFrame:
    """by, src, dst, n: transitions counted along the rows of an alignment, S and E included."""
    path = profile_states(rows, by, theta, order, seq)
    w = Window.partitionBy(*by, order).orderBy("col")
    steps = path.select(*by, order, "state", "_end", F.lag("state", 1, 0).over(w).alias("before"), F.lead("state").over(w).alias("after"))
    ends = steps.where("after IS NULL").select(*by, F.col("state").alias("src"), F.col("_end").alias("dst"))
    return steps.select(*by, F.col("before").alias("src"), F.col("state").alias("dst")).union(ends).groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def profile_model(rows: DataFrame, by: list[str], theta: float = 0.5, pseudocount: float = 0.01, alphabet: str = "ACGT", order: str = "ordinal", seq: str = "seq") -> DataFrame:
    """by, kind (T or E), src, to, p: the models of many alignments at once, in the terms of build_profile(), unrounded. to: a state, or a
    letter's place in the alphabet. Cells of probability 0 that the layout doesn't allow are left out."""
    counts = profile_counts(rows, by, theta, order, seq)
    end = counts.groupBy(*by).agg(F.max("dst").alias("_end"))
    state = end.select(*by, "_end", F.explode(F.sequence(F.lit(0), F.col("_end") - 1)).alias("src"))
    first = F.col("src") + F.when(F.col("src") == 0, 1).otherwise(F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), (F.col("src") % 3 + 1).cast("int")))
    to = F.when(first + 2 <= F.col("_end"), F.sequence(first, first + 2)).otherwise(F.array(F.col("_end") - 1, F.col("_end")))
    allowed_ = state.select(*by, "src", F.explode(to).alias("to"))
    letter = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(alphabet) - 1).cast("long"))).alias("to")
    emitting = state.where("src % 3 <> 0").select(*by, "src", letter)
    seen = emissions(rows, by, theta, alphabet, order, seq)

    def shares(found: DataFrame, more: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by, "src")
        plain = found.select(*by, "src", "to", (F.col("n") / F.sum("n").over(w)).alias("p")).unionByName(more.withColumn("p", F.lit(pseudocount)))
        cells = plain.groupBy(*by, "src", "to").agg(F.sum("p").alias("p"))
        return cells.withColumn("p", F.col("p") / F.sum("p").over(w))

    t = shares(counts.withColumnRenamed("dst", "to"), allowed_).withColumn("kind", F.lit("T"))
    return t.unionByName(shares(seen, emitting).withColumn("kind", F.lit("E"))).select(*by, "kind", "src", "to", "p")


def emissions(rows: DataFrame, by: list[str], theta: float, alphabet: str, order: str = "ordinal", seq: str = "seq") -> DataFrame:
    """by, src, to, n: how often the state emits the letter at that place of the alphabet."""
    path = profile_states(rows, by, theta, order, seq).where("ch <> '-'")
    return path.select(*by, F.col("state").alias("src"), (F.expr(f"instr('{alphabet}', ch)") - 1).cast("long").alias("to")).where("to >= 0").groupBy(*by, "src", "to").agg(F.count(F.lit(1)).alias("n"))


def build_profile(alignment: list[str], theta: float = 0.5, pseudocount: float = 0.01, alphabet: str = "ACGT", decimals: int | None = 3) -> Model:
    """The model of an alignment: shares of transitions and emissions, the pseudocount added to what the layout allows, and shares again."""
    n, width = len(alignment), len(alignment[0])
    kept = [sum(s[c] == "-" for s in alignment) < theta * n for c in range(width)]
    levels = sum(kept)
    size = 3 * levels + 3
    t, e = np.zeros((size, size)), np.zeros((size, len(alphabet)))
    for s in alignment:
        at, level = 0, 0
        for c, ch in enumerate(s):
            level += kept[c]
            if kept[c]:
                new = 3 * level if ch == "-" else 3 * level - 1
            elif ch == "-":
                continue
            else:
                new = 3 * level + 1
            t[at, new] += 1
            if ch != "-":
                e[new, alphabet.index(ch)] += 1
            at = new
        t[at, size - 1] += 1
    share = lambda x: np.divide(x, x.sum(1, keepdims=True), out=np.zeros_like(x), where=x.sum(1, keepdims=True) > 0)
    t, e = share(t), share(e)
    for i in range(size - 1):
        for j in allowed(i, size):
            t[i, j] += pseudocount
        if 0 < i and i % 3:
            e[i] += pseudocount
    t, e = share(t), share(e)
    if decimals is not None:
        t, e = t.round(decimals), e.round(decimals)
    return Model(state_names(levels), t, e, alphabet)


def allowed(i: int, size: int) -> list[int]:
    """Where a state may go: its level's insertion, and the next level's match and deletion (or the end)."""
    first = 1 if i == 0 else i if i % 3 == 1 else i + 2 if i % 3 == 2 else i + 1
    return [j for j in (first, first + 1, first + 2) if j < size - 1] if first + 2 < size else [j for j in (size - 2, size - 1)]


def forward(x: str, m: Model) -> float:
    """Log-likelihood with a uniform start, every state emitting, and floors."""
    if not x:
        return 0.0
    (logt, loge), o = logs(m), coded(x, m)
    a = loge[:, o[0]] - np.log(len(m.states))
    for c in o[1:]:
        v = a[:, None] + logt
        top = v.max(0)
        a = loge[:, c] + top + np.log(np.exp(v - top).sum(0))
    return float(a.max() + np.log(np.exp(a - a.max()).sum()))


def profile_path(x: str, m: Model) -> tuple[list[str], float]:
    """Viterbi over the profile with silent deletions: from S to E, emitting in matches and insertions; ties prefer I, then M, then D."""
    size, n = len(m.states), len(x)
    levels = (size - 3) // 3
    log = lambda p: np.log(p) if p > 0 else -1e9
    seen = np.column_stack((m.emission, np.zeros(size)))
    o = coded(x, m)
    best = {(0, 0): 0.0}
    back: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(state: int, i: int, sources: list[tuple[int, int]], emit: float) -> None:
        top, how = None, None
        for s, j in sources:
            if (s, j) in best:
                v = best[s, j] + log(m.transition[s, state])
                if top is None or v > top:
                    top, how = v, (s, j)
        if top is not None:
            best[state, i] = top + emit
            back[state, i] = how

    for i in range(n + 1):
        for level in range(levels + 1):
            ins, mat, dele = 3 * level + 1, 3 * level - 1, 3 * level
            if level:
                before = [3 * level - 2, 3 * level - 4 if level > 1 else 0, 3 * level - 3] if level > 1 else [1, 0]
                if i:
                    offer(mat, i, [(s, i - 1) for s in before], log(seen[mat, o[i - 1]]))
                offer(dele, i, [(s, i) for s in before], 0.0)
            if i:
                own = [ins, mat, dele] if level else [1, 0]
                offer(ins, i, [(s, i - 1) for s in own], log(seen[ins, o[i - 1]]))
    end = size - 1
    offer(end, n, [(s, n) for s in ([3 * levels + 1, 3 * levels - 1, 3 * levels] if levels else [1, 0])], 0.0)
    path, at = [], back.get((end, n))
    while at and at[0]:
        path.append(m.states[at[0]])
        at = back[at]
    return path[::-1], float(best.get((end, n), -np.inf))


def viterbi(x: str, m: Model) -> np.ndarray:
    """The most probable states with a uniform start; ties to the first state."""
    if not x:
        return np.empty(0, int)
    (logt, loge), o = logs(m), coded(x, m)
    v, back = loge[:, o[0]] - np.log(len(logt)), []
    for c in o[1:]:
        s = v[:, None] + logt
        back.append(s.argmax(0))
        v = s.max(0) + loge[:, c]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def expected_counts(x: str, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch's sums over one sequence: transitions and emissions."""
    (logt, loge), o = logs(m), coded(x, m)
    n, size = len(o), len(m.states)
    if not n:
        return np.zeros_like(logt), np.zeros_like(m.emission)
    lse = lambda v, axis: v.max(axis) + np.log(np.exp(v - v.max(axis, keepdims=True)).sum(axis))
    a, b = np.zeros((n, size)), np.zeros((n, size))
    a[0] = loge[:, o[0]] - np.log(size)
    for t in range(1, n):
        a[t] = loge[:, o[t]] + lse(a[t - 1][:, None] + logt, 0)
    for t in range(n - 2, -1, -1):
        b[t] = lse(logt + (loge[:, o[t + 1]] + b[t + 1])[None, :], 1)
    total = lse((a[-1] + b[-1])[None, :], 1)[0]
    gamma = np.exp(a + b - total)
    T, E = np.zeros_like(logt), np.zeros_like(loge)
    for t in range(n - 1):
        xi = a[t][:, None] + logt + (loge[:, o[t + 1]] + b[t + 1])[None, :]
        xi = np.exp(xi - xi.max())
        T += xi / xi.sum()
    for t in range(n):
        E[:, o[t]] += gamma[t]
    return T, E[:, :-1]


def path_counts(x: str, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The same from the one best path."""
    path = viterbi(x, m)
    T, E = np.zeros_like(m.transition), np.zeros((len(m.states), len(m.alphabet) + 1))
    np.add.at(T, (path[:-1], path[1:]), 1)
    np.add.at(E, (path, coded(x, m)), 1)
    return T, E[:, :-1]


def _maximised(T: np.ndarray, E: np.ndarray, m: Model) -> Model:
    share = lambda x: np.divide(x, x.sum(1, keepdims=True), out=np.zeros_like(x), where=x.sum(1, keepdims=True) > 0)
    return Model(m.states, share(T), share(E), m.alphabet)


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis, keepdims=True)
    return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)


def _batches(texts: list[str], m: Model, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in texts, their letters (text x place, the longest text first) and lengths, of texts of like length together."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    while len(order):
        n = max(1, int(cells // (size[order[0]] * len(m.states))))
        part, order = order[:n], order[n:]
        o = np.full((len(part), int(size[part[0]])), len(m.alphabet), np.int64)
        for row, i in zip(o, part.tolist()):
            row[: size[i]] = coded(texts[i], m)
        yield part, o, size[part]


def _live(size: np.ndarray, t: int) -> int:
    """How many texts are longer than t, the longest coming first."""
    return int(np.searchsorted(-size, -t, "left"))


def _forward(o: np.ndarray, size: np.ndarray, logt: np.ndarray, loge: np.ndarray) -> np.ndarray:
    """text x place x state. logt, loge: of each text, or one for all."""
    a = np.zeros((*o.shape, logt.shape[-1]))
    at = np.arange(len(o))
    own = lambda x, n: x[:n] if len(x) > 1 else x
    emit = lambda t, n: loge[at[:n] if len(loge) > 1 else 0, :, o[:n, t]]
    a[:, 0] = emit(0, len(o)) - np.log(a.shape[2])
    for t in range(1, o.shape[1]):
        n = _live(size, t)
        a[:n, t] = emit(t, n) + _lse(a[:n, t - 1, :, None] + own(logt, n), 1)
    return a


def batch_counts(o: np.ndarray, size: np.ndarray, logt: np.ndarray, loge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch's sums of each text, all texts a place at a time: text x state x state, text x state x letter."""
    a = _forward(o, size, logt, loge)
    count, long, states = a.shape
    at = np.arange(count)
    own = lambda x, n: x[:n] if len(x) > 1 else x
    b = np.zeros_like(a)
    T, E = np.zeros((count, states, states)), np.zeros((count, states, loge.shape[2]))
    for t in range(long - 2, -1, -1):
        n = _live(size, t + 1)
        ahead = loge[at[:n] if len(loge) > 1 else 0, :, o[:n, t + 1]] + b[:n, t + 1]
        xi = own(logt, n) + ahead[:, None, :]
        b[:n, t] = _lse(xi, 2)
        xi = a[:n, t, :, None] + xi
        xi = np.exp(xi - xi.max((1, 2), keepdims=True))
        T[:n] += xi / xi.sum((1, 2), keepdims=True)
    total = _lse(a[at, size - 1], 1)
    for t in range(long):
        n = _live(size, t)
        E[at[:n], :, o[:n, t]] += np.exp(a[:n, t] + b[:n, t] - total[:n, None])
    return T, E[:, :, :-1]


def train_one(x: str, m: Model, iterations: int = 5, hard: bool = False) -> Model:
    for _ in range(iterations):
        m = _maximised(*(path_counts if hard else expected_counts)(x, m), m)
    return m


def own_likelihoods(texts: list[str], m: Model, iterations: int = 5) -> np.ndarray:
    """Each text's log-likelihood under the model trained on it alone; texts of like length are trained together."""
    out = np.zeros(len(texts))
    share = lambda x: np.divide(x, x.sum(-1, keepdims=True), out=np.zeros_like(x), where=x.sum(-1, keepdims=True) > 0)
    for part, o, size in _batches(texts, m):
        logt, loge = (x[None] for x in logs(m))
        for _ in range(iterations):
            T, E = batch_counts(o, size, logt, loge)
            logt = np.log(share(T) + FLOOR)
            loge = np.log(np.concatenate((share(E), np.zeros((*E.shape[:2], 1))), axis=2) + FLOOR)
        out[part] = _lse(_forward(o, size, logt, loge)[np.arange(len(o)), size - 1], 1)
    return out


def train(seqs: DataFrame, m: Model, iterations: int = 5, hard: bool = False, seq: str = "seq") -> Model:
    """Rounds over all sequences, which are stored once: a task adds up the counts of its sequences, and the driver gets one number a cell."""
    rows = stored(seqs.select(F.col(seq).alias("seq")))
    for _ in range(iterations):
        now = m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat = np.zeros(now.transition.size + now.emission.size)
            logt, loge = (x[None] for x in logs(now))
            for b in batches:
                texts = [x or "" for x in b.column("seq").to_pylist()]
                if hard:
                    for x in texts:
                        flat += np.concatenate([c.ravel() for c in path_counts(x, now)])
                else:
                    for _, o, size in _batches(texts, now):
                        T, E = batch_counts(o, size, logt, loge)
                        flat += np.concatenate((T.sum(0).ravel(), E.sum(0).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

        cells = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(m.transition.size + m.emission.size)
        for r in cells:
            flat[r["i"]] = r["v"]
        m = _maximised(flat[: m.transition.size].reshape(m.transition.shape), flat[m.transition.size :].reshape(m.emission.shape), m)
    return m


def likelihoods(seqs: DataFrame, m: Model, seq: str = "seq") -> DataFrame:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else forward(x, m))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return seqs.withColumn("log_likelihood", F.pandas_udf(run, "double")(seq))


def decode(seqs: DataFrame, m: Model, kind: str = "profile", seq: str = "seq") -> DataFrame:
    """seqs with path: the states of the best path."""

    def run(s: pd.Series) -> pd.Series:
        if kind == "profile":
            return s.map(lambda x: None if x is None else " ".join(profile_path(x, m)[0]))
        return s.map(lambda x: None if x is None else " ".join(m.states[i] for i in viterbi(x, m)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return seqs.withColumn("path", F.pandas_udf(run, "string")(seq))


def most_divergent(seqs: DataFrame, m: Model, iterations: int = 5, order: str = "ordinal", seq: str = "seq") -> DataFrame:
    """The sequence whose own trained model gives it the least likelihood, ties to the first; null ones have none."""

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series(own_likelihoods([x or "" for x in s], m, iterations))
        return out.where(s.notna().to_numpy(), None)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    scored = seqs.select(order, F.pandas_udf(run, "double")(seq).alias("_p"))
    # a filter on the result would be pushed below it, and run it twice
    least = F.min(F.when(F.col("_p").isNotNull(), F.struct("_p", order))).alias("m")
    return scored.agg(least).select(F.col(f"m.{order}").alias(order), F.col("m._p").alias("log_likelihood"))


def model_rows(spark, m: Model) -> tuple[DataFrame, DataFrame]:
    """(from, to, p) and (state, sym, p), for sinks."""
    n = range(len(m.states))
    return (
        spark.createDataFrame([(i, j, float(m.transition[i, j])) for i in n for j in n], "`from` int, `to` int, p double"),
        spark.createDataFrame([(i, c, float(m.emission[i, k])) for i in n for k, c in enumerate(m.alphabet)], "state int, sym string, p double"),
    )


def model_text(m: Model) -> str:
    """The states, and both matrices a row a line, under their titles."""
    rows = lambda a: "".join(" ".join(str(float(x)) for x in r) + "\n" for r in a)
    return f"States:\n{' '.join(m.states)}\n\nTransition Matrix:\n{rows(m.transition)}\nEmission Matrix:\n{rows(m.emission)}"


def full_transition(compact: np.ndarray) -> np.ndarray:
    """The n x n matrix of a compact one, whose three columns are where a state may go (the last three rows: first and last column)."""
    size = len(compact)
    out = np.zeros((size, size))
    for i in range(size - 1):
        to = allowed(i, size)
        out[i, to] = compact[i, [0, 2] if len(to) == 2 else [0, 1, 2]]
    return out


def expected(seqs: DataFrame, m: Model, key: str, seq: str = "seq") -> DataFrame:
    """key, src, dst, n: expected transitions of each sequence."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: expected_counts(x or "", m)[0].ravel())

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    n = len(m.states)
    cells = seqs.select(key, F.posexplode(F.pandas_udf(run, "array<double>")(seq)).alias("i", "n"))
    return cells.select(key, (F.col("i") / n).cast("int").alias("src"), (F.col("i") % n).alias("dst"), "n")
