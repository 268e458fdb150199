"""Motif search. Profiles add one to every count; products are taken left to right, so that ties fall the same everywhere.

Single searches are sequential; starts, restarts and chains are rows and run in parallel. Every random choice takes a seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kmers import kmers

BASES = "ACGT"


def cells(motifs: DataFrame, by: list[str], motif: str = "motif") -> DataFrame:
    return motifs.select(*by, F.posexplode(F.filter(F.split(motif, ""), lambda c: c != "")).alias("pos", "nuc"))


def profile(motifs: DataFrame, by: list[str], motif: str = "motif") -> DataFrame:
    """by, pos, a, c, g, t: shares with one added to each count."""
    n = lambda b: F.sum(F.when(F.col("nuc") == b, 1).otherwise(0))
    return cells(motifs, by, motif).groupBy(*by, "pos").agg(*[((n(b) + 1) / (F.count(F.lit(1)) + 4)).alias(b.lower()) for b in BASES])


def score(motifs: DataFrame, by: list[str], motif: str = "motif") -> DataFrame:
    """by, score: letters that differ from their column's most common one."""
    counts = cells(motifs, by, motif).groupBy(*by, "pos", "nuc").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by, "pos").agg((F.sum("n") - F.max("n")).alias("s")).groupBy(*by).agg(F.sum("s").alias("score"))


def consensus(motifs: DataFrame, by: list[str], motif: str = "motif") -> DataFrame:
    """by, consensus: each column's most common letter, ties to the first of ACGT."""
    counts = cells(motifs, by, motif).groupBy(*by, "pos", "nuc").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by, "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), "nuc"))["nuc"].alias("nuc"))
    return best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nuc"))), lambda x: x["nuc"]), "").alias("consensus"))


def probability(kmer: Column, columns: Column) -> Column:
    """The product over the places of a k-mer; columns: array of (a, c, g, t)."""
    pick = lambda c, p: F.when(c == "A", p["a"]).when(c == "C", p["c"]).when(c == "G", p["g"]).otherwise(p["t"])
    letters = F.filter(F.split(kmer, ""), lambda c: c != "")
    return F.aggregate(F.zip_with(letters, columns, pick), F.lit(1.0), lambda s, x: s * x)


def most_probable(df: DataFrame, profile_rows: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """by, kmer, pos: the first most probable k-mer of each sequence under one profile (k rows, attached as an array)."""
    p = profile_rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "a", "c", "g", "t"))).alias("_p"))
    scored = kmers(df, k, seq, by).crossJoin(F.broadcast(p)).withColumn("_s", probability(F.col("kmer"), F.col("_p")))
    best = scored.groupBy(*by).agg(F.max(F.struct("_s", (-F.col("pos")).alias("_q"), "kmer")).alias("b"))
    return best.select(*by, "b.kmer", (-F.col("b._q")).alias("pos"))


def hashed(text: Column) -> Column:
    """A number below 16 ** 13 from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def random_kmers(df: DataFrame, k: int, seed: int, seq: str = "seq") -> DataFrame:
    """df with a k-mer from a uniform place, drawn by a hash of the sequence and the seed."""
    place = hashed(F.concat(F.lit(f"{seed}:"), F.col(seq))) % (F.length(seq) - (k - 1))
    return df.withColumn("motif", F.when(F.length(seq) >= k, F.substring(F.col(seq), place.cast("int") + 1, F.lit(k))))


# Kernels on sequences as arrays of 0..3.


def _codes(s: str) -> np.ndarray:
    return np.array([BASES.find(c) for c in s], np.int8)


def _windows(seqs: list[str], k: int) -> list[np.ndarray]:
    """Each sequence's k-mers over ACGT; a sequence without any is left out."""
    all_ = (np.lib.stride_tricks.sliding_window_view(_codes(s), k) for s in seqs)
    return [x for w in all_ if len(x := w[(w >= 0).all(1)])]


def _profile(motifs: np.ndarray) -> np.ndarray:
    return np.array([(motifs == b).sum(0) + 1 for b in range(4)]) / (len(motifs) + 4)


def _probabilities(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.ones(len(w))
    for j in range(w.shape[1]):
        out = out * p[w[:, j], j]
    return out


def _score(motifs: np.ndarray) -> int:
    return int((len(motifs) - np.array([(motifs == b).sum(0) for b in range(4)]).max(0)).sum())


def _text(motifs: np.ndarray) -> list[str]:
    return ["".join(BASES[b] for b in m) for m in motifs]


def greedy_from(w: list[np.ndarray], start: int) -> tuple[int, np.ndarray]:
    """Each further sequence gives its most probable k-mer under the motifs so far."""
    motifs = w[0][start : start + 1]
    for x in w[1:]:
        motifs = np.vstack([motifs, x[int(_probabilities(x, _profile(motifs)).argmax())]])
    return _score(motifs), motifs


def randomized(w: list[np.ndarray], seed: int, restarts: int = 50) -> tuple[int, np.ndarray]:
    """A restart goes on only while it beats the best of all restarts."""
    r = np.random.default_rng(seed)
    best, best_score = None, 1 << 30
    for _ in range(restarts):
        motifs = np.array([x[r.integers(len(x))] for x in w])
        while True:
            p = _profile(motifs)
            motifs = np.array([x[int(_probabilities(x, p).argmax())] for x in w])
            s = _score(motifs)
            if s >= best_score:
                break
            best, best_score = motifs, s
    return best_score, best


def gibbs(w: list[np.ndarray], seed: int, steps: int = 50) -> tuple[int, np.ndarray]:
    """One chain: a random sequence's motif is drawn anew by its probability under the others."""
    r = np.random.default_rng(seed)
    motifs = np.array([x[r.integers(len(x))] for x in w])
    best, best_score = motifs.copy(), _score(motifs)
    for _ in range(steps):
        i = int(r.integers(len(w)))
        p = _probabilities(w[i], _profile(np.delete(motifs, i, 0)))
        motifs[i] = w[i][int(r.choice(len(p), p=p / p.sum()))]
        s = _score(motifs)
        if s < best_score:
            best, best_score = motifs.copy(), s
    return best_score, best


def search(df: DataFrame, k: int, by: list[str], method: str = "greedy", order: str = "ordinal", seq: str = "seq", seeds: int = 8, **options) -> DataFrame:
    """by, score, motifs: the best motif set of each group of sequences.

    greedy tries every k-mer of the first sequence; those starts are dealt into rows. randomized and gibbs run once per seed. The best
    score wins, then the first start or seed. k-mers with other letters than ACGT are never taken; sequences that are null or have no k-mer
    are left out, and a group of no others has no row."""
    groups = df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, seq))), lambda x: x[seq]).alias("_s"))
    groups = groups.withColumn("_s", F.filter("_s", lambda x: F.length(x) >= k)).where(F.size("_s") > 0)
    if method == "greedy":
        runs = F.sequence(F.lit(0), F.length(F.element_at("_s", 1)) - k, F.lit(32))
    else:
        runs = F.sequence(F.lit(0), F.lit(seeds - 1))
    rows = groups.withColumn("_run", F.explode(runs))

    def run(s: pd.Series, r: pd.Series) -> pd.DataFrame:
        out, made = [], {}
        for seqs, first in zip(s, r):
            key = tuple(seqs)
            if key not in made:
                made = {key: _windows(list(seqs), k)}
            w = made[key]
            if not w or (method == "greedy" and first >= len(w[0])):
                out.append((None, None, None))
                continue
            if method == "greedy":
                tries = [(*greedy_from(w, i), i) for i in range(first, min(first + 32, len(w[0])))]
                if first == 0:  # the first k-mers are the set to beat
                    start = np.array([x[0] for x in w])
                    tries.insert(0, (_score(start), start, -1))
                score_, motifs, at = min(tries, key=lambda t: (t[0], t[2]))
            else:
                score_, motifs = (randomized if method == "randomized" else gibbs)(w, int(first), **options)
                at = int(first)
            out.append((score_, at, _text(motifs)))
        return pd.DataFrame(out, columns=["score", "at", "motifs"]).astype({"score": "Int64", "at": "Int64"})

    run.__annotations__ = {"s": pd.Series, "r": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(run, "struct<score:int,at:int,motifs:array<string>>")("_s", "_run")
    # a filter on the result would be pushed below it, and run it twice
    best = F.min(F.when(F.col("m.score").isNotNull(), F.col("m"))).alias("m")
    return rows.select(*by, made.alias("m")).groupBy(*by).agg(best).where("m IS NOT NULL").select(*by, "m.score", "m.motifs")


def profile_random(df: DataFrame, profile_rows: DataFrame, k: int, by: list[str], seed: int, seq: str = "seq") -> DataFrame:
    """by, kmer, pos: one k-mer of each sequence, drawn with the profile's probabilities (by an exponential clock a k-mer, so that
    the draw is a minimum and needs no running sum)."""
    p = profile_rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "a", "c", "g", "t"))).alias("_p"))
    scored = kmers(df, k, seq, by).crossJoin(F.broadcast(p)).withColumn("_s", probability(F.col("kmer"), F.col("_p")))  # one row of k places
    u = (hashed(F.concat_ws(":", F.lit(str(seed)), *by, "pos")).cast("double") + 0.5) / F.lit(float(16**13))
    clock = F.when(F.col("_s") > 0, -F.ln(u) / F.col("_s")).otherwise(float("inf"))
    return scored.groupBy(*by).agg(F.min(F.struct(clock.alias("c"), "pos", "kmer")).alias("b")).select(*by, "b.kmer", "b.pos")
