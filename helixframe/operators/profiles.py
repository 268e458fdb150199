"""Multiple alignment of many sequences by profiles.

A guide tree by shared k-mers says who joins whom; two alignments join column by column, so that their sum over pairs of sequences grows most; then each
sequence is taken out and aligned to the rest again while the sum rises. One group in a task: time is that of a few hundred vector operations a column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agglomerate import merge_matrix
from .align import Scoring


def _full(letters: list[str], p: Scoring) -> np.ndarray:
    """Scores of letters, and the gap as the last one: a letter against a gap costs `gap`, two gaps nothing."""
    n = len(letters)
    out = np.full((n + 1, n + 1), -p.step)
    out[:n, :n] = p.table("".join(letters), "".join(letters))
    out[n, n] = 0.0
    return out


def _counts(rows: np.ndarray, n: int) -> np.ndarray:
    """How many of each letter (and gap) a column holds."""
    return (rows.T[:, :, None] == np.arange(n)).sum(1).astype(float)


def pair_total(rows: np.ndarray, s: np.ndarray) -> float:
    """The sum over all columns and pairs of rows."""
    c = _counts(rows, len(s))
    return float((np.einsum("ca,ab,cb->", c, s, c) - (c @ np.diag(s)).sum()) / 2)


def _join(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two alignments as one, by the best path of columns; ties prefer diagonal, then x alone, then y alone."""
    gap, (a, b) = len(s) - 1, (_counts(x, len(s)), _counts(y, len(s)))
    match = a @ s @ b.T
    x_alone, y_alone = (a @ s[:, gap]) * len(y), np.append(0.0, np.cumsum((b @ s[:, gap]) * len(x)))
    row = y_alone.copy()
    how = np.full((len(a) + 1, len(b) + 1), 2, np.int8)
    for i in range(len(a)):
        here = row + x_alone[i]
        how[i + 1] = 1
        diagonal = row[:-1] + match[i]
        better = diagonal >= here[1:] - 1e-9
        here[1:] = np.where(better, diagonal, here[1:])
        how[i + 1, 1:][better] = 0
        row = np.maximum.accumulate(here - y_alone) + y_alone
        how[i + 1][row > here + 1e-9] = 2
    i, j, one, two = len(a), len(b), [], []
    while i or j:
        h = how[i, j]
        i, j = i - (h != 2), j - (h != 1)
        one.append(i if h != 2 else -1)
        two.append(j if h != 1 else -1)
    put = lambda rows, at: np.where(at < 0, gap, np.append(rows, np.full((len(rows), 1), gap), 1)[:, at])
    return put(x, np.array(one[::-1], int)), put(y, np.array(two[::-1], int))


def _guide(seqs: list[str], k: int) -> list[tuple]:
    """Merges by mean distance: one minus the shared k-mers' share of those of the shorter."""
    words, at = np.unique([s[i : i + k] for s in seqs for i in range(len(s) - k + 1)] or [""], return_inverse=True)
    n = np.array([max(len(s) - k + 1, 0) for s in seqs])
    counts = np.zeros((len(seqs), len(words)))
    if n.sum():
        np.add.at(counts, (np.repeat(np.arange(len(seqs)), n), at), 1)
    i, j = np.triu_indices(len(seqs), 1)
    shared = np.concatenate([np.minimum(counts[a], counts[a + 1 :]).sum(1) for a in range(len(seqs) - 1)])
    d = 1 - shared / np.maximum(np.minimum(n[i], n[j]), 1)
    return merge_matrix(i, j, pd.DataFrame({"s": d, "n": 1}), "avg")


def align_many(seqs: list[str], p: Scoring = Scoring(), k: int = 3, refine: int = 2) -> tuple[list[str], float]:
    """The rows of an alignment, in order, and their sum over pairs."""
    letters = sorted(set("".join(seqs)))
    if len(seqs) < 2 or not letters:
        return list(seqs), 0.0
    s, at = _full(letters, p), {c: i for i, c in enumerate(letters)}
    gap, coded = len(letters), [np.array([[at[c] for c in x]], int).reshape(1, -1) for x in seqs]
    parts = {i: ([i], c) for i, c in enumerate(coded)}
    for a, b, *_ in _guide(seqs, k):
        (m, x), (n, y) = parts[a], parts.pop(b)
        parts[a] = (m + n, np.concatenate(_join(x, y, s)))
    ((members, rows),) = parts.values()
    rows = rows[np.argsort(members)]
    score = pair_total(rows, s)
    for _ in range(refine):
        before = score
        for i in range(len(seqs)):
            rest = np.delete(rows, i, 0)
            x, y = _join(rest[:, (rest != gap).any(0)], coded[i], s)
            new = np.insert(x, i, y[0], 0)
            total = pair_total(new, s)
            if total > score + 1e-9:
                rows, score = new, total
        if score == before:
            break
    names = np.array([*letters, "-"])
    return ["".join(names[r]) for r in rows], score


def profile_alignment(rows: DataFrame, by: list[str], order: str = "ordinal", seq: str = "seq", scoring: Scoring = Scoring(), k: int = 3, refine: int = 2) -> DataFrame:
    """by, order, aligned, score: each group's sequences aligned, and the sum over the group's pairs of rows. Null sequences count as empty; rows of equal
    order are all kept. A matrix in `scoring` must have every pair of the letters met."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_s=pdf[seq].where(pdf[seq].notna(), "")).sort_values([order, "_s"])
        got, score = align_many(pdf["_s"].tolist(), scoring, k, refine)
        return pd.DataFrame({**{c: [x] * len(pdf) for c, x in zip(by, key)}, order: pdf[order].to_numpy(), "aligned": got, "score": score})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, order])
    # dealt by number, as a group is much work in few bytes
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return dealt.groupBy(*by).applyInPandas(run, f"{kinds}, aligned string, score double")


def column_totals(aligned: DataFrame, by: list[str], seq: str = "aligned", match: float = 1.0, mismatch: float = 1.0, gap: float = 1.0) -> DataFrame:
    """by, total: the sum over columns and pairs of rows, from the number of each letter in each column; no pair of rows is formed."""
    pairs: Column = F.col("n") * (F.col("n") - 1) / 2
    cells = aligned.select(*by, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("col", "ch"))
    counts = cells.groupBy(*by, "col", "ch").agg(F.count("*").alias("n"))
    letter = F.col("ch") != "-"
    columns = counts.groupBy(*by, "col").agg(F.sum(F.when(letter, pairs).otherwise(0)).alias("same"), F.sum(F.when(letter, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(letter, 0).otherwise(F.col("n"))).alias("gaps"))
    return columns.groupBy(*by).agg(F.sum(match * F.col("same") - mismatch * (pairs - F.col("same")) - gap * F.col("n") * F.col("gaps")).alias("total"))
