"""Scores of pairs too long for one task: the table is cut into tiles, and those of an antidiagonal are filled in parallel.

A tile needs the last row of the tile above and the last column of the one to its left, so a round's results are two borders a tile, in shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import NEG, Scoring
from .lineage import stored

BORDERS = "top array<array<double>>, left array<array<double>>"


def tile(v: str, w: str, p: Scoring, switch: bool, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last row and the last column of a tile. A border holds, cell by cell, the best score, the score from which a gap may open, and that of a gap
    which goes on across it (from above, from the left). switch: a gap may follow one in the other sequence."""
    s, n, m = p.table(v, w), len(v), len(w)
    opening, extend = (p.step, p.step) if switch else (p.open, p.extend)
    slope, (best, start, down) = extend * np.arange(m), top
    right = np.full((3, n + 1), NEG)
    right[:2, 0] = best[-1], start[-1]
    for i in range(1, n + 1):
        match = best[:-1] + s[i - 1]
        down = np.maximum(start - opening, down - extend)
        free = np.maximum(match, down[1:]) if switch else match
        across = np.append(left[1, i], free)[:m] - opening
        if m:
            across[0] = max(across[0], left[2, i] - extend)
            across = np.maximum.accumulate(across + slope) - slope
        all_ = np.maximum(np.maximum(match, down[1:]), across)
        best, start = np.append(left[0, i], all_), np.append(left[1, i], all_ if switch else match)
        right[:, i] = (best[-1], start[-1], across[-1]) if m else left[:, i]
    return np.stack([best, start, down]), right


def _edge(first: int, n: int, opening: float, extend: float) -> np.ndarray:
    at = np.arange(first, first + n + 1)
    cost = np.where(at == 0, 0.0, -opening - (at - 1) * extend)
    return np.stack([cost, cost, np.full(n + 1, NEG)])


def _blocks(text: Column, size: int) -> Column:
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def tiled_scores(pairs: DataFrame, by: list[str], kind: str = "affine", v: str = "v", w: str = "w", scoring: Scoring = Scoring(), size: int = 2048) -> DataFrame:
    """by, score: the best global alignment of each pair, equal to that of `align` of the same kind (global or affine). by tells pairs apart; of pairs alike in it,
    all have to be equal. Pairs with a null sequence have no row; an empty one is all gaps.

    A task holds a tile of size x size cells at a time. There are as many rounds as the longest pair has antidiagonals of tiles, each with the tiles of
    all pairs that have come as far."""
    if kind not in ("global", "affine"):
        raise ValueError(f"kind {kind} is neither global nor affine")
    switch = kind == "global"
    opening, extend = (scoring.step, scoring.step) if switch else (scoring.open, scoring.extend)
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.where(F.col(v).isNotNull() & F.col(w).isNotNull()).select(F.struct(F.lit(0).alias("_all"), *by).alias("_k"), _blocks(F.col(v), size).alias("_v"), _blocks(F.col(w), size).alias("_w")).dropDuplicates(["_k"])
    both = stored(both, small=True)
    rows, columns = both.select("_k", F.posexplode("_v").alias("r", "_v")), both.select("_k", F.posexplode("_w").alias("c", "_w"))
    rows, columns = stored(rows, small=True), stored(columns, small=True)
    ends = both.select("_k", F.size("_v").alias("_r"), F.size("_w").alias("_c"))
    state = ends.select("*", F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(None).cast("array<array<double>>").alias("top"), F.lit(None).cast("array<array<double>>").alias("left"))
    rounds = ends.agg(F.max(F.col("_r") + F.col("_c"))).first()[0] or 1

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):  # one tile's borders at a time
                one = batch.iloc[at : at + 1].reset_index(drop=True)
                a, b, r, c = one["_v"][0], one["_w"][0], int(one["r"][0]), int(one["c"][0])
                top = _edge(c * size, len(b), opening, extend) if one["top"][0] is None else np.stack(list(one["top"][0]))
                left = _edge(r * size, len(a), opening, extend) if one["left"][0] is None else np.stack(list(one["left"][0]))
                below, right = tile(a, b, scoring, switch, top, left)
                yield one[["_id", "_r", "_c", "r", "c"]].assign(top=[below.tolist()], left=[right.tolist()])

    # a struct of keys can hold types that pandas alters: tiles go by a number, the keys stay behind
    names = stored(both.select("_k", F.monotonically_increasing_id().alias("_id")), small=True)
    rows, columns, state = (t.join(names, "_k").drop("_k") for t in (rows, columns, state))
    rows, columns, done = stored(rows, small=True), stored(columns, small=True), []
    for _ in range(rounds - 1):
        work = state.join(rows, ["_id", "r"]).join(columns, ["_id", "c"]).repartition(tasks, "_id", "r", "c")  # dealt by number: a tile is much work in few bytes
        out = stored(work.select("_id", "_r", "_c", "r", "c", "_v", "_w", "top", "left").mapInPandas(fill, f"_id long, _r int, _c int, r int, c int, {BORDERS}"))
        done.append(out.where("r = _r - 1 AND c = _c - 1").select("_id", F.element_at(F.col("top")[0], -1).alias("score")))
        none = F.lit(None).cast("array<array<double>>")
        down = out.where("r + 1 < _r").select("_id", "_r", "_c", (F.col("r") + 1).alias("r"), "c", "top", none.alias("left"))
        across = out.where("c + 1 < _c").select("_id", "_r", "_c", "r", (F.col("c") + 1).alias("c"), none.alias("top"), "left")
        state = down.union(across).groupBy("_id", "_r", "_c", "r", "c").agg(F.first("top", ignorenulls=True).alias("top"), F.first("left", ignorenulls=True).alias("left"))
    scores = done[0] if done else spark.createDataFrame([], "_id long, score double")
    for more in done[1:]:
        scores = scores.union(more)
    return scores.join(names, "_id").select(*[F.col("_k")[c].alias(c) for c in by], "score")
