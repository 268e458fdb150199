"""All pairs of rows of two tables, where every pair is the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, blocks: int = 8) -> DataFrame:
    """Each row of a beside each row of b, whose columns have other names.

    Both sides are dealt into blocks and meet by (block of a, block of b): an equi-join with blocks ** 2 keys, so that neither side is
    sent whole to anyone and no task has more than a share of the pairs. Each row is shuffled `blocks` times."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = a.withColumn("_x", block(a_key)).withColumn("_y", each)
    right = b.withColumn("_y", block(b_key)).withColumn("_x", each)
    # dealt by number, as a block is as much work however few bytes it has
    left, right = (t.repartition(blocks * blocks, "_x", "_y") for t in (left, right))
    return left.join(right.hint("merge"), ["_x", "_y"]).drop("_x", "_y")
