"""Blocks, fingerprint ranges and bounded filters for the operators that compare documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOOM_BITS = 26  # at most 8 MB, however many keys


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULT = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**j and MULT**-j modulo 2**64, for j below n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, MULT, np.uint64), np.full(size, pow(MULT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def range_of(tokens: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the 64-bit numbers each is in."""
    return ((tokens >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def blocks_for(rows_bytes: int, partitions: int, block_bytes: int = 16 << 20) -> int:
    return max(partitions, -(-rows_bytes // block_bytes))


def _bits(key: Column, size: int) -> Column:
    return F.array(F.pmod(F.xxhash64(key), F.lit(size)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(size)), F.pmod(F.xxhash64(key, F.lit(2)), F.lit(size)))


def bloom(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A Bloom filter of a long column, built by the executors; its size is bounded by BLOOM_BITS. `in_bloom` reads it."""
    n = keys.count()
    size = 1 << min(BLOOM_BITS, max(10, (16 * n).bit_length()))
    bit = F.explode(_bits(F.col(column), size))
    words = keys.select(bit.alias("bit")).select((F.col("bit") / 64).cast("long").alias("at"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("word"))
    found = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out, size


def bloom_bits(key: Column, size: int) -> Column:
    """The bits that a key sets, to be passed to in_bloom()."""
    return _bits(key, size)


def in_bloom(words: np.ndarray, bits: pa.Array) -> np.ndarray:
    b = bits.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    return ((words[b >> 6] >> (b & 63)) & 1).all(1)


def raw(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def gathered(batches: Iterator[pa.RecordBatch] | pa.Table, name: str) -> list:
    return batches.column(name).to_pylist()
