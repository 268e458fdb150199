"""k-mers and replication origins. Sequences are columns of upper-case letters; positions count from 0."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGT"
CODE = np.full(256, 4, np.uint8)
CODE[list(b"ACGT")] = range(4)


def letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def valid_dna(seq: Column) -> Column:
    """Whether every letter is one of ACGT; filter by it before operators that need a strict alphabet."""
    return seq.rlike("^[ACGT]*$")


def hamming(a: Column, b: Column) -> Column:
    """Differing places of the common length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(letters(F.left(a, n)), letters(F.left(b, n)), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def neighbours(pattern: Column, k: int, d: int) -> Column:
    """All strings over ACGT within Hamming distance d of a pattern of length k, itself included, as an array."""
    out = F.array(pattern)
    for _ in range(d):
        one = lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.transform(F.array(*map(F.lit, BASES)), lambda b: F.overlay(s, b, i, F.lit(1)))))
        out = F.array_distinct(F.flatten(F.transform(out, one)))
    return out


def _windows(df: DataFrame, span: int, seq: str, keep: list[str]) -> DataFrame:
    """keep, pos (from 0) and _cut(at, n) for each window of `span` letters: places are generated, and letters cut out of the row's one
    sequence, so nothing holds all windows of a sequence at once."""
    places = F.when(F.length(seq) >= span, F.sequence(F.lit(0), F.length(seq) - span))
    rows = df.select(*keep, F.col(seq).alias("_s"), F.col(seq).cast("binary").alias("_raw"), places.alias("_p"))
    return rows.select(*keep, "_s", "_raw", F.explode("_p").alias("pos"))


def _letters_at(at: Column, n: int) -> Column:
    """Bytes can be reached without counting characters, which takes a place's time; they are used where a sequence has one byte a letter."""
    plain = F.length("_raw") == F.length("_s")
    return F.when(plain, F.substring(F.col("_raw"), at + 1, F.lit(n)).cast("string")).otherwise(F.substring(F.col("_s"), at + 1, F.lit(n)))


def kmers(df: DataFrame, k: int, seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """One row per occurrence: the columns of keep (default: all but seq), pos and kmer. A narrow explode."""
    keep = [c for c in df.columns if c != seq] if keep is None else keep
    return _windows(df, k, seq, keep).select(*keep, "pos", _letters_at(F.col("pos"), k).alias("kmer"))


def kmer_counts(df: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """Occurrences of each k-mer by group, and where it first is. Partial sums are made before the shuffle."""
    return kmers(df, k, seq, by).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def window_numbers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of k codes its number in base 4, and whether all its codes are below 4."""
    n = len(codes) - k + 1
    number, odd = np.zeros(n, np.int64), np.concatenate(([0], np.cumsum(codes > 3)))
    for j in range(k):
        number = (number << 2) | codes[j : j + n]
    return number, odd[k:] == odd[:-k]


def _pieces(texts: Iterable[str], chunk: int) -> Iterator[np.ndarray]:
    """Codes of the texts, joined by a mark until they have `chunk` letters. Other letters, of whatever width, are all one mark too."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= chunk:
            yield CODE[np.frombuffer("\n".join(part).encode("ascii", "replace"), np.uint8)]
            part, size = [], 0
    if part:
        yield CODE[np.frombuffer("\n".join(part).encode("ascii", "replace"), np.uint8)]


#: All words of five bases in order.
WORDS = np.frombuffer("".join(map("".join, itertools.product(BASES, repeat=5))).encode(), "V5")


def _spelled(number: np.ndarray, k: int) -> pa.Array:
    words = -(-k // 5)
    text = WORDS.take((number[:, None] >> np.arange(10 * (words - 1), -1, -10)) & 1023).view(np.uint8).reshape(len(number), 5 * words)[:, 5 * words - k :]
    return pa.Array.from_buffers(pa.string(), len(number), [None, pa.py_buffer(np.arange(0, k * len(number) + 1, k, dtype=np.int32).tobytes()), pa.py_buffer(text.tobytes())])


def kmer_totals(df: DataFrame, k: int, seq: str = "seq", chunk: int = 1 << 20, by: list[str] = ()) -> DataFrame:
    """by, kmer, n over the whole table, for k of at most 31.

    A task counts its k-mers as base-4 numbers (windows with other letters as text) and sends each once a chunk, or once in all for short ones without groups, so
    what is shuffled is distinct k-mers. Sequences are joined, and cut into overlapping chunks, so one of any length takes bounded memory."""

    def numbers(texts: list[str]) -> Iterator[np.ndarray]:
        for codes in _pieces(texts, chunk):
            for at in range(0, max(1, len(codes) - k + 1), chunk):
                part = codes[at : at + chunk + k - 1]
                if len(part) >= k:
                    number, whole = window_numbers(part, k)
                    yield number[whole]

    def groups(b: pa.RecordBatch) -> dict[tuple, list[str]]:
        texts = [t or "" for t in b.column("seq").to_pylist()]
        if not by:
            return {(): texts}
        found: dict[tuple, list[str]] = {}
        for key, t in zip(zip(*[b.column(c).to_pylist() for c in own]), texts):
            found.setdefault(key, []).append(t)
        return found

    def rows(key: tuple, kmer: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x] * len(n), kind) for x, kind in zip(key, kinds)], kmer, n], [*own, "kmer", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(4**k, np.int64) if k <= 11 and not by else None
        for b in batches:
            kinds[:] = [b.schema.field(c).type for c in own]
            for key, texts in groups(b).items():
                odd = Counter(t[i : i + k] for t in texts if t.strip(BASES) for i in range(len(t) - k + 1) if t[i : i + k].strip(BASES))
                if odd:
                    yield rows(key, pa.array(odd.keys(), pa.string()), pa.array(odd.values(), pa.int64()))
                for x in numbers(texts):
                    if dense is not None:
                        dense += np.bincount(x, minlength=4**k)
                    else:
                        at, n = np.unique(x, return_counts=True)
                        yield rows(key, _spelled(at, k), pa.array(n))
        if dense is not None:
            at = np.flatnonzero(dense)
            for i in range(0, len(at), 100_000):
                yield rows((), _spelled(at[i : i + 100_000], k), pa.array(dense[at[i : i + 100_000]]))

    if not 0 < k < 32:
        raise ValueError("k must be in 1..31")
    own, kinds = [f"_by{i}" for i in range(len(by))], []
    shape = "".join(f"{o} {df.schema[c].dataType.simpleString()}, " for o, c in zip(own, by)) + "kmer string, n long"
    counted = df.select(*[F.col(c).alias(o) for o, c in zip(own, by)], F.col(seq).alias("seq")).mapInArrow(run, shape)
    return counted.groupBy(*own, "kmer").agg(F.sum("n").alias("n")).select(*[F.col(o).alias(c) for o, c in zip(own, by)], "kmer", "n")


def kmer_array(seq: str, k: int) -> str:
    """The k-mers of one sequence in order, as an SQL text of an array of (pos, kmer). The bytes (or, with wide letters, the letters) are at hand as
    the variable of a fold of one step, so that each k-mer is cut without counting from the start."""
    made = "array()"
    places = f"IF(length({seq}) >= {k}, sequence(0, length({seq}) - {k}), CAST({made} AS ARRAY<INT>))"
    none = f"CAST({made} AS ARRAY<STRUCT<pos: INT, kmer: STRING>>)"
    plain = f"aggregate(array(CAST({seq} AS BINARY)), {none}, (s, x) -> transform({places}, i -> named_struct('pos', i, 'kmer', CAST(substring(x, i + 1, {k}) AS STRING))))"
    wide = f"aggregate(array(filter(split({seq}, ''), c -> c <> '')), {none}, (s, x) -> transform({places}, i -> named_struct('pos', i, 'kmer', array_join(slice(x, i + 1, {k}), ''))))"
    return f"CASE WHEN octet_length({seq}) = length({seq}) THEN {plain} WHEN {seq} IS NOT NULL THEN {wide} END"


def _skew_minimum(text: str | None, chunk: int = 1 << 20) -> int:
    low, at, before = None, -1, 0
    data = (text or "").encode("ascii", "replace")
    for i in range(0, len(data), chunk):
        x = np.frombuffer(data[i : i + chunk], np.uint8)
        run = before + np.cumsum((x == 71).astype(np.int8) - (x == 67), dtype=np.int64)
        j = int(run.argmin())
        if low is None or run[j] < low:
            low, at = int(run[j]), i + j
        before = int(run[-1])
    return at


def skew_minimum(seq: Column) -> Column:
    """The first place where G minus C, running, is smallest; -1 for an empty or null sequence. An Arrow function: a running sum in
    SQL is a fold, interpreted letter by letter."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_skew_minimum, na_action=None).astype("int32")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(seq)


def skew_minimum_chunked(df: DataFrame, by: list[str], chunk: str = "chunk", seq: str = "seq") -> DataFrame:
    """The same for a sequence that is dealt into rows (chunk numbers from 0): sums of chunks, their running sum, minima within."""

    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            x = np.frombuffer((t or "").encode("ascii", "replace"), np.uint8)
            steps = np.cumsum((x == 71).astype(np.int8) - (x == 67), dtype=np.int64)
            out.append((len(x), int(steps[-1]), int(steps.min()), int(steps.argmin())) if len(x) else (0, 0, None, None))
        return pd.DataFrame(out, columns=["n", "total", "low", "at"]).astype("Int64")

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    c = df.select(*by, chunk, F.pandas_udf(run, "struct<n:long,total:long,low:long,at:long>")(seq).alias("_s")).select(*by, chunk, "_s.*")
    w = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"before": F.coalesce(F.sum("total").over(w), F.lit(0)), "first": F.coalesce(F.sum("n").over(w), F.lit(0))}).where("low IS NOT NULL")
    place = F.col("first") + F.col("at")
    return c.groupBy(*by).agg(F.min_by(place, F.struct(F.col("low") + F.col("before"), place)).alias("skew_pos"))


def mismatch_totals(df: DataFrame, k: int, d: int, by: list[str], seq: str = "seq") -> DataFrame:
    """For each k-mer present: occurrences of its neighbourhood and of the reverse complements there."""
    counts = kmer_counts(df, k, by, seq)
    near = counts.select(*by, F.col("kmer").alias("u"), "first_pos", F.explode(neighbours(F.col("kmer"), k, d)).alias("x"))
    both = near.select(*by, "u", "first_pos", F.explode(F.array_distinct(F.array("x", reverse_complement(F.col("x"))))).alias("kmer"))
    hits = both.join(counts.select(*by, "kmer", "n"), [*by, "kmer"])
    return hits.groupBy(*by, "u", "first_pos").agg(F.sum("n").alias("total")).withColumnRenamed("u", "kmer")


def frequent_kmers(df: DataFrame, k: int, d: int, by: list[str], seq: str = "seq", dedupe: bool = True) -> DataFrame:
    """The k-mers of largest total. With dedupe, a k-mer in the neighbourhood (or its complements) of an earlier one that
    was scored, in order of first occurrence, is not scored itself; that greedy choice runs per group."""
    totals = mismatch_totals(df, k, d, by, seq)
    if dedupe:
        shape = totals.schema

        def near(u: str, left: int) -> set[str]:
            found = {u}
            for _ in range(left):
                found |= {x[:i] + b + x[i + 1 :] for x in found for i in range(k) for b in BASES}
            return found

        def choose(pdf):
            table = str.maketrans("ACGT", "TGCA")
            pdf = pdf.sort_values("first_pos")
            kept, covered = [], set()  # by the k-mers that were scored
            for i, u in enumerate(pdf["kmer"]):
                if u not in covered:
                    around = near(u, d)
                    covered |= around | {x[::-1].translate(table) for x in around}
                    kept.append(i)
            return pdf.iloc[kept]

        totals = totals.groupBy(*by).applyInPandas(choose, shape)
    best = F.rank().over(Window.partitionBy(*by).orderBy(F.col("total").desc()))
    return totals.withColumn("_r", best).where("_r = 1").select(*by, "kmer", "total")


def origin_windows(df: DataFrame, size: int, seq: str = "seq", pos: str = "skew_pos") -> DataFrame:
    """The three windows of `size` before, around and after a place, cut at the sequence's ends."""
    p, n = F.col(pos), F.length(seq)
    spans = [("before", F.greatest(p - size, F.lit(0)), p), ("around", F.greatest(p - size // 2, F.lit(0)), F.least(p + size // 2, n)), ("after", p, F.least(p + size, n))]
    made = F.array(*[F.struct(F.lit(w).alias("window"), a.alias("start"), F.substring(F.col(seq), a + 1, F.greatest(b - a, F.lit(0))).alias("part")) for w, a, b in spans])
    return df.select(*[c for c in df.columns if c != seq], F.explode(made).alias("_w")).select("*", "_w.window", "_w.start", "_w.part").drop("_w")


def base4(kmer: Column) -> Column:
    """A k-mer of up to 31 letters as a number, A0 C1 G2 T3."""
    return F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("long")


def base4_reverse_complement(number: Column, k: int) -> Column:
    digits = F.lpad(F.conv(number.cast("string"), 10, 4), k, "0")
    return F.conv(F.translate(F.reverse(digits), "0123", "3210"), 4, 10).cast("long")


def read_pairs(df: DataFrame, k: int, gap: int, seq: str = "seq") -> DataFrame:
    """The pairs of k-mers that lie gap letters apart."""
    keep = [c for c in df.columns if c != seq]
    pos = F.col("pos")
    return _windows(df, 2 * k + gap, seq, keep).select(*keep, "pos", _letters_at(pos, k).alias("a"), _letters_at(pos + k + gap, k).alias("b"))


def _pair_numbers(codes: np.ndarray, k: int, gap: int) -> np.ndarray:
    """Both k-mers of each pair as one number in base 4."""
    m = len(codes) - 2 * k - gap + 1
    number, whole = window_numbers(codes, k)
    return ((number[:m] << 2 * k) | number[k + gap :])[whole[:m] & whole[k + gap :]]


#: Bits of the number of a bucket of pairs.
BUCKET = 10


def _mixed(number: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """Pairs with their first k-mer multiplied by an odd number, so that its upper bits are as good as random; back undoes it."""
    low = 4**k - 1
    factor = 0x9E3779B1 & low | 1
    return (((number >> 2 * k) * (pow(factor, -1, 4**k) if back else factor) & low) << 2 * k) | (number & low)


def _packed_pairs(number: np.ndarray, k: int) -> Iterator[tuple[int, bytes]]:
    """Buckets of pairs, by the upper bits of their mixed numbers: how many there are and how often each stands, in bytes. In order a pair is a small step from the
    one before it. The lower bytes of steps are as good as random and stay as they are; the upper ones, those of a place together, and the counts pack well."""
    number = np.sort(_mixed(number, k))
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    number, n = number[first], np.diff(np.append(first, len(number)))
    shift = 4 * k - min(BUCKET, 2 * k)
    starts = np.searchsorted(number, np.arange(2 ** (4 * k - shift) + 1) << shift)
    steps = np.diff(number, prepend=0)
    at = np.flatnonzero(np.diff(starts))
    steps[starts[at]] = number[starts[at]] - (at << shift)
    width = (shift + 7) // 8
    for b in at.tolist():
        own, times = steps[starts[b] : starts[b + 1]], n[starts[b] : starts[b + 1]]
        few, plain = int(times.max() < 256), len(own) * min(width, int(own.sum() // len(own)).bit_length() // 8)
        cells = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() + times.astype(np.uint8 if few else np.int64).tobytes()
        yield b, b"".join((len(own).to_bytes(8, "little"), plain.to_bytes(8, "little"), bytes([few]), cells[:plain], pa.compress(cells[plain:], "zstd", asbytes=True)))


def _unpacked_pairs(b: int, cells: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The mixed numbers of `_packed_pairs`, in order, and how often each stands."""
    size, plain, few = int.from_bytes(cells[:8], "little"), int.from_bytes(cells[8:16], "little"), cells[16]
    shift = 4 * k - min(BUCKET, 2 * k)
    width = (shift + 7) // 8
    cells = np.frombuffer(cells[17 : 17 + plain] + pa.decompress(cells[17 + plain :], size * (width + (1 if few else 8)) - plain, "zstd", asbytes=True), np.uint8)
    steps = np.zeros((size, 8), np.uint8)
    steps[:, :width] = cells[: size * width].reshape(width, size).T
    return np.cumsum(steps.view(np.int64).ravel()) + (b << shift), cells[size * width :].view(np.uint8 if few else np.int64).astype(np.int64)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each number of the parts once, in order, and the sum of its counts."""
    if len(parts) == 1:
        return parts[0]
    number, n = (np.concatenate(x) for x in zip(*parts))
    more = np.flatnonzero(n > 1)
    extra = number[more], n[more] - 1
    number.sort()
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    number, n = number[first], np.diff(np.append(first, len(number)))
    np.add.at(n, np.searchsorted(number, extra[0]), extra[1])
    return number, n


def read_pair_totals(df: DataFrame, k: int, gap: int, seq: str = "seq", chunk: int = 1 << 18, held: int = 1 << 22, letters: tuple[bytes, bytes] | None = None) -> DataFrame:
    """a, b, n: how often each of `read_pairs` stands in the whole table, for k of at most 15.

    Sequences are dealt out, a letter in two bits, as a few bytes make many pairs. A task counts `held` pairs at a time as numbers (those with other letters as text); what is
    shuffled of them is the steps between them in order, one or two bytes each, in buckets by their first k-mer. A task that adds up holds a bucket's pairs, each
    once, and as many more. A sequence of any length takes bounded memory beside its own. letters: of texts that become sequences in the task, what each byte
    becomes and which bytes are left out, as `bytes.translate` takes them."""
    span, low = 2 * k + gap, 4**k - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(part: list[bytes]) -> pa.RecordBatch:
            codes = CODE[np.frombuffer(b"".join(part), np.uint8)]
            c = np.concatenate((codes, np.zeros(-len(codes) % 4, np.uint8))).reshape(-1, 4)
            c = c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()]), pa.array([np.array([len(t) for t in part], np.int64).tobytes()]), pa.nulls(1, pa.string())], ["c", "m", "t"])

        part, size = [], 0
        for batch in batches:
            texts = [t.encode() for t in batch["seq"].to_pylist() if t]
            texts = [t.translate(*letters) for t in texts] if letters else texts
            odd = [t.decode() for t in texts if t.translate(None, BASES.encode())]
            odd = [t for t in odd if len(t) >= span]
            if odd:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(odd), pa.binary()), pa.nulls(len(odd), pa.binary()), pa.array(odd)], ["c", "m", "t"])
            for t in texts:
                if t.translate(None, BASES.encode()):
                    continue
                for at in range(0, len(t) - span + 1, chunk):
                    part.append(t[at : at + chunk + span - 1])
                    size += len(part[-1])
                    if size >= chunk:
                        yield row(part)
                        part, size = [], 0
        if part:
            yield row(part)

    def numbers(c: pa.BinaryScalar, m: pa.BinaryScalar, t: pa.StringScalar) -> Iterator[np.ndarray]:
        if not t.is_valid:
            codes = ((np.frombuffer(c.as_buffer(), np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()
            number, at = window_numbers(codes, k)[0], 0
            for n in np.frombuffer(m.as_buffer(), np.int64).tolist():
                yield (number[at : at + n - span + 1] << 2 * k) | number[at + k + gap : at + n - k + 1]
                at += n
            return
        codes = CODE[np.frombuffer(t.as_py().encode("ascii", "replace"), np.uint8)]
        for at in range(0, len(codes) - span + 1, chunk):
            yield _pair_numbers(codes[at : at + chunk + span - 1], k, gap)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(found)
            found.clear()
            if len(x):
                b, cells = zip(*_packed_pairs(x, k))
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(cells, pa.binary()), pa.nulls(len(b), pa.string()), pa.nulls(len(b), pa.int64())], ["b", "p", "o", "n"])

        found, size = [], 0
        for batch in batches:
            for c, m, t in zip(batch["c"], batch["m"], batch["t"]):
                for x in numbers(c, m, t):
                    found.append(x)
                    size += len(x)
                    if size >= held:
                        yield from flush()
                        size = 0
                if t.is_valid:
                    t = t.as_py()
                    for at in range(0, len(t) - span + 1, chunk):
                        both = (t[i : i + k] + t[i + k + gap : i + span] for i in range(at, min(at + chunk, len(t) - span + 1)))
                        own = Counter(x for x in both if x.strip(BASES))
                        b = [zlib.crc32(x.encode()) % 2 ** min(BUCKET, 2 * k) for x in own]
                        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.nulls(len(own), pa.binary()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["b", "p", "o", "n"])
        if found:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, more, size, odd = [], [], 0, Counter()
        for batch in batches:
            for b, p, o, n in zip(batch["b"], batch["p"], batch["o"], batch["n"]):
                if o.is_valid:
                    odd[o.as_py()] += n.as_py()
                    continue
                more.append(_unpacked_pairs(b.as_py(), p.as_buffer().to_pybytes(), k))
                size += len(more[-1][0])
                if size >= max(held, len(parts[0][0]) if parts else 0):
                    parts, more, size = [_counted(parts + more)], [], 0
        if more:
            parts = [_counted(parts + more)]
        for number, n in parts:
            for at in range(0, len(number), 100_000):
                x = _mixed(number[at : at + 100_000], k, True)
                yield pa.RecordBatch.from_arrays([_spelled(x >> 2 * k, k), _spelled(x & low, k), pa.array(n[at : at + 100_000])], ["a", "b", "n"])
        if odd:
            yield pa.RecordBatch.from_arrays([pa.array([x[:k] for x in odd]), pa.array([x[k:] for x in odd]), pa.array(odd.values(), pa.int64())], ["a", "b", "n"])

    if not 0 < k < 16 or gap < 0:
        raise ValueError("k must be in 1..15, and gap no less than 0")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(seq).alias("seq")).mapInArrow(deal, "c binary, m binary, t string").repartition(tasks)
    # a bucket is a few rows, of as many bytes as the pairs of all tasks ask for
    buckets = dealt.mapInArrow(pack, "b int, p binary, o string, n long").repartition(max(tasks, 64), "b")
    return buckets.groupBy("b").applyInArrow(add, "a string, b string, n long")
