"""Suffix arrays, Burrows-Wheeler transform and exact, approximate and shared patterns.

Many patterns against many texts is a join on k-mers. Suffix arrays of single texts are built by prefix doubling in numpy, in parallel over
texts; `suffix_array_distributed` does the same with DataFrames for a text too long for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .automaton import Automaton
from .index import Suffixes, Tree
from .kmers import hamming, kmers
from .lineage import checkpoint, stored


def suffix_order(text: str) -> np.ndarray:
    """Start places of the suffixes in order."""
    return Suffixes([text]).order[1:]


def _udf(f, kind: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def suffix_arrays(df: DataFrame, seq: str = "seq") -> DataFrame:
    """df with sa, an array of places."""
    return df.withColumn("sa", _udf(suffix_order, "array<long>")(seq))


def suffix_array_distributed(text: DataFrame) -> DataFrame:
    """pos, rank for one text given as (pos, ch): log2(n) rounds of a join and a sort, dealt by rank so that no round is one task."""
    letters = text.select("ch").distinct().orderBy("ch").collect()  # an alphabet
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(letters) for x in (r["ch"], i)])
    ranked = checkpoint(text.select("pos", rank[F.col("ch")].cast("long").alias("rank")))
    n, k = ranked.count(), 1
    while True:
        ahead = ranked.select((F.col("pos") - k).alias("pos"), F.col("rank").alias("second"))
        pairs = ranked.join(ahead, "pos", "left").withColumn("second", F.coalesce("second", F.lit(-1)))
        counts = pairs.groupBy("rank", "second").count()
        # a pair's new rank: rows of smaller first ranks, then of smaller seconds within
        totals = counts.groupBy("rank").agg(F.sum("count").alias("t"))
        first = _running(totals, "rank", "t")
        within = F.coalesce(F.sum("count").over(Window.partitionBy("rank").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = counts.withColumn("within", within).join(first, "rank").select("rank", "second", (F.col("before") + F.col("within")).alias("new"))
        ranked = checkpoint(pairs.join(new, ["rank", "second"]).select("pos", F.col("new").alias("rank")))
        if ranked.select("rank").distinct().count() == n:
            return ranked
        k *= 2


def _running(totals: DataFrame, key: str, value: str, width: int = 1 << 16) -> DataFrame:
    """Sums before each key, in two levels: within ranges of keys, and over the ranges."""
    t = totals.withColumn("_b", (F.col(key) / width).cast("long"))
    blocks = t.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_o", before("_s", Window.partitionBy(F.lit(0)).orderBy("_b"))).drop("_s")
    return t.withColumn("_w", before(value, Window.partitionBy("_b").orderBy(key))).join(blocks, "_b").select(key, (F.col("_o") + F.col("_w")).alias("before"))


def bwt(text: str) -> str:
    """The last letters of the rotations in order; equal rotations keep their place."""
    n = len(text)
    period = (text + text).find(text, 1) if n else 0  # rotations that far apart are equal
    unit = text[:period]
    twice = np.empty(2 * period, np.int64)
    twice[suffix_order(unit + unit)] = np.arange(2 * period)
    order = np.argsort(twice[:period], kind="stable")
    return "".join(text[i - 1] for i in (order[:, None] + np.arange(0, n, max(period, 1))).ravel().tolist())


def burrows_wheeler(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn("bwt", _udf(bwt, "string")(seq))


def inverse_bwt(last: str) -> str:
    """The text whose smallest letter $ ends it."""
    first = np.argsort(np.frombuffer(last.encode("utf-32-le"), np.uint32), kind="stable")
    out, i = [], first[0]
    for _ in range(len(last)):
        out.append(last[i])
        i = first[i]
    return "".join(out[1:] + out[:1])


PATTERNS = 100_000  # patterns that are sent to executors; more are joined
CELLS = 1 << 23  # of the automaton that is sent, 32 MB


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n codes."""
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(h)].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def exact_matches(texts: DataFrame, patterns: DataFrame, by: list[str], lengths: list[int] | None = None, base: int = 0, pattern: str = "pattern", keep_zero: bool = False, seq: str = "seq") -> DataFrame:
    """by, pattern, pos of every occurrence of the patterns, of any lengths or of the given ones. With keep_zero, patterns without a hit keep a row of null place.

    Up to PATTERNS patterns, if their automaton has up to CELLS entries, are sent to the executors as that automaton; of more, texts offer
    their k-mers of each length and patterns are joined once. Either way only hits are shuffled with keep_zero, not windows. Empty and null patterns occur nowhere."""
    p = patterns.select(pattern).distinct()
    wanted = p.where(F.length(pattern) > 0)
    if lengths is not None:
        wanted = wanted.where(F.length(pattern).isin(*lengths))
    letters = F.array_size(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.split(F.col(pattern), ""))))))
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(pattern)), F.lit(0))).first()
    fits = n <= PATTERNS and size < CELLS
    if fits:
        width = (wanted.agg(letters).first()[0] or 0) + 1
        fits = (size + 1) * width <= CELLS
    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in by)
    if fits:
        sent = texts.sparkSession.sparkContext.broadcast(Automaton(sorted(r[0] for r in wanted.collect())))  # of bounded size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = sent.value
            names = pa.array(machine.patterns, pa.string())
            for b in batches:
                for part in _by_size(b, len(by)):
                    row, found, place = machine.find([t or "" for t in part.column(len(by)).to_pylist()])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(len(by))), names.take(pa.array(found)), pa.array((place + base).astype(np.int32))], [*by, pattern, "pos"])

        hits = texts.select(*by, seq).mapInArrow(run, f"{kinds}`{pattern}` string, pos int")
    else:
        grams = None
        for (k,) in wanted.select(F.length(pattern)).distinct().collect():  # lengths, not patterns
            g = kmers(texts, k, seq, by)
            grams = g if grams is None else grams.union(g)
        hits = grams.withColumnRenamed("kmer", pattern).join(wanted, pattern).select(*by, pattern, (F.col("pos") + base).cast("int").alias("pos"))
    if not keep_zero:
        return hits
    hits = stored(hits)  # read twice
    none = p.join(hits.select(pattern).distinct(), pattern, "left_anti")
    return hits.unionByName(none.select(pattern), allowMissingColumns=True).select(*by, pattern, "pos")


def _by_size(b: pa.RecordBatch, column: int, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices with about so many bytes of text."""
    ends = np.cumsum([len(x) if (x := t.as_buffer()) is not None else 0 for t in b.column(column).cast(pa.large_binary())])
    at = 0
    while at < b.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield b.slice(at, stop - at)
        at = stop


def _verified(codes: np.ndarray, row: np.ndarray, place: np.ndarray, name: np.ndarray, letters: list[np.ndarray], d: int, at_once: int = 1 << 22) -> np.ndarray:
    """Differing letters of patterns (by number) at places of the joined texts, d + 1 for more than d."""
    out = np.full(len(name), d + 1, np.int32)
    order = np.argsort(name, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(name[order]) != 0, [True])))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = letters[int(name[order[a]])]
        step = max(1, at_once // len(own))
        for k in range(a, z, step):
            i = order[k : min(z, k + step)]
            out[i] = np.minimum((codes[(row[i] + place[i])[:, None] + np.arange(len(own))] != own).sum(1), d + 1)
    return out


def near_matches(texts: DataFrame, patterns: DataFrame, d: int, by: list[str], name: str = "item_id", pattern: str = "pattern", seq: str = "seq") -> DataFrame:
    """by, name, pos (from 0), mismatches: places inside a text where a pattern, of any length above d, stands with at most d letters changed.

    Of d + 1 pieces of a pattern one must occur as it is. The pieces of all patterns are found by one automaton, which is sent to executors along with
    the patterns, and what they point at is compared where the text is: nothing is shuffled. Patterns that are too many for that (PATTERNS,
    CELLS) are joined by their pieces; texts must then be told apart by `by`. Shorter and null patterns occur nowhere; equal patterns of different names each count."""
    p = patterns.select(F.col(name).alias("name"), F.col(pattern).alias("pattern")).where(F.length("pattern") > d)
    count, size = p.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    cut = lambda n, i: F.floor(n * F.lit(i) / F.lit(d + 1)).cast("int")
    n = F.length("pattern")
    if count > PATTERNS or size * 8 > CELLS:
        piece = F.explode(F.array(*[F.struct(F.substring("pattern", cut(n, i) + 1, cut(n, i + 1) - cut(n, i)).alias("piece"), cut(n, i).alias("shift")) for i in range(d + 1)]))
        pieces = p.select("name", "pattern", piece.alias("x")).select("name", "pattern", "x.piece", "x.shift")
        hits = exact_matches(texts, pieces, by, pattern="piece", seq=seq).join(pieces, "piece")
        found = hits.select(*by, "name", "pattern", (F.col("pos") - F.col("shift")).alias("pos")).where("pos >= 0").distinct()
        found = found.join(texts.select(*by, F.col(seq).alias("_seq")), by).where(F.col("pos") + F.length("pattern") <= F.length("_seq"))
        wrong = hamming(F.substring(F.col("_seq"), F.col("pos") + 1, F.length("pattern")), F.col("pattern"))
        return found.select(*by, F.col("name").alias(name), "pos", wrong.alias("mismatches")).where(F.col("mismatches") <= d)
    rows = sorted(map(tuple, p.collect()), key=repr)  # PATTERNS at most
    letters = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for _, x in rows]
    of: dict[str, list[tuple[int, int]]] = {}
    for k, (_, x) in enumerate(rows):
        for i in range(d + 1):
            a, z = i * len(x) // (d + 1), (i + 1) * len(x) // (d + 1)
            of.setdefault(x[a:z], []).append((k, a))
    machine = Automaton(sorted(of))
    owners = [np.array(of[x], np.int64) for x in machine.patterns]
    first = np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64)
    flat = np.concatenate([*owners, np.empty((0, 2), np.int64)])
    sizes = np.array([len(x) for x in letters], np.int64)
    kind = patterns.schema[name].dataType
    sent = texts.sparkSession.sparkContext.broadcast((machine, first, flat, letters, sizes, [k for k, _ in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, first, flat, letters, sizes, names = sent.value
        for b in batches:
            for part in _by_size(b, len(by)):
                own = [t or "" for t in part.column(len(by)).to_pylist()]
                row, piece, place = machine.find(own)
                many = first[piece + 1] - first[piece]
                at = np.repeat(first[piece] - np.cumsum(many) + many, many) + np.arange(many.sum())
                row, k, place = np.repeat(row, many), flat[at, 0], np.repeat(place, many) - flat[at, 1]
                long = np.array([len(t) for t in own], np.int64)
                fits = (place >= 0) & (place + sizes[k] <= long[row]) if len(k) else np.zeros(0, bool)
                each = np.unique(np.stack((row[fits], place[fits], k[fits]), axis=1), axis=0)
                row, place, k = each.T
                codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
                wrong = _verified(codes, (np.cumsum(long) - long)[row], place, k, letters, d)
                good = wrong <= d
                take = pa.array(row[good])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(len(by))), pa.array([names[i] for i in k[good].tolist()], to_arrow_type(kind)), pa.array(place[good].astype(np.int32)), pa.array(wrong[good])], [*by, name, "pos", "mismatches"])

    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in by)
    return texts.select(*by, seq).mapInArrow(run, f"{kinds}`{name}` {kind.simpleString()}, pos int, mismatches int")


def suffix_array_find(text: str, order: np.ndarray, pattern: str) -> list[int]:
    """Places (from 1) by binary search over the sorted suffixes; none if the pattern sorts past them all."""
    n = len(pattern)

    def bound(after: bool) -> int:
        lo, hi = 0, len(order)
        while lo < hi:
            mid = (lo + hi) // 2
            part = text[order[mid] : order[mid] + n]
            if part < pattern or (after and part == pattern):
                lo = mid + 1
            else:
                hi = mid
        return lo

    return sorted(int(x) + 1 for x in order[bound(False) : bound(True)])


def suffix_array_matches(texts: DataFrame, pattern: str, seq: str = "seq") -> DataFrame:
    return texts.withColumn("places", _udf(lambda t: suffix_array_find(t, suffix_order(t), pattern), "array<long>")(seq))


def trie(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """node, parent, ch, ends: the distinct prefixes, and whether a pattern ends there."""
    p = patterns.select(F.col(pattern).alias("p")).distinct().where("length(p) > 0")
    pre = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p")), lambda i: F.struct(F.left("p", i).alias("node"), (i == F.length("p")).alias("e")))).alias("x"))
    nodes = pre.groupBy("x.node").agg(F.max("x.e").alias("ends"))
    return nodes.select("node", F.left("node", F.length("node") - 1).alias("parent"), F.right("node", F.lit(1)).alias("ch"), "ends")


def _near(text: str, length: int, d: int, tables: list[tuple], letters: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places and pattern numbers within distance d. tables: first and last place of a piece, its sorted hashes, their patterns."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - length + 1
    found = [np.empty(0, np.int64)]
    if n > 0 and len(letters):
        windows = np.lib.stride_tricks.sliding_window_view(codes, length)
        for a, b, hashes, own in tables:
            h = _rolling(codes, b - a)[a : a + n] if b > a else np.zeros(n, np.uint64)
            low, size = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            size -= low
            part = np.cumsum(size) // at_once  # so many comparisons at a time
            for k in np.unique(part).tolist():
                i = np.flatnonzero(part == k)
                place = np.repeat(i, size[i])
                pattern = own[np.repeat(low[i] - np.cumsum(size[i]) + size[i], size[i]) + np.arange(size[i].sum())]
                hit = (windows[place] != letters[pattern]).sum(1) <= d
                found.append(np.unique(place[hit] * len(letters) + pattern[hit]))
    both = np.unique(np.concatenate(found))
    return both // max(1, len(letters)), both % max(1, len(letters))


def approximate_matches(texts: DataFrame, patterns: DataFrame, length: int, d: int, by: list[str], seq: str = "seq", pattern: str = "pattern") -> DataFrame:
    """by, pattern, pos (from 0): places within Hamming distance d of patterns of one length.

    Of d + 1 pieces of a pattern one must occur as it is, so texts and patterns meet on pieces and are compared there only: on the
    executors, to which up to PATTERNS patterns are sent, or in a join on pieces if there are more."""
    cut = [i * length // (d + 1) for i in range(d + 2)]
    p = patterns.select(pattern).distinct().where(F.length(pattern) == length)
    own = sorted(r[0] for r in p.limit(PATTERNS + 1).collect())
    if len(own) <= PATTERNS:
        letters = np.array([np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in own], np.uint32).reshape(len(own), length)
        tables = []
        for a, b in zip(cut, cut[1:]):
            hashes = np.array([_rolling(x[a:b], b - a)[0] if b > a else 0 for x in letters], np.uint64)
            order = np.argsort(hashes, kind="stable")
            tables.append((a, b, hashes[order], order))
        sent = texts.sparkSession.sparkContext.broadcast((tables, letters, pa.array(own, pa.string())))  # of PATTERNS patterns at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, letters, names = sent.value
            for b in batches:
                hits = [_near(t or "", length, d, tables, letters) for t in b.column(len(by)).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(hits)), [len(x) for x, _ in hits]))
                place, number = (np.concatenate([x[k] for x in hits] or [np.empty(0, np.int64)]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in range(len(by))), names.take(pa.array(number)), pa.array(place.astype(np.int32))], [*by, pattern, "pos"])

        kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in by)
        return texts.select(*by, seq).mapInArrow(run, f"{kinds}`{pattern}` string, pos int")
    pieces = lambda c: F.array(*[F.struct(F.lit(n).alias("piece"), F.substring(F.col(c), a + 1, b - a).alias("part")) for n, (a, b) in enumerate(zip(cut, cut[1:]))])
    windows = kmers(texts, length, seq, by).withColumnRenamed("kmer", "w")
    hits = windows.select(*by, "pos", "w", F.inline(pieces("w"))).join(p.select(pattern, F.inline(pieces(pattern))), ["piece", "part"])
    return hits.where(hamming(F.col("w"), F.col(pattern)) <= d).select(*by, pattern, "pos").distinct()


def longest_repeat(text: str) -> str:
    """The longest substring that occurs twice: the deepest inner node of the suffix tree; of several, the one a depth-first walk of the suffix trie meets first,
    its children in order of insertion, suffixes inserted from the longest on."""
    found = {text[a : a + n] for _, a, n in Tree([text]).deepest()}
    return min(found, key=lambda s: [text.find(s[: k + 1]) for k in range(len(s))], default="")


def longest_shared(a: str, b: str) -> str:
    """The longest substring of both, ties as above with the first text inserted first."""
    texts = [a, b]
    found = {texts[t][i : i + n] for t, i, n in Tree(texts).deepest(shared=True)}
    return min(found, key=lambda s: [a.find(s[: k + 1]) for k in range(len(s))], default="")


def shortest_unshared(a: str, b: str) -> str | None:
    """The shortest substring of a that isn't in b; ties to the earliest."""
    found = Tree([a, b]).unshared(0)
    return a[found[1] : found[1] + found[2]] if found else None


def repeats(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn("repeat", _udf(longest_repeat, "string")(seq))


def shared_substrings(pairs: DataFrame, v: str = "v", w: str = "w") -> DataFrame:
    """pairs with shared (longest in both) and unshared (shortest in v only)."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(longest_shared(x, y), shortest_unshared(x, y)) for x, y in zip(a, b)], columns=["shared", "unshared"])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return pairs.withColumn("_s", F.pandas_udf(run, "struct<shared:string,unshared:string>")(v, w)).select("*", "_s.shared", "_s.unshared").drop("_s")


def prefix_colours(df: DataFrame, length: int, by: list[str], source: str = "source", seq: str = "seq") -> DataFrame:
    """by, kmer, colour: whether substrings of one length come from source 1 (blue), 2 (red) or both (purple)."""
    seen = kmers(df, length, seq, [*by, source]).groupBy(*by, "kmer").agg(F.min(source).alias("a"), F.max(source).alias("b"))
    return seen.select(*by, "kmer", F.when(F.col("a") != F.col("b"), "purple").when(F.col("a") == 1, "blue").otherwise("red").alias("colour"))
