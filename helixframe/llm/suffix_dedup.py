"""Suffix-array dedup: remove every byte that a repeated string of `length` bytes covers.

Sorting all suffixes would move many times the input. Which suffixes to sort is decided by content: the anchor of the window
[i, i + length) is the place of its smallest hash of `gram` bytes, leftmost of equals, so equal windows have equal anchors at
equal offsets, and one anchor serves a run of windows. An anchor with its run is one record: the suffix that starts
at the anchor, as far as its windows reach, and what stands before it.

1. Anchors whose gram occurs once are dropped: grams meet by hash range. A task sends a gram once, so one of very many
   places is no hot key; the places of grams that repeat within the task are known there.
2. The documents with anchors left (marked in a Bloom filter of bounded size; all others are final at the scan) are dealt
   into blocks. A block sorts the suffixes of its records into runs, one for each range of grams. Records alike in suffix,
   past and windows repeat as a whole, so a run carries one of them; runs are front-coded (shared prefix length, rest) and packed.
3. The runs of a range are merged by a loser tree. Its entries hold the length of the prefix they share with the last
   winner: of two with different lengths the longer one is smaller without a look at the text, and equal lengths compare from there
   on, so no known prefix is compared again. The merged order gives each suffix its common prefix with its neighbour.
4. Suffixes that share a gram form a class. For each offset a window is repeated if another record of the class
   agrees on its right part (from the neighbours' common prefixes) and its left part (likewise, from the reversed pasts).
   Comparisons are of bytes; hashes only choose what is compared.
5. Repeated windows go back to the blocks, where runs of covered bytes are cut out.

Defined cases: a null text is an empty one; texts shorter than `length` lose nothing; repeated rows lose what they share
like any other documents, each row on its own; ids may repeat or be null; texts that overlap themselves count; texts of any length are
read whole, in pieces that overlap; an empty table gives no rows. All columns of the input are kept; a column named like a result is replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import stored
from .common import lean, shuffle_partitions, table, trim
from .exchange import batch, blocks_for, bloom, bloom_bits, in_bloom, mix, powers, range_of, raw

GRAM = 64
PIECE = 1 << 20  # bytes that are hashed at once
BLOCK = 8 << 20  # bytes of text in a block
PART_ANCHORS = 500_000  # that a task sorts at once
U8 = np.uint64
THIRD = 0x14057B7EF767814F
LONG, BIN = pa.int64(), pa.binary()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the gram that starts at each byte."""
    up, down = powers(len(data))
    letters = mix(np.arange(1, 257, dtype=U8))
    sums = np.concatenate((np.zeros(1, U8), np.cumsum(letters[data] * up)))
    return mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(U8).max, U8)
    grid = np.concatenate((x, pad)).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text number, place, first and last window start (from the place backwards) and gram hash of each anchor."""
    out = []
    todo = [(i, at, t[at : at + PIECE]) for i, t in enumerate(texts) if len(t) >= length for at in range(0, len(t) - length + 1, PIECE - length + 1)]
    while todo:
        group, size = [], 0
        while todo and (not group or size + len(todo[-1][2]) <= PIECE):
            group.append(todo.pop())
            size += len(group[-1][2])
        data = np.frombuffer(b"".join(t for *_, t in group), np.uint8)
        if len(data) < length:
            continue
        h = gram_hashes(data, gram)
        place = np.arange(len(h), dtype=U8)
        low = sliding_min((h & ~U8((1 << 22) - 1)) | place, length - gram + 1) & U8((1 << 22) - 1)
        sizes = np.array([len(t) for *_, t in group])
        ends = np.cumsum(sizes)
        for (i, base, t), end in zip(group, ends.tolist()):
            start = end - len(t)
            a = low[start : end - length + 1].astype(np.int64)
            if not len(a):
                continue
            new = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            last = np.append(new[1:], len(a)) - 1
            p = a[new]
            back = p - start
            # smallest hashes are all small: mixed again, so that ranges of them hold alike many
            out.append((np.full(len(p), i), back + base, back - new, back - last, mix(h[p], THIRD)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, U8),)
    return tuple(np.concatenate(c) for c in zip(*out))


HIT = np.dtype([("key", "<i8"), ("place", "<u4"), ("far", "u1"), ("near", "u1")])


def repeated_anchors(rows: DataFrame, ranges: int, blocks: int, length: int) -> DataFrame:
    """block, hits: the anchors (HIT records) whose gram occurs more than once."""

    def by_block(hits: np.ndarray) -> Iterator[tuple[int, bytes]]:
        if not len(hits):
            return
        block = hits["key"] % blocks
        order = np.argsort(block, kind="stable")
        hits, block = hits[order], block[order]
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(block[x]), raw(hits[x:y])

    def part(hits: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h)
        hits, h = hits[order], h[order]
        first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        again = ~first
        again[:-1] |= ~first[1:]
        for block, data in by_block(hits[again]):
            yield batch({"r": ([-1 - block], LONG), "grams": ([b""], BIN), "hits": ([data], BIN), "known": ([b""], BIN)})
        hits, known, h = hits[first], again[first], h[first]
        cut = np.searchsorted(range_of(h, ranges), np.arange(ranges + 1))
        full = [r for r in range(ranges) if cut[r] < cut[r + 1]]
        column = lambda x: ([raw(x[cut[r] : cut[r + 1]]) for r in full], BIN)
        yield batch({"r": (full, LONG), "grams": column(h), "hits": column(hits), "known": column(known)})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors in parts of bounded size."""
        found, grams, size = [], [], 0
        for b in _slices(batches):
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            key = b.column("key").to_numpy()
            text, place, far, near, h = anchors(texts, length)
            hit = np.empty(len(text), HIT)
            hit["key"], hit["place"], hit["far"], hit["near"] = key[text], place, far, near
            found.append(hit)
            grams.append(h)
            size += len(h)
            if size >= PART_ANCHORS:
                yield from part(np.concatenate(found), np.concatenate(grams))
                found, grams, size = [], [], 0
        if size:
            yield from part(np.concatenate(found), np.concatenate(grams))

    def meet(t: pa.Table) -> pa.Table:
        r = t.column("r")[0].as_py()
        if r < 0:
            return pa.table({"block": pa.array([-1 - r] * len(t), LONG), "hits": t.column("hits")})
        h = np.concatenate([np.frombuffer(x, U8) for x in t.column("grams").to_pylist()])
        hits = np.concatenate([np.frombuffer(x, HIT) for x in t.column("hits").to_pylist()])
        known = np.concatenate([np.frombuffer(x, bool) for x in t.column("known").to_pylist()])
        order = np.argsort(h)
        h, hits, known = h[order], hits[order], known[order]
        again = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        again[1:] |= same
        again[:-1] |= same
        parts = list(by_block(hits[again & ~known]))
        return pa.table({"block": pa.array([b for b, _ in parts], LONG), "hits": pa.array([x for _, x in parts], BIN)})

    asked = rows.select("key", "text").mapInArrow(lean(ask), "r long, grams binary, hits binary, known binary")
    return asked.groupBy("r").applyInArrow(meet, "block long, hits binary")


def shared(x: bytes, y: bytes, at: int = 0) -> int:
    """The length of the common prefix, known to be `at` or more."""
    n = min(len(x), len(y))
    if x[at:n] == y[at:n]:
        return n
    while at < n:
        step = min(16, n - at)
        if x[at : at + step] != y[at : at + step]:
            while x[at] == y[at]:
                at += 1
            return at
        at += step
    return n


def front_coded(texts: list[bytes]) -> tuple[bytes, bytes, bytes, list[int]]:
    """Of texts up to 255 bytes: shared lengths, rest lengths, rests; and the shared lengths as numbers."""
    before, known, rest = b"", [], []
    for t in texts:
        n = shared(before, t)
        known.append(n)
        rest.append(t[n:])
        before = t
    return bytes(known), bytes(map(len, rest)), b"".join(rest), known


def plain_texts(known: bytes, sizes: bytes, rests: bytes) -> Iterator[bytes]:
    before, at = b"", 0
    for n, size in zip(known, sizes):
        before = before[:n] + rests[at : at + size]
        at += size
        yield before


REC = np.dtype([("row", "<i4"), ("place", "<u4"), ("far", "u1"), ("near", "u1"), ("more", "?")])


class Run:
    """One sorted, front-coded run: suffix, past (reversed) and REC of each record."""

    @staticmethod
    def pack(records: list[tuple]) -> bytes:
        """records: (suffix, past, row, place, far, near, more), sorted."""
        a = front_coded([r[0] for r in records])
        b = front_coded([r[1] for r in records])
        meta = np.array([r[2:] for r in records], REC)
        parts = [*a[:3], *b[:3], raw(meta)]
        return zlib.compress(np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts), 1)

    def __init__(self, data: bytes, block: int):
        data = zlib.decompress(data)
        sizes, at, parts = np.frombuffer(data[:28], "<u4").tolist(), 28, []
        for n in sizes:
            parts.append(data[at : at + n])
            at += n
        self.block, self.known = block, parts[0]
        self.suffixes, self.pasts = plain_texts(*parts[:3]), plain_texts(*parts[3:6])
        self.meta = np.frombuffer(parts[6], REC).tolist()
        self.i = -1

    def next(self) -> tuple | None:
        """suffix, its common prefix with the one before in the run, the rest of the record."""
        self.i += 1
        if self.i == len(self.meta):
            return None
        return next(self.suffixes), self.known[self.i], (next(self.pasts), self.block, *self.meta[self.i])


def merged(runs: list[Run]) -> Iterator[tuple[bytes, int, tuple]]:
    """All records in order, each with the length of its common prefix with the one before, by a loser tree.

    heads[k] is run k's next record and prefix[k] what it shares with the last winner. A node of the tree keeps the loser.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[tuple | None] = [r.next() for r in runs] + [None] * (k - len(runs))
    prefix = [0] * k

    def beats(x: int, y: int) -> bool:
        """Whether x's head comes first. Sets what the loser shares with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return b is None and (a is not None or x < y)
        if prefix[x] != prefix[y]:
            return prefix[x] > prefix[y]  # and the loser's prefix with the winner stays what it was
        n = shared(a[0], b[0], prefix[x])
        s, t = a[0], b[0]
        first = x < y if n == len(s) == len(t) else n == len(s) or (n < len(t) and s[n] < t[n])
        prefix[y if first else x] = n
        return first

    tree = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        x, y = build(2 * node), build(2 * node + 1)
        if not beats(x, y):
            x, y = y, x
        tree[node] = y
        return x

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        text, _, record = heads[winner]
        yield text, prefix[winner], record
        heads[winner] = head = runs[winner].next()
        prefix[winner] = head[1] if head else 0
        node = (winner + k) // 2
        while node:
            if not beats(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2


def windows_of_class(members: list[tuple], lcps: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(block, row, first, last start) of the repeated windows of one class.

    members: (suffix, (past, block, row, place, far, near, more)) in order; lcps: each with the one before.
    """
    # Records alike in everything are one, which repeats as a whole.
    kinds: dict[tuple, list[int]] = {}
    for i, (s, r) in enumerate(members):
        kinds.setdefault((s, r[0], r[4], r[5]), []).append(i)
    open_ = []
    for same in kinds.values():
        if len(same) > 1:
            for i in same:
                _, block, row, place, far, near, more = members[i][1]
                if not more:  # otherwise its block knows
                    yield block, row, place - far, place - near
        else:
            if not members[same[0]][1][6]:
                open_.append(same[0])
    if not open_ or len(kinds) == 1:
        return
    keep = sorted(same[0] for same in kinds.values())
    lcp, low, j = [], 1 << 30, 0  # of neighbours among those kept
    for i in range(len(members)):
        if i:
            low = min(low, lcps[i])
        if j < len(keep) and keep[j] == i:
            lcp.append(0 if j == 0 else low)
            low, j = 1 << 30, j + 1
    n = len(keep)
    at = {i: k for k, i in enumerate(keep)}
    if n <= 8:
        for i in open_:
            past, block, row, place, far, near, _ = members[i][1]
            hit = set()
            for step in (-1, 1):
                low, k = 1 << 30, at[i]
                while 0 <= (m := k + step) < n:
                    low = min(low, lcp[k] if step < 0 else lcp[m])
                    k = m
                    other = members[keep[m]][1]
                    hit.update(range(max(near, other[5], length - low), min(far, other[4], shared(past, other[0])) + 1))
            yield from spans(block, row, place, hit)
        return
    lefts = [members[i][1][0] for i in keep]
    order = sorted(range(n), key=lefts.__getitem__)
    lcs = np.array([0, *(shared(lefts[x], lefts[y]) for x, y in zip(order, order[1:]))])
    lcp_, rank = np.array(lcp), np.empty(n, np.int64)
    rank[order] = np.arange(n)
    far_, near_ = np.array([members[i][1][4] for i in keep]), np.array([members[i][1][5] for i in keep])
    hits: list[set] = [set() for _ in range(n)]
    for o in range(int(near_.min()), int(far_.max()) + 1):
        right = np.cumsum(lcp_ < length - o)
        left = np.cumsum(lcs < o)[rank]
        live = (near_ <= o) & (o <= far_)
        _, inverse, count = np.unique(np.where(live, right * (n + 2) + left, -1), return_inverse=True, return_counts=True)
        for k in np.flatnonzero(live & (count[inverse] > 1)).tolist():
            hits[k].add(o)
    for i in open_:
        _, block, row, place, *_ = members[i][1]
        yield from spans(block, row, place, hits[at[i]])


def spans(block: int, row: int, place: int, offsets: set[int]) -> Iterator[tuple[int, int, int, int]]:
    """Runs of window starts place - o."""
    s = sorted(place - o for o in offsets)
    i = 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and s[j + 1] == s[j] + 1:
            j += 1
        yield block, row, s[i], s[j]
        i = j + 1


def _ordered(t: pa.Table) -> pa.Table:
    """A block's rows in an order that doesn't depend on how they came."""
    texts = t.column("text").cast(pa.large_binary()).to_pylist()
    keys = t.column("key").to_pylist()
    return t.take(sorted(range(len(t)), key=lambda i: (keys[i], texts[i] or b"")))


def repeats(texts: DataFrame, hits: DataFrame, ranges: int, length: int, gram: int = GRAM) -> DataFrame:
    """block, row (its number in _ordered()), first, last: runs of starts of repeated windows."""

    def sort(t: pa.Table, hit_rows: pa.Table) -> pa.Table:
        t = _ordered(t)
        data = [x or b"" for x in t.column("text").cast(pa.large_binary()).to_pylist()]
        rows: dict[int, list[int]] = {}
        for i, k in enumerate(t.column("key").to_pylist()):
            rows.setdefault(k, []).append(i)
        block = t.column("block")[0].as_py() if len(t) else 0
        by: dict[int, list[tuple]] = {}
        seen_hits = [np.frombuffer(x, HIT) for x in hit_rows.column("hits").to_pylist()]
        for key, place, far, near in (np.unique(np.concatenate(seen_hits)).tolist() if seen_hits else []):
            for i in rows.get(key, ()):
                d = data[i]
                if place - far >= 0 and place - near + length <= len(d):
                    g = d[place : place + gram]
                    by.setdefault(zlib.crc32(g) * ranges >> 32, []).append((d[place : place + length - near], d[place - far : place][::-1], far, near, i, place))
        done: list[tuple[int, int, int]] = []
        out_r, out_data = [], []
        for r, records in by.items():
            records.sort()
            run, i = [], 0
            while i < len(records):
                j = i
                while j + 1 < len(records) and records[j + 1][:4] == records[i][:4]:
                    j += 1
                if j > i:
                    done += [(row, place - far, place - near) for _, _, far, near, row, place in records[i : j + 1]]
                s, past, far, near, row, place = records[i]
                run.append((s, past, row, place, far, near, j > i))
                i = j + 1
            out_r.append(r)
            out_data.append(Run.pack(run))
        n = len(out_r)
        d = np.array(done, np.int64).reshape(-1, 3)
        del by, done, data
        trim()
        return pa.table({"r": pa.array([*out_r, -1 - block], LONG), "block": pa.array([block] * (n + 1), LONG), "data": pa.array([*out_data, raw(d)], BIN)})

    def merge(t: pa.Table) -> pa.Table:
        if t.column("r")[0].as_py() < 0:  # what a block found by itself
            return pa.table({"block": t.column("block"), "data": t.column("data")})
        order = np.argsort(np.array(t.column("block").to_pylist()), kind="stable").tolist()
        blocks, packed = t.column("block").to_pylist(), t.column("data").to_pylist()
        out: dict[int, list[tuple[int, int, int]]] = {}
        members: list[tuple] = []
        lcps: list[int] = []

        def flush() -> None:
            if len(members) > 1:
                for block, row, first, last in windows_of_class(members, lcps, length):
                    out.setdefault(block, []).append((row, first, last))
            members.clear()
            lcps.clear()

        for text, known, record in merged([Run(packed[i], blocks[i]) for i in order]):
            if known < gram:
                flush()
            members.append((text, record))
            lcps.append(known)
        flush()
        del packed
        trim()
        return pa.table({"block": pa.array(list(out), LONG), "data": pa.array([raw(np.array(x, np.int64)) for x in out.values()], BIN)})

    runs = texts.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(sort, "r long, block long, data binary")
    return runs.groupBy("r").applyInArrow(merge, "block long, data binary")


def _cut(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[list[bytes], int, int]:
    """The pieces that remain, removed bytes and removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    lo = hi = -1
    for first, last in [*sorted(starts), (1 << 62, 1 << 62)]:
        if first > hi:
            if hi > 0:
                kept.append(text[at:lo])
                removed, runs, at = removed + hi - lo, runs + 1, hi
            lo, hi = first, last + length
        else:
            hi = max(hi, last + length)
    kept.append(text[at:])
    return kept, removed, runs


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, keep: str | None = "binary") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept in place of the text: its bytes (binary), a string without
    the characters of which a byte is gone (string), or nothing (None)."""
    if length <= GRAM or length - GRAM > 255 or length > 255:
        raise ValueError(f"length must be in {GRAM + 1}..255")
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    extra = [c for c in docs.columns if c != text and c not in results]
    parts = shuffle_partitions(docs.sparkSession)
    # rows that share an id, null ones say, are kept apart by their texts
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in extra]).alias("other"))
    total = docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = blocks_for(total, parts, BLOCK)
    ranges = max(parts, total // (32 << 20))
    hits = stored(repeated_anchors(rows, ranges, blocks, length), small=True)
    owners = hits.mapInArrow(lean(_owners), "key long")
    words, size = bloom(owners.distinct(), "key")
    known = docs.sparkSession.sparkContext.broadcast(words)  # of bounded size
    marked = rows.withColumn("bits", bloom_bits(F.col("key"), size))
    other = marked.schema["other"].dataType
    text_kind = marked.schema["text"].dataType.simpleString()
    shape = f"key long, text {text_kind}, other {other.simpleString()}"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield b.filter(pa.array(in_bloom(known.value, b.column("bits")))).select(["key", "text", "other"])

    made = f"other {other.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {keep or 'binary'}"
    # of a character that was cut, what is left must not meet the rest of another one
    form = {"binary": b"".join, "string": lambda k: "".join(x.decode("utf-8", "ignore") for x in k), None: lambda k: None}[keep]
    kind = pa.string() if keep == "string" else BIN

    def result(other: pa.Array, found: list[tuple[int, list[bytes], int, int]]) -> dict:
        return {
            "other": other, "n_bytes": pa.array([n for n, *_ in found], LONG), "n_removed": pa.array([x for _, _, x, _ in found], LONG), "n_spans": pa.array([x for *_, x in found], LONG),
            "kept_sha256": pa.array([hashlib.sha256(b"".join(k)).hexdigest() for _, k, *_ in found], pa.string()), "kept": pa.array([form(k) for _, k, *_ in found], kind),
        }

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            b = b.filter(pa.array(~in_bloom(known.value, b.column("bits"))))
            texts = [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict(result(b.column("other"), [(len(t), [t], 0, 0) for t in texts]))

    def cut(t: pa.Table, found: pa.Table) -> pa.Table:
        t = _ordered(t)
        spans_of: dict[int, list[tuple[int, int]]] = {}
        for x in found.column("data").to_pylist():
            for row, first, last in np.frombuffer(x, np.int64).reshape(-1, 3).tolist():
                spans_of.setdefault(row, []).append((first, last))
        texts = [x or b"" for x in t.column("text").cast(pa.large_binary()).to_pylist()]
        return pa.table(result(t.column("other"), [(len(x), *_cut(x, spans_of.get(i, []), length)) for i, x in enumerate(texts)]))

    block = lambda d: d.withColumn("block", F.pmod("key", F.lit(blocks)))
    live = block(marked.mapInArrow(lean(pick), shape)).repartition(blocks, "block")
    found = stored(repeats(live.select("block", "key", "text"), hits, ranges, length), small=True)
    done = live.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, made)
    out = marked.mapInArrow(lean(final), made).union(done)
    return out.select(*[F.col("other")[c].alias(c) for c in extra], *results[: 5 if keep else 4])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = [np.frombuffer(x, HIT)["key"] for x in b.column("hits").to_pylist()]
        if hits:
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.unique(np.concatenate(hits)))})


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=None)
