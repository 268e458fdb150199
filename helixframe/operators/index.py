"""Indexes over many texts: suffix arrays with common prefixes, FM-indexes searched backwards, generalised suffix trees.

Texts that a task holds are indexed together. Each is followed by an end mark of its own, smaller than all letters and in the order of the texts, so no
match and no common prefix reaches from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import codes_of

STEP, RATE = 32, 8  # letters between two checkpoints; places of a text between two samples
PATTERNS = 100_000  # that are sent to executors at a time
BLOCK = 4 << 20  # letters that are indexed together, unless one text is longer


class Suffixes:
    """letters: the alphabet; codes: texts as numbers from 1, 0 for ends; end: of each place's text; order: sorted places, ends first."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.letters, found = np.unique(codes_of("".join(texts)), return_inverse=True)
        n = int((sizes + 1).sum())
        stop = self.starts + sizes
        self.codes = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[stop] = False
        self.codes[inside] = found.reshape(-1) + 1
        self.end = np.repeat(stop, sizes + 1)
        self.bits = max(1, int(len(self.letters)).bit_length())
        self.wide = 60 // self.bits  # letters in one key
        self.key = self.keys()
        self.order = self.sorted()

    def keys(self) -> np.ndarray:
        """The next `wide` letters as one number, 0 behind the end."""
        n = len(self.codes)
        key, at = np.zeros(n, np.int64), np.arange(n)
        for j in range(self.wide):
            key <<= self.bits
            if j < n:
                key[: n - j] |= np.where(at[: n - j] + j < self.end[: n - j], self.codes[j:], 0)
        return key

    def sorted(self) -> np.ndarray:
        """Prefix doubling from the keys on; in each round only places that are not alone in their rank are sorted."""
        n, h = len(self.codes), self.wide
        order = np.argsort(self.key, kind="stable")
        k, whole = self.key[order], (self.end - np.arange(n))[order] < h
        new = np.ones(n, bool)
        new[1:] = (k[1:] != k[:-1]) | whole[1:]  # one that has ended is in the order of its text
        slot = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, slot, 0))
        while True:
            alone = new & np.append(new[1:], True)
            slot, new = slot[~alone], new[~alone]
            if not len(slot):
                return order
            place = order[slot]
            own, second = rank[place], rank[place + h]
            by = np.lexsort((second, own))
            place, own, second = place[by], own[by], second[by]
            order[slot] = place
            new = np.ones(len(slot), bool)
            new[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
            rank[place] = np.maximum.accumulate(np.where(new, slot, 0))
            h *= 2

    def common(self) -> np.ndarray:
        """How many letters each suffix in order has in common with the one before it, compared key by key."""
        n, wide = len(self.order), self.wide
        out, k = np.zeros(n, np.int64), np.arange(1, n)
        at = 0
        while len(k):
            x, y = self.order[k - 1] + at, self.order[k] + at
            left = np.minimum(self.end[x] - x, self.end[y] - y)
            differ = self.key[x] ^ self.key[y]
            high = differ >> 30
            length = np.where(high > 0, 30 + np.frexp(high.astype(float))[1], np.frexp((differ & (1 << 30) - 1).astype(float))[1])
            same = np.where(differ == 0, wide, wide - 1 - (length - 1) // self.bits)
            out[k] += np.minimum(same, left)
            k = k[(differ == 0) & (left >= wide)]
            at += wide
        return out


class FMIndex:
    """The transform of the texts with checkpoints of letter counts, and sampled places, as arrays that travel in a row."""

    def __init__(self, **parts):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, texts: list[str]) -> FMIndex:
        s = Suffixes(texts)
        bwt = s.codes[s.order - 1]
        small = np.uint8 if len(s.letters) < 256 else np.uint32
        kinds = len(s.letters) + 1
        first = np.concatenate(([0], np.cumsum(np.bincount(s.codes, minlength=kinds))))[:kinds]
        padded = np.concatenate((bwt, np.full(-len(bwt) % STEP, -1)))
        rows = padded.reshape(-1, STEP)
        counts = np.zeros((len(rows) + 1, kinds), np.int32)
        for c in range(kinds):
            counts[1:, c] = np.cumsum((rows == c).sum(1))
        offset = s.order - s.starts[np.searchsorted(s.starts, s.order, "right") - 1] if len(s.order) else s.order
        marked = np.flatnonzero(offset % RATE == 0)  # the start of a text among them, so no walk leaves its text
        return cls(letters=s.letters, starts=s.starts, first=first, bwt=bwt.astype(small), counts=counts, marked=marked.astype(np.int32), places=s.order[marked].astype(np.int32))

    def rank(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the letter stand before each row: the last checkpoint and the letters since."""
        out = self.counts[row // STEP, letter].astype(np.int64)
        if not hasattr(self, "padded"):
            self.padded = np.concatenate((self.bwt, np.zeros(STEP, self.bwt.dtype)))
        for a in range(0, len(row), 1 << 16):
            r, c = row[a : a + (1 << 16)], letter[a : a + (1 << 16)]
            base = r - r % STEP
            at = np.arange(STEP)
            out[a : a + (1 << 16)] += ((self.padded[base[:, None] + at] == c[:, None]) & (at < (r - base)[:, None])).sum(1)
        return out

    def search(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the rows of the suffixes that begin with it, from and up to: all patterns go backwards together."""
        sizes = np.array([len(p) for p in patterns], np.int64)
        flat = codes_of("".join(patterns))
        at = np.minimum(np.searchsorted(self.letters, flat), max(0, len(self.letters) - 1))
        known = self.letters[at] == flat if len(self.letters) else np.zeros(len(flat), bool)
        code, ends = np.where(known, at + 1, -1), np.cumsum(sizes)
        lo, hi = np.zeros(len(patterns), np.int64), np.where(sizes > 0, len(self.bwt), 0)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero((sizes >= t) & (lo < hi))
            c = code[ends[live] - t]
            hi[live[c < 0]] = lo[live[c < 0]]
            live, c = live[c >= 0], c[c >= 0]
            both = self.first[np.tile(c, 2)] + self.rank(np.tile(c, 2), np.concatenate((lo[live], hi[live])))
            lo[live], hi[live] = both[: len(live)], both[len(live) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and place in it of suffixes, by steps back through the transform to a sampled one."""
        place, walk, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(walk):
            at = np.minimum(np.searchsorted(self.marked, row), len(self.marked) - 1)
            hit = self.marked[at] == row
            place[walk[hit]] = self.places[at[hit]] + steps
            walk, row = walk[~hit], row[~hit]
            letter = self.bwt[row].astype(np.int64)
            row = self.first[letter] + self.rank(letter, row)
            steps += 1
        text = np.searchsorted(self.starts, place, "right") - 1
        return text, place - self.starts[text]


ARRAYS = {"letters": np.uint32, "starts": np.int64, "first": np.int64, "counts": np.int32, "marked": np.int32, "places": np.int32}


def fm_index(texts: DataFrame, by: list[str], seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """A row for each block of texts: their `by` values (keys), and the index's arrays. Store it to search it more than once; for sequences of ACGT it
    takes some 2.6 bytes a letter (1 for the transform, 0.6 for checkpoints, 1 for samples). Null texts are empty ones. A text longer than a block is one by itself."""
    keys = F.struct(*by).alias("key")
    kind = texts.select(keys).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size = [], [], 0

        def row() -> pa.RecordBatch:
            index = FMIndex.build(own)
            key = pa.concat_arrays(held)
            parts = [pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), *(pa.array([np.ascontiguousarray(getattr(index, n), t).tobytes()], pa.binary()) for n, t in ARRAYS.items())]
            return pa.RecordBatch.from_arrays([*parts, pa.array([index.bwt.tobytes()], pa.binary())], ["keys", *ARRAYS, "bwt"])

        for b in batches:
            for i, t in enumerate(b.column("seq").to_pylist()):
                if own and size + len(t or "") > block:
                    yield row()
                    held, own, size = [], [], 0
                held.append(b.column("key").slice(i, 1))
                own.append(t or "")
                size += len(t or "") + 1
        if own:
            yield row()

    return texts.select(keys, F.col(seq).alias("seq")).mapInArrow(run, f"keys array<{kind}>, " + ", ".join(f"{n} binary" for n in [*ARRAYS, "bwt"]))


def _opened(row: dict) -> FMIndex:
    parts = {n: np.frombuffer(row[n], t) for n, t in ARRAYS.items()}
    kinds = len(parts["letters"]) + 1
    parts["counts"] = parts["counts"].reshape(-1, kinds)
    return FMIndex(**parts, bwt=np.frombuffer(row["bwt"], np.uint8 if kinds <= 256 else np.uint32))


def fm_search(index: DataFrame, patterns: DataFrame, pattern: str = "pattern", base: int = 0, at_once: int = PATTERNS, hits: int = 1 << 18) -> DataFrame:
    """The columns of keys, pattern and pos of every occurrence. Patterns are sent to the executors, `at_once` at a time: more of them take as many more
    passes over the index. A task locates so many hits at a time. Empty and null patterns occur nowhere."""
    p = patterns.select(F.col(pattern).alias("p")).where(F.length(pattern) > 0).distinct()
    parts = max(1, -(-p.count() // at_once)) if at_once < 1 << 40 else 1
    own = index.schema["keys"].dataType.elementType
    names = own.fieldNames()
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)
    found = None
    for part in range(parts):
        some = sorted(r["p"] for r in p.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part).collect())
        sent = index.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words = pa.array(sent.value, pa.string())
            for b in batches:
                for i in range(b.num_rows):
                    fm = _opened({n: b.column(n)[i].as_buffer() for n in [*ARRAYS, "bwt"]})
                    key = b.column("keys")[i].values
                    lo, hi = fm.search(sent.value)
                    live = np.flatnonzero(lo < hi)
                    lo, many = lo[live], (hi - lo)[live]
                    cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 1, hits)).tolist() + [len(live)]
                    for x, y in zip(cuts, cuts[1:]):
                        m = many[x:y]
                        rows = np.repeat(lo[x:y] - np.cumsum(m) + m, m) + np.arange(m.sum())
                        text, place = fm.locate(rows)
                        k = key.take(pa.array(text))
                        yield pa.RecordBatch.from_arrays([*(k.field(n) for n in names), words.take(pa.array(np.repeat(live[x:y], m))), pa.array((place + base).astype(np.int32))], [*names, pattern, "pos"])

        more = index.mapInArrow(run, f"{kinds}`{pattern}` string, pos int")
        found = more if found is None else found.unionAll(more)
    return found


def occurrences(index: DataFrame) -> DataFrame:
    """The columns of keys, rank, ch and occ of blocks of one text: the transform letter by letter ($ for the end), and how often the letter stands up to
    and with this place, by checkpoints."""
    own = index.schema["keys"].dataType.elementType
    names = own.fieldNames()
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                fm = _opened({n: b.column(n)[i].as_buffer() for n in [*ARRAYS, "bwt"]})
                spelled = pa.array(["$", *map(chr, fm.letters.tolist())], pa.string())
                key = b.column("keys")[i].values
                for a in range(0, len(fm.bwt), 1 << 16):
                    letter = fm.bwt[a : a + (1 << 16)].astype(np.int64)
                    row = np.arange(a, a + len(letter))
                    k = key.take(pa.array(np.zeros(len(row), np.int64)))
                    yield pa.RecordBatch.from_arrays([*(k.field(n) for n in names), pa.array(row.astype(np.int32)), spelled.take(pa.array(letter)), pa.array(fm.rank(letter, row + 1))], [*names, "rank", "ch", "occ"])

    return index.mapInArrow(run, f"{kinds}rank int, ch string, occ long")


class Tree:
    """The tree of all suffixes of some texts, from the suffix array and the common prefixes by one pass with a stack.

    Nodes 0.. are the inner ones (0 the root), then one leaf for each suffix in order. Of each node: parent, depth (letters from the root), leaves, least
    and largest source, and the first suffix below it by (text, place)."""

    def __init__(self, texts: list[str], sources: list[int] | None = None):
        s = Suffixes(texts)
        empty = len(texts)
        self.s, place = s, s.order[empty:]  # the ends come first
        n = len(place)
        lcp = s.common()[empty:].tolist()
        depth, low, high, parent, stack, over = [0], [0], [n], [-1], [0], [0] * n
        for k in range(1, n + 1):
            h = lcp[k] if k < n else 0
            top = stack[-1]
            start, pending = k - 1, -1
            while depth[stack[-1]] > h:
                v = stack.pop()
                high[v], start = k, low[v]
                if depth[stack[-1]] >= h:
                    parent[v] = stack[-1]
                else:
                    pending = v
            if depth[stack[-1]] < h:
                stack.append(len(depth))
                depth.append(h)
                low.append(start)
                high.append(n)
                parent.append(-1)
                if pending >= 0:
                    parent[pending] = stack[-1]
            over[k - 1] = stack[-1] if h > depth[top] else top
        for x, y in zip(stack, stack[1:]):
            parent[y] = x
        self.inner = len(depth)
        text = np.searchsorted(s.starts, place, "right") - 1
        source = np.asarray(sources if sources is not None else range(len(texts)), np.int64)[text]
        self.parent = np.array(parent + over, np.int64)
        self.depth = np.concatenate((np.array(depth, np.int64), s.end[place] - place))
        self.leaves = np.concatenate((np.array(high, np.int64) - low, np.ones(n, np.int64)))
        blank = np.full(self.inner, np.iinfo(np.int64).max)
        self.least, self.most = np.concatenate((blank, source)), np.concatenate((-blank, source))
        self.place = np.concatenate((blank, place))
        by = np.argsort(-self.depth[: self.inner], kind="stable")
        np.minimum.at(self.least, self.parent[self.inner :], source)
        np.maximum.at(self.most, self.parent[self.inner :], source)
        np.minimum.at(self.place, self.parent[self.inner :], place)
        for v in by.tolist():
            if v:
                p = self.parent[v]
                self.least[p], self.most[p] = min(self.least[p], self.least[v]), max(self.most[p], self.most[v])
                self.place[p] = min(self.place[p], self.place[v])
        if not n:
            self.least[0] = self.most[0] = self.place[0] = 0
        self.text = np.searchsorted(s.starts, self.place, "right") - 1 if len(texts) else self.place
        self.start = self.place - s.starts[self.text] if len(texts) else self.place

    def deepest(self, shared: bool = False) -> list[tuple[int, int, int]]:
        """(text, place, depth) of the inner nodes of largest depth; shared: of those below which there are several sources."""
        own = np.arange(1, self.inner)
        own = own[self.least[own] != self.most[own]] if shared else own
        if not len(own):
            return []
        own = own[self.depth[own] == self.depth[own].max()]
        return [(int(self.text[v]), int(self.start[v]), int(self.depth[v])) for v in own]

    def unshared(self, source: int) -> tuple[int, int, int] | None:
        """(text, place, length) of the shortest string that only this source has, the first of equals: one letter below a node."""
        v = np.flatnonzero((self.least == source) & (self.most == source) & (self.parent >= 0))
        length = self.depth[self.parent[v]] + 1
        v, length = v[self.depth[v] >= length], length[self.depth[v] >= length]
        if not len(v):
            return None
        best = np.lexsort((self.place[v], length))[0]
        return int(self.text[v[best]]), int(self.start[v[best]]), int(length[best])


def suffix_tree(texts: DataFrame, by: list[str], source: str = "source", seq: str = "seq", labels: bool = False) -> DataFrame:
    """The generalised suffix tree of each group's texts as a table: by, node (0 the root, each inner node and a leaf for each suffix), parent, leaf,
    depth, parent_depth, leaves (suffixes below), source_min and source_max (whose they are), source and pos of one of them; label, with labels:
    the letters from the root, which add up to the square of a long text.

    A group's texts are one task's, in order of source and text; sources are whole numbers. Null and empty texts have no suffix."""
    own = texts.select(*by, F.col(source).cast("long").alias("_source"), F.coalesce(F.col(seq), F.lit("")).alias("_seq"))
    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in by)
    columns = ["node", "parent", "leaf", "depth", "parent_depth", "leaves", "source_min", "source_max", "source", "pos", *(["label"] if labels else [])]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_source", "ascending"), ("_seq", "ascending")])
        found, sources = t.column("_seq").to_pylist(), t.column("_source").to_numpy()
        tree = Tree(found, sources)
        n = len(tree.depth)
        up = np.maximum(tree.parent, 0)
        values = [np.arange(n), tree.parent, np.arange(n) >= tree.inner, tree.depth, np.where(tree.parent < 0, 0, tree.depth[up]), tree.leaves, tree.least, tree.most, sources[tree.text], tree.start]
        arrays = [pa.array(x) for x in values]
        if labels:
            arrays.append(pa.array([found[x][a : a + d] for x, a, d in zip(tree.text.tolist(), tree.start.tolist(), tree.depth.tolist())], pa.string()))
        first = pa.array(np.zeros(n, np.int64))
        return pa.table([*(t.column(c).combine_chunks().take(first) for c in by), *arrays], [*by, *columns])

    shape = f"{kinds}node long, parent long, leaf boolean, depth long, parent_depth long, leaves long, source_min long, source_max long, source long, pos long" + (", label string" if labels else "")
    return own.groupBy(*by).applyInArrow(run, shape)
