"""N-gram Jaccard join: exact links between word-shingle sets, by prefixes under several global token orders.

With J >= t, two sets share a token among the first n - ceil(t n) + 1 of each, under any order of all tokens. Three
orders are used: H1 and H2 order tokens by two hashes, DF by document frequency and then hash.

1. Texts become sets of 64-bit shingle hashes. Equal sets (by a 128-bit digest) are one node from here on.
2. A node can have a link only if ceil(t n) of its tokens occur in another node: otherwise its DF prefix holds nothing but
   tokens of its own. Tokens meet by range, counts go back. Each part of a task sends a token once, so a token of very many
   documents is no hot key; the few nodes that remain are marked in a Bloom filter of bounded size.
3. The remaining nodes' sets are kept in blocks. Document frequencies among them are counted by token range and sent back to the blocks.
4. A node's DF prefix tokens that occur elsewhere are its postings. Within a token's postings every node is first
   compared with one centre, which joins groups of near copies by links in proportion to their size, not its square.
5. What the centre did not join is compared directly, unless a bound excludes a link: the tokens of its own, its shared
   tokens counted by class of hash, or the triangle inequality of Jaccard distance through the centre. No pair within a component is ever formed.
6. Candidate pairs so far are pairs of ids, from the DF order. The prefixes under H1 and H2 meet next, without the sets; only pairs that share a
   token under all three orders are verified, and only their sets travel.

Tokens of MANY nodes are spread over SPREAD tasks wherever nodes meet by token.

Components come from label propagation with pointer jumping; lineage is cut by checkpoints.

Defined cases: null and empty texts have an empty set and link with nothing, not even each other; texts of fewer words
than a shingle are one shingle; rows that share an id are one document, linked if one of its texts is; rows with a null id
have a null component; an empty table gives no rows; texts of any length are read whole. Only the id and the text are read.

Words and shingles are told apart by 64-bit hashes, sets by 128 bits: two different ones are taken for equal with a chance of some 10**-19 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..operators.lineage import checkpoint, stored
from .common import lean, shuffle_partitions, table, trim
from .exchange import batch, blocks_for, bloom, bloom_bits, in_bloom, mix, powers, range_of, raw

SECOND = 0x5851F42D4C957F2D  # salt of H2
THIRD = 0x14057B7EF767814F  # salt of the hash within DF
U8 = np.uint64
NOBODY = 0xFFFF
CLASS_BITS = 6
PART_TOKENS = 2_000_000
MANY, SPREAD = 256, 16  # nodes from which a token is spread, and the tasks that it is dealt to
LETTERS = mix(np.arange(1, 257, dtype=U8))


SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
PIECE, LONG_WORD = 1 << 18, 64  # bytes hashed at once; bytes from which a word is hashed on its own


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words, A-Z lower-cased."""
    import xxhash

    starts, hashes, at = [], [], 0
    while at < len(blob):
        stop = min(len(blob), at + PIECE)
        if stop < len(blob):  # a piece ends after white space
            near = max(blob.rfind(s, at, stop) for s in (b" ", b"\n")) + 1
            stop = near or min((x for s in (b" ", b"\n") if (x := blob.find(s, stop)) >= 0), default=len(blob) - 1) + 1
        piece = blob[at:stop].lower()
        data = np.frombuffer(piece, np.uint8)
        space = np.concatenate(([True], SPACE[data], [True]))
        start = np.flatnonzero(space[:-1] & ~space[1:])
        end = np.flatnonzero(~space[:-1] & space[1:])
        up, down = powers(len(data))
        sums = np.concatenate((np.zeros(1, U8), np.cumsum(LETTERS[data] * up)))
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U8))
        for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(piece[start[i] : end[i]])
        starts.append(start + at)
        hashes.append(h)
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, U8))


def token_sets(texts: list[bytes], n: int = 4) -> list[np.ndarray]:
    """Each text's distinct hashes of shingles of n words, ascending (which is H1)."""
    start, h = word_hashes(b"\n".join(texts))
    last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    sizes = np.diff(last, prepend=0)
    if len(h) >= n:
        x = np.zeros(len(h) - n + 1, U8)
        for k in range(n):
            x = mix(x * U8(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    out = []
    for size, end in zip(sizes.tolist(), last.tolist()):
        if size >= n:
            s = np.sort(x[end - size : end - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif size:  # the whole sequence is one shingle, unlike any of n words
            whole = np.zeros(1, U8)
            for k in range(size):
                whole = mix(whole * U8(0x9E3779B97F4A7C15) + h[end - size + k])
            out.append(mix(whole + U8(size)))
        else:
            out.append(np.empty(0, U8))
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _digests(s: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(raw(s), digest_size=16).digest(), np.int64).tolist()
    return a, b


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            yield b, [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]


LONG, BIN = pa.int64(), pa.binary()


def describe(rows: DataFrame, n: int) -> DataFrame:
    """id, n, d1, d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _texts(batches):
            sets = token_sets(texts, n)
            d = [_digests(s) for s in sets]
            yield batch({"id": (b.column("id"), LONG), "n": ([len(s) for s in sets], LONG), "d1": ([x for x, _ in d], LONG), "d2": ([y for _, y in d], LONG)})

    return rows.mapInArrow(lean(run), "id long, n long, d1 long, d2 long")


def companions(rows: DataFrame, ranges: int, percent: int, n: int) -> DataFrame:
    """d1 of the nodes that could have a link: at least ceil(t n) of their tokens occur in another node (and, rarely, some more).

    Nodes are taken in parts of bounded size. A part sends each of its tokens once, with its holder's number there if it has
    one holder; holders of tokens that several nodes of the part share are known at once. Back come counts by holder."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, d1s, sets, size = TaskContext.get().partitionId() << 32, set(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
            token = np.concatenate(sets)
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            first = np.concatenate(([True], token[1:] != token[:-1]))
            shared = ~first
            shared[:-1] |= ~first[1:]
            known = np.bincount(owner[shared], minlength=len(sets))
            need = [len(x) - prefix_size(len(x), percent) + 1 for x in sets]
            # the part's own table goes to where its counts come back
            yield batch({"r": ([-1 - part], LONG), "part": ([part], LONG), "tokens": ([raw(np.array(d1s, np.int64))], BIN), "owners": ([raw(np.stack([known, need]).astype(np.int64))], BIN)})
            # a token with several holders here still tells others that it occurs elsewhere, but needs no answer
            token, owner, mute = token[first], owner[first], shared[first]
            owner = np.where(mute, NOBODY, owner).astype(np.uint16)
            cut = np.searchsorted(range_of(token, ranges), np.arange(ranges + 1))
            full = [r for r in range(ranges) if cut[r] < cut[r + 1]]
            # six bytes of a token are enough: what a chance agreement adds is sorted out later
            six = lambda x: raw(x.view(np.uint8).reshape(-1, 8)[:, 2:])
            yield batch({"r": (full, LONG), "part": ([part] * len(full), LONG), "tokens": ([six(token[cut[r] : cut[r + 1]]) for r in full], BIN), "owners": ([raw(owner[cut[r] : cut[r + 1]]) for r in full], BIN)})

        for _, texts in _texts(batches):
            for x in token_sets(texts, n):
                d = _digests(x)[0] if len(x) else None
                if d is not None and d not in seen:
                    seen.add(d)
                    d1s.append(d)
                    sets.append(x)
                    size += len(x)
                    if size >= PART_TOKENS or len(sets) == NOBODY:
                        yield from flush()
                        part, seen, d1s, sets, size = part + 1, set(), [], [], 0
        if sets:
            yield from flush()

    def meet(t: pa.Table) -> pa.Table:
        if t.column("r")[0].as_py() < 0:
            return t.select(["part", "tokens", "owners"])
        six = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in t.column("tokens").to_pylist()]
        token = np.zeros((sum(map(len, six)), 8), np.uint8)
        token[:, 2:] = np.concatenate(six)
        token = token.view(U8)[:, 0]
        owner = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("owners").to_pylist()])
        row = np.repeat(np.arange(len(six)), [len(x) for x in six])
        order = np.argsort(token)
        again = np.zeros(len(token), bool)
        same = token[order[1:]] == token[order[:-1]]
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= owner != NOBODY
        parts, out = t.column("part").to_pylist(), []
        for i in range(len(six)):
            at, n = np.unique(owner[again & (row == i)], return_counts=True)
            out.append(raw(np.stack([at, n]).astype(np.int64)))
        del six, token, owner, row, order, again, same
        trim()
        return pa.table({"part": pa.array(parts, LONG), "tokens": pa.array([None] * len(parts), BIN), "owners": pa.array(out, BIN)})

    def judge(t: pa.Table) -> pa.Table:
        d1, count, need = None, 0, 0
        for tokens, owners in zip(t.column("tokens").to_pylist(), t.column("owners").to_pylist()):
            if tokens is not None:
                d1 = np.frombuffer(tokens, np.int64)
                known, need = np.frombuffer(owners, np.int64).reshape(2, -1)
        count = np.array(known)
        for tokens, owners in zip(t.column("tokens").to_pylist(), t.column("owners").to_pylist()):
            if tokens is None:
                at, n = np.frombuffer(owners, np.int64).reshape(2, -1)
                count[at] += n
        return pa.table({"d1": d1[count >= need]})

    asked = rows.select("text").mapInArrow(lean(ask), "r long, part long, tokens binary, owners binary")
    counts = asked.groupBy("r").applyInArrow(meet, "part long, tokens binary, owners binary")
    return counts.groupBy("part").applyInArrow(judge, "d1 long").distinct()


def node_sets(rows: DataFrame, ids: DataFrame, blocks: int, n: int) -> DataFrame:
    """block, d1, id, tokens of the nodes whose id is among ids (a few others may slip in), each block in one partition."""
    words, size = bloom(ids, "id")
    known = rows.sparkSession.sparkContext.broadcast(words)  # BLOOM_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep = whole.filter(pa.array(in_bloom(known.value, whole.column("bits"))))
            for b, texts in _texts([keep]):
                at = [(i, s) for i, s in zip(b.column("id").to_pylist(), token_sets(texts, n)) if len(s)]
                d = [_digests(s)[0] for _, s in at]
                yield batch({"block": ([x % blocks for x in d], LONG), "d1": (d, LONG), "id": ([i for i, _ in at], LONG), "tokens": ([raw(s) for _, s in at], BIN)})

    marked = rows.withColumn("bits", bloom_bits(F.col("id"), size))
    return marked.mapInArrow(lean(run), "block long, d1 long, id long, tokens binary").repartition(blocks, "block")


def _nodes(t: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    return {(d, i): np.frombuffer(s, U8) for d, i, s in zip(t.column("d1").to_pylist(), t.column("id").to_pylist(), t.column("tokens").to_pylist())}


def _distinct(nodes: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct tokens, and how many of its nodes hold each."""
    return np.unique(np.concatenate(list(nodes.values())), return_counts=True) if nodes else (np.empty(0, U8), np.empty(0, np.int64))


def postings(sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """token, d1, id, n, s, df, v: the DF prefix tokens that more than one node holds, their node's size, how many of
    all its tokens more than one node holds, the nodes that hold the token (up to 65,535 are counted), and the node's shared tokens counted by
    class of hash (null where a count is too large)."""

    def ask(t: pa.Table) -> pa.Table:
        tokens, counts = _distinct(_nodes(t))
        cut = np.searchsorted(range_of(tokens, ranges), np.arange(ranges + 1))
        full = [r for r in range(ranges) if cut[r] < cut[r + 1]]
        counts = np.minimum(counts, 65535).astype(np.uint16)
        block = t.column("block")[0].as_py()
        return pa.table({"r": pa.array(full, LONG), "block": pa.array([block] * len(full), LONG), "tokens": pa.array([raw(tokens[cut[r] : cut[r + 1]]) for r in full], BIN), "counts": pa.array([raw(counts[cut[r] : cut[r + 1]]) for r in full], BIN)})

    def add(t: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, U8) for x in t.column("tokens").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.minimum(np.bincount(at, counts), 65535).astype(np.uint16)[at]
        parts = np.split(df, np.cumsum([len(x) for x in tokens])[:-1])
        return pa.table({"block": t.column("block"), "r": t.column("r"), "df": pa.array([raw(x) for x in parts], BIN)})

    def choose(t: pa.Table, replies: pa.Table) -> pa.Table:
        nodes = _nodes(t)
        tokens, _ = _distinct(nodes)
        replies = replies.sort_by("r")
        df = np.concatenate([np.frombuffer(x, np.uint16) for x in replies.column("df").to_pylist()] or [np.empty(0, np.uint16)])
        if len(df) != len(tokens):
            raise RuntimeError(f"{len(df)} frequencies for {len(tokens)} tokens")
        out, often, owners, sizes, classes = [], [], [], [], []
        for key, s in nodes.items():
            own = df[np.searchsorted(tokens, s)]
            first = np.lexsort((mix(s, THIRD), own))[: prefix_size(len(s), percent)]
            first = first[own[first] > 1]
            if len(first):
                out.append(s[first])
                often.append(own[first].astype(np.int64))
                owners.append((*key, len(s), int((own > 1).sum())))
                sizes.append(len(first))
                c = np.bincount((mix(s[own > 1], THIRD) >> U8(64 - CLASS_BITS)).astype(np.int64), minlength=1 << CLASS_BITS)
                classes += [c.astype(np.int16) if c.max() < 1 << 15 else None] * len(first)
        who = np.repeat(np.array(owners, np.int64).reshape(-1, 4), sizes, axis=0)
        token = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
        often = np.concatenate(often) if often else np.empty(0, np.int64)
        return pa.table({"token": token, "d1": np.ascontiguousarray(who[:, 0]), "id": np.ascontiguousarray(who[:, 1]), "n": np.ascontiguousarray(who[:, 2]), "s": np.ascontiguousarray(who[:, 3]), "df": often, "v": pa.array(classes, pa.list_(pa.int16()))})

    asked = sets.groupBy("block").applyInArrow(ask, "r long, block long, tokens binary, counts binary")
    replies = asked.groupBy("r").applyInArrow(add, "block long, r long, df binary")
    return sets.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(choose, "token long, d1 long, id long, n long, s long, df long, v array<smallint>")


PAIR = ["a_d1", "a_id", "b_d1", "b_id"]


def _meet(sets: DataFrame, pairs: DataFrame, blocks: int, make, test, shape: str) -> DataFrame:
    """test(a's tokens, what make gave of b's tokens) for each pair (a_d1, a_id, b_d1, b_id), as further columns.

    What make gives travels to a's block, once however many pairs need it there."""
    pairs = pairs.select(*PAIR, F.pmod("a_d1", F.lit(blocks)).alias("block"))
    wanted = pairs.select(F.pmod("b_d1", F.lit(blocks)).alias("home"), "b_d1", "b_id", "block").distinct()
    names = [c.split()[0] for c in shape.split(",")]

    def send(t: pa.Table, asked: pa.Table) -> pa.Table:
        own, made = _nodes(t), {}
        keys = list(zip(asked.column("b_d1").to_pylist(), asked.column("b_id").to_pylist()))
        for k in keys:
            if k not in made and k in own:
                made[k] = raw(make(own[k]))
        return pa.table({"block": asked.column("block"), "b_d1": asked.column("b_d1"), "b_id": asked.column("b_id"), "tokens": pa.array([made.get(k) for k in keys], BIN)})

    def compare(t: pa.Table, rows: pa.Table) -> pa.Table:
        nodes = _nodes(t)
        come = rows.filter(rows.column("tokens").is_valid())
        others = {(d, i): np.frombuffer(x, U8) for d, i, x in zip(come.column("b_d1").to_pylist(), come.column("b_id").to_pylist(), come.column("tokens").to_pylist())}
        rows = rows.filter(rows.column("a_id").is_valid())
        found = [test(nodes[ad, ai], others[bd, bi]) for ad, ai, bd, bi in zip(*(rows.column(c).to_pylist() for c in PAIR))]
        return pa.table({**{c: rows.column(c) for c in PAIR}, **{n: pa.array([f[k] for f in found], KINDS[n]) for k, n in enumerate(names)}})

    sent = sets.groupBy("block").cogroup(wanted.withColumn("at", F.col("home")).groupBy("at")).applyInArrow(send, "block long, b_d1 long, b_id long, tokens binary")
    both = pairs.withColumn("tokens", F.lit(None).cast("binary")).unionByName(sent, allowMissingColumns=True)
    return sets.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(compare, ", ".join(f"{c} long" for c in PAIR) + ", " + shape)


KINDS = {"h1": pa.bool_(), "h2": pa.bool_(), "distance": pa.float64(), "linked": pa.bool_()}


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two arrays of distinct ones share."""
    z = np.sort(np.concatenate((x, y)))
    return int((z[1:] == z[:-1]).sum())


def order_prefixes(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of a set under H1 and H2."""
    p = prefix_size(len(s), percent)
    return s[:p], np.sort(mix(s, SECOND))[:p]


def agreeing(sets: DataFrame, pairs: DataFrame, blocks: int, percent: int) -> DataFrame:
    """Pairs with h1 and h2: whether they share a token in their prefixes under each order. A set's two prefixes travel, not the set."""

    def make(s: np.ndarray) -> np.ndarray:
        return np.concatenate(order_prefixes(s, percent))

    def test(x: np.ndarray, both: np.ndarray) -> tuple[bool, bool]:
        (x1, x2), (y1, y2) = order_prefixes(x, percent), np.split(both, 2)
        return common(x1, y1) > 0, common(x2, y2) > 0

    return _meet(sets, pairs, blocks, make, test, "h1 boolean, h2 boolean")


def verify(sets: DataFrame, pairs: DataFrame, blocks: int, percent: int) -> DataFrame:
    """Pairs with their distance and linked, from the whole sets."""

    def test(x: np.ndarray, y: np.ndarray) -> tuple[float, bool]:
        both = common(x, y)
        union = len(x) + len(y) - both
        return 1 - both / union, 100 * both >= percent * union

    return _meet(sets, pairs, blocks, lambda s: s, test, "distance double, linked boolean")


def intersected(sets: DataFrame, pairs: DataFrame, blocks: int, percent: int) -> DataFrame:
    """The pairs that all orders make candidates, with distance and linked."""
    pairs = stored(agreeing(sets, pairs, blocks, percent), small=True).where("h1 AND h2").select(*PAIR)
    return stored(verify(sets, pairs, blocks, percent), small=True)


def dealt(rows: DataFrame) -> DataFrame:
    """rows (token, id, df) with part: the rows of a token of MANY nodes go to SPREAD parts."""
    return rows.withColumn("part", F.when(F.col("df") > MANY, F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0).cast("int"))


def copied(rows: DataFrame) -> DataFrame:
    """rows (token, df) in every part to which the token's rows are dealt."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("df") > MANY, SPREAD - 1).otherwise(0))))


def by_token(many: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
    """many and one, which has few rows a token, joined on token."""
    return dealt(many).join(copied(one).drop("df"), ["token", "part"], how).drop("part")


def links(rows: DataFrame, meta: DataFrame, percent: int, n: int) -> DataFrame:
    """src, dst of enough links between nodes (by id) to connect whatever is linked."""
    parts = shuffle_partitions(rows.sparkSession)
    ranges = max(parts, (meta.agg(F.sum("n")).first()[0] or 0) // 4_000_000)
    nodes = meta.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    live = stored(nodes.join(companions(rows, ranges, percent, n), "d1").select("id", "n"), small=True)
    tokens = live.agg(F.sum("n")).first()[0] or 0
    blocks = blocks_for(8 * tokens, parts)
    sets = checkpoint(node_sets(rows, live, blocks, n))
    post = stored(postings(sets, max(parts, tokens // 1_000_000), percent), small=True)
    # the centre of a token's nodes is the one with the fewest tokens of its own, near which a group of edited copies lies
    node = F.struct((F.col("n") - F.col("s")).alias("own"), "id", "d1", "n", "s")
    centres = post.groupBy("token").agg(F.min(node).alias("c"), F.count(F.lit(1)).alias("m"), F.first("df").alias("df")).where("m > 1").select("token", "df", "c")
    # Only tokens that more than one node holds can be common, which bounds the similarity from sizes alone.
    fits = lambda x, y: (100 + percent) * F.least(F.col(f"{x}s"), F.col(f"{y}s")) >= percent * (F.col(f"{x}n") + F.col(f"{y}n"))
    star = by_token(post, centres).where((F.col("id") != F.col("c.id")) | (F.col("d1") != F.col("c.d1")))
    star = star.where(fits("", "c.")).select(F.col("d1").alias("a_d1"), F.col("id").alias("a_id"), F.col("c.d1").alias("b_d1"), F.col("c.id").alias("b_id")).distinct()
    star = intersected(sets, star, blocks, percent)
    joined = star.where("linked").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    label = components(joined)
    # what remains: nodes of a token that aren't in its centre's component, against all of the token
    named = post.join(label, post["id"] == label["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")
    own = centres.join(label, F.col("c.id") == label["node"], "left").select("token", "df", "c", F.coalesce("component", F.col("c.id")).alias("main"))
    own = by_token(named, own)
    near = star.select(F.col("a_d1").alias("d1"), F.col("a_id").alias("id"), F.col("b_d1").alias("c_d1"), F.col("b_id").alias("c_id"), "distance")
    own = own.withColumn("c_id", F.col("c.id")).withColumn("c_d1", F.col("c.d1")).join(near, ["d1", "id", "c_d1", "c_id"], "left")
    own = own.withColumn("distance", F.when((F.col("id") == F.col("c_id")) & (F.col("d1") == F.col("c_d1")), F.lit(0.0)).otherwise(F.col("distance")))
    own = stored(own.select("token", "df", "d1", "id", "n", "s", "v", "component", (F.col("component") == F.col("main")).alias("major"), "distance"), small=True)
    minor = own.where("NOT major")
    x, y = copied(minor).alias("x"), dealt(by_token(own, minor.select("token", "df").distinct(), "left_semi")).alias("y")
    apart = F.abs(F.col("x.distance") - F.col("y.distance")) > (1 - percent / 100 + 1e-9)
    # tokens of one class can only be common with tokens of that class
    most = F.aggregate(F.zip_with("x.v", "y.v", lambda a, b: F.least(a, b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    enough = (100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))
    rest = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component")) & fits("x.", "y.")
        & (F.col("y.major") | (F.col("x.id") < F.col("y.id"))) & ~F.coalesce(apart, F.lit(False)) & F.coalesce(enough, F.lit(True)),
    )
    rest = rest.select(*[F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in (("x", "a"), ("y", "b")) for c in ("d1", "id")]).distinct()
    more = intersected(sets, rest, blocks, percent).where("linked").select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    return stored(joined.union(more), small=True)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, n: int = 4) -> DataFrame:
    """One row per row of docs: key, n_shingles (of n words), component_id, which is of the key's type."""
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        return _join_named(docs, key, text, percent, n)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    meta = stored(describe(rows, n), small=True)
    known = meta.where("id IS NOT NULL")
    label = components(links(rows.where("id IS NOT NULL"), known, percent, n))
    # equal sets are one node, by the smallest id; a document stands for its node, or for itself if empty
    rep = known.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"))
    edges = known.where("n > 0").join(rep, ["d1", "d2"]).select("id", "rep").where("id <> rep")
    label = label.select(F.col("node").alias("rep"), F.col("component").alias("top"))
    own = edges.join(label, "rep", "left").select("id", F.coalesce("top", "rep").alias("component")).union(label)
    own = own.groupBy("id").agg(F.min("component").alias("component"))
    out = meta.select("id", "n").join(own, "id", "left")
    kind = docs.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))


def _join_named(docs: DataFrame, key: str, text: str, percent: int, n: int) -> DataFrame:
    """The same for keys of any type that has an order: they are numbered in that order."""
    rows = docs.select(F.col(key).alias("name"), F.col(text).alias("text"))
    names = stored(rows.select("name").where("name IS NOT NULL").distinct().orderBy("name").select("name", F.monotonically_increasing_id().alias("id")))
    found = join(rows.join(names, "name", "left").select("id", "text"), "id", "text", percent, n)
    found = found.join(names, "id", "left").withColumnRenamed("name", key)
    tops = names.select(F.col("id").alias("component_id"), F.col("name").alias("top"))
    return found.join(tops, "component_id", "left").select(key, "n_shingles", F.col("top").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
