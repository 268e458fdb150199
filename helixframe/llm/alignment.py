"""Alignment of two tokenizers' tokens on the bytes of each text, with each distinct segment tokenised and aligned once.

Texts, a space before each, are split before runs of white space across which neither vocabulary can merge. This is read off the vocabularies:
the byte-level one must have the pre-tokenizer that never puts white space behind another character, and a character starts a segment only if no
piece of the other one holds it behind a character that isn't white space (`Both.safe`). If the first isn't so, whole texts are segments.

Each block of documents is written as numbers into a list of its own segments, so what is exchanged is a row for each
block and distinct segment, of which no segment has more than one a block, however frequent. Segments of all blocks are grouped, tokenised and aligned
once, and joined back to the blocks' lists; a block's documents then meet its list and are composed. How often a pair of ids is linked is summed
over distinct segments by how often each occurs; documents that don't count are found first by the segments that spoil them, and taken off.

Token bytes: of the byte-level tokenizer its letters decoded, of the other its piece with U+2581 as a space, or the byte that <0xHH> names.
Strings of special tokens are plain text.

Defined cases: null and empty texts, and texts whose tokens of either kind don't give back the space and the text (one with U+2581, say), have no tokens:
zeros and an empty digest. Repeated rows count and are returned each; texts of any length are processed whole (a segment or a document is
held by one task); an empty table gives no rows; only key and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import stored
from .common import lean, table
from .token_counts import byte_letters, load

BLOCK_CHARS = 32 << 20  # of a block's documents, unless one alone is longer
PAIRS = 2_000_000  # linked pairs of ids that are sent to every executor, 34 MB
PACK_ROWS = 200_000
TOGETHER = 4096  # segments tokenised in one string
MARK = "\u2581"
BLANK = "\\s\u180e"  # what any version of the patterns may take for white space
#: All of it, as far as a character can start a run.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\u180e"


class Numbers(dict):
    """A number for each new key."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Both:
    """A byte-level tokenizer and a SentencePiece model, and alignments of segments."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = load(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.mark = self.b.piece_to_id(MARK)
        self.safe = self.safe_starts(pieces)
        self.cut = self.pattern()

    def safe_starts(self, pieces: list[str]) -> str:
        """White space before which a text can be split, unless white space stands before it too."""
        spec = json.loads(self.a.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            return ""
        inner = {c for p in pieces for c in p[1:]}  # a dummy prefix would not merge with these either
        safe = "".join(c for c in "\t\n\x0b\x0c\r" if c not in inner)
        return safe + ("" if any(MARK in p.lstrip(MARK) for p in pieces) else " ")

    def pattern(self) -> re.Pattern:
        if not self.safe:
            return re.compile(r"(?s).+")
        rest = "".join(map(re.escape, (c for c in BLANKS if c not in self.safe)))
        return re.compile(f"[{BLANK}]*[^{BLANK}]+(?:[{rest}][{BLANK}]*[^{BLANK}]+)*(?:[{rest}][{BLANK}]*\\Z)?|[{BLANK}]+")

    def pieces_of(self, s: str) -> list[int]:
        """Piece ids of a string that starts with white space, without a prefix."""
        if s == " ":
            return [self.mark]
        if s[0] == " ":
            return self.b.encode(s[1:])  # the library puts it back
        ids = self.b.encode(s)
        return ids[1:] if ids[:1] == [self.mark] else []

    def tokens(self, s: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, None if either's bytes aren't the string's."""
        raw = s.encode()
        a, b = self.a.encode(s, add_special_tokens=False).ids, self.pieces_of(s)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, segments: list[str]) -> list[tuple[int, int, int, str, np.ndarray] | None]:
        """For each: numbers of tokens and of groups, the groups' text, and linked pairs (first id << 32 | second id) in order; None if
        it has no tokens. Segments that end in no white space are tokenised many in a string, which is safe for the reason that they are segments."""
        out: list = [None] * len(segments)
        blank = re.compile(f"[{BLANK}]\\Z")
        group: list[int] = []

        def flush() -> None:
            if group and not self.together([segments[i] for i in group], group, out):
                for i in group if len(group) > 1 else []:
                    self.together([segments[i]], [i], out)
            group.clear()

        size = 0
        for i, s in enumerate(segments):
            group.append(i)
            size += len(s)
            if not self.safe or blank.search(s) or len(group) >= TOGETHER or size > 1 << 20:
                flush()
                size = 0
        flush()
        return out

    def together(self, segments: list[str], at: list[int], out: list) -> bool:
        found = self.tokens("".join(segments))
        if found is None:
            return False
        a, b = found
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum([len(s.encode()) for s in segments])
        cut = np.union1d(a_end, b_end)
        i, j = np.searchsorted(a_end, cut), np.searchsorted(b_end, cut)
        pairs = a[i] << 32 | b[j]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_to, b_to = (np.searchsorted(x, both, "right").tolist() for x in (a_end, b_end))
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts, x, y = [], 0, 0
        for p, q in zip(a_to, b_to):
            texts.append(f"{','.join(a_text[x:p])}|{','.join(b_text[y:q])}")
            x, y = p, q
        stops = [np.searchsorted(e, ends, "right").tolist() for e in (a_end, b_end, both, cut)]
        a0 = b0 = g0 = l0 = 0
        for k, a1, b1, g1, l1 in zip(at, *stops):
            out[k] = a1 - a0, b1 - b0, g1 - g0, ";".join(texts[g0:g1]), pairs[l0:l1]
            a0, b0, g0, l0 = a1, b1, g1, l1
        return True


def split(docs: DataFrame, byte_path: str, piece_path: str, key: str, text: str, block_chars: int) -> DataFrame:
    """Rows of documents (key, codes: numbers of their segments) and of blocks' segments (code, segment, count), with the block."""
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Both(byte_path, piece_path).cut.findall
        first, part = TaskContext.get().partitionId() << 24, 0
        known, keys, codes, size = Numbers(), [], [], 0

        def rows_of(block: int) -> Iterator[pa.RecordBatch]:
            count = np.zeros(len(known), np.int64)
            for at in range(0, len(codes), 256):
                some = codes[at : at + 256]
                ends = np.concatenate(([0], np.cumsum([len(c) for c in some])))
                flat = np.concatenate(some)
                count += np.bincount(flat, minlength=len(known))
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n), pa.array([-1] * n, pa.int32()), pa.concat_arrays(keys[at : at + 256]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())],
                    ["block", "code", "key", "codes", "segment", "count"],
                )
            names = list(known)
            for at in range(0, len(names), 20_000):
                some = names[at : at + 20_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n), pa.array(range(at, at + n), pa.int32()), pa.nulls(n, keys[0].type), pa.nulls(n, pa.list_(pa.int32())), pa.array(some, pa.string()), pa.array(count[at : at + n])],
                    ["block", "code", "key", "codes", "segment", "count"],
                )

        for b in batches:
            for i in range(b.num_rows):
                t = b.column("text")[i].as_py()
                if keys and size + len(t or "") > block_chars:
                    yield from rows_of(first + part)
                    part, known, keys, codes, size = part + 1, Numbers(), [], [], 0
                found = cut(" " + t) if t else []
                keys.append(b.column("key").slice(i, 1))
                codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                size += len(t or "")
        if keys:
            yield from rows_of(first + part)

    return rows.mapInArrow(lean(run), f"block long, code int, key {kind.simpleString()}, codes array<int>, segment string, count long")


def aligned(segments: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """seg, segment, total, n_a, n_b, n_groups, groups, pairs of each distinct segment; nulls from n_a on if it has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Both(byte_path, piece_path)
        for b in batches:
            found = both.align(b.column("segment").to_pylist())
            none = (None, None, None, None, None)
            n_a, n_b, n_groups, groups, pairs = zip(*(x or none for x in found)) if found else [()] * 5
            long = lambda v: pa.array(v, pa.int64())
            ends = np.concatenate(([0], np.cumsum([0 if p is None else len(p) for p in pairs]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *(p for p in pairs if p is not None)])
            links = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("seg"), b.column("segment"), b.column("total"), long(n_a), long(n_b), long(n_groups), pa.array(groups, pa.string()), links], ["seg", "segment", "total", "n_a", "n_b", "n_groups", "groups", "pairs"])

    totals = segments.groupBy("segment").agg(F.sum("count").alias("total")).select(F.monotonically_increasing_id().alias("seg"), "segment", "total")
    return totals.mapInArrow(lean(run), "seg long, segment string, total long, n_a long, n_b long, n_groups long, groups string, pairs array<long>")


def without(known: DataFrame, docs: DataFrame, lists: DataFrame) -> DataFrame:
    """known with totals over the documents that have tokens."""
    spoilt = known.where("n_a IS NULL").select("segment")
    if spoilt.isEmpty():
        return known
    codes = lists.join(spoilt, "segment", "left_semi").groupBy("block").agg(F.collect_set("code").alias("bad"))  # a part of the block's list
    gone = docs.join(codes, "block").where(F.arrays_overlap("codes", "bad")).select("block", F.explode("codes").alias("code"))
    less = gone.groupBy("block", "code").count().join(lists.select("block", "code", "segment"), ["block", "code"]).groupBy("segment").agg(F.sum("count").alias("less"))
    return stored(known.join(less, "segment", "left").withColumn("total", F.col("total") - F.coalesce("less", F.lit(0))).select(known.columns))


def pair_counts(known: DataFrame) -> DataFrame:
    """pair, count, best: linked ids, how often, and whether no other first id is linked with the second more often."""
    counts = known.where("total > 0").select("total", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("total").alias("count"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(second)))


def scored(known: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """known with n_best and count_sum of each segment, for its pairs. Up to `most` pairs are sent to the executors, more are joined."""
    rest = known.select("segment", "seg", "pairs", "n_a", "n_b", "n_groups", "groups")
    if counts.count() > most:
        links = known.select("seg", F.explode("pairs").alias("pair")).join(counts, "pair")
        sums = links.groupBy("seg").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
        return rest.drop("pairs").join(sums, "seg", "left").drop("seg")
    held = counts.orderBy("pair").toArrow()
    sent = known.sparkSession.sparkContext.broadcast([held.column(c).to_numpy() for c in ("pair", "count", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        total = [np.concatenate(([0], x)) for x in (best.astype(np.int64), count)]
        for b in batches:
            links = b.column("pairs")
            of = np.repeat(np.arange(len(links)), links.value_lengths().fill_null(0).to_numpy())
            flat = links.flatten().to_numpy()
            at = np.searchsorted(pair, flat)
            hit = np.flatnonzero(at < len(pair))
            hit = hit[pair[at[hit]] == flat[hit]]  # all but those of documents without tokens
            sums = []
            for t in total:
                x = np.zeros(len(links), np.int64)
                np.add.at(x, of[hit], t[at[hit] + 1])
                sums.append(pa.array(x))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *sums], [*own, "n_best", "count_sum"])

    own = ("segment", "n_a", "n_b", "n_groups", "groups")
    return rest.drop("seg").mapInArrow(lean(run), "segment string, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long")


NUMBERS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


def packed(code: np.ndarray, numbers: np.ndarray, groups: list[str]) -> bytes:
    """Some entries of a block's list; groups are empty where there are no tokens."""
    plain = struct.pack("<I", len(code)) + code.astype("<u4").tobytes() + numbers.T.astype("<i8").tobytes() + "\n".join(groups).encode()
    return struct.pack("<I", len(plain)) + pa.Codec("zstd").compress(plain, asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, list[str]]:
    (size,) = struct.unpack_from("<I", data)
    plain = pa.Codec("zstd").decompress(memoryview(data)[4:], decompressed_size=size, asbytes=True)
    (n,) = struct.unpack_from("<I", plain)
    ends = 4 + 4 * n, 4 + 4 * n + 8 * n * len(NUMBERS)
    return np.frombuffer(plain[4 : ends[0]], "<u4"), np.frombuffer(plain[ends[0] : ends[1]], "<i8").reshape(len(NUMBERS), n).T, plain[ends[1] :].decode().split("\n")


def packs(payload: DataFrame) -> DataFrame:
    """Rows of one block that a task holds at a time in one, as they take much less so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.take(pa.array(np.argsort(t.column("block").to_numpy(), kind="stable")))
            block, code = t.column("block").to_numpy(), t.column("code").to_numpy()
            numbers = np.stack([t.column(c).fill_null(0).to_numpy() for c in NUMBERS], axis=1)
            groups = t.column("groups").fill_null("").to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            data = [packed(code[a:z], numbers[a:z], groups[a:z]) for a, z in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(data, pa.binary())], ["block", "data"])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK_ROWS:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return payload.select("block", "code", *NUMBERS, "groups").mapInArrow(lean(run), "block long, data binary")


def planes(codes: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest first, as the higher ones hardly differ."""
    plain = codes.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()
    return struct.pack("<I", len(plain)) + pa.Codec("zstd").compress(plain, asbytes=True)


def from_planes(data: bytes) -> np.ndarray:
    (size,) = struct.unpack_from("<I", data)
    plain = pa.Codec("zstd").decompress(memoryview(data)[4:], decompressed_size=size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(plain, "u1").reshape(4, -1).T).view("<u4").ravel()


def numbered(docs: DataFrame, kind: str) -> DataFrame:
    """Documents with their numbers packed, for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [planes(c.values.to_numpy()) for c in b.column("codes")]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("key"), pa.array(data, pa.binary())], ["block", "key", "data"])

    return docs.select("block", "key", "codes").mapInArrow(lean(run), f"block long, key {kind}, data binary")


def compose(docs: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Documents put together from their blocks' lists."""
    kind = docs.schema["key"].dataType.simpleString()
    lists = packs(payload).select("block", F.lit(0).alias("kind"), "data")
    texts = numbered(docs, kind).select("block", F.lit(1).alias("kind"), "data", "key")
    both = lists.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, numbers, groups = None, [], None, None

        def ready() -> None:
            nonlocal held, numbers, groups
            n = sum(len(h[0]) for h in held)
            numbers, groups = np.zeros((n, len(NUMBERS)), np.int64), np.empty(n, object)
            for c, values, texts in held:
                numbers[c], groups[c] = values, texts
            held = []

        for b in batches:
            block, what = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(what) != 0)) + 1).tolist(), len(block)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if here != block[a]:
                    here, held, numbers = block[a], [], None
                part = b.slice(a, z - a)
                if what[a] == 0:
                    held += [unpacked(x.as_py()) for x in part.column("data")]
                    continue
                if numbers is None:
                    ready()
                out, digest = np.zeros((z - a, len(NUMBERS)), np.int64), []
                for i, data in enumerate(part.column("data")):
                    codes = from_planes(data.as_py())
                    texts = groups[codes].tolist()
                    if texts and "" not in texts:
                        out[i] = numbers[codes].sum(0)
                        digest.append(hashlib.sha256(";".join(texts).encode()).hexdigest())
                    else:
                        digest.append("")
                n_a, n_b, n_groups, n_best, count_sum = out.T
                yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, (n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum, digest))], ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return both.mapInArrow(lean(run), f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").withColumnRenamed("key", key)


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, pairs: int = PAIRS) -> DataFrame:
    """key; n_a, n_b tokens; n_groups: runs of tokens between places where tokens of both end; n_links: pairs of overlapping tokens;
    n_best: links counted as often as any of their second id; count_sum: of the links' counts over all texts; groups_sha256."""
    parts = stored(split(docs, byte_path, piece_path, key, text, block_chars))
    texts = parts.where("code < 0").select("block", "key", "codes")
    lists = parts.where("code >= 0").select("block", "code", "segment", "count")
    known = without(stored(aligned(lists, byte_path, piece_path)), texts, lists)
    counts = stored(pair_counts(known), small=True)
    payload = lists.select("block", "code", "segment").join(scored(known, counts, pairs).hint("merge"), "segment").drop("segment")
    return compose(texts, payload, key)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
