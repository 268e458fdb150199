"""SentencePiece encoding and decoding with batched numpy.

Texts are cut where no piece can reach across (before a run of word marks, around newlines), and each distinct segment is
encoded once. Segments of equal length advance together as one matrix: rolling hashes of all substrings up to the longest
piece probe the sorted piece keys, which gives a score for each (segment, start, length); then

* `viterbi` takes, end by end, the vectorised maximum over the piece lengths and stores backpointers. It is exact for unigram models;
* `merges` takes, step by step, the vectorised maximum over the neighbouring pairs, which is what the library does
  with a model of kind BPE. The shipped model is BPE, for which Viterbi finds a better-scored but different split.

Characters that no piece covers become byte pieces. Segments of more than LONG characters are cut where no piece has the two characters
side by side, and the parts encoded one by one (same results, tested against the library): merges by a heap, Viterbi in chunks.

Defined cases: null and empty texts have no pieces; repeated rows are each returned; an empty table gives no rows; a text of any length is encoded
whole; only the key and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

MARK = "▁"
CACHE_SEGMENTS = 400_000
LONG = 64  # characters from which a segment is encoded on its own, and merged with a heap
MULT = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A model's pieces, sorted by hash."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        text = [self.lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(text[i][3:5], 16): i for i in range(n) if self.lib.is_byte(i)}
        self.id = {text[i]: i for i in range(n) if not (self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))}
        self.score = np.array([self.lib.get_score(i) for i in range(n)])
        self.longest = max(map(len, self.id))
        self.worst = self.score.min() - 10
        keys = np.array([self.hash_of(p) for p in self.id], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(self.id.values()), np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        out = {i: p.replace(MARK, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [out.get(i, b"") for i in range(n)]
        self.cut = self.segments_pattern()
        self.together = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.maybe = np.zeros(1 << 20, bool)  # a first look at a hash's upper bits, before the search
        self.maybe[self.keys >> np.uint64(44)] = True

    def segments_pattern(self) -> re.Pattern | None:
        """Finds segments that no piece reaches out of: cut before a run of marks, around newlines, and after a run of
        letters unless a character follows that some piece has right after a letter."""
        if any(MARK in p.lstrip(MARK) for p in self.id) or any("\n" in p for p in self.id):
            return None
        is_letter = re.compile(r"[^\W\d_]").match
        after = {y for p in self.id for x, y in zip(p, p[1:]) if is_letter(x) and not is_letter(y)}
        on = f"(?:[{''.join(map(re.escape, sorted(after)))}][^{MARK}\n]*)?" if after else ""
        return re.compile(f"\n+|{MARK}*[^\\w{MARK}\n]*[^\\W\\d_]+{on}|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(MULT)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def probe(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: segments x n. Scores and ids of [segment, start, length - 1]; -inf and -1 where there is no piece."""
        m, n = codes.shape
        most = min(self.longest, n)
        score, ids = np.full((m, n, most), -np.inf), np.full((m, n, most), -1, np.int32)
        h = np.zeros((m, n), np.uint64)
        for k in range(most):
            w = n - k
            h = (h[:, :w] + codes[:, k:].astype(np.uint64) + np.uint64(1)) * MULT
            h ^= h >> np.uint64(29)
            r, c = np.nonzero(self.maybe[h >> np.uint64(44)])
            key = h[r, c]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            found = self.ids[at[hit]]
            ids[r[hit], c[hit], k] = found
            score[r[hit], c[hit], k] = self.score[found]
        return score, ids

    def parts(self, segment: str) -> list[str]:
        """A segment cut between characters that no piece has side by side, which no piece can reach across."""
        at = [0, *(i + 1 for i in range(len(segment) - 1) if segment[i : i + 2] not in self.together), len(segment)]
        return [segment[a:b] for a, b in zip(at, at[1:])]

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.lib.unk_id()]


def codes_of(segments: list[str]) -> np.ndarray:
    return np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(segments), -1)


def viterbi(model: Pieces, segments: list[str], probed=None) -> list[bytes]:
    """Best-scored splits of segments of one length. Ties go to the longer last piece."""
    score, ids = probed or model.probe(codes_of(segments))
    m, n, most = score.shape
    alone = score[:, :, 0]
    alone[np.isneginf(alone)] = model.worst  # a character without a piece
    best, back = np.zeros((m, n + 1)), np.zeros((m, n + 1), np.int32)
    for j in range(1, n + 1):
        first = max(0, j - most)
        starts = np.arange(first, j)
        c = best[:, first:j] + score[:, starts, j - 1 - starts]
        k = c.argmax(1)
        best[:, j], back[:, j] = c[np.arange(m), k], first + k
    start, end, j, r = np.zeros((m, n), bool), np.zeros((m, n), np.int32), np.full(m, n), np.arange(m)
    while len(r):
        i = back[r, j]
        start[r, i], end[r, i] = True, j
        r, j = r[i > 0], i[i > 0]
    return written(model, segments, ids, start, end)


def viterbi_long(model: Pieces, s: str, chunk: int = 4096) -> bytes:
    """The same for one long segment: scores are looked up chunk by chunk, and of the table only the best score and the
    backpointer of each end are kept."""
    n, most = len(s), model.longest
    best, back = np.zeros(n + 1), np.zeros(n + 1, np.int32)
    for a in range(0, n, chunk):
        first, stop = max(0, a - most + 1), min(n, a + chunk)
        score, _ = model.probe(codes_of([s[first:stop]]))
        score = score[0]
        alone = score[:, 0]
        alone[np.isneginf(alone)] = model.worst
        for j in range(a + 1, stop + 1):
            i = np.arange(max(0, j - score.shape[1]), j)
            c = best[i] + score[i - first, j - 1 - i]
            k = int(c.argmax())
            best[j], back[j] = c[k], i[k]
    ends, j = [], n
    while j:
        ends.append((int(back[j]), j))
        j = int(back[j])
    found = [x for i, j in reversed(ends) for x in ([model.id[s[i:j]]] if s[i:j] in model.id else model.fallback(s[i:j]))]
    return np.array(found, "<u4").tobytes()


def written(model: Pieces, segments: list[str], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Each segment's ids in order, little-endian unsigned 32-bit."""
    r, i = np.nonzero(start)
    got = ids[r, i, end[r, i] - 1 - i]
    data, at = got.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(start.sum(1)))) * 4
    out = [data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
    for row in np.unique(r[got < 0]).tolist():
        pieces: list[int] = []
        for x in np.flatnonzero(start[row]).tolist():
            y = int(end[row, x])
            p = int(ids[row, x, y - 1 - x])
            pieces += [p] if p >= 0 else model.fallback(segments[row][x:y])
        out[row] = np.array(pieces, "<u4").tobytes()
    return out


def merges(model: Pieces, segments: list[str], probed=None) -> list[bytes]:
    """Splits by best-scored merge first, the leftmost of equals, as the library does for BPE models."""
    score, ids = probed or model.probe(codes_of(segments))
    m, n, most = score.shape
    end = np.tile(np.arange(1, n + 1), (m, 1))  # of the symbol that starts here
    before = np.tile(np.arange(-1, n - 1), (m, 1))  # the start of the symbol before it
    start = np.ones((m, n), bool)
    pair = np.full((m, n), -np.inf)  # the score of merging the symbol with the next
    if n > 1 and most > 1:
        pair[:, : n - 1] = score[:, : n - 1, 1]

    def scored(rows: np.ndarray, i: np.ndarray, k: np.ndarray) -> None:
        size = k - i
        pair[rows, i] = np.where(size <= most, score[rows, i, np.minimum(size, most) - 1], -np.inf)

    live = np.arange(m)
    while len(live):
        near = pair[live]
        i = near.argmax(1)
        go = near[np.arange(len(live)), i] > -np.inf
        live, i = live[go], i[go]
        j = end[live, i]
        k = end[live, j]
        end[live, i], start[live, j], pair[live, j], pair[live, i] = k, False, -np.inf, -np.inf
        on = k < n
        before[live[on], k[on]] = i[on]
        scored(live[on], i[on], end[live[on], k[on]])
        p = before[live, i]
        on = p >= 0
        scored(live[on], p[on], k[on])
    return written(model, segments, ids, start, end)


def merges_long(model: Pieces, s: str) -> bytes:
    """The same for one long segment, with a heap."""
    import heapq

    n = len(s)
    end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (p := model.id.get(s[i : end[j]])) is not None:
            heapq.heappush(heap, (-model.score[p], i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, k = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != k:
            continue
        alive[end[i]] = False
        end[i] = k
        if k < n:
            left[k] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    found = [x for i in range(n) if alive[i] for x in ([model.id[s[i : end[i]]]] if s[i : end[i]] in model.id else model.fallback(s[i : end[i]]))]
    return np.array(found, "<u4").tobytes()


class Codec:
    def __init__(self, path: str):
        self.model = Pieces(path)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}  # the generation before

    def segments(self, text: str) -> list[str]:
        s = MARK + text.replace(" ", MARK)
        return self.model.cut.findall(s) if self.model.cut else [s]

    def fill(self, new: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for s in new:
            by.setdefault(len(s), []).append(s)
        for n, same in by.items():
            if n > LONG:
                for s in same:
                    parts = self.model.parts(s)
                    self.cache[s] = b"".join(merges_long(self.model, p) for p in parts), b"".join(viterbi_long(self.model, p) for p in parts)
                continue
            step = max(1, 400_000 // (n * min(n, self.model.longest)))
            for at in range(0, len(same), step):
                part = same[at : at + step]
                probed = self.model.probe(codes_of(part))  # scores of single characters, which viterbi() fills in, are not read by merges()
                self.cache.update(zip(part, zip(merges(self.model, part, probed), viterbi(self.model, part, probed))))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids by merges and by Viterbi, as little-endian unsigned 32-bit numbers."""
        split = [self.segments(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache, self.old = {}, self.cache
        found = [list(map(self.cache.get, x)) for x in split]
        new = {s for x, f in zip(split, found) if None in f for s, v in zip(x, f) if v is None}
        if new:
            known = new & self.old.keys()
            self.cache.update((s, self.old[s]) for s in known)
            self.fill(sorted(new - known))
            found = [list(map(self.cache.__getitem__, x)) if None in f else f for x, f in zip(split, found)]
        return [tuple(map(b"".join, zip(*f))) if f else (b"", b"") for f in found]

    def decode(self, ids: bytes) -> bytes:
        out = b"".join(map(self.model.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out[1:] if out[:1] == b" " else out


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, ids and viterbi_ids (binary, little-endian unsigned 32-bit), decoded and viterbi_decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = codec.encode(texts)
                cols = [[len(t.encode()) for t in texts], [x for x, _ in ids], [y for _, y in ids], [codec.decode(x) for x, _ in ids], [codec.decode(y) for _, y in ids]]
                kinds = [pa.int64(), *[pa.large_binary()] * 4]
                yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k).cast(pa.binary() if k == pa.large_binary() else k) for c, k in zip(cols, kinds))], ["key", "n_bytes", "ids", "viterbi_ids", "decoded", "viterbi_decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"key {kind}, n_bytes long, ids binary, viterbi_ids binary, decoded binary, viterbi_decoded binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of its ids (binary as above); bytes that are no UTF-8 become the replacement character."""
    import pandas as pd

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for x in parts:
            yield x.map(lambda v: None if v is None else codec.decode(v).decode("utf-8", "replace"))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    run = F.pandas_udf(run, "string")
    return df.withColumn(out, run(ids))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_pieces, ids_crc32, n_viterbi, viterbi_crc32, round_trip: only these leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                texts = [t or "" for t in b.column("text").to_pylist()]
                raw = [t.encode() for t in texts]
                ids = codec.encode(texts)
                same = [codec.decode(x) == r and codec.decode(y) == r for (x, y), r in zip(ids, raw)]
                long = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), long([len(r) for r in raw]), long([len(x) // 4 for x, _ in ids]), long([zlib.crc32(x) for x, _ in ids]), long([len(y) // 4 for _, y in ids]), long([zlib.crc32(y) for _, y in ids]), pa.array(same)],
                    ["key", "n_bytes", "n_pieces", "ids_crc32", "n_viterbi", "viterbi_crc32", "round_trip"],
                )

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"key {kind}, n_bytes long, n_pieces long, ids_crc32 long, n_viterbi long, viterbi_crc32 long, round_trip boolean").withColumnRenamed("key", key)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
