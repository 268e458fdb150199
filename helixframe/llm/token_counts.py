"""Token counts: batches encoded in an Arrow function that returns lengths only.

Batches are cut by bytes, not rows. Texts are split at the six ASCII spaces, which is a safe boundary for this kind of
tokenizer (it drops white space, and neither its normaliser, its pre-tokenizer nor a special token reaches across one),
so a text longer than a batch is encoded part by part. `safe_spaces` says whether a tokenizer is of that kind; for another,
whole texts go to the library.

Most texts consist of `PLAIN` bytes only. Their words are found by numpy: a class for each byte, a start wherever the class
changes. A word of up to 16 bytes is two 64-bit numbers, by which a batch's words are looked up at once in a table of the
words seen so far, so a look-up is exact and costs no Python object. Each new word is encoded once by the library.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are each returned; an empty table gives no rows; a text
of any length is encoded whole; only key and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

CACHE_WORDS = 300_000  # kept by a worker; then it starts afresh
BATCH_BYTES = 1 << 20
SLOT_BITS = 20
U8 = np.uint64


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def safe_spaces(tokenizer) -> bool:
    """Whether white space always separates tokens and is dropped."""
    import json

    spec = json.loads(tokenizer.to_str())
    pre = json.dumps(spec.get("pre_tokenizer") or {})
    normal = spec.get("normalizer") or {}
    kinds = {n["type"] for n in normal.get("normalizers", [normal] if normal else [])}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    dropped = '"behavior": "Removed"' in pre and "\\\\s" in pre
    return dropped and kinds <= {"NFC", "Replace", "Lowercase"} and not any(set(t) & set(" \t\n\r\x0b\x0c") for t in special)


#: The pre-tokenizer whose words can be encoded one by one. In texts of PLAIN bytes (Latin-1) the normaliser does no more than
#: lower-casing, and the classes of LETTERS, digits and others make up the pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = bytes(range(9, 14)) + b" "
LETTERS = bytes({*range(ord("a"), ord("z") + 1), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)})
PLAIN = bytes({*range(9, 14), *range(32, 127), *range(0xA1, 0x100)} - {0xAD, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE})
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
CLASS = np.array([0 if b in SPACES else 1 if b in LETTERS else 2 if b in b"0123456789" else 3 for b in range(256)], np.uint8)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U8)


def plain_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case PLAIN bytes; data ends in at least 3 spaces."""
    kind = CLASS[data]
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == 2
    start &= kind != 0
    at = np.flatnonzero(data == 39)
    if len(at):  # the alternatives 's 't 'm 'd 're 've 'll
        at = at[(at == 0) | (kind[at - 1] != 3)]
        x, y = data[at + 1], data[at + 2]
        for size, hit in ((2, np.isin(x, (115, 116, 109, 100))), (3, ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108))):
            start[at[hit] + 1] = False
            on = at[hit] + size
            start[on[kind[on] == 1]] = True
    end = np.empty(len(kind), bool)
    end[-1] = False
    end[:-1] = start[1:] | (kind[1:] == 0)
    end &= kind != 0
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def eight_bytes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, of bytes seen as 64-bit numbers."""
    i, shift = at >> 3, ((at & 7) << 3).astype(U8)
    return (words[i] >> shift) | ((words[i + 1] << (U8(63) - shift)) << U8(1))


class WordTable:
    """Numbers of words held as two 64-bit numbers: open addressing, all look-ups of a batch at once."""

    def __init__(self):
        self.lo, self.hi = np.zeros(1 << SLOT_BITS, U8), np.zeros(1 << SLOT_BITS, U8)
        self.number = np.zeros(1 << SLOT_BITS, np.int32)

    @staticmethod
    def slots(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = lo * U8(0x9E3779B97F4A7C15) ^ hi * U8(0xC2B2AE3D27D4EB4F)
        h ^= h >> U8(29)
        return ((h * U8(0xBF58476D1CE4E5B9)) >> U8(64 - SLOT_BITS)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Numbers, -1 for words that aren't there."""
        slot = self.slots(lo, hi)
        out = np.where((self.lo[slot] == lo) & (self.hi[slot] == hi), self.number[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.lo[slot] != 0))  # no word begins with a byte 0
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            hit = (self.lo[slot] == lo[todo]) & (self.hi[slot] == hi[todo])
            out[todo[hit]] = self.number[slot[hit]]
            on = ~hit & (self.lo[slot] != 0)
            todo, slot = todo[on], slot[on]
        return out

    def put(self, lo: np.ndarray, hi: np.ndarray, number: np.ndarray) -> None:
        """Adds words that are distinct and not there yet."""
        slot, todo = self.slots(lo, hi), np.arange(len(lo))
        while len(todo):
            free = self.lo[slot] == 0
            _, first = np.unique(slot, return_index=True)
            first = first[free[first]]
            self.lo[slot[first]], self.hi[slot[first]], self.number[slot[first]] = lo[todo[first]], hi[todo[first]], number[todo[first]]
            on = np.ones(len(todo), bool)
            on[first] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Ids or numbers of tokens of texts; words seen lately are kept."""

    def __init__(self, path: str):
        import json

        self.tokenizer = load(path)
        self.by_word = safe_spaces(self.tokenizer)
        spec = json.loads(self.tokenizer.to_str())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_part = self.by_word and first.get("pattern") == {"Regex": PATTERN}
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.forget()

    def forget(self) -> None:
        self.words, self.others = WordTable(), {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0  # the words' ids, one after the other
        self.first, self.size = [np.zeros(1 << 14, np.int32) for _ in range(2)]
        self.n = 0

    def new(self, ids: list[list[int]]) -> np.ndarray:
        """The numbers of new words with these ids."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        while self.n + len(size) > len(self.first):
            self.first, self.size = np.concatenate((self.first, self.first)), np.concatenate((self.size, self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, self.pool))
        here = slice(self.n, self.n + len(size))
        self.first[here], self.size[here] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(size)
        return np.arange(here.start, here.stop, dtype=np.int32)

    def plain_ids(self, words: list[str]) -> list[list[int]]:
        """Of words of plain texts."""
        split, letters = self.tokenizer.model.tokenize, self.letters
        return [[t.id for t in split(w if w.isascii() else w.translate(letters))] for w in words]

    def other(self, words: list, whole) -> list[int]:
        """Numbers of words that the table doesn't hold: of bytes through the whole tokenizer, of strings as plain words."""
        fresh = list(dict.fromkeys(w for w in words if w not in self.others))
        if fresh:
            self.others.update(zip(fresh, self.new(whole(fresh)).tolist()))
        return [self.others[w] for w in words]

    def whole_ids(self, words: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def plain_numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and numbers of the words of plain bytes."""
        data = np.frombuffer(data.translate(LOWER) + b" " * (32 - len(data) % 8), np.uint8)
        start, end = plain_words(data)
        n = end - start
        words = data.view(U8)
        lo, hi = eight_bytes(words, start) & MASKS[np.minimum(n, 8)], np.zeros(len(start), U8)
        long = np.flatnonzero(n > 8)
        hi[long] = eight_bytes(words, start[long] + 8) & MASKS[np.minimum(n[long] - 8, 8)]
        out = self.words.find(lo, hi)
        text = ""
        if len(huge := np.flatnonzero(n > 16)):
            text = data.tobytes().decode("latin-1")
            out[huge] = self.other([text[a:b] for a, b in zip(start[huge].tolist(), end[huge].tolist())], self.plain_ids)
        missing = np.flatnonzero(out < 0)
        while len(missing):
            text = text or data.tobytes().decode("latin-1")
            # two words of one hash take two rounds
            _, at = np.unique(lo[missing] * U8(0x9E3779B97F4A7C15) ^ hi[missing], return_index=True)
            at = missing[at]
            self.words.put(lo[at], hi[at], self.new(self.plain_ids([text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])))
            out[missing] = self.words.find(lo[missing], hi[missing])
            missing = missing[out[missing] < 0]
        return start, out

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and how many words each text has."""
        if self.n > CACHE_WORDS:
            self.forget()
        if self.by_part:
            one = self.plain(b"\n".join(texts))
            if one is not None:
                start, numbers = self.plain_numbers(one)
                ends = np.cumsum([len(t) if t.isascii() else len(t.decode()) for t in texts]) + np.arange(len(texts))
                return numbers, np.diff(np.searchsorted(start, ends), prepend=0)
        found = []
        for t in texts:
            one = self.plain(t) if self.by_part else None
            found.append(self.plain_numbers(one)[1] if one is not None else np.array(self.other(t.split(), self.whole_ids), np.int32))
        return np.concatenate(found), np.array([len(x) for x in found])

    def plain(self, text: bytes) -> bytes | None:
        """The text in Latin-1 if it is plain."""
        if any(s in text for s in self.special):
            return None
        if not text.isascii():
            try:
                text = text.decode().encode("latin-1")
            except UnicodeEncodeError:
                return None
        return None if text.translate(None, PLAIN) else text

    def parts(self, text: bytes) -> Iterator[bytes]:
        """A long text in parts that end at white space."""
        at = 0
        while len(text) - at > BATCH_BYTES:
            cut = max(text.rfind(s, at, at + BATCH_BYTES) for s in (b" ", b"\n"))
            if cut < 0:
                found = re.search(rb"[ \t-\r]", memoryview(text)[at + BATCH_BYTES :])
                cut = at + BATCH_BYTES + found.start() if found else len(text) - 1
            yield text[at : cut + 1]
            at = cut + 1
        yield text[at:]

    def batches(self, texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """Texts some at a time with the first one's number; a long text comes alone, in parts."""
        group, first, size = [], 0, 0
        for i, t in enumerate(texts):
            if group and size + len(t) > BATCH_BYTES:
                yield first, group
                group, size = [], 0
            if len(t) > BATCH_BYTES:
                yield from ((i, [p]) for p in self.parts(t))
            else:
                first = first if group else i
                group.append(t)
                size += len(t)
        if group:
            yield first, group

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """How many tokens each text has."""
        if not self.by_word:
            return np.array([len(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids) for t in texts], np.int64)
        out = np.zeros(len(texts), np.int64)
        for first, group in self.batches(texts):
            numbers, words = self.numbers(group)
            total = np.concatenate(([0], np.cumsum(self.size[numbers], dtype=np.int64)))
            stop = np.cumsum(words)
            out[first : first + len(group)] += total[stop] - total[stop - words]
        return out

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids."""
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for first, group in self.batches(texts):
            numbers, words = self.numbers(group)
            size = self.size[numbers]
            total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            ids = self.pool[np.repeat(self.first[numbers] - total[:-1], size) + np.arange(total[-1])]
            stop = np.cumsum(words)
            for i, (a, b) in enumerate(zip(total[stop - words].tolist(), total[stop].tolist())):
                out[first + i].append(ids[a:b])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def byte_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 * BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about `limit` bytes of text, with the texts as bytes."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(start, stop - start), [x or b"" for x in column.slice(start, stop - start).to_pylist()]
            start = stop


def count(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and n_tokens of each row of df."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch, texts in byte_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(len, texts), pa.int64()), pa.array(encoder.lengths(texts), pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(lean(run), f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return found.withColumnRenamed("key", key)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)
