"""Packing by lexical retrieval.

1. Texts are encoded once, to two bytes a token, and stored. Document frequencies are counted over the whole corpus.
2. A document's whole windows are sequences of their own. What is left of it, its end, is a document of the index.
3. Ends are dealt into shards by their words. An end's BM25 weights are projected to a few dimensions. A tree that halves a bounded sample
   (`SAMPLE` ends a leaf, `LEAVES` leaves at most) along principal axes, each leaf cut into `BINS` along its own, orders the corpus into
   cells of like words. The ends of every cell are counted exactly; a shard is a run of cells of about `shard_docs` ends, and a cell that holds
   more (copies of one text, say) is split by a hash of the row into as many shards as it takes.
4. A shard holds a BM25 inverted index over its ends, weighted by the corpus's frequencies. A seed opens a window, its best-scored unused
   neighbours fill it greedily, the last of them is cut where the window ends, and its rest is the next seed. The last window's
   tokens go into sequences of power-of-two lengths, so nothing is padded.

A neighbour is the best unused one of its shard, not of the corpus (the README has measured figures). In return work is in proportion to the
corpus and nothing that grows with it reaches the driver: it gets document frequencies, the sample and a counter for each cell.

Defined cases: null and empty texts are the end token alone; repeated rows are separate documents; an empty table gives no rows; a document of any
length is cut into windows row by row; ties in score go to the earlier row (scores are sums of whole numbers, so they are exact); only the key
and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import stored
from .common import lean, table, trim
from .exchange import mix
from .token_counts import Encoder, byte_batches

WINDOW = 2048
END = 1
SHARD_DOCS = 1024  # ends in a shard, about
LEAVES, SAMPLE, BINS = 4096, 32, 64  # leaves of the tree at most, sampled ends for each, cells in each
DIMENSIONS = 64
DENSE_SHARE, DENSE_BYTES = 32, 32 << 20  # tokens in a DENSE_SHAREth of a shard's ends are rows of a matrix
UNIT = 1 << 14  # weights are whole multiples of 1 / UNIT; 2048 of them fit 31 bits
POS = 33  # bits of a row's number within its partition
WHOLE = 1 << 62  # numbers of sequences from here on are documents' own windows
K1, B = 1.2, 0.75
U8 = np.uint64


def encode(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """key, id (partition and number within it) and token ids, the end token included, two bytes an id (ids are below 65,536)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit two bytes")
        end = np.array([END], "<u2").tobytes()
        at = TaskContext.get().partitionId() << POS
        for batch, texts in byte_batches(batches, "text"):
            ids = pa.array([x.astype("<u2").tobytes() + end for x in encoder.ids(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.arange(at, at + len(ids))), ids], ["key", "id", "ids"])
            at += len(ids)

    return rows.mapInArrow(lean(run), f"key {kind}, id long, ids binary").withColumn("total", (F.octet_length("ids") / 2).cast("long"))


def unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch, [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, distinct token and its count, by document and token."""
    size = np.array([len(x) for x in docs])
    key = np.sort((np.repeat(np.arange(len(docs), dtype=np.uint32), size) << np.uint32(16)) | np.concatenate(docs).astype(np.uint32))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return (key[at] >> np.uint32(16)).astype(np.int64), (key[at] & np.uint32(0xFFFF)).astype(np.int64), np.diff(np.append(at, len(key)))


def corpus_statistics(rows: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """Document frequency by token, documents, tokens and ends. Three further counters carry the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << 16) + 3, np.int64)
        for _, ids in unpacked(batches):
            df[: 1 << 16] += np.bincount(terms(ids)[1], minlength=1 << 16)
            size = np.array([len(x) for x in ids])
            df[-3:] += (len(ids), size.sum(), (size % WINDOW > 0).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["token", "n"])

    found = rows.mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << 16) + 3, np.int64)
    df[found.column("token").to_numpy()] = found.column("n").to_numpy()
    return df[:-3], *map(int, df[-3:])


class Model:
    """BM25 weights, and the projection of a document's weights."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float):
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = mean
        self._axes: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_axes": None}

    def weights(self, doc: np.ndarray, token: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * length / self.mean)
        return self.idf[token] * tf * (K1 + 1) / (tf + norm[doc])

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        """One row of unit length a document."""
        if self._axes is None:
            bits = mix(np.arange(1, (1 << 16) + 1, dtype=U8))
            self._axes = ((bits[:, None] >> np.arange(DIMENSIONS, dtype=U8)) & U8(1)).astype(np.float32) * 2 - 1
        out = np.empty((len(docs), DIMENSIONS), np.float32)
        doc, token, tf = terms(docs)
        w = self.weights(doc, token, tf, np.array([len(x) for x in docs])).astype(np.float32)
        stop = np.cumsum(np.bincount(doc, minlength=len(docs))).tolist()
        for i, (a, b) in enumerate(zip([0, *stop[:-1]], stop)):
            out[i] = w[a:b] @ self._axes[token[a:b]]
        return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


class Tree:
    """Halves a sample along the principal axis of each node; places any vector in a cell."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = leaves.bit_length() - 1
        self.axis, self.cut = np.zeros((leaves, DIMENSIONS), np.float32), np.zeros(leaves, np.float32)  # node k's children are 2k and 2k + 1
        self.last, self.edges = np.zeros((leaves, DIMENSIONS), np.float32), np.zeros((leaves, BINS - 1), np.float32)
        part = [sample]
        for level in range(self.depth):
            below = []
            for k, x in enumerate(part, 1 << level):
                axis, along = self.principal(x)
                self.axis[k], self.cut[k] = axis, np.median(along) if len(x) else 0
                right = along > self.cut[k]
                below += [x[~right], x[right]]
            part = below
        for k, x in enumerate(part):
            self.last[k], along = self.principal(x)
            if len(x):
                self.edges[k] = np.quantile(along, np.arange(1, BINS) / BINS)

    @staticmethod
    def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        axis = np.linalg.eigh(np.cov(x.T.astype(np.float64)))[1][:, -1].astype(np.float32) if len(x) > 1 else np.ones(DIMENSIONS, np.float32)
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        return axis, x @ axis

    def cells(self, v: np.ndarray) -> np.ndarray:
        node = np.ones(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((v * self.axis[node]).sum(1) > self.cut[node])
        leaf = node - (1 << self.depth)
        return leaf * BINS + ((v * self.last[leaf]).sum(1)[:, None] > self.edges[leaf]).sum(1)


def shards_of(counts: np.ndarray, shard_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each cell, and the number of shards that it is split into (1 for a cell that shares its shard)."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard, held = 0, 0
    for i in np.flatnonzero(counts).tolist():
        n = int(counts[i])
        if held and held + n > shard_docs:
            shard, held = shard + 1, 0
        first[i] = shard
        held += n
        if n > shard_docs:
            parts[i] = -(-n // shard_docs)
            shard, held = shard + int(parts[i]), 0
    return first, parts


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """A BM25 inverted index over some documents. Tokens of one document only, which no other is found by, are left out."""

    def __init__(self, docs: list[np.ndarray], model: Model):
        self.n = n = len(docs)
        doc, token, tf = terms(docs)
        weight = np.rint(model.weights(doc, token, tf, np.array([len(x) for x in docs])).astype(np.float64) * UNIT).astype(np.int32)
        df = np.bincount(token, minlength=1 << 16)
        stop = np.cumsum(np.bincount(doc, minlength=n))
        self.query = [token[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]
        often = np.argsort(-df, kind="stable")[: DENSE_BYTES // (4 * max(1, n))]
        often = often[df[often] * DENSE_SHARE >= max(n, 64)]
        self.row = np.full(1 << 16, -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.int32)
        on = self.row[token] >= 0
        self.dense[self.row[token[on]], doc[on]] = weight[on]
        on = ~on & (df[token] > 1)
        doc, token, weight = doc[on], token[on], weight[on]
        order = np.argsort(token.astype(np.uint16), kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.df = np.where((df > 1) & (self.row < 0), df, 0)
        self.start = np.cumsum(self.df) - self.df
        self.own = model

    def scores(self, i: int) -> np.ndarray:
        """Of each document as a neighbour of document i, times UNIT; of i itself without the tokens that no other has."""
        q = self.query[i]
        row = self.row[q]
        out = self.dense[row[row >= 0]].sum(0, dtype=np.int32).astype(np.int64)
        rare = q[row < 0]
        at = spans(self.start[rare], self.df[rare])
        return out + np.bincount(self.doc[at], self.weight[at], self.n).astype(np.int64) if len(at) else out


def chained(docs: list[np.ndarray], model: Model) -> list[int]:
    """The order in which documents fill windows."""
    index, size = Index(docs, model), [len(x) for x in docs]
    unused, order, end, seed, following = np.ones(len(docs), bool), [], 0, -1, 0

    def put(i: int) -> None:
        nonlocal end
        unused[i] = False
        order.append(i)
        end += size[i]

    while len(order) < len(docs):
        if seed < 0:  # a window's end fell between documents
            while not unused[following]:
                following += 1
            seed = following
            put(seed)
        goal = (end // WINDOW + 1) * WINDOW
        score = np.where(unused, index.scores(seed), -1)
        while end < goal and len(order) < len(docs):
            i = int(score.argmax())
            put(i)
            score[i] = -1
        seed = order[-1] if end % WINDOW else -1
    return order


def sequences(end: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sequences of a stream of tokens: whole windows, then powers of two."""
    rest = end % WINDOW
    size = [WINDOW] * (end // WINDOW) + [1 << b for b in range(WINDOW.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.cumsum([0, *size[:-1]]), np.array(size)


NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pieces(docs: list[np.ndarray], order: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, start in it, length, crc32 of the ids, sequence, offset) for documents that fill sequences in this order."""
    start, _ = sequences(sum(len(docs[i]) for i in order))
    at = k = 0
    for i in order:
        done = 0
        while done < len(docs[i]):
            stop = int(start[k + 1]) if k + 1 < len(start) else 1 << 62
            n = min(stop - at, len(docs[i]) - done)
            yield i, done, n, zlib.crc32(docs[i][done : done + n].astype("<u4").tobytes()), k, at - int(start[k])
            done, at = done + n, at + n
            k += at == stop


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = stored(encode(df.select(F.col(key).alias("key"), F.col(text).alias("text")), path, kind))
    df_counts, n_docs, n_tokens, n_ends = corpus_statistics(rows.select("ids"))
    model = spark.sparkContext.broadcast(Model(df_counts, n_docs, n_tokens / max(1, n_docs)))  # one number a token of the vocabulary
    leaves = min(LEAVES, 1 << max(0, (4 * n_ends // shard_docs).bit_length() - 1))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """Rows with an end, and the ends."""
        for batch, ids in unpacked(batches):
            yield batch, [x[len(x) // WINDOW * WINDOW :] for x in ids]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in ends(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in model.value.vectors(docs)], pa.binary())], ["id", "v"])

    share = min(1.0, leaves * SAMPLE / max(1, n_ends))
    with_end = rows.where(F.col("total") % WINDOW > 0)
    chance = with_end.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    drawn = chance.select("id", "ids").mapInArrow(lean(draw), "id long, v binary").orderBy("id").limit(2 * leaves * SAMPLE).toArrow()  # a bound on the draw's chance excess
    tree = Tree(np.frombuffer(b"".join(drawn.column("v").to_pylist()), np.float32).reshape(-1, DIMENSIONS), leaves)
    placed = spark.sparkContext.broadcast(tree)  # of LEAVES leaves at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in ends(batches):
            cell = placed.value.cells(model.value.vectors(docs))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(c) for c in ("key", "id", "total")), pa.array([x.tobytes() for x in docs], pa.binary())], ["cell", "key", "id", "total", "ids"])

    cells = stored(with_end.mapInArrow(lean(place), f"cell long, key {kind}, id long, total long, ids binary"))
    counted = cells.groupBy("cell").count().toArrow()
    counts = np.zeros(leaves * BINS, np.int64)
    counts[counted.column("cell").to_numpy()] = counted.column("count").to_numpy()
    first, parts = shards_of(counts, shard_docs)
    known = pa.table([pa.array(np.arange(len(first))), pa.array(first), pa.array(parts)], ["cell", "first", "parts"])
    shard = F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    dealt = cells.join(F.broadcast(spark.createDataFrame(known)), "cell").select(shard.alias("shard"), "key", "id", "total", "ids")  # LEAVES * BINS rows at most

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        docs = [np.frombuffer(x, "<u2") for x in t.column("ids").to_pylist()]
        found = np.array(list(pieces(docs, chained(docs, model.value))), np.int64)
        total = t.column("total").to_numpy()[found[:, 0]]
        before = total // WINDOW * WINDOW
        sequence = (t.column("shard")[0].as_py() << 32) + found[:, 4]
        columns = [before + found[:, 1], found[:, 2], found[:, 3], total, sequence, found[:, 5]]
        out = pa.table([t.column("key").take(pa.array(found[:, 0])), *map(pa.array, columns)], NAMES)
        del docs, t
        trim()
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of documents of a window and more."""
        sequence = WHOLE + (TaskContext.get().partitionId() << POS)
        for batch, ids in unpacked(batches):
            row, out = [], []
            for i, x in enumerate(ids):
                for at in range(0, len(x) // WINDOW * WINDOW, WINDOW):
                    row.append(i)
                    out.append((at, WINDOW, zlib.crc32(x[at : at + WINDOW].astype("<u4").tobytes()), len(x), sequence, 0))
                    sequence += 1
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*out))], NAMES)

    shape = f"key {kind}, " + ", ".join(f"{n} long" for n in NAMES[1:])
    long = rows.where(F.col("total") >= WINDOW).select("key", "ids")
    return dealt.groupBy("shard").applyInArrow(fill, shape).unionAll(long.mapInArrow(lean(windows), shape)).withColumnRenamed("key", key)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
