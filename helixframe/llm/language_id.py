"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams come from a bounded sample of labelled rows (`sample_rows`, drawn by a hash of the key); the
log-probability matrix (buckets x languages, of fixed size) is broadcast, and texts are scored whole, a batch at a time:
each n-gram is one entry of a sparse row, its probabilities are gathered and summed by document.

Defined cases: a null text, and one without a letter, is `und` with score 0; with no labelled row at all every
text is `und`; more than LANGUAGES different labels are an error; equal scores go to the language first in order; repeated rows are each returned; an empty table gives no rows; a text of any
length is scored whole, slice by slice; only the key, text and label are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .token_counts import byte_batches

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
LETTER_LIKE = re.compile(r"[^\W\d_]")  # letters, and numerals that are neither letters nor digits
LANGUAGES = 1000  # at most: the matrix holds BUCKETS numbers of each
SLICE_CHARS = 500_000
BATCH_BYTES = 500_000


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of the lower-cased text, n in SIZES, all of size n after all of size n-1."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], c.copy()
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = (h[:-1] * np.uint32(0x9E3779B1)) ^ (c[n - 1 :] * np.uint32(0x85EBCA77) + np.uint32(n))
        if n in SIZES:
            x = h ^ (h >> np.uint32(15))
            out.append((x * np.uint32(0x2C1B3C6D)) >> np.uint32(16))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    """Whether it holds a character of a category L."""
    return any(m[0].isalpha() for m in LETTER_LIKE.finditer(text))


def slices(text: str) -> Iterator[str]:
    """Consecutive slices that overlap by what an n-gram needs; a text of usual length is one slice."""
    for i in range(0, max(1, len(text)), SLICE_CHARS):
        yield text[i : i + SLICE_CHARS + (max(SIZES) - 1)]


def train(labelled: DataFrame, key: str, text: str, label: str, sample_rows: int = 20_000, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """The languages, and a matrix of log-probabilities with the log-priors as its last row."""
    labelled = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    share = sample_rows / max(1, labelled.select(key, label).count())
    draw = F.crc32(F.concat(F.lit("sample:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows = labelled.where(draw < F.lit(min(1.0, share) * 2.0**32)).select(F.col(text).alias("text"), F.col(label).alias("label"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                s = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                for part in slices(t):
                    s[:BUCKETS] += np.bincount(ngram_buckets(part), minlength=BUCKETS)
                s[BUCKETS] += 1
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at])], ["label", "bucket", "n"])

    counts = rows.mapInArrow(lean(tally), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("label").to_pylist()))
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    table_ = np.zeros((BUCKETS + 1, len(names)))
    if names:
        place = {x: i for i, x in enumerate(names)}
        table_[counts.column("bucket").to_numpy(), [place[x] for x in counts.column("label").to_pylist()]] = counts.column("n").to_numpy()
        table_[:BUCKETS] = np.log(table_[:BUCKETS] + alpha) - np.log(table_[:BUCKETS].sum(0) + alpha * BUCKETS)
        table_[BUCKETS] = np.log(table_[BUCKETS] / table_[BUCKETS].sum())
    return names, table_


def score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log-likelihoods, texts x languages."""
    out = np.tile(matrix[BUCKETS], (len(texts), 1))
    columns = [np.ascontiguousarray(matrix[:BUCKETS, k]) for k in range(matrix.shape[1])]
    entries = [(i, ngram_buckets(s)) for i, t in enumerate(texts) for s in slices(t)]
    entries = [(i, b) for i, b in entries if len(b)]
    if entries:
        buckets, rows = np.concatenate([b for _, b in entries]), [i for i, _ in entries]
        starts = np.cumsum([0, *(len(b) for _, b in entries[:-1])])
        for k, column in enumerate(columns):
            np.add.at(out[:, k], rows, np.add.reduceat(column[buckets], starts))
    return out


def predict(df: DataFrame, names: list[str], matrix: np.ndarray, key: str, text: str) -> DataFrame:
    """key, lang_pred and score (the winner's posterior) of each row."""
    model = df.sparkSession.sparkContext.broadcast(matrix)  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in byte_batches(batches, "text", BATCH_BYTES):
            texts = [t.decode() for t in raw]
            known = [i for i, t in enumerate(texts) if names and has_letter(t)]
            pred, prob = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                s = score([texts[i] for i in known], model.value)
                best = s.argmax(1)
                p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                for i, b, x in zip(known, best, p):
                    pred[i], prob[i] = names[b], float(x)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(pred, pa.string()), pa.array(prob, pa.float64())], ["key", "lang_pred", "score"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), f"key {df.schema[key].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    names, matrix = train(docs.where(fold != 2), "doc_id", "text", "lang")
    return predict(docs, names, matrix, "doc_id", "text").select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
