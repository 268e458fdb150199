import json
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.operators import patterns
from jobs import kmer_ledger, pattern_screen

ROOT = Path(__file__).parents[2]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def letters(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def rows(seed, first, n, passages=()):
    r = random.Random(seed)
    out = []
    for i in range(first, first + n):
        text = letters(r, r.randrange(0, 120))
        for p in passages:
            if r.random() < 0.5:
                p = list(p)
                for _ in range(r.randrange(0, 4)):
                    p[r.randrange(len(p))] = r.choice("ACGT")
                text += "".join(p) + letters(r, r.randrange(0, 5))
        out.append((i, r.choice([text, text.lower(), " ".join(text)]), "en", r.choice(["a", "b", None, "x/y=z"]), len(text)))
    return [*out, (first + n, None, "en", "a", 0), (first + n + 1, "", None, "a", 0)]


def dna(text):
    """As the projection: every fourth letter of the alphabet is the same base."""
    return "".join("ACGT"[(ord(c) - 65) % 4] for c in (text or "").upper() if "A" <= c <= "Z")


def screened(docs, items, d=2):
    found = []
    for i, t, _, source, _ in docs:
        t = dna(t)
        for k, p in items:
            p = dna(p)
            for a in range(len(t) - len(p) + 1 if len(p) >= 36 else 0):
                n = sum(x != y for x, y in zip(p, t[a : a + len(p)]))
                if n <= d:
                    found.append((i, k, len(p), a, n, source))
    return sorted(found, key=repr)


def written(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_screen_equals_all_placements_and_reruns(spark, tmp_path):
    r = random.Random(3)
    items = [(1, letters(r, 40)), (2, letters(r, 61)), (3, letters(r, 35)), (4, None), (5, "AC" * 20)]
    items.append((6, items[0][1]))  # the same passage under another name
    docs = rows(5, 0, 40, [items[0][1], items[1][1], "AC" * 25]) + rows(5, 0, 1)  # repeated rows
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/i")
    told = pattern_screen.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", f"{tmp_path}/out")
    want = screened(docs, items)
    assert written(pattern_screen.output(spark, f"{tmp_path}/out")) == want and len(want) > 20
    assert told == {"documents": len(docs), "items": 6, "items_too_short": 2, "places": len(want)}
    assert pattern_screen.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", f"{tmp_path}/out") == told
    assert written(pattern_screen.output(spark, f"{tmp_path}/out")) == want
    # a source that is gone leaves nothing behind
    spark.createDataFrame([x for x in docs if x[3] != "b"], DOCS).write.parquet(f"{tmp_path}/fewer")
    pattern_screen.run(spark, f"{tmp_path}/fewer", f"{tmp_path}/i", f"{tmp_path}/out")
    assert written(pattern_screen.output(spark, f"{tmp_path}/out")) == [x for x in want if x[5] != "b"]
    with pytest.raises(ValueError):
        pattern_screen.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", f"{tmp_path}/out", {"min_length": 2})


def test_screen_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/i")
    assert pattern_screen.run(spark, f"{tmp_path}/d", f"{tmp_path}/i", f"{tmp_path}/out")["places"] == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_near_matches_sent_and_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(patterns, "PATTERNS", limit)
    r = random.Random(7)
    texts = [(i, "".join(r.choice("ACé") for _ in range(r.randrange(0, 40)))) for i in range(20)] + [(99, None)]
    words = [(k, "".join(r.choice("ACé") for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 9])] + [(50, None), (51, "")]
    for d in (0, 2):
        got = patterns.near_matches(spark.createDataFrame(texts, "id long, seq string"), spark.createDataFrame(words, "item_id long, pattern string"), d, ["id"])
        want = [(i, k, a, n) for i, t in texts if t for k, p in words if p and len(p) > d for a in range(len(t) - len(p) + 1) if (n := sum(x != y for x, y in zip(p, t[a:]))) <= d]
        assert written(got) == sorted(want, key=repr)


def ledger_of(docs, k):
    flip = str.maketrans("ACGT", "TGCA")
    found = Counter()
    for _, t, _, source, _ in docs:
        t = dna(t)
        found.update((min(x, x[::-1].translate(flip)), source) for x in (t[i : i + k] for i in range(len(t) - k + 1)))
    return sorted(((x, n, s) for (x, s), n in found.items()), key=repr)


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = f"{tmp_path}/d", f"{tmp_path}/out", f"{tmp_path}/mark"
    first, second = rows(1, 0, 30), rows(2, 100, 20)
    config = {"k": 3, "files_per_batch": 2}
    spark.createDataFrame(first, DOCS).repartition(3).write.parquet(docs)
    told = kmer_ledger.run(spark, docs, out, mark, config)
    assert (told["batches"], told["documents"]) == (2, len(first))
    assert written(kmer_ledger.output(spark, out)) == ledger_of(first, 3)
    again = kmer_ledger.run(spark, docs, out, mark, config)
    assert (again["batches"], again["documents"]) == (0, 0) and written(kmer_ledger.output(spark, out)) == ledger_of(first, 3)
    spark.createDataFrame(second, DOCS).coalesce(1).write.mode("append").parquet(docs)
    told = kmer_ledger.run(spark, docs, out, mark, config)
    assert (told["batches"], told["documents"]) == (1, len(second)) and written(kmer_ledger.output(spark, out)) == ledger_of(first + second, 3)
    # a run that breaks off after a batch, and a lost ledger, are mended by the next one
    spark.createDataFrame([], "source string, kmer string, n long").write.mode("overwrite").parquet(f"{out}/ledger")
    kmer_ledger.run(spark, docs, out, mark, config)
    assert written(kmer_ledger.output(spark, out)) == ledger_of(first + second, 3)
    with pytest.raises(ValueError):
        kmer_ledger.run(spark, docs, out, mark, {"k": 13})


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path, monkeypatch):
    docs, out, mark = f"{tmp_path}/d", f"{tmp_path}/out", f"{tmp_path}/mark"
    data = rows(4, 0, 25)
    spark.createDataFrame(data, DOCS).repartition(2).write.parquet(docs)
    plain, seen = kmer_ledger.LOG.info, []

    def broken(message, *a):
        seen.append(a)
        if message.startswith("batch") and len(seen) == 1:
            raise RuntimeError("lost after the write")
        plain(message, *a)

    monkeypatch.setattr(kmer_ledger.LOG, "info", broken)
    with pytest.raises(Exception):
        kmer_ledger.run(spark, docs, out, mark, {"k": 4, "files_per_batch": 1})
    kmer_ledger.run(spark, docs, out, mark, {"k": 4, "files_per_batch": 1})
    assert written(kmer_ledger.output(spark, out)) == ledger_of(data, 4)


def test_command_lines(tmp_path):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    docs = rows(9, 0, 10, ["ACGTTGCA" * 6])
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, "ACGTTGCA" * 6)], "item_id long, text string").write.parquet(f"{tmp_path}/i")
    (tmp_path / "c.json").write_text(json.dumps({"k": 5, "files_per_batch": 10}))
    for job, more in (("pattern_screen", ["--items", f"{tmp_path}/i"]), ("kmer_ledger", ["--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/c.json"])):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--documents", f"{tmp_path}/d", "--out", f"{tmp_path}/{job}", *more], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and f"{len(docs)} documents" in done.stderr, done.stderr[-2000:]
    assert written(kmer_ledger.output(spark, f"{tmp_path}/kmer_ledger")) == ledger_of(docs, 5)
    assert written(pattern_screen.output(spark, f"{tmp_path}/pattern_screen")) == screened(docs, [(1, "ACGTTGCA" * 6)])
