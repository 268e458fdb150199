"""Readers of files that Spark splits, against a plain reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import fasta


def plain(text, normalise):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    records, header, body = [], None, []
    for line in [*lines, None]:
        if line is None or line.startswith(">"):
            if body:
                seq = "".join(x.replace(" ", "").upper() if normalise else x.strip(" ") for x in body)
                if seq or not normalise:
                    records.append((header, seq))
            header, body = line[1:].strip(" ") if line is not None else None, []
        else:
            body.append(line)
    return [(n, h, s) for n, (h, s) in enumerate(records)]


def some_file(r):
    lines = []
    for _ in range(r.randrange(0, 22)):
        lines.append(r.choice([">h %d x" % r.randrange(9), ">", "", "  ", "ACGT" * r.randrange(1, 4), " ac gt ", "ACéGT", "x>y"]))
    return r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n"])


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(old, (size, 1))]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [13, 1 << 20])
def test_records_across_splits(spark, tmp_path, tiny_splits, size):
    r = random.Random(size)
    files = {f"f{i}.txt": some_file(r) for i in range(4)}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    tiny_splits(size)
    for normalise in (False, True):
        got = {}
        for x in fasta.multi_fasta(spark, str(tmp_path), normalise).collect():
            got.setdefault(x["file"].rsplit("/", 1)[1], []).append((x["ordinal"], x["header"], x["seq"]))
        assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: w for k, t in files.items() if (w := plain(t, normalise))}
    one = {x["file"].rsplit("/", 1)[1]: x["seq"] for x in fasta.single_fasta(spark, str(tmp_path)).collect()}
    assert one == {k: "".join(x.strip(" ") for x in t.replace("\r\n", "\n").split("\n") if not x.startswith(">")) for k, t in files.items() if t}


def test_a_long_record_and_many_short_ones_are_read_by_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "long.txt").write_text(">one\n" + ("ACGTACGTAC" * 6 + "\n") * 20_000)
    (tmp_path / "many.txt").write_text("".join(f">{i}\nACGT\n" for i in range(100_000)))
    tiny_splits(1 << 17)
    pieces = fasta.fasta_pieces(spark, f"{tmp_path}/long.txt").withColumn("task", F.spark_partition_id())
    assert pieces.select("task").distinct().count() >= 8
    chunks = fasta.fasta_chunks(spark, f"{tmp_path}/long.txt")
    assert [tuple(x) for x in chunks.groupBy("record").agg(F.sum(F.length("seq")), F.max("header")).collect()] == [(1, 1_200_000, "one")]
    assert chunks.agg(F.max(F.length("seq"))).first()[0] <= 1 << 20
    many = fasta.multi_fasta(spark, f"{tmp_path}/many.txt")
    assert many.where("header = CAST(ordinal AS STRING) AND seq = 'ACGT'").count() == 100_000
