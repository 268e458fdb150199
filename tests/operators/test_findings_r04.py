"""What the fourth review found: work and shuffled bytes that grow faster than their input."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import projections as P
from helixframe.operators import agglomerate as G
from helixframe.operators import cluster, kmers
from helixframe.operators.lineage import stored


def _clusters(r, names, most, grid, places):
    rows = [(c, r.choice((1, 1, 3)) if grid else 1, [float(r.randint(0, 2)) if grid else r.gauss(0, 1) for _ in range(places)]) for c in names for _ in range(r.randint(1, most))]
    r.shuffle(rows)
    return rows, G._side(pa.table({"c": [x[0] for x in rows], "w": [x[1] for x in rows], "f": pa.array([x[2] for x in rows], pa.list_(pa.float64()))}))


@pytest.mark.parametrize("most, grid, near", [(1, False, 50), (1, True, 200), (7, False, 100), (7, True, 90), (40, True, 300), (7, True, 500_000)])
def test_nearest_clusters_of_two_blocks(monkeypatch, most, grid, near):
    """Clusters of many sizes, a few distances at a time, ties and copies among them."""
    monkeypatch.setattr(G, "NEAR", near)
    r = random.Random(most + near)
    (one, a), (two, b) = (_clusters(r, range(at, 40, 2), most, grid, 3) for at in (0, 1))
    for left, right, p, q in ((one, two, a, b), (one, one, a, a)):
        mean = {}
        for i in {x[0] for x in left}:
            for j in {x[0] for x in right} - {i}:
                d = [(u * v, u * v * np.linalg.norm(np.subtract(f, g))) for c, u, f in left if c == i for o, v, g in right if o == j]
                mean[i, j] = mean[j, i] = round(sum(x[1] for x in d) / sum(x[0] for x in d), 9)
        got = {}
        for c, v, o in G._nearest_met(p, q):
            for x in zip(c.tolist(), v.tolist(), o.tolist()):
                got[x[0]] = min(got.get(x[0], (np.inf, 0)), x[1:])
        want = {i: min((v, j) for (k, j), v in mean.items() if k == i) for i in {x[0] for x in left + right}}
        assert {i: o for i, (_, o) in got.items()} == {i: o for i, (_, o) in want.items()}
        assert max(abs(got[i][0] - want[i][0]) for i in want) < 2e-9


def test_blocks_of_points_meet_without_a_shuffle(spark):
    """Each two blocks of points are read where they are stored; before, every point was shuffled once for each block, in every round."""
    r = random.Random(5)
    rows = [(0, i, 1, [r.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    state = spark.createDataFrame(rows, "k int, c long, w long, f array<double>")
    sizes = spark.createDataFrame([(0, 6)], "k int, _n int")
    blocks = stored(G._blocks(state, sizes, 6))
    assert blocks.count() == 6 and len(blocks.inputFiles()) == 6  # a file each, as each two are a task's work
    met = G._met_blocks(blocks)
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    points = np.array([x[3] for x in rows])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {x.c: x.o for x in met.groupBy("c").agg(F.min_by("o", "v").alias("o")).collect()} == dict(enumerate(d.argmin(1).tolist()))


def test_pairs_are_shuffled_as_steps():
    """A number and a count each took some 30 bytes in a row; in order and in buckets a pair takes few."""
    rng = np.random.default_rng(2)
    for k, top in ((10, 40), (10, 12), (3, 12), (1, 4), (15, 60)):
        number = np.concatenate((rng.integers(0, 1 << top, 300_000), np.full(1000, 5), [1, 1, 2]))
        found = {b: kmers._unpacked_pairs(b, cells, k) for b, cells in kmers._packed_pairs(number, k)}
        got = {}
        for x, n in found.values():
            assert (np.diff(x) > 0).all()
            got.update(zip(kmers._mixed(x, k, True).tolist(), n.tolist()))
        assert got == Counter(number.tolist()) and sum(len(x) for x, _ in found.values()) == len(got)
    cells = [c for _, c in kmers._packed_pairs(rng.integers(0, 1 << 40, 1 << 20), 10)]
    assert sum(map(len, cells)) < 3.2 * 2**20


def test_pairs_of_texts_in_small_parts(spark):
    """What is left of a text is what the projection leaves; a task's pairs in many parts, and some in all of them."""
    r = random.Random(8)
    texts = ["".join(r.choice("abcXYZ é漢😀.\n7ACGT") for _ in range(r.randint(0, 90))) for _ in range(60)] + [None, "", "Aé" * 40] + ["Hello, World! " * 9] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seqs = [x.seq for x in df.select(P.dna(F.col("text")).alias("seq")).collect()]
    want = Counter((t[i : i + 4], t[i + 6 : i + 10]) for t in seqs if t for i in range(len(t) - 9))
    for chunk, held in ((8, 30), (1 << 18, 1 << 22)):
        rows = kmers.read_pair_totals(df, 4, 2, "text", chunk, held, P.DNA_BYTES).collect()
        assert {(x.a, x.b): x.n for x in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("kind", ["euclidean", "pearson"])
def test_a_point_is_sent_a_few_times(spark, monkeypatch, kind):
    """Once for each of 8 blocks, however large its group; before, for each block of a thousand points."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(330, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 300 // 299, p.tolist()) for i, p in enumerate(points)], "point_id long, g int, features array<float>")
    sent, dealt = [], cluster._dealt
    monkeypatch.setattr(cluster, "_dealt", lambda rows, *by: sent.append(rows.count()) or dealt(rows, *by))
    rows = cluster.distance_rows(df, ["g"], kind, block=10, digits=6).collect()
    assert sent[0] <= 8 * len(points)
    p = points.astype(float)
    want = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) if kind == "euclidean" else 1 - np.corrcoef(p)
    assert {(x.i, x.j) for x in rows} == {(i, j) for i in range(330) for j in range(i + 1, 330) if i % 300 // 299 == j % 300 // 299}
    assert len(rows) == len({(x.i, x.j) for x in rows}) and all(abs(x.d - want[x.i, x.j]) < 5.1e-7 and x.d == round(x.d, 6) for x in rows)


def test_rounding_is_that_of_sql():
    import duckdb

    values = np.concatenate((np.arange(2000) / 2**10, np.random.default_rng(6).random(2000) * 3, (np.arange(2000) + 0.5) / 1e6, [1e9 + 0.1234565, 2.0, np.inf]))
    with duckdb.connect() as db:
        want = [x[0] for x in db.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values.tolist()]).fetchall()]
    assert cluster._rounded(values, 6).tolist() == want
    assert np.isnan(cluster._rounded(np.array([np.nan]), 6)).all() and str(cluster._rounded(np.array([-1e-16]), 6)[0]) == "0.0"
