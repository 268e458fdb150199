"""Published small results, as literals."""

import numpy as np
import pytest

from helixframe.operators import align, cluster, kmers, motifs, phylo, rearrange, spectra

DISTANCES = np.array([[0, 28, 4, 19, 27, 15], [28, 0, 24, 29, 7, 25], [4, 24, 0, 23, 31, 19], [19, 29, 23, 0, 22, 4], [27, 7, 31, 22, 0, 18], [15, 25, 19, 4, 18, 0]])
POINTS = [(1.0, 2.0, 3.0, 4.0), (1.1, 2.1, 2.9, 4.1), (9.0, 8.9, 9.1, 9.2), (8.8, 9.2, 9.0, 9.1), (4.9, 5.1, 5.0, 5.2)]


def test_upgma():
    assert phylo.newick(phylo.upgma(range(6), DISTANCES)) == "((1:3.50,4:3.50)8:9.25,((0:2.00,2:2.00)6:7.50,(3:2.00,5:2.00)7:7.50)9:3.25)10;"


def test_neighbor_joining():
    want = "((3:4.00,5:0.00)(3,5):2.75,((1:4.50,4:2.50)(1,4):12.50,(0:0.67,2:3.33)(0,2):9.50)((1,4),(0,2)):2.75)((3,5),((1,4),(0,2)));"
    assert phylo.newick(phylo.neighbor_joining(range(6), DISTANCES)) == want


def test_cyclopeptide():
    own = spectra._cyclic([spectra.DECI[a] for a in "WEHTQNHMYD"])
    assert len(own) == 92 and spectra.branch_and_bound(own) == "TKNHMYDWEH"
    assert spectra.leaderboard(own, 25, 5)[1] == 92


@pytest.mark.parametrize("pep,p,modified", [("KSIIGDM", 0.0478, "K(+1)SIIGDM"), ("SMHIIM", 0.0206, "S(+1)MHIIM"), ("GSVPEAGIVM", 0.2504, "G(+1)SVPEAGIVM")])
def test_peptide_matches(pep, p, modified):
    masses = spectra._linear([spectra.DALTON[a] for a in pep])
    assert round(spectra.tail_probability(masses, 3), 4) == p
    assert spectra.spectral_alignment(pep, masses, 1, extra_cell=True) == modified
    assert spectra.spectral_alignment(pep, masses, 1) == pep


def test_psm_scores(spark):
    peps = ["GSVPEWYIVM", "GSVPEAGIVM", "MMAKLVDCGQAV", "KSIIGDM", "SMHIINN", "SMHIIM"]
    order = spark.createDataFrame(list(enumerate(peps)), "ordinal int, pep string")
    vectors = spectra.spectrum_vector(spectra.linear_spectrum(order.select("pep"), zero=False), ["pep"])
    spec = spectra.linear_spectrum(spark.createDataFrame([("a", "KSIIGDM"), ("b", "SMHIIM"), ("c", "GSVPEAGIVM"), ("d", "W")], "spec_id string, pep string")).select("spec_id", "mass")
    got = {r["spec_id"]: (r["pep"], r["score"]) for r in spectra.best_matches(spectra.spectrum_vector(spec, ["spec_id"]), vectors, order, 3).collect()}
    assert got == {"a": ("KSIIGDM", 28), "b": ("SMHIIM", 21), "c": ("GSVPEAGIVM", 55), "d": (None, 0)}


def test_two_breaks(spark):
    p, q = [[1], [2], [3, 4, 5]], [[1], [-3, -2], [4], [5]]
    steps = rearrange.two_break_scenario(p, q)
    assert len(steps) == 4 and sorted(map(sorted, (map(abs, c) for c in steps[-1]))) == sorted(map(sorted, (map(abs, c) for c in q)))
    rows = [("x", g, c, o, b) for g, genome in (("P", p), ("Q", q)) for c, ch in enumerate(genome) for o, b in enumerate(ch)]
    df = spark.createDataFrame(rows, "o string, genome string, chrom int, ord int, block int")
    assert rearrange.two_break_distance(df, ["o"]).first()["distance"] == 3
    assert rearrange.format_genome(q) == "[+1][-3 -2][+4][+5]"


def test_clusters():
    d = np.array([[np.linalg.norm(np.array(a) - np.array(b)) for b in POINTS] for a in POINTS])
    assert sorted(cluster.cast_clusters(range(5), d, 0.8)) == [[0, 1], [2, 3], [4]]
    r = np.array([[1 - np.corrcoef(a, b)[0, 1] for b in POINTS] for a in POINTS])
    merges = {}
    for parent, child, *_ in cluster.hierarchical(range(5), r):
        merges.setdefault(parent, []).append(child)
    assert merges == {5: [0, 1], 6: [3, 4], 7: [2, 5], 8: [6, 7]}


def test_lloyd_and_k_centres(spark):
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(POINTS)], "point_id int, features array<double>")
    centres = cluster.k_centres(df, 3, POINTS[1])
    assert centres == [list(POINTS[1]), list(POINTS[2]), list(POINTS[4])]
    got = cluster.lloyd(df, [list(POINTS[0]), list(POINTS[2]), list(POINTS[4])])
    assert np.allclose(sorted(got), sorted([[1.05, 2.05, 2.95, 4.05], [8.9, 9.05, 9.05, 9.15], list(POINTS[4])]))


def test_motif_found_verbatim(spark):
    import random

    r = random.Random(1)
    motif = "AAAAAAATTTTTTTT"
    rows = []
    for i in range(6):
        s = "".join(r.choice("ACGT") for _ in range(200))
        at = r.randrange(180)
        rows.append((0, i, s[:at] + motif + s[at:]))
    got = motifs.search(spark.createDataFrame(rows, "g int, ordinal int, seq string"), 15, ["g"]).first()
    assert got["score"] == 0 and got["motifs"] == [motif] * 6


def test_alignment_identities():
    p = align.Scoring()
    assert align.needleman_wunsch("GATTACA", "GATTACA", p) == ("GATTACA", "GATTACA", 7.0)
    assert align.affine("AAAACCCC", "AAAA", p)[2] == 4 - 1 - 3 * 0.5
    assert kmers.BASES == "ACGT"
