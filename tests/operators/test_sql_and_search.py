"""Functions by name in SQL texts, and the pruned peptide search."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sql
from helixframe.operators import spectra


def test_functions_in_one_text(spark):
    assert set(sql.register(spark)) == {"hf_dna", "hf_reverse_complement", "hf_hamming", "hf_peptide_mass", "hf_kmers", "hf_linear_spectrum", "hf_align"}
    rows = spark.createDataFrame([(1, "ACGTA"), (2, "AC"), (3, ""), (4, None)], "id int, seq string")
    got = spark.sql("SELECT id, inline(ks) FROM (SELECT id, hf_kmers(seq, 3) AS ks FROM {t})", t=rows).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "ACG"), (1, 1, "CGT"), (1, 2, "GTA")]
    one = spark.sql("SELECT hf_reverse_complement('AACG') AS a, hf_hamming('ACGTT', 'AGGT') AS b, hf_peptide_mass('GAS') AS c, hf_peptide_mass('G*') AS d, hf_dna('a-B j') AS e, hf_hamming(NULL, 'A') AS f").first()
    assert tuple(one) == ("CGTT", 1, 57 + 71 + 87, None, "ACC", None)
    masses = spark.sql("SELECT hf_linear_spectrum('GAG') AS m, hf_kmers('aéa', 2) AS k, hf_kmers(NULL, 2) AS n, hf_linear_spectrum(NULL) AS o").first()
    assert (list(map(tuple, masses["k"])), masses["n"], masses["o"]) == ([(0, "aé"), (1, "éa")], None, None)
    assert sorted(masses["m"]) == sorted([0, 57, 71, 57, 128, 128, 185])
    aligned = spark.sql("SELECT id, score, a, b FROM {t}, LATERAL hf_align(seq, 'ACTA', 'global') WHERE id < 3", t=rows).collect()
    assert sorted(map(tuple, aligned)) == [(1, 3.0, "ACGTA", "AC-TA"), (2, 0.0, "AC--", "ACTA")]


@pytest.mark.parametrize("text", ["SELECT hf_kmers('ACGT', 0)", "SELECT hf_kmers('ACGT', NULL)", "SELECT * FROM hf_align('A', 'C', 'best')"])
def test_wrong_arguments_are_named(spark, text):
    sql.register(spark)
    with pytest.raises(Exception, match="hf_(kmers|align): (k|mode) must be"):
        spark.sql(text).collect()


@pytest.mark.parametrize("rare", [1, 3])
def test_pruned_search_equals_the_full_one(spark, rare):
    r = random.Random(rare)
    letters = "GASPVTLN"
    peps = sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(150)})
    order = spark.createDataFrame([(i, p) for i, p in enumerate(r.sample(peps, len(peps)))], "ordinal int, pep string")
    vectors = spectra.spectrum_vector(spectra.linear_spectrum(order.select("pep"), zero=False), ["pep"])
    specs = [(str(i), "".join(r.choice(letters + "W") for _ in range(r.randint(1, 9)))) for i in range(40)]
    spec = spectra.spectrum_vector(spectra.linear_spectrum(spark.createDataFrame(specs, "spec_id string, pep string"), zero=False).select("spec_id", "mass"), ["spec_id"])
    for threshold in (0, 4):
        full = spectra.best_matches(spec, vectors, order, threshold)
        pruned = spectra.best_matches_pruned(spec, vectors, order, threshold, rare=rare)
        assert sorted(map(tuple, pruned.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    few = spectra.candidates(spec, vectors, order, 0, rare=rare).count()
    assert few < spectra.match_scores(spec, vectors).count() * 0.7
    with pytest.raises(ValueError):
        spectra.best_matches_pruned(spec, vectors, order, -1)
    assert spectra.best_matches_pruned(spec.where(F.lit(False)), vectors, order, 3).count() == 0
