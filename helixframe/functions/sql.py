"""The library's functions by name, for SQL texts: `register(spark)` makes them temporary functions of the session.

| call | gives |
|-|-|
| hf_dna(text) | the sequence that a text stands for, by `projections.dna` |
| hf_reverse_complement(seq) | the other strand |
| hf_hamming(a, b) | differing letters of the common length |
| hf_peptide_mass(pep) | daltons; null with a letter that is no residue |
| hf_kmers(seq, k) | array of (pos, kmer); k from 1 to 1000 |
| hf_linear_spectrum(pep) | array of daltons of all linear parts, 0 among them |
| hf_align(a, b, mode) | table (score, a, b): alignment with unit scores; mode global, local or fitting |

hf_align is a table function in Python, one call a row; the others are SQL functions, which Catalyst inlines. A wrong argument is an
error that names it; null sequences give null, or no rows. Arrays are read by explode or inline once they are selected. For sequences of many
megabytes `kmers.kmers` makes no array.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import align
from ..operators.kmers import kmer_array
from ..operators.spectra import DALTON
from .projections import TO_BASE, UPPER

MODES = ("global", "local", "fitting")
_MASS = "map(" + ", ".join(f"'{a}', {m}" for a, m in DALTON.items()) + ")"
_PREFIX = f"aggregate(transform(filter(split(pep, ''), c -> c <> ''), c -> element_at({_MASS}, c)), array(0), (s, x) -> s || array(element_at(s, -1) + x))"
FUNCTIONS = {
    "hf_dna(text STRING) RETURNS STRING": f"translate(upper(regexp_replace(text, '[^A-Za-z]', '')), '{UPPER}', '{TO_BASE}')",
    "hf_reverse_complement(seq STRING) RETURNS STRING": "translate(reverse(seq), 'ACGT', 'TGCA')",
    "hf_hamming(a STRING, b STRING) RETURNS INT": "aggregate(zip_with(split(left(a, least(length(a), length(b))), ''), split(left(b, least(length(a), length(b))), ''), (x, y) -> IF(x <> y, 1, 0)), 0, (s, x) -> s + x)",
    "hf_peptide_mass(pep STRING) RETURNS INT": f"aggregate(transform(filter(split(pep, ''), c -> c <> ''), c -> element_at({_MASS}, c)), 0, (s, x) -> s + x)",
    "hf_linear_spectrum(pep STRING) RETURNS ARRAY<INT>": f"""aggregate(array({_PREFIX}), CAST(array() AS ARRAY<INT>), (s, p) -> array(0) || flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> y - x))))""",
    "hf_kmers(seq STRING, k INT) RETURNS ARRAY<STRUCT<pos: INT, kmer: STRING>>": f"IF(coalesce(k BETWEEN 1 AND 1000, false), {kmer_array('seq', 'k')}, raise_error('hf_kmers: k must be from 1 to 1000'))",
}


class _Align:
    def eval(self, a: str, b: str, mode: str) -> Iterator[tuple]:
        if mode not in MODES:
            raise ValueError(f"hf_align: mode must be one of {', '.join(MODES)}")
        if a is not None and b is not None:
            x, y, score = align.KERNELS[mode](a, b, align.Scoring())
            yield score, x, y


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, in place of any of these names; returns the names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("hf_align", udtf(_Align, returnType="score double, a string, b string"))
    return [head.split("(")[0] for head in FUNCTIONS] + ["hf_align"]
