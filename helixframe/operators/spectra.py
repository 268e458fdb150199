"""Mass spectra and peptides. Masses are whole numbers: daltons, or tenths of a dalton (decimasses), so that equality is exact."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import stored

# Residues in their order, with decimasses.
RESIDUES = {
    "G": 570, "A": 710, "S": 870, "P": 970, "V": 990, "T": 1011, "C": 1030, "I": 1131, "L": 1131, "N": 1141, "D": 1151,
    "K": 1281, "Q": 1281, "E": 1291, "M": 1312, "O": 1322, "H": 1371, "F": 1472, "R": 1562, "Y": 1632, "U": 1681, "W": 1862,
}
ALPHABET = "".join(RESIDUES)
DECI = RESIDUES
DALTON = {a: m // 10 for a, m in RESIDUES.items()}


def mass_table(spark: SparkSession) -> DataFrame:
    """aa, ord, mass_int, mass_decida."""
    return spark.createDataFrame([(a, i, DALTON[a], DECI[a]) for i, a in enumerate(RESIDUES)], "aa string, ord int, mass_int int, mass_decida int")


def _masses(pep: Column, masses: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for am in masses.items() for x in am])
    return F.transform(F.filter(F.split(pep, ""), lambda c: c != ""), lambda c: F.element_at(table, c))


def peptide_mass(pep: Column, masses: dict[str, int] = DALTON) -> Column:
    return F.aggregate(_masses(pep, masses), F.lit(0), lambda s, x: s + x)


def prefix_masses(pep: Column, masses: dict[str, int] = DALTON) -> Column:
    return F.aggregate(_masses(pep, masses), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _differences(prefix: Column) -> Column:
    """All later minus earlier prefix masses: the masses of the linear parts."""
    return F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda y: y - x)))


def linear_spectrum(df: DataFrame, pep: str = "pep", masses: dict[str, int] = DALTON, zero: bool = True) -> DataFrame:
    """One row per mass of a linear part, 0 among them unless told otherwise. Narrow: arrays, then one explode."""
    d = df.withColumn("_p", prefix_masses(F.col(pep), masses))
    parts = _differences(F.col("_p"))
    return d.withColumn("mass", F.explode(F.concat(F.array(F.lit(0)), parts) if zero else parts)).drop("_p")


def cyclic_spectrum(df: DataFrame, pep: str = "pep", masses: dict[str, int] = DECI, drop_share: float = 0.0, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """0, the linear parts, and the rest of the ring for each inner part. With drop_share, that share of the masses (by banker's
    rounding) goes, chosen by a hash with the seed."""
    if not drop_share:  # two ends at a time, straight from the prefix masses
        d = df.withColumn("_p", prefix_masses(F.col(pep), masses))
        n, total = F.size("_p") - 1, F.element_at("_p", -1)
        first = d.where(n > 0).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
        both = first.select("*", F.posexplode(F.slice("_p", F.col("_i") + 2, F.size("_p"))).alias("_k", "_y"))
        part = F.col("_y") - F.element_at("_p", F.col("_i") + 1)
        inside = (F.col("_i") > 0) & (F.col("_i") + F.col("_k") + 1 < n)
        parts = both.withColumn("mass", F.explode(F.when(inside, F.array(part, total - part)).otherwise(F.array(part))))
        return parts.select(*df.columns, "mass").union(df.where(F.col(pep).isNotNull()).select(*df.columns, F.lit(0).alias("mass")))
    dropped = _dropped(F.col(pep), masses, drop_share, seed)
    deal = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a peptide is little to read and much to work out
    return df.repartition(deal).withColumn("mass", F.explode(dropped))


def _dropped(pep: Column, masses: dict[str, int], share: float, seed: int) -> Column:
    """The masses of the cyclic spectrum that stay, in order, as an array; unknown ones, after a letter that is no residue, are null and come last. An Arrow
    function: in SQL the masses, their hashes and both sorts are folds, interpreted mass by mass. A batch works out equal peptides once."""

    def one(p: str) -> list[int | None]:
        known = len(p) if all(c in masses for c in p) else next(i for i, c in enumerate(p) if c not in masses)
        own = [masses[c] for c in p[:known]]
        n = len(p)
        size = 1 + n * (n + 1) // 2 + max(n - 1, 0) * max(n - 2, 0) // 2
        m = _cyclic(own) if known == n else _linear(own)
        m += [None] * (size - len(m))
        draw = sorted(range(size), key=lambda i: hashlib.md5(f"{seed}:{p}:{i}".encode()).digest())
        return [m[i] for i in sorted(draw[: size - round(size * share)])]

    def run(peps: pa.Array) -> pa.Array:
        found = peps.dictionary_encode()
        made = [None if p is None else one(p) for p in found.dictionary.to_pylist()]
        return pa.array(made, pa.list_(pa.int32())).take(found.indices)

    return F.arrow_udf(run, "array<int>")(pep)


def spectrum_vector(spectra: DataFrame, by: list[str], mass: str = "mass") -> DataFrame:
    """Sparse counts: by, mass, n."""
    return spectra.groupBy(*by, mass).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(peptides: DataFrame, pep: str = "pep", order: str = "ordinal") -> DataFrame:
    """One row per peptide, its first ordinal."""
    return peptides.groupBy(pep).agg(F.min(order).alias(order))


def match_scores(spectra: DataFrame, peptides: DataFrame, spec: str = "spec_id", pep: str = "pep") -> DataFrame:
    """spec, pep, score: shared counts of the sparse vectors (columns mass, n). Pairs without a common mass don't occur.

    The join is on mass. Spark splits it where a mass is common; what it yields is summed before the shuffle."""
    p = peptides.withColumnRenamed("n", "_m")
    both = spectra.join(p, "mass").groupBy(spec, pep)
    return both.agg(F.sum(F.least("n", "_m")).alias("score"))


def best_matches(spectra: DataFrame, peptides: DataFrame, order: DataFrame, threshold: int, spec: str = "spec_id", pep: str = "pep") -> DataFrame:
    """Each spectrum's best peptide, ties to the earliest; none above the threshold gives a null peptide and score 0.

    Below a threshold of 0 a score of 0 can win: a spectrum that shares no mass with any peptide gets the earliest of all."""
    scored = match_scores(spectra, peptides, spec, pep).where(F.col("score") > threshold).join(order, pep)
    best = scored.groupBy(spec).agg(F.max(F.struct(F.col("score"), (-F.col("ordinal")).alias("o"), F.col(pep))).alias("b"))
    found = spectra.select(spec).distinct().join(best, spec, "left").select(spec, F.col(f"b.{pep}").alias(pep), F.coalesce("b.score", F.lit(0)).alias("score"))
    if threshold >= 0:
        return found
    earliest = order.agg(F.min(F.struct("ordinal", pep))[pep].alias("_first"))  # one row
    return found.crossJoin(F.broadcast(earliest)).withColumn(pep, F.coalesce(pep, "_first")).drop("_first")


def _winners(scored: DataFrame, order: DataFrame, spec: str, pep: str) -> DataFrame:
    """The best-scored row of each spectrum, ties to the earliest peptide."""
    best = scored.join(order, pep).groupBy(spec).agg(F.max(F.struct(F.col("score"), (-F.col("ordinal")).alias("o"), F.col(pep))).alias("b"))
    return best.select(spec, F.col(f"b.{pep}").alias(pep), F.col("b.score").alias("score"))


def candidates(spectra: DataFrame, peptides: DataFrame, order: DataFrame, threshold: int, spec: str = "spec_id", pep: str = "pep", rare: int = 2) -> DataFrame:
    """spec, pep: the pairs that can be a spectrum's best with a score above the threshold; a spectrum meets only these.

    A mass can add at most the smaller of its counts in the spectrum and in any peptide. First each spectrum meets the peptides that share one of its
    `rare` rarest masses, and the whole score of the best of these is a score that the winner has at least. Its most common masses are then
    set aside as long as they cannot add up to that score together: a peptide that shares none of the others cannot win, so only the
    others, which few peptides have, are joined."""
    stats = peptides.groupBy("mass").agg(F.count(F.lit(1)).alias("df"), F.max("n").alias("top"))
    terms = stored(spectra.join(stats, "mass").select(spec, "mass", "n", "df", F.least("n", "top").alias("most")), small=True)
    rarest = terms.withColumn("r", F.row_number().over(Window.partitionBy(spec).orderBy("df", "mass"))).where(F.col("r") <= rare)
    first = _winners(match_scores(rarest.select(spec, "mass", "n"), peptides, spec, pep), order, spec, pep).select(spec, pep)
    own = first.join(peptides.withColumnRenamed("n", "_m"), pep).join(spectra, [spec, "mass"]).groupBy(spec).agg(F.sum(F.least("n", "_m")).alias("_least"))
    aside = F.sum("most").over(Window.partitionBy(spec).orderBy(F.desc("df"), "mass"))
    need = F.greatest(F.coalesce("_least", F.lit(0)), F.lit(threshold + 1))
    kept = terms.withColumn("_aside", aside).join(own, spec, "left").where(F.col("_aside") >= need)
    return kept.select(spec, "mass").join(peptides.select(pep, "mass"), "mass").select(spec, pep).distinct()


def best_matches_pruned(spectra: DataFrame, peptides: DataFrame, order: DataFrame, threshold: int, spec: str = "spec_id", pep: str = "pep", rare: int = 2) -> DataFrame:
    """best_matches(), for thresholds of 0 or more, of `candidates` alone: scores are added up only for pairs that can win."""
    if threshold < 0:
        raise ValueError("a score of 0 needs all pairs: use best_matches")
    pairs = candidates(spectra, peptides, order, threshold, spec, pep, rare)
    scored = pairs.join(peptides.withColumnRenamed("n", "_m"), pep).join(spectra, [spec, "mass"]).groupBy(spec, pep).agg(F.sum(F.least("n", "_m")).alias("score"))
    best = _winners(scored.where(F.col("score") > threshold), order, spec, pep)
    return spectra.select(spec).distinct().join(best, spec, "left").select(spec, pep, F.coalesce("score", F.lit(0)).alias("score"))


def consistent(peptides: DataFrame, spectrum: DataFrame, pep: str = "pep", masses: dict[str, int] = DECI) -> DataFrame:
    """The peptides whose linear masses, counted, all occur in the spectrum (mass, n)."""
    own = linear_spectrum(peptides.select(pep).distinct(), pep, masses).groupBy(pep, "mass").agg(F.count(F.lit(1)).alias("need"))
    short = own.join(spectrum.select("mass", "n"), "mass", "left").where("n IS NULL OR need > n").select(pep).distinct()
    return peptides.join(short, pep, "left_anti")


def expand(peptides: DataFrame, table: DataFrame, pep: str = "pep") -> DataFrame:
    """Each peptide with each residue after it; path keeps the order of generation."""
    t = F.broadcast(table.select("aa", F.col("ord").alias("_o")))  # 22 rows
    return peptides.crossJoin(t).withColumn("path", F.concat("path", F.array("_o"))).withColumn(pep, F.concat(pep, "aa")).drop("aa", "_o")


def convolution(spectra: DataFrame, by: list[str], top: int, low: int = 570, high: int = 2000, mass: str = "mass") -> DataFrame:
    """by, diff, n: the most frequent differences within bounds, `top` of them and whatever ties with the last."""
    sorted_ = spectra.groupBy(*by).agg(F.array_sort(F.collect_list(mass)).alias("_m"))
    d = sorted_.select(*by, F.explode(_differences(F.col("_m"))).alias("diff")).where(F.col("diff").between(low, high))
    counts = d.groupBy(*by, "diff").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.col("n").desc()))).where(F.col("_r") <= top).drop("_r")


def residues_near(masses: DataFrame, table: DataFrame, tolerance: int = 5, mass: str = "diff", by: list[str] = ()) -> DataFrame:
    """by, aa: residues within the tolerance of one of the masses; all of them where none is."""
    hit = masses.join(F.broadcast(table), F.abs(F.col("mass_decida") - F.col(mass)) <= tolerance).select(*by, "aa", "ord").distinct()
    none = masses.select(*by).distinct().join(hit.select(*by).distinct(), list(by), "left_anti") if by else None
    return hit if none is None else hit.union(none.crossJoin(F.broadcast(table.select("aa", "ord"))))


def tolerant_score(a: Column, b: Column, tolerance: float) -> Column:
    """Pairs matched by walking two sorted arrays together: a pair within the tolerance uses up both."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(s: Column, _: Column) -> Column:
        x, y = F.get(a, s["i"]), F.get(b, s["j"])
        over = x.isNull() | y.isNull()
        hit = ~over & (F.abs(x - y) <= tolerance)
        left = ~over & ~hit & (x < y)
        right = ~over & ~hit & ~(x < y)
        add = lambda c, w: c + w.cast("int")
        return F.struct(add(s["i"], hit | left).alias("i"), add(s["j"], hit | right).alias("j"), add(s["n"], hit).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), zero, step, lambda s: s["n"])


def trim(board: DataFrame, top: int, score: str = "score", by: list[str] = ()) -> DataFrame:
    """The `top` best rows of a group and what ties with the last of them."""
    if not by:  # the last of the best, found without one window over all rows
        last = board.orderBy(F.col(score).desc()).limit(top).agg(F.min(score).alias("_last"))
        return board.crossJoin(F.broadcast(last)).where(F.col(score) >= F.col("_last")).drop("_last")
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    return board.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= top).drop("_r")


# Kernels of the searches that are sequential within one spectrum; they run in parallel over spectra.


def _linear(masses: list[int]) -> list[int]:
    p = np.concatenate(([0], np.cumsum(masses)))
    i, j = np.triu_indices(len(p), 1)
    return sorted([0, *(p[j] - p[i]).tolist()])


def _cyclic(masses: list[int]) -> list[int]:
    p = np.concatenate(([0], np.cumsum(masses)))
    i, j = np.triu_indices(len(p), 1)
    part = p[j] - p[i]
    inner = (i > 0) & (j < len(masses))
    return sorted([0, *part.tolist(), *(p[-1] - part[inner]).tolist()])


def _walk(a: list[int], b: list[int], tolerance: float) -> int:
    i = j = n = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            i, j, n = i + 1, j + 1, n + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def branch_and_bound(spectrum: list[int], masses: dict[str, int] = DECI) -> str | None:
    """The first peptide, in order of generation, whose cyclic spectrum is the given one."""
    have, parent, want = Counter(spectrum), max(spectrum, default=0), sorted(spectrum)
    level: list[str] = [""]
    while level:
        after = []
        for pep in level:
            for aa in masses:
                new = pep + aa
                own = [masses[c] for c in new]
                total = sum(own)
                if total == parent:
                    if _cyclic(own) == want:
                        return new
                elif total < parent and not Counter(_linear(own)) - have:
                    after.append(new)
        level = after
    return None


def leaderboard(spectrum: list[int], top: int = 25, tolerance: int = 5, shift: int = 0, m: int | None = None, masses: dict[str, int] = DECI) -> tuple[str | None, int]:
    """A beam search: peptides grow residue by residue, the best by linear score stay. m: residues are those near the m most
    frequent differences of the spectrum; None: all."""
    spec = sorted(x - shift for x in spectrum)
    parent = max(spec, default=0)
    residues = dict(masses)
    if m is not None:
        diffs = Counter(b - a for i, a in enumerate(spec) for b in spec[i + 1 :] if 570 <= b - a <= 2000)
        if diffs:
            last = sorted(diffs.values(), reverse=True)[: m][-1]
            near = {a: x for a, x in masses.items() if any(abs(x - d) <= tolerance for d, n in diffs.items() if n >= last)}
            residues = near or residues
    board, best, best_score = [()], None, -1
    while board:
        grown, scored = [p + (a,) for p in board for a in residues], []
        for p in grown:
            own = [masses[a] for a in p]
            total = sum(own)
            if abs(total - parent) <= tolerance:
                s = _walk(_cyclic(own), spec, tolerance)
                if s > best_score:
                    best, best_score = "".join(p), s
            if total <= parent + tolerance:
                scored.append((_walk(_linear(own), spec, tolerance), p))
        scored.sort(key=lambda x: -x[0])
        board = [p for s, p in scored if len(scored) <= top or s >= scored[top - 1][0]]
    return best, best_score


def sequence_spectra(spectra: DataFrame, spec: str = "spec_id", mass: str = "mass", method: str = "branch_and_bound", **options) -> DataFrame:
    """spec, pep, score: one peptide for each cyclic spectrum (decimasses, one row a mass)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf[mass].astype(int).tolist()
        pep, score = (branch_and_bound(s, **options), None) if method == "branch_and_bound" else leaderboard(s, **options)
        return pd.DataFrame({spec: [key[0]], "pep": [pep], "score": pd.array([score], "Int32")})

    # dealt by number, as a spectrum is much work in few bytes
    dealt = spectra.repartition(int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions")), spec)
    return dealt.groupBy(spec).applyInPandas(run, f"{spec} {spectra.schema[spec].dataType.simpleString()}, pep string, score int")


def _dense(masses: list[int]) -> np.ndarray:
    return np.bincount(np.array(masses, int), minlength=1) if len(masses) else np.zeros(1, int)


def tail_probability(masses: list[int], k: int, residues: dict[str, int] = DALTON) -> float:
    """The probability mass of random peptides that score k or more, over all masses up to the largest."""
    v = _dense(masses)
    top = len(v)
    steps = list(residues.values())
    table = np.zeros((top, int(np.minimum(v, 1).sum()) + 2))
    table[0, 0] = 1
    for x in range(1, top):
        came = sum((table[x - a] for a in steps if a <= x), np.zeros(table.shape[1])) / len(steps)
        table[x] = np.concatenate(([0.0], came[:-1])) if v[x] else came
    return float(min(1.0, table[:, k:].sum())) if k < table.shape[1] else 0.0


def spectral_alignment(pep: str, masses: list[int], d: int, extra_cell: bool = False, residues: dict[str, int] = DALTON) -> str | None:
    """The peptide with up to d mass shifts that best explains the spectrum, as in K(+1)SII.

    Cell (i, y, z): i residues read, mass y, z shifts used. extra_cell takes the spectrum one cell longer than its largest mass."""
    v = _dense(masses).astype(float)
    n, cells = len(pep), len(v) + extra_cell
    gain = np.zeros(cells)
    gain[1:] = v[: cells - 1] if extra_cell else v[1:cells]
    F_ = np.full((d + 1, n + 1, cells), -np.inf)
    F_[0, 0, 0] = 0
    for i, aa in enumerate(pep, 1):
        a = residues[aa]
        for z in range(d + 1):
            plain = np.full(cells, -np.inf)
            if a < cells:
                plain[a:] = F_[z, i - 1, :-a]
            best = plain
            if z:
                before = np.concatenate(([-np.inf], np.maximum.accumulate(F_[z - 1, i - 1])[:-1]))
                best = np.maximum(plain, before)
            F_[z, i] = best + gain
            F_[z, i, 0] = -np.inf
    z, y, out = int(np.argmax(F_[:, n, cells - 1])), cells - 1, []
    if np.isneginf(F_[z, n, y]):
        return None
    for i in range(n, 0, -1):
        a = residues[pep[i - 1]]
        want = F_[z, i, y] - gain[y]
        came = None
        if z:
            hits = np.flatnonzero(F_[z - 1, i - 1, :y] == want)
            came = int(hits[0]) if len(hits) else None
        if came is not None:
            shift = y - came - a
            out.append(f"{pep[i - 1]}({shift:+d})")
            y, z = came, z - 1
        else:
            out.append(pep[i - 1])
            y -= a
    return "".join(reversed(out))


def significance(matches: DataFrame, spectra: DataFrame, k: int, d: int, extra_cell: bool = False, spec: str = "spec_id") -> DataFrame:
    """matches with probability (4 decimals) and the peptide's spectral alignment; spectra have one row a mass."""
    lists = spectra.groupBy(spec).agg(F.collect_list("mass").alias("_m"))
    rows = matches.join(lists, spec)

    def run(pep: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = [(None, None) if p is None else (round(tail_probability(list(x), k), 4), spectral_alignment(p, list(x), d, extra_cell)) for p, x in zip(pep, m)]
        return pd.DataFrame(out, columns=["probability", "modified"])

    run.__annotations__ = {"pep": pd.Series, "m": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(run, "struct<probability:double,modified:string>")("pep", "_m")
    return rows.withColumn("_r", made).select(*matches.columns, "_r.probability", "_r.modified")
