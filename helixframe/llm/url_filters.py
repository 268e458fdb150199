"""URL filters: host and path rules, then naive Bayes over segmented names.

Rules are SQL expressions. For the urls that no rule fits, host labels and path tokens are split into words by a unigram
Viterbi (word counts come from the titles of all pages; all words count that occur in a url, of which the `vocabulary` that most urls
hold are sent to executors and the others joined to the urls that hold them), and multinomial naive Bayes scores the words and the
shape of the host (its labels' kinds: letters as a, digits as 0, `a.a-a` say).

Urls have no labels. A host that holds a seed word is a bad example, and blocked; every other url is unlabelled, not good. The model is
fitted by expectation maximisation: unlabelled urls count in both classes by their probability, which starts at 0 and comes from the
model of the round before, until none changes by a hundredth (`ROUNDS` at most). Seed words made the labels and are no features, so what the
model blocks it blocks for other words and shapes that go with them. It is fitted on all urls: those of equal features are one row with a count.
The tables that executors get are of bounded size: the weights of the most frequent tokens (`model_tokens`) are sent to them, those of all others joined.
Weights are whole multiples of 2^-40 and probabilities of 2^-20, so sums are exact.

Defined cases: a null url, and one without ://, has an empty host and path and is allowed; of rules of equal
length the first listed wins; repeated rows are each returned; with no bad example in the whole table, everything is allowed; an empty table gives
no rows; a path of any length is read whole, piece by piece; only key, url and html are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import stored
from .common import lean, table

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Names of the categories of public block lists, and words that are as plain.
SEEDS = frozenset({"adult", "ads", "gambling", "drugs", "tracker", "spam", "casino", "viagra", "porn", "xxx", "phish", "phishing", "malware", "warez", "pills", "scam"})
UNIT = float(1 << 40)  # of the weights of tokens
LONGEST = 24  # letters of a word that is looked up
CACHED = 256  # letters of a name that is kept with its words
PIECE = 4096  # letters of a name that are looked up at a time
FILTER_BITS = 26  # 8 MB
SHARE = 1 << 20  # probabilities are whole multiples of 1 / SHARE
ROUNDS = 30
PARTS = re.compile(r"[a-z]+|[0-9]+|[^\W\d_a-z]+")
SHAPE = re.compile(r"[^\W\d_]+|\d+")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, URL, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(u, URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits a concatenated name into the most probable words."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST, total: int | None = None):
        """total: of a vocabulary of which counts are a part, the sum of its counts and its words, and one."""
        self.counts = counts
        self.total = total or sum(counts.values()) + len(counts) + 1
        self.logp = {w: self.of(n) for w, n in counts.items()}
        self.unseen, self.longest, self.cache = math.log(1 / self.total), longest, {}
        self.more: dict[str, float] = {}

    def of(self, n: int) -> float:
        return math.log((n + 1) / self.total)

    def with_words(self, counts: dict[str, int]) -> None:
        """From now on these words are known too, in place of those of the last call."""
        if counts or self.more:
            self.more = {w: self.of(n) for w, n in counts.items()}
            self.cache.clear()

    def words(self, name: str) -> list[str]:
        """Unknown stretches cost `unseen` and as much again for each character; ties go to the longer last word."""
        if name in self.cache:
            return self.cache[name]
        best, back = [0.0], [0]
        for j in range(1, len(name) + 1):
            top, at = -math.inf, j - 1
            for i in range(max(0, j - self.longest), j):
                lp = self.logp.get(name[i:j])
                if lp is None and self.more:
                    lp = self.more.get(name[i:j])
                s = best[i] + (lp if lp is not None else self.unseen * (1 + j - i))
                if s > top:
                    top, at = s, i
            best.append(top)
            back.append(at)
        out, j = [], len(name)
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        out.reverse()
        if len(name) <= CACHED:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[name] = out
        return out


def tokens(segmenter: Segmenter, host: str, path: str) -> list[str]:
    split = lambda s: [w for part in PARTS.findall(s) for w in (segmenter.words(part) if part.isalpha() else ["0"])]
    shape = ".".join(sorted({SHAPE.sub(lambda m: "a" if m[0].isalpha() else "0", label) for label in host.split(".")}))
    # each once, so that a url that repeats itself weighs no more than another
    return list(dict.fromkeys([f"h:{w}" for w in split(host)] + [f"p:{w}" for w in split(path.lower())] + [f"s:{shape}"]))


def title_words(pages: DataFrame) -> DataFrame:
    """w and n of all words of titles and of the seeds, which count once more."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit("([a-z]+)"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, 1) for w in sorted(SEEDS)], "w string, n long")
    return stored(words.unionByName(seeds).groupBy("w").agg(F.sum("n").alias("n")))


def word_filter(words: DataFrame) -> bytes:
    """A bit for the crc32 of each word, in 8 MB."""
    bit = (F.crc32(F.col("w").cast("binary")) % F.lit(1 << FILTER_BITS)).alias("bit")
    found = words.select(bit).select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("word")).groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, "<i8")
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out.tobytes()


def stretches(urls: DataFrame, words: DataFrame, known: dict[str, int]) -> DataFrame:
    """host, path and w for each stretch of a name of a url that can be one of the words and is not known."""
    sent = urls.sparkSession.sparkContext.broadcast((word_filter(words), known))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, skip = sent.value
        cache: dict[str, list[str]] = {}

        def look(name: str) -> set[str]:
            hits = set()
            for at in range(0, len(name), PIECE):  # only what may be a word is kept of a piece
                part = name[at : at + PIECE + LONGEST - 1]
                found = {part[i:j] for i in range(min(len(part), PIECE)) for j in range(i + 1, min(len(part), i + LONGEST) + 1)} - skip.keys()
                keys = ((w, zlib.crc32(w.encode()) & (1 << FILTER_BITS) - 1) for w in found)
                hits.update(w for w, k in keys if bits[k >> 3] >> (k & 7) & 1)
            return hits

        def of(name: str) -> list[str]:
            if len(name) > CACHED:
                return list(look(name))
            if name not in cache:
                if len(cache) > 50_000:
                    cache.clear()
                cache[name] = list(look(name))
            return cache[name]

        for b in batches:
            rows, found = [], []
            for i, (h, p) in enumerate(zip(b.column("host").to_pylist(), b.column("path").to_pylist())):
                ws = {w for part in PARTS.findall(h) + PARTS.findall(p.lower()) if "a" <= part[0] <= "z" for w in of(part)}
                rows += [i] * len(ws)
                found += ws
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("host").take(at), b.column("path").take(at), pa.array(found, pa.string())], ["host", "path", "w"])

    return urls.select("host", "path").mapInArrow(lean(run), "host string, path string, w string")


def examples(pages: DataFrame, vocabulary: int) -> DataFrame:
    """host, path, rows, tokens and label of each distinct url."""
    words = title_words(pages)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*") + 1).first()[0]
    urls = stored(pages.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")))
    uses = stretches(urls, words, {}).groupBy("w").agg(F.count("*").alias("uses"))
    used = stored(uses.join(words, "w"))
    often = used.orderBy(F.col("uses").desc(), "w").limit(vocabulary).collect()
    sent = pages.sparkSession.sparkContext.broadcast({r["w"]: r["n"] for r in often})  # bounded by vocabulary
    urls = urls.withColumn("more", F.lit(None).cast("map<string,bigint>"))
    if used.count() > len(often):
        last = often[-1] if often else None
        rest = used.where((F.col("uses") < last["uses"]) | ((F.col("uses") == last["uses"]) & (F.col("w") > last["w"]))) if last else used
        more = stretches(urls, rest, sent.value).join(rest.select("w", F.col("n").alias("m")), "w")
        more = more.groupBy("host", "path").agg(F.map_from_entries(F.collect_list(F.struct("w", "m"))).alias("more"))
        urls = urls.drop("more").join(more, ["host", "path"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(sent.value, total=total)
        for b in batches:
            found = []
            for h, p, m in zip(*(b.column(c).to_pylist() for c in ("host", "path", "more"))):
                segmenter.with_words(dict(m or ()))
                found.append(tokens(segmenter, h, p))
            bad = [any(t[2:] in SEEDS for t in ts if t[0] == "h") for ts in found]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("path"), b.column("n"), pa.array(found, pa.list_(pa.string())), pa.array(bad, pa.bool_())], ["host", "path", "n", "tokens", "bad"])

    return stored(urls.select("host", "path", "n", "more").mapInArrow(lean(run), "host string, path string, n long, tokens array<string>, bad boolean"))


def weigh(rows: DataFrame, size: int) -> tuple[DataFrame, int, int]:
    """token, weight and n of rows (tokens, n, share: of SHARE, how bad, was: in the round before); the prior's weight; the largest change.

    size: the number of distinct tokens."""
    part = lambda share, n=1: F.coalesce(F.sum(F.col("n") * n * share), F.lit(0))
    bad, good = F.col("share"), SHARE - F.col("share")
    *labels, all_bad, all_good, moved = rows.agg(part(bad), part(good), part(bad, F.size("tokens")), part(good, F.size("tokens")), F.max(F.abs(F.col("share") - F.col("was")))).first()
    total_bad, total_good = (t / SHARE + size + 1 for t in (all_bad, all_good))
    seen = rows.select(F.explode("tokens").alias("token"), "n", "share").groupBy("token").agg(part(bad).alias("bad"), part(good).alias("good"))
    ratio = F.log((F.col("bad") / SHARE + 1) / F.lit(total_bad)) - F.log((F.col("good") / SHARE + 1) / F.lit(total_good))
    prior = round(UNIT * math.log((labels[0] / SHARE + 1) / (labels[1] / SHARE + 1)))
    return seen.select("token", F.round(ratio * UNIT).cast("long").alias("weight"), (F.col("bad") + F.col("good")).alias("n")), prior, moved


def scored(rows: DataFrame, key: list[str], weights: DataFrame, prior: int, size: int, model_tokens: int) -> DataFrame:
    """key and score (times UNIT) of rows (key, tokens)."""
    weights = stored(weights) if size > model_tokens else weights
    often = {r["token"]: r["weight"] for r in weights.orderBy(F.col("n").desc(), "token").limit(model_tokens).collect()}
    sent = rows.sparkSession.sparkContext.broadcast(often)  # bounded by model_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            found = b.column("tokens").to_pylist()
            part = [prior + sum(known.get(t, 0) for t in ts) for ts in found]
            rest = [[t for t in ts if t not in known] for ts in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array(part, pa.int64()), pa.array(rest, pa.list_(pa.string()))], [*key, "score", "rest"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    out = rows.select(*dict.fromkeys([*key, "tokens"])).mapInArrow(lean(run), f"{kinds}, score long, rest array<string>")
    if size <= model_tokens:
        return out.select(*key, "score")
    each = out.select(*key, "score", F.explode_outer("rest").alias("token"))
    whole, some = each.where("token IS NULL").select(*key, "score"), each.where("token IS NOT NULL")
    some = some.join(weights.select("token", "weight"), "token").groupBy(*key).agg((F.first("score") + F.sum("weight")).alias("score"))
    return whole.unionByName(some)


def features(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.substring(t, 3, 1 << 20).isin(*SEEDS))


def fitted(urls: DataFrame, model_tokens: int, rounds: int = ROUNDS) -> tuple[DataFrame, int, int] | None:
    """Weights, prior and number of tokens; None if no url is a bad example."""
    bags = stored(urls.groupBy(F.array_sort(features(F.col("tokens"))).alias("tokens"), "bad").agg(F.sum("n").alias("n")))
    if bags.where("bad").isEmpty():
        return None
    size = bags.select(F.explode("tokens")).distinct().count()
    rows = bags.withColumns({"share": F.when(F.col("bad"), F.lit(SHARE)).otherwise(0).cast("long"), "was": F.lit(-SHARE).cast("long")})
    for k in range(rounds + 1):
        weights, prior, moved = weigh(rows, size)
        if moved < SHARE // 100 or k == rounds:
            return weights, prior, size
        found = scored(rows.select("tokens", "bad", "n", F.col("share").alias("was")), ["tokens", "bad", "n", "was"], weights, prior, size, model_tokens)
        new = F.when(F.col("bad"), F.lit(SHARE)).otherwise(F.round(SHARE / (1 + F.exp(-F.col("score") / UNIT))))
        rows = stored(found.withColumn("share", new.cast("long")).drop("score"))


def blocked(urls: DataFrame, model_tokens: int) -> DataFrame | None:
    """host and path of the urls that are bad examples or that the model finds bad; None if no example is bad."""
    model = fitted(urls, model_tokens)
    if model is None:
        return None
    rows = urls.select("host", "path", "bad", features(F.col("tokens")).alias("tokens"))
    return scored(rows, ["host", "path", "bad"], *model, model_tokens).where("bad OR score > 0").select("host", "path")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, vocabulary: int = 20_000, model_tokens: int = 20_000) -> DataFrame:
    """key, host, path, rule and verdict of each row."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    gone = blocked(examples(rows, vocabulary), model_tokens)
    if gone is not None:
        # only urls that need a verdict and have a host can be among those
        open_ = (F.col("host") != "") & F.col("verdict").isNull()
        asked = found.where(open_).drop("verdict").join(gone.withColumn("verdict", F.lit("block")), ["host", "path"], "left")
        found = found.where(~open_).unionByName(asked)
    return found.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
