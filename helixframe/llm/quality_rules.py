"""Quality rules: clean line by line, then reject documents that lose too much.

Every step is a Spark SQL expression over one row, so the plan is a scan and a projection: no shuffle,
no Python, and a document is never gathered with another one.

`measure` ends in a generator of one row, through which Spark pushes no filter: a filter on its results would otherwise compute the
arrays that they are made of again for every word.

Defined cases: a null text counts as an empty one (no words, base_failed), its clean text is null; a text of blank lines likewise;
repeated rows are judged alike and each returned; an empty table gives no rows; a text of any length is judged whole; a column of the input
named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, words_of

SYMBOLS = "[#*$%&|<>]"
END_MARKS = "[.?!:;\"'»”…。！？؟।]"
BOILERPLATE = (
    "licensed under|all rights reserved|copyright|spdx-license|terms of (use|service)|privacy policy|"
    "cookie|subscribe|sign in|log in|click here|read more|javascript|lorem ipsum"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document's verdict."""

    max_symbol_share: float = 0.05  # of a line's characters
    max_bang_share: float = 0.03  # of a line's characters, counting pairs of "!!"
    min_separators: int = 3  # of "|", for a navigation line
    min_unpunctuated: int = 80  # characters from which a line must hold . ? ! : ; or a closing quote somewhere
    min_capital_line: int = 20  # characters from which a line all in capitals fails
    max_boilerplate_line: int = 200  # a longer line is prose that mentions the phrase
    boilerplate: str = BOILERPLATE
    max_lost_share: float = 0.5  # of the characters of the lines


def _line_fails(line: Column, r: LineRules) -> Column:
    n = F.length(line)
    return (
        ((n >= r.min_unpunctuated) & ~line.rlike(END_MARKS))
        | (n - F.length(F.replace(line, F.lit("!!"), F.lit("!"))) > n * F.lit(r.max_bang_share))
        | (n - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= r.min_separators)
        | (n - F.length(F.regexp_replace(line, SYMBOLS, "")) > n * F.lit(r.max_symbol_share))
        | ((n >= r.min_capital_line) & (F.upper(line) == line) & (F.lower(line) != line))
        | ((n <= r.max_boilerplate_line) & F.lower(line).rlike(r.boilerplate))
    )


def measure(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with counts, verdicts and clean_text (the lines that pass), one row in, one row out."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", words_of(t)).withColumn("_lines", F.split(t, "\n"))
    d = d.withColumn("_fails", F.transform("_lines", lambda x: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), _line_fails(x, rules))))  # null: blank
    d = d.withColumn("_full", F.filter("_lines", lambda x, i: F.get("_fails", i).isNotNull()))
    d = d.withColumn("_bad", F.filter("_lines", lambda x, i: F.coalesce(F.get("_fails", i), F.lit(False))))
    d = d.withColumn("_good", F.filter("_lines", lambda x, i: ~F.coalesce(F.get("_fails", i), F.lit(False))))
    d = d.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + k) for k in range(8)])
    n = F.size("_hash")
    d = d.withColumn("_win", F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), window)).otherwise(F.array().cast("array<bigint>")))
    # Only texts in which some window comes back pay for sorting their windows.
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    near = lambda e, i: (F.get(F.col("_sorted"), i + 1)["h"].eqNullSafe(e["h"])) | ((i > 0) & (F.get(F.col("_sorted"), F.greatest(i - 1, F.lit(0)))["h"] == e["h"]))
    d = d.withColumn("_twice", F.array_sort(F.transform(F.filter("_sorted", near), lambda e: e["p"])))
    gaps = F.transform("_twice", lambda p, i: F.least(F.lit(8), F.coalesce(F.get(F.col("_twice"), i + 1) - p, F.lit(8))))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint"),
            "n_repeat_words": F.coalesce(total(gaps), F.lit(0)).cast("bigint"),
            "line_chars": total(F.transform("_full", F.length)),
            "lost_chars": total(F.transform("_bad", F.length)),
            "clean_text": F.when(F.col(text).isNotNull(), F.array_join("_good", "\n")),
        }
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("line_chars") * F.lit(rules.max_lost_share)))
    d = d.drop("_words", "_lines", "_fails", "_full", "_bad", "_good", "_hash", "_win", "_sorted", "_twice")
    return d.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in d.columns]))))


def filter_documents(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of docs that are kept, their texts without the lines that fail; n_chars, if there, is the new length."""
    new = {text: F.col("clean_text")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("clean_text").cast(docs.schema[n_chars].dataType)
    rows = docs.select(F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = measure(rows, rules).where("kept")
    return found.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", F.coalesce(F.length("clean_text"), F.lit(0)).cast("bigint").alias("clean_chars")
    )


_R = LineRules()
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{SPACE_CLASS}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM t),
v AS (SELECT *, [array_to_string(ws[i:i+7], ' ') FOR i IN range(1, len(ws) - 6)] AS win FROM w),
e AS (SELECT row_number() OVER () AS k, * FROM v),
g AS (SELECT k, unnest(win) AS x, unnest(range(0, len(win))) AS p FROM e),
r AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, x) AS c FROM g) WHERE c > 1),
n AS (SELECT k, sum(least(8, coalesce(q - p, 8)))::BIGINT AS rep FROM (SELECT k, p, lead(p) OVER (PARTITION BY k ORDER BY p) AS q FROM r) GROUP BY k),
l AS (SELECT k, unnest(full_lines) AS x FROM e),
m AS (SELECT k, x, length(x) AS n, n - length(regexp_replace(x, '{SYMBOLS}', '', 'g')) AS sy,
  n - length(replace(x, '!!', '!')) AS bangs, n - length(replace(x, '|', '')) AS bars FROM l),
f AS (SELECT k, sum(n)::BIGINT AS line_chars, coalesce(sum(n) FILTER (WHERE bad), 0)::BIGINT AS lost, count(*) FILTER (WHERE bad) AS lost_lines FROM (SELECT *, (sy > n * {_R.max_symbol_share}::DOUBLE OR bangs > n * {_R.max_bang_share}::DOUBLE
  OR bars >= {_R.min_separators} OR (n >= {_R.min_capital_line} AND upper(x) = x AND lower(x) <> x)
  OR (n >= {_R.min_unpunctuated} AND NOT regexp_matches(x, '{END_MARKS.replace("'", "''")}'))
  OR (n <= {_R.max_boilerplate_line} AND regexp_matches(lower(x), '{BOILERPLATE}'))) AS bad FROM m) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= line_chars * {_R.max_lost_share}::DOUBLE AS kept, lost_chars, greatest(0, length(text) - lost_chars - lost_lines)::BIGINT AS clean_chars
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0) AS line_chars, coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(lost_lines, 0) AS lost_lines, text
  FROM e LEFT JOIN n USING (k) LEFT JOIN f USING (k)))
"""
