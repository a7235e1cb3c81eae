"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

A text is measured once (words, lines, symbols, stop words, repeated windows) and each rule
bounds one of the measures as a share of another, in whole numbers so that no rounding decides.
There are no user functions and no shuffle.

Repeated windows are told by 64-bit hashes of their five words. Texts without any repeat, most
of them, are done after comparing the numbers of windows and of distinct windows; only the rest
are sorted. ``words`` and later columns are steps of one pass over the rows.

Edge cases: a null text has no words, counts 0 everywhere and fails; so do empty and blank
texts; repeated rows are judged each on their own; an empty table gives an empty table. A null id
is passed on. Columns of the input other than id and text are not touched or looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
# White space that parts words, symbols that count, and common words of four languages.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to a in for is it that with was on by as this be are at from or an not have "
    "der die und in den von das zu sich mit des auf für nicht im ist dem ein eine als auch es an werden aus er "
    "de la le et les des en un du que une est pour qui dans par au sur pas avec ne se plus ce il "
    "que el los y se las del con por no una su para es al lo como más pero sus").split()


@dataclass(frozen=True)
class Rule:
    """``least <= 1000 * part / whole <= most``; a rule with no ``whole`` bounds the count itself."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        value, unit = (F.col(self.part), F.lit(1)) if self.whole is None else (1000 * F.col(self.part), F.col(self.whole))
        held = F.lit(True)
        if self.least is not None:
            held = held & (value >= self.least * unit)
        if self.most is not None:
            held = held & (value <= self.most * unit)
        return held


RULES = [
    Rule("words", "n_words", least=10, most=10_000_000),
    Rule("word length", "word_chars", "n_words", least=2_000, most=15_000),
    Rule("symbols per word", "n_symbols", "n_words", most=150),
    Rule("stop words per word after the first 20", "n_stop", "n_later", least=60),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", most=600),
]


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_later, n_lines``.

    ``n_later`` are the words after the first twenty: too few words say nothing of stop words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    trimmed = F.trim(F.col("t"), F.lit(SPACE))
    rows = rows.select(
        "doc_id", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+")).alias("words"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("lines"))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    rows = rows.select(
        "doc_id", "n_symbols", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).alias("hashes"))
    rows = rows.withColumn("sorted", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k: F.coalesce(F.get("sorted", k)["h"], F.lit(None))
    rows = rows.withColumn("again", F.array_sort(F.transform(F.filter(
        "sorted", lambda x, k: F.coalesce(x["h"] == same(k - 1), F.lit(False)) | F.coalesce(x["h"] == same(k + 1), F.lit(False))),
        lambda x: x["i"])))
    covered = F.transform("again", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("again", k + 1) - p, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       total.alias("n_repeat_words"), "n_stop",
                       F.greatest(F.col("n_words") - 20, F.lit(0)).alias("n_later"), "n_lines")


def judge(measured: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: the base conditions, then all rules."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    held = F.lit(True)
    for rule in rules:
        held = held & rule.holds()
    return measured.select(*measured.columns, base.alias("base_failed"), (~base & held).alias("kept"))


def failed_rules(measured: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``measured`` with ``failed``: the names of the rules that a document breaks."""
    names = F.array(*[F.when(~rule.holds(), F.lit(rule.name)) for rule in rules])
    return measured.withColumn("failed", F.array_compact(names))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

ORACLE = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS k FROM (
      SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5))),
again AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows WHERE c > 1) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))}], lower(x)))) AS n_stop,
         len(l) AS n_lines
  FROM split LEFT JOIN again USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 10 AND 10000000
       AND 1000 * word_chars BETWEEN 2000 * n_words AND 15000 * n_words AND 1000 * n_symbols <= 150 * n_words
       AND 1000 * n_stop >= 60 * greatest(n_words - 20, 0) AND 1000 * n_dup_lines <= 600 * n_lines AS kept
FROM based
"""
