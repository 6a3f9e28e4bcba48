"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, SPACES, all_of, text_of, words_of

#: Symbols that prose rarely holds (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Common words of the four languages that documents come in (fixed values).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "was", "it", "by", "are", "this", "be", "from", "or", "an",
    "der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "ein", "eine", "im", "auf", "für", "nicht", "sich",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "est", "pour", "dans", "sur", "du", "au",
    "el", "los", "las", "y", "del", "se", "con", "por", "para", "una", "su", "al", "lo", "como",
]


@dataclass(frozen=True)
class Rule:
    """A ratio of two measured columns that has to lie in [low, high]; None leaves that side open."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        ratio = F.col(self.top).cast("double") / F.greatest(F.col(self.bottom), F.lit(1)).cast("double")
        return all_of(([ratio >= self.low] if self.low is not None else []) + ([ratio <= self.high] if self.high is not None else []))


#: The production thresholds. They are loose on purpose: what they reject is junk, not merely plain prose.
RULES = [
    Rule("length", "n_words", "one", 20, 1_000_000),
    Rule("mean_word", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """Counts of each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines.

    A null text is empty and gives zeros; repeated rows and null ids are measured row by row; other columns are not read.
    n_repeat_words counts the words under windows of `window` words that occur twice or more in the text: the window
    hashes are built by doubling, sorted with their places, and the lengths of the union of the repeated ones added up.
    """
    if window & (window - 1):
        raise ValueError("window has to be a power of two")
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    d = d.withColumns({"w": words_of(F.col("t")), "ln": F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)})
    d = d.withColumns(
        {
            "one": F.lit(1),
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.translate("t", SPACES, "")).cast("long"),
            "n_symbols": (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("ln").cast("long"),
            "n_dup_lines": (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long"),
            "n_stop_words": F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            "h": F.transform("w", lambda x: F.xxhash64(x)),
        }
    ).drop("t", "ln", "w")
    step = 1
    while step < window:
        d = d.withColumn("h2", F.zip_with("h", F.slice("h", step + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b))).drop("h").withColumnRenamed("h2", "h")
        step *= 2
    d = d.withColumn("h3", F.slice("h", 1, F.greatest(F.size("h") - (window - 1), F.lit(0)))).drop("h")
    d = d.withColumn("p", F.when(F.size(F.array_distinct("h3")) < F.size("h3"), F.sort_array(F.transform("h3", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h3")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    d = d.withColumn("s", F.transform("p", lambda x, k: F.when(same(x, F.get("p", k - 1)) | same(x, F.get("p", k + 1)), x["i"]))).drop("p")
    d = d.withColumn("s2", F.sort_array(F.filter("s", lambda x: x.isNotNull()))).drop("s")
    covered = F.aggregate(F.transform("s2", lambda x, k: F.least(F.lit(window), F.coalesce(F.get("s2", k + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s2")


def judged(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of each document with base_failed, the names of the broken rules and kept.

    Defined results: an empty or null text has no words, so it fails the base; an empty table gives an empty result.
    """
    m = measures(docs, id_col, text_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.array_compact(F.array(*(F.when(~r.holds(), F.lit(r.name)) for r in rules)))
    m = m.withColumns({"base_failed": base, "broken_rules": broken})
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop("one")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same from the definitions: windows are compared as word lists, thresholds are those of RULES.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
s AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + 7), ' ')) AS n FROM s),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM v WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: list_contains([{', '.join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS n_stop
      FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words <= 1000000
         AND word_chars / n_words::DOUBLE BETWEEN 2 AND 20 AND n_symbols / n_words::DOUBLE <= 0.5
         AND n_stop / n_words::DOUBLE >= 0.02 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5 AS kept
FROM m
"""
