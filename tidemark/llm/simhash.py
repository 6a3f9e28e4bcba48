"""SimHash fingerprints of 64 bits, computed with built-in functions only.

A term's hash votes for a one or against it on every bit. Two of the 64 counters share one long (32 bits each, more
than the votes a string can hold), so a document's votes are 32 sums that Spark adds up before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, words_of

#: Bit i and bit i + 32 of a hash shifted right by i.
LANES = 0x0000000100000001
HALF = 0xFFFFFFFF


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of each run of `size` words of the text lower-cased in A-Z; fewer words: of the whole sequence; none: an empty array.

    Expects a column (not an expression) with the words, as it is referred to several times.
    """
    n = F.size(text)
    parts = lambda x, i: F.xxhash64(F.concat_ws(" ", x, *(F.get(text, i + k) for k in range(1, size))))
    return F.when(n >= size, F.transform(F.slice(text, 1, F.greatest(n - (size - 1), F.lit(0))), parts)).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", text)))).otherwise(F.array().cast("array<bigint>"))


def lower_words(text: Column) -> Column:
    return words_of(F.translate(text, UPPER, LOWER))


def weighted_terms(words: Column) -> Column:
    """(hash, weight) of each word with its successor: a vote weighs the letters of the two words, 31 at most.

    Long words say more about a document than short ones, which are mostly function words; repeats vote again.
    """
    return F.transform(words, lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1)).alias("h"), F.least(F.lit(31), F.length(x) + F.coalesce(F.length(F.get(words, i + 1)), F.lit(0))).alias("v")))


def fingerprints(terms: DataFrame, keys: list[str], h: str = "h", weight: Column | None = None, more: list[Column] | None = None) -> DataFrame:
    """(keys, fp, and the aggregates `more`): a bit of fp is one if it is set in more than half of the weight of the group's terms; no terms (h null): zero."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    ones = [F.sum(w * F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit(LANES))).alias(f"s{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg(F.sum(F.when(F.col(h).isNotNull(), w)).alias("all_votes"), *ones, *(more or []))

    def bit(count: Column, at: int) -> Column:
        return F.when(2 * count > F.col("all_votes"), F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    bits = [b for i in range(32) for b in (bit(F.col(f"s{i}").bitwiseAND(F.lit(HALF)), i), bit(F.shiftrightunsigned(F.col(f"s{i}"), 32), i + 32))]
    rest = [c for c in votes.columns[len(keys) + 1 + len(ones) :]]
    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"), *rest)
