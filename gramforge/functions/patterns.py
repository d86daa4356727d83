"""Wildcard patterns: parsing, masks, rendering.

A wildcard is a null word plus a bit in the mask (leftmost word = highest bit, as in ``grouping_id``); ``_`` exists only in text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ORDER = 5
WILDCARD = "_"


def parse_tokens(pattern: Column) -> Column:
    return F.filter(F.split(pattern, r"\s+"), lambda t: t != "")


def parse_patterns(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Distinct patterns: pattern (single spaces), n, mask, p1..p5.

    Null and blank patterns are dropped; more than five tokens raise an error; repeated patterns count once.
    """
    t = F.col("t")
    tokens = patterns.select(parse_tokens(F.col(column)).alias("t")).where(F.size("t") > 0)
    error = F.raise_error(F.concat(F.lit("pattern of more than 5 tokens: "), F.array_join(t, " "))).cast("int")
    checked = F.when(F.size(t) > MAX_ORDER, error).otherwise(F.size(t))
    mask = F.aggregate(t, F.lit(0), lambda acc, x: acc * 2 + F.when(x == WILDCARD, 1).otherwise(0))
    words = [F.when(F.get(t, F.lit(i)) != WILDCARD, F.get(t, F.lit(i))).alias(f"p{i + 1}") for i in range(MAX_ORDER)]
    return tokens.select(F.array_join(t, " ").alias("pattern"), checked.alias("n"), mask.alias("mask"), *words).distinct()


def render(words: list[Column], n: Column, mask: Column) -> Column:
    """The text of a pattern from its words."""
    parts = [F.when(F.lit(i) < n, F.coalesce(w, F.lit(WILDCARD))) for i, w in enumerate(words)]
    return F.concat_ws(" ", *parts)


def wildcards(mask: Column) -> Column:
    return F.bit_count(mask)


def has_n2(mask: Column) -> Column:
    """Whether distinct last words are counted: at least two wildcards, the last word one of them."""
    return (F.bit_count(mask) > 1) & (mask.bitwiseAND(1) == 1)
