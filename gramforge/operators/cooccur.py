"""Totals, fan-outs and windowed co-occurrence from n-gram tables (n, w1..w5, cnt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.sources.ngram_data import WORDS


def prefix_totals(ngrams: DataFrame) -> DataFrame:
    """n, prefix (first n - 1 words), n0 and n1 of "prefix _", for orders from 2."""
    words = F.slice(F.array(*WORDS), F.lit(1), F.col("n") - 1)
    return ngrams.where("n > 1").groupBy("n", F.array_join(words, " ").alias("prefix")).agg(F.sum("cnt").alias("n0"), F.count("*").alias("n1"))


def left_fanout(ngrams: DataFrame) -> DataFrame:
    """n, suffix (last n - 1 words), n0 and n1 of "_ suffix", for orders from 2."""
    words = F.slice(F.array(*WORDS), F.lit(2), F.col("n") - 1)
    return ngrams.where("n > 1").groupBy("n", F.array_join(words, " ").alias("suffix")).agg(F.sum("cnt").alias("n0"), F.count("*").alias("n1"))


def mid_fanout(ngrams: DataFrame) -> DataFrame:
    """n, middle (words 2 to n - 1), n0 and n1 of "_ middle _", for orders from 3."""
    words = F.slice(F.array(*WORDS), F.lit(2), F.col("n") - 2)
    return ngrams.where("n > 2").groupBy("n", F.array_join(words, " ").alias("middle")).agg(F.sum("cnt").alias("n0"), F.count("*").alias("n1"))


def pair_counts(ngrams: DataFrame, least: int = 3) -> DataFrame:
    """n, a, b, n0: occurrences of n-grams that begin with a and end with b."""
    last = F.get(F.array(*WORDS), F.col("n") - 1)
    return ngrams.where(F.col("n") >= least).groupBy("n", F.col("w1").alias("a"), last.alias("b")).agg(F.sum("cnt").alias("n0"))


def window_cooccurrence(ngrams: DataFrame) -> DataFrame:
    """a <= b, n0: how often two words stand within five words of each other, in either order (a pair of equal words counts twice)."""
    pairs = pair_counts(ngrams, 2)
    both = F.when(F.col("a") == F.col("b"), F.col("n0") * 2).otherwise(F.col("n0"))
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(both).alias("n0"))
