"""Streaming forms: answering patterns as they arrive, and counts of n-grams as they are loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.patterns import has_n2, parse_patterns, wildcards
from gramforge.operators.lookup import pattern_counts
from gramforge.sources.ngram_data import WORDS


def answer_patterns(patterns: DataFrame, ngrams: DataFrame, out, checkpoint: str):
    """Answers a stream of patterns (column ``pattern``) against a table of n-grams: each micro-batch is one bulk lookup.

    ``out(df, batch_id)`` receives pattern, n0, n1, n2, zeroes included. Returns the started query.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        out(pattern_counts(ngrams, parse_patterns(df), zeroes=True), batch_id)

    return patterns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_from_counts(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """A stateless stream-static join: patterns in the stream with counts computed before (pattern, n0, n1, n2); 0 where none."""
    tokens = F.filter(F.split("pattern", r"\s+"), lambda t: t != "")
    mask = F.aggregate(tokens, F.lit(0), lambda acc, x: acc * 2 + F.when(x == "_", 1).otherwise(0))
    asked = patterns.where("pattern is not null").select(F.array_join(tokens, " ").alias("pattern"), mask.alias("mask")).where("pattern <> ''")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return asked.join(counts, "pattern", "left").select(
        "pattern", zero("n0").alias("n0"), F.when(wildcards(F.col("mask")) > 0, zero("n1")).alias("n1"), F.when(has_n2(F.col("mask")), zero("n2")).alias("n2")
    )


def daily_counts(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Occurrences by order and day of loading from a stream of loaded rows; repeated deliveries of (fnum, line_no) count once.

    State is dropped once the watermark has passed: rows later than ``late`` are ignored.
    """
    seen = rows.where("ngram is not null and cnt is not null").withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["fnum", "line_no"])
    day = F.window("loaded_at", "1 day")
    return seen.groupBy(day.alias("day"), "n").agg(F.sum("cnt").alias("n0"), F.count("*").alias("rows")).select(F.col("day.start").alias("day"), "n", "n0", "rows")


def ngram_stream(spark, path: str, schema: str = f"n int, {', '.join(f'{w} string' for w in WORDS)}, cnt long") -> DataFrame:
    """Parquet files of n-grams as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)
