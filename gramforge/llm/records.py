"""N-gram records and their terms, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms_of(text: Column) -> Column:
    """Runs of characters other than space and tab, in order."""
    return F.filter(F.split(text, "[ \t]+"), lambda t: t != "")


def ngram_records(df: DataFrame) -> DataFrame:
    """One row per (fnum, line_no) whose ngram and cnt are not null: the latest delivery."""
    kept = df.where(F.col("ngram").isNotNull() & F.col("cnt").isNotNull() & F.col("fnum").isNotNull() & F.col("line_no").isNotNull())
    return kept.groupBy("fnum", "line_no").agg(F.max_by(F.struct("ngram", F.col("cnt").cast("long").alias("cnt")), F.struct("loaded_at", "ngram", "cnt")).alias("r")).select("fnum", "line_no", "r.*")
