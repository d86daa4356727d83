"""Readers and writers of n-gram data: text files, count files, vocabularies, tables of loaded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.patterns import parse_tokens

WORDS = ["w1", "w2", "w3", "w4", "w5"]


def read_ngram_files(spark: SparkSession, path: str, glob: str = "?gm-????.gz") -> DataFrame:
    """n, w1..w5, cnt of n-gram text files (``tokens<TAB>count``; plain, gz or bz2), searched for below ``path``.

    The line is cut at its first tab; quotes are ordinary tokens. Lines without a count, blank ones and those of more
    than five tokens are left out.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return parse_lines(lines, "value")


def parse_lines(lines: DataFrame, column: str) -> DataFrame:
    at = F.instr(F.col(column), "\t")
    parsed = lines.where(at > 0).select(
        parse_tokens(F.substring_index(column, "\t", 1)).alias("t"), F.regexp_extract(F.substring_index(F.col(column), "\t", -1), r"^\s*(\d+)", 1).try_cast("long").alias("cnt")
    )
    sound = parsed.where(F.col("cnt").isNotNull() & F.size("t").between(1, 5))
    return sound.select(F.size("t").alias("n"), *(F.get("t", F.lit(i)).alias(w) for i, w in enumerate(WORDS)), "cnt")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """w1, cnt of a vocabulary file."""
    return spark.read.csv(path, sep="\t", quote="", schema="w1 string, cnt long").where("w1 is not null and cnt is not null")


def read_total(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="total long").where("total is not null")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("pattern"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """pattern, n0, n1, n2 of a count file; a line without pattern or n0 is an error."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="pattern string, n0 long, n1 long, n2 long")
    for c in ("pattern", "n0"):
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"count file: a line without {c}")).cast(rows.schema[c].dataType)))
    return rows


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sound lines (query, cnt) of a lookup cache, and malformed lines (line)."""
    lines = spark.read.text(path)
    form = r"^(.+?)\t(\d+)$"
    good = lines.where(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).alias("query"), F.regexp_extract("value", form, 2).cast("long").alias("cnt"))
    return good, lines.where(~F.col("value").rlike(form)).select(F.col("value").alias("line"))


def read_lexicon(spark: SparkSession, lemmas: str, forms: str, spellings: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lexicon tables from backslash-separated files: (lemma_id, pos), (wf_id, lemma_id, infl), (wf_id, str)."""
    field = lambda i: F.get(F.split("value", r"\\"), F.lit(i))
    lemma = spark.read.text(lemmas).select(field(0).cast("int").alias("lemma_id"), field(3).cast("int").alias("pos"))
    form = spark.read.text(forms).select(field(0).cast("int").alias("wf_id"), field(3).cast("int").alias("lemma_id"), field(4).alias("infl"))
    parts = F.split("value", r"\\")
    each = F.transform(F.sequence(F.lit(8), F.greatest(F.size(parts) - 1, F.lit(8)), F.lit(5)), lambda i: F.get(parts, i))
    plain = F.regexp_replace(F.lower(F.col("s")), r"[^\p{L}\p{N}' .-]", "")
    spelling = spark.read.text(spellings).select(field(0).cast("int").alias("wf_id"), F.explode(each).alias("s")).select("wf_id", plain.alias("str")).where("str <> ''").distinct()
    return lemma, form, spelling


def records(ngram_files: DataFrame, changed: bool = False) -> DataFrame:
    """fnum, line_no, n, w1..w5, cnt of loaded rows without repeated deliveries; nulls in ngram or cnt are left out.

    A repeated delivery has the same key and content, so distinct rows do, and filters on words reach the scan. With
    ``changed``, a key may come with other content, and its latest row counts.
    """
    sound = ngram_files.where(F.col("ngram").isNotNull() & F.col("cnt").isNotNull())
    if not changed:
        return sound.select("fnum", "line_no", "n", *WORDS, "cnt").distinct()
    latest = F.max_by(F.struct("n", *WORDS, "cnt"), F.struct("loaded_at", "row_id"))
    return sound.groupBy("fnum", "line_no").agg(latest.alias("r")).select("fnum", "line_no", "r.*")


def ngram_table(ngram_files: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Distinct n-grams: n, w1..w5, cnt. Partial counts are added up; ``vocab`` adds order 1 (null counts are left out)."""
    rows = records(ngram_files).select("n", *WORDS, "cnt")
    if vocab is not None:
        empty = [F.lit(None).cast("string").alias(w) for w in WORDS[1:]]
        rows = rows.unionByName(vocab.where("w1 is not null and cnt is not null").select(F.lit(1).alias("n"), "w1", *empty, "cnt"))
    return rows.groupBy("n", *WORDS).agg(F.sum("cnt").alias("cnt"))


def write_counts(counts: DataFrame, path: str) -> None:
    """A count file: pattern, n0 and, where known, n1 and n2, separated by tabs."""
    text = F.concat_ws("\t", "pattern", F.col("n0").cast("string"), F.col("n1").cast("string"), F.col("n2").cast("string"))
    counts.select(text.alias("value")).write.text(path)


def write_sorted(ngrams: DataFrame, path: str, by: str = "w1", partitions: int | None = None) -> None:
    """N-grams by order, sorted by a word, so that row-group statistics find a prefix; ``by`` w2 is the second copy."""
    order = ["n", by, *(w for w in WORDS if w != by)]
    spread = ngrams.repartitionByRange(partitions, *order) if partitions else ngrams.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.partitionBy("n").parquet(path)
