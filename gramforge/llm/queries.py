"""Queries of the problems for training text, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.llm.cooccurrence import cooccurrence, item_stats
from gramforge.llm.contamination import leaked_spans, removal_spans
from gramforge.llm.distinct_sketch import combinations, estimate, long_values, merge, sketch, week_start
from gramforge.llm.encoding import damaged_ids, damaged_rows, find_damage
from gramforge.llm.language import MIXED_WORDS, document_languages, label_language, segments, train_from
from gramforge.llm.packing import packed
from gramforge.llm.records import ngram_records, terms_of
from gramforge.llm.term_counts import TermCountStore, load_by_delivery
from gramforge.session import materialize, shared_dir, table


def _term_store(spark: SparkSession, sf: str) -> TermCountStore:
    return load_by_delivery(spark, shared_dir(spark, "term-counts"), table(spark, sf, "ngram_files"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return _term_store(spark, sf).counts().where("rare or common").select("term", F.explode(marks).alias("mark"))


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _term_store(spark, sf).counts()


def _baskets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Written tables of records (distinct terms, cnt) and of their item statistics."""
    r = ngram_records(table(spark, sf, "ngram_files")).select(F.array_distinct(terms_of(F.col("ngram"))).alias("terms"), F.col("cnt").alias("weight"))
    records = materialize(r, "baskets")
    return records, materialize(item_stats(records), "basket-items")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence(*_baskets(spark, sf), min_records=20, min_lift=10).select("term_a", "term_b")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence(*_baskets(spark, sf))
    return pairs.select("term_a", "term_b", "records", "weight", F.round("lift", 4).alias("lift"))


def _day_sketches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pattern_counters").where(F.col("hit_date").isNotNull())
    return sketch(long_values(rows, ["site", "hit_date"], ["n1", "n2"]), ["site", "hit_date", "measure"], "value")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    days = _day_sketches(spark, sf)
    week = week_start(F.col("hit_date")).alias("week")
    by_day = estimate(days, ["site", "hit_date", "measure"]).select("site", week, "measure", "estimate")
    summed = by_day.groupBy("site", "week", "measure").agg(F.sum("estimate").alias("days"))
    weeks = estimate(merge(days.withColumn("week", week), ["site", "week", "measure"]), ["site", "week", "measure"])
    w, s = weeks.alias("w"), summed.alias("s")
    same = F.col("w.site").eqNullSafe(F.col("s.site")) & (F.col("w.week") == F.col("s.week")) & (F.col("w.measure") == F.col("s.measure"))
    return w.join(s, same).where(F.col("w.estimate") * 2 < F.col("s.days")).select(F.date_format("w.week", "yyyy-MM-dd").alias("week_start"), F.col("w.site").alias("site"), F.col("w.measure").alias("measure"))


def p6_combinations(spark: SparkSession, sf: str) -> DataFrame:
    days = _day_sketches(spark, sf).withColumn("week_start", week_start(F.col("hit_date")))
    sets = [["hit_date", "site"], ["week_start", "site"], ["hit_date"], ["week_start"], ["site"], []]
    return combinations(days, ["hit_date", "week_start", "site"], sets, ["measure"]).withColumn("estimate", F.round("estimate").cast("long"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ngram_files")
    return damaged_ids(rows, find_damage(rows).tokens)


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "ngram_files")
    return damaged_rows(rows, find_damage(rows).tokens)


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"), table(spark, sf, "containers"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_removal_spans(spark: SparkSession, sf: str) -> DataFrame:
    return removal_spans(_leaks(spark, sf)).withColumn("items", F.concat_ws(",", "items"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return segments(documents, train_from(documents, table(spark, sf, "lang_samples")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    langs = document_languages(_segments(spark, sf))
    labels = table(spark, sf, "documents").select("doc_id", label_language(F.col("lang")).alias("label"))
    first = F.col("rank") == 1
    per_doc = langs.groupBy("doc_id").agg(
        F.max(F.when(first, F.col("lang"))).alias("main"), F.sum(F.when(~first, F.col("words")).otherwise(0)).alias("others"),
        F.collect_list(F.when(first | (F.col("words") >= MIXED_WORDS), F.col("lang"))).alias("langs"),
    )
    wrong = ~F.col("label").eqNullSafe(F.col("main")) | (F.col("others") >= MIXED_WORDS)
    return per_doc.join(labels, "doc_id").where(wrong).select("doc_id", F.explode("langs").alias("lang"))


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).withColumn("confidence", F.round("confidence", 4))


_RECORDS = """
with r as (select fnum, line_no, any_value(ngram) as ngram, any_value(cnt) as cnt from ngram_files where ngram is not null and cnt is not null group by all),
t as (select fnum, line_no, cnt, unnest(regexp_split_to_array(ngram, '[ \\t]+')) as term from r),
x as (select fnum, line_no, any_value(cnt) as cnt, term, count(*) as k from t where term <> '' group by fnum, line_no, term),
n as (select count(*) as n, sum(cnt) as w from r),
c as (select term, cast(sum(cnt * k) as bigint) as occurrences, count(*) as records, sum(cnt) as w from x group by term)
"""
_PAIRS = _RECORDS + ", p as (select a.term as term_a, b.term as term_b, count(*) as records, sum(a.cnt) as w from x a join x b on a.fnum = b.fnum and a.line_no = b.line_no and a.term < b.term group by all)"

QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p4_found": p4_found, "p4_pairs": p4_pairs, "p6_found": p6_found, "p6_combinations": p6_combinations, "p5_found": p5_found, "p5_restored": p5_restored, "p7_packed": p7_packed, "p8_found": p8_found, "p8_removal_spans": p8_removal_spans, "p9_found": p9_found, "p9_segments": p9_segments}

ORACLE = {
    "p1_found": _RECORDS + "select term, 'rare' as mark from c where occurrences < 200 union all select term, 'common' as mark from c, n where c.records * 20 > n.n",
    "p1_terms": _RECORDS + "select term, occurrences, records, occurrences < 200 as rare, records * 20 > n.n as common from c, n",
    "p4_found": _PAIRS + "select term_a, term_b from p join c a on a.term = term_a join c b on b.term = term_b, n where p.records >= 20 and n.w * p.w >= 10 * a.w * b.w",
    "p4_pairs": _PAIRS
    + "select term_a, term_b, p.records, cast(p.w as bigint) as weight, round(n.w::double * p.w / (a.w::double * b.w), 4) as lift from p join c a on a.term = term_a join c b on b.term = term_b, n",
    "p6_found": """with l as (select site, hit_date, 'n1' as measure, n1 as v from pattern_counters union all select site, hit_date, 'n2', n2 from pattern_counters),
d as (select site, hit_date, date_trunc('week', hit_date)::date as week, measure, count(distinct v) as k from l where v is not null and hit_date is not null group by all),
s as (select site, week, measure, sum(k) as k from d group by all),
w as (select site, date_trunc('week', hit_date)::date as week, measure, count(distinct v) as k from l where v is not null and hit_date is not null group by all)
select strftime(w.week, '%Y-%m-%d') as week_start, w.site, w.measure from w join s on w.site is not distinct from s.site and w.week = s.week and w.measure = s.measure where w.k * 2 < s.k""",
}
