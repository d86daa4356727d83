"""Queries of the general problems (2 and 3), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.operators.rejects import load_ngram_lines, rejects
from gramforge.operators.skew import heavy_keys, skewed_counters
from gramforge.session import materialize, table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    # one row per key, written: it is read for the whole and for the shares
    counters = materialize(skewed_counters(table(spark, sf, "pattern_counters")), "counters")
    return heavy_keys(counters).select(F.col("key").alias("pc_key"))


def p2_counters(spark: SparkSession, sf: str) -> DataFrame:
    c = skewed_counters(table(spark, sf, "pattern_counters"))
    return c.select(F.col("key").alias("pc_key"), F.col("rows_all").alias("rows"), "records", F.col("total").alias("n0"), F.col("distinct_1").alias("n1"), F.col("distinct_2").alias("n2"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    loaded = load_ngram_lines(table(spark, sf, "ngram_raw"), table(spark, sf, "file_index"))
    return rejects(loaded).where("reason <> 'unknown_file'").select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    loaded = load_ngram_lines(table(spark, sf, "ngram_raw"), table(spark, sf, "file_index"))
    return loaded.select("line_id", "fnum", "ngram", "cnt", "reason")


_NORMAL = "trim(regexp_replace(pc_key, '[ \\t]+', ' ', 'g'))"
_LINES = r"""
with f as (select l.line_id, l.fnum, coalesce(l.line_text, '') as s, i.n, i.layout from ngram_raw l left join file_index i on l.fnum = i.fnum),
q as (select *, layout <> 'quoted' or regexp_full_match(s, '"([^"]|"")*"(\t"([^"]|"")*")*', 's') as sound from f),
x as (select *, case when layout = 'quoted' and sound then regexp_extract_all(s, '"((?:[^"]|"")*)"', 1, 's') when layout = 'quoted' then [] else string_split(s, chr(9)) end as p from q),
y as (select *, case when layout = 'quoted' then replace(p[1], '""', '"') else p[1] end as g, case when layout = 'quoted' then replace(p[2], '""', '"') else p[2] end as c from x),
z as (select *, case when n is null or layout is null then 'unknown_file' when not sound then 'quoting' when len(p) <> 2 then 'columns'
  when len(string_split(g, ' ')) <> n or list_contains(string_split(g, ' '), '') or regexp_matches(g, '[_\x00-\x1f\x7f]') then 'ngram'
  when not regexp_full_match(c, '[1-9][0-9]{0,18}') or try_cast(c as hugeint) not between 40 and 9223372036854775807 then 'count' end as reason from y)
"""

QUERIES = {"p2_found": p2_found, "p2_counters": p2_counters, "p3_found": p3_found, "p3_loaded": p3_loaded}

ORACLE = {
    "p2_found": f"select {_NORMAL} as pc_key from pattern_counters where pc_key is not null group by 1 having count(*) * 50 >= (select count(*) from pattern_counters)",
    "p2_counters": f"""with r as (select {_NORMAL} as pc_key, site, seq_no, n0, n1, n2 from pattern_counters),
d as (select pc_key, site, seq_no, any_value(n0) as n0 from r group by all),
a as (select pc_key, count(*) as records, sum(n0) as n0 from d group by pc_key),
b as (select pc_key, count(*) as rows, count(distinct n1) as n1, count(distinct n2) as n2 from r group by pc_key)
select b.pc_key, b.rows, a.records, cast(a.n0 as bigint) as n0, b.n1, b.n2 from b join a on a.pc_key is not distinct from b.pc_key""",
    "p3_found": _LINES + "select line_id, reason from z where reason <> 'unknown_file'",
    "p3_loaded": _LINES + "select line_id, fnum, case when reason is null then g end as ngram, case when reason is null then cast(c as bigint) end as cnt, reason from z",
}
