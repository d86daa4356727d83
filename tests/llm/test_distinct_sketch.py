import datetime
import random

import pytest
from pyspark.sql import functions as F

from gramforge.llm.distinct_sketch import combinations, estimate, long_values, merge, sketch, standard_error, week_start


def value(df):
    row = estimate(df, []).first()
    return row["estimate"] if row else None


@pytest.mark.parametrize("n", [1, 100, 5_000, 50_000, 1_000_000])
def test_error_is_within_the_bound(spark, n):
    errors = []
    for seed in range(4):
        df = spark.range(n).select((F.col("id") * 7919 + seed * 10**12).alias("v"))
        errors.append(value(sketch(df, [], "v")) / n - 1)
    assert max(map(abs, errors)) < 3.5 * standard_error(), errors
    assert standard_error() < 0.02


def test_merging_is_the_sketch_of_the_union(spark):
    a, b = spark.range(0, 40_000), spark.range(20_000, 90_000)
    whole = sketch(a.union(b), [], "id")
    parts = merge(sketch(a, [], "id").union(sketch(b, [], "id")), [])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}
    assert {tuple(r) for r in merge(parts.union(parts), []).collect()} == {tuple(r) for r in parts.collect()}


def test_size_is_bounded(spark):
    assert sketch(spark.range(300_000), [], "id").count() <= 28 * 8192 // 64
    assert sketch(spark.range(10), [], "id").count() <= 10


def test_groups_nulls_and_repeats(spark):
    rows = [("a", 1), ("a", 1), ("a", None), ("b", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("level", F.lit(1)).withColumn("word", F.lit("clash"))
    got = {r["g"]: round(r["estimate"]) for r in estimate(sketch(df, ["g"], "v"), ["g"]).collect()}
    assert got == {"a": 1, None: 2}
    assert estimate(sketch(df.limit(0), ["g"], "v"), ["g"]).count() == 0


def test_text_values(spark):
    df = spark.createDataFrame([("x" * 100_000,), ("",), ("",)], "v string")
    assert round(value(sketch(df, [], "v"))) == 2


def test_combinations(spark):
    r = random.Random(1)
    day = datetime.date(2015, 1, 5)
    rows = [(r.choice("ns"), day + datetime.timedelta(days=r.randrange(14)), r.randrange(300), r.randrange(20)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "site string, hit_date date, n1 long, n2 long")
    days = sketch(long_values(df, ["site", "hit_date"], ["n1", "n2"]), ["site", "hit_date", "measure"], "value").withColumn("week", week_start(F.col("hit_date")))
    got = {(x["measure"], x["combination"], x["site"], x["week"]): x["estimate"] for x in combinations(days, ["site", "week"], [["site", "week"], ["site"], []], ["measure"]).collect()}
    exact = {}
    for s, d, a, b in rows:
        w = d - datetime.timedelta(days=d.weekday())
        for m, v in (("n1", a), ("n2", b)):
            for key in ((m, "site+week", s, w), (m, "site", s, None), (m, "all", None, None)):
                exact.setdefault(key, set()).add(v)
    assert set(got) == set(exact)
    for k, v in exact.items():
        assert got[k] == pytest.approx(len(v), rel=0.05, abs=0.6)
