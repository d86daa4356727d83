import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gramforge.operators.skew import heavy_keys, skewed_counters

SCHEMA = "pc_key string, site string, seq_no long, n0 long, n1 long, n2 long"


def brute(rows):
    keys = defaultdict(list)
    for r in rows:
        k = None if r[0] is None else " ".join(t for t in r[0].replace("\t", " ").split(" ") if t)
        keys[k].append(r)
    out = {}
    for k, rs in keys.items():
        records = {(r[1], r[2]): r[3] for r in rs}
        out[k] = (len(rs), len(records), sum(v or 0 for v in records.values()), len({r[4] for r in rs} - {None}), len({r[5] for r in rs} - {None}))
    return out


def result(df):
    return {r["key"]: (r["rows_all"], r["records"], r["total"], r["distinct_1"], r["distinct_2"]) for r in df.collect()}


def make(n, seed, values=40):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = r.choice(["a _", "a  _", " a\t_ ", "a _", "b", None, "c d", f"k{r.randrange(30)}", ""])
        rows.append((key, r.choice(["x", "y", None]), i, r.choice([None, 1, 40, 7]), r.choice([None, *range(values)]), r.choice([None, *range(values)])))
    return rows + [x for x in rows if r.random() < 0.1]


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("values", [3, 2000])
def test_against_brute_force(spark, partitions, values):
    rows = make(3000, partitions, values)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("value", F.lit(2))
    assert result(skewed_counters(df, partitions=partitions)) == brute(rows)


def test_one_key_with_one_value(spark):
    """A single key, all of one value: only the record spreads it; the value is stitched to one."""
    rows = [("k", "s", i, 1, 5, 6) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = skewed_counters(df, partitions=8)
    assert result(got) == {"k": (5000, 5000, 5000, 1, 1)}


def test_small_batches(spark):
    rows = make(500, 9, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(skewed_counters(spark.createDataFrame(rows, SCHEMA), partitions=3)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_all_null(spark):
    assert skewed_counters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert result(skewed_counters(spark.createDataFrame([(None,) * 6] * 3, SCHEMA))) == {None: (3, 1, 0, 0, 0)}


def test_heavy(spark):
    rows = [("h", "s", i, 1, i, None) for i in range(98)] + [("x", "s", 1000, 1, 1, None), ("y", "s", 1001, 1, 1, None)]
    got = skewed_counters(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["key"] for r in heavy_keys(got).collect()) == ["h"]
    assert sorted(r["key"] for r in heavy_keys(got, (1, 100)).collect()) == ["h", "x", "y"]


def test_long_keys(spark):
    key = " ".join(["w" * 1000] * 50)
    assert result(skewed_counters(spark.createDataFrame([(key, "s", 1, 2, 3, 4)], SCHEMA))) == {key: (1, 1, 2, 1, 1)}
