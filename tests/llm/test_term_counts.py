import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramforge.llm.term_counts import TermCountStore, load_by_delivery
from gramforge.session import shared_dir

SCHEMA = "k1 long, k2 long, content string, weight long, version long"


def brute(records):
    occ, rec = Counter(), Counter()
    for content, weight in records.values():
        terms = [t for t in content.replace("\t", " ").split(" ") if t]
        for t in terms:
            occ[t] += weight
        for t in set(terms):
            rec[t] += 1
    return {t: (occ[t], rec[t]) for t in rec}


def result(store):
    return {r["term"]: (r["occurrences"], r["records"]) for r in store.counts().collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_changes(spark, seed):
    """Added, changed, repeated and deleted records, batch by batch, against counting from scratch."""
    r = random.Random(seed)
    store = TermCountStore(spark, shared_dir(spark, "t"), buckets=3)
    state = {}
    for batch in range(4):
        rows = {}
        for _ in range(60):
            key = (r.randrange(4), r.randrange(20))
            rows[key] = (*key, " ".join(r.choice(["a", "b", "c ", "d\te", "ü"]) for _ in range(r.randrange(5))), r.randrange(1, 9), batch)
        keep = [(*k, *state[k], batch) for k in list(state)[:5] if k not in rows]  # sent again unchanged
        gone = [k for k in list(state)[-4:] if batch]
        store.apply(
            spark.createDataFrame([*rows.values(), *keep, (1, 999, None, 3, 0), (None, 5, "x", 3, 0), (5, 5, "x", None, 0)], SCHEMA).withColumn("term", F.lit("clash")).withColumn("gen", F.lit(9)),
            spark.createDataFrame(gone, "k1 long, k2 long") if gone else None,
        )
        for k, v in rows.items():
            state[k] = (v[2], v[3])
        for k in gone:
            state.pop(k, None)
        assert result(store) == brute(state)
        assert store.total() == len(state)
        if batch == 2:
            store.compact()
            store.clean()
        store = TermCountStore(spark, store.path)  # opened again, as by another application


def test_unchanged_batch_writes_no_delta(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"))
    df = spark.createDataFrame([(1, i, "a b a", 40, 0) for i in range(10)], SCHEMA)
    store.apply(df)
    store.apply(df)
    assert spark.read.schema("k1 long").parquet(f"{store.path}/records/gen=1").count() == 0
    assert set(store.state["counts"].values()) == {0}
    assert result(store) == {"a": (800, 10), "b": (400, 10)}


def test_latest_version_in_a_batch(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"))
    store.apply(spark.createDataFrame([(1, 1, "old", 1, 1), (1, 1, "new", 1, 2), (1, 1, "null", 1, None)], SCHEMA))
    assert set(result(store)) == {"new"}


def test_marks_and_compaction(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"))
    store.apply(spark.createDataFrame([(1, i, "all " + ("few" if i < 2 else "x"), 60, 0) for i in range(100)], SCHEMA))
    store.compact()
    got = {r["term"]: (r["rare"], r["common"]) for r in store.counts().collect()}
    assert got == {"all": (False, True), "few": (True, False), "x": (False, True)}
    assert result(store) == {"all": (6000, 100), "few": (120, 2), "x": (5880, 98)}
    store.apply(spark.createDataFrame([(1, 0, "all", 60, 0), (2, 0, "x", 1, 0)], SCHEMA))
    store.compact()
    store.apply(spark.createDataFrame([(2, 0, "x x", 1, 0)], SCHEMA))
    assert result(store) == {"all": (6000, 100), "few": (60, 1), "x": (5882, 99)}


def test_empty_and_long(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"))
    store.apply(spark.createDataFrame([], SCHEMA))
    assert result(store) == {}
    store.apply(spark.createDataFrame([(1, 1, " ".join(["w", "v"] * 100_000), 2, 0), (1, 2, "", 2, 0), (1, 3, " \t ", 2, 0)], SCHEMA))
    assert result(store) == {"w": (200_000, 1), "v": (200_000, 1)} and store.total() == 3


def test_loading_by_delivery(spark, small):
    df = spark.read.parquet(f"{small}/ngram_files.parquet")
    by_delivery = result(load_by_delivery(spark, shared_dir(spark, "t"), df))
    state = {(r.fnum, r.line_no): (r.ngram, r.cnt) for r in df.where("ngram is not null and cnt is not null").collect()}
    assert by_delivery == brute(state)
    assert result(load_by_delivery(spark, shared_dir(spark, "t"), df.limit(0))) == {}


def test_opened_again(spark):
    path = shared_dir(spark, "t")
    TermCountStore(spark, path, buckets=5).apply(spark.createDataFrame([(1, i, "a b", 1, 0) for i in range(10)], SCHEMA))
    again = TermCountStore(spark, path, buckets=3)
    assert result(again) == {"a": (10, 10), "b": (10, 10)} and again.total() == 10 and again.buckets == 5
    again.apply(spark.createDataFrame([(2, 0, "c", 1, 0)], SCHEMA), spark.createDataFrame([(1, 0)], "k1 long, k2 long"))
    assert result(TermCountStore(spark, path)) == {"a": (9, 9), "b": (9, 9), "c": (1, 1)}


def test_versions_out_of_order(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"))
    one = lambda text, version: spark.createDataFrame([(1, 1, text, 1, version)], SCHEMA)
    for text, version, left in (("new", 5, "new"), ("old", 2, "new"), ("null", None, "new"), ("same", 5, "same"), ("newer", 6, "newer")):
        store.apply(one(text, version))
        assert result(store) == {left: (1, 1)}
    store.apply(one("x", 1).limit(0), spark.createDataFrame([(1, 1)], "k1 long, k2 long"))
    store.apply(one("old", 4))
    assert result(store) == {} and store.total() == 0
    store.compact()
    store.apply(one("old", 4))
    assert result(store) == {}
    store.apply(one("newest", 7))
    assert result(store) == {"newest": (1, 1)} and store.total() == 1


def test_a_batch_reads_and_writes_only_what_it_touches(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"), buckets=64)
    store.apply(spark.createDataFrame([(f, i, f"word{f} x{i}", 1, 0) for f in range(200) for i in range(5)], SCHEMA))
    before = dict(store.state["counts"])
    read = []
    stored = store._stored
    store._stored = lambda parts: read.append(parts) or stored(parts)
    store.apply(spark.createDataFrame([(7, 0, "word7 changed", 1, 1)], SCHEMA))
    assert len(read) == 1 and len(read[0]) == 1 and len(stored(read[0]).inputFiles()) < len(stored(list(range(64))).inputFiles()) / 20
    assert sum(before.get(k) != v for k, v in store.state["counts"].items()) <= 2


def test_a_batch_that_fails_changes_nothing(spark):
    store = TermCountStore(spark, shared_dir(spark, "t"))
    store.apply(spark.createDataFrame([(1, 1, "a", 1, 0)], SCHEMA))
    commit, store._commit = store._commit, lambda state: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.apply(spark.createDataFrame([(1, 1, "b", 1, 1)], SCHEMA))
    again = TermCountStore(spark, store.path)
    assert result(again) == {"a": (1, 1)}
    again.apply(spark.createDataFrame([(1, 1, "c", 1, 1)], SCHEMA))
    assert result(again) == {"c": (1, 1)}
