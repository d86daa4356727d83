import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.llm.cooccurrence import cooccurrence, item_stats, pair_counts


def make(seed, n=800):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        k = r.choice([0, 1, 2, 3, 5, 9])
        terms = sorted({r.choice(["the", "of", "é", "Z", f"w{int(r.paretovariate(1))}", f"v{r.randrange(40)}"]) for _ in range(k)}, key=lambda _: r.random())
        rows.append((terms, r.choice([0, 1, 40, 1000, 2**33])))
    return rows


def brute(rows):
    n, w = Counter(), Counter()
    for terms, weight in rows:
        for a, b in combinations(sorted(terms), 2):
            n[a, b] += 1
            w[a, b] += weight
    return {k: (n[k], w[k]) for k in n}


@pytest.mark.parametrize("heavy", [[], ["the"], ["the", "of", "é", "w1", "w2"], "all"])
def test_parts_are_complete(spark, heavy):
    rows = make(1)
    if heavy == "all":
        heavy = sorted({t for ts, _ in rows for t in ts})
    df = spark.createDataFrame(rows, "terms array<string>, weight long").repartition(3)
    got = {(r[0], r[1]): (r[2], r[3]) for r in pair_counts(df, heavy).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("share", [0.001, 0.05, 2.0])
def test_lift_and_thresholds(spark, share):
    rows = make(2)
    df = spark.createDataFrame(rows, "terms array<string>, weight long").withColumn("term", F.lit("clash"))
    got = {(r["term_a"], r["term_b"]): r for r in cooccurrence(df, item_stats(df), min_records=3, min_lift=2, heavy_share=share).collect()}
    w, total = Counter(), sum(x for _, x in rows)
    for ts, x in rows:
        for t in ts:
            w[t] += x
    want = {k: v for k, v in brute(rows).items() if v[0] >= 3 and total * v[1] >= 2 * w[k[0]] * w[k[1]]}
    assert {k: (r["records"], r["weight"]) for k, r in got.items()} == want
    for k, r in got.items():
        if w[k[0]] * w[k[1]]:
            assert r["lift"] == pytest.approx(total * want[k][1] / (w[k[0]] * w[k[1]]))


def test_byte_order_and_repeats(spark):
    rows = [(["ü", "z", "Z", "a"], 1)] * 3
    df = spark.createDataFrame(rows, "terms array<string>, weight long")
    got = sorted((r[0], r[1], r[2]) for r in pair_counts(df, ["z"]).collect())
    assert got == sorted((a, b, 3) for a, b in combinations(sorted(["ü", "z", "Z", "a"]), 2))


def test_small_and_empty(spark):
    for rows in ([], [(["a"], 4)], [([], 1)]):
        df = spark.createDataFrame(rows, "terms array<string>, weight long")
        assert cooccurrence(df, item_stats(df)).count() == 0


def test_long_record(spark):
    terms = [f"t{i:04d}" for i in range(700)]
    df = spark.createDataFrame([(terms, 2)], "terms array<string>, weight long")
    assert pair_counts(df, terms[:3]).count() == 700 * 699 // 2


def test_rare_items_are_taken_out_before_pairing(spark, monkeypatch):
    """Few bits, few heavy items, sums in small parts: the same pairs."""
    from gramforge.llm import cooccurrence as module

    monkeypatch.setattr(module, "MAX_HEAVY", 3)
    rows = make(3) + [([f"long{i}" for i in range(60)], 2)] * 2
    df = spark.createDataFrame(rows, "terms array<string>, weight long")
    for bits in (64, 1 << 16):
        got = {(r["term_a"], r["term_b"]): (r["records"], r["weight"]) for r in cooccurrence(df, item_stats(df), min_records=4, heavy_share=0.001, map_bits=bits).collect()}
        assert got == {k: v for k, v in brute(rows).items() if v[0] >= 4}
    frequent = module.frequent_map(item_stats(df), 4)
    assert 0 < sum(int(x).bit_count() for x in frequent) <= sum(v >= 4 for v in Counter(t for ts, _ in rows for t in ts).values())
    names = [f"w{i}" for i in range(60)]
    row, ids, weight = np.zeros(60, np.int64), np.arange(60), np.array([3])
    whole = module._Block._hashed(row, ids, weight, names)
    monkeypatch.setattr(module, "HELD", 50)
    parts = module._Block._hashed(row, ids, weight, names)
    flat = lambda x: sorted((a, b, int(n), int(w)) for p in x for a, b, n, w in zip(*p))
    assert len(whole) == 1 < len(parts) and flat(whole) == flat(parts)
    emitted = pair_counts(df, [], None, frequent).where("term_a like 'long%'").count()
    assert emitted == 0
