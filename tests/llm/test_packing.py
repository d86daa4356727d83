import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gramforge.llm.packing import fullest, pack, pack_documents, token_lengths


def test_fullest_is_optimal():
    r = random.Random(1)
    for _ in range(400):
        lengths = list({r.randint(1, 12): r.randint(1, 3) for _ in range(r.randint(0, 5))}.items())
        room = r.randint(0, 30)
        got = Counter(fullest(lengths, room))
        assert all(v <= dict(lengths)[k] for k, v in got.items())
        best = max(s for ks in itertools.product(*[range(c + 1) for _, c in lengths]) if (s := sum(k * n for k, (n, _) in zip(ks, lengths))) <= room)
        assert sum(k * v for k, v in got.items()) == best


def test_pack_uses_everything_once():
    r = random.Random(2)
    stock = Counter(int(r.lognormvariate(5, 1)) % 511 + 1 for _ in range(3000))
    made = pack(dict(stock), 512)
    assert Counter(x for c, k in made for x in c * k) == stock
    assert all(sum(c) <= 512 for c, _ in made)
    bins, total = sum(k for _, k in made), sum(k * v for k, v in stock.items())
    assert total / (bins * 512) > 0.995
    assert pack({}, 10) == [] and pack({10: 3}, 10) == [([10], 3)]


def check(rows, sizes):
    by = defaultdict(list)
    for r in rows:
        by[r["class_name"]].append(r)
    for rs in by.values():
        fill, pieces = Counter(), defaultdict(list)
        for r in rs:
            assert (r["container_id"] is None) == (r["tokens"] == 0)
            if r["tokens"]:
                fill[r["container_id"]] += r["tokens"]
            pieces[r["doc_id"]].append(r)
        capacity = rs[0]["capacity"]
        assert all(v <= capacity for v in fill.values())
        for doc, ps in pieces.items():
            assert sum(p["tokens"] for p in ps) == sum(sizes[doc])
            if len(sizes[doc]) == 1 and sizes[doc][0] <= capacity:
                assert len(ps) == 1
        yield rs[0]["class_name"], sum(fill.values()) / (len(fill) * capacity) if fill else 1.0


def test_documents(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 5, 100, 511, 512, 513, 5000, r.randrange(1, 700)])) for i in range(2000)] + [(7, 40), (7, 40)]
    sizes = defaultdict(list)
    for i, n in rows:
        sizes[i].append(n)
    lengths = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("shard", F.lit(9)).withColumn("capacity", F.lit("clash"))
    classes = spark.createDataFrame([("small", 512), ("large", 4096), ("none", 0), ("null", None)], "class_name string, capacity int")
    got = dict(check(pack_documents(lengths, classes, shard_items=400).collect(), sizes))
    assert set(got) == {"small", "large"} and min(got.values()) > 0.97
    assert pack_documents(lengths.limit(0), classes).count() == 0


def test_tokens_of_texts(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 50_000)], "doc_id long, text string")
    got = {r[0]: r[1] for r in token_lengths(docs).collect()}
    assert got[2] == got[3] == 0 and got[1] == 2 and got[4] > 1 and got[5] >= 50_000


def test_shards_are_packed_by_as_many_tasks(spark):
    lengths = spark.range(500).selectExpr("id as doc_id", "id % 90 + 1 as tokens")
    classes = spark.createDataFrame([("c", 100)], "class_name string, capacity int")
    assert pack_documents(lengths, classes, shard_items=50).rdd.getNumPartitions() == 10
