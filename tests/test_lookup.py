from itertools import product

import pytest
from pyspark.errors import PySparkException

from gramforge.functions.patterns import parse_patterns
from gramforge.operators import cooccur, lookup

WORDS = "n int, w1 string, w2 string, w3 string, w4 string, w5 string, cnt long"
NGRAMS = [
    ("the", 900), ("of", 500), ("cat", 50), ("the cat", 60), ("the dog", 50), ("a cat", 45), ("of the", 300), ("of a", 70),
    ("of the cat", 44), ("of the dog", 41), ("by the cat", 40), ("the cat sat", 42), ("the the the", 40), ("a b c d e", 47), ("a b c d f", 40),
]
PATTERNS = ["the", "the _", "_ of", " _  the _ ", "_ _", "_ _ _", "zzz _", "the _", "", None, "the cat", "_", "a _ _ d _", "the _ the"]


def rows(items):
    return [(len(g.split()), *(g.split() + [None] * 5)[:5], c) for g, c in items]


@pytest.fixture
def ngrams(spark):
    return spark.createDataFrame(rows(NGRAMS), WORDS)


@pytest.fixture
def patterns(spark):
    return parse_patterns(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))


def matches(pattern, gram):
    p, g = pattern.split(), gram.split()
    return len(p) == len(g) and all(a in ("_", b) for a, b in zip(p, g))


def brute(pattern):
    hit = [(g, c) for g, c in NGRAMS if matches(pattern, g)]
    wild = pattern.split().count("_")
    n1 = len(hit) if wild else None
    n2 = len({g.split()[-1] for g, _ in hit}) if wild > 1 and pattern.endswith("_") else None
    return sum(c for _, c in hit), n1, n2


def clean():
    return sorted({" ".join(p.split()) for p in PATTERNS if p and p.split()})


def test_parsing(patterns):
    got = {r["pattern"]: r for r in patterns.collect()}
    assert sorted(got) == clean()
    assert got["_ the _"]["mask"] == 5 and got["_ the _"]["p1"] is None and got["_ the _"]["p2"] == "the"
    assert got["_ _ _"]["mask"] == 7 and got["a _ _ d _"]["mask"] == 13


def test_too_long(spark):
    with pytest.raises(PySparkException, match="more than 5"):
        parse_patterns(spark.createDataFrame([("a b c d e f",)], "pattern string")).collect()


@pytest.mark.parametrize("bound", [0, 200_000])
@pytest.mark.parametrize("zeroes", [False, True])
def test_counts(ngrams, patterns, zeroes, bound, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_PATTERNS", bound)
    got = {r[0]: tuple(r[1:]) for r in lookup.pattern_counts(ngrams, patterns, zeroes=zeroes).collect()}
    want = {p: brute(p) for p in clean()}
    assert got == {p: v for p, v in want.items() if zeroes or v[0]}


def test_counts_of_nothing(ngrams, patterns):
    assert lookup.pattern_counts(ngrams.limit(0), patterns).count() == 0
    assert lookup.pattern_counts(ngrams, patterns.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [0, 200_000])
@pytest.mark.parametrize("exact", [False, True])
def test_matching(ngrams, patterns, exact, bound, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_PATTERNS", bound)
    got = sorted(" ".join(w for w in r[1:6] if w) for r in lookup.matching_ngrams(ngrams, patterns, exact).collect())
    some = [p for p in clean() if set(p.split()) != {"_"}]
    want = [g for g, _ in NGRAMS if any(matches(p, g) for p in some) and (exact or g not in some)]
    if not exact:
        want = [g for g in want if any(matches(p, g) for p in some if "_" in p)]
    assert got == sorted(want)


@pytest.mark.parametrize("n", [2, 3])
def test_cube_equals_patterns(spark, ngrams, n):
    got = {}
    for r in lookup.cube_counts(ngrams, n).collect():
        got[" ".join("_" if r["mask"] >> (n - 1 - i) & 1 else r[i] for i in range(n))] = (r["n0"], r["n1"], r["n2"])
    keys = {" ".join("_" if m else w for m, w in zip(ms, g.split())) for g, _ in NGRAMS if len(g.split()) == n for ms in product([0, 1], repeat=n)}
    assert got == {k: brute(k) for k in keys}
    for mask in range(2**n):
        assert sum(v[0] for k, v in got.items() if int("".join("1" if t == "_" else "0" for t in k.split()), 2) == mask) == sum(c for g, c in NGRAMS if len(g.split()) == n)


def test_single_lookup_reaches_the_scan(spark, ngrams, tmp_path):
    from gramforge.sources.ngram_data import write_sorted

    write_sorted(ngrams, str(tmp_path / "first"), "w1", 2)
    write_sorted(ngrams, str(tmp_path / "second"), "w2", 2)
    first, second = spark.read.parquet(str(tmp_path / "first")), spark.read.parquet(str(tmp_path / "second"))
    found = lookup.lookup_sorted(first, second, "_ the _")
    assert "second" in found.inputFiles()[0]
    assert sorted(r["w1"] + r["w3"] for r in found.collect()) == ["bycat", "ofcat", "ofdog", "thethe"]
    plan = found._jdf.queryExecution().toString()
    assert "EqualTo(w2,the)" in plan and "PartitionFilters: [isnotnull(n" in plan
    with pytest.raises(ValueError):
        lookup.lookup(ngrams, "")


def test_completions(ngrams):
    got = [(r["context"], r["word"], r["rank"]) for r in lookup.top_completions(ngrams, 2, 1).collect()]
    assert sorted(got) == [("a", "cat", 1), ("of", "the", 1), ("the", "cat", 1)]


def test_cooccurrence(ngrams):
    got = {(r["a"], r["b"]): r["n0"] for r in cooccur.window_cooccurrence(ngrams).collect()}
    want = {}
    for g, c in NGRAMS:
        w = g.split()
        if len(w) > 1:
            k = tuple(sorted((w[0], w[-1])))
            want[k] = want.get(k, 0) + c * (2 if w[0] == w[-1] else 1)
    assert got == want
    fan = {(r["n"], r["suffix"]): (r["n0"], r["n1"]) for r in cooccur.left_fanout(ngrams).collect()}
    assert fan[(2, "cat")] == (105, 2) and fan[(3, "the cat")] == (84, 2)
    mid = {(r["n"], r["middle"]): (r["n0"], r["n1"]) for r in cooccur.mid_fanout(ngrams).collect()}
    assert mid[(3, "the")] == (165, 4)
    pre = {(r["n"], r["prefix"]): (r["n0"], r["n1"]) for r in cooccur.prefix_totals(ngrams).collect()}
    assert pre[(2, "of")] == (370, 2)
