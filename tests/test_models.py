"""The layered expressions against a recursive brute force over plain dictionaries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gramforge.operators.corpus import Corpus, known_sentences, windows
from gramforge.plans import optimize, score
from gramforge.plans.features import CONTEXT, distinct_positions, features, stats_tables
from gramforge.plans.smoothing import DEFAULTS, MODELS

K, T = 2, 4


def make_sentences():
    r = random.Random(5)
    words = ["a", "b", "c", "d", ".", ";", "e"]
    out = []
    for _ in range(120):
        n = r.choice([1, 2, 3, 5, 8])
        out.append(["<S>", *(r.choice(words[: r.choice([3, 5, 7])]) for _ in range(n)), "</S>"])
    return out + [["<S>", "unseen", "a", "</S>"]]


class Brute:
    """Counts by pattern text, and every model as a recursion on words."""

    def __init__(self, sents):
        vocab = {w for w, c in Counter(w for s in sents for w in s).items() if c >= T}
        self.vocab = vocab
        sents = [[w if w in vocab else "<UNK>" for w in s] for s in sents]
        self.grams = {}
        for n in range(1, 6):
            c = Counter(tuple(s[i : i + n]) for s in sents for i in range(len(s) - n + 1))
            self.grams.update({g: v for g, v in c.items() if n == 1 or v >= K})
        self.n0c, self.n1c, lasts = Counter(), Counter(), {}
        for g, v in self.grams.items():
            for mask in range(2 ** len(g)):
                p = tuple("_" if mask >> i & 1 else w for i, w in enumerate(g))
                self.n0c[p] += v
                self.n1c[p] += 1
                lasts.setdefault(p, set()).add(g[-1])
        self.n2c = {p: len(x) for p, x in lasts.items()}

    def n0(self, *p):
        return self.n0c.get(p, 0)

    def n1(self, *p):
        return self.n1c.get(p, 0)

    def n2(self, *p):
        return self.n2c.get(p, 0)

    def n1mod(self, p, coef):
        i = p.index("_")
        return self.n1(*p) + coef * (self.n0(*p[:i], *p[i + 1 :]) - self.n0(*p))

    def prob(self, model, x, y, n):
        """x: all words before y."""
        n = min(n, 5, len(x) + 1)
        if n == 1:
            return (self.n0(y) or T / 2) / self.n0("_")
        c = tuple(x[-(n - 1) :])
        lower = self.prob(model, x, y, n - 1)
        nx, nx_, nxy = self.n0(*c), self.n0(*c, "_"), self.n0(*c, y)
        par = DEFAULTS[model]
        bad = any(w in ";!?." for w in c)
        kn = model.startswith("kn")
        if kn:
            bad = bad and not (re.fullmatch(r"[^;!?.]*[;!?.]", " ".join(c)) and y == "</S>")
        if nx == 0 or bad or (model in ("kn", "kn1") and (nx_ == 0 or n == 5)):
            return lower
        if model == "mc":
            e = par[n - 2] * (nx - nx_) or 1
            return (nxy + lower * e) / (nx_ + e)
        if model == "baseline":
            return par[n - 2] * lower + ((1 - par[n - 2]) * nxy / nx_ if nx_ else 0)
        if model == "cdiscount":
            if n > 3 or nx_ == 0:
                return lower
            d = K * par[n - 2]
            return (nxy - d if nxy else 0) / nx_ + lower * d * self.n1(*c, "_") / nx_
        if model == "wbdiscount":
            if nx_ == 0:
                return lower
            k = self.n1(*c, "_") + 7 * (nx - nx_)
            b = k / (k + nx_)
            return (1 - b) * nxy / nx_ + b * lower
        if model == "gbits":
            d = par[n - 2] * K / 40
            return (nxy - d if nxy else 0) / nx + (d * self.n1(*c, "_") + nx - nx_) / nx * self.back(model, x, y, n - 1)
        back = self.back(model, x, y, n - 1)
        if model in ("kn", "kn1"):
            d = K * par[2 * n - 4 if model == "kn" else 2 * n - 3]
            return (nxy - d if nxy else 0) / nx_ + back * self.n1(*c, "_") * d / nx_
        e = par[2 * n - 3] * (nx - nx_) or 1
        return (nxy + back * e) / (nx_ + e)

    def back(self, model, x, y, n):
        if n == 1:
            return (self.n1("_", y) or 1) / self.n1("_", "_")
        c = tuple(x[-(n - 1) :])
        lower = self.back(model, x, y, n - 1)
        par = DEFAULTS[model]
        n1x = self.n1(*c, "_")
        bad = model != "gbits" and any(w in ";!?." for w in c) and not (re.fullmatch(r"[^;!?.]*[;!?.]", " ".join(c)) and y == "</S>")
        if model in ("kn", "gbits"):
            ctx, hit = self.n1("_", *c, "_"), self.n1("_", *c, y)
        else:
            coef = (par[0] + 1) / (par[0] + K) if model in ("kn1", "kn3") else max(par[0], 1 / K)
            ctx, hit = self.n1mod(("_", *c, "_"), coef), self.n1mod(("_", *c, y), coef)
        if ctx == 0 or bad:
            return lower
        if model == "gbits":
            d = par[4 + n - 2]
            return (hit - d if hit else 0) / ctx + d * n1x / ctx * lower
        if model == "kn":
            d = par[2 * n - 3]
            return (hit - d if hit else 0) / ctx + lower * self.n2("_", *c, "_") * d / ctx
        if model in ("kn1", "kn3"):
            d = par[2 * n - 2]
            return (hit - d if hit else 0) / ctx + lower * n1x * d / ctx
        if model == "kn4":
            e = par[2 * n - 2] * (self.n0(*c) - self.n0(*c, "_")) or 1
            return (hit + lower * e) / (e + ctx)
        m = par[2 * n - 2] * self.n1mod((*c, "_"), 1 / K)
        return (hit - 1 if hit else 0) / (m + ctx) + lower * (m + n1x) / (m + ctx)


@pytest.fixture(scope="module")
def made(spark):
    sents = make_sentences()
    brute = Brute(sents)
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sents)], "doc_id long, line_no int, w array<string>")
    vocab = spark.createDataFrame([(w,) for w in sorted(brute.vocab)], "w1 string")
    mapped = spark.createDataFrame([(1, i, [w if w in brute.vocab else "<UNK>" for w in s]) for i, s in enumerate(sents)], "doc_id long, line_no int, w array<string>")
    corpus = Corpus(df, vocab, windows(mapped), K, T)
    known = known_sentences(df, vocab)
    feats = features(distinct_positions(known), stats_tables(corpus)).cache()
    return brute, corpus, feats, sents


def test_known_sentences(made, spark):
    brute, corpus, _, sents = made
    assert known_sentences(corpus.sents, corpus.vocab).count() == sum(all(w in brute.vocab for w in s) for s in sents)


@pytest.mark.parametrize("model", MODELS)
def test_model(made, model):
    brute, corpus, feats, _ = made
    seen = 0
    for r in score.with_bits(feats, model, corpus).collect():
        x = [r[c] for c in CONTEXT if r[c] is not None]
        for n in range(1, 6):
            p = brute.prob(model, x, r["y"], n)
            assert r[f"bits_{n}"] == pytest.approx(-math.log2(p) if p > 0 else 1e9, abs=1e-9), (model, x, r["y"], n)
            seen += 1
    assert seen > 500


@pytest.mark.parametrize("model", ["mc", "kn", "kn1", "kn3", "kn4", "knmod"])
def test_probabilities_add_up(made, spark, model):
    brute, corpus, feats, _ = made
    words = spark.createDataFrame([(g[0],) for g in brute.grams if len(g) == 1], "w1 string")
    # the exception for </S> after a final period is the only word-dependent rule: leave such contexts out
    plain = feats.where("x4 is not null").where(" and ".join(f"not {c} in ('.', ';')" for c in CONTEXT))
    plain = plain.select(*CONTEXT).distinct().orderBy(*CONTEXT).limit(12)
    rows = optimize.normalization(plain, words, stats_tables(corpus), [model], K, T).collect()
    assert rows
    for r in rows:
        for n in range(1, 6):
            assert r[f"sum_{n}"] == pytest.approx(1, abs=1e-9)


def test_string_and_patterns(made, spark):
    brute, corpus, feats, sents = made
    row = score.score_string(corpus, stats_tables(corpus), "<S> a b c a", "knmod").first()
    assert row["bits_5"] == pytest.approx(-math.log2(brute.prob("knmod", ["<S>", "a", "b", "c"], "a", 5)))
    asked = {r[0] for r in score.request_patterns(distinct_positions(corpus.sents.where("line_no < 40")), "knmod").collect()}
    assert {"_", "_ _", "a", "<S> a", "<S> _"} <= asked and not any(len(p.split()) > 5 for p in asked)


def test_entropy_of_nothing(made):
    _, corpus, feats, _ = made
    row = score.cross_entropy(score.with_bits(feats.limit(0), "mc", corpus)).first()
    assert row["words"] == 0 and row["bits_5"] is None


def test_rare_words_as_unknown(made, spark):
    _, corpus, _, _ = made
    vocab = corpus.vocab.withColumn("cnt", F.when(F.col("w1") == "a", 1).otherwise(100))
    got = score.mincnt_positions(corpus.sents, vocab, 50)
    assert got.where("x1 = 'a' or x2 = 'a' or x3 = 'a' or x4 = 'a'").count() == 0
    assert got.where("y = 'a'").count() > 0 and got.where("x1 = '<UNK>'").count() > 0


@pytest.mark.parametrize("kind", ["default", "zeroes", "random"])
def test_optimizers_agree(kind):
    """On a smooth function without Spark: every start ends at the optimum."""
    f = lambda points: [(p[0] - 3) ** 2 + 2 * (p[1] - 1.5) ** 2 + 0.5 * p[0] * p[1] for p in points]
    x, v = optimize.hill_climb(f, optimize.start("mc", 3, kind), least=1e-5, gain=1e-12)
    y, w = optimize.simplex(f, optimize.start("mc", 3, kind), least=1e-6)
    assert v == pytest.approx(w, abs=1e-4) and x == pytest.approx(y, abs=1e-2)


def test_objective(made):
    brute, corpus, feats, sents = made
    f = optimize.objective(feats, "mc", 3, K, T)
    values = f([[7.8440119, 6.6305746], [-1.0, 2.0], [0.0, 2.0]])
    total, words = 0.0, 0
    for s in sents:
        if all(w in brute.vocab for w in s):
            for i in range(1, len(s) - 1):
                total -= math.log2(brute.prob("mc", s[:i], s[i], 3))
                words += 1
    assert values[0] == pytest.approx(total / words) and values[1] == pytest.approx(values[2])
    assert optimize.objective(feats, "kn", 3, K, T)([[2.0, 0.5, 0.5]]) == [1e9]
    assert [optimize.dimensions(m, 5) for m in ("mc", "kn", "knmod")] == [4, 7, 8]


def test_request_patterns_of_sentences_with_unknown_words(spark, small):
    """A sentence that scoring skips for a rare word asks for its patterns all the same: the query's SQL over all sentences."""
    import duckdb

    from compare import differences
    from gramforge.plans import queries
    from gramforge.plans.oracles import ORACLE

    c = queries.corpus(spark, small)
    words = {r[0] for r in c.sents.select(F.explode(F.slice("w", F.lit(2), F.size("w") - 2))).distinct().collect()}
    got = queries.request_patterns(spark, small)
    assert words - {r["w1"] for r in c.vocab.collect()} and words <= {r[0] for r in got.collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    assert differences(got, con, ORACLE["request_patterns"]) == ""


def test_optimize_mc_moves_all_parameters_to_the_optimum(spark, small, monkeypatch):
    """The query on a smooth function in place of the corpus: every start ends at its optimum."""
    from gramforge.plans import queries

    best = [3.3, 1.7, 2.2, 4.1]
    asked = []

    def smooth(feats, model, order, *thresholds):
        asked.append((model, order))
        return lambda points: [8 + sum((a - b) ** 2 for a, b in zip(p, best[: order - 1])) + 0.3 * p[0] * p[1] for p in points]

    monkeypatch.setattr(optimize, "objective", smooth)
    monkeypatch.setattr(queries, "_features", lambda spark, sf: None)
    rows = queries.optimize_mc(spark, small).collect()
    assert asked == [("mc", 5)] and len(rows) == 4
    assert all(len(r["params"]) == 4 and r["params"][2:] == pytest.approx(best[2:], abs=2e-3) for r in rows)
    assert max(r["bits"] for r in rows) - min(r["bits"] for r in rows) < 1e-4
