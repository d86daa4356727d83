"""Scoring a corpus: bits per token, cross entropy, the patterns a model asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.tokenizer import UNKNOWN
from gramforge.operators.corpus import Corpus, known_sentences
from gramforge.plans.features import CONTEXT, bad_contexts, features, positions
from gramforge.plans.smoothing import KN_MODELS, apply_layers, bits, layers, prefixed


def with_bits(feats: DataFrame, model: str, corpus: Corpus, params: list[float] | None = None) -> DataFrame:
    """Feature rows with bits_1..bits_5."""
    scored = apply_layers(feats, layers(model, params, corpus.ngram_threshold, corpus.token_threshold))
    return scored.select("*", *(F.expr(bits(f"p{n}")).alias(f"bits_{n}") for n in range(1, 6)))


def cross_entropies(feats: DataFrame, models: list[str], ngram_threshold: int, token_threshold: int) -> DataFrame:
    """model, words, bits_1..bits_5 of several models, over one scan of the feature table: each model's layers have names of their own."""
    sums = [F.coalesce(F.sum("times"), F.lit(0)).alias("words")]
    for m in models:
        feats = apply_layers(feats, prefixed(layers(m, None, ngram_threshold, token_threshold), f"{m}_"))
        sums += [F.try_divide(F.sum(F.expr(bits(f"{m}_p{n}")) * F.col("times")), F.sum("times")).alias(f"{m}_{n}") for n in range(1, 6)]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), *(F.col(f"{m}_{n}").alias(f"bits_{n}") for n in range(1, 6))) for m in models))).alias("e")
    return feats.agg(*sums).select("words", each).select("e.model", "words", *(f"e.bits_{n}" for n in range(1, 6)))


def cross_entropy(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """words and bits per word of each order; null over no words."""
    mean = [F.try_divide(F.sum(F.col(f"bits_{n}") * F.col("times")), F.sum("times")).alias(f"bits_{n}") for n in range(1, 6)]
    total = F.coalesce(F.sum("times"), F.lit(0)).alias("words")
    return scored.groupBy(*(by or [])).agg(total, *mean)


def rare_as_unknown(sents: DataFrame, vocab: DataFrame, mincnt: int) -> DataFrame:
    """Sentences of known words with the words below ``mincnt`` replaced by <UNK>, beside the words themselves (column y).

    Contexts are taken from the replaced words, targets stay as they are.
    """
    key = ["doc_id", "line_no"]
    tokens = sents.select(*key, F.posexplode("w").alias("i", "w1")).join(vocab.select("w1", "cnt"), "w1", "left")
    x = F.when(F.coalesce("cnt", F.lit(0)) < mincnt, F.lit(UNKNOWN)).otherwise(F.col("w1"))
    s = tokens.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", F.col("w1").alias("y"), x.alias("x")))).alias("s"))
    return s.select(*key, F.col("s.x").alias("w"), F.col("s.y").alias("y"))


def mincnt_positions(sents: DataFrame, vocab: DataFrame, mincnt: int) -> DataFrame:
    """x4..x1 (rare words as <UNK>), y, times."""
    marked = rare_as_unknown(known_sentences(sents, vocab), vocab, mincnt)
    pos = positions(marked.withColumnRenamed("y", "real"), ("real",)).select(*CONTEXT, F.get(F.col("real"), F.col("i")).alias("y"))
    return pos.groupBy(*CONTEXT, "y").agg(F.count("*").alias("times"))


def string_position(spark: SparkSession, text: str) -> DataFrame:
    """The last of some blank-separated words, after up to four before it."""
    words = text.split()[-5:]
    return spark.createDataFrame([(*[None] * (5 - len(words)), *words)], "x4 string, x3 string, x2 string, x1 string, y string")


def score_string(corpus: Corpus, stats: dict[str, DataFrame], text: str, model: str) -> DataFrame:
    """Bits of the last of some blank-separated words, for each order."""
    pos = string_position(corpus.sents.sparkSession, text)
    return with_bits(features(pos, stats), model, corpus).select("y", *(f"bits_{n}" for n in range(1, 6)))


def request_patterns(pos: DataFrame, model: str, order: int = 5) -> DataFrame:
    """Distinct patterns (text) that scoring positions with a model asks for, at most ``order`` words long (not for gbits, which asks for none).

    All counts are taken to be present; contexts that hold a bad token ask for nothing beyond their own counts.
    """
    if model == "gbits":
        raise ValueError("the older model has no patterns")
    rows = pos.select(*CONTEXT, "y", *bad_contexts())
    kn = model in KN_MODELS
    bad = "kbad" if kn else "bad"
    top = min(order, {"kn": 4, "kn1": 4}.get(model, 5))
    wanted = [(F.lit(True), F.col("y")), (F.lit(True), F.lit("_"))]
    joined = lambda *parts: F.concat_ws(" ", *parts)
    for n in range(2, order + 1):
        k = n - 1
        x = [F.col(f"x{j}") for j in range(k, 0, -1)]
        there = F.col(f"x{k}").isNotNull()
        good = there & ~F.col(f"{bad}_{k}")
        wanted += [(there, joined(*x)), (there, joined(*x, F.lit("_")))]
        if not kn:
            wanted.append((there, joined(*x, F.col("y"))))
        elif n <= top:
            wanted.append((good, joined(*x, F.col("y"))))
    if kn:
        # the back-off of order n - 1 is asked for where order n is good
        for n in range(2, top + 1):
            use = F.col(f"x{n - 1}").isNotNull() & ~F.col(f"kbad_{n - 1}")
            wanted += [(use, joined(F.lit("_"), F.col("y"))), (use, F.lit("_ _"))]
            for m in range(2, n):
                k = m - 1
                x = [F.col(f"x{j}") for j in range(k, 0, -1)]
                good = use & ~F.col(f"kbad_{k}")
                wanted += [(use, joined(F.lit("_"), *x, F.lit("_"))), (good, joined(F.lit("_"), *x, F.col("y"))), (good, joined(*x, F.lit("_")))]
                if model != "kn":
                    wanted += [(use, joined(*x, F.lit("_"))), (good, joined(*x, F.col("y"))), (good, joined(*x))]
    each = F.array(*(F.when(c, t) for c, t in wanted))
    return rows.select(F.explode(F.array_distinct(each)).alias("pattern")).where("pattern is not null").distinct()
