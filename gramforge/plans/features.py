"""Counts that language models ask for, as one wide row for each scored position.

Names: for the k words x before the target: ``x0_k`` n0(x), ``r0_k`` n0(x _), ``r1_k`` n1(x _), ``m0_k`` n0(_ x _), ``m1_k`` n1(_ x _),
``m2_k`` n2(_ x _); for k words z that end in the target: ``y0_k`` n0(z), ``l0_k`` n0(_ z), ``l1_k`` n1(_ z). Absent counts are 0.
``t0`` is n0(_), ``t1`` is n1(_ _).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.operators.corpus import Corpus
from gramforge.session import materialize
from gramforge.sources.ngram_data import WORDS

CONTEXT = ["x4", "x3", "x2", "x1"]
#: tokens after which the counts are not to be trusted (fixed values)
BAD_TOKENS = [";", "!", "?", "."]


def positions(sents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per scored token: kept columns, i (from 1), y, x4..x1 (null before the sentence). Sentence marks aren't scored."""
    at = sents.where(F.size("w") > 2).select(*keep, "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i"))
    before = [F.get(F.col("w"), F.col("i") - k).alias(f"x{k}") for k in (4, 3, 2, 1)]
    return at.select(*keep, "i", F.get(F.col("w"), F.col("i")).alias("y"), *before)


def distinct_positions(sents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """x4..x1, y, kept columns and how often: positions that look alike are scored once."""
    return positions(sents, keep).groupBy(*keep, *CONTEXT, "y").agg(F.count("*").alias("times"))


def _sums(parts: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    """Tables with some of the counts each, joined on their keys by adding up."""
    full = [p.select(*keys, *((F.col(n) if n in p.columns else F.lit(0).cast("long")).alias(n) for n in names)) for p in parts]
    out = full[0]
    for p in full[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))


def context_stats(orders: dict[int, DataFrame], k: int) -> DataFrame:
    """c1..ck with x0_k, r0_k, r1_k and, up to k = 3, m0_k, m1_k, m2_k."""
    keys = [f"c{i + 1}" for i in range(k)]
    rename = lambda df, first: df.select(*(F.col(WORDS[first + i]).alias(c) for i, c in enumerate(keys)), *[w for w in WORDS[first + k : first + k + 1] if w in df.columns], "cnt")
    parts = [rename(orders[k], 0).select(*keys, F.col("cnt").alias(f"x0_{k}"))]
    parts.append(orders[k + 1].groupBy(*(F.col(WORDS[i]).alias(c) for i, c in enumerate(keys))).agg(F.sum("cnt").alias(f"r0_{k}"), F.count("*").alias(f"r1_{k}")))
    names = [f"x0_{k}", f"r0_{k}", f"r1_{k}"]
    if k <= 3:
        last = WORDS[k + 1]
        middle = orders[k + 2].groupBy(*(F.col(WORDS[i + 1]).alias(c) for i, c in enumerate(keys)))
        parts.append(middle.agg(F.sum("cnt").alias(f"m0_{k}"), F.count("*").alias(f"m1_{k}"), F.count_distinct(last).alias(f"m2_{k}")))
        names += [f"m0_{k}", f"m1_{k}", f"m2_{k}"]
    return _sums(parts, keys, names)


def target_stats(orders: dict[int, DataFrame], k: int) -> DataFrame:
    """c1..ck with y0_k and, up to k = 4, l0_k and l1_k."""
    keys = [f"c{i + 1}" for i in range(k)]
    parts = [orders[k].select(*(F.col(WORDS[i]).alias(c) for i, c in enumerate(keys)), F.col("cnt").alias(f"y0_{k}"))]
    names = [f"y0_{k}"]
    if k <= 4:
        parts.append(orders[k + 1].groupBy(*(F.col(WORDS[i + 1]).alias(c) for i, c in enumerate(keys))).agg(F.sum("cnt").alias(f"l0_{k}"), F.count("*").alias(f"l1_{k}")))
        names += [f"l0_{k}", f"l1_{k}"]
    return _sums(parts, keys, names)


def totals(orders: dict[int, DataFrame]) -> DataFrame:
    """t0 = n0(_), t1 = n1(_ _): one row."""
    return orders[1].agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("t0")).crossJoin(orders[2].agg(F.count("*").alias("t1")))


def stats_tables(corpus: Corpus) -> dict[str, DataFrame]:
    """The nine written tables that positions are joined with, and the totals."""
    orders = {n: materialize(corpus.order(n), f"order-{n}") for n in range(1, 6)}
    out = {f"x{k}": context_stats(orders, k) for k in range(1, 5)} | {f"y{k}": target_stats(orders, k) for k in range(1, 6)}
    return out | {"totals": totals(orders)}


def stats_from_counts(counts: DataFrame) -> dict[str, DataFrame]:
    """The same tables from a count file: parsed patterns (n, mask, p1..p5) with n0, n1, n2. What it lacks is 0."""
    words = ["p1", "p2", "p3", "p4", "p5"]

    def pick(n: int, mask: int, first: int, k: int, **names: str) -> DataFrame:
        rows = counts.where((F.col("n") == n) & (F.col("mask") == mask))
        return rows.select(*(F.col(words[first + i]).alias(f"c{i + 1}") for i in range(k)), *(F.coalesce(c, F.lit(0)).alias(name) for c, name in names.items()))

    out = {}
    for k in range(1, 5):
        keys = [f"c{i + 1}" for i in range(k)]
        parts = [pick(k, 0, 0, k, n0=f"x0_{k}"), pick(k + 1, 1, 0, k, n0=f"r0_{k}", n1=f"r1_{k}")]
        names = [f"x0_{k}", f"r0_{k}", f"r1_{k}"]
        if k <= 3:
            parts.append(pick(k + 2, 1 << (k + 1) | 1, 1, k, n0=f"m0_{k}", n1=f"m1_{k}", n2=f"m2_{k}"))
            names += [f"m0_{k}", f"m1_{k}", f"m2_{k}"]
        out[f"x{k}"] = _sums(parts, keys, names)
    for k in range(1, 6):
        keys = [f"c{i + 1}" for i in range(k)]
        parts, names = [pick(k, 0, 0, k, n0=f"y0_{k}")], [f"y0_{k}"]
        if k <= 4:
            parts.append(pick(k + 1, 1 << k, 1, k, n0=f"l0_{k}", n1=f"l1_{k}"))
            names += [f"l0_{k}", f"l1_{k}"]
        out[f"y{k}"] = _sums(parts, keys, names)
    one = lambda n, mask, c: F.coalesce(F.max(F.when((F.col("n") == n) & (F.col("mask") == mask), F.col(c))), F.lit(0))
    return out | {"totals": counts.agg(one(1, 1, "n0").alias("t0"), one(2, 3, "n1").alias("t1"))}


def bad_contexts() -> list[Column]:
    """bad_k: one of the k words before the target is a token of BAD_TOKENS; kbad_k: the same, but for </S> after a context whose only such character is its last."""
    out = []
    for k in range(1, 5):
        words = [F.col(f"x{j}") for j in range(k, 0, -1)]
        bad = F.coalesce(F.lit(False) | words[0].isin(BAD_TOKENS), F.lit(False))
        for w in words[1:]:
            bad = bad | F.coalesce(w.isin(BAD_TOKENS), F.lit(False))
        ends = F.concat_ws(" ", *words).rlike(r"^[^;!?.]*[;!?.]$") & (F.col("y") == "</S>")
        out += [bad.alias(f"bad_{k}"), (bad & ~F.coalesce(ends, F.lit(False))).alias(f"kbad_{k}")]
    return out


def features(pos: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Positions (y, x4..x1, further columns) with all counts. Nine equi-joins; a context longer than the sentence joins nothing."""
    out = pos
    for kind in ("x", "y"):
        for k in range(1, 5 if kind == "x" else 6):
            table = stats[f"{kind}{k}"]
            words = [f"x{j}" for j in range(k, 0, -1)] if kind == "x" else [*(f"x{j}" for j in range(k - 1, 0, -1)), "y"]
            named = table.select(*(F.col(f"c{i + 1}").alias(f"_{w}") for i, w in enumerate(words)), *(c for c in table.columns if not c.startswith("c")))
            on = [F.col(w) == F.col(f"_{w}") for w in words]
            out = out.join(named, on, "left").drop(*(f"_{w}" for w in words))
    counts = [c for t in stats.values() for c in t.columns if "_" in c]
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts]
    return out.select(*pos.columns, *zero, *bad_contexts()).crossJoin(F.broadcast(stats["totals"]))
