"""Parameter optimization and normalization checks.

The objective is bits per word over a written table of the counts that the model uses, equal ones added up. One Spark job evaluates several points
at once, so that a round of trial moves costs one pass over the data; the points are rows that are joined with the counts, so that
the generated code is the same for all of them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.plans.smoothing import DEFAULTS, KN_MODELS, apply_layers, bits, layers, prefixed, with_columns_for_constants
from gramforge.session import materialize

Point = list[float]
Objective = Callable[[Sequence[Point]], list[float]]
OUT_OF_RANGE = 1e9
EPSILON = 1e-6


#: models without parameters to optimize
FIXED = ["wbdiscount", "gbits"]


def dimensions(model: str, order: int) -> int:
    if model in FIXED:
        raise ValueError(f"{model} has no parameters to optimize")
    if model == "kn":
        return 2 * order - 3
    return 2 * order - 2 if model in KN_MODELS else order - 1


def start(model: str, order: int, kind: str = "default", seed: int = 0) -> Point:
    """A starting point: "default", "zeroes" (ones for the KN family) or "random" (up to 10 for mc)."""
    n = dimensions(model, order)
    if kind == "zeroes":
        return [1.0 if model in KN_MODELS else 0.0] * n
    if kind == "random":
        r = random.Random(seed)
        return [r.random() * (10 if model == "mc" else 1) for _ in range(n)]
    given = DEFAULTS[model]
    return (given + given[-1:] * n)[:n]


def admissible(model: str, x: Point, threshold: int) -> Point | None:
    """The point, clamped where the model clamps, or None outside its domain."""
    if model == "mc":
        return [max(0.0, v) for v in x]
    if model == "baseline":
        return [min(1 - EPSILON, max(EPSILON, v)) for v in x]
    if any(v < 0 for v in x):
        return None
    if model in ("cdiscount", "kn") and any(v > 1 for v in x):
        return None
    if model == "kn1" and any(v > 1 for v in x[1:]):
        return None
    if model == "kn3" and any(v > 1 for v in x[2::2]):
        return None
    if model in ("kn4", "knmod") and not 1 / threshold <= x[0] <= 1:
        return None
    return x


def objective(feats: DataFrame, model: str, order: int, ngram_threshold: int, token_threshold: int) -> Objective:
    """Bits per word at ``order`` of each of some points; out of range 1e9."""
    at = lambda p: with_columns_for_constants(layers(model, _padded(model, p), ngram_threshold, token_threshold))
    steps, _ = at(start(model, order))
    steps = steps[: next(i for i, (n, _) in enumerate(steps) if n == f"p{order}") + 1]
    used = set(re.findall(r"\w+", " ".join(t for _, t in steps)))
    # of a context word the layers only ask whether there is one
    cols = [(F.when(F.col(c).isNotNull(), F.lit("x")).alias(c) if re.fullmatch("x[1-4]", c) else F.col(c)) for c in feats.columns if c in used and c != "times"]
    rows = materialize(feats.select(*cols, "times").groupBy(*(c for c in feats.columns if c in used and c != "times")).agg(F.sum("times").alias("times")), "objective")
    spark = feats.sparkSession

    def value(points: Sequence[Point]) -> list[float]:
        inside = [admissible(model, list(p), ngram_threshold) for p in points]
        todo = [(i, *at(p)[1]) for i, p in enumerate(inside) if p is not None]
        out = [OUT_OF_RANGE] * len(points)
        if todo:
            table = spark.createDataFrame(todo, ", ".join(["point int", *(f"c{j} double" for j in range(len(todo[0]) - 1))]))
            scored = apply_layers(rows.crossJoin(F.broadcast(table)), steps)
            mean = F.try_divide(F.sum(F.expr(bits(f"p{order}")) * F.col("times")), F.sum("times"))
            for r in scored.groupBy("point").agg(mean.alias("r")).collect():
                if r["r"] is not None:
                    out[r["point"]] = r["r"]
        return out

    return value


def _padded(model: str, p: Point) -> Point:
    """Slots beyond the optimized order keep their published values."""
    return [*p, *DEFAULTS[model][len(p) :]]


def hill_climb(f: Objective, x: Point, step: float = 0.1, least: float = 1e-4, rounds: int = 1_000_000, gain: float = 1e-9) -> tuple[Point, float]:
    """Pattern search: all single moves of a round, by ``step`` and by quarters of it down to ``least``, are tried in one job; the best improvements
    are combined and, while that helps, repeated in the same direction. It ends where no move improves by ``gain``."""
    best = f([x])[0]
    for _ in range(rounds):
        sizes = [step / 4**k for k in range(40) if step / 4**k > least] + [least]
        moves = [(i, s) for i in range(len(x)) for size in sizes for s in (size, -size)]
        tried = f([[v + (s if j == i else 0) for j, v in enumerate(x)] for i, s in moves])
        gains: dict[int, tuple[float, float]] = {}
        for (i, s), v in zip(moves, tried):
            if v < best - gain and (i not in gains or v < gains[i][0]):
                gains[i] = (v, s)
        if not gains:
            break
        leader = min(gains, key=lambda i: gains[i][0])
        direction = [gains[i][1] if i in gains else 0.0 for i in range(len(x))]
        single = [gains[leader][1] if i == leader else 0.0 for i in range(len(x))]
        lines = [[v + d * m for v, d in zip(x, way)] for way in (direction, single) for m in (0.5, 1, 2, 4, 8)]
        values = f(lines)
        k = min(range(len(lines)), key=lambda i: values[i])
        x, best = lines[k], values[k]
        if k % 5 == 4:
            step *= 2
    return x, best


def simplex(f: Objective, x: Point, size: float = 1.0, least: float = 1e-4, rounds: int = 1_000_000) -> tuple[Point, float]:
    """Nelder-Mead, until the simplex is smaller than ``least``."""
    n = len(x)
    points = [list(x)] + [[v + (size if j == i else 0) for j, v in enumerate(x)] for i in range(n)]
    ranked = sorted(zip(f(points), points))
    for _ in range(rounds):
        if max(max(abs(a - b) for a, b in zip(p, ranked[0][1])) for _, p in ranked) < least:
            break
        worst_value, worst = ranked[-1]
        centre = [sum(p[i] for _, p in ranked[:-1]) / n for i in range(n)]
        at = lambda t: [c + t * (c - w) for c, w in zip(centre, worst)]
        trial = [at(1.0), at(2.0), at(0.5), at(-0.5)]  # reflected, expanded, contracted outside and inside: one job
        values = f(trial)
        if values[0] < ranked[0][0]:
            new = min((values[1], trial[1]), (values[0], trial[0]))
        elif values[0] < ranked[-2][0]:
            new = (values[0], trial[0])
        else:
            new = min((values[2], trial[2]), (values[3], trial[3]))
            if new[0] >= worst_value:
                top = ranked[0][1]
                points = [[a + (b - a) / 2 for a, b in zip(top, p)] for _, p in ranked[1:]]
                ranked = sorted([ranked[0], *zip(f(points), points)])
                continue
        ranked = sorted([*ranked[:-1], new])
    return ranked[0][1], ranked[0][0]


def normalization(contexts: DataFrame, vocab: DataFrame, stats: dict[str, DataFrame], models: list[str], ngram_threshold: int, token_threshold: int) -> DataFrame:
    """model and, for each context (x4..x1; null before a sentence's begin), the sum of the probabilities of all words of the vocabulary at each order, without pseudo-counts.

    The contexts are a stated set of bounded size, each held against the whole vocabulary; their features are made once for all models.
    """
    from gramforge.plans.features import CONTEXT, features

    pos = vocab.select(F.col("w1").alias("y")).crossJoin(F.broadcast(contexts.select(*CONTEXT)))
    scored, sums = features(pos, stats), []
    for m in models:
        scored = apply_layers(scored, prefixed(layers(m, None, ngram_threshold, token_threshold, pseudo_counts=False), f"{m}_"))
        sums += [F.sum(f"{m}_p{n}").alias(f"{m}_{n}") for n in range(1, 6)]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), *(F.col(f"{m}_{n}").alias(f"sum_{n}") for n in range(1, 6))) for m in models))).alias("e")
    return scored.groupBy(*CONTEXT).agg(*sums).select(*CONTEXT, each).select("e.model", *CONTEXT, *(f"e.sum_{n}" for n in range(1, 6)))
