"""Wildcard lookup in n-gram tables (n, w1..w5, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.functions.patterns import MAX_ORDER, WILDCARD, has_n2, wildcards
from gramforge.sources.ngram_data import WORDS

KEYS = ["k1", "k2", "k3", "k4", "k5"]
#: patterns are broadcast up to this many (some 20 MB); beyond, both sides are shuffled
BROADCAST_PATTERNS = 200_000


def _masks(patterns: DataFrame) -> dict[int, list[int]]:
    """The masks asked for, by order: at most 62 rows."""
    out: dict[int, list[int]] = {}
    for r in patterns.select("n", "mask").distinct().collect():
        out.setdefault(r["n"], []).append(r["mask"])
    return {n: sorted(m) for n, m in sorted(out.items())}


def masked(ngrams: DataFrame, masks: dict[int, list[int]], extra: list[str]) -> DataFrame:
    """Each n-gram once for each mask of its order: n, mask, k1..k5 (null where wild), last word, cnt, extra columns."""
    if not masks:
        masks = {1: []}
    per_order = F.create_map(*(x for n, ms in masks.items() for x in (F.lit(n), F.array(*(F.lit(m) for m in ms)) if ms else F.array().cast("array<int>"))))
    asked = ngrams.where(F.col("n").isin(list(masks))).withColumn("mask", F.explode(F.try_element_at(per_order, F.col("n"))))
    bit = lambda i: F.shiftrightunsigned(F.col("mask"), 0).bitwiseAND(F.expr(f"shiftleft(1, n - {i + 1})"))
    keys = [F.when((F.lit(i) < F.col("n")) & (bit(i) == 0), F.col(w)).alias(k) for i, (w, k) in enumerate(zip(WORDS, KEYS))]
    last = F.get(F.array(*WORDS), F.col("n") - 1).alias("last")
    return asked.select("n", "mask", *keys, last, "cnt", *extra)


def _few(patterns: DataFrame) -> bool:
    return patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    on = (a["n"] == b["n"]) & (a["mask"] == b["mask"])
    for k, p in zip(KEYS, ("p1", "p2", "p3", "p4", "p5")):
        on = on & a[k].eqNullSafe(b[p])
    return on


def pattern_counts(ngrams: DataFrame, patterns: DataFrame, n2: bool = True, zeroes: bool = False) -> DataFrame:
    """pattern, n0, n1, n2 of parsed patterns.

    n0: occurrences of matching n-grams. n1: distinct matching n-grams (null without a wildcard). n2: their distinct last
    words (null unless two wildcards or more, the last word one). Patterns without a match come out only with ``zeroes``.
    Only the masks asked for are probed, and only n-grams of the orders asked for are read.
    """
    long = masked(ngrams, _masks(patterns), []).withColumn("one", F.lit(1).cast("long"))
    if _few(patterns):
        asked = F.broadcast(patterns)
    else:
        # the keys of many wildcards hold most rows: they are added up by last word before the join
        asked = patterns
        long = long.groupBy("n", "mask", *KEYS, "last").agg(F.sum("cnt").alias("cnt"), F.sum("one").alias("one"))
    hit = long.join(asked, _same_key(long, patterns)).select("pattern", patterns["mask"].alias("pmask"), "cnt", "one", "last")
    found = hit.groupBy("pattern").agg(
        F.sum("cnt").alias("c0"), F.sum("one").alias("c1"), *([F.count_distinct(F.when(has_n2(F.col("pmask")), F.col("last"))).alias("c2")] if n2 else [])
    )
    out = patterns.select("pattern", "mask").join(found, "pattern", "left" if zeroes else "inner")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = ["pattern", zero("c0").alias("n0"), F.when(wildcards(F.col("mask")) > 0, zero("c1")).alias("n1")]
    if n2:
        cols.append(F.when(has_n2(F.col("mask")), zero("c2")).alias("n2"))
    return out.select(*cols)


def matching_ngrams(ngrams: DataFrame, patterns: DataFrame, with_exact: bool = False) -> DataFrame:
    """n, w1..w5, cnt of n-grams that match a pattern which isn't all wildcards, each once.

    Those that are themselves asked for as exact patterns are left out, unless ``with_exact``.
    """
    some = patterns.where(F.col("mask") < F.expr("shiftleft(1, n) - 1"))
    asked = some if with_exact else some.where("mask > 0")
    long = masked(ngrams, _masks(asked), WORDS)
    # beyond the bound, adaptive execution splits the hot keys of a semi-join
    small = F.broadcast(asked) if _few(asked) else asked
    kept = long.join(small, _same_key(long, asked), "left_semi").select("n", *WORDS, "cnt").distinct()
    if with_exact:
        return kept
    exact = patterns.where("mask = 0")
    on = kept["n"] == exact["n"]
    for w, p in zip(WORDS, ("p1", "p2", "p3", "p4", "p5")):
        on = on & kept[w].eqNullSafe(exact[p])
    return kept.join(exact, on, "left_anti")


def cube_counts(ngrams: DataFrame, n: int, masks: list[int] | None = None) -> DataFrame:
    """Every pattern of an order with one of some masks (all, if none are named: 2^n rows an n-gram): w1..wn (null where wild), mask, n0, n1, n2.

    With masks named, only those are expanded: name them for the orders 4 and 5 of large tables.
    """
    w = WORDS[:n]
    if masks is not None:
        long = masked(ngrams, {n: sorted(masks)}, [])
        keys = [F.col(k).alias(x) for k, x in zip(KEYS, w)]
        counted = long.groupBy("mask", *keys).agg(F.sum("cnt").alias("n0"), F.count("*").alias("n1"), F.count_distinct(F.when(has_n2(F.col("mask")), F.col("last"))).alias("d"))
        return counted.select(*w, "mask", "n0", F.when(F.col("mask") > 0, F.col("n1")).alias("n1"), F.when(has_n2(F.col("mask")), F.col("d")).alias("n2"))
    copy = ngrams.where(F.col("n") == n).select(*w, "cnt", F.col(w[-1]).alias("last"))
    cube = copy.cube(*w).agg(F.grouping_id().cast("int").alias("mask"), F.sum("cnt").alias("n0"), F.count("*").alias("n1"), F.count_distinct("last").alias("d"))
    return cube.select(*w, "mask", "n0", F.when(F.col("mask") > 0, F.col("n1")).alias("n1"), F.when(has_n2(F.col("mask")), F.col("d")).alias("n2"))


def allwild_totals(ngrams: DataFrame) -> DataFrame:
    """n, n0, n1, n2 of the patterns of wildcards only (n2 from order 2 on)."""
    last = F.get(F.array(*WORDS), F.col("n") - 1)
    return ngrams.groupBy("n").agg(F.sum("cnt").alias("n0"), F.count("*").alias("n1"), F.count_distinct(F.when(F.col("n") > 1, last)).alias("d")).select("n", "n0", "n1", F.when(F.col("n") > 1, F.col("d")).alias("n2"))


def lookup(ngrams: DataFrame, pattern: str) -> DataFrame:
    """n-grams that match one pattern. Fixed words become equality filters, which reach the scan and its row-group statistics."""
    tokens = pattern.split()
    if not 1 <= len(tokens) <= MAX_ORDER:
        raise ValueError(f"a pattern has 1 to {MAX_ORDER} tokens: {pattern!r}")
    out = ngrams.where(F.col("n") == len(tokens))
    for w, t in zip(WORDS, tokens):
        if t != WILDCARD:
            out = out.where(F.col(w) == t)
    return out


def lookup_sorted(by_first: DataFrame, by_second: DataFrame, pattern: str) -> DataFrame:
    """``lookup`` in whichever sorted copy serves the pattern: the second if only the first word is wild."""
    tokens = pattern.split()
    second = len(tokens) > 1 and tokens[0] == WILDCARD and tokens[1] != WILDCARD
    return lookup(by_second if second else by_first, pattern)


def top_completions(ngrams: DataFrame, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams of each context of n - 1 words: context, word, cnt, rank (ties by word)."""
    context = F.concat_ws(" ", *WORDS[: n - 1])
    rows = ngrams.where(F.col("n") == n).select(context.alias("context"), F.col(WORDS[n - 1]).alias("word"), "cnt")
    rank = F.row_number().over(Window.partitionBy("context").orderBy(F.desc("cnt"), "word"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def route_files(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, fnum: the files (of the first sort order) that can hold a pattern whose first word is fixed, by their first entries."""
    w = Window.partitionBy("n").orderBy("first_ngram", "fnum")
    files = index.where("sortkey = 1 and first_ngram is not null").select("n", "fnum", "first_ngram", F.lead("first_ngram").over(w).alias("next_ngram"))
    fixed = patterns.where("p1 is not null and n > 1").select("pattern", F.col("n").alias("pn"), "p1")
    low, high = F.concat("p1", F.lit(" ")), F.concat("p1", F.lit("!"))  # "!" follows the space
    inside = (F.col("n") == F.col("pn")) & (F.col("first_ngram") < high) & (F.col("next_ngram").isNull() | (F.col("next_ngram") >= low))
    return fixed.join(files, inside).select("pattern", "fnum")
