"""Smoothed language models as layers of SQL expressions over feature rows (see ``features``).

A model is a list of layers (name, expression); each may use the names before it. ``p1``..``p5`` are the
probabilities of orders 1 to 5, ``b1``..``b4`` those of a back-off model. The text is plain SQL: Spark compiles it
into generated code, and tests hold it against a recursive brute force.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published parameters, from order 2 (non-KN) or from index 0 (KN), and constants of the formulas.
DEFAULTS: dict[str, list[float]] = {
    "baseline": [0.12264181, 0.48531058, 0.73285371, 0.8485226],
    "mc": [7.8440119, 6.6305746, 6.9277921, 7.3675802],
    "cdiscount": [0.94934424, 0.99209517],
    "wbdiscount": [],
    "kn": [0.98520067, 0.80424828, 0.99577209, 0.93954335, 0.99953513],
    "kn1": [0.095564851, 0.9851726, 0.99995823, 0.99581479, 0.99992424, 0.99949497],
    "kn3": [0.020662374, 3.1924203, 0.95571439, 3.2104425, 0.99992424, 4.8814022, 0.9999869, 6.8346343],
    "kn4": [0.119330390707, 3.192501, 0.156310135, 2.8096546125, 0.205351523914, 3.23767800788, 0.238121750327, 3.58515159429],
    "knmod": [0.05880943795777517957, 3.192501, 1.3022398, 2.9146123, 2.0386943, 3.4570501, 2.4608205, 3.9005968],
    "gbits": [28.11096928644257128068, 33.98733562666299928484, 39.16948427744310745367, 39.81172633310000762, 0.85948550385118495566, 0.96034527604501211555, 0.99565930386648919162],
}
WB_CONSTANT = 7
REFERENCE_NGRAM_THRESHOLD = 40
INFINITE_BITS = 1e9
MODELS = list(DEFAULTS)
KN_MODELS = ["kn", "kn1", "kn3", "kn4", "knmod"]
#: highest order with counts of its own; above it these models repeat the order below
TOP_ORDER = {"cdiscount": 3, "kn": 4, "kn1": 4}


def _d(x: float) -> str:
    return f"cast({x!r} as double)"


def _or_one(e: str) -> str:
    return f"(case when {e} = 0 then cast(1 as double) else {e} end)"


def _less(count: str, by: str) -> str:
    """A count with a discount, if there is one."""
    return f"(case when {count} <> 0 then {count} - {by} else cast(0 as double) end)"


def _unigram(unseen: float) -> tuple[str, str]:
    return "p1", f"(case when y0_1 = 0 then {_d(unseen)} else cast(y0_1 as double) end) / t0"


def _first_backoff(pseudo: bool) -> tuple[str, str]:
    return "b1", f"(case when l1_1 = 0 then {_d(1.0 if pseudo else 0.0)} else cast(l1_1 as double) end) / t1"


def _simple(name: str, params: list[float], threshold: int, unseen: float) -> list[tuple[str, str]]:
    out = [_unigram(unseen)]
    for n in range(2, 6):
        k, p = n - 1, f"p{n - 1}"
        lost = f"(x0_{k} - r0_{k})"
        if name == "mc":
            e = _or_one(f"({_d(params[n - 2])} * {lost})")
            made = f"(y0_{n} + {p} * {e}) / (r0_{k} + {e})"
        elif name == "baseline":
            c = _d(params[n - 2])
            made = f"{c} * {p} + (case when r0_{k} > 0 then (1 - {c}) * y0_{n} / r0_{k} else cast(0 as double) end)"
        elif name == "cdiscount":
            made = p
            if n <= TOP_ORDER["cdiscount"]:
                d = _d(threshold * params[n - 2])
                made = f"(case when r0_{k} = 0 then {p} else {_less(f'y0_{n}', d)} / r0_{k} + {p} * {d} * r1_{k} / r0_{k} end)"
        else:
            w = f"cast(r1_{k} + {WB_CONSTANT} * {lost} as double)"
            made = f"(case when r0_{k} = 0 then {p} else (1 - {w} / ({w} + r0_{k})) * y0_{n} / r0_{k} + {w} / ({w} + r0_{k}) * {p} end)"
        out.append((f"p{n}", f"case when x{k} is null or x0_{k} = 0 or bad_{k} then {p} else {made} end"))
    return out


def _kneser_ney(name: str, params: list[float], threshold: int, unseen: float, pseudo: bool) -> list[tuple[str, str]]:
    out = [_unigram(unseen), _first_backoff(pseudo)]
    least = 1.0 / threshold
    if name in ("kn1", "kn3"):
        coef = (params[0] + 1) / (params[0] + threshold)
    else:
        coef = max(params[0], least)
    for n in range(2, 5):  # back-off orders
        k, b = n - 1, f"b{n - 1}"
        if name == "kn":
            ctx, hit = f"cast(m1_{k} as double)", f"cast(l1_{n} as double)"
        else:
            ctx = f"(m1_{k} + {_d(coef)} * (r0_{k} - m0_{k}))"
            hit = f"(l1_{n} + {_d(coef)} * (y0_{n} - l0_{n}))"
        slot = (2 * n - 3) if name == "kn" else (2 * n - 2)
        if slot >= len(params):
            made = b
        elif name == "kn":
            d = _d(params[slot])
            made = f"{_less(hit, d)} / {ctx} + {b} * m2_{k} * {d} / {ctx}"
        elif name in ("kn1", "kn3"):
            d = _d(params[slot])
            made = f"{_less(hit, d)} / {ctx} + {b} * r1_{k} * {d} / {ctx}"
        elif name == "kn4":
            e = _or_one(f"({_d(params[slot])} * (x0_{k} - r0_{k}))")
            made = f"{hit} / ({e} + {ctx}) + {b} * {e} / ({e} + {ctx})"
        else:
            m = f"({_d(params[slot])} * (r1_{k} + {_d(least)} * (x0_{k} - r0_{k})))"
            made = f"{_less(hit, '1')} / ({m} + {ctx}) + {b} * ({m} + r1_{k}) / ({m} + {ctx})"
        out.append((f"b{n}", f"case when x{k} is null or {ctx} = 0 or kbad_{k} then {b} else {made} end"))
    for n in range(2, 6):
        k, p, b = n - 1, f"p{n - 1}", f"b{n - 1}"
        plain = name in ("kn", "kn1")
        skip = f"x{k} is null or x0_{k} = 0" + (f" or r0_{k} = 0" if plain else "") + f" or kbad_{k}"
        if n > TOP_ORDER.get(name, 5):
            out.append((f"p{n}", p))
            continue
        if plain:
            d = _d(threshold * params[2 * n - 4 if name == "kn" else 2 * n - 3])
            made = f"{_less(f'y0_{n}', d)} / r0_{k} + {b} * r1_{k} * {d} / r0_{k}"
        else:
            e = _or_one(f"({_d(params[2 * n - 3])} * (x0_{k} - r0_{k}))")
            made = f"(y0_{n} + {b} * {e}) / (r0_{k} + {e})"
        out.append((f"p{n}", f"case when {skip} then {p} else {made} end"))
    return out


def _legacy(params: list[float], threshold: int, unseen: float, pseudo: bool) -> list[tuple[str, str]]:
    """The older Kneser-Ney model; its discounts were fitted at a threshold of 40 and scale with it."""
    out = [_unigram(unseen), _first_backoff(pseudo)]
    scale = threshold / REFERENCE_NGRAM_THRESHOLD
    for n in range(2, 5):
        k, b, d = n - 1, f"b{n - 1}", _d(params[4 + n - 2])
        made = f"{_less(f'cast(l1_{n} as double)', d)} / m1_{k} + {d} * r1_{k} / m1_{k} * {b}"
        out.append((f"b{n}", f"case when x{k} is null or m1_{k} = 0 then {b} else {made} end"))
    for n in range(2, 6):
        k, d = n - 1, _d(params[n - 2] * scale)
        made = f"{_less(f'cast(y0_{n} as double)', d)} / x0_{k} + ({d} * r1_{k} + x0_{k} - r0_{k}) / x0_{k} * b{k}"
        out.append((f"p{n}", f"case when x{k} is null or x0_{k} = 0 or bad_{k} then p{n - 1} else {made} end"))
    return out


def layers(model: str, params: list[float] | None = None, ngram_threshold: int = REFERENCE_NGRAM_THRESHOLD, token_threshold: int = 200, pseudo_counts: bool = True) -> list[tuple[str, str]]:
    """The layers of a model. ``pseudo_counts``: words without left neighbours, and unseen words, get a share of their own
    (half the token threshold, and one neighbour); off, the probabilities of a context add up to one."""
    given = list(DEFAULTS[model] if params is None else params)
    unseen = token_threshold / 2 if pseudo_counts else 0.0
    if model == "gbits":
        return _legacy(given, ngram_threshold, unseen, pseudo_counts)
    if model in KN_MODELS:
        return _kneser_ney(model, given, ngram_threshold, unseen, pseudo_counts)
    return _simple(model, given, ngram_threshold, unseen)


def bits(p: str) -> str:
    return f"case when {p} > 0 then -log2({p}) else {_d(INFINITE_BITS)} end"


def prefixed(steps: list[tuple[str, str]], prefix: str) -> list[tuple[str, str]]:
    """The layers under other names, so that several models stand side by side."""
    names = {n for n, _ in steps}
    return [(prefix + n, re.sub(r"\b([pb][1-5])\b", lambda m: prefix + m[1] if m[1] in names else m[1], t)) for n, t in steps]


_LITERAL = re.compile(r"cast\((-?[0-9.]+(?:e[-+]?[0-9]+)?) as double\)")


def with_columns_for_constants(steps: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[float]]:
    """The layers with columns c0, c1, ... in place of their constants, and the constants: layers of one model differ in them alone."""
    found: list[float] = []

    def column(m: re.Match) -> str:
        found.append(float(m[1]))
        return f"c{len(found) - 1}"

    return [(n, _LITERAL.sub(column, t)) for n, t in steps], found


def apply_layers(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Each layer as a projection of its own, so that shared values are computed once."""
    for name, text in steps:
        df = df.select("*", F.expr(text).alias(name))
    return df


def layers_sql(source: str, steps: list[tuple[str, str]]) -> str:
    """The same as nested SELECTs."""
    for name, text in steps:
        source = f"(select *, {text} as {name} from {source})"
    return source
