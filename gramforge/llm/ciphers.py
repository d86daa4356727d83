"""Ciphers learned from an open start: which letter stands behind each symbol, where no code table says so.

Two kinds of evidence are summed over all tokens that no known source explains:

* tokens that differ from a far more frequent word of the same shape (its characters within ASCII) in their symbols
  only give aligned pairs of symbol and letter; each token is held against one word, so nothing grows with the size of a shape;
* tokens wholly beyond ASCII have no shape. The bigrams (and the pairs of characters one apart) of those that the language model finds
  improbable are the text of a substitution cipher, solved by expectation-maximization against the
  bigrams of the language: N(ab) symbol bigrams are made by hidden letter bigrams, p(ab) = sum_ij p(ij) q(a|i) q(b|j), and
  q starts from noise. It needs only these sums, which are bounded by the square of the alphabet, whatever the data.

Up to ``LETTERS`` letters are kept behind a symbol with their probabilities; the bigrams and the words in use choose among them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: letters kept behind a symbol, readings kept of a token
LETTERS, READINGS = 3, 8
#: how much more frequent a word must be to be what a token of its shape was; tokens that a symbol's letter rests on, at least
TIMES, LEAST_PAIRS = 4, 4
#: symbols of such evidence that make a cipher
LEAST_SYMBOLS = 3
#: share of a symbol's tokens that must have such a word
PAIRED = 0.5
#: nats by which the mean joint bigram of a token must lie below that of tokens beyond ASCII to be a cipher's text
IMPROBABLE = 1.5
#: distinct tokens of such text that a cipher is solved from, at least; noisy starts and rounds of each
LEAST_TEXT, STARTS, EM_ROUNDS = 40, 40, 250
#: of them, how many are made one to one
FINALS = 10
_LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
_STATS = "kind string, name string, value double"
_EDGE = ("\x02", "\x03")


@dataclass(frozen=True)
class Cipher:
    """A learned source: symbols (of one or of several characters) and the letters that each may stand for, with probabilities."""

    name: str
    letters: dict[str, tuple[tuple[str, float], ...]]

    @cached_property
    def symbols(self) -> re.Pattern:
        return re.compile("|".join(re.escape(x) for x in sorted(self.letters, key=len, reverse=True)))

    @cached_property
    def table(self) -> dict[int, str] | None:
        """For ``translate()``, if each symbol is a character with one letter."""
        if all(len(k) == 1 and len(v) == 1 for k, v in self.letters.items()):
            return {ord(k): v[0][0] for k, v in self.letters.items()}
        return None

    def split(self, token: str) -> list[str] | None:
        """A token as symbols and ASCII characters; None if a character beyond ASCII is in no symbol."""
        out: list[str] = []
        at = 0
        for run in _RUN.finditer(token):
            out += token[at : run.start()]
            at = run.start()
            while at < run.end():
                m = self.symbols.match(token, at, run.end())
                if m is None:
                    return None
                out.append(m[0])
                at = m.end()
        out += token[at:]
        return out

    def readings(self, token: str, log_pair: Callable[[str, str], float] | None = None) -> list[tuple[str, float]]:
        """What a token may have been, with the probability that the symbols give it: the best ``READINGS`` by the symbols and a bigram model."""
        if self.table is not None:
            return [(token.translate(self.table), 1.0)] if all(ord(c) < 128 or ord(c) in self.table for c in token) else []
        parts = self.split(token)
        if parts is None:
            return []
        beam: list[tuple[float, float, str]] = [(0.0, 1.0, "")]
        for part in parts:
            some = self.letters.get(part, ((part, 1.0),))
            step = [(s + log(p) + (log_pair(y[-1:] or _EDGE[0], x) if log_pair else 0.0), w * p, y + x) for s, w, y in beam for x, p in some]
            beam = sorted(step, reverse=True)[:READINGS]
        return [(y, w) for _, w, y in beam]

    def weight(self, token: str, y: str) -> float:
        """The probability that the symbols of a token give a reading."""
        return next((w for x, w in self.readings(token) if x == y), 1e-3)


def aligned(token: str, word: str) -> list[tuple[str, str]]:
    """(symbol, letter) where two words of one shape differ: each run beyond ASCII is cut into as many equal parts as the other has letters."""
    out = []
    a, b = _RUN.findall(token), _RUN.findall(word)
    if len(a) != len(b):
        return []
    for r, q in zip(a, b):
        k, rest = divmod(len(r), len(q))
        if rest or not k:
            return []
        out += [(r[i * k : (i + 1) * k], x) for i, x in enumerate(q)]
    return out


def _batch(stats: dict[tuple[str, str], float]) -> pa.RecordBatch:
    keys = list(stats)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([stats[k] for k in keys], pa.float64())], names=["kind", "name", "value"])


def _summed(df: DataFrame, run: Callable[[Iterator[tuple], Callable[[str, str, float], None]], None]) -> dict[str, dict[str, float]]:
    """Statistics that ``run`` adds up over the rows of a table; they are bounded by the alphabet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats: dict[tuple[str, str], float] = {}

        def add(kind: str, name: str, value: float) -> None:
            stats[kind, name] = stats.get((kind, name), 0.0) + value

        for b in batches:
            run(zip(*(c.to_pylist() for c in b.columns)), add)
        yield _batch(stats)

    out: dict[str, dict[str, float]] = {}
    for r in df.mapInArrow(work, _STATS).groupBy("kind", "name").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["kind"], {})[r["name"]] = r["value"]
    return out


def shape_of(token):
    """The characters of a token within ASCII; each run of others is one mark."""
    return F.regexp_replace(token, r"[^\x00-\x7f]+", _LOST)


def _pairs(rows: Iterator[tuple], add: Callable[[str, str, float], None]) -> None:
    for token, count, best, most in rows:
        if best is not None and most >= TIMES * count and (pairs := aligned(token, best)):
            for symbol, letter in pairs:
                if symbol != letter:
                    add("pair", f"{symbol}\t{letter}", 1.0)
                    add("symbol", symbol, 1.0)
            continue
        for run in _RUN.findall(token):  # in use as it is written
            for k in range(1, min(6, len(run)) + 1):
                for i in range(0, len(run) - k + 1, k):
                    add("symbol", run[i : i + k], 1.0)


def from_pairs(stats: dict[str, dict[str, float]]) -> list[Cipher]:
    """Ciphers of symbols of one character and of several, from aligned pairs."""
    by: dict[str, dict[str, float]] = {}
    for name, v in stats.get("pair", {}).items():
        symbol, letter = name.split("\t")
        by.setdefault(symbol, {})[letter] = v
    out = []
    for name, kind in (("single characters", lambda s: len(s) == 1), ("several characters", lambda s: len(s) > 1)):
        letters, weak = {}, {}
        for symbol, m in by.items():
            total = sum(m.values())
            ranked = sorted(m.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]
            kept = [(x, v) for x, v in ranked if v >= 0.1 * total]
            one = tuple((x, v / sum(w for _, w in kept)) for x, v in kept)
            if kind(symbol) and ranked[0][1] >= LEAST_PAIRS and total >= PAIRED * stats["symbol"][symbol]:
                letters[symbol] = one
            elif kind(symbol) and ranked[0][1] >= 2 and ranked[0][1] >= 0.6 * total:
                weak[symbol] = one
        if len(letters) >= LEAST_SYMBOLS:  # only a cipher that stands without them may say what little-used symbols are, or letters in use
            out.append(Cipher(f"learned, {name}", letters | weak))
    return out


def solve_bigrams(text: list[dict[tuple[str, str], float]], language: list[dict[tuple[str, str], float]], starts: int = STARTS, rounds: int = EM_ROUNDS) -> tuple[float, dict[str, tuple[tuple[str, float], ...]]]:
    """The letters behind symbols, from bigrams of a cipher's text and of the language; several pairs of tables (distance one, two) add up.

    Returns the mean log likelihood of a bigram and, for each symbol, up to ``LETTERS`` letters. Of several noisy starts the likeliest counts.
    """
    symbols = sorted({c for t in text for p in t for c in p} - {*_EDGE})
    letters = sorted({c for t in language for p in t for c in p} - {*_EDGE})
    if not symbols or not letters:
        return -np.inf, {}
    si = {c: i for i, c in enumerate([*_EDGE, *symbols])}
    li = {c: i for i, c in enumerate([*_EDGE, *letters])}
    n, p = [], []
    for t, m in zip(text, language):
        a, b = np.zeros((len(si), len(si))), np.zeros((len(li), len(li)))
        for (x, y), v in t.items():
            a[si[x], si[y]] += v
        for (x, y), v in m.items():
            b[li[x], li[y]] += v
        one = np.outer(b.sum(1), b.sum(0)) / max(b.sum(), 1e-9)
        b = b + 0.5 * one / max(one.max(), 1e-9) + 1e-3
        n.append(a)
        p.append(b / b.sum())
    r = np.random.default_rng(20)
    ends: list[tuple[float, np.ndarray]] = []
    free = slice(2, None)
    for _ in range(starts):
        q = np.zeros((len(si), len(li)))
        q[0, 0] = q[1, 1] = 1.0
        q[free, free] = r.dirichlet(np.full(len(symbols), 3.0), len(letters)).T
        score = -np.inf
        for k in range(rounds):
            c, like = np.zeros_like(q), 0.0
            for a, b in zip(n, p):
                made = q @ b @ q.T + 1e-12
                g = a / made
                c += q * (g @ q @ b.T + g.T @ q @ b)
                like += float((a * np.log(made)).sum())
            # a letter has one symbol and a symbol one letter: both ways are normalized, more sharply as the rounds go on
            c = c[free, free] + 1e-6
            both = c / c.sum(0, keepdims=True) * (c / c.sum(1, keepdims=True)) ** min(1.0, 2 * k / rounds)
            q[free, free] = both / both.sum(0, keepdims=True)
            if k % 20 == 19 and like - score < 1e-6 * abs(like):
                break
            score = like
        ends.append((score, c))
    ends.sort(key=lambda x: -x[0])
    like, one = max(_one_to_one(c, n, p) for _, c in ends[:FINALS])
    mean = like / max(1.0, sum(float(a.sum()) for a in n))
    return mean, {s: ((letters[j], 1.0),) for s, j in zip(symbols, one) if j < len(letters)}


def _one_to_one(c: np.ndarray, n: list[np.ndarray], p: list[np.ndarray]) -> tuple[float, list[int]]:
    """The log likelihood, and a letter for each symbol, no letter twice, from expected counts: the surest first, then exchanges while they make the text likelier.

    Numbers beyond the letters stand for none.
    """
    size, known = c.shape
    logs = []
    for b in p:
        wide = np.full((2 + known + size, 2 + known + size), np.log(b.min() * 0.1))
        wide[: 2 + known, : 2 + known] = np.log(b)
        logs.append(wide)
    pick = np.arange(2 + size)
    pick[2:] = -1
    free = set(range(known))
    for at in np.argsort(-c, axis=None):
        i, j = divmod(int(at), known)
        if pick[2 + i] < 0 and j in free:
            pick[2 + i] = 2 + j
            free.remove(j)
    spare = iter(range(2 + known, 2 + known + size))
    pick = np.array([x if x >= 0 else next(spare) for x in pick])
    used = set(pick.tolist())
    rest = [*(2 + j for j in range(known) if 2 + j not in used)]

    def part(at: list[int], pick: np.ndarray) -> float:
        """What the rows and columns of some symbols add to the log likelihood."""
        out = 0.0
        for a, b in zip(n, logs):
            for i in at:
                out += a[i] @ b[pick[i], pick] + a[:, i] @ b[pick, pick[i]] - a[i, i] * b[pick[i], pick[i]]
            if len(at) == 2:
                i, j = at
                out -= a[i, j] * b[pick[i], pick[j]] + a[j, i] * b[pick[j], pick[i]]
        return out

    better = True
    while better:
        better = False
        for i in range(2, 2 + size):
            for j in range(i + 1, 2 + size):
                other = pick.copy()
                other[i], other[j] = pick[j], pick[i]
                if part([i, j], other) > part([i, j], pick) + 1e-9:
                    pick, better = other, True
            for k, letter in enumerate(rest):
                other = pick.copy()
                other[i] = letter
                if part([i], other) > part([i], pick) + 1e-9:
                    rest[k] = int(pick[i])
                    pick, better = other, True
    return sum(float((a * b[np.ix_(pick, pick)]).sum()) for a, b in zip(n, logs)), [int(x) - 2 for x in pick[2:]]


def _block(c: str) -> int:
    return ord(c) >> 8


def _apart(token: str, k: int) -> list[tuple[str, str]]:
    full = _EDGE[0] + token + _EDGE[1]
    return [(full[i], full[i + k]) for i in range(len(full) - k)]


def from_text(odd: DataFrame, rarity: Callable[[str, int], float]) -> list[Cipher]:
    """Ciphers of whole words, from the bigrams of tokens (token, count) wholly beyond ASCII. ``rarity``: the mean log of a token's joint bigrams."""
    whole = odd.where(F.col("token").rlike(r"^[^\x00-\x7f]{3,}$")).select("token", "count")

    def level(rows: Iterator[tuple], add: Callable[[str, str, float], None]) -> None:
        for token, count in rows:
            add("n", "", log(1.0 + count))
            add("d", "", rarity(token, count) * log(1.0 + count))

    first = _summed(whole, level)
    if not first.get("n"):
        return []
    cut = first["d"][""] / first["n"][""] - IMPROBABLE

    def split(rows: Iterator[tuple], add: Callable[[str, str, float], None]) -> None:
        for token, count in rows:
            strange = rarity(token, count) < cut
            w = 1.0 if strange else log(1.0 + count)
            if strange:
                add("types", "", 1.0)
            for k in (1, 2):
                for a, b in _apart(token, k):
                    same = {_block(x) for x in (a, b) if x not in _EDGE}
                    if strange:
                        add(f"text{k}", a + b, w)
                    elif len(same) == 1:
                        add(f"language{k}:{same.pop()}", a + b, w)

    got = _summed(whole, split)
    if got.get("types", {}).get("", 0) < LEAST_TEXT:
        return []
    tables = lambda kind: [{(x[0], x[1]): v for x, v in got.get(f"{kind[0]}{k}{kind[1]}", {}).items()} for k in (1, 2)]
    text = tables(("text", ""))
    out = []
    for name in sorted(k for k in got if k.startswith("language1:")):
        language = tables(("language", name.removeprefix("language1")))
        if sum(c.isalpha() for c in {c for p in language[0] for c in p}) < 10:
            continue
        _, letters = solve_bigrams(text, language)
        # tokens that make no sense under this mapping were no text of the cipher: it is solved again without them
        table = str.maketrans({k: v[0][0] for k, v in letters.items()})

        def sense(rows: Iterator[tuple], add: Callable[[str, str, float], None], table: dict = table) -> None:
            for token, count in rows:
                if rarity(token, count) < cut and rarity(token.translate(table), 0) >= cut:
                    for k in (1, 2):
                        for a, b in _apart(token, k):
                            add(f"text{k}", a + b, 1.0)
                    add("types", "", 1.0)

        again = _summed(whole, sense) if letters else {}
        if again.get("types", {}).get("", 0) >= LEAST_TEXT:
            _, letters = solve_bigrams([{(x[0], x[1]): v for x, v in again[f"text{k}"].items()} for k in (1, 2)], language)
        if letters:
            out.append(Cipher(f"learned, text of block {int(name.split(':')[1]):#04x}", letters))
    return out


def learn_open(types: DataFrame, rarity: Callable[[str, int], float]) -> list[Cipher]:
    """Ciphers behind tokens (token, count) that no known source explains; whether they hold is judged afterwards, token by token."""
    odd = types.where(F.col("token").rlike(r"[^\x00-\x7f]") & ~F.col("token").contains(_LOST)).select("token", "count", shape_of(F.col("token")).alias("shape"))
    shaped = odd.where(F.length(F.regexp_replace("shape", f"[{_LOST}]", "")) >= 2)
    best = shaped.groupBy("shape").agg(F.max(F.struct("count", "token")).alias("b"))
    pairs = _summed(shaped.join(best, "shape").select("token", "count", F.col("b.token").alias("best"), F.col("b.count").alias("most")), _pairs)
    return from_pairs(pairs) + from_text(odd, rarity)
