"""Text read in a wrong encoding: code-page swaps as substitution ciphers, solved by expectation-maximization.

A swap turns each letter beyond ASCII into one symbol (two single-byte pages) or several (UTF-8 read as a single-byte page); ASCII
stays. Which swaps occur isn't known. A source is a cipher: a mapping from symbols to letters. Pairs of known code pages
are sources whose tables are a prior of ``PRIOR`` words for each symbol; sources that no table covers start open: any letter
of the language may stand behind any symbol (``gramforge.llm.ciphers``).

For a distinct token the E-step weighs "written so" against what each source makes of it, by a bigram model of the
language and by whether that word is in use; the M-step re-estimates how often each source occurs, the letter
behind each symbol (from the words in use that differ from a token in its symbols only), and the bigrams, without what is
held to be damaged. It ends when the shares of the sources settle. Then mappings that differ from a table, and ciphers learned from what no source explains, become
sources of their own, and the rounds begin again, until no new source explains anything.
Statistics are summed over all tokens by Spark; only they (sources, symbols, bigrams) reach the driver.

The learned mappings decipher tokens by ``translate`` (symbol by symbol).
U+FFFD stands for bytes that were lost; it is restored where just one known word fits best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, lgamma, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.ciphers import Cipher, learn_open, shape_of
from gramforge.llm.records import terms_of
from gramforge.session import materialize, shuffle_partitions

#: code pages (fixed values: names of Python's codecs)
PAGES = ["cp1252", "latin-1", "iso8859-2", "cp1250", "iso8859-15", "cp1254", "cp1257", "cp1251", "koi8-r", "iso8859-5", "cp866", "cp1253", "iso8859-7", "cp437", "cp850", "cp852", "mac_roman"]
#: rounds end when less than this part of all shares moves; a bound for data on which they would not settle
SETTLED, ROUNDS = 0.02, 30
#: words that a code table is worth, for the letter behind one of its symbols
PRIOR = 3.0
#: distinct tokens that a learned source must explain to be kept
LEAST_TOKENS = 10
LOST = "�"
#: share of the tokens beyond ASCII that come from a source before anything is learned, and least share later
FIRST_SHARE, LEAST_SHARE = 1e-4, 1e-7
#: tokens beyond ASCII that speak against damage before any is seen: in a few tokens no share is learned
FEW = 1000.0
#: dispersion of how often a word meets a source
SPREAD = 0.5
#: log probability that a sign standing alone was written so, at least
SIGN = log(0.01)
#: damage from which on a token is held to be damaged
DECIDE = 0.8
_START, _END = "\x02", "\x03"
_STATS = "kind string, name string, value double"
_SCORED = "token string, damage double, original string, source string"


@lru_cache(maxsize=None)
def _alphabet(page: str) -> tuple[str, ...]:
    """The 256 characters of a page; bytes it doesn't define are C1 controls, as readers commonly do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _bytes_of(page: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_alphabet(page))))}


def sources() -> list[tuple[str, str, int]]:
    """(written in, read in, times): UTF-8 read as a page up to three times, and pairs of single-byte pages."""
    multi = [("utf-8", p, k) for p in PAGES for k in (1, 2, 3)]
    single = [(w, r, 1) for w in PAGES for r in PAGES if w != r]
    return multi + single


@lru_cache(maxsize=None)
def _single(written: str, read: str) -> dict[int, str]:
    """A translate() table from symbols to the letters they stand for."""
    a, b = _alphabet(written), _alphabet(read)
    return {ord(b[k]): a[k] for k in range(128, 256) if a[k] != b[k]}


def _undo_utf8(token: str, read: str) -> str | None:
    known = _bytes_of(read)
    try:
        return bytes(known[c] for c in token).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def decipher(token: str) -> dict[str, list[int]]:
    """What a token may have been, with the sources (indexes of ``sources()``) that say so."""
    out: dict[str, list[int]] = {}
    base = len(PAGES) * 3
    for i, page in enumerate(PAGES):
        y = token
        for k in range(3):
            y = _undo_utf8(y, page)
            if y is None or y == token:
                break
            out.setdefault(y, []).append(i * 3 + k)
            if y.isascii():
                break
    j = base
    high = [c for c in token if ord(c) > 127]
    for w in PAGES:
        for r in PAGES:
            if w == r:
                continue
            table = _single(w, r)
            known = _bytes_of(r)
            if all(c in known for c in high):
                y = token.translate(table)
                if y != token and y.isprintable():
                    out.setdefault(y, []).append(j)
            j += 1
    return out


@dataclass
class Model:
    """What is learned: bigrams of the language, and the share of each source."""

    bigrams: dict[str, float] = field(default_factory=dict)
    #: of ``sources()`` and then of ``ciphers``
    shares: list[float] = field(default_factory=list)
    ciphers: list[Cipher] = field(default_factory=list)
    smooth: float = 2.0

    def __post_init__(self):
        self.shares = self.shares or [FIRST_SHARE] * (len(sources()) + len(self.ciphers))
        self.first: dict[str, float] = {}
        self.single: dict[str, float] = {}
        for pair, v in self.bigrams.items():
            self.first[pair[0]] = self.first.get(pair[0], 0.0) + v
            self.single[pair[1]] = self.single.get(pair[1], 0.0) + v
        self.total = sum(self.single.values())
        self.size = len(self.single) + 5000.0  # characters never seen

    def log_p(self, word: str, own: float = 0.0, among: set[str] | None = None) -> float:
        """Log probability of a word; ``own`` is what a token (the word itself, or one of the bigrams ``among``) has added to the bigrams and is left out."""
        out, a, weight = 0.0, _START, own
        for b in word + _END:
            if among is not None:
                own = weight if a + b in among else 0.0
            one = (max(0.0, self.single.get(b, 0.0) - own) + 0.05) / (self.total + 0.05 * self.size)
            out += log((max(0.0, self.bigrams.get(a + b, 0.0) - own) + self.smooth * one) / (self.first.get(a, 0.0) + self.smooth))
            a = b
        return out

    def log_pair(self, a: str, b: str) -> float:
        return log((self.bigrams.get(a + b, 0.0) + 0.01) / (self.first.get(a, 0.0) + 1.0))

    def rarity(self, token: str, count: int) -> float:
        """The mean log of the joint probabilities of a token's bigrams, without what it adds itself."""
        pairs = _pairs(token)
        own = _weight(count)
        return sum(log((max(0.0, self.bigrams.get(p, 0.0) - own) + 0.05) / (self.total + 1.0)) for p in pairs) / len(pairs)

    def parts(self, token: str, y: str, by: list[int]) -> list[float]:
        """How much each source makes of what ``y`` was, where it occurs at all."""
        known = len(self.shares) - len(self.ciphers)
        return [self.shares[s] * (1.0 if s < known else self.ciphers[s - known].weight(token, y)) for s in by]

    def judge(self, token: str, count: int, options: list[tuple[str, list[int], int]], types: int) -> list[float]:
        """Posterior of "written so" (first) and of each option (what it was, sources, how often that is a token).

        Written so: one of ``types`` words that the bigrams make. From a word in use: a word seen k times is expected
        k * share times in a source's form. From a word not in use: a word that the bigrams make, damaged every time.
        """
        often = -log(count * (count + 1.0))
        same = set(_pairs(token))
        clean = min(0.0, log(types) + self.log_p(token, _weight(count)))
        if len(token) == 1 and not token.isalpha():
            clean = max(clean, SIGN)  # bigrams say nothing about a sign that stands alone
        weights = [clean + often]
        for y, by, seen in options:
            share = min(0.5, sum(self.parts(token, y, by)))
            new = min(0.0, log(types) + self.log_p(y, _weight(count), same)) + often + count * log(share)
            if seen:
                mean = seen * share  # negative binomial, as sources hit words unevenly
                used = lgamma(count + SPREAD) - lgamma(SPREAD) - lgamma(count + 1.0) + SPREAD * log(SPREAD / (SPREAD + mean)) + count * log(mean / (SPREAD + mean))
                new = max(new, used)
            weights.append(new)
        top = max(weights)
        e = [exp(w - top) for w in weights]
        return [x / sum(e) for x in e]


def token_types(texts: DataFrame, column: str = "ngram") -> DataFrame:
    """token, count (records that hold it)."""
    return texts.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(terms_of(F.col(column)))).alias("token")).groupBy("token").agg(F.count("*").alias("count"))


def _stats(df: DataFrame, run, schema_kind: str = _STATS) -> dict[str, dict[str, float]]:
    rows = df.mapInArrow(run, schema_kind).groupBy("kind", "name").agg(F.sum("value").alias("value")).collect()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r["kind"], {})[r["name"]] = r["value"]
    return out


def _stat_batch(stats: dict[tuple[str, str], float]) -> pa.RecordBatch:
    keys = list(stats)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([stats[k] for k in keys], pa.float64())], names=["kind", "name", "value"])


def _pairs(token: str) -> list[str]:
    full = _START + token + _END
    return [full[i : i + 2] for i in range(len(full) - 1)]


def _weight(count: int) -> float:
    return log(1.0 + count)


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stats: dict[tuple[str, str], float] = {}
    for b in batches:
        for token, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if LOST in token:
                continue
            w = _weight(count)
            for p in _pairs(token):
                stats["bigram", p] = stats.get(("bigram", p), 0.0) + w
            stats["types", ""] = stats.get(("types", ""), 0.0) + 1
            if not token.isascii():
                stats["tokens", ""] = stats.get(("tokens", ""), 0.0) + count
    yield _stat_batch(stats)


def _spread(tokens: DataFrame) -> DataFrame:
    """Over all cores, also where it is written and read again: there are few tokens beyond ASCII, but each has many candidates."""
    spark = tokens.sparkSession
    return tokens.repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), "token")


def _odd(types: DataFrame) -> DataFrame:
    """Tokens beyond ASCII without lost letters."""
    return _spread(types.where(F.col("token").rlike(r"[^\x00-\x7f]") & ~F.col("token").contains(LOST)).select("token", "count"))


def _with_uses(made: DataFrame, types: DataFrame) -> DataFrame:
    """token, count, options from (token, count, y, by): how often each candidate is a token itself."""
    seen = types.select(F.col("token").alias("y"), F.col("count").alias("seen"))
    return made.join(seen, "y", "left").groupBy("token", "count").agg(F.collect_list(F.struct("y", "by", F.coalesce("seen", F.lit(0)).alias("seen"))).alias("options"))


_MADE = "token string, count long, y string, `by` array<int>"


def _made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["token", "count", "y", "by"])


def candidates(types: DataFrame) -> DataFrame:
    """Tokens beyond ASCII: token, count, options (what it may have been, by which sources, how often that is a token), anchor.

    The anchor is the most frequent word of the token's shape, null if that is the token itself or within ASCII nothing is left to compare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, c, y, s) for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for y, s in decipher(t).items()]
            if rows:
                yield _made(rows)

    odd = _odd(types)
    options = _with_uses(odd.mapInArrow(run, _MADE), types).withColumn("shape", shape_of(F.col("token")))
    best = odd.withColumn("shape", shape_of(F.col("token"))).where(F.col("shape") != LOST).groupBy("shape").agg(F.max(F.struct("count", "token")).alias("b"))
    anchor = F.when(F.col("b.token") != F.col("token"), F.col("b.token")).alias("anchor")
    return _spread(options.join(best, "shape", "left").select("token", "count", "options", anchor))


def more_candidates(types: DataFrame, options: DataFrame, model: Model, first: int) -> DataFrame:
    """``options`` with what the model's ciphers from number ``first`` on make of each token."""
    sent = types.sparkSession.sparkContext.broadcast((model, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first = sent.value
        base = len(sources())
        for b in batches:
            rows = []
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by: dict[str, list[int]] = {}
                for k, cipher in enumerate(model.ciphers[first:], first):
                    for y, _ in cipher.readings(t, model.log_pair):
                        if y != t and y.isprintable():
                            by.setdefault(y, []).append(base + k)
                rows += [(t, c, y, s) for y, s in by.items()]
            if rows:
                yield _made(rows)

    new = _with_uses(_odd(types).mapInArrow(run, _MADE), types).select("token", "count", F.col("options").alias("new"))
    none = F.array().cast(options.schema["options"].dataType)
    both = options.join(new, ["token", "count"], "full").withColumn("options", F.concat(F.coalesce("options", none), F.coalesce("new", none)))
    return _spread(both.select("token", "count", "options", "anchor"))


def _options(cell) -> list[tuple[str, list[int], int]]:
    """Candidates that tables and ciphers both make count once."""
    out: dict[str, tuple[list[int], int]] = {}
    for o in cell:
        by, _ = out.get(o["y"], ([], 0))
        out[o["y"]] = ([*by, *(s for s in o["by"] if s not in by)], o["seen"])
    return sorted((y, by, seen) for y, (by, seen) in out.items())


@dataclass
class Solved:
    model: Model
    types: int
    #: (source, symbol) -> letters with how many words speak for each, the code table's with PRIOR more
    mapping: dict[tuple[int, str], dict[str, float]]


def _symbols(token: str, original: str, source: tuple[str, str, int]) -> list[tuple[str, str]]:
    """The symbols of a token with the letters that a code table makes of them."""
    if source[0] != "utf-8":
        table = _single(source[0], source[1])
        return [(c, table.get(ord(c), c)) for c in token if ord(c) > 127]
    out = []
    for letter in original:
        if ord(letter) > 127:
            s = letter
            for _ in range(source[2]):
                s = "".join(_alphabet(source[1])[x] for x in s.encode("utf-8"))
            out.append((s, letter))
    return out


def _evidence(token: str, y: str, seen: int, anchor: str | None, source: tuple[str, str, int]) -> list[tuple[str, str]]:
    """(symbol, letter) that words in use say: those of the candidate if it is in use, else those of the token's anchor."""
    symbols = _symbols(token, y, source)
    word = y if seen else anchor
    letters = [c for c in word or "" if ord(c) > 127]
    return [(s, letter) for (s, _), letter in zip(symbols, letters)] if len(letters) == len(symbols) else []


def solve(types: DataFrame, options: DataFrame, ciphers: list[Cipher] | None = None, start: Solved | None = None) -> Solved:
    """Expectation-maximization over all token types, until the shares settle. Both tables are read once a round: hand over written ones."""
    first = _stats(types.select("token", "count"), _count_bigrams)
    everything = first.get("bigram", {})
    tokens = max(1.0, first.get("tokens", {}).get("", 0.0))  # beyond ASCII
    kinds = max(1, int(first.get("types", {}).get("", 0)))
    known, ciphers = sources(), list(ciphers or [])
    model = Model(bigrams=everything, ciphers=ciphers)
    if start is not None:
        model = Model(bigrams=start.model.bigrams, ciphers=ciphers, shares=[*start.model.shares, *[FIRST_SHARE] * (len(known) + len(ciphers) - len(start.model.shares))])
    use: dict[tuple[int, str], dict[str, float]] = {}
    for _ in range(ROUNDS):
        sent = types.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: Model = sent.value
            stats: dict[tuple[str, str], float] = {}

            def add(kind: str, name: str, value: float) -> None:
                stats[kind, name] = stats.get((kind, name), 0.0) + value

            for b in batches:
                for token, count, cell, anchor in zip(*(c.to_pylist() for c in b.columns)):
                    opts = _options(cell)
                    post = model.judge(token, count, opts, kinds)
                    damage = 1 - post[0]
                    if damage > 1e-6:
                        for p in _pairs(token):
                            add("bigram", p, -_weight(count) * damage)
                    for (y, by, seen), p in zip(opts, post[1:]):
                        if p < 1e-6:
                            continue
                        parts = model.parts(token, y, by)
                        whole = sum(parts)
                        for s, part in zip(by, parts):
                            share = p * part / whole
                            add("source", str(s), share * count)
                            if share > 0.01:
                                if s < len(known):
                                    pairs = _evidence(token, y, seen, anchor, known[s])
                                else:
                                    symbols = model.ciphers[s - len(known)].split(token) or []
                                    pairs = [(x, c) for x, c in zip(symbols, y) if ord(c) > 127] if len(symbols) == len(y) else []
                                for symbol, letter in pairs:
                                    add("letter", f"{s}\t{symbol}\t{letter}", share)
            yield _stat_batch(stats)

        got = _stats(options.select("token", "count", "options", "anchor"), expect)
        moved = got.get("bigram", {})
        bigrams = {k: max(0.0, v + moved.get(k, 0.0)) for k, v in everything.items()}
        shares = [max(LEAST_SHARE, got.get("source", {}).get(str(s), 0.0) / (tokens + FEW)) for s in range(len(known) + len(ciphers))]
        use = {}
        for name, v in got.get("letter", {}).items():
            s, symbol, letter = name.split("\t")
            use.setdefault((int(s), symbol), {})[letter] = v
        ciphers = [_again(c, {k[1]: v for k, v in use.items() if k[0] == len(known) + i}) for i, c in enumerate(ciphers)]
        still = sum(abs(a - b) for a, b in zip(shares, model.shares)) <= SETTLED * sum(shares)
        model = Model(bigrams=bigrams, shares=shares, ciphers=ciphers)
        if still:
            break
    for (s, symbol), m in use.items():
        if s < len(known) and (letter := _table_letter(known[s], symbol)) is not None:
            m[letter] = m.get(letter, 0.0) + PRIOR
    return Solved(model, kinds, use)


def _again(c: Cipher, use: dict[str, dict[str, float]]) -> Cipher:
    """A cipher with its letters re-estimated; a symbol without use keeps them."""
    letters = {}
    for symbol, some in c.letters.items():
        m = {x: use.get(symbol, {}).get(x, 0.0) + 0.5 * p for x, p in some}
        letters[symbol] = tuple(sorted(((x, v / sum(m.values())) for x, v in m.items()), key=lambda q: (-q[1], q[0])))
    return Cipher(c.name, letters)


def _table_letter(source: tuple[str, str, int], symbol: str) -> str | None:
    """The letter that a code table has for a symbol."""
    if source[0] != "utf-8":
        return _single(source[0], source[1]).get(ord(symbol), symbol)
    out: str | None = symbol
    for _ in range(source[2]):
        out = _undo_utf8(out, source[1]) if out is not None else None
    return out


def relearned(solved: Solved) -> list[Cipher]:
    """Sources whose words in use speak for other letters than their code table, as ciphers of their own."""
    by: dict[int, dict[str, str]] = {}
    for (s, symbol), m in solved.mapping.items():
        if s < len(sources()) and m and (best := max(m.items(), key=lambda x: (x[1], x[0])))[0] != _table_letter(sources()[s], symbol) and best[1] >= 0.8 * sum(m.values()):
            by.setdefault(s, {})[symbol] = best[0]
    out = []
    for s, other in by.items():
        letters = {k[1]: max(m.items(), key=lambda x: (x[1], x[0]))[0] for k, m in solved.mapping.items() if k[0] == s}
        out.append(Cipher(f"{source_name(sources()[s])}, relearned", {k: ((v, 1.0),) for k, v in letters.items()}))
    return out


def source_name(source: tuple[str, str, int]) -> str:
    return f"{source[0]} read as {source[1]}" + (f" x{source[2]}" if source[2] > 1 else "")


def score(options: DataFrame, solved: Solved) -> DataFrame:
    """token, damage (probability), original, source of each token that is damaged with a probability of at least DECIDE."""
    sent = options.sparkSession.sparkContext.broadcast(solved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved: Solved = sent.value
        model = solved.model
        names = [source_name(x) for x in sources()] + [c.name for c in model.ciphers]
        for b in batches:
            rows = []
            for token, count, cell in zip(*(c.to_pylist() for c in b.columns)):
                opts = _options(cell)
                post = model.judge(token, count, opts, solved.types)
                if 1 - post[0] < DECIDE:
                    continue
                k = max(range(len(opts)), key=lambda i: post[i + 1])
                y, by, _ = opts[k]
                rows.append((token, 1 - post[0], y, names[max(zip(model.parts(token, y, by), by))[1]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), [pa.string(), pa.float64(), pa.string(), pa.string()])], names=["token", "damage", "original", "source"])

    return options.select("token", "count", "options").mapInArrow(run, _SCORED)


def lost_letters(types: DataFrame) -> DataFrame:
    """Tokens with U+FFFD and the known word that fits them best (null if none or several fit alike)."""
    shape = F.regexp_replace("token", r"[^\x00-\x7f]+", LOST)
    broken = types.where(F.col("token").contains(LOST)).select("token", shape.alias("shape"))
    sound = types.where(F.col("token").rlike(r"[^\x00-\x7f]") & ~F.col("token").contains(LOST)).select(F.col("token").alias("word"), shape.alias("shape"), "count")
    best = sound.groupBy("shape").agg(F.max(F.struct("count", "word")).alias("b"), F.sum("count").alias("all")).where(F.col("b.count") * 2 > F.col("all"))
    return broken.join(best, "shape", "left").select("token", F.lit(1.0).alias("damage"), F.col("b.word").alias("original"), F.lit("lost bytes").alias("source"))


@dataclass
class Damage:
    tokens: DataFrame
    solved: Solved


def find_damage(texts: DataFrame, column: str = "ngram") -> Damage:
    """Damaged tokens of a table's text column (see ``score`` and ``lost_letters``), and what was learned."""
    types = materialize(token_types(texts, column), "token-types")
    options = materialize(candidates(types), "cipher-options")
    solved = solve(types, options)
    found = materialize(score(options, solved), "damaged-once")
    ciphers: list[Cipher] = []
    new = relearned(solved)
    while True:
        sent = texts.sparkSession.sparkContext.broadcast(solved.model)
        left = types.join(found.select("token"), "token", "left_anti")
        new += [Cipher(f"{c.name} {len(ciphers) + i + 1}", c.letters) for i, c in enumerate(learn_open(left, lambda t, c: sent.value.rarity(t, c)))]
        if not new:
            break
        wider = Model(bigrams=solved.model.bigrams, ciphers=[*ciphers, *new])
        more = materialize(more_candidates(types, options, wider, len(ciphers)), "cipher-options")
        trial = solve(types, more, wider.ciphers, solved)
        again = materialize(score(more, trial), "damaged-once")
        names = [c.name for c in new]
        explained = {r["source"] for r in again.where(F.col("source").isin(names)).groupBy("source").count().where(F.col("count") >= LEAST_TOKENS).collect()}
        if not explained:
            break
        # what explains too little is kept, too: it has a share next to nothing
        ciphers, options, solved, found, new = trial.model.ciphers, more, trial, again, []
    # what a token was may itself be damaged, if the same text was read wrongly several times
    deeper = found.select(F.col("token").alias("original"), F.col("original").alias("first"))
    whole = found.join(deeper, "original", "left").select("token", "damage", F.coalesce("first", "original").alias("original"), "source")
    return Damage(materialize(whole.unionByName(lost_letters(types)), "damaged-tokens"), solved)


def _odd_tokens(texts: DataFrame, id_column: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with characters beyond ASCII (_id, _text), and their tokens that have such (_id, token)."""
    odd = texts.where(F.col(column).rlike(r"[^\x00-\x7f]")).select(F.col(id_column).alias("_id"), F.col(column).alias("_text"))
    each = odd.select("_id", F.explode(F.array_distinct(terms_of(F.col("_text")))).alias("token")).where(F.col("token").rlike(r"[^\x00-\x7f]"))
    return odd, each


def damaged_ids(texts: DataFrame, damage: DataFrame, id_column: str = "row_id", column: str = "ngram") -> DataFrame:
    """The ids of the rows that hold a damaged token, each once."""
    _, each = _odd_tokens(texts, id_column, column)
    return each.join(damage.select("token"), "token", "left_semi").select(F.col("_id").alias(id_column)).distinct()


def damaged_rows(texts: DataFrame, damage: DataFrame, id_column: str = "row_id", column: str = "ngram") -> DataFrame:
    """id, text, restored (null if a token can't be restored), sources of the rows that hold a damaged token.

    Rows with a null text hold none; repeated rows come out each; spacing is kept.
    """
    odd, each = _odd_tokens(texts, id_column, column)
    found = each.join(damage, "token").groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("token", "original"))).alias("t"), F.sort_array(F.collect_set("source")).alias("sources")
    )
    joined = found.join(odd, "_id")
    parts = F.expr("regexp_extract_all(_text, '[^ \\\\t]+|[ \\\\t]+', 0)")
    known = F.map_from_entries("t")
    restored = F.when(F.forall("t", lambda x: x["original"].isNotNull()), F.array_join(F.transform("p", lambda w: F.coalesce(F.try_element_at("m", w), w)), ""))
    wide = joined.withColumn("p", parts).withColumn("m", known)
    return wide.select(F.col("_id").alias(id_column), F.col("_text").alias(column), restored.alias("restored"), F.concat_ws("; ", "sources").alias("sources"))
