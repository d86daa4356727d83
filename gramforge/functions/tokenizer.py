"""The rule-based tokenizer: an ordered chain of substitutions, then a split at white space.

Everything is a Column expression inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALWAYS = r"[!\"$%()?@\[\\\]^_{|}~]"



@dataclass(frozen=True)
class Outside:
    """Signs that always stand alone, but for those in a whole that stays (a marker, an entity): the line is cut at the wholes, and signs are
    set apart in the parts between them."""

    whole: str
    signs: str


# The substitutions that define the tokenization, in their order. Each group: a pattern without which a line
# isn't changed by it, and its substitutions (pattern, replacement, passes).
GROUPS: list[tuple[str, list[tuple[str, str, int]] | Outside]] = [
    # punctuation that always stands alone
    (_ALWAYS, [(rf"(\S)({_ALWAYS})", "$1 $2", 1), (rf"({_ALWAYS})(\S)", "$1 $2", 1)]),
    # angle brackets, unless they are part of a marker
    (r"[<>]", Outside(r"<(?:S|/S|UNK)>", r"[<>]")),
    # backtick, unless beside another
    (r"`", [(r"([^`\s])(`)", "$1 $2", 1), (r"(`)([^`\s])", "$1 $2", 1)]),
    # ampersand, number sign and semicolon, unless they form an entity
    (r"[&#;]", Outside(r"&#?[^\s&#;]+;", r"[&#;]")),
    # star and equals beside letters and digits; plus, comma and colon beside letters
    (r"[*=]", [(r"([\pL\pN])([*=])", "$1 $2", 1), (r"([*=])([\pL\pN])", "$1 $2", 1)]),
    (r"[+,:]", [(r"(\pL)([+,:])", "$1 $2", 1), (r"([+,:])(\pL)", "$1 $2", 1)]),
    # a contraction that stands alone; punctuation at the end of a word; clitics
    (r"n't", [(r"\bn't\b", "not", 1)]),
    (r"['\-/] ", [(r"(\w)(['\-/]) ", "$1 $2 ", 1)]),
    (r"'", [(r"(?i)(\S)('(?:d|em|ll|m|re|s|ve))\b", "$1 $2", 1)]),
    # dashes and slashes inside words: one character may belong to two matches, so twice
    (r"[\-/]", [(r"(\w)([\-/])(\w)", "$1 $2 $3", 2)]),
    # the final period; acronyms
    (r"\.", [(r"(\w)(\.\W*)$", "$1 $2", 1)]),
    (r"[A-Z]\.[A-Z]", [(r"([A-Z]\.)([A-Z]\.)", "$1 $2", 2)]),
]
START, END, UNKNOWN = "<S>", "</S>", "<UNK>"


def _apply(text: Column, rules: list[tuple[str, str, int]]) -> Column:
    steps = [(p, r) for p, r, times in rules for _ in range(times)]
    return reduce(lambda c, step: F.regexp_replace(c, F.lit(step[0]), F.lit(step[1])), steps, text)


def _outside(text: Column, cut: Outside) -> Column:
    parts = F.transform(F.split(text, cut.whole, -1), lambda part: F.regexp_replace(part, F.lit(f"({cut.signs})"), F.lit(" $1 ")))
    kept = F.regexp_extract_all(text, F.lit(cut.whole), F.lit(0))
    return F.array_join(F.zip_with(parts, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _guarded(text: Column, guard: str, rules: list[tuple[str, str, int]] | Outside) -> Column:
    """A group of rules, passed over for lines it can't change. The line is bound once, as a lambda's variable:
    written out, each group would repeat all those before it."""
    return F.get(F.transform(F.array(text), lambda x: F.when(x.rlike(guard), _outside(x, rules) if isinstance(rules, Outside) else _apply(x, rules)).otherwise(x)), F.lit(0))


def tokenize(text: Column) -> Column:
    """Tokens of one line: ARRAY<STRING>; a null line gives null, a blank one an empty array."""
    done = reduce(lambda c, group: _guarded(c, *group), GROUPS, text)
    return F.filter(F.split(done, r"\s+"), lambda t: t != "")


def sentences(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no (from 0), kept columns, w (tokens between <S> and </S>).

    Null and empty texts have no sentence.
    """
    lines = documents.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"\S"))
    marked = F.concat(F.array(F.lit(START)), tokenize(F.col("line")), F.array(F.lit(END)))
    return lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), *keep, marked.alias("w"))
