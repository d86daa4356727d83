"""The tokenizer in SQL for DuckDB, written by itself: what the queries' tokens are held against."""

from __future__ import annotations

_MARKER, _ENTITY = r"<(?:S|/S|UNK)>", r"&#?[^\s&#;]+;"

# What is replaced by what, in order, beside markers and entities.
_FIRST = [(r'([!"$%()?@\[\\\]^_{|}~])', r" \1 ")]
_BACKTICKS = [(r"([^`\s])`", r"\1 `"), (r"`([^`\s])", r"` \1")]
_REST = [
    (r"([\pL\pN])([*=])", r"\1 \2"), (r"([*=])([\pL\pN])", r"\1 \2"), (r"(\pL)([+,:])", r"\1 \2"), (r"([+,:])(\pL)", r"\1 \2"),
    (r"\bn''t\b", "not"), (r"(\w)([''/-]) ", r"\1 \2 "), (r"(?i)(\S)(''(?:d|em|ll|m|re|s|ve))\b", r"\1 \2"),
    (r"(\w)([/-])(\w)", r"\1 \2 \3"), (r"(\w)([/-])(\w)", r"\1 \2 \3"), (r"(\w)(\.\W*)$", r"\1 \2"),
    (r"([A-Z]\.)([A-Z]\.)", r"\1 \2"), (r"([A-Z]\.)([A-Z]\.)", r"\1 \2"),
]


def _chain(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


def _around(whole: str, signs: str) -> str:
    """The line with signs set apart between wholes."""
    parts = f"string_split_regex(line, '{whole}')"
    each = f"regexp_replace({parts}[i], '({signs})', ' \\1 ', 'g') || coalesce(regexp_extract_all(line, '{whole}')[i], '')"
    return f"case when regexp_matches(line, '{signs}') then list_aggregate(list_transform(range(1, len({parts}) + 1), lambda i: {each}), 'string_agg', '') else line end"


def tokens_sql(source: str, keep: str = "") -> str:
    """w: the tokens of ``line``, beside the columns ``keep`` (each with a comma behind it)."""
    for s in (_chain("line", _FIRST), _around(_MARKER, "[<>]"), _chain("line", _BACKTICKS), _around(_ENTITY, "[&#;]"), _chain("line", _REST)):
        source = f"(select {keep}{s} as line from {source})"
    return f"select {keep}list_filter(string_split_regex(line, '\\s+'), lambda t: t <> '') as w from {source}"


def sentences_sql(extra: str = "") -> str:
    """CTEs ``lines``, ``plain`` and ``sent``; ``extra``: further columns, each with a comma behind it."""
    keep = f"doc_id, {extra} line_no, "
    some = tokens_sql("(select * from lines where regexp_matches(line, '\\S'))", keep)
    return (
        f"lines as (select doc_id, {extra} generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, unnest(string_split(text, chr(10))) as line from documents),\n"
        f"plain as ({some}),\n"
        f"sent as (select {keep}list_concat(list_concat(['<S>'], w), ['</S>']) as w from plain)"
    )
