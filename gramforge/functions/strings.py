"""String functions for substitute words: head words and capitalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def headword(phrase: Column, pos: Column) -> Column:
    """A single word is its own head; a noun phrase whose second word is not "of" has its last word, others the first."""
    words = F.split(phrase, r"\s+")
    noun = F.coalesce(pos == "n", F.lit(False)) & (F.get(words, F.lit(1)) != "of")
    return F.when(F.size(words) == 1, phrase).when(noun, F.element_at(words, -1)).otherwise(F.get(words, F.lit(0)))


def capmatch(head: Column, word: Column) -> Column:
    """``word`` in the capitalization of ``head``: lower, all capitals (two at least), initial capitals, else unchanged."""
    initial = F.array_join(F.transform(F.split(word, r"\s+"), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))), " ")
    return (
        F.when(head == F.lower(head), F.lower(word))
        .when((head == F.upper(head)) & head.rlike("[A-Z].*[A-Z]"), F.upper(word))
        .when(head.rlike("^[A-Z]"), initial)
        .otherwise(word)
    )


def replace_first(text: Column, what: Column, by: Column) -> Column:
    """The first literal occurrence replaced."""
    at = F.instr(text, what)
    return F.when(at > 0, F.overlay(text, by, at, F.length(what))).otherwise(text)
