"""Substitute words in the form of the word they replace, over a lexicon.

Lexicon tables: lemma (lemma_id, pos), wordform (wf_id, lemma_id, infl), spelling (wf_id, str).
Requests: id, head, word, pos (n, a, v, r or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.functions.strings import capmatch, headword, replace_first

# Part-of-speech codes of the lexicon.
POS = {"n": 1, "a": 2, "v": 4, "r": 7}


def pos_code(pos: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in POS.items() for x in kv)), pos)


def _forms(lemma: DataFrame, wordform: DataFrame, spelling: DataFrame) -> DataFrame:
    return spelling.join(wordform, "wf_id").join(lemma, "lemma_id").select("wf_id", "lemma_id", "infl", F.col("pos").alias("form_pos"), "str")


def mormatch(requests: DataFrame, lemma: DataFrame, wordform: DataFrame, spelling: DataFrame) -> DataFrame:
    """id, form: the spellings of the word's lemma in the inflection of the head, of the same part of speech.

    A request whose head or word is unknown, or which has no such form, gets its word back. A null id, head or word gives no row
    but for the fallback to the word.
    """
    forms = _forms(lemma, wordform, spelling)
    asked = requests.withColumn("code", pos_code(F.col("pos")))
    wanted = lambda p: F.col("code").isNull() | (F.col(p) == F.col("code"))
    h = forms.select(F.col("str").alias("h_str"), F.col("form_pos").alias("h_pos"), F.col("infl").alias("h_infl")).distinct()
    w = forms.select(F.col("str").alias("w_str"), F.col("form_pos").alias("w_pos"), "lemma_id").distinct()
    x = wordform.join(spelling, "wf_id").select("lemma_id", F.col("infl").alias("h_infl"), F.col("str").alias("form")).distinct()
    heads = asked.join(h, (F.lower("head") == F.col("h_str")) & wanted("h_pos"))
    both = heads.join(w, (F.lower("word") == F.col("w_str")) & (F.col("w_pos") == F.col("h_pos")))
    found = both.join(x, ["lemma_id", "h_infl"]).select("id", "form").distinct()
    return asked.join(found, "id", "left").select("id", F.coalesce("form", "word").alias("form")).distinct()


def submatch(requests: DataFrame, lemma: DataFrame, wordform: DataFrame, spelling: DataFrame) -> DataFrame:
    """id, result: the word phrase with its head word in the form and the capitalization of the head phrase."""
    heads = requests.select("id", F.col("head").alias("head0"), F.col("word").alias("word0"), "pos", headword(F.col("head"), F.col("pos")).alias("head"), headword(F.col("word"), F.col("pos")).alias("word"))
    forms = mormatch(heads.select("id", "head", "word", "pos"), lemma, wordform, spelling)
    made = heads.join(forms, "id").select("id", "head0", replace_first(F.col("word0"), F.col("word"), F.col("form")).alias("r"))
    return made.select("id", capmatch(F.col("head0"), F.col("r")).alias("result")).distinct()
