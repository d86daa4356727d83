"""N-gram counts of a text corpus, with vocabulary and n-gram thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.functions.tokenizer import UNKNOWN, sentences
from gramforge.session import materialize
from gramforge.sources.ngram_data import WORDS


def word_counts(sents: DataFrame) -> DataFrame:
    """w1, cnt of all tokens, the sentence marks among them."""
    return sents.select(F.explode_outer("w").alias("w1")).groupBy("w1").agg(F.count("*").alias("cnt"))


def with_unknowns(sents: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sentences with the words that ``vocab`` (w1) lacks replaced by <UNK>."""
    key = ["doc_id", "line_no", *keep]
    tokens = sents.select(*key, F.posexplode("w").alias("i", "t"))
    known = tokens.join(vocab.select(F.col("w1").alias("t"), F.lit(True).alias("known")), "t", "left")
    word = F.when(F.col("known"), F.col("t")).otherwise(F.lit(UNKNOWN))
    joined = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", word.alias("t")))).alias("s"))
    return joined.select(*key, F.col("s.t").alias("w"))


def windows(sents: DataFrame) -> DataFrame:
    """w1..w5, cnt: every position once with the four words after it (null beyond the sentence), equal ones added up.

    The n-grams of any order are its rows with a word n, by their first n words: one shuffle of the corpus serves all orders.
    """
    at = sents.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    words = [F.get(F.col("w"), F.col("i") + k).alias(x) for k, x in enumerate(WORDS)]
    return at.select(*words).groupBy(*WORDS).agg(F.count("*").alias("cnt"))


def order_counts(wins: DataFrame, n: int, threshold: int) -> DataFrame:
    """w1..wn, cnt of the n-grams that occur at least ``threshold`` times (order 1: all)."""
    w = WORDS[:n]
    out = wins.where(F.col(w[-1]).isNotNull()).groupBy(*w).agg(F.sum("cnt").alias("cnt"))
    return out.where(F.col("cnt") >= threshold) if n > 1 else out


@dataclass
class Corpus:
    """A corpus ready for models: its sentences, its vocabulary, and windows after <UNK>."""

    sents: DataFrame
    vocab: DataFrame
    wins: DataFrame
    ngram_threshold: int
    token_threshold: int

    def order(self, n: int) -> DataFrame:
        return order_counts(self.wins, n, self.ngram_threshold)


def build(documents: DataFrame, ngram_threshold: int = 40, token_threshold: int = 200, keep: tuple[str, ...] = ()) -> Corpus:
    """Count a corpus. Sentences, vocabulary and windows are written to the shared folder, as several plans read them."""
    sents = materialize(sentences(documents, keep), "sentences")
    vocab = materialize(word_counts(sents).where(F.col("cnt") >= token_threshold), "vocabulary")
    wins = materialize(windows(with_unknowns(sents, vocab)), "windows")
    return Corpus(sents, vocab, wins, ngram_threshold, token_threshold)


def known_sentences(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sentences all of whose words, the marks at both ends aside, are in the vocabulary."""
    key = ["doc_id", "line_no"]
    tokens = sents.select(*key, F.explode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("w1"))
    unknown = tokens.join(vocab.select("w1"), "w1", "left_anti").select(*key).distinct()
    return sents.join(unknown, key, "left_anti")


