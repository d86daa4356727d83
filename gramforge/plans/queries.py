"""Queries for the operators of n-gram analytics and language models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.patterns import parse_patterns, render
from gramforge.functions.strings import capmatch, headword
from gramforge.functions.tokenizer import sentences
from gramforge.operators import cooccur, lookup, morph
from gramforge.operators.corpus import Corpus, build, known_sentences, with_unknowns, word_counts
from gramforge.plans import optimize, score
from gramforge.plans.features import CONTEXT, bad_contexts, distinct_positions, features, positions, stats_tables
from gramforge.plans.smoothing import MODELS
from gramforge.session import materialize, shared_dir, table
from gramforge.sources.ngram_data import WORDS, ngram_table, write_sorted

#: thresholds for the test corpus (the published ones are 40 and 200)
K, T = 2, 5
#: a word below this is <UNK> as a context in ``mincnt_unk``
MINCNT = 50
#: contexts that ``verify_norm`` checks: those with the lowest hashes in the corpus; a sentence's begin, words never seen, a bad token; and the models
HASHED, MADE, VERIFIED = 9, [(None, None, None, "<S>"), ("no", "such", "words", "hereabouts"), ("the", "of", "a", ";")], ["mc", "kn", "kn1", "kn3", "kn4", "knmod"]

_kept: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf: str, what: str, make):
    """Written tables that several queries read are made once in an application and directory."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def corpus(spark: SparkSession, sf: str) -> Corpus:
    return _once(spark, sf, "corpus", lambda: build(table(spark, sf, "documents"), K, T, ("lang",)))


def _stats(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def make():
        made = stats_tables(corpus(spark, sf))
        return {k: materialize(t, f"stats-{k}") for k, t in made.items()}

    return _once(spark, sf, "stats", make)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        c = corpus(spark, sf)
        return materialize(features(distinct_positions(known_sentences(c.sents, c.vocab)), _stats(spark, sf)), "features")

    return _once(spark, sf, "features", make)


def shared_tables(spark: SparkSession, sf: str) -> None:
    """Build what several queries read: the corpus, the counts, the feature table."""
    _features(spark, sf)


def _ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_table(table(spark, sf, "ngram_files"), table(spark, sf, "vocab"))


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    return parse_patterns(table(spark, sf, "pattern_list"))


# --- tokens and corpus counts ---


def tokenize_documents(spark, sf):
    s = sentences(table(spark, sf, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.size("w") - 2).alias("tokens"))


def token_counts(spark, sf):
    return word_counts(sentences(table(spark, sf, "documents"))).select("w1", "cnt")


def sentence_stats(spark, sf):
    s = sentences(table(spark, sf, "documents"), ("lang",))
    return s.groupBy("lang").agg(F.count("*").alias("sentences"), F.sum(F.size("w")).alias("tokens"), F.max(F.size("w")).alias("longest"))


def ngram_counts(spark, sf, n):
    return corpus(spark, sf).order(n).select(*WORDS[:n], "cnt")


def vocab_unk(spark, sf):
    c = corpus(spark, sf)
    return word_counts(with_unknowns(c.sents, c.vocab)).select("w1", "cnt")


def known_sentence_list(spark, sf):
    c = corpus(spark, sf)
    return known_sentences(c.sents, c.vocab).select("doc_id", "line_no", F.size("w").alias("size"))


# --- loaded n-gram data ---


def ngram_data(spark, sf):
    return _ngrams(spark, sf)


def allwild_totals(spark, sf):
    return lookup.allwild_totals(_ngrams(spark, sf))


def cube_counts(spark, sf, n):
    if n <= 3:
        return lookup.cube_counts(_ngrams(spark, sf), n)
    asked = _patterns(spark, sf).where(F.col("n") == n).select("mask").distinct().collect()  # at most 2^n
    return lookup.cube_counts(_ngrams(spark, sf), n, [r[0] for r in asked])


def parsed_patterns(spark, sf):
    p = _patterns(spark, sf)
    return p.withColumn("rendered", render([F.col(f"p{i}") for i in range(1, 6)], F.col("n"), F.col("mask")))


def pattern_counts(spark, sf):
    return lookup.pattern_counts(_ngrams(spark, sf), _patterns(spark, sf), n2=False)


def pattern_counts_n2(spark, sf):
    return lookup.pattern_counts(_ngrams(spark, sf), _patterns(spark, sf))


def pattern_counts_zero(spark, sf):
    return lookup.pattern_counts(_ngrams(spark, sf), _patterns(spark, sf), zeroes=True)


def match_ngrams(spark, sf):
    return lookup.matching_ngrams(_ngrams(spark, sf), _patterns(spark, sf))


def match_ngrams_all(spark, sf):
    return lookup.matching_ngrams(_ngrams(spark, sf), _patterns(spark, sf), with_exact=True)


def _sorted_copies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The n-grams by first and by second word, written once: a lookup reads the row groups that can hold its pattern."""

    def make():
        paths = shared_dir(spark, "by-w1"), shared_dir(spark, "by-w2")
        ngrams = materialize(_ngrams(spark, sf), "ngrams")
        for path, by in zip(paths, ("w1", "w2")):
            write_sorted(ngrams, path, by)
        return tuple(spark.read.parquet(p).select("n", *WORDS, "cnt") for p in paths)

    return _once(spark, sf, "sorted copies", make)


def prefix_lookup(spark, sf):
    return lookup.lookup_sorted(*_sorted_copies(spark, sf), "the _ _")


def second_word_lookup(spark, sf):
    return lookup.lookup_sorted(*_sorted_copies(spark, sf), "_ of _")


def point_lookup(spark, sf):
    return lookup.lookup(_ngrams(spark, sf), "the").select("n", "w1", "cnt")


def top_completions(spark, sf):
    return lookup.top_completions(_ngrams(spark, sf), 3, 3)


def file_routing(spark, sf):
    return lookup.route_files(table(spark, sf, "file_index"), _patterns(spark, sf))


def prefix_totals(spark, sf):
    return cooccur.prefix_totals(_ngrams(spark, sf))


def left_fanout(spark, sf):
    return cooccur.left_fanout(_ngrams(spark, sf))


def mid_fanout(spark, sf):
    return cooccur.mid_fanout(_ngrams(spark, sf))


def pair_counts(spark, sf):
    return cooccur.pair_counts(_ngrams(spark, sf))


def window_cooccurrence(spark, sf):
    return cooccur.window_cooccurrence(_ngrams(spark, sf))


# --- language models ---


def missing_count(spark, sf):
    """Contexts of one to four words with what their continuations lack."""
    stats = _stats(spark, sf)
    parts = [stats[f"x{k}"].where(f"x0_{k} > 0").select(F.concat_ws(" ", *(f"c{i + 1}" for i in range(k))).alias("context"), F.lit(k).alias("k"), (F.col(f"x0_{k}") - F.col(f"r0_{k}")).alias("missing")) for k in range(1, 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def n1mod(spark, sf):
    """n1 of "_ x y" with its missing count at 1 / K, for bigrams x y."""
    t = _stats(spark, sf)["y2"].where("y0_2 > 0 or l0_2 > 0")
    return t.select(F.col("c1").alias("x"), F.col("c2").alias("y"), F.round(F.col("l1_2") + F.lit(1.0 / K) * (F.col("y0_2") - F.col("l0_2")), 6).alias("n1mod"))


def bad_context(spark, sf):
    c = corpus(spark, sf)
    flags = [f"{b}_{k}" for k in range(1, 5) for b in ("bad", "kbad")]
    rows = positions(known_sentences(c.sents, c.vocab), ("doc_id",)).select("*", *bad_contexts())
    return rows.groupBy("doc_id").agg(*(F.sum(F.col(f).cast("int")).alias(f) for f in flags))


def mincnt_unk(spark, sf):
    c = corpus(spark, sf)
    return score.mincnt_positions(c.sents, c.vocab, MINCNT)


def bits_mincnt(spark, sf):
    """Bits with rare words as <UNK> in contexts; targets stay as they are."""
    c = corpus(spark, sf)
    rows = features(score.mincnt_positions(c.sents, c.vocab, MINCNT), _stats(spark, sf))
    return score.with_bits(rows, "knmod", c).select(*CONTEXT, "y", "times", F.round("bits_5", 6).alias("bits_5"))


def bits(spark, sf, model):
    scored = score.with_bits(_features(spark, sf), model, corpus(spark, sf))
    return scored.select(*CONTEXT, "y", "times", F.round("bits_5", 6).alias("bits_5"))


def token_bits(spark, sf):
    c = corpus(spark, sf)
    known = known_sentences(c.sents, c.vocab)
    where = positions(known, ("doc_id", "line_no")).select("doc_id", "line_no", "i", *CONTEXT, "y")
    scored = score.with_bits(_features(spark, sf), "knmod", c).select(*(F.col(x).alias(f"s_{x}") for x in (*CONTEXT, "y")), *(F.round(f"bits_{n}", 6).alias(f"bits_{n}") for n in range(1, 6)))
    on = [F.col(x).eqNullSafe(F.col(f"s_{x}")) for x in (*CONTEXT, "y")]
    return where.join(scored, on).select("doc_id", "line_no", "i", "y", *(f"bits_{n}" for n in range(1, 6)))


def cross_entropy(spark, sf):
    out = score.cross_entropies(_features(spark, sf), MODELS, K, T)
    return out.select("model", "words", *(F.round(f"bits_{n}", 4).alias(f"bits_{n}") for n in range(1, 6)))


def cross_entropy_by_lang(spark, sf):
    c = corpus(spark, sf)
    rows = features(distinct_positions(known_sentences(c.sents, c.vocab), ("lang",)), _stats(spark, sf))
    return score.cross_entropy(score.with_bits(rows, "knmod", c), ["lang"]).select("lang", "words", *(F.round(f"bits_{n}", 4).alias(f"bits_{n}") for n in range(1, 6)))


def verify_norm(spark, sf):
    """Sums of probabilities by model for a stated set of contexts: HASHED of those in the corpus, whatever they are, and some made ones, by model."""
    c, stats = corpus(spark, sf), _stats(spark, sf)
    some = _features(spark, sf).select(*CONTEXT).distinct().orderBy(F.md5(F.concat_ws(" ", *CONTEXT))).limit(HASHED)
    contexts = materialize(some.unionByName(spark.createDataFrame(MADE, ", ".join(f"{x} string" for x in CONTEXT))).distinct(), "contexts")
    out = optimize.normalization(contexts, c.order(1), stats, VERIFIED, K, T)
    return out.select("model", *CONTEXT, *(F.round(f"sum_{n}", 6).alias(f"sum_{n}") for n in range(1, 6)))


def request_patterns(spark, sf, model="knmod"):
    """Patterns of all sentences: those with unknown words are skipped in scoring only."""
    return score.request_patterns(distinct_positions(corpus(spark, sf).sents), model)


def optimize_mc(spark, sf):
    """Hill climbing from three starts and simplex, all four parameters, until a step is below 1e-4: they end at the same bits per word."""
    f = optimize.objective(_features(spark, sf), "mc", 5, K, T)
    searches = [("hill climbing", kind, lambda kind=kind: optimize.hill_climb(f, optimize.start("mc", 5, kind), step=1.0)) for kind in ("default", "zeroes", "random")]
    searches.append(("simplex", "default", lambda: optimize.simplex(f, optimize.start("mc", 5))))
    with ThreadPoolExecutor(len(searches)) as pool:  # many small jobs, each waiting for the one before: the searches run side by side
        ends = list(pool.map(lambda s: s[2](), searches))
    rows = [(method, kind, [round(a, 4) for a in x], round(v, 6)) for (method, kind, _), (x, v) in zip(searches, ends)]
    return spark.createDataFrame(rows, "method string, start string, params array<double>, bits double")


# --- substitute words, over a small invented lexicon ---

LEMMAS = [(1, 4), (2, 4), (3, 1), (4, 2), (5, 1)]
FORMS = [(1, 1, "a1"), (2, 1, "pe"), (3, 1, "a3"), (4, 2, "a1"), (5, 2, "pe"), (6, 2, "a3"), (7, 3, "S"), (8, 3, "P"), (9, 4, "b"), (10, 5, "S"), (11, 5, "P")]
SPELLINGS = [(1, "count"), (2, "counted"), (3, "counts"), (4, "tally"), (5, "tallied"), (6, "tallies"), (7, "count"), (8, "counts"), (9, "counted"), (10, "colour"), (10, "color"), (11, "colours"), (11, "colors")]
REQUESTS = [
    (1, "counted", "tally", "v"), (2, "Counts", "colour", "n"), (3, "COUNTS", "tally", None), (4, "the counts", "colour of words", "n"), (5, "unheard", "tally", "v"),
    (6, "counted", "unheard of", None), (7, "word counts", "main colour", "n"), (8, "Counts of words", "colour", "n"), (9, "counts", "Tally up", "v"), (10, "counted", "counts", "a"),
]


def _lexicon(spark):
    return (
        spark.createDataFrame(LEMMAS, "lemma_id int, pos int"), spark.createDataFrame(FORMS, "wf_id int, lemma_id int, infl string"), spark.createDataFrame(SPELLINGS, "wf_id int, str string"),
    )


def _requests(spark):
    return spark.createDataFrame(REQUESTS, "id int, head string, word string, pos string")


def headwords(spark, sf):
    return _requests(spark).select("id", headword(F.col("head"), F.col("pos")).alias("head"), headword(F.col("word"), F.col("pos")).alias("word"))


def capmatches(spark, sf):
    return _requests(spark).select("id", capmatch(F.col("head"), F.col("word")).alias("result"))


def mormatches(spark, sf):
    single = _requests(spark).select("id", headword(F.col("head"), F.col("pos")).alias("head"), headword(F.col("word"), F.col("pos")).alias("word"), "pos")
    return morph.mormatch(single, *_lexicon(spark))


def submatches(spark, sf):
    return morph.submatch(_requests(spark), *_lexicon(spark))


QUERIES = {
    "tokenize_documents": tokenize_documents,
    "token_counts": token_counts,
    "sentence_stats": sentence_stats,
    **{f"ngram_counts_{n}": partial(ngram_counts, n=n) for n in range(1, 6)},
    "vocab_unk": vocab_unk,
    "known_sentences": known_sentence_list,
    "ngram_table": ngram_data,
    "allwild_totals": allwild_totals,
    "cube_counts_2": partial(cube_counts, n=2),
    **{f"cube_counts_{n}": partial(cube_counts, n=n) for n in (3, 4, 5)},
    "parsed_patterns": parsed_patterns,
    "pattern_counts": pattern_counts,
    "pattern_counts_n2": pattern_counts_n2,
    "pattern_counts_zero": pattern_counts_zero,
    "match_ngrams": match_ngrams,
    "match_ngrams_all": match_ngrams_all,
    "prefix_lookup": prefix_lookup,
    "second_word_lookup": second_word_lookup,
    "point_lookup": point_lookup,
    "top_completions": top_completions,
    "file_routing": file_routing,
    "prefix_totals": prefix_totals,
    "left_fanout": left_fanout,
    "mid_fanout": mid_fanout,
    "pair_counts": pair_counts,
    "window_cooccurrence": window_cooccurrence,
    "missing_count": missing_count,
    "n1mod": n1mod,
    "bad_context": bad_context,
    "mincnt_unk": mincnt_unk,
    **{f"bits_{m}": partial(bits, model=m) for m in MODELS},
    "bits_mincnt": bits_mincnt,
    "token_bits": token_bits,
    "cross_entropy": cross_entropy,
    "cross_entropy_by_lang": cross_entropy_by_lang,
    "verify_norm": verify_norm,
    "request_patterns": request_patterns,
    **{f"request_patterns_{m}": partial(request_patterns, model=m) for m in MODELS if m not in ("knmod", "gbits")},
    "optimize_mc": optimize_mc,
    "headword": headwords,
    "capmatch": capmatches,
    "mormatch": mormatches,
    "submatch": submatches,
}
