"""Command line: python -m gramforge {lookup,model,tokenize,pair} ...

lookup    patterns from standard input (or --pattern), counts or matching n-grams to standard output
model     cross entropy of a text with a count file; --patterns prints what the model asks for
tokenize  tokens of lines from standard input
pair      how often two words stand within five words of each other
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.patterns import parse_patterns
from gramforge.functions.tokenizer import sentences, tokenize
from gramforge.operators.cooccur import window_cooccurrence
from gramforge.operators.corpus import known_sentences
from gramforge.operators.lookup import matching_ngrams, pattern_counts
from gramforge.plans import optimize, smoothing
from gramforge.plans.features import distinct_positions, features, positions, stats_from_counts
from gramforge.plans.score import mincnt_positions, request_patterns, string_position
from gramforge.session import materialize, ship
from gramforge.sources.ngram_data import WORDS, read_counts, read_ngram_files, read_vocabulary


def _ngrams(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    rows = read_ngram_files(spark, args.path, args.glob)
    if args.vocab:
        empty = [F.lit(None).cast("string").alias(w) for w in WORDS[1:]]
        rows = rows.unionByName(read_vocabulary(spark, args.vocab).select(F.lit(1).alias("n"), "w1", *empty, "cnt"))
    return rows.groupBy("n", *WORDS).agg(F.sum("cnt").alias("cnt"))


def _print(df: DataFrame) -> None:
    """Rows as they come from the executors, one partition at a time."""
    for r in df.toLocalIterator():
        print("\t".join(str(v) for v in r if v is not None))


def lookup(spark: SparkSession, args: argparse.Namespace) -> None:
    asked = args.pattern or [line.rstrip("\n") for line in sys.stdin]
    patterns = parse_patterns(spark.createDataFrame([(p,) for p in asked], "pattern string"))
    ngrams = _ngrams(spark, args)
    if args.all:
        _print(matching_ngrams(ngrams, patterns).select(F.concat_ws(" ", *WORDS), "cnt"))
    _print(pattern_counts(ngrams, patterns, n2=args.n2, zeroes=args.zero))


def model(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.optimize:
        optimize.dimensions(args.smoothing, args.ngram)  # an error for models without parameters
    if not args.text and not args.string and not args.verify:
        raise SystemExit("model: one of --text, --string and --verify is needed")
    lines = spark.createDataFrame([], "value string") if not args.text else spark.read.text(args.text)
    lines = lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    sents = materialize(sentences(lines), "sentences")
    if args.patterns:
        _print(request_patterns(distinct_positions(sents), args.smoothing, args.ngram))
        return
    raw = materialize(read_counts(spark, args.counts), "counts")
    parsed = parse_patterns(raw).join(raw.select(F.array_join(F.filter(F.split("pattern", r"\s+"), lambda t: t != ""), " ").alias("pattern"), "n0", "n1", "n2"), "pattern")
    parsed = materialize(parsed, "patterns")
    stats = stats_from_counts(parsed)
    vocab = parsed.where("n = 1 and mask = 0 and n0 > 0").select(F.col("p1").alias("w1"))
    if args.string:
        pos = features(string_position(spark, args.string), stats)
        cols = [F.expr(smoothing.bits(f"p{n}")).alias(f"bits_{n}") for n in range(1, args.ngram + 1)]
        _print(smoothing.apply_layers(pos, smoothing.layers(args.smoothing, None, args.threshold, args.token_threshold)).select("y", *cols))
        return
    if args.verify:
        words = args.verify.split()[-5:-1]
        context = spark.createDataFrame([(*[None] * (4 - len(words)), *words)], "x4 string, x3 string, x2 string, x1 string")
        row = optimize.normalization(context, vocab, stats, [args.smoothing], args.threshold, args.token_threshold).first()
        for n in range(1, args.ngram + 1):
            print(f"sum_{n}", row[f"sum_{n}"])
        return
    steps = smoothing.layers(args.smoothing, None, args.threshold, args.token_threshold)
    cols = [F.expr(smoothing.bits(f"p{n}")).alias(f"bits_{n}") for n in range(1, args.ngram + 1)]
    known = known_sentences(sents, vocab)
    scored = distinct_positions(known)
    if args.mincnt:
        counts_of = parsed.where("n = 1 and mask = 0 and n0 > 0").select(F.col("p1").alias("w1"), F.col("n0").alias("cnt"))
        scored = mincnt_positions(sents, counts_of, args.mincnt)
    if args.verbose:
        each = features(positions(known, ("doc_id", "line_no")), stats)
        _print(smoothing.apply_layers(each, steps).orderBy("doc_id", "line_no", "i").select("y", *cols))
    feats = materialize(features(scored, stats), "features")
    if args.optimize:
        f = optimize.objective(feats, args.smoothing, args.ngram, args.threshold, args.token_threshold)
        search = optimize.simplex if args.optimize == "simplex" else optimize.hill_climb
        x, value = search(f, optimize.start(args.smoothing, args.ngram, args.start))
        print("params", *x)
        print("bits", value)
        return
    row = smoothing.apply_layers(feats, steps).select("times", *cols).agg(F.sum("times").alias("words"), *(F.try_divide(F.sum(F.col(f"bits_{n}") * F.col("times")), F.sum("times")).alias(f"bits_{n}") for n in range(1, args.ngram + 1))).first()
    print("words", row["words"] or 0)
    for n in range(1, args.ngram + 1):
        print(f"bits_{n}", row[f"bits_{n}"])


def tokens(spark: SparkSession, args: argparse.Namespace) -> None:
    df = spark.createDataFrame([(i, line.rstrip("\n")) for i, line in enumerate(sys.stdin)], "i long, line string")
    _print(df.select("i", F.array_join(tokenize(F.col("line")), " ").alias("t")).orderBy("i").select("t"))


def pair(spark: SparkSession, args: argparse.Namespace) -> None:
    a, b = sorted([args.a, args.b])
    row = window_cooccurrence(_ngrams(spark, args)).where((F.col("a") == a) & (F.col("b") == b)).first()
    print(row["n0"] if row else 0)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gramforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(required=True)

    def data(p: argparse.ArgumentParser) -> None:
        p.add_argument("-p", "--path", default=".", help="folder with n-gram files")
        p.add_argument("--glob", default="?gm-????.gz")
        p.add_argument("--vocab", help="vocabulary file, for order 1")

    p = sub.add_parser("lookup")
    data(p)
    p.add_argument("--pattern", action="append")
    p.add_argument("-a", "--all", action="store_true", help="the matching n-grams, too")
    p.add_argument("-2", "--n2", action="store_true", help="distinct last words, too")
    p.add_argument("-0", "--zero", action="store_true", help="patterns without a match, too")
    p.set_defaults(run=lookup)
    p = sub.add_parser("model")
    p.add_argument("--text")
    p.add_argument("--counts", help="count file: pattern, n0, n1, n2")
    p.add_argument("--smoothing", choices=smoothing.MODELS, default="knmod")
    p.add_argument("--ngram", type=int, choices=range(1, 6), default=5)
    p.add_argument("--threshold", type=int, default=40)
    p.add_argument("--token-threshold", type=int, default=200)
    p.add_argument("--patterns", action="store_true", help="print the patterns that the model asks for")
    p.add_argument("--string", help="blank-separated words: bits of the last one, for each order")
    p.add_argument("--verify", help="blank-separated words: sums of the probabilities of all words in place of the last one, for each order")
    p.add_argument("--mincnt", type=int, default=0, help="words below this count are <UNK> in contexts")
    p.add_argument("--verbose", action="store_true", help="bits of each token")
    p.add_argument("--optimize", choices=["climb", "simplex"])
    p.add_argument("--start", choices=["default", "zeroes", "random"], default="default")
    p.set_defaults(run=model)
    p = sub.add_parser("tokenize")
    p.set_defaults(run=tokens)
    p = sub.add_parser("pair")
    data(p)
    p.add_argument("a")
    p.add_argument("b")
    p.set_defaults(run=pair)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("gramforge").getOrCreate()
    ship(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
