"""The whole way from text to patterns, counts and entropy on the command line, against the direct way."""

import gzip
import io
from collections import Counter

import pytest

from gramforge.__main__ import main
from gramforge.operators.corpus import Corpus, known_sentences, windows, word_counts
from gramforge.plans.features import distinct_positions, features, stats_tables
from gramforge.plans.score import cross_entropy, with_bits


@pytest.fixture
def files(spark, tmp_path):
    text = ["a b c a b", "a b . c", "b c a", "a b c a", "c", "a b c b"] * 3
    sents = [["<S>", *t.split(), "</S>"] for t in text]
    (tmp_path / "text").write_text("\n".join(text) + "\n\n")
    for n in range(2, 6):
        grams = Counter(" ".join(s[i : i + n]) for s in sents for i in range(len(s) - n + 1))
        with gzip.open(tmp_path / f"{n}gm-0000.gz", "wt") as f:
            f.writelines(f"{g}\t{c}\n" for g, c in grams.items() if c >= 4)
    (tmp_path / "vocab").write_text("".join(f"{w}\t{c}\n" for w, c in Counter(w for s in sents for w in s).items()))
    return tmp_path, sents


def run(capsys, spark, *argv, stdin="", monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    main(list(argv), spark)
    return [line.split("\t") for line in capsys.readouterr().out.splitlines()]


def test_pipeline(spark, files, capsys, monkeypatch):
    path, sents = files
    data = ["-p", str(path), "--vocab", str(path / "vocab")]
    asked = run(capsys, spark, "model", "--text", str(path / "text"), "--patterns")
    counts = run(capsys, spark, "lookup", *data, "-2", "-0", stdin="\n".join(p[0] for p in asked), monkeypatch=monkeypatch)
    assert len(counts) == len(asked)
    (path / "counts").write_text("\n".join("\t".join(c) for c in counts) + "\n")
    got = run(capsys, spark, "model", "--text", str(path / "text"), "--counts", str(path / "counts"), "--threshold", "4")
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sents)], "doc_id long, line_no int, w array<string>")
    corpus = Corpus(df, word_counts(df), windows(df), 4, 200)
    want = cross_entropy(with_bits(features(distinct_positions(known_sentences(df, corpus.vocab)), stats_tables(corpus)), "knmod", corpus)).first()
    values = dict(line[0].split(" ") for line in got)
    assert int(values["words"]) == want["words"]
    for n in range(1, 6):
        assert float(values[f"bits_{n}"]) == pytest.approx(want[f"bits_{n}"])
    verbose = run(capsys, spark, "model", "--text", str(path / "text"), "--counts", str(path / "counts"), "--threshold", "4", "--ngram", "2", "--verbose")
    model = ["model", "--counts", str(path / "counts"), "--threshold", "4"]
    last = run(capsys, spark, *model, "--string", "<S> a b c")[0]
    assert last[0] == "c" and len(last) == 6 and all(0 < float(x) < 20 for x in last[1:])
    sums = dict(line[0].split(" ") for line in run(capsys, spark, *model, "--smoothing", "mc", "--verify", "b c a x"))
    assert len(sums) == 5 and all(0 < float(v) <= 1.000001 for v in sums.values())
    rare = dict(line[0].split(" ") for line in run(capsys, spark, *model, "--text", str(path / "text"), "--mincnt", "1000"))
    assert rare["words"] == values["words"] and rare["bits_1"] == values["bits_1"] and rare["bits_2"] != values["bits_2"]
    with pytest.raises(ValueError):
        run(capsys, spark, *model, "--text", str(path / "text"), "--smoothing", "wbdiscount", "--optimize", "climb")
    assert len(verbose) == want["words"] + 3 and verbose[0][0] == "a"


def test_other_commands(spark, files, capsys, monkeypatch):
    path, _ = files
    data = ["-p", str(path), "--vocab", str(path / "vocab")]
    assert run(capsys, spark, "lookup", *data, "--pattern", "a b", "--pattern", "zz _") == [["a b", "15"]]
    matched = run(capsys, spark, "lookup", *data, "--pattern", "a _", "-a")
    assert ["a b", "15"] in matched and ["a _", "21", "2"] in matched
    assert run(capsys, spark, "tokenize", stdin="don't stop.\n\n", monkeypatch=monkeypatch) == [["don't stop ."], [""]]
    assert int(run(capsys, spark, "pair", *data, "a", "b")[0][0]) > 0
    assert run(capsys, spark, "pair", *data, "a", "zz") == [["0"]]
