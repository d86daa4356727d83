import bz2
import gzip

import pytest
from pyspark.errors import PySparkException

from gramforge.sources import ngram_data as D


def test_ngram_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "2gm-0000.gz", "wt") as f:
        f.write('the cat\t45\n" said\t50\n\nno count\nx y\tabc\na b c d e f\t44\n')
    with gzip.open(tmp_path / "other.gz", "wt") as f:
        f.write("not read\t1\n")
    got = sorted((r["n"], r["w1"], r["w2"], r["cnt"]) for r in D.read_ngram_files(spark, str(tmp_path)).collect())
    assert got == [(2, '"', "said", 50), (2, "the", "cat", 45)]
    with bz2.open(tmp_path / "3gm-0000.bz2", "wt") as f:
        f.write("a b c\t40\n")
    assert D.read_ngram_files(spark, str(tmp_path), "?gm-????.bz2").first()["n"] == 3


def test_vocabulary_total_patterns(spark, tmp_path):
    (tmp_path / "vocab").write_text('the\t900\n"\t500\n\t\n')
    (tmp_path / "total").write_text("1400\n")
    (tmp_path / "patterns").write_text("the _\n\n_ of\n")
    assert {tuple(r) for r in D.read_vocabulary(spark, str(tmp_path / "vocab")).collect()} == {("the", 900), ('"', 500)}
    assert D.read_total(spark, str(tmp_path / "total")).first()[0] == 1400
    assert D.read_patterns(spark, str(tmp_path / "patterns")).count() == 3


def test_count_files(spark, tmp_path):
    counts = spark.createDataFrame([("the", 5, None, None), ("the _", 7, 2, None), ("_ _", 9, 3, 1)], "pattern string, n0 long, n1 long, n2 long")
    D.write_counts(counts, str(tmp_path / "out"))
    assert {tuple(r) for r in D.read_counts(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in counts.collect()}
    (tmp_path / "bad").write_text("pattern\n")
    with pytest.raises(PySparkException, match="without n0"):
        D.read_counts(spark, str(tmp_path / "bad")).collect()


def test_cache(spark, tmp_path):
    (tmp_path / "cache").write_text("a b\t5\nbroken\nc\t7\n")
    good, bad = D.read_cache(spark, str(tmp_path / "cache"))
    assert {tuple(r) for r in good.collect()} == {("a b", 5), ("c", 7)} and [r[0] for r in bad.collect()] == ["broken"]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l").write_text("1\\count\\9\\4\n")
    (tmp_path / "f").write_text("3\\counted\\7\\1\\pe\n")
    (tmp_path / "s").write_text("3\\x\\1\\1\\1\\1\\1\\1\\Count*ed\\1\\1\\1\\1\\tallied\n")
    lemma, form, spelling = D.read_lexicon(spark, *(str(tmp_path / x) for x in "lfs"))
    assert tuple(lemma.first()) == (1, 4) and tuple(form.first()) == (3, 1, "pe")
    assert sorted(r["str"] for r in spelling.collect()) == ["counted", "tallied"]


def test_table_of_rows(spark):
    rows = [
        (1, 0, 1, 2, "a b", "a", "b", 40, 1), (2, 0, 1, 2, "a b", "a", "b", 40, 2), (3, 0, 2, 2, "a  b", "a", "b", 45, 1), (4, 0, 3, 2, None, None, None, 45, 1), (5, 0, 4, 2, "a c", "a", "c", None, 1),
    ]
    df = spark.createDataFrame(rows, "row_id long, fnum int, line_no long, n int, ngram string, w1 string, w2 string, cnt long, loaded_at int").selectExpr("*", "cast(null as string) as w3", "cast(null as string) as w4", "cast(null as string) as w5")
    vocab = spark.createDataFrame([("a", 10), ("a", 5), ("b", None), (None, 3)], "w1 string, cnt long")
    got = {(r["n"], r["w1"], r["w2"], r["cnt"]) for r in D.ngram_table(df, vocab).collect()}
    assert got == {(2, "a", "b", 85), (1, "a", None, 15)}
    assert D.ngram_table(df.limit(0), vocab.limit(0)).count() == 0
