import datetime

from gramforge.functions.patterns import parse_patterns
from gramforge.operators.lookup import pattern_counts
from gramforge.streaming.lookup import answer_patterns, answers_from_counts, daily_counts, ngram_stream

WORDS = "n int, w1 string, w2 string, w3 string, w4 string, w5 string, cnt long"
NGRAMS = [(2, "the", "cat", None, None, None, 60), (2, "the", "dog", None, None, None, 50), (1, "the", None, None, None, None, 900)]


def test_answers(spark, tmp_path):
    ngrams = spark.createDataFrame(NGRAMS, WORDS)
    spark.createDataFrame([("the _",), ("zzz",), ("",), (None,)], "pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pattern string").parquet(str(tmp_path / "in"))
    got = []
    answer_patterns(stream, ngrams, lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == [("the _", 110, 2, None), ("zzz", 0, None, None)]


def test_static_join(spark, tmp_path):
    ngrams = spark.createDataFrame(NGRAMS, WORDS)
    counts = pattern_counts(ngrams, parse_patterns(spark.createDataFrame([("the _",), ("_ _",)], "pattern string")))
    spark.createDataFrame([(" the  _",), ("_ _",), ("_ x",)], "pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pattern string").parquet(str(tmp_path / "in"))
    q = answers_from_counts(stream, counts).writeStream.format("memory").queryName("answers").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("answers").collect()} == {("the _", 110, 2, None), ("_ _", 110, 2, 2), ("_ x", 0, 0, None)}


def test_daily_counts(spark, tmp_path):
    at = datetime.datetime(2014, 1, 6, 4)
    rows = [(0, 1, 2, "a b", 40, at), (0, 1, 2, "a b", 40, at + datetime.timedelta(hours=1)), (0, 2, 2, "a c", 50, at), (0, 3, 2, None, 50, at)]
    schema = "fnum int, line_no long, n int, ngram string, cnt long, loaded_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = daily_counts(stream).writeStream.format("memory").outputMode("complete").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["n0"], r["rows"]) for r in spark.table("daily").collect()] == [(2, 90, 2)]
    assert ngram_stream(spark, str(tmp_path)).isStreaming
