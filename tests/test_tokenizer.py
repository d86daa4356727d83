import duckdb
import pytest
from pyspark.sql import functions as F

from gramforge.functions.tokenizer import sentences, tokenize
from gramforge.plans.oracle_text import tokens_sql

CASES = [
    ("I don't know what you'll do, it's U.S.A.F. vis-a-vis a-b-c-d!!!! \"end.\"", "I don't know what you 'll do , it 's U. S. A. F. vis - a - vis a - b - c - d ! ! ! ! \" end . \""),
    ("AT&T &amp; &#120; <S> foo<UNK>bar </S> x=1 1,000 a,b e.g. www.x.com/y n't", "AT & T &amp; &#120; <S> foo<UNK>bar </S> x = 1 1,000 a , b e.g. www.x.com / y not"),
    ("at 10:30", "at 10:30"),
    ("``tick``", "`` tick ``"),
    ("", ""),
    ("   ", ""),
    ("a_b", "a _ b"),
    ("ü,ö", "ü , ö"),
    ("&lt;S&gt; &a&b; x&#x27;y;", "&lt;S&gt; & a&b; x&#x27;y ;"),
    ("<<UNK>>x&<S>", "< <UNK> > x & <S>"),
    ("AT&T&#38;&lt;a&; #1; &;", "AT & T&#38;&lt;a & ; # 1 ; & ;"),
    ("l'eau ``x`y a-b/c-d 'tis we'LL *a=b* U.K.. ok...", "l'eau `` x ` y a - b / c - d 'tis we 'LL * a = b * U. K.. ok ..."),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_cases_in_both_engines(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0]
    assert got == expected.split()
    assert duckdb.execute(tokens_sql("(select ? as line)"), [text]).fetchall()[0][0] == expected.split()


def test_null_line(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tokenize(F.col("t"))).first()[0] is None


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "one line\n\n \nTwo."), (2, None), (3, ""), (4, "x")], "doc_id long, text string").withColumn("w", F.lit("clash"))
    got = {(r[0], r[1]): r[2] for r in sentences(docs).collect()}
    assert got == {(1, 0): ["<S>", "one", "line", "</S>"], (1, 3): ["<S>", "Two", ".", "</S>"], (4, 0): ["<S>", "x", "</S>"]}
    assert sentences(docs.limit(0)).count() == 0
