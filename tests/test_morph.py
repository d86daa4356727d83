from pyspark.sql import functions as F

from gramforge.functions.strings import capmatch, headword, replace_first
from gramforge.operators.morph import submatch
from gramforge.plans.queries import _lexicon, _requests


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr).first()[0]


def test_headword(spark):
    h = headword(F.col("p"), F.col("pos"))
    assert one(spark, h, p="word", pos="n") == "word"
    assert one(spark, h, p="big red word", pos="n") == "word"
    assert one(spark, h, p="word of mouth", pos="n") == "word"
    assert one(spark, h, p="look up", pos="v") == "look"
    assert one(spark, h, p="look up", pos=None) == "look"
    assert one(spark, h, p=None, pos="n") is None


def test_capmatch(spark):
    c = capmatch(F.col("h"), F.col("w"))
    assert one(spark, c, h="lower", w="MiXed") == "mixed"
    assert one(spark, c, h="UPPER", w="mixed") == "MIXED"
    assert one(spark, c, h="A", w="of mIce") == "Of MIce"
    assert one(spark, c, h="Initial", w="of mIce") == "Of MIce"
    assert one(spark, c, h="mIxed", w="stays As") == "stays As"


def test_first_occurrence_only(spark):
    assert one(spark, replace_first(F.col("t"), F.col("a"), F.col("b")), t="a.b a.b", a="a.b", b="$1") == "$1 a.b"


def test_submatch(spark):
    got = {}
    for r in submatch(_requests(spark), *_lexicon(spark)).collect():
        got.setdefault(r["id"], set()).add(r["result"])
    assert got[1] == {"tallied"} and got[2] == {"Colours", "Colors"} and got[4] == {"colours of words", "colors of words"}
    assert got[5] == {"tally"} and got[6] == {"unheard of"}
    assert submatch(_requests(spark).limit(0), *_lexicon(spark)).count() == 0
