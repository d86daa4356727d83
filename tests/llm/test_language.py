import random

import pytest
from pyspark.sql import functions as F

from gramforge.llm.language import document_languages, fold, label_language, seeds, segments, sentences_of, train, train_from


@pytest.fixture(scope="module")
def samples(spark, small):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/lang_samples.parquet").collect()]


@pytest.fixture(scope="module")
def learned(spark, small, samples):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return train_from(docs, spark.read.parquet(f"{small}/lang_samples.parquet"))


def test_held_out_sentences(spark, samples, learned):
    """Dictionaries learned without any of the tested sentences' labels."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").limit(600).collect()]
    r = random.Random(1)
    shuffled = sorted(samples, key=lambda _: r.random())
    held, used = shuffled[:35], shuffled[35:]
    held = [(lang, t) for lang, t in held if len(t.split()) > 4]
    known = train(used, docs)
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(held)], "doc_id long, text string")
    got = {x["doc_id"]: x["lang"] for x in segments(df, known).collect()}
    right = sum(got.get(i) == lang for i, (lang, _) in enumerate(held))
    assert right >= 0.95 * len(held)


def test_segments_of_a_mixed_text(spark, learned):
    text = (
        "The counter keeps the hyphenated words from the compressed archive. The hash table changes each distinct trigram, so the new script rejects the final word.\n"
        'Der Zähler ersetzt drei große Dateien während des nächtlichen Laufs. Die Wortliste zählt die gemeldeten Zahlen. ("the final word")\n'
        "_ the _\t45\t7\n#123\nThe tokenizer counts the split contractions without any warning."
    )
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "_ a\t5"), (1, text)], "doc_id long, text string").withColumn("lang", F.lit("clash"))
    rows = segments(df, learned).orderBy("segment").collect()
    assert {r["doc_id"] for r in rows} == {1}
    assert [(r["lang"], r["sentences"]) for r in rows if True][::2] == [("en", 2), ("de", 2), ("en", 1)]
    assert all(0 < r["confidence"] <= 1 for r in rows)
    top = {r["lang"]: r["rank"] for r in document_languages(segments(df.limit(1), learned)).collect()}
    assert top == {"en": 1, "de": 2}


def test_accents_and_case_do_not_matter(spark, learned):
    df = spark.createDataFrame([(1, "UN LECTOR ATENTO RECHAZA LA PRIMERA COLUMNA POR CULPA DE UN DESPLAZAMIENTO ERRONEO.")], "doc_id long, text string")
    assert segments(df, learned).first()["lang"] == "es"
    assert fold("Él año") == fold("EL ANO")


def test_empty_and_long(spark, learned):
    df = spark.createDataFrame([(1, "The counter keeps the old totals. " * 20_000)], "doc_id long, text string")
    row = segments(df, learned).first()
    assert row["words"] == 120_000 and row["lang"] == "en"
    assert segments(df.limit(0), learned).count() == 0


def test_sentences():
    got = sentences_of('The word "a b" is here. Is it?\n"one two three four five" x\n#1\n2010-01-01\nkn 4: 5.0')
    assert [k for _, k in got] == [4, 2, 6]


def test_labels(spark):
    cases = {"en": "en", "EN-gb": "en", "en_US": "en", " English ": "en", "deu": "de", "Deutsch": "de", "nl-BE": "nl", "und": None, "": None, "??": None, None: None, "zxx": None, "por": "pt", "fre": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in df.select("l", label_language(F.col("l"))).collect()} == cases


def test_all_documents_widen_the_dictionaries(spark, samples, learned):
    """Long texts and every document take part: the same dictionaries as from a list of all texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    texts = [r["text"] for r in docs.select("text").collect()]
    assert any(len(t) > 20_000 for t in texts)
    assert learned == train(sorted(set(samples)), texts)


def test_seeds_of_every_language(spark):
    """However many labelled sentences one language has, the others keep theirs."""
    rows = [("de", f"Satz {i} " + "wort " * 5) for i in range(3000)] + [("pt", "uma frase"), ("pt", "uma frase"), ("nl", None), (None, "x"), ("zz", "y" * 5000)]
    got = seeds(spark.createDataFrame(rows, "lang string, text string"), limit=2000)
    assert {lang for lang, _ in got} == {"de", "pt"} and [x for x in got if x[0] == "pt"] == [("pt", "uma frase")]
    size = sum(len(t) for lang, t in got if lang == "de")
    assert 1900 < size <= 2000


def test_quotations_and_tags_of_any_length(spark):
    long = "x" * 100
    assert sentences_of(f'One two "{long} {long} {long}" three <b class="{long}">four</b>') == sentences_of("One two three four")
    assert [k for _, k in sentences_of('He said "one two three four" and "five" then')] == [8]
