import random

import pytest
from pyspark.sql import functions as F

from gramforge.llm.encoding import damaged_ids, damaged_rows, decipher, find_damage, sources


def swap(text, written, read):
    try:
        return text.encode(written).decode(read)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def test_every_source_is_undone():
    names = sources()
    for written, read in (("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1250", "latin-1"), ("koi8-r", "cp1251")):
        for word in ("gigéta", "kuş", "книга", "über"):
            bad = swap(word, written, read)
            if bad and bad != word and bad.isprintable():
                assert word in decipher(bad)
                assert (written, read, 1) in [names[s] for s in decipher(bad)[word]]


@pytest.fixture(scope="module")
def made(spark):
    """A language of syllables with accented letters, of which some rows are damaged."""
    r = random.Random(7)
    vowels, consonants = "aeiouéèùôüñ", "bdfgklmnrstv"
    words = ["".join(r.choice(consonants) + r.choice(vowels) for _ in range(r.choice([2, 3]))) for _ in range(400)] + ["книга", "слово", "Λέξη"]
    rows, truth = [], {}
    kinds = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850")]
    for i in range(12_000):
        text = " ".join(words[min(int(r.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(r.choice([2, 3]))) + r.choice(["", "", "", " √", " ©", " 20°"])
        if r.random() < 0.03:
            w, k = r.choice(kinds)
            bad = swap(text, w, k)
            if bad and bad != text:
                truth[i], text = text, bad
        rows.append((i, text))
    lost = swap("gigéta", "cp1252", "latin-1").encode("latin-1").decode("utf-8", "replace")
    rows += [(20_000, None), (20_001, ""), (20_002, lost + " x"), (20_003, "gigéta x"), (20_004, "gigéta  y"), (20_005, lost + " x")]
    df = spark.createDataFrame(rows, "row_id long, ngram string").withColumn("token", F.lit("clash")).withColumn("count", F.lit(1))
    return df, truth


def test_found_and_restored(made):
    df, truth = made
    damage = find_damage(df).tokens
    got = {r["row_id"]: r for r in damaged_rows(df, damage).collect()}
    assert sorted(r[0] for r in damaged_ids(df, damage).collect()) == sorted(got)
    assert {20_002, 20_005} <= set(got) and got[20_002]["restored"] == "gigéta x"
    found = set(got) - {20_002, 20_005}
    right = found & set(truth)
    assert len(right) >= 0.97 * len(found) and len(right) >= 0.95 * len(truth)
    restored = sum(got[i]["restored"] == truth[i] for i in right)
    assert restored >= 0.95 * len(right)


def test_clean_and_empty(spark):
    clean = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "é √", "über ©", None, "", "é √"])], "row_id long, ngram string")
    assert damaged_rows(clean, find_damage(clean).tokens).count() == 0
    assert damaged_rows(clean.limit(0), find_damage(clean.limit(0)).tokens).count() == 0
    long = spark.createDataFrame([(1, "é" * 50_000 + " " + "x " * 50_000)], "row_id long, ngram string")
    assert damaged_rows(long, find_damage(long).tokens).count() == 0


LATIN, CYRILLIC = "aeiounsrtlkdmgbvfpéèùôüñäøşõ", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф"


def _vocabulary(r, letters, size):
    """Words of a language in which each letter is followed by some letters more than by others."""
    often = [1 / (i + 2) for i in range(len(letters))]
    after = {a: [r.random() ** 4 * f for f in often] for a in letters}
    words = []
    while len(words) < size:
        w = r.choices(letters, often)[0]
        while len(w) < 3 or (r.random() < 0.78 and len(w) < 10):
            w += r.choices(letters, after[w[-1]])[0]
        words.append(w)
    return words


def _permutation(r):
    """The high half of a page read with its bytes in any order."""
    high = [bytes([b]).decode("latin-1") for b in range(0xA1, 0x100)]
    other = high[:]
    r.shuffle(other)
    return str.maketrans("".join(high), "".join(other))


@pytest.mark.parametrize("kind", ["koi8-r read as mac_cyrillic", "cp855 read as cp866", "latin-1, bytes in any order", "utf-8 read as hp_roman8"])
def test_pages_that_no_table_covers(spark, kind):
    """The mapping is learned from an open start: found and restored as well as pages that are known."""
    r = random.Random(11)
    cyrillic = "cp855" in kind or "koi8" in kind
    words = _vocabulary(r, CYRILLIC if cyrillic else LATIN, 600)
    if "any order" in kind:
        order = _permutation(r)
        damaged = lambda t: t.translate(order) if all(ord(c) < 256 for c in t) else t
    else:
        written, read = kind.split(" read as ")
        damaged = lambda t: swap(t, written, read) or t
    rows, truth = [], {}
    for i in range(12_000):
        text = " ".join(words[min(int(r.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(r.choice([2, 3])))
        if r.random() < 0.03 and (bad := damaged(text)) != text:
            truth[i], text = text, bad
        rows.append((i, text))
    found = find_damage(spark.createDataFrame(rows, "row_id long, ngram string"))
    assert any(c.name.startswith("learned") for c in found.solved.model.ciphers)
    got = {x["row_id"]: x["restored"] for x in damaged_rows(spark.createDataFrame(rows, "row_id long, ngram string"), found.tokens).collect()}
    both = set(got) & set(truth)
    assert len(both) >= 0.95 * len(truth) and len(both) >= 0.95 * len(got), (len(got), len(truth), len(both))
    assert sum(got[i] == truth[i] for i in both) >= 0.95 * len(both)
