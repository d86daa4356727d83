import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.llm.contamination import _surely_hit, align, leaked_spans, needed, removal_spans, unbroken, words_of
from gramforge.llm.fm_index import FMIndex, suffix_array


def test_fm_index_against_search():
    r = np.random.default_rng(0)
    for _ in range(120):
        s = r.integers(0, r.integers(2, 6), r.integers(1, 60))
        t = [*(s + 1).tolist(), 0]
        assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        index = FMIndex(s)
        for _ in range(5):
            p = r.integers(0, s.max() + 1, r.integers(1, 5))
            lo, hi = index.everything(1)
            for c in p[::-1]:
                lo, hi = index.extend(lo, hi, np.array([c]))
            want = [i for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def brute_match(item, text):
    """Exhaustive: does some passage of enough words stand in the text with few enough edits?"""
    n = len(item)
    for i in range(n):
        for j in range(i + needed(n), n + 1):
            passage, most = item[i:j], (j - i) // 8
            row = [0] * (len(text) + 1)
            for a in passage:
                new = [row[0] + 1]
                for k, b in enumerate(text):
                    new.append(min(row[k] + (a != b), row[k + 1] + 1, new[k] + 1))
                row = new
            if min(row) <= most:
                return True
    return False


def damage(r, words, rate):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(r.randrange(100, 200) if x < 2 * rate / 3 else w)
        if x > 1 - rate / 3:
            out.append(r.randrange(100, 200))
    return out


def test_alignment_against_exhaustive_search():
    r = random.Random(4)
    seen = set()
    for _ in range(250):
        item = [r.randrange(2, 30) for _ in range(r.randint(4, 26))]
        part = item[r.randrange(len(item)) :] if r.random() < 0.6 else item
        text = [r.randrange(2, 40) for _ in range(r.randrange(8))] + damage(r, part, r.choice([0, 0.1, 0.2])) + [r.randrange(2, 40) for _ in range(r.randrange(8))]
        got = align(np.array(item), np.array(text, dtype=np.int64)) is not None
        assert got == brute_match(item, text)
        seen.add(got)
    assert seen == {True, False}


def test_guarantee_of_phrases():
    """If phrases are said to hit every passage, no choice of edits destroys them all in a passage."""
    r = random.Random(5)
    checked = 0
    for _ in range(300):
        n = r.randint(8, 20)
        length = np.array([r.choice([0, 0, 1, 2]) if i < n - 1 else 0 for i in range(n)])
        if not _surely_hit(length, n):
            continue
        for i in range(n):
            for j in range(i + needed(n), n + 1):
                inside = [(a, a + int(g)) for a, g in enumerate(length) if g and a >= i and a + g <= j]
                k, stabs, end = (j - i) // 8, 0, -1
                for a, b in sorted(inside, key=lambda x: x[1]):
                    if a >= end:
                        stabs, end = stabs + 1, b
                assert stabs > k
                checked += 1
    assert checked > 100


def test_words():
    assert words_of("<S> L'un </S> **B­o­b** <em>é</em> &amp; A_B 1,5") == ["l", "un", "bob", "é", "a", "b", "1", "5"]
    assert words_of(None) == [] and words_of(" .,") == []
    assert unbroken(26) <= 7 and needed(7) == 4


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(base) if r.random() < 0.7 else f"name{i}x{r.randrange(99)}" for _ in range(r.randint(12, 50)))) for i in range(25)] + [(98, None), (99, "")]
    docs, truth = [], set()
    for d in range(160):
        words = [r.choice(base) for _ in range(r.randrange(0, 80))]
        if d % 2:
            i, text = items[r.randrange(25)]
            w = text.split()
            kind = r.choice(["whole", "half", "short", "mixed"])
            part = {"whole": w, "half": w[: needed(len(w)) + 1], "short": w[: max(2, len(w) // 4)], "mixed": r.sample(w, len(w))}[kind]
            if kind == "whole" and r.random() < 0.5:
                part = [x if k % 9 else "changed" for k, x in enumerate(part, 1)]
            words = words + [f"*{x.upper()}*," for x in part] + words
        docs.append((d, " ".join(words)))
    ids = {}
    sym = lambda t: [ids.setdefault(x, len(ids)) for x in words_of(t)]
    for d, t in docs:
        for i, x in items:
            if x and brute_match(sym(x), sym(t)):
                truth.add((d, i))
    return spark.createDataFrame([*docs, (500, None), (501, "")], "doc_id long, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"), truth


@pytest.mark.parametrize("shard", [500, 100_000])
def test_found_against_exhaustive_search(case, shard):
    docs, items, truth = case
    spans = leaked_spans(docs, items, shard)
    assert {(r["doc_id"], r["item_id"]) for r in spans.collect()} == truth
    assert len(truth) > 20


def test_spans(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "eta theta iota kappa lambda mu")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu y"), (2, "mu lambda"), (1, "none of it")], "doc_id long, text string")
    spans = {(r["item_id"], r["start_word"], r["end_word"], r["edits"]) for r in leaked_spans(docs, items).collect()}
    assert spans == {(1, 1, 9, 0), (2, 7, 13, 0)}
    merged = removal_spans(leaked_spans(docs, items)).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"], list(r["items"])) for r in merged] == [(1, 1, 13, [1, 2])]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaked_spans(docs.limit(0), items).count() == 0 and leaked_spans(docs, items.limit(0)).count() == 0


def test_long_text_in_pieces(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    filler = " ".join(f"f{i % 977}" for i in range(30_000))
    docs = spark.createDataFrame([(1, f"{filler} {passage} {filler}")], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    got = {(r["start_word"], r["end_word"]) for r in leaked_spans(docs, items, 2_000).collect()}
    assert got == {(30_000, 30_040)}


def test_two_passages_of_an_item_close_together(spark):
    w = [f"p{i}" for i in range(80)]
    between = [f"x{i}" for i in range(15)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["a", *w[:40], *between, *w[40:], "b"]))], "doc_id long, text string")
    assert {(r["start_word"], r["end_word"]) for r in removal_spans(leaked_spans(docs, items)).collect()} == {(1, 41), (56, 96)}


def test_folding():
    same = lambda a, b, known=None: words_of(a, known) == words_of(b, known)
    assert same("STRASSE", "straße") and same("ΣΊΣΥΦΟΣ", "σίσυφος") and same("ﬁne", "FINE")
    assert same("&lt;S&gt; a word &lt;/S&gt;", "a word") and same(f'a <b class="{"x" * 200}">word</b>', "a word")
    assert same("w<b>or</b>d **wo**rd", "word word") and same("one<br>two", "one two")
    assert words_of("the coun-\n  ter and well-\nknown", {"counter": 2, "well": 3, "known": 4}) == ["the", "counter", "and", "well", "known"]


def test_items_in_several_passes(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 30)))) for i in range(60)]
    docs = [(i, " ".join([word() for _ in range(20)] + items[i % 60][1].split() + [word() for _ in range(5)])) for i in range(90)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, leaked_spans(d, t).collect()))
    assert one == sorted(map(tuple, leaked_spans(d, t, pass_chars=2000).collect())) and {(x[0], x[1]) for x in one} == {(i, i % 60) for i in range(90)}
