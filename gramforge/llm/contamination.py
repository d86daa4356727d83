"""Evaluation passages in a corpus: an FM-index per shard of documents, searched for all passages.

A match is a run of at least half of an item's words that stands in a document in order, with at
most one word in eight changed, left out or added. Words are compared after Unicode, case, markup
and punctuation are folded away.

Each task turns its documents into shards of about ``SHARD_WORDS`` words, builds the FM-index of a shard and
searches phrases of the items backwards through the wavelet ranks, one word at a time, for all items
at once of which the shard has words enough. Located phrases are checked exactly by alignment; overlapping spans of an item are merged.

Of passages as defined none is lost: one of L words with k = L // 8 edits keeps at least one of any k + 1 disjoint phrases
whole. For each item the shortest phrases that are rare in the shard are taken, if every passage of the
item holds k + 1 disjoint ones; else all phrases of the length that every match must hold unbroken.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.fm_index import FMIndex
from gramforge.session import materialize

SHARD_WORDS = 400_000
EDIT_EVERY = 8
#: phrases found at most this often in a shard are rare
RARE = 40
#: characters of the items that the driver and every task hold at once; more are searched in several passes
PASS_CHARS = 20_000_000
_SPANS = "doc_id long, item_id long, start_word long, end_word long, item_words int, matched_words int, edits int"
#: markup that may stand within a word, and any other tag
_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|sup|sub|font|mark|small|code|tt|wbr)(?:\s[^<>\n]*)?/?>|(?<=\w)\*{1,3}(?=\w)", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_BROKEN = re.compile(r"(?<!\w)(\w++)[-\u2010\u00ad][ \t]*\r?\n[ \t]*(\w+)")  # a word broken at the end of a line
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")  # soft hyphen and spaces without width
_WORD = re.compile(r"[^\W_]+")
_HARD = re.compile(r"[^\x00-\x7f]")


def words_of(text: str | None, known: dict[str, int] | None = None) -> list[str]:
    """The words of a text; null and empty texts have none.

    Escaped markup is markup. A word broken at the end of a line is whole again if it is one of ``known``.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "*" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if known and "\n" in text:
        text = _BROKEN.sub(lambda m: m[1] + m[2] if _fold(m[1] + m[2]) in known else m[0], text)
    return _WORD.findall(_fold(text))


def _fold(text: str) -> str:
    if _HARD.search(text):
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).casefold())
    return text.lower() if text.isascii() else text


@dataclass
class _Items:
    ids: list[int]
    words: list[np.ndarray]  # of symbols > 1
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> _Items:
        vocabulary: dict[str, int] = {}
        ids, words = [], []
        for i, text in rows:
            w = [vocabulary.setdefault(x, len(vocabulary) + 2) for x in words_of(text)]
            if w:
                ids.append(i)
                words.append(np.array(w, np.int64))
        return cls(ids, words, vocabulary)

    def some(self, which: np.ndarray) -> _Items:
        return _Items([self.ids[i] for i in which], [self.words[i] for i in which], self.vocabulary)


def needed(n: int) -> int:
    """Words of an item of n words that a match covers at least."""
    return -(-n // 2)


@lru_cache(maxsize=None)
def unbroken(n: int) -> int:
    """Words in a row that every match of an item of n words holds unchanged."""
    return min(-(-(m - m // EDIT_EVERY) // (m // EDIT_EVERY + 1)) for m in range(needed(n), n + 1))


def _surely_hit(length: np.ndarray, n: int) -> bool:
    """Whether every passage of an item holds one more disjoint phrase than it may have edits.

    length[i]: words of the phrase that begins at i, 0 for none.
    """
    least = needed(n)
    ends = np.where(length > 0, np.arange(n) + length, 10 * n)
    first_end = np.minimum.accumulate(ends[::-1])[::-1].tolist() + [10 * n]  # the earliest end of a phrase beginning at i or later
    for start in range(n - least + 1):
        at, k = start, 0
        while True:
            m = max(least, EDIT_EVERY * k)  # the shortest passage with k edits
            if start + m > n:
                break
            at = first_end[min(at, n)]
            if at > start + m:
                return False
            k += 1
            if at >= n and start + max(least, EDIT_EVERY * k) <= n:
                return False
    return True


class _Search:
    """All items over one shard."""

    def __init__(self, items: _Items, top: int | None = None):
        self.items = items
        n = [len(w) for w in items.words]
        self.item = np.repeat(np.arange(len(n)), n)
        self.offset = np.concatenate([np.arange(k) for k in n])
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.flat = np.concatenate(items.words)
        self.top = top or int(self.flat.max())
        self.least = np.array([needed(k) - needed(k) // EDIT_EVERY for k in n])
        self.unbroken = [unbroken(k) for k in n]
        self.longest = max(self.unbroken)
        self.lengths = np.array(n)[self.item]

    def phrases(self, index: FMIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the items where a searched phrase begins, and its range of suffixes."""
        total = len(self.flat)
        lows, highs = [], []
        lo, hi = index.everything(total + 1)
        for g in range(1, self.longest + 1):
            # the phrase of g words that begins here is this word before the phrase of g - 1 words that begins next
            low, high = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
            at = np.flatnonzero((self.offset + g <= self.lengths) & (hi[1:] > lo[1:]))
            low[at], high[at] = index.extend(lo[at + 1], hi[at + 1], self.flat[at])
            lo, hi = low, high
            lows.append(low[:total])
            highs.append(high[:total])
        return self._choose(np.array(lows), np.array(highs))

    def _choose(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = high - low
        places, lo, hi = [], [], []
        for k, words in enumerate(self.items.words):
            a, b, n = self.start[k], self.start[k + 1], len(words)
            limit = self.unbroken[k]
            c = count[:limit, a:b]
            chosen = None
            length = np.zeros(n, np.int64)
            for g in range(1, limit + 1):
                fits = np.arange(n) + g <= n
                rare = (length == 0) & fits & (c[g - 1] <= RARE)
                length[rare] = g
                if _surely_hit(length, n):
                    chosen = length
                    break
            if chosen is None:
                chosen = np.where(np.arange(n) + limit <= n, limit, 0)
            i = np.flatnonzero(chosen)
            g = chosen[i] - 1
            found = c[g, i] > 0
            i, g = i[found], g[found]
            places.append(a + i)
            lo.append(low[g, a + i])
            hi.append(high[g, a + i])
        return np.concatenate(places), np.concatenate(lo), np.concatenate(hi)

    def run(self, ids: np.ndarray, words: np.ndarray, doc_start: np.ndarray, word_base: np.ndarray) -> list[tuple]:
        """Spans in the documents of a shard. words: symbols, 1 for a word of no item; doc_start: with the end."""
        # an item can only stand in a shard that has the words of its shortest passage, but for the edits
        present = np.zeros(self.top + 1, bool)
        present[words] = True
        present[1] = False
        have = np.add.reduceat(present[self.flat], self.start[:-1], dtype=np.int64)
        which = np.flatnonzero(have >= self.least)
        if not len(which):
            return []
        return (self if len(which) == len(self.items.ids) else _Search(self.items.some(which), self.top))._run(ids, words, doc_start, word_base)

    def _run(self, ids: np.ndarray, words: np.ndarray, doc_start: np.ndarray, word_base: np.ndarray) -> list[tuple]:
        text = np.concatenate([np.append(words[doc_start[i] : doc_start[i + 1]], 0) for i in range(len(ids))])
        raw = np.concatenate([np.append(np.arange(doc_start[i], doc_start[i + 1]), -1) for i in range(len(ids))])
        keep = np.ones(len(text), bool)
        keep[1:] = ~((text[1:] == 1) & (text[:-1] == 1))  # a run of foreign words can't be in a phrase
        text, raw = text[keep], raw[keep]
        index = FMIndex(text, self.top)
        place, lo, hi = self.phrases(index)
        size = hi - lo
        if not size.sum():
            return []
        which = np.repeat(place, size)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        at = raw[index.locate(rows)]
        doc = np.searchsorted(doc_start, at, side="right") - 1
        order = np.lexsort((at, doc, self.item[which]))
        which, at, doc = which[order], at[order], doc[order]
        item = self.item[which]
        windows: list[tuple[int, int, int, int]] = []
        for a, b in _groups(item):
            windows += self._windows(int(item[a]), at[a:b], doc[a:b], self.offset[which[a:b]], words, doc_start)
        out = []
        while windows:
            windows.sort(key=lambda x: (-len(self.items.words[x[0]]), x))
            rest: list[tuple[int, int, int, int]] = []
            for c in range(0, len(windows), 256):
                some = windows[c : c + 256]
                found = align_all([self.items.words[k] for k, *_ in some], [words[lo:hi] for _, _, lo, hi in some])
                for (k, d, lo, hi), best in zip(some, found):
                    if best:
                        base = lo - int(doc_start[d]) + int(word_base[d])
                        n = len(self.items.words[k])
                        out.append((int(ids[d]), self.items.ids[k], base + best[0], base + best[1], n, best[2], best[3]))
                        # another passage may stand before or after it
                        least = max(1, needed(n) - needed(n) // EDIT_EVERY)
                        rest += [(k, d, x, y) for x, y in ((lo, lo + best[0]), (lo + best[1], hi)) if y - x >= least]
            windows = rest
        return out

    def _windows(self, k: int, at: np.ndarray, doc: np.ndarray, offset: np.ndarray, words: np.ndarray, doc_start: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, document, first word, end): where an item can stand, with enough of its words near the phrases found."""
        w = self.items.words[k]
        n = len(w)
        least, band = needed(n), n // EDIT_EVERY
        one = np.unique(np.stack([doc, at - offset]), axis=1)
        doc, diagonal = one[0], one[1]
        kept = []
        for c in range(0, len(doc), 4096):
            d, g = doc[c : c + 4096], diagonal[c : c + 4096]
            pos = (g - band)[:, None] + np.arange(n + 2 * band)
            near = np.where((pos >= doc_start[d][:, None]) & (pos < doc_start[d + 1][:, None]), words[np.clip(pos, 0, len(words) - 1)], 0)
            hit = near[:, :n] == w
            for s in range(1, 2 * band + 1):
                hit |= near[:, s : s + n] == w
            kept.append(np.flatnonzero(hit.sum(axis=1) >= least - least // EDIT_EVERY) + c)
        kept = np.concatenate(kept)
        doc, diagonal = doc[kept].tolist(), diagonal[kept].tolist()
        out, begin = [], 0
        for i in range(1, len(doc) + 1):
            if i == len(doc) or doc[i] != doc[begin] or diagonal[i] - diagonal[i - 1] > 2 * band + 1:
                d = doc[begin]
                out.append((k, d, max(int(doc_start[d]), diagonal[begin] - band), min(int(doc_start[d + 1]), diagonal[i - 1] + n + band + 1)))
                begin = i
        return out


def align_all(items: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[int, int, int, int] | None]:
    """For each item and text the longest passage: (start, end, item words covered, edits); None without a match.

    ``items`` come longest first. A state is the item words covered by an alignment that ends at an item word and a
    text word with e edits, times 2^32, plus where it began: the greatest state is the longest alignment.
    """
    size = len(items)
    n = np.array([len(x) for x in items])
    m = max(len(x) for x in texts)
    text = np.full((size, m), -1, np.int64)
    for r, x in enumerate(texts):
        text[r, : len(x)] = x
    item = np.full((size, int(n[0])), -2, np.int64)
    for r, x in enumerate(items):
        item[r, : len(x)] = x
    most = int(n[0]) // EDIT_EVERY
    one, none = 1 << 32, -(1 << 60)
    least = -(-n // 2)
    fresh = np.arange(m + 1)
    old = np.full((most + 1, size, m + 1), none, np.int64)
    old[0] = fresh
    best: list[tuple[int, int, int, int] | None] = [None] * size
    for i in range(int(n[0])):
        live = int((n > i).sum())
        old = old[:, :live]
        new = np.empty_like(old)
        equal = text[:live] == item[:live, i, None]
        for e in range(most + 1):
            x = new[e]
            x[:, 0] = none
            np.copyto(x[:, 1:], np.where(equal, old[e, :, :-1] + one, none))
            if e:
                before = old[e - 1] + one
                np.maximum(x[:, 1:], before[:, :-1], out=x[:, 1:])  # changed
                np.maximum(x, before, out=x)  # left out
                np.maximum(x[:, 1:], new[e - 1, :, :-1], out=x[:, 1:])  # added
        top = new.max(axis=2)  # edits x rows
        np.maximum(new[0], fresh, out=new[0])  # a passage may begin after any item word
        covered = top >> 32
        fits = (covered >= least[:live]) & (covered >= EDIT_EVERY * np.arange(most + 1)[:, None])
        for e, r in zip(*np.nonzero(fits)):
            c = int(covered[e, r])
            if best[r] is None or (c - e, -e) > (best[r][2] - best[r][3], -best[r][3]):
                best[r] = (int(top[e, r]) & (one - 1), int(new[e, r].argmax()), c, int(e))
        old = new
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int] | None:
    """``align_all`` of one item and text."""
    return align_all([item], [text])[0] if len(text) else None


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(keys)]))


def leaked_spans(documents: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, pass_chars: int = PASS_CHARS) -> DataFrame:
    """Where items stand in documents: doc_id, item_id, start_word, end_word (of the document's words), item_words, matched_words, edits.

    ``documents``: doc_id, text; ``items``: item_id, text (a stated query set, in passes over the documents of about
    PASS_CHARS characters of items each). Null and empty texts hold nothing and are held by nothing; repeated documents
    come out each; a document longer than a shard is searched in overlapping pieces.
    """
    sound = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    passes = max(1, -(-(sound.agg(F.sum(F.length("text"))).first()[0] or 0) // pass_chars))
    if passes == 1:
        return _search_pass(documents, sound, shard_words)
    part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    spans = [materialize(_search_pass(documents, sound.where(part == p), shard_words), "spans") for p in range(passes)]
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _search_pass(documents: DataFrame, items: DataFrame, shard_words: int) -> DataFrame:
    query = _Items.of(sorted((r[0], r[1]) for r in items.collect()))
    if not query.ids:
        return documents.sparkSession.createDataFrame([], _SPANS)
    overlap = 3 * max(map(len, query.words))
    sent = documents.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: _Items = sent.value
        search = _Search(query)
        symbol = query.vocabulary.get
        ids: list[int] = []
        words: list[np.ndarray] = []
        bases: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch | None:
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            spans = search.run(np.array(ids), np.concatenate(words), starts, np.array(bases))
            ids.clear(), words.clear(), bases.clear()
            if not spans:
                return None
            names = [x.split()[0] for x in _SPANS.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*spans), kinds)], names=names)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array([symbol(x, 1) for x in words_of(text, query.vocabulary)], np.int64)
                for base in range(0, max(1, len(w) - overlap), shard_words):
                    part = w[base : base + shard_words + overlap]
                    if len(part) < 1:
                        continue
                    ids.append(i)
                    words.append(part)
                    bases.append(base)
                    held += len(part)
                    if held >= shard_words:
                        if (out := flush()) is not None:
                            yield out
                        held = 0
        if held and (out := flush()) is not None:
            yield out

    spans = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SPANS)
    return spans


def removal_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document merged: doc_id, start_word, end_word, items (distinct, sorted)."""
    one = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word", "item_id"))).alias("s"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<start_word:bigint,end_word:bigint,items:array<bigint>>>), (acc, x) ->"
        " if(size(acc) > 0 and element_at(acc, -1).end_word >= x.start_word,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start_word', element_at(acc, -1).start_word, 'end_word', greatest(element_at(acc, -1).end_word, x.end_word), 'items', array_sort(array_union(element_at(acc, -1).items, array(x.item_id)))))),"
        " concat(acc, array(named_struct('start_word', x.start_word, 'end_word', x.end_word, 'items', array(x.item_id))))))"
    )
    return one.select("doc_id", F.explode(merged).alias("m")).select("doc_id", "m.*")
