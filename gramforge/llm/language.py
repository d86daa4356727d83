"""Languages of documents and segments by compression: the language whose dictionary compresses best.

Each language has a raw-content zstandard dictionary. A sentence is encoded with every dictionary and goes to
the smallest; a narrow margin is rejected, and the sentence then follows its neighbours among the languages
that are as good. Dictionaries start from labelled sentences and are widened twice with sentences of the
documents, which get the language that their texts as a whole are encoded best in: Spark counts the votes of all
texts, and only the sentences with most votes of each language reach the driver. The documents' own labels are not
used, as they are unreliable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.session import materialize

#: bytes of a dictionary, and of the labelled sentences of a language that it starts from, at most: those with the lowest hashes
DICTIONARY_BYTES, SEED_BYTES = 48_000, 24_000
#: share and bytes by which the smallest code must beat the next, else the sentence is rejected
MARGIN, MARGIN_BYTES = 0.06, 3
#: for widening: how far below the next a text's code in its main language is, how many votes count as several, and what a majority is
CLEAR_TEXT, SEVERAL, MAJORITY = 0.85, 3, 0.7
#: share of its bytes that a sentence's code under the seed must exceed to be worth a place
NEW = 0.25
#: words in another language that make a document mixed
MIXED_WORDS = 12
#: names and codes of the languages (fixed values: ISO 639-1, 639-2/B, 639-2/T, English and own names)
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "ger", "deu", "german", "deutsch"],
    "fr": ["fr", "fre", "fra", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "dut", "nld", "dutch", "nederlands"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
}
_QUOTE = re.compile('["«„“]')
#: quotations of up to three words, however long these are; straight quotes stand at words, as they don't tell begin from end
_QUOTES = re.compile(r'"(?:[^"\s]+\s+){0,2}[^"\s]+"|«\s*(?:[^»\s]+\s+){0,2}[^»\s]*\s*»|„\s*(?:[^“”\s]+\s+){0,2}[^“”\s]*\s*[“”]|“\s*(?:[^”\s]+\s+){0,2}[^”\s]*\s*”')
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_COUNTS = re.compile(r"^[^\t]*(\t\d+)+\s*$")
_SPLIT = re.compile(r"(?<=[.!?])[\s\"*]+")
_WORD = re.compile(r"[^\W\d_]+")
_HARD = re.compile(r"[^\x00-\x7f]")
_MARKS = re.compile("[\u0300-\u036f\u00ad]")  # combining marks, soft hyphen
#: encoded sentences that a task remembers
MEMORY = 200_000
_SEGMENTS = "doc_id long, segment int, lang string, confidence double, words int, sentences int, first_sentence int"


def label_language(label: Column) -> Column:
    """The language a label names in any spelling (code, name, region), null if it names none of those known."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_\s]+)", 1)
    known = F.create_map(*(F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)))
    return F.try_element_at(known, base)


def sentences_of(text: str | None) -> list[tuple[bytes, int]]:
    """Sentences as they are encoded (words without case and accents between single spaces), with their number of words.

    Count-file lines, headings (lines of fewer than three words) and quotations of up to three words are left out.
    """
    if not text:
        return []
    text = text.lower()
    if _HARD.search(text):
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if _QUOTE.search(text):
        text = "\n".join(_QUOTES.sub(" ", line) for line in text.splitlines())
    out = []
    for line in text.splitlines():
        if "\t" in line and _COUNTS.match(line):
            continue
        rest = [w for s in _SPLIT.split(line) if (w := _WORD.findall(s))]
        if sum(map(len, rest)) >= 3:
            out += [(f" {' '.join(w)} ".encode(), len(w)) for w in rest]
    return out


def fold(sentence: str) -> bytes:
    """A sentence as ``sentences_of`` gives it, whatever its length."""
    return f" {' '.join(_WORD.findall(_MARKS.sub('', unicodedata.normalize('NFKD', sentence.lower()))))} ".encode()


class Coder:
    """Code sizes of sentences under the dictionary of each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.languages = sorted(dictionaries)
        self.coders = []
        for k in self.languages:
            d = z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters(strategy=z.STRATEGY_DFAST, min_match=4, search_log=1, window_log=17, hash_log=13, chain_log=13, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            self.coders.append(z.ZstdCompressor(dict_data=d, compression_params=p))
        self.known: dict[bytes, tuple[int, ...]] = {}

    def size(self, folded: bytes, language: int) -> int:
        return max(1, len(self.coders[language].compress(folded)) - 9)

    def sizes(self, folded: list[bytes]) -> np.ndarray:
        """Bytes of each sentence in each language, without frame and block headers."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        new = list({s: None for s in folded if s not in known})
        if new:
            columns = [[max(1, len(x) - 9) for x in c.multi_compress_to_buffer(new, threads=1)] for c in self.coders]
            known.update(zip(new, zip(*columns)))
        out = [known[s] for s in folded]
        return np.array(out, np.float64).reshape(len(folded), len(self.coders))


def _shares(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, whether its margin to the next is wide enough, and a confidence from the differences in bytes, for each sentence."""
    order = np.argsort(sizes, axis=1, kind="stable")
    two = np.take_along_axis(sizes, order[:, :2], 1)
    gap = two[:, 1] - two[:, 0]
    bits = np.exp2(-np.minimum(sizes - sizes.min(axis=1, keepdims=True), 60.0))
    return order[:, 0], (gap >= MARGIN * two[:, 1]) & (gap >= MARGIN_BYTES), bits.max(axis=1) / bits.sum(axis=1)


def votes_of(coder: Coder, folded: list[bytes]) -> list[tuple[bytes, int, int]]:
    """For the sentences of a text: (sentence, main language of the text, languages that encode it alone best, as bits); none if no language of the text is clear.

    All sentences of a text decide together on its main language.
    """
    if not folded:
        return []
    sizes = coder.sizes(folded)
    total = sizes.sum(axis=0)
    main = int(total.argmin())
    if total[main] > CLEAR_TEXT * np.sort(total)[1]:
        return []
    least = (sizes <= sizes.min(axis=1, keepdims=True)) @ (1 << np.arange(sizes.shape[1]))
    return [(f, main, k) for f, k in zip(folded, least.tolist())]


def _extend(seed: dict[str, bytes], chosen: list[tuple[str, bytes]], limit: int) -> dict[str, bytes]:
    """The seed's dictionaries with as many of the chosen sentences (language, sentence), most votes first, as there is room for."""
    out = {k: [v] for k, v in seed.items()}
    room = {k: limit - len(v) for k, v in seed.items()}
    for k, f in chosen:
        if room[k] >= len(f):
            out[k].append(f)
            room[k] -= len(f)
    return {k: b"".join(reversed(v)) for k, v in out.items()}  # what is seen most stands last, where matches are cheapest


def _is_new(first: Coder, sentence: bytes, language: int) -> bool:
    """What the seed encodes well needs no place."""
    return first.size(sentence, language) > NEW * len(sentence)


def widen(seed: dict[str, bytes], now: dict[str, bytes], texts: list[str], limit: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The seed's dictionaries with sentences of ``texts``.

    A sentence votes for the main language of its text. One that
    stands in several texts goes to the language with most votes, whatever the dictionaries say of it alone: mixed texts
    are few. One seen less often is taken only if its own code agrees with its text.
    """
    from xxhash import xxh3_128_digest

    coder, first = Coder(now), Coder(seed)
    votes: dict[bytes, dict[int, int]] = {}
    least: dict[bytes, int] = {}
    for text in dict.fromkeys(texts):  # a copied text votes once
        for f, main, k in votes_of(coder, [f for f, _ in sentences_of(text)]):
            by = votes.setdefault(f, {})
            by[main] = by.get(main, 0) + 1
            least[f] = k
    ranked = []
    for f, by in votes.items():
        pick, most = max(by.items(), key=lambda x: x[1])
        total = sum(by.values())
        if most >= MAJORITY * total and (most >= SEVERAL or least[f] >> pick & 1) and _is_new(first, f, pick):
            ranked.append((-total, xxh3_128_digest(f), f, coder.languages[pick]))
    return _extend(seed, [(k, f) for _, _, f, k in sorted(ranked)], limit)


def parsed_texts(documents: DataFrame) -> DataFrame:
    """The sentences (s) of each different text, written once for all rounds: a copied text votes once."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [some for text in batch.column(0).to_pylist() if (some := [f for f, _ in sentences_of(text)])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.binary()))], names=["s"])

    texts = documents.where(F.col("text").isNotNull()).select("text").distinct()
    return materialize(texts.mapInArrow(parse, "s array<binary>"), "sentences")


def widen_from(seed: dict[str, bytes], now: dict[str, bytes], texts: DataFrame, limit: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """``widen`` with all rows of ``parsed_texts``.

    Sentences are counted by a 128-bit hash; the texts of those chosen, no more than the dictionaries hold, are fetched at the end.
    """
    languages = sorted(seed)
    sent = texts.sparkSession.sparkContext.broadcast((seed, now))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        coder, first = Coder(sent.value[1]), Coder(sent.value[0])
        for batch in batches:
            counts: dict[tuple[bytes, int], list] = {}
            for folded in batch.column(0).to_pylist():
                for f, main, least in votes_of(coder, folded):
                    seen = counts.get((f, main))
                    if seen is None:
                        counts[f, main] = [1, least, _is_new(first, f, main)]
                    else:
                        seen[0] += 1
            if counts:
                columns = [[xxh3_128_digest(f) for f, _ in counts], [m for _, m in counts], [len(f) for f, _ in counts], *zip(*counts.values())]
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["h", "main", "bytes", "n", "least", "fresh"])

    # one shuffle, by sentence: a column of votes for each language
    by = [F.sum(F.when(F.col("main") == k, F.col("n")).otherwise(0)) for k in range(len(languages))]
    fresh = [F.bool_or(F.when(F.col("main") == k, F.col("fresh")).otherwise(False)) for k in range(len(languages))]
    votes = texts.mapInArrow(vote, "h binary, main int, bytes int, n long, least int, fresh boolean").groupBy("h", "bytes").agg(F.array(*by).alias("by"), F.array(*fresh).alias("fresh"), F.sum("n").alias("total"), F.max("least").alias("least"))
    most = F.array_max("by")
    picked = votes.select("h", "bytes", (F.array_position("by", most) - 1).cast("int").alias("pick"), "total", most.alias("most"), "least", "fresh")
    clear = picked.where((F.col("most") >= MAJORITY * F.col("total")) & ((F.col("most") >= SEVERAL) | (F.expr("shiftright(least, pick) & 1") == 1)) & F.expr("fresh[pick]") & (F.col("bytes") <= limit))
    ranked = materialize(clear.select("h", "bytes", "pick", "total"), "language-votes")
    chosen: dict[bytes, tuple[int, str]] = {}
    for k, lang in enumerate(languages):
        room = limit - len(seed[lang])
        # a sentence has three bytes at least
        for r in ranked.where(F.col("pick") == k).orderBy(F.desc("total"), "h").limit(limit // 3).select("h", "bytes").collect():
            if r["bytes"] <= room:
                chosen[bytes(r["h"])] = (len(chosen), lang)
                room -= r["bytes"]
    asked = texts.sparkSession.sparkContext.broadcast(frozenset(chosen))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            found = {f for folded in batch.column(0).to_pylist() for f in folded if xxh3_128_digest(f) in asked.value}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["f"])

    from xxhash import xxh3_128_digest

    texts_of = {xxh3_128_digest(f): f for r in texts.mapInArrow(fetch, "f binary").distinct().collect() for f in [bytes(r[0])]}
    return _extend(seed, [(lang, texts_of[h]) for h, (_, lang) in sorted(chosen.items(), key=lambda x: x[1])], limit)


def _train(samples: list[tuple[str, str]], rounds: int, wider: Callable[[dict[str, bytes], dict[str, bytes]], dict[str, bytes]]) -> dict[str, bytes]:
    seed: dict[str, bytes] = {}
    for lang, text in samples:
        if lang and text:
            seed[lang] = seed.get(lang, b"") + fold(text)
    now = seed
    for _ in range(rounds):
        now = wider(seed, {k: (now[k] + v if now is not seed else v) for k, v in seed.items()})
    return now


def train(samples: list[tuple[str, str]], texts: list[str], rounds: int = 2) -> dict[str, bytes]:
    """Dictionaries of all languages, from labelled sentences and unlabelled texts."""
    return _train(samples, rounds if texts else 0, lambda seed, now: widen(seed, now, texts))


def assign(sizes: np.ndarray, best: np.ndarray, sure: np.ndarray) -> list[int]:
    """A language per sentence of a text: the best, or where rejected what its neighbours or the text have among the equally good."""
    lang = best.tolist()
    if sure.all():
        return lang
    main = int(sizes.sum(axis=0).argmin())
    certain = sure.tolist()
    for i in np.flatnonzero(~sure).tolist():
        near = sizes[i] <= max(sizes[i].min() / (1 - MARGIN), sizes[i].min() + MARGIN_BYTES)
        after = next((lang[j] for j in range(i + 1, len(lang)) if certain[j]), -1)
        lang[i] = next((x for x in (lang[i - 1] if i else -1, after, main) if x >= 0 and near[x]), lang[i])
    return lang


def segments(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Runs of sentences in one language: doc_id, segment, lang, confidence, words, sentences, first_sentence.

    Null and empty texts and texts without a sentence have no segment; repeated documents come out each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dictionaries)
        names = [x.split()[0] for x in _SEGMENTS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            rows: list[tuple] = []
            texts = [(i, some) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (some := sentences_of(text))]
            if not texts:
                continue
            sizes = coder.sizes([s for _, some in texts for s, _ in some])
            best, sure, conf = _shares(sizes)
            at = 0
            for i, some in texts:
                here = slice(at, at + len(some))
                lang, c = assign(sizes[here], best[here], sure[here]), conf[here].tolist()
                at += len(some)
                begin, k = 0, 0
                for j in range(1, len(some) + 1):
                    if j == len(some) or lang[j] != lang[begin]:
                        words = sum(w for _, w in some[begin:j])
                        rows.append((i, k, coder.languages[lang[begin]], sum(c[x] * some[x][1] for x in range(begin, j)) / words, words, j - begin, begin))
                        begin, k = j, k + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SEGMENTS)


def seeds(samples: DataFrame, limit: int = SEED_BYTES) -> list[tuple[str, str]]:
    """(lang, text) of labelled sentences: of each language those with the lowest hashes, at most ``limit`` bytes in all.

    A language with far more is thinned out by hash first, so that no task gets all of it. Sentences longer than the limit are left out.
    """
    from pyspark.sql import Window

    known = samples.where("lang is not null and text is not null").select("lang", "text").distinct().select("*", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h")).where(F.col("bytes") <= limit)
    whole = known.groupBy("lang").agg(F.sum("bytes").alias("all"))
    share = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("all")  # the bytes before it, about
    few = known.join(F.broadcast(whole), "lang").where(share <= 8.0 * limit)
    before = F.sum("bytes").over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return [(r[0], r[1]) for r in few.withColumn("sum", before).where(F.col("sum") <= limit).orderBy("lang", "text").select("lang", "text").collect()]


def train_from(documents: DataFrame, samples: DataFrame, rounds: int = 2) -> dict[str, bytes]:
    """Dictionaries from labelled sentences and all documents."""
    texts = parsed_texts(documents)
    return _train(seeds(samples), rounds, lambda seed, now: widen_from(seed, now, texts))


def document_languages(parts: DataFrame) -> DataFrame:
    """doc_id, lang, words, confidence, rank (1: the main language, by words, ties by language)."""
    from pyspark.sql import Window

    total = parts.groupBy("doc_id", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("words"), "lang")))
