"""Pairs of items in the same record: heavy-light decomposition.

Items in at least ``heavy_share`` of the records are heavy; there are at most (mean record size /
heavy_share) of them, whatever the size of the data. Pairs of heavy items are counted on dense
bit-matrices: popcounts of ANDed rows, and of the same against the bit-planes of the weights. Pairs of
a heavy and a light item are counted by probing the heavy bits at the light item's positions. Pairs
of light items are counted by hash. Items in too few records for any pair are taken out before, by a bitmap of the hashes of the
others: of fixed size, and a rare item that it lets pass is found out later. Each block emits sums, which Spark adds up before and after one
shuffle on the pair. All three parts are exact and complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 200
#: heavy items at most, the most frequent ones: two matrices of 67 MB in all for a task; items beyond them count as light ones
MAX_HEAVY = 2048
#: bits of the bitmap of items that may be in a pair (2 MB), and pair codes held before they are summed
MAP_BITS, HELD = 1 << 24, 4_000_000
#: rows of a bit-matrix block, and light positions probed at once
BLOCK, PROBE = 32_768, 8_192
_PAIRS = "term_a string, term_b string, records long, weight long"


def _sums(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes with their number and summed weight."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    if not len(at):
        return code, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return code[at], np.diff(np.concatenate([at, [len(code)]])), np.add.reduceat(weight[order], at)


def _named(names: list[str], code: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple:
    return [names[c // len(names)] for c in code.tolist()], [names[c % len(names)] for c in code.tolist()], n, w


def _hashes(names: list[str], bits: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(t) % bits for t in names], np.int64)


def frequent_map(stats: DataFrame, least: int, size: int = MAP_BITS) -> np.ndarray:
    """A bitmap of the hashes of all items (term, records) in at least ``least`` records: at most ``size`` / 64 rows reach the driver."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            for h in _hashes(b.column(0).to_pylist(), size).tolist():
                found[h >> 6] = found.get(h >> 6, 0) | 1 << (h & 63)
        bits = np.array(list(found.values()), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(bits, pa.int64())], names=["word", "bits"])

    out = np.zeros(size >> 6, np.uint64)
    rows = stats.where(F.col("records") >= least).select("term").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    if rows:
        out[[r["word"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return out


class _Block:
    """Pair counts of up to BLOCK records at a time."""

    def __init__(self, heavy: list[str], ignored: set[str], frequent: np.ndarray | None = None):
        self.heavy, self.ignored, self.frequent = heavy, ignored, frequent
        self.index = {t: i for i, t in enumerate(heavy)}
        self.n = np.zeros((len(heavy), len(heavy)), np.int64)
        self.w = np.zeros_like(self.n)

    def add(self, terms: pa.ListArray, weight: np.ndarray) -> pa.RecordBatch | None:
        rows = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = pc.dictionary_encode(terms.flatten())
        names = coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy(zero_copy_only=False)
        place = np.array([-2 if t in self.ignored else self.index.get(t, -1) for t in names], np.int64)
        if self.frequent is not None:
            at = _hashes(names, len(self.frequent) << 6)
            place[(place == -1) & (self.frequent[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 0)] = -2
        h, size = place[ids], len(self.heavy)
        if size:
            dense = np.zeros((size, -(-len(terms) // 64) * 64), bool)
            dense[h[h >= 0], rows[h >= 0]] = True
            self._dense(dense, weight)
        light = h == -1
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        ordered = sorted(names)
        lr, li = rows[light], rank[ids[light]]
        out = []
        if size and len(lr):
            out += self._probe(dense, lr, li, weight, ordered)
        out += self._hashed(lr, li, weight, ordered)
        if not out:
            return None
        cols = [sum((list(x[i]) for x in out), []) for i in range(2)] + [np.concatenate([x[i] for x in out]) for i in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["term_a", "term_b", "records", "weight"])

    def _dense(self, dense: np.ndarray, weight: np.ndarray) -> None:
        bits = np.packbits(dense, axis=1).view(np.uint64)
        padded = np.zeros(dense.shape[1], np.int64)
        padded[: len(weight)] = weight
        top = int(padded.max(initial=0)).bit_length()
        planes = [np.packbits((padded >> p & 1).astype(bool)).view(np.uint64) for p in range(top)]
        negative = padded < 0
        if negative.any():
            raise ValueError("weights must not be negative")
        for a in range(len(self.heavy) - 1):
            both = bits[a] & bits[a + 1 :]
            hits = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            self.n[a, a + 1 :] += hits
            some = np.flatnonzero(hits)
            if len(some):
                both = both[some]
                words = np.flatnonzero(both.any(axis=0))
                both = both[:, words]
                for p, plane in enumerate(planes):
                    self.w[a, a + 1 + some] += np.bitwise_count(both & plane[words]).sum(axis=1, dtype=np.int64) << p

    def _probe(self, dense: np.ndarray, lr: np.ndarray, li: np.ndarray, weight: np.ndarray, names: list[str]) -> list:
        size = len(self.heavy)
        by_row = np.packbits(dense.T, axis=1)
        at, hs = [], []
        for k in range(0, len(lr), PROBE):
            hit = np.unpackbits(by_row[lr[k : k + PROBE]], axis=1, count=size)
            i, j = np.nonzero(hit)
            at.append(i + k)
            hs.append(j)
        at, hs = np.concatenate(at), np.concatenate(hs)
        code, n, w = _sums(li[at] * size + hs, weight[lr[at]])
        pairs = [(names[c // size], self.heavy[c % size]) for c in code.tolist()]
        pairs = [p if p[0] < p[1] else (p[1], p[0]) for p in pairs]
        return [([p[0] for p in pairs], [p[1] for p in pairs], n, w)] if pairs else []

    @staticmethod
    def _hashed(lr: np.ndarray, li: np.ndarray, weight: np.ndarray, names: list[str]) -> list:
        codes, weights, step, held, out = [], [], 1, 0, []
        while step < len(lr):
            same = np.flatnonzero(lr[step:] == lr[:-step])
            if not len(same):
                break
            a, b = li[same], li[same + step]
            codes.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            weights.append(weight[lr[same]])
            held += len(same)
            if held > HELD:  # a long record has many pairs
                out.append(_named(names, *_sums(np.concatenate(codes), np.concatenate(weights))))
                codes, weights, held = [], [], 0
            step += 1
        if codes:
            out.append(_named(names, *_sums(np.concatenate(codes), np.concatenate(weights))))
        return out

    def dense_pairs(self) -> pa.RecordBatch:
        a, b = np.nonzero(self.n)
        pairs = [(self.heavy[i], self.heavy[j]) for i, j in zip(a.tolist(), b.tolist())]
        pairs = [p if p[0] < p[1] else (p[1], p[0]) for p in pairs]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(self.n[a, b], pa.int64()), pa.array(self.w[a, b], pa.int64())], names=["term_a", "term_b", "records", "weight"])


def item_stats(records: DataFrame) -> DataFrame:
    """term, records, weight of (terms ARRAY<STRING> without repeats, weight LONG)."""
    return records.select(F.explode("terms").alias("term"), "weight").groupBy("term").agg(F.count("*").alias("records"), F.sum("weight").alias("weight"))


def pair_counts(records: DataFrame, heavy: list[str], ignored: set[str] | None = None, frequent: np.ndarray | None = None) -> DataFrame:
    """term_a < term_b (byte order), records, weight for every pair of items that share a record; ``frequent``: see ``frequent_map``."""
    skip = frozenset(ignored or ())
    items = sorted(set(heavy) - skip)
    sent = records.sparkSession.sparkContext.broadcast((items, skip, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(*sent.value)
        waiting, rows = [], 0

        def flush() -> pa.RecordBatch | None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            return block.add(whole.column("terms").combine_chunks(), whole.column("weight").to_numpy())

        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                if rows + part.num_rows > BLOCK:
                    if (out := flush()) is not None:
                        yield out
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows and (out := flush()) is not None:
            yield out
        yield block.dense_pairs()

    several = records.select("terms", "weight").where(F.size("terms") > 1)
    return several.mapInArrow(run, _PAIRS).groupBy("term_a", "term_b").agg(F.sum("records").alias("records"), F.sum("weight").alias("weight"))


def cooccurrence(records: DataFrame, stats: DataFrame, min_records: int = 1, min_lift: int | None = None, heavy_share: float = HEAVY_SHARE, map_bits: int = MAP_BITS) -> DataFrame:
    """term_a, term_b, records, weight, lift of every pair held together by at least ``min_records`` records.

    ``records``: terms ARRAY<STRING> (distinct, no nulls), weight LONG (not negative); ``stats``: its
    ``item_stats``. Both are read more than once: hand over written tables. With ``min_lift``, pairs
    with W * w(a,b) < min_lift * w(a) * w(b) are left out; then items of more than W / min_lift can't be
    in a pair, as w(a,b) <= w(b), and are skipped. Records of one item and empty tables give no pairs.
    """
    whole = records.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    bound = F.col("records") >= max(1.0, heavy_share * whole["n"])
    rows = stats.where(bound).orderBy(F.desc("records"), "term").limit(MAX_HEAVY).select("term", "weight").collect()
    ignored = {r["term"] for r in rows if min_lift and r["weight"] * min_lift > whole["w"]}
    frequent = frequent_map(stats, min_records, map_bits) if min_records > 1 else None
    pairs = pair_counts(records, [r["term"] for r in rows], ignored, frequent).where(F.col("records") >= min_records)
    a, b = (stats.select(F.col("term").alias(f"term_{x}"), F.col("weight").alias(f"w_{x}")) for x in "ab")
    wide = lambda c: c.cast("decimal(19,0)")
    total = wide(F.lit(int(whole["w"])))
    known = pairs.join(a, "term_a").join(b, "term_b")
    if min_lift:
        known = known.where(total * wide(F.col("weight")) >= wide(F.col("w_a")) * min_lift * wide(F.col("w_b")))
    lift = F.lit(float(whole["w"])) * F.col("weight") / (F.col("w_a").cast("double") * F.col("w_b"))
    return known.select("term_a", "term_b", "records", "weight", lift.alias("lift"))
