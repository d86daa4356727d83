"""Filling containers of fixed capacity: minimum bin slack.

Documents are measured in tokens of a public tokenizer once. Lengths are then packed in shards of about
``SHARD_ITEMS`` documents. Each container takes the longest text left and the combination of available
lengths that fills the rest best, found by subset-sum dynamic programming on a bitset; the
combination is removed and the next container follows. What a shard's last container
leaves unused is at most one container in a shard.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: how the rank files split text before merging (fixed value, published with the tokenizer)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 20_000
_PACKED = "class_name string, capacity int, container_id long, doc_id long, piece int, start_token long, tokens long"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, tokens (LONG) of each document; null and empty texts have 0. The tokenizer's file need only be on the driver: Spark hands it to the executors."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long")


def fullest(lengths: list[tuple[int, int]], room: int) -> list[int]:
    """The combination of lengths (each with how many there are) with the greatest sum up to ``room``.

    Bitset subset-sum: bit s of ``reach`` says that the sum s can be made. A length that occurs c times enters
    as 1, 2, 4, ... of it. The states are kept, to walk back from the best sum; it stops once ``room`` is met.
    """
    reach, goal, mask = 1, 1 << room, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # state before, length, how many at once
    for length, count in lengths:
        if length > room:
            continue
        count, chunk = min(count, room // length), 1
        while count > 0:
            k = min(chunk, count)
            more = (reach | reach << (length * k)) & mask
            if more != reach:
                steps.append((reach, length, k))
                reach = more
            count -= k
            chunk *= 2
        if reach & goal:
            break
    best = reach.bit_length() - 1
    out: list[int] = []
    for before, length, k in reversed(steps):
        if not before >> best & 1:
            best -= length * k
            out += [length] * k
    return out


def pack(lengths: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Containers (lengths in it, how many containers alike) for a stock of lengths from 1 to ``capacity``."""
    stock = {k: v for k, v in lengths.items() if v > 0}
    order = sorted(stock, reverse=True)
    out = []
    while order:
        top = order[0]
        stock[top] -= 1
        rest = fullest([(k, stock[k]) for k in order if stock[k]], capacity - top)
        stock[top] += 1
        need: dict[int, int] = {}
        for k in [top, *rest]:
            need[k] = need.get(k, 0) + 1
        # an exactly full combination stays the fullest as long as its lengths last
        times = min(stock[k] // n for k, n in need.items()) if top + sum(rest) == capacity else 1
        for k, n in need.items():
            stock[k] -= n * times
        out.append(([top, *rest], times))
        order = [k for k in order if stock[k]]
    return out


def _pack_shard(items: pd.DataFrame, classes: list[tuple[str, int]]) -> pd.DataFrame:
    shard = int(items["shard"].iloc[0])
    rows: list[tuple] = []
    items = items.sort_values(["doc_id", "copy"])
    for name, capacity in classes:
        waiting: dict[int, list[tuple]] = {}
        container = shard << 32
        for doc, tokens in zip(items["doc_id"].tolist(), items["tokens"].tolist()):
            if tokens == 0:
                rows.append((name, capacity, None, doc, 0, 0, 0))
            whole, rest = divmod(tokens, capacity)
            for p in range(whole):
                rows.append((name, capacity, container, doc, p, p * capacity, capacity))
                container += 1
            if rest:
                waiting.setdefault(rest, []).append((doc, whole, whole * capacity))
        for v in waiting.values():
            v.reverse()
        for lengths, times in pack({k: len(v) for k, v in waiting.items()}, capacity):
            for _ in range(times):
                rows += [(name, capacity, container, *waiting[k].pop(), k) for k in lengths]
                container += 1
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in _PACKED.split(", ")])
    return out.astype({"container_id": "Int64"})


def pack_documents(lengths: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Each document in a container of each class: class_name, capacity, container_id, doc_id, piece, start_token, tokens.

    ``lengths``: doc_id, tokens (a written table: it is read more than once). A text above the capacity is cut
    into pieces that fill containers of their own and a rest, which is packed like a text. Texts without
    tokens take no room: they come out once with container_id null. Repeated documents are packed each. Classes without
    a positive capacity are ignored; container ids are unique in a class.
    """
    classes = sorted((r[0], int(r[1])) for r in containers.where("capacity > 0").select("class_name", "capacity").distinct().collect())
    shards = max(1, -(-lengths.count() // shard_items))
    # rows of one id are told apart and spread: no shard grows with them
    numbered = lengths.select("doc_id", "tokens", F.monotonically_increasing_id().alias("copy"))
    given = numbered.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)).cast("long"))
    # few bytes but much work: a number of partitions of its own, which adaptive execution keeps
    given = given.repartition(shards, "shard")
    return given.groupBy("shard").applyInPandas(lambda pdf: _pack_shard(pdf, classes), _PACKED)


def packed(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack_documents(materialize(token_lengths(documents, tokenizer), "token-lengths"), containers)
