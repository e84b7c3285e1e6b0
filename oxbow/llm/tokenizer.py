"""Byte-level BPE over whole corpora with a public tokenizer's rank file.

Method: the adjacent pairs of a piece are the leaves of a segment tree that holds, in each
node, the least (rank, position) below it. The root is the leftmost lowest-rank merge;
a merge changes two or three leaves, each in logarithmic time, until the root is empty.
A piece of n bytes costs O(n log n), so very long pieces are no trouble.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.session import spread, table

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the public vocabulary that splits text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts of ASCII characters alone, in the form that Python's own (faster) engine reads.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""
#: Pieces kept with their ids in a Python worker; the cache is emptied when full.
CACHE = 200_000
NONE = 1 << 62


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Token bytes to rank (= id) of a rank file: base64, blank, number in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by repeated leftmost lowest-rank merges.

    Leaf i of the tree is (rank << 32 | i) of the part that begins at byte i together with the part after it.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # of the part that begins here
    prv = list(range(-1, n - 1))  # where the part before begins
    while (least := tree[1]) != NONE:
        i = least & 0xFFFFFFFF
        j = end[i]
        k = end[i] = end[j]
        # the three leaves that change: this part's, the swallowed part's, and the one of the part before
        if k < n:
            prv[k] = i
            r = get(piece[i : end[k]])
            changes = [(i, NONE if r is None else r << 32 | i), (j, NONE)]
        else:
            changes = [(i, NONE)]
        h = prv[i]
        if h >= 0:
            r = get(piece[h:k])
            changes.append((h, NONE if r is None else r << 32 | h))
        for at, value in changes:
            at += size
            tree[at] = value
            while at > 1:
                x = tree[at ^ 1]
                if value > x:
                    value = x
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Encoder:
    """Texts to ids, without special tokens: their strings are ordinary text. Null and empty texts have no ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.find, self.cache = ranks, regex.compile(pattern).findall, {}
        self.find_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.find

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for p in self.find_ascii(text) if text.isascii() else self.find(text):
            ids = cache.get(p)
            if ids is None:
                ids = encode_piece(p.encode(), self.ranks)
                if len(p) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out


def _worker(ranks, pattern: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 1000):  # long texts: a few at a time
                part = b.slice(i, 1000)
                ids = [enc(t) for t in part.column(1).to_pylist()]
                made = pa.array([len(x) for x in ids], pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=["key", "n" if counts else "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, ranks_path: str = DEFAULT_RANKS, counts: bool = False, pattern: str = PATTERN) -> DataFrame:
    """One row per row of ``df``: key and ids (a list of integers), or with ``counts`` key and n.

    Null and empty texts come out with an empty list (or 0); blank texts have the ids of their
    blanks. Rows are independent: nothing is shuffled (but for inputs of fewer tasks than cores, which are spread). The vocabulary, of fixed size, goes to the
    executors as a broadcast variable; only the driver reads ``ranks_path``.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    src = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = src.schema["key"].dataType.simpleString()
    out = src.mapInArrow(_worker(ranks, pattern, counts), f"key {kind}, " + ("n long" if counts else "ids array<int>"))
    return out.withColumnRenamed("key", key)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")
