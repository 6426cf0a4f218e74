"""Token counts of a SentencePiece BPE model by heap-and-linked-list merging.

A text becomes symbols (one per code point, spaces as the word mark, one mark
put before it).  A heap holds the adjacent pairs that form a piece, by score
and then by position; the best is popped and merged in a linked list of the
symbols until no pair is left.  The count is the initial symbols minus the
merges, where a symbol that is no piece itself counts its UTF-8 bytes (byte
fallback).  No ids are made.

No piece holds a word mark after another sign, so nothing merges across the
start of a run of marks, nor over a sign that is in no longer piece; texts are
cut there and each distinct unit is merged once per worker, in a cache of
bounded size.  Merging a unit of n symbols takes O(n log n), so long texts
without a space are no special case.  Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import serve, ship_package

MARK = "▁"
CACHE_UNITS = 400_000
#: Piece types of the model file that take part in merges.
NORMAL, USER_DEFINED = 1, 4


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + n]
            at += n


def read_pieces(path: str) -> dict[str, float]:
    """Mergeable pieces of a model file with their scores."""
    with open(path, "rb") as f:
        model = f.read()
    pieces = {}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, NORMAL) in (NORMAL, USER_DEFINED):
                pieces[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
    return pieces


class UnitCounts(dict):
    """unit -> number of tokens; missing units are merged."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces = pieces
        inside = set().union(*(p for p in pieces if len(p) > 1)) if pieces else set()
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after another sign")
        self.breaks = [c for c in "\n\t\r" if c not in inside]
        self.break_cost = {c: 1 if c in pieces else len(c.encode()) for c in self.breaks}

    def __missing__(self, unit: str) -> int:
        n = self[unit] = self.merge(unit)
        return n

    def merge(self, unit: str) -> int:
        pieces = self.pieces
        if unit in pieces and len(unit) == 1:
            return 1
        symbol: list[str | None] = list(unit)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int):
            j = after[i]
            if j < n:
                pair = symbol[i] + symbol[j]
                score = pieces.get(pair)
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, pair))
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if symbol[i] is None or after[i] != j or symbol[j] is None or symbol[i] + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = pair, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        merges = sum(s is None for s in symbol)
        fallback = sum(len(s.encode()) - 1 for s in symbol if s is not None and s not in pieces)
        return n - merges + fallback

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > CACHE_UNITS:
            self.clear()
        extra = 0
        for c in self.breaks:
            if c in text:
                extra += text.count(c) * self.break_cost[c]
        marked = MARK + text.replace(" ", MARK)
        for c in self.breaks:
            marked = marked.replace(c, "\n")
        return extra + sum(map(self.__getitem__, _units(marked)))


def _units(marked: str) -> Iterator[str]:
    """Cut before every run of word marks and at line ends, runs kept whole."""
    for line in marked.split("\n"):
        if not line:
            continue
        parts = line.split(MARK)
        if parts[0]:
            yield parts[0]
        run = 1
        for p in parts[1:]:
            if p:
                yield MARK * run + p
                run = 1
            else:
                run += 1
        if run > 1:
            yield MARK * (run - 1)


@functools.lru_cache(1)
def _counts(path: str) -> UnitCounts:
    return UnitCounts(read_pieces(path))


def worker_counts(path: str) -> UnitCounts:
    """One per Python worker; its units serve the worker's later tasks too."""
    serve("token counts", _counts.cache_clear)
    return _counts(path)


def token_counts(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """Append the number of tokens of each text; other columns stay and do
    not leave the JVM, a column named ``out_col`` is replaced."""
    ship_package(df.sparkSession)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        units = worker_counts(path)
        return pa.array(np.fromiter((units.count(t) for t in texts.to_pylist()), np.int64, len(texts)))
    return df.withColumn(out_col, count(F.coalesce(F.col(text_col), F.lit(""))))


def counted(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return token_counts(rows, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
