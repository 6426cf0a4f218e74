"""Splitting texts into pre-tokens with array operations, and a bounded cache
of their token ids.

``split`` finds the matches of the byte-level BPE pattern (contractions,
letters, digits and other signs with one space before them, runs of white
space) for many texts at once: code point classes change at token starts,
then the spaces and the contractions are put right.  Work and memory are
linear in the texts' length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 4, 0
CHUNK = 1 << 20


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Code point -> class, from the ``regex`` library's Unicode tables."""
    import regex
    out = np.full(0x110000, OTHER, np.uint8)
    every = np.r_[:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = (x + (0x800 if x >= 0xD800 else 0) for x in (m.start(), m.end() - 1))
            out[a:b + 1] = kind
    return out


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, byte start of each token, byte end, tokens per text)."""
    raw = "".join(texts)
    data = raw.encode()
    u = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    n = len(u)
    if not n:
        z = np.empty(0, np.int64)
        return data, z, z, np.zeros(len(texts), np.int64)
    c = classes()[u]
    last = np.zeros(n, bool)                  # last code point of its text
    last[stops[sizes > 0] - 1] = True
    start = np.empty(n + 2, bool)
    start[n:] = True
    start[0] = True
    start[1:n] = (c[1:] != c[:-1]) | last[:-1]
    # white space before another sign: the run's last code point is a token of
    # its own, or, if it is a space, goes with what follows
    before = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & ~last[:-1])
    start[before] = True
    joined = before[u[before] == 32] + 1
    start[joined] = False
    # contractions: only where the apostrophe itself starts a token
    q = np.flatnonzero((u == 39) & start[:n])
    q = q[q < n - 1]
    q = q[~last[q]]
    if len(q):
        a = u[q + 1]
        b = u[np.minimum(q + 2, n - 1)]
        second = ~last[q + 1] & (q + 2 < n)
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = second & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                        | ((a == ord("l")) & (b == ord("l"))))
        hit, width = q[one | two], np.where(two, 3, 2)[one | two]
        start[hit + 1] = False
        start[hit + width] = True
    at = np.flatnonzero(start[:n])
    wide = len(data) != n
    if wide:
        lens = 1 + (u >= 0x80).astype(np.int64) + (u >= 0x800) + (u >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(lens)])
        begin = offset[at]
    else:
        begin = at
    ends = np.append(begin[1:], len(data))
    per_text = np.diff(np.concatenate([[0], np.searchsorted(at, stops)]))
    return data, begin, ends, per_text


def chunks(texts: list[str], limit: int = CHUNK):
    """The texts in runs of about ``limit`` code points, none of them cut."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


class WordIds:
    """Ids of pre-tokens: each distinct one is encoded once by ``encode``
    (list of bytes -> list of id lists).  Emptied when it holds ``limit``
    words, so memory is bounded and results do not depend on it."""

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self._empty()

    def _empty(self):
        self.at: dict[bytes, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _add(self, words: list[bytes]):
        for w, ids in zip(words, self.encode(words), strict=True):
            k, n = len(self.at), len(ids)
            if k == len(self.first):
                self.first = np.concatenate([self.first, np.zeros_like(self.first)])
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            while self.used + n > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used:self.used + n] = ids
            self.at[w], self.first[k], self.count[k] = k, self.used, n
            self.used += n

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        data, begin, _, per_text = split(texts)
        words, which = distinct(data, begin)
        if len(self.at) > self.limit:
            self._empty()
        new = [w for w in words if w not in self.at]
        if new:
            self._add(new)
        at = np.fromiter((self.at[w] for w in words), np.int64, len(words))[which]
        n = self.count[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.first[at] - total[:-1], n) + np.arange(total[-1])]
        word_stop = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.diff(total[word_stop])


def distinct(data: bytes, begin: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct tokens of ``data``, cut at ``begin``, and for each token
    which of them it is."""
    ends = pa.py_buffer(np.append(begin, len(data)))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, ends, pa.py_buffer(data)]).dictionary_encode()
    return tokens.dictionary.to_pylist(), tokens.indices.to_numpy()


def parts(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Consecutive parts of ``values`` of the given sizes."""
    ends = np.cumsum(sizes).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]
