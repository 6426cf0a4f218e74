"""Word shingles of whole texts as 64-bit hashes, with array operations.

Words are the runs of bytes other than space and tab to carriage return, A-Z
in lower case.  A word's hash is a polynomial over its bytes modulo 2**64
(one running sum over the text gives all of them), mixed; a shingle's hash
mixes the hashes of its words in their order.  A text with fewer words than a
shingle has one shingle, the whole sequence; one without words has none.
Two different shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import functools

import numpy as np

GROUP_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_ORDER = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)

_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[9:14] = _GAP[32] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, _P_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def release() -> None:
    _powers.cache_clear()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each text's first word, with
    the end)."""
    joined = b"\n".join(texts) + b"\n"
    b = np.frombuffer(joined, np.uint8)
    gap = _GAP[b]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    first = np.flatnonzero(edge == -1)
    after = np.flatnonzero(edge == 1)
    up, down = _powers(max(GROUP_BYTES, 1 << int(len(b)).bit_length()))
    total = np.cumsum(_LOWER[b] * up[:len(b)], dtype=np.uint64)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sums = total[after - 1] - np.where(first > 0, total[first - 1], np.uint64(0))
    h = mix(sums * down[first] + (after - first).astype(np.uint64) * _ORDER[0])
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(first, starts)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n == 0 or n + len(texts[end]) < GROUP_BYTES):
            n += len(texts[end]) + 1
            end += 1
        h, cut = word_hashes(texts[at:end])
        if len(h) >= size:
            s = sum((h[k:len(h) - size + 1 + k] * _ORDER[k] for k in range(size)), np.uint64(0))
            s = mix(s)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if z - a >= size:
                out.append(np.unique(s[a:z - size + 1]))
            elif z > a:
                whole = (h[a:z] * _ORDER[:z - a]).sum(dtype=np.uint64) + np.uint64(z - a)
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out
