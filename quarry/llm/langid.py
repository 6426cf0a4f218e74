"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one byte-trigram classifier per bit
tells the languages whose bit is 1 from the others (log ratio of the two
class distributions over hashed trigrams).  A document's margin for a bit is
the mean weight of its trigrams.  Decoding weighs each bit's logistic loss by
the margin that the bit has for that language in training and takes the
codeword of least loss; when the two best are close the document is flagged
ambiguous.

Each language is smoothed on its own, and margins are scaled by the mean margin
of the training trigrams.  A language counts in a bit's class distributions, and
its own margins in its bit weights, only as far as its counts outweigh what the
smoothing adds, so a rare or stray label does not decide on the others.

Training counts trigrams over all training rows, in tasks: only one count
vector per language reaches the driver (``1 << HASH_BITS`` numbers each).
Whole texts are read, in pieces of ``PIECE`` bytes.  Null texts and texts
without a letter get ``und`` with score 0; so does every text when there is
no training row.  With one language every text with a letter is of it, score
1.  Repeated rows get equal results; other columns pass through, and columns
with the names of the results are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import added_up, serve, ship_package

HASH_BITS = 15
PIECE = 1 << 19
#: Steepness of the loss over scaled margins and of the score over losses.
SHARPNESS, CONTRAST = 10.0, 6.0
#: Added to every trigram count of a language.
SMOOTHING = 0.5
#: Two best scores closer than this make a document ambiguous.
AMBIGUOUS_GAP = 0.2
MAX_WEIGHT = 4.0
UNKNOWN = "und"

#: Byte -> class: 0 for what is no letter, letters without case, high bytes.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Groups of text pieces joined by line ends: (owners, joined, positions
    of the line ends around the pieces)."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PIECE):
            p = t[at:at + PIECE + 2]
            owners.append(i)
            parts.append(p)
            size += len(p)
            if size >= PIECE:
                yield owners, b"\n" + b"\n".join(parts) + b"\n", _ends(parts)
                owners, parts, size = [], [], 0
    if parts:
        yield owners, b"\n" + b"\n".join(parts) + b"\n", _ends(parts)


def _ends(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])


def trigrams(joined: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of a joined group, with each piece's first index and
    the index after its last."""
    c = _CLASS[np.frombuffer(joined, np.uint8)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    place = np.cumsum(keep) - 1
    c = c[keep]
    edge = place[ends]
    if len(c) < 3:
        return np.empty(0, np.int64), edge[:-1] * 0, edge[:-1] * 0
    x = ((c[:-2] * 155 + c[1:-1]) * 155 + c[2:]).astype(np.uint32)
    g = ((x * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
    first = edge[:-1]
    return g, first, np.maximum(first, edge[1:] - 1)


def count_trigrams(train: DataFrame, lang_col: str, text_col: str) -> dict[str, np.ndarray]:
    """Trigram counts of each language over all rows of ``train``."""
    size = 1 << HASH_BITS
    ship_package(train.sparkSession)

    def count(batches):
        serve("language ID")
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                acc = total.setdefault(lang, np.zeros(size, np.int64))
                for _, joined, ends in _pieces([t.encode() for t in part["text"]]):
                    g, first, last = trigrams(joined, ends)
                    inside = np.zeros(len(g) + 1, np.int32)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, last, -1)
                    acc += np.bincount(g[np.cumsum(inside[:-1]) > 0], minlength=size)
        if total:
            yield pd.DataFrame({"lang": list(total), "counts": [v.tobytes() for v in total.values()]})

    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = rows.mapInPandas(count, "lang string, counts binary")
    return {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in added_up(parts, "lang", "string").collect()}


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 / -1: the exhaustive code up to five languages, beyond it
    seeded random columns, distinct rows, both signs in every column."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), 4 * math.ceil(math.log2(n)) + 3
    while True:
        code = rng.choice((-1.0, 1.0), (n, bits))
        if len(np.unique(code, axis=0)) == n and (abs(code.sum(0)) < n).all():
            return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray            # language x bit, +1 or -1
    bit_weight: np.ndarray      # language x bit, rows sum to 1
    weights: np.ndarray         # trigram x bit, over the mean margin in training

    def margins(self, texts: list[bytes]) -> np.ndarray:
        sums, n = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for owners, joined, ends in _pieces(texts):
            g, first, last = trigrams(joined, ends)
            some = last > first
            if not some.any():
                continue
            v = np.concatenate([self.weights[g], np.zeros((1, self.weights.shape[1]), np.float32)])
            cuts = np.stack([first[some], last[some]], 1).ravel()
            own = np.array(owners)[some]
            np.add.at(sums, own, np.add.reduceat(v, cuts, axis=0)[::2])
            np.add.at(n, own, (last - first)[some])
        return sums / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous) of each text."""
        if len(self.languages) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts)), np.zeros(len(texts), bool)
        z = self.margins(texts)[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -SHARPNESS * z) * self.bit_weight[None]).sum(2)
        p = np.exp(-CONTRAST * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)
        return loss.argmin(1), top[:, -1], top[:, -1] - top[:, -2] < AMBIGUOUS_GAP


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel | None:
    """A model from every row of ``train`` with a language and a text; None
    when there is none."""
    counts = {k: v for k, v in count_trigrams(train, lang_col, text_col).items() if v.sum()}
    if not counts:
        return None
    languages = sorted(counts)
    c = np.stack([counts[x] for x in languages]).astype(float)
    code = codewords(len(languages))
    if len(languages) == 1:
        return LanguageModel(languages, code, np.ones((1, 0)), np.zeros((c.shape[1], 0), np.float32))
    total = c.sum(1, keepdims=True)
    p = (c + SMOOTHING) / (total + SMOOTHING * c.shape[1])
    known = total / (total + SMOOTHING * c.shape[1])
    weights = np.empty((c.shape[1], code.shape[1]))
    for b in range(code.shape[1]):
        one, zero = (np.average(p[side], axis=0, weights=known[side, 0]) for side in (code[:, b] > 0, code[:, b] < 0))
        weights[:, b] = np.clip(np.log(one / zero), -MAX_WEIGHT, MAX_WEIGHT)
    expected = np.maximum((c / total @ weights) * code, 1e-3)
    usual = (expected * total).sum(0) / total.sum()
    bit_weight = known * expected + (1 - known) * usual
    return LanguageModel(languages, code, bit_weight / bit_weight.sum(1, keepdims=True),
                         (weights / usual.mean()).astype(np.float32))


def identify(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score`` and ``ambiguous`` to ``df``."""
    out = "struct<lang_pred:string,score:double,ambiguous:boolean>"
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    ship_package(df.sparkSession)
    text = F.col(text_col)
    if model is None:
        found: Column = none
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf(out)
        def predict(texts: pa.Array) -> pa.Array:
            serve("language ID")
            m = shared.value
            if not len(texts):
                return pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]))
            parts = [m.predict([(t or "").encode() for t in texts.slice(k, 512).to_pylist()])
                     for k in range(0, len(texts), 512)]
            at, score, near = (np.concatenate(x) for x in zip(*parts))
            return pa.StructArray.from_arrays([pa.array([m.languages[k] for k in at], pa.string()),
                                               pa.array(score), pa.array(near)], ["lang_pred", "score", "ambiguous"])

        has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        found = F.when(has_letter, predict(text)).otherwise(none)
    rows = df.withColumn("_found", found)
    rows = rows.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.round("_found.score", 6),
                             "ambiguous": F.col("_found.ambiguous")})
    return rows.drop("_found")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where("NOT held_out").select("lang", "text"))
    return identify(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
