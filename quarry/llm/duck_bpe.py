"""Byte-level BPE encoding and decoding with DuckDB queries per partition.

Encoding: the texts of a task are cut into pre-tokens; those not met before
become token-position rows (word, position, id), one per byte.  A recursive
query joins neighbouring positions with the merge table and contracts in
every word the leftmost pair of least rank, until no word has a pair left.
Words longer than ``LONG`` bytes contract, in each step, all places of their
least-ranked pair that do not overlap, from the left: the same result, as a
merge never makes a pair of lower rank, in far fewer steps.
A query makes at most ``TURNS`` steps; words not ended go into another one.
Decoding: token-position rows join the vocabulary, and an ordered aggregate
puts the bytes of each document together.

Spark deals the rows and moves them; a task's DuckDB works in memory on
bounded batches (only a word beyond ``TOKENS_PER_QUERY`` bytes takes more).  Null and empty texts have no ids and decode to nothing;
texts of any length are encoded whole; repeated rows get equal results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import serve, ship_package, slices
from quarry.llm.pretokens import WordIds, chunks, parts

#: Bytes beyond which a word is contracted at all places of a pair at once.
LONG = 48
WORDS_KEPT = 250_000
CHUNK = 1 << 18
WORDS_PER_QUERY = 8_000
TOKENS_PER_QUERY = 1 << 18
#: Steps of a recursive query, all of whose rows DuckDB keeps; words not ended go into another query.
TURNS = 16
MEMORY_MB = 200
#: A query on one word longer than ``TOKENS_PER_QUERY`` may use so many bytes a byte of it.
BYTES_A_TOKEN = 1_000

_STEP = """
WITH RECURSIVE step(turn, k, id) AS (
  SELECT 0, w::BIGINT * 64 + p, id FROM word_tokens
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.turn, s.k, s.id, (m.made::BIGINT << 12) | ((s.k & 63) << 6) | (s.next_k & 63) AS pair
     FROM (SELECT *, lead(id) OVER by_place AS next_id, lead(k) OVER by_place AS next_k
           FROM step WHERE turn < $turns WINDOW by_place AS (ORDER BY k)) s
     LEFT JOIN merges m ON m.pair = s.id::BIGINT * 65536 + s.next_id AND s.next_k >> 6 = s.k >> 6),
   best AS (SELECT k >> 6 AS w, min(pair) AS pair FROM pairs GROUP BY k >> 6 HAVING min(pair) IS NOT NULL)
   SELECT turn + 1, k, CASE WHEN k & 63 = (best.pair >> 6) & 63 THEN (best.pair >> 12)::INTEGER ELSE id END
   FROM pairs JOIN best ON k >> 6 = best.w WHERE k & 63 <> best.pair & 63)
), ended AS (SELECT k >> 6 AS w, max(turn) AS turn FROM step GROUP BY k >> 6)
SELECT ended.w::INTEGER AS w, id, ended.turn AS turn FROM step JOIN ended ON k >> 6 = ended.w AND step.turn = ended.turn ORDER BY k
"""

_STEP_ALL = """
WITH RECURSIVE step(turn, w, p, id) AS (
  SELECT 0, w, p, id FROM word_tokens
  UNION ALL
  SELECT turn + 1, w, p, CASE WHEN picked THEN made ELSE id END
  FROM (SELECT *, coalesce(lag(picked) OVER (PARTITION BY w ORDER BY p), false) AS gone
        FROM (SELECT *, hit AND row_number() OVER (PARTITION BY w, hit, island ORDER BY p) % 2 = 1 AS picked
              FROM (SELECT *, k - row_number() OVER (PARTITION BY w, hit ORDER BY p) AS island
                    FROM (SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit,
                                 min(rank) OVER (PARTITION BY w) AS least_rank
                          FROM (SELECT s.*, m.made, m.made AS rank
                                FROM (SELECT *, lead(id) OVER (PARTITION BY w ORDER BY p) AS nxt,
                                             row_number() OVER (PARTITION BY w ORDER BY p) AS k FROM step WHERE turn < $turns) s
                                LEFT JOIN merges m ON m.pair = s.id::BIGINT * 65536 + s.nxt))
                    WHERE least_rank IS NOT NULL)))
  WHERE NOT gone
), ended AS (SELECT w, max(turn) AS turn FROM step GROUP BY w)
SELECT w, id, turn FROM step JOIN ended USING (w, turn) ORDER BY w, p
"""

_DECODE = """
SELECT d.doc AS doc, string_agg(v.piece, '' ORDER BY d.p) AS text
FROM doc_tokens d JOIN vocabulary v ON v.id = d.id GROUP BY d.doc ORDER BY d.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class DuckBpe:
    """One task's tables: the merges, the vocabulary and the words met."""

    def __init__(self, path: str):
        import duckdb
        ranks = read_ranks(path)
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pair, made = [], []
        for word, rank in ranks.items():            # any two ids whose bytes together are in the vocabulary
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k]), ranks.get(word[k:])
                if a is not None and b is not None:
                    pair.append(a * 65536 + b)
                    made.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self.memory_mb = MEMORY_MB
        self._table("merge_rows", pair=pa.array(pair, pa.int64()), made=pa.array(made, pa.int32()))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self._table("vocabulary_rows", id=pa.array(list(ranks.values()), pa.int32()),
                    piece=pa.array([w.decode("latin-1") for w in ranks]))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
        self.words = WordIds(self.encode_words, WORDS_KEPT)

    def _table(self, name: str, **columns):
        self.db.register(name, pa.table(columns))

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the merge queries."""
        out: list = [None] * len(words)
        short, long = [], []
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[k] = np.array([whole], np.int32)
            else:
                (short if len(w) <= LONG else long).append(k)
        for group, query in ((short, _STEP), (long, _STEP_ALL)):
            at = 0
            while at < len(group):
                end, size = at, 0
                while end < len(group) and end - at < WORDS_PER_QUERY and size < TOKENS_PER_QUERY:
                    size += len(words[group[end]])
                    end += 1
                self._contract(words, group[at:end], query, out)
                at = end
        return out

    def _contract(self, words: list[bytes], some: list[int], query: str, out: list):
        sizes = np.array([len(words[k]) for k in some])
        w = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
        ids = self.byte_id[np.frombuffer(b"".join(words[k] for k in some), np.uint8)]
        self._memory(len(ids))
        while len(w):
            new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            place = np.arange(len(w)) - np.repeat(new, np.diff(np.r_[new, len(w)]))
            self._table("word_tokens", w=w, p=place.astype(np.int32), id=ids)
            got = self.db.sql(query.replace("$turns", str(TURNS))).to_arrow_table()
            w, ids, turn = (got[c].to_numpy() for c in ("w", "id", "turn"))
            ends = np.flatnonzero(np.r_[w[1:] != w[:-1], True]) + 1
            at = 0
            for word, end, last in zip(w[ends - 1].tolist(), ends.tolist(), turn[ends - 1].tolist()):
                if last < TURNS:
                    out[some[word]] = ids[at:end]
                at = end
            more = turn == TURNS
            w, ids = w[more], ids[more]

    def _memory(self, tokens: int):
        need = max(MEMORY_MB, BYTES_A_TOKEN * tokens >> 20 if tokens > 2 * TOKENS_PER_QUERY else 0)
        if need != self.memory_mb:
            self.db.execute(f"SET memory_limit = '{need}MB'")
            self.memory_mb = need

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids, by ordered aggregation: queries of
        ``TOKENS_PER_QUERY`` rows, a longer list in several."""
        out: list[list[bytes]] = [[] for _ in ids]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
        every = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else doc
        self._memory(0)
        for at in range(0, len(every), TOKENS_PER_QUERY):
            part = every[at:at + TOKENS_PER_QUERY]
            self._table("doc_tokens", doc=doc[at:at + TOKENS_PER_QUERY], p=np.arange(len(part), dtype=np.int32), id=part)
            for k, text in self.db.execute(_DECODE).fetchall():
                out[k].append(text.encode("latin-1"))
        return [b"".join(x) for x in out]


@functools.lru_cache(1)
def _bpe(path: str) -> DuckBpe:
    return DuckBpe(path)


def worker_bpe(path: str) -> DuckBpe:
    """One per Python worker: its words serve the worker's later tasks too."""
    serve("byte BPE", _bpe.cache_clear)
    return _bpe(path)


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Append the token ids (array<int>) of ``text_col``; other columns stay,
    a column of the name ``out_col`` is replaced."""
    ship_package(df.sparkSession)

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        import pandas as pd
        bpe, found = worker_bpe(path), []
        for run in chunks(texts.fillna("").tolist(), CHUNK):
            ids, n = bpe.words.ids(run)
            found += parts(ids.astype(np.int32), n)
        return pd.Series(found)
    return df.withColumn(out_col, ids_of(F.coalesce(F.col(text_col), F.lit(""))))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the bytes (binary) of the token ids in ``ids_col`` (null: none)."""
    ship_package(df.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(ids):
        import pandas as pd
        return pd.Series(worker_bpe(path).decode([np.empty(0, np.int32) if x is None else x for x in ids]))
    return df.withColumn(out_col, bytes_of(F.col(ids_col)))


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text and
    decode the ids again, digests only leaving the tasks."""
    ship_package(df.sparkSession)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in slices(batches):
            at, doc_ids = 0, batch.column(0)
            for some in chunks(batch.column(1).to_pylist(), CHUNK):
                ids, n = bpe.words.ids(some)
                lists = parts(ids.astype("<u4"), n)
                texts = bpe.decode(lists)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(at, len(some)), pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(some)

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)
