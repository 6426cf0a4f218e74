"""Token ids in binary files: an adaptive context-mixing range coder.

File format.  A file set is a Parquet table of segments, written by Spark
(so a lost task is retried and only whole files appear); a segment holds whole
documents in ascending id order:

  bucket, start         place: bucket of the id range, ids before it in the bucket
  doc_ids, doc_lens     documents and their numbers of ids, the end id included
  n_ids                 ids in the segment
  block_words           length of each block's code, in 16-bit words
  block_crc32           crc32 of each block's ids as little-endian uint32
  payload               the blocks' codes, little-endian uint16, one after another

A block holds ``BLOCK_IDS`` ids (the last one fewer) and is coded with models
reset at its start, so each can be decoded alone and a damaged one is found
by its checksum.

Model.  Four predictions of the next id are mixed: the id that last followed
the two ids before (order 2), the one that last followed the id before
(order 1), the counts of the block's ids so far (order 0), and for ids that the
block has not had a fixed law, falling with the id as merge ranks do.  Which
one codes the id follows from adaptive counts of the block and of the state
that the contexts are in (how often each was right in a row, whether they
agree, how many ids the block has had), mixed with a weight that follows how
well each of the two did.  Range coder: 64-bit carryless, 16 bits at a time.
The blocks of a segment advance in step as rows of arrays.

Ids must be below 2**20.  Null and empty texts are the end id alone.  Repeated
rows are documents of their own; null ids come first, ties go by text.  An
empty table makes an empty file set, read as no rows.  Columns other than id
and text are not written.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, id_cuts, order_id, serve, ship_package
from quarry.llm.pretokens import WordIds, chunks
from quarry.session import scratch_path

END_ID = 0
BLOCK_IDS = 1024
LANES = 2048
SEGMENT_IDS = BLOCK_IDS * LANES
ROWS_PER_BUCKET = 2048
WORDS_KEPT = 600_000
MAX_ID = 1 << 20
SLOTS2, SLOTS1 = 1024, 1024             # contexts of a block, by hash
PLACES = 2 * BLOCK_IDS                  # of a block's table of its ids (open addressing)
GROUP, GROUPS = 16, BLOCK_IDS // 16     # counts of order 0 and their sums
LEVELS = 3                              # of ids that the block has had: below 16, below 128, more
DECAY, SHARE = 0.99, 0.02

SCHEMA = ("bucket int, start bigint, doc_ids array<bigint>, doc_lens array<bigint>, n_ids bigint, "
          "block_words array<int>, block_crc32 array<bigint>, payload binary")

_16, _48 = np.uint64(16), np.uint64(48)
_LOW32 = np.uint64((1 << 32) - 1)
_STEP = np.arange(max(GROUP, GROUPS), dtype=np.int64)


@functools.lru_cache(1)
def unseen_law() -> np.ndarray:
    """Sums of the weights 2**20 // (id + 256) + 1 of all ids before each."""
    return np.concatenate([[0], np.cumsum((1 << 20) // (np.arange(MAX_ID) + 256) + 1)])


def _start_counts() -> np.ndarray:
    """First counts of the four kinds by state (order 2, order 1, agree)."""
    out = np.full((4, 4, 2, LEVELS, 4), 0.6, np.float32)
    out[..., :2] = 0.01
    out[1:, :, :, :, 0] = 0.4
    out[:, 1:, 0, :, 1] = 0.4
    return out.reshape(-1, 4)


class Model:
    """State of the predictions of ``n`` blocks side by side."""

    def __init__(self, n: int):
        self.row = np.arange(n)
        # the id that followed each context, times 4, plus how often it was right in a row (0 to 2); -1: none
        self.after2, self.after1 = np.full(n * SLOTS2, -1, np.int32), np.full(n * SLOTS1, -1, np.int32)
        start = _start_counts()
        self.states = len(start)
        self.by_state = np.tile(start, (n, 1))
        self.by_block = np.full((n, 4), 0.5, np.float32)
        self.weight = np.full(n, 0.2, np.float32)
        self.seen = np.full((n, BLOCK_IDS), -1, np.int32)       # ids of the block in order of arrival
        self.places = np.full(n * PLACES, -1, np.int32)         # id * BLOCK_IDS + place; -1: free
        self.count = np.zeros((n * GROUPS, GROUP), np.int16)
        self.sums = np.zeros((n, GROUPS), np.int16)
        self.used = np.zeros(n, np.int64)
        self.last = np.zeros((2, n), np.int64)
        self.step = self.width = 0

    def narrow(self, n: int) -> None:
        """Go on with the first n blocks only."""
        had = len(self.row)
        for name, v in list(vars(self).items()):
            if name == "last":
                self.last = v[:, :n]
            elif isinstance(v, np.ndarray):
                setattr(self, name, v[:len(v) // had * n])

    def predict(self) -> None:
        row, (b, a) = self.row, self.last                   # a: the id before, b: the one before it
        self.at2 = row * SLOTS2 + (((b * 40503 + a * 10007) >> 3) & (SLOTS2 - 1))
        self.at1 = row * SLOTS1 + (a & (SLOTS1 - 1))
        self.v2, self.v1 = self.after2[self.at2], self.after1[self.at1]
        self.p2, self.p1 = self.v2 >> 2, self.v1 >> 2
        s2, s1 = np.where(self.v2 < 0, 0, (self.v2 & 3) + 1), np.where(self.v1 < 0, 0, (self.v1 & 3) + 1)
        level = (self.used >= 16).astype(np.int64) + (self.used >= 128)
        self.state = row * self.states + (((s2 * 4 + s1) * 2 + ((self.p2 == self.p1) & (self.p2 >= 0))) * LEVELS + level)
        self.held = self.by_state[self.state]
        self.e0, self.e2 = (x / (x[:, 0] + x[:, 1] + x[:, 2] + x[:, 3])[:, None] for x in (self.by_block, self.held))
        mixed = self.e2 + self.weight[:, None] * (self.e0 - self.e2)
        share = np.maximum(mixed * np.float32(65000), 0).astype(np.int32) + 1
        share[:, 3] += 65536 - (share[:, 0] + share[:, 1] + share[:, 2] + share[:, 3])
        self.share = share

    def place_of(self, ids: np.ndarray) -> np.ndarray:
        """Where the block has each id, -1 for a new one."""
        at = self.row * PLACES + ((ids * 40503 >> 4) & (PLACES - 1))
        held = self.places[at]
        miss = np.flatnonzero((held // BLOCK_IDS != ids) & (held >= 0))
        while len(miss):
            on = at[miss] + 1
            on = np.where(on & (PLACES - 1) == 0, on - PLACES, on)
            at[miss], held[miss] = on, self.places[on]
            miss = miss[(held[miss] // BLOCK_IDS != ids[miss]) & (held[miss] >= 0)]
        self.slot = at
        return np.where(held < 0, -1, held % BLOCK_IDS)

    def kind_of(self, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(ids == self.p2, 0, np.where(ids == self.p1, 1, np.where(place >= 0, 2, 3)))

    def update(self, kind: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        row = self.row
        a, b = self.weight * self.e0[row, kind], (1 - self.weight) * self.e2[row, kind]
        self.weight = np.clip(a / (a + b), np.float32(SHARE), np.float32(1 - SHARE))
        self.by_block *= np.float32(DECAY)
        self.by_block[row, kind] += np.float32(1)
        self.held *= np.float32(DECAY)
        self.held[row, kind] += np.float32(1)
        self.by_state[self.state] = self.held
        fresh = ids << 2
        for after, at, had in ((self.after2, self.at2, self.v2), (self.after1, self.at1, self.v1)):
            # right: surer; wrong but sure before: keeps its place unsure; else the new id
            trust = had & 3
            after[at] = np.where(had >> 2 == ids, fresh | np.minimum(trust + 1, 2), np.where((trust > 0) & (had >= 0), had - trust, fresh))
        new = np.flatnonzero(place < 0)
        if len(new):
            place = place.copy()
            place[new] = self.used[new]
            self.seen[new, place[new]] = ids[new]
            self.places[self.slot[new]] = ids[new] * BLOCK_IDS + place[new]
            self.used[new] += 1
            self.width = int(self.used.max())
        self.count[row * GROUPS + place // GROUP, place % GROUP] += 1
        self.sums[row, place // GROUP] += 1
        self.step += 1
        self.last = np.stack([self.last[1], ids])

    def before(self, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts before, count) of places in the blocks ``rows``."""
        group, inside = place // GROUP, place % GROUP
        n = self.width // GROUP + 1
        c = self.count[rows * GROUPS + group]
        ahead = (self.sums[rows, :n] * (_STEP[:n] < group[:, None])).sum(1) + (c * (_STEP[:GROUP] < inside[:, None])).sum(1)
        return ahead, c[np.arange(len(rows)), inside].astype(np.int64)

    def place_at(self, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The place whose counts hold ``v`` in each block."""
        own, n = np.arange(len(rows)), self.width // GROUP + 1
        c = np.cumsum(self.sums[rows, :n], 1, dtype=np.int64)
        group = (c <= v[:, None]).sum(1)
        left = v - np.where(group > 0, c[own, group - 1], 0)
        return group * GROUP + (np.cumsum(self.count[rows * GROUPS + group], 1) <= left[:, None]).sum(1)


def _shift(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Which coders must give out 16 bits; short spans are cut first."""
    same = (low ^ (low + span)) >> _48 == 0
    short = ~same & (span <= _LOW32)
    if short.any():
        span[short] = (~low[short] + np.uint64(1)) & _LOW32
        same |= short
    return np.flatnonzero(same)


def encode_blocks(ids: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """(words of each block, crc32 of each block, codes) of a run of ids."""
    if len(ids) and int(ids.max()) >= MAX_ID:
        raise ValueError(f"ids must be below {MAX_ID}")
    law = unseen_law()
    words, sums, codes = [], [], []
    for at in range(0, len(ids), BLOCK_IDS * LANES):
        part = ids[at:at + BLOCK_IDS * LANES].astype(np.int64)
        n = -(-len(part) // BLOCK_IDS)
        table = np.zeros((n, BLOCK_IDS), np.int64)
        table.ravel()[:len(part)] = part
        m, tail = Model(n), len(part) - (n - 1) * BLOCK_IDS
        low, span = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
        out, used = np.zeros((n, 4 * BLOCK_IDS + 8), np.uint16), np.zeros(n, np.int64)

        def put(rows):
            while True:
                k = _shift(low_ := low[rows], span_ := span[rows])
                span[rows] = span_
                if not len(k):
                    return
                r = rows[k]
                out[r, used[r]] = (low_[k] >> _48).astype(np.uint16)
                used[r] += 1
                low[r] = low_[k] << _16
                span[r] = span_[k] << _16
                rows = r

        def narrowed(rows, before, count, whole):
            unit = span[rows] // np.uint64(whole)
            low[rows] += unit * before.astype(np.uint64)
            span[rows] = unit * count.astype(np.uint64)
            put(rows)

        for step in range(BLOCK_IDS):
            if step == tail and n > 0 and len(m.row) == n:
                if n == 1:
                    break
                m.narrow(n - 1)
            rows = m.row
            x = table[rows, step]
            m.predict()
            place = m.place_of(x)
            kind = m.kind_of(x, place)
            total = np.cumsum(m.share, 1, dtype=np.int64)
            freq = m.share[rows, kind]
            narrowed(rows, total[rows, kind] - freq, freq, 65536)
            known, new = rows[kind == 2], rows[kind == 3]
            if len(known):
                narrowed(known, *m.before(known, place[known]), m.step)
            if len(new):
                narrowed(new, law[x[new]], law[x[new] + 1] - law[x[new]], law[-1])
            m.update(kind, x, place)
        for k in range(4):
            out[np.arange(n), used] = (low >> _48).astype(np.uint16)
            used += 1
            low = low << _16
        raw = part.astype("<u4").tobytes()
        for i in range(n):
            words.append(int(used[i]))
            sums.append(zlib.crc32(raw[4 * BLOCK_IDS * i:4 * BLOCK_IDS * (i + 1)]))
            codes.append(out[i, :used[i]].astype("<u2").tobytes())
    return words, sums, b"".join(codes)


def decode_blocks(n_ids: int, words: list[int], sums: list[int], payload: bytes) -> np.ndarray:
    """The ids of consecutive blocks; raises ValueError where a checksum differs."""
    parts, law = [], unseen_law()
    code_at = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    data = np.frombuffer(payload, "<u2")
    for first in range(0, len(words), LANES):
        some = words[first:first + LANES]
        n = len(some)
        size = min(n * BLOCK_IDS, n_ids - first * BLOCK_IDS)
        tail = size - (n - 1) * BLOCK_IDS
        source = np.zeros((n, max(some) + 4), np.uint64)
        for i in range(n):
            source[i, :some[i]] = data[code_at[first + i]:code_at[first + i + 1]]
        m = Model(n)
        low, span, code = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        for k in range(4):
            code = (code << _16) | source[:, k]
        used = np.full(n, 4, np.int64)
        table = np.zeros((n, BLOCK_IDS), np.int64)

        def take(rows):
            while True:
                k = _shift(low_ := low[rows], span_ := span[rows])
                span[rows] = span_
                if not len(k):
                    return
                r = rows[k]
                code[r] = (code[r] << _16) | source[r, np.minimum(used[r], source.shape[1] - 1)]
                used[r] += 1
                low[r] = low_[k] << _16
                span[r] = span_[k] << _16
                rows = r

        def value(rows, whole):
            got = (code[rows] - low[rows]) // (span[rows] // np.uint64(whole))
            return np.minimum(got, np.uint64(int(whole) - 1)).astype(np.int64)

        def narrowed(rows, before, count, whole):
            unit = span[rows] // np.uint64(whole)
            low[rows] += unit * before.astype(np.uint64)
            span[rows] = unit * count.astype(np.uint64)
            take(rows)

        for step in range(BLOCK_IDS):
            if step == tail and len(m.row) == n:
                if n == 1:
                    break
                m.narrow(n - 1)
            rows = m.row
            m.predict()
            total = np.cumsum(m.share, 1, dtype=np.int64)
            kind = (total <= value(rows, 65536)[:, None]).sum(1)
            freq = m.share[rows, kind]
            narrowed(rows, total[rows, kind] - freq, freq, 65536)
            x = np.where(kind == 0, m.p2, m.p1).astype(np.int64)
            known, new = rows[kind == 2], rows[kind == 3]
            if len(known):
                at = m.place_at(known, value(known, m.step))
                narrowed(known, *m.before(known, at), m.step)
                x[known] = m.seen[known, at]
            if len(new):
                x[new] = np.searchsorted(law, value(new, law[-1]), side="right") - 1
                narrowed(new, law[x[new]], law[x[new] + 1] - law[x[new]], law[-1])
            m.update(kind, x, m.place_of(x))
            table[rows, step] = x
        got = table.ravel()[:size].astype("<u4")
        raw = got.tobytes()
        for i in range(n):
            if zlib.crc32(raw[4 * BLOCK_IDS * i:4 * BLOCK_IDS * (i + 1)]) != sums[first + i]:
                raise ValueError(f"block {first + i}: checksum differs")
        parts.append(got)
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


class Encoder:
    """The library's tokenizer over cached pre-tokens; a text that holds the
    string of an added token goes through it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordIds(lambda words: [e.ids for e in self.tokenizer.encode_batch(
            [w.decode() for w in words], add_special_tokens=False)], WORDS_KEPT)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for some in chunks(texts):
            whole = [i for i, t in enumerate(some) if any(a in t for a in self.added)]
            ids, n = self.words.ids(["" if i in set(whole) else t for i, t in enumerate(some)])
            found = np.split(ids, np.cumsum(n)[:-1])
            for i in whole:
                found[i] = np.array(self.tokenizer.encode(some[i], add_special_tokens=False).ids, np.uint32)
            out += found
        return out


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def worker_encoder(path: str) -> Encoder:
    """One per Python worker; its words serve the worker's later tasks too."""
    serve("id files", _encoder.cache_clear)
    return _encoder(path)


def _segment(bucket, start, doc_ids, parts) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    words, sums, payload = encode_blocks(ids)
    row = [[bucket], [start], [doc_ids], [[len(p) for p in parts]], [len(ids)], [words], [sums], [payload]]
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()),
             pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)


def write_ids(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Encode every text, append the end id to each document and write the
    segments under the folder ``out``, in ascending id order: the ids are cut
    into buckets, a bucket is sorted in one task, and no task holds more than
    a segment."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = id_cuts(rows.select("doc_id"), "doc_id", rows_per_bucket)
    rows = rows.withColumn("bucket", bucket_of(order_id("doc_id"), cuts).cast("int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(1, parts), "bucket").sortWithinPartitions("bucket", order_id("doc_id"), "text")

    def run(batches):
        encoder, end = worker_encoder(tokenizer), np.array([END_ID], np.uint32)
        bucket = start = None
        doc_ids, parts, size = [], [], 0
        for batch in batches:
            found = encoder.ids(batch.column("text").to_pylist())
            for b, d, ids in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), found):
                if parts and (b != bucket or size >= SEGMENT_IDS):
                    yield _segment(bucket, start, doc_ids, parts)
                    start, doc_ids, parts, size = start + size, [], [], 0
                if b != bucket:
                    bucket, start = b, 0
                doc_ids.append(d)
                parts.append(np.concatenate([ids, end]))
                size += len(ids) + 1
        if parts:
            yield _segment(bucket, start, doc_ids, parts)

    rows.select("bucket", "doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of a file set, ids as array<int>,
    start = ids of all documents before."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32).tolist(),
                 pa.list_(pa.int32()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a file set."""
    rows = _read(spark, path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def _read(spark, path, column, of, kind) -> DataFrame:
    ship_package(spark)
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_blocks(r["n_ids"], r["block_words"], r["block_crc32"], r["payload"])
                stop = np.cumsum(r["doc_lens"])
                parts = np.split(ids, stop[:-1])
                values = [of(p) for p in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["bucket"]] * len(parts), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["start"] + stop - r["doc_lens"], pa.int64()), pa.array(r["doc_lens"], pa.int64()),
                    pa.array(values, kind)], ["bucket", "doc_id", "place", "n_tokens", column.split()[0]])

    rows = files.mapInArrow(run, f"bucket int, doc_id bigint, place bigint, n_tokens bigint, {column}")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select(       # at most 65536 buckets
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(offsets), "bucket").withColumn("start", F.col("base") + F.col("place")).drop("base", "place", "bucket")


def encoded_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, out, tokenizer)
    return read_digests(docs.sparkSession, out)
