"""Benchmark decontamination with an FM-index per training shard.

Words are the runs of digits, letters a-z (A-Z in lower case) and characters
beyond ASCII.  A benchmark item's windows are its runs of ``WINDOW`` words, or
the whole item where it has fewer.  A shard is a stretch of a task's documents
of about ``SHARD_WORDS`` words; a longer document goes on in the next shard
with an overlap of a window.  Words that no benchmark item has become
terminators, each smaller than all words and different from every other, which
no phrase can match.

Per shard the suffixes are sorted by prefix doubling, and the words before
them (the Burrows-Wheeler transform) go into a wavelet matrix.  All windows
are searched backward at once, two ranks a word; the rows that remain walk
back to the nearest sampled suffix position, which gives their places.  Hit
words are merged into removal spans.

Nothing is shuffled and no text leaves its task.  The benchmark is the query
set: its items go to the tasks in blocks of at most ``BLOCK_WORDS`` words
(a longer item in overlapping parts); with more than one block, results meet
by text digest.  A document word stands for the benchmark word of the same
64-bit hash and length.

Null or empty texts have no words; documents and items without words, and an
empty benchmark, hit nothing.  Repeated rows get their own result rows; items
with the same id count once, a null id counts as the id ''.  Columns other
than id and text are ignored by ``contamination``, kept by ``without_spans``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import serve, ship_package, slices
from quarry.llm.shingles import mix

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 2_000_000
GROUP_BYTES = 1 << 20
SAMPLE = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_P = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.r_[np.uint64(1), np.full(2 * GROUP_BYTES, _P, np.uint64)])
_DOWN = np.cumprod(np.r_[np.uint64(1), np.full(2 * GROUP_BYTES, pow(_P, -1, 1 << 64), np.uint64)])


# ------------------------------------------------------------------ words
def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of every word of ``joined``."""
    b = np.frombuffer(joined, np.uint8)
    edge = np.diff(_WORD[b].astype(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty(0, np.uint64), first, after
    up, down = _UP, _DOWN
    if len(b) >= len(up):                       # one word longer than a group
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(b), _P, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(len(b), pow(_P, -1, 1 << 64), np.uint64)])
    total = np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * up[:len(b)], dtype=np.uint64)
    sums = total[after - 1] - np.where(first > 0, total[first - 1], np.uint64(0))
    return mix(sums * down[first] + (after - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, after


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``GROUP_BYTES``, cut between words."""
    at = 0
    while len(text) - at > GROUP_BYTES:
        cut = _BREAK.search(text, at + GROUP_BYTES)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


# ------------------------------------------------------------------ phrases
@dataclass
class Phrases:
    """A block of the query set.  ``words`` are the ids (1..) of all its words
    one after another; window k is ``words[start[k]:start[k] + length[k]]`` and
    belongs to the items ``items[first[k]:first[k + 1]]`` (indices into
    ``names``, which is sorted)."""
    hashes: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(rows: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    """The distinct windows of (item id, text) rows."""
    names = sorted({name for name, _ in rows})
    place = {name: k for k, name in enumerate(names)}
    hashes, sizes, spans, n = [], [], [], 0
    for name, text in rows:
        h, first, after = (np.concatenate(x) for x in zip(*(word_spans(p) for p in pieces(text))))
        hashes.append(h)
        sizes.append(after - first)
        spans.append((place[name], n, len(h)))
        n += len(h)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    vocabulary, at, ids = np.unique(h, return_index=True, return_inverse=True)
    seen: dict[tuple, tuple[int, set]] = {}
    words = (ids + 1).astype(np.int32)
    for item, at0, count in spans:
        for a in range(at0, at0 + max(1, count - window + 1)) if count else ():
            key = words[a:min(a + window, at0 + count)].tobytes()
            seen.setdefault(key, (a, set()))[1].add(item)
    starts = np.array([a for a, _ in seen.values()], np.int64)
    lengths = np.array([len(k) // 4 for k in seen], np.int64)
    groups = [sorted(s) for _, s in seen.values()]
    return Phrases(vocabulary, size[at], words, starts, lengths, np.cumsum([0] + [len(g) for g in groups]),
                   np.array([i for g in groups for i in g], np.int64), names)


# ------------------------------------------------------------------ index
def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of the symbols ``t`` (int, the last one 0); every 0 is a
    terminator of its own, the earlier the smaller."""
    n = len(t)
    side = int(t.max()).bit_length() if n else 1
    first = max(1, min(n, 62 // max(1, side)))
    key, live = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(first):
        symbol = np.zeros(n, np.uint64)
        symbol[:n - k] = t[k:]
        live &= symbol > 0                      # nothing counts after a terminator
        key = (key << np.uint64(side)) | np.where(live, symbol, np.uint64(0))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    del key
    fresh = np.r_[True, ordered[1:] != ordered[:-1]] | ~live[order]     # with a terminator, position decides
    del ordered
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    single = fresh & np.r_[fresh[1:], True]
    open_ = order[~single]                      # suffixes that others still equal, in order
    h = first
    while len(open_):
        base = rank[open_]
        pair = base * n + rank[open_ + h]
        turn = np.argsort(pair, kind="stable")
        open_, base, pair = open_[turn], base[turn], pair[turn]
        head = np.r_[True, base[1:] != base[:-1]]
        within = np.arange(len(base)) - np.maximum.accumulate(np.where(head, np.arange(len(base)), 0))
        slot = base + within
        order[slot] = open_
        fresh = np.r_[True, pair[1:] != pair[:-1]]
        rank[open_] = slot[np.maximum.accumulate(np.where(fresh, np.arange(len(base)), 0))]
        open_ = open_[~(fresh & np.r_[fresh[1:], True])]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols 0..``top`` in a sequence, a bit vector a level."""

    def __init__(self, s: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.n = len(s)
        self.bits, self.ones, self.zeros = [], [], []
        s = s.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.bits.append(packed)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])
        self.start = np.searchsorted(self._final(s), self._final(np.arange(top + 1, dtype=np.uint32)))

    def _final(self, s: np.ndarray) -> np.ndarray:
        """Order of the symbols after the last level: by reversed bits."""
        out = np.zeros(len(s), np.uint32)
        for level in range(self.levels):
            out = (out << np.uint32(1)) | ((s >> np.uint32(level)) & np.uint32(1))
        return out

    def _rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[k][word] + np.bitwise_count(self.bits[k][word] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1
            r = self._rank1(k, at)
            at = np.where(one == 1, self.zeros[k] + r, at - r)
        return at - self.start[symbol]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its rank) at each place."""
        symbol = np.zeros(len(place), np.int64)
        for k in range(self.levels):
            one = ((self.bits[k][place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            r = self._rank1(k, place)
            place = np.where(one == 1, self.zeros[k] + r, place - r)
            symbol = symbol * 2 + one
        return symbol, place - self.start[symbol]


class FMIndex:
    """Index of a sequence of symbols (0: terminators, the last one included)."""

    def __init__(self, t: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_order(t)
        before = t[order - 1]                                   # t[-1] is a terminator
        self.before = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(t, minlength=top + 1), out=self.before[1:])
        self.tree = WaveletMatrix(before, top)
        known = (order % sample == 0) | (before == 0)           # a walk never crosses a terminator
        self.known = known
        self.nth = np.cumsum(known) - 1
        self.place = order[known]

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) rows of the suffixes that begin with each phrase
        ``words[start:start + length]``, by backward search of all at once."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.tree.n, np.int64)
        live = np.arange(len(start))
        for step in range(int(length.max(initial=0))):
            going = live[step < length[live]]
            c = words[start[going] + length[going] - 1 - step].astype(np.int64)
            for edge in (low, high):
                edge[going] = self.before[c] + self.tree.rank(c, edge[going])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text place of each row: back to the next sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.known[rows]
            out[todo[done]] = self.place[self.nth[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            c, r = self.tree.at(rows)
            rows = self.before[c] + r
            steps += 1
        return out


# ------------------------------------------------------------------ shards
class Found:
    """A document's result: number of words, merged spans of hit words (word
    numbers, end exclusive) and the sorted windows that occur."""

    def __init__(self) -> None:
        self.words, self.runs, self.parts = 0, [], []

    @property
    def spans(self) -> list[tuple[int, int]]:
        """The runs of hit words; those of two shards may overlap."""
        out: list[tuple[int, int]] = []
        for a, z in sorted(self.runs):
            if out and out[-1][1] >= a:
                a, z = out[-1][0], max(z, out.pop()[1])
            out.append((a, z))
        return out

    @property
    def windows(self) -> np.ndarray:
        return np.unique(np.concatenate(self.parts)) if self.parts else np.empty(0, np.int64)

    @property
    def hit(self) -> int:
        return sum(z - a for a, z in self.spans)


def symbols(texts: Iterator[bytes], p: Phrases) -> Iterator[tuple[np.ndarray, bool]]:
    """(word ids, whether the text ends here) of the texts, piece by piece."""
    group, size = [], 0
    for text in texts:
        parts = list(pieces(text))
        for k, part in enumerate(parts):
            group.append((part, k == len(parts) - 1))
            size += len(part) + 1
            if size >= GROUP_BYTES:
                yield from _ids(group, p)
                group, size = [], 0
    yield from _ids(group, p)


def _ids(group: list[tuple[bytes, bool]], p: Phrases) -> Iterator[tuple[np.ndarray, bool]]:
    h, first, after = word_spans(b"\n".join(x[0] for x in group))
    ids = np.zeros(len(h), np.int32)
    if len(p.hashes):
        slot = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
        ids = np.where((p.hashes[slot] == h) & (p.sizes[slot] == after - first), slot + 1, 0).astype(np.int32)
    cuts = np.searchsorted(first, np.cumsum([0] + [len(x[0]) + 1 for x in group]))
    for (_, last), a, z in zip(group, cuts[:-1].tolist(), cuts[1:].tolist()):
        yield ids[a:z], last


def scan(texts: Iterator[bytes], p: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[Found]:
    """The result of every text, in order, as its last shard is done."""
    shard = Shard(p)
    limit = max(shard_words, 2 * shard.overlap + 2)
    for ids, last in symbols(texts, p):
        while True:
            room = limit - shard.size
            shard.put(ids[:room])
            ids = ids[room:]
            if last and not len(ids):
                shard.end()
            if shard.size >= limit:
                yield from shard.searched()
            if not len(ids):
                break
    yield from shard.searched()


class Shard:
    """Word ids of documents, each but an unfinished last one closed by a 0."""

    def __init__(self, p: Phrases):
        self.p, self.overlap = p, max(0, int(p.length.max(initial=1)) - 1)
        self.ids: list[np.ndarray] = []
        self.docs: list[Found] = []
        self.at: list[int] = []                 # place of each document's first word here
        self.base: list[int] = []               # the number of that word in its document
        self.size, self.open = 0, False

    def put(self, ids: np.ndarray) -> None:
        if not self.open:
            self._begin(Found(), 0)
        self.ids.append(ids)
        self.size += len(ids)
        self.docs[-1].words += len(ids)

    def end(self) -> None:
        self.ids.append(np.zeros(1, np.int32))
        self.size += 1
        self.open = False

    def _begin(self, doc: Found, base: int) -> None:
        self.docs.append(doc)
        self.at.append(self.size)
        self.base.append(base)
        self.open = True

    def searched(self) -> Iterator[Found]:
        """Search the shard and hand out its finished documents; an
        unfinished one goes on with the overlap."""
        t = np.concatenate([*self.ids, np.zeros(1, np.int32)])
        if len(self.p.start) and t.any():
            self._collect(t)
        going = self.docs.pop() if self.open else None
        begin = self.at[-1] if self.open else 0
        yield from self.docs
        self.ids, self.docs, self.at, self.base, self.size, self.open = [], [], [], [], 0, False
        if going is not None:
            tail = t[begin:-1]
            tail = tail[len(tail) - min(len(tail), self.overlap):]
            self._begin(going, going.words - len(tail))
            self.ids, self.size = [tail], len(tail)

    def _collect(self, t: np.ndarray) -> None:
        place, window = occurrences(t, self.p)
        at, many = np.array(self.at), len(self.p.start)
        depth = np.zeros(len(t) + 1, np.int64)
        np.add.at(depth, place, 1)
        np.add.at(depth, place + self.p.length[window], -1)
        edge = np.diff((np.cumsum(depth) > 0).astype(np.int8), prepend=0, append=0)
        for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            k = int(np.searchsorted(at, a, side="right")) - 1
            spans, shift = self.docs[k].runs, self.base[k] - self.at[k]
            spans.append((a + shift, z + shift))
        pair = np.unique((np.searchsorted(at, place, side="right") - 1) * many + window)
        owner, window = pair // many, pair % many
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
        for k, part in zip(owner[cuts].tolist(), np.split(window, cuts[1:])):
            self.docs[k].parts.append(part)


def occurrences(t: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every window in the word ids ``t`` (0: no word of a
    phrase, the last one included).  A run of zeros is indexed as one
    terminator."""
    at = np.flatnonzero(np.r_[True, (t[1:] != 0) | (t[:-1] != 0)])
    index = FMIndex(t[at], len(p.hashes))
    low, high = index.search(p.words, p.start, p.length)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return at[index.locate(rows)], window


# ------------------------------------------------------------------ Spark
def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """(item id, text) lists of at most about ``block_words`` words, read one
    block at a time; a longer item is cut into parts that overlap by a window.
    Sizes are bounded by bytes: a word has at least one, and one gap."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text")) \
        .where(F.length("text") > 0)
    held, size = [], 0
    for r in rows.toLocalIterator():
        for part in _overlapping(r["text"].encode(), window, 2 * block_words):
            if held and size + len(part) > 2 * block_words:
                yield held
                held, size = [], 0
            held.append((r["name"], part))
            size += len(part)
    yield held


def _overlapping(text: bytes, window: int, most: int) -> Iterator[bytes]:
    if len(text) <= most:
        yield text
        return
    _, first, after = (np.concatenate(x) for x in zip(*_shifted(text)))
    a = 0
    while a < len(first):
        z = max(min(int(np.searchsorted(after, first[a] + most, side="right")), len(first)), min(a + 2 * window, len(first)))
        yield text[first[a]:after[z - 1]]
        if z == len(first):
            return
        a = z - window + 1


def _shifted(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``word_spans`` of the whole text, piece by piece."""
    shift = 0
    for part in pieces(text):
        h, first, after = word_spans(part)
        yield h, first + shift, after + shift
        shift += len(part)


_RESULT = "id bigint, digest string, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _block(docs: DataFrame, held: list[tuple[str, bytes]], id_col: str, text_col: str, window: int, shard_words: int) -> DataFrame:
    """(id, digest, n_words, spans, items) of every row for one block."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases(held, window))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest"),
                       F.col(text_col).alias("text"))

    def run(batches):
        serve("fm_index")
        p, waiting = sent.value, []

        def texts():
            for batch in slices(batches):
                ids, digests = batch.column("id").to_pylist(), batch.column("digest").to_pylist()
                for i, d, t in zip(ids, digests, batch.column("text").to_pylist()):
                    waiting.append((i, d))
                    yield (t or "").encode()
        out = []
        for found in scan(texts(), p, shard_words):
            out.append((*waiting.pop(0), found))
            if len(out) == 1_000:
                yield _batch(out, p)
                out = []
        yield _batch(out, p)

    return rows.mapInArrow(run, _RESULT)


def _batch(rows: list, p: Phrases) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    items = []
    for *_, f in rows:
        w = f.windows
        owners = np.unique(np.concatenate([p.items[p.first[k]:p.first[k + 1]] for k in w])) if len(w) else []
        items.append([p.names[k] for k in owners])
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
        pa.array([r[2].words for r in rows], pa.int64()),
        pa.array([[{"start": a, "end": z} for a, z in r[2].spans] for r in rows], spans),
        pa.array(items, pa.list_(pa.string()))], ["id", "digest", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: spans are the merged runs
    of hit words (numbers of words, end exclusive), items the ids of the items
    with occurring windows, sorted as strings."""
    return _results(docs, benchmark, id_col, text_col, item_col, item_text, window, shard_words, block_words).drop("digest")


def _results(docs, benchmark, id_col, text_col, item_col, item_text, window, shard_words, block_words) -> DataFrame:
    ship_package(docs.sparkSession)
    blocks = phrase_blocks(benchmark, item_col, item_text, window, block_words)
    parts = [_block(docs, held, id_col, text_col, window, shard_words) for held in blocks]
    if len(parts) == 1:
        return parts[0].withColumnRenamed("id", "doc_id")
    # spans of one text from several blocks: texts that are hit, once each, by digest
    base, hits = parts[0], None
    for part in parts:
        hit = part.where(F.size("items") > 0).select("digest", "spans", "items").dropDuplicates(["digest"])
        hits = hit if hits is None else hits.unionByName(hit)
    merged = hits.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
                                        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    merged = merged.select("digest", "i", _merged("s").alias("s"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return base.select("id", "digest", "n_words").join(merged, "digest", "left").select(
        F.col("id").alias("doc_id"), "digest", "n_words", F.coalesce("s", none).alias("spans"),
        F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def _merged(col: str):
    """Sorted spans with touching ones made one."""
    last = lambda acc: F.element_at(acc, -1)
    one = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(col, one, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row."""
    found = contamination(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    _, first, after = (np.concatenate(x) for x in zip(*_shifted(raw)))
    out, at = [], 0
    for a, z in spans:
        out.append(raw[at:first[a]])
        at = int(after[z - 1])
    return b"".join([*out, raw[at:]]).decode()


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts; every row stays
    with all its columns.  Results meet their texts by digest: only hit texts
    are looked up, each once."""
    hits = _results(docs, benchmark, id_col, text_col, item_col, item_text, window, shard_words, block_words) \
        .where(F.size("spans") > 0).select("digest", "spans").dropDuplicates(["digest"])
    key, value = (_free(docs, x) for x in ("digest", "spans"))
    rows = docs.withColumn(key, F.sha2(F.coalesce(text_col, F.lit("")), 256)).join(
        hits.toDF(key, value), key, "left")
    cut = F.pandas_udf(lambda t, s: t.combine(s, lambda a, b: a if b is None else cut_spans(a, [(x["start"], x["end"]) for x in b])), "string")
    return rows.withColumn(text_col, F.when(F.col(value).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(value)))) \
        .select(docs.columns)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name
