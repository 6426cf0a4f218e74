"""Conversation structure repair by cheapest edits with Four-Russians blocks.

A conversation's rows, by turn, become symbols: to be deleted (blank, or role
and text seen earlier), or the role's initial (s, u, a or another), truncated
or not.  Edits: keep 0, re-role 1, delete 2, insert an empty user or assistant
row 5; a truncated row that stays adds 5.  The rows that remain must have the
role initials ``(s?(ua)+)?``.

``V[i][state]`` is the least cost of rows i.. from a state of that pattern.
Less its least entry it takes a few values only, so the transition of every
block of ``BLOCK`` symbols is tabulated for every such normalised vector, and
a conversation is worked through backward by look-ups, a block each.  For the
trace, from the front, each block is expanded backward from the vector behind
it and the least edit letter on a cheapest way is taken: the audit is the
ASCII-least of all cheapest ones.

Rows are shuffled once by conversation.  One with more than ``GIANT_ROWS``
rows or ``GIANT_CHARS`` characters (ids counted first; at most rows /
``GIANT_ROWS`` + characters / ``GIANT_CHARS`` ids, broadcast) is cut into
segments of ``SEGMENT`` rows: a segment's transitions for all vectors are
computed alone, composed, and traced from all four states, so no task holds
such a conversation.  Its digest is taken over sorted rows, one at a time.

Null roles and texts are one space.  Rows of the same turn, null turns first,
go by role, then text; equal rows are duplicates.  An empty role has no
initial of the pattern.  A null conversation id is a conversation.  No rows,
no result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import serve, ship_package, slices
from quarry.operators.order import global_row_number
from quarry.session import written

BLOCK = 4
GIANT_ROWS = 50_000
GIANT_CHARS = 64 << 20
SEGMENT = 16_384
# Costs of the edits and what a kept truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbols: 0 must go; 1-4 initials s, u, a, another; 5-8 the same, truncated.
INITIALS = "sua"
SYMBOLS = 9
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
NEXT_ROLE = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
FINAL = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 30
_SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}


def symbol(role: str, blank: bool, duplicate: bool, truncated: bool) -> int:
    if blank or duplicate:
        return 0
    return 1 + (INITIALS.find(role[0]) if role[:1] and role[0] in INITIALS else 3) + 4 * truncated


def _kept_to(state: int, initial: int) -> int | None:
    """State after keeping a row of an initial (0 s, 1 u, 2 a, 3 another)."""
    if initial == 0:
        return 1 if state == 0 else None
    to = {1: 2, 2: 3}.get(initial)
    return to if to == NEXT_ROLE[state] else None


def _options(sym: int, after: tuple, state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, letter, next state) of the edits that take the row."""
    out = [(DELETE + after[state], "D", state)]
    if sym:
        initial, extra = (sym - 1) % 4, TRUNCATED * (sym > 4)
        to = _kept_to(state, initial)
        if to is not None:
            out.append((KEEP + extra + after[to], "K", to))
        to = NEXT_ROLE[state]
        out.append((REROLE + extra + after[to], "R", to))
    return out


def _before(sym: int, after: tuple) -> tuple:
    """V[i] from V[i + 1]: take the row at once, or insert first."""
    v = [min(o[0] for o in _options(sym, after, s)) for s in range(4)]
    for _ in range(3):
        v = [min(v[s], INSERT + v[NEXT_ROLE[s]]) for s in range(4)]
    return tuple(v)


class Tables:
    """Normalised vectors, transitions of symbols and of blocks, and traces."""

    def __init__(self, block: int = BLOCK):
        ids, todo = {FINAL: 0}, [FINAL]
        step: dict[tuple[int, int], tuple[int, int]] = {}
        for v in todo:
            for sym in range(SYMBOLS):
                w = _before(sym, v)
                low = min(w)
                w = tuple(x - low for x in w)
                if w not in ids:
                    ids[w] = len(ids)
                    todo.append(w)
                step[sym, ids[v]] = ids[w], low
        self.vectors, self.block = np.array(todo, np.int64), block
        n = len(todo)
        one = np.array([[step[sym, v] for v in range(n)] for sym in range(SYMBOLS)], np.int64)
        self.to1, self.cost1 = one[..., 0], one[..., 1]
        to, cost = self.to1, self.cost1             # blocks of 1 symbol, then of one more in front
        for _ in range(block - 1):
            to, cost = (np.concatenate([self.to1[s][to] for s in range(SYMBOLS)]),
                        np.concatenate([cost + self.cost1[s][to] for s in range(SYMBOLS)]))
        self.to, self.cost = to, cost
        self.trace = [[[self._edits(sym, todo[v], s) for s in range(4)] for v in range(n)] for sym in range(SYMBOLS)]

    @staticmethod
    def _edits(sym: int, after: tuple, state: int) -> tuple[str, int]:
        """Least letters on a cheapest way from a state through the row."""
        v, letters = _before(sym, after), ""
        while True:
            ways = [o for o in _options(sym, after, state) if o[0] == v[state]]
            ways += [(0, "I", NEXT_ROLE[state])] if INSERT + v[NEXT_ROLE[state]] == v[state] else []
            _, letter, state = min(ways, key=lambda o: o[1])
            letters += letter
            if letter != "I":
                return letters, state

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols in front that fill no block, block codes in order)."""
        odd = len(symbols) % self.block
        weight = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        return symbols[:odd], symbols[odd:].reshape(-1, self.block).astype(np.int64) @ weight

    def back(self, symbols: np.ndarray, vector):
        """(vector before, cost, vectors behind each block in order) from
        ``vector`` behind the symbols; an array of vectors goes as well."""
        odd, codes = self.codes(symbols)
        cost, behind = vector * 0, []
        for code in codes[::-1].tolist():
            behind.append(vector)
            cost = cost + self.cost[code][vector]
            vector = self.to[code][vector]
        behind.append(vector)
        for sym in odd[::-1].tolist():
            cost = cost + self.cost1[sym][vector]
            vector = self.to1[sym][vector]
        return vector, cost, behind[::-1]

    def edits(self, symbols: np.ndarray, behind: list[int], state: int) -> tuple[list[str], int]:
        """The letters of every row, and the state after the last one."""
        odd = len(symbols) % self.block
        out, at, syms = [], 0, symbols.tolist()
        for k, vector in enumerate(behind):
            end = odd + k * self.block
            inside = [0] * (end - at)                   # the vector behind each row of the block
            for i in range(end - at - 1, -1, -1):
                inside[i] = vector
                vector = self.to1[syms[at + i], vector]
            for i in range(end - at):
                letters, state = self.trace[syms[at + i]][inside[i]][state]
                out.append(letters)
            at = end
        return out, state


@functools.lru_cache(4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def closing(state: int) -> str:
    return "I" * {0: 0, 1: 2, 2: 1, 3: 0}[state]


def apply_edits(rows: list[tuple[str, str]], edits: list[str], state: int) -> list[tuple[str, str, str]]:
    """(role, text, letter) of what remains after the letters of every row."""
    out = []
    for (role, text), letters in zip(rows, edits):
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                state = 1 if role[0] == "s" else NEXT_ROLE[state]
                out.append((role, text, "K"))
                continue
            state = NEXT_ROLE[state]
            out.append((ROLE_OF[state], text if letter == "R" else "", letter))
    return out


def faults(rows: list[tuple[str, str]]) -> tuple[np.ndarray, list[int]]:
    """(symbols, [blank, duplicate, truncated]) of rows in order."""
    seen, counts, out = set(), [0, 0, 0], []
    for role, text in rows:
        ink, key = text.rstrip(_SPACE), (role, text)
        blank, duplicate = not ink, key in seen
        truncated = not blank and not duplicate and ink[-1] not in ".!?"
        seen.add(key)
        for k, x in enumerate((blank, duplicate and not blank, truncated)):
            counts[k] += x
        out.append(symbol(role, blank, duplicate, truncated))
    return np.array(out, np.int64), counts


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repaired(rows: list[tuple[int | None, str, str]]) -> dict:
    """Result of one conversation; rows (turn, role, text) in order."""
    pairs = [(r, x) for _, r, x in rows]
    symbols, (blank, duplicate, truncated) = faults(pairs)
    t = tables()
    first, cost, behind = t.back(symbols, 0)
    edits, state = t.edits(symbols, behind, 0)
    edits.append(closing(state))
    turns = apply_edits([*pairs, ("", "")], edits, 0)
    return {"gaps": gaps([k for k, _, _ in rows]), "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": illegal([r[:1] for r, _ in pairs]), "cost": int(cost + t.vectors[first][0]), "audit": "".join(edits),
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x, _ in turns).encode()).hexdigest(), "turns": turns}


# ------------------------------------------------------------------ Spark
def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a digest of their
    id and turn.  ``copies`` 0 stands for a dropped row, 2 for a repeated one."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(name("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_ROW = "key string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_TURN = "key string, part bigint, k bigint, role string, text string, edit string"


def _keyed(rows: DataFrame) -> DataFrame:
    one = F.col("copies") if "copies" in rows.columns else F.lit(1)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("turn").cast("bigint").alias("turn"),
                       space("role").alias("role"), space("text").alias("text"), one.cast("int").alias("copies"))


def _split(rows: DataFrame, giant_rows: int, giant_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary conversations, and of giant ones if there are any."""
    sizes = rows.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("c"))
    giants = written(sizes.where((F.col("n") > giant_rows) | (F.col("c") > giant_chars)).select("key"), "repair-giants")
    if giants.isEmpty():
        return rows, None
    return rows.join(F.broadcast(giants), "key", "left_anti"), rows.join(F.broadcast(giants), "key", "left_semi")


def _conversations(batches):
    """(key, rows in order) of a sorted partition, one conversation at a time."""
    key, held = None, []
    for batch in slices(batches):
        cols = [batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "copies")]
        for k, turn, role, text, copies in zip(*cols):
            if k != key:
                if key is not None:
                    yield key, held
                key, held = k, []
            held.extend([(turn, role, text)] * copies)
    if key is not None:
        yield key, held


def _ordinary(rows: DataFrame, turns: bool) -> DataFrame:
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches):
        serve("turn_repair")
        out = []
        for key, held in _conversations(batches):
            r = repaired(held)
            out += [(key, 0, k, *t) for k, t in enumerate(r["turns"])] if turns else \
                [(key, *(r[c] for c in _COUNTS), r["audit"], r["repaired_sha256"])]
            if len(out) >= 1_000:
                yield _columns(out, turns)
                out = []
        yield _columns(out, turns)

    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, _TURN if turns else _ROW)


def _columns(rows: list[tuple], turns: bool) -> pa.RecordBatch:
    return _table(_TURN if turns else _ROW, rows).combine_chunks().to_batches()[0] if rows else \
        pa.RecordBatch.from_pylist([], _table(_TURN if turns else _ROW, []).schema)


def _giant(rows: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """(result rows but for the digest, remaining turns) of giant conversations."""
    rows = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) \
        .withColumn("tie", F.monotonically_increasing_id())
    order = ["key", "turn", "role", "text", "copy", "tie"]
    rows = written(global_row_number(rows.drop("copies"), order), "repair-rows")
    base = rows.groupBy("key").agg(F.min("rn").alias("base"))
    rows = rows.join(F.broadcast(base), "key").withColumn("pos", F.col("rn") - F.col("base")) \
        .withColumn("part", F.floor(F.col("pos") / segment))
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    firsts = rows.groupBy("key", digest.alias("d")).agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("new"))
    ink = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    marked = rows.join(firsts, ["key", "pos"], "left").select(
        "key", "part", "pos", "turn", initial.alias("initial"), (ink == "").alias("blank"),
        F.coalesce("new", F.lit(False)).alias("new"), (~ink.isin(".", "!", "?")).alias("open"))
    at = F.expr(f"locate(initial, '{INITIALS}')")
    kind = F.when((F.col("initial") == "") | (at == 0), 4).otherwise(at)
    marked = written(marked.select(
        "key", "part", "pos", "turn", "initial", F.col("blank"), (~F.col("blank") & ~F.col("new")).alias("duplicate"),
        (~F.col("blank") & F.col("new") & F.col("open")).alias("truncated"))
        .withColumn("sym", F.when(F.col("blank") | F.col("duplicate"), 0).otherwise(kind + F.when(F.col("truncated"), 4).otherwise(0))
                    .cast("bigint")), "repair-symbols")
    narrow = marked.select("key", "part", "pos", "initial", "sym")

    def forth(group: pa.Table) -> pa.Table:
        c, t = _ordered(group, "pos"), tables()
        first, cost, _ = t.back(np.array(c["sym"]), np.arange(len(t.vectors)))
        return _table(moves_type, [(c["key"][0], c["part"][0], first.tobytes(), cost.tobytes(), c["initial"][0], c["initial"][-1],
                                    illegal(c["initial"]))])

    moves_type = "key string, part bigint, to binary, cost binary, head string, tail string, illegal bigint"
    moves = narrow.groupBy("key", "part").applyInArrow(forth, moves_type)

    def chain(group: pa.Table) -> pa.Table:
        c, t = _ordered(group, "part"), tables()
        vector, cost, behind = 0, 0, []
        for to, price in zip(c["to"][::-1], c["cost"][::-1]):
            behind.append(vector)
            cost += int(np.frombuffer(price, np.int64)[vector])
            vector = int(np.frombuffer(to, np.int64)[vector])
        cost += int(t.vectors[vector][0])
        bad = sum(c["illegal"]) + sum(a + b not in LEGAL for a, b in zip(c["tail"], c["head"][1:]))
        return _table(chain_type, [(k, p, v, cost, bad) for k, p, v in zip(c["key"], c["part"], behind[::-1])])

    chain_type = "key string, part bigint, vector bigint, cost bigint, illegal bigint"
    chained = written(moves.groupBy("key").applyInArrow(chain, chain_type), "repair-vectors")

    def traced(group: pa.Table) -> pa.Table:
        c, t = _ordered(group, "pos"), tables()
        symbols = np.array(c["sym"])
        behind = t.back(symbols, c["vector"][0])[2]
        ways = [t.edits(symbols, behind, s) for s in range(4)]
        return _table(way_type, [(c["key"][0], c["part"][0], s, end, ",".join(edits)) for s, (edits, end) in enumerate(ways)])

    way_type = "key string, part bigint, state bigint, ends bigint, edits string"
    ways = written(narrow.join(chained.select("key", "part", "vector"), ["key", "part"]).groupBy("key", "part")
                   .applyInArrow(traced, way_type), "repair-ways")

    def walk(group: pa.Table) -> pa.Table:
        c = _ordered(group, "part")
        ends = {(p, s): e for p, s, e in zip(c["part"], c["state"], c["ends"])}
        state, parts, out = 0, sorted(set(c["part"])), []
        for p in parts:
            out.append((c["key"][0], p, state, p == parts[-1]))
            state = ends[p, state]
        return _table(walk_type, out)

    walk_type = "key string, part bigint, state bigint, last boolean"
    walked = ways.select("key", "part", "state", "ends").groupBy("key").applyInArrow(walk, walk_type)
    chosen = written(ways.join(walked, ["key", "part", "state"]), "repair-edits")

    def turned(group: pa.Table) -> pa.Table:
        c = _ordered(group, "pos")
        edits, held = c["edits"][0].split(","), list(zip(c["role"], c["text"]))
        if c["last"][0]:
            edits, held = [*edits, closing(c["ends"][0])], [*held, ("", "")]
        left = apply_edits(held, edits, c["state"][0])
        return _table(_TURN, [(c["key"][0], c["part"][0], k, *x) for k, x in enumerate(left)])

    turns = rows.select("key", "part", "pos", "role", "text").join(chosen, ["key", "part"]).groupBy("key", "part").applyInArrow(turned, _TURN)
    known = marked.groupBy("key").agg(
        *(F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")),
        (F.max("turn") - F.min("turn") + 1).alias("span"))
    distinct = marked.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(F.count("*").alias("turns"))
    known = known.join(distinct, "key", "left").withColumn("gaps", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)))
    shared = chained.groupBy("key").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    tail = chosen.where("last").select("key", F.col("ends").alias("end"))
    audits = chosen.select("key", "part", F.regexp_replace("edits", ",", "").alias("edits"))

    def joined(batches):
        key, letters = None, []
        for batch in batches:
            for k, e in zip(batch.column("key").to_pylist(), batch.column("edits").to_pylist()):
                if k != key and key is not None:
                    yield _pairs(key, "".join(letters))
                    letters = []
                key = k
                letters.append(e)
        if key is not None:
            yield _pairs(key, "".join(letters))

    audit = audits.repartition("key").sortWithinPartitions("key", "part").mapInArrow(joined, "key string, value string")
    end = F.element_at(F.array(F.lit(""), F.lit("II"), F.lit("I"), F.lit("")), F.col("end").cast("int") + 1)
    audit = audit.join(tail, "key").select("key", F.concat("value", end).alias("audit"))
    return known.join(shared, "key").join(audit, "key"), turns


def _ordered(group: pa.Table, by: str) -> dict[str, list]:
    return group.sort_by(by).to_pydict()


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], _KINDS[kind]) for i, (name, kind) in enumerate(fields)})


def _pairs(key: str, value: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([value])], ["key", "value"])


def _digests(turns: DataFrame) -> DataFrame:
    """(key, value): sha256 of each conversation's turns, a row at a time."""
    def run(batches):
        key, h = None, None
        for batch in slices(batches):
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text"))):
                if k != key:
                    if key is not None:
                        yield _pairs(key, h.hexdigest())
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
        if key is not None:
            yield _pairs(key, h.hexdigest())

    return turns.repartition("key").sortWithinPartitions("key", "part", "k").mapInArrow(run, "key string, value string")


def repair(rows: DataFrame, giant_rows: int = GIANT_ROWS, giant_chars: int = GIANT_CHARS, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of every conversation of ``rows`` (conv_id, turn, role,
    text and, where given, copies: how often a row stands there, 0 for one
    that only names its conversation)."""
    ship_package(rows.sparkSession)
    small, giant = _split(_keyed(rows), giant_rows, giant_chars)
    out = _ordinary(small, turns=False)
    if giant is not None:
        known, turns = _giant(giant, segment)
        digests = _digests(turns).withColumnRenamed("value", "repaired_sha256")
        out = out.unionByName(known.join(digests, "key", "left").select(
            "key", *_COUNTS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
    return out.select(_id().alias("conv_id"), *_COUNTS, "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame, giant_rows: int = GIANT_ROWS, giant_chars: int = GIANT_CHARS, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, k, role, text, edit): what remains of every
    conversation, in the order of part and k; edit is K, R or I."""
    ship_package(rows.sparkSession)
    small, giant = _split(_keyed(rows), giant_rows, giant_chars)
    out = _ordinary(small, turns=True)
    if giant is not None:
        out = out.unionByName(_giant(giant, segment)[1])
    return out.select(_id().alias("conv_id"), "part", "k", "role", "text", "edit")


def _id():
    return F.when(F.col("key") != "", F.col("key")).cast("bigint")
