"""Conversation repair against a best-first search over all edit scripts."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from quarry.llm import turn_repair as tr

INK = " \t\n\v\f\r"


def searched(symbols):
    """(cost, least audit) by best-first search; symbols as in ``tr``."""
    n, seen, heap = len(symbols), set(), [(0, "", 0, 0)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if state == "end":
            return cost, audit
        if i == n and state in (0, 3):
            heapq.heappush(heap, (cost, audit, n, "end")) if (n, "end") not in seen else None
            return cost, audit
        to = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 5, audit + "I", i, to))
        if i == n:
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
        if symbols[i]:
            extra, initial = 5 * (symbols[i] > 4), "suao"[(symbols[i] - 1) % 4]
            if initial == "s" and state == 0:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, 1))
            if initial == {2: "a"}.get(state, "u"):
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to))
            heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, to))


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_find_the_least_cheapest_audit(block):
    rng, t = random.Random(block), tr.Tables(block)
    for _ in range(600):
        pool = rng.choice([range(9), [1, 2, 3, 3, 2, 4], [2, 2, 2, 3, 7, 0]])
        symbols = np.array([rng.choice(pool) for _ in range(rng.randint(0, 14))], np.int64)
        first, cost, behind = t.back(symbols, 0)
        edits, state = t.edits(symbols, behind, 0)
        assert (int(cost + t.vectors[first][0]), "".join(edits) + tr.closing(state)) == searched(symbols.tolist())


def plain(rows):
    """Results by conversation of damaged raw rows, in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            ink = text.strip(INK)
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            initial = "sua".find(role[0]) if role and role[0] in "sua" else 3
            symbols.append(0 if fault in (0, 1) else 1 + initial + 4 * (fault == 2))
        cost, audit = searched(symbols)
        state, left, i = 0, [], 0
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            to = 1 if letter == "K" and held[i][1][0] == "s" else 3 if state == 2 else 2
            role = held[i][1] if letter == "K" else {2: "user", 3: "assistant"}[to]
            left.append(role + ":" + ("" if letter == "I" else held[i][2]))
            i += letter != "I"
            state = to
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out[conv] = (gaps, *counts, bad, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def made(seed, n=60):
    rng, rows = random.Random(seed), []
    texts = ["Hello there.", "What is it?", "no end", "", "  \n", "Fine!  ", "same.", "same.", "日本語。", "é?", None]
    for conv in [*range(n), None]:
        length = rng.choice([1, 2, 4, 8, 8, 9, 40])
        for turn in range(length):
            role = rng.choice(["user", "assistant"]) if rng.random() < .4 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", "", None, "System"]) if rng.random() < .12 else role
            rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, rng.choice(texts) if rng.random() < .5 else f"text {rng.random()}."))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, copies int")


def rows_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain(spark, seed):
    rows = made(seed)
    assert rows_of(tr.repair(tr.damage(frame(spark, rows)))) == plain(rows)


@pytest.mark.parametrize("segment", [3, 7, 1000])
def test_giant_conversations_equal_plain(spark, segment):
    rows = made(3, 8)
    rows += [(100, k % 50, "user", "again.") for k in range(300)]           # a third of all rows are one
    got = tr.repair(tr.damage(frame(spark, rows)), giant_rows=6, segment=segment)
    assert rows_of(got) == plain(rows)


def test_turns_hash_to_the_digest(spark):
    rows = made(4, 20)
    damaged = tr.damage(frame(spark, rows))
    want = rows_of(tr.repair(damaged))
    for limit in (tr.GIANT_ROWS, 6):
        text = {}
        for r in sorted(tr.repaired_turns(damaged, giant_rows=limit, segment=5).collect(), key=lambda r: (str(r["conv_id"]), r["part"], r["k"])):
            text.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in text.items()} == \
            {k: v[-1] for k, v in want.items() if v[-1] != hashlib.sha256(b"").hexdigest()}


def test_empty_table_and_dropped_conversations(spark):
    assert tr.repair(tr.damage(frame(spark, [(1, 1, "user", "a.")]).limit(0))).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = rows_of(tr.repair(tr.damage(frame(spark, [(gone, 0, "user", "a.")]))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
