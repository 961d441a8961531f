"""Conversation repair against a search over all edits, by chunks of several sizes, and its SQL."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from syncsift.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(faults, cost, audit, lines) by a search in the order of (cost, audit)."""
    seen, faults = set(), []
    for role, text in rows:
        t = text.strip(SPACE)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "start", ())], set()
    after = {"start": ("user", "asked"), "system": ("user", "asked"), "asked": ("assistant", "answered"), "answered": ("user", "asked")}
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("start", "answered"):
            return faults, cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        role, then = after[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, then, (*lines, f"{role}:")))
        if i == len(rows):
            continue
        (own, text), fault = rows[i], faults[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if fault not in ("blank", "duplicate"):
            cost += 5 * (fault == "truncated")
            heapq.heappush(heap, (cost + 1, audit + "R", i + 1, then, (*lines, f"{role}:{text}")))
            if own[:1] == role[0]:
                heapq.heappush(heap, (cost, audit + "K", i + 1, then, (*lines, f"{own}:{text}")))
            if state == "start" and own[:1] == "s":
                heapq.heappush(heap, (cost, audit + "K", i + 1, "system", (*lines, f"{own}:{text}")))


def restated(rows):
    held, spaced = defaultdict(list), lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else spaced(role), "" if kind == 1 else spaced(text)
        text = "".join(x for x in text if x not in ".!?") if kind == 2 else text
        held[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, turns in held.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        numbers = [t[0] for t in turns if t[0] is not None]
        faults, cost, audit, lines = cheapest([t[1:] for t in turns])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "user", "assistant", "u", "", None, "User", "tool"]
    texts = ["", "  ", "a.", "b!", "c?", "d", "e", "a b. \n", None, "é" * 5000 + ".", "日本"]
    some = []
    for conv in [None, *range(-3, 120)]:
        for i in range(rng.choice([1, 1, 2, 3, 5, 9, 20]) if conv is not None else 500):
            some.append((conv, rng.choice([None, i, i, i, i, i // 2]), rng.choice(roles), rng.choice([*texts, f"{rng.random()}.", str(rng.random())])))
    return some + some[:40] + [(7000, i, "user", "the same turn, again and again.") for i in range(300)]


@pytest.mark.parametrize("bits", [8, 2, 0])
def test_repair(spark, rows, bits, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, at long, chunk long, edits string").repartition(5)
    got = sorted((tuple(r) for r in conversations.digest(df).collect()), key=str)
    assert got == restated(rows)
    assert conversations.digest(df.where("turn = -1")).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hello."), (1, 1, "user", "why?"), (2, 0, "user", "alone."), (3, 0, "system", "rules.")], "conv_id long, turn long, role string, text string")
    told, repaired = conversations.repair(df)
    assert {r.conv_id: (r.cost, r.audit) for r in told.collect()} == {1: (2, "RR"), 2: (2, "D"), 3: (2, "D")}
    assert [(r.role, r.text, r.edit) for r in repaired.orderBy("conv_id", "at", "nth").collect()] == [("user", "hello.", "R"), ("assistant", "why?", "R")]


def test_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.sql(conversations.ORACLE).fetchall(), key=str) == restated(rows)
