"""Conversation repair against a shortest-path search that keeps audits as strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import turn_repair as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
FOLLOW = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) rows, by Dijkstra over (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        to = FOLLOW[state]
        if not audit.endswith("III"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, out + ((NAME[to], ""),)))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        dear = 3 if fault == "truncated" else 0
        heapq.heappush(heap, (cost + 3 + dear, audit + "R", i + 1, to, out + ((NAME[to], text),)))
        if role[:1] == to or (role[:1] == "s" and state == ""):
            heapq.heappush(heap, (cost + dear, audit + "K", i + 1, role[0], out + ((role, text),)))


def brute(conversations):
    convs = {}
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, rows in convs.items():
        rows.sort()
        seen, marked = set(), []
        for _, _, role, text in rows:
            fault = ("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen
                     else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "fine")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for known, t, _, _ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = cheapest(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *count, illegal, cost, audit, sha))
    return sorted(out, key=repr)


def result(df, block_rows=T.BLOCK_ROWS):
    return sorted((tuple(r) for r in T.digest(T.repair(T.damage(df), block_rows)).collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, longest)):
            turn = rng.choice([None, t, t, t, t + rng.randrange(3)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "sub", "", None])
            rows.append((c, turn, role, rng.choice(["A.", "b?", "Same. ", "cut", " \t", "", None, "é!\n", "x" * 50 + ".", "f", "b!f", "c!\x0b\x0c\r", "\x0c\x0b"])))
    return rows


@pytest.mark.parametrize("block_rows", [1, 2, T.BLOCK_ROWS])
def test_random_conversations_at_every_block_size(spark, block_rows):
    rows = conversations(block_rows, 60, 7) + [(None, t, "user", f"{t}.") for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert result(df, block_rows) == brute(rows)


def test_one_task_a_conversation_in_blocks(spark):
    """Blocks inside one task, and repeats found across them."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t % 9}.") for t in range(40)]
    rows += [(2, 0, "user", "a."), (3, 1, "assistant", "b.")]
    repaired = T.repair(spark.createDataFrame(rows, SCHEMA).coalesce(1), block_rows=4)
    got = repaired.where("conv_id = 1").orderBy("part")
    assert got.count() > 1 and got.first()["duplicate"] == 22          # nine texts under two roles
    assert [t["text"] for r in got.collect() for t in r["repaired"]] == [f"{t % 9}." for t in range(18)]


def test_long_conversation_equals_a_plain_recursion():
    """Windows and given-up states change nothing: strings from the last row to the first."""
    def plain(codes):
        best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
        for code in reversed(codes):
            role, fault = divmod(code, 4)
            dear = 3 if fault == T.CUT_OFF else 0
            here = {}
            for s in range(4):
                offers = [(best[s][0] + 4, "D" + best[s][1])]
                if fault in (T.FINE, T.CUT_OFF):
                    to = T._NEXT[s]
                    offers.append((best[to][0] + 3 + dear, "R" + best[to][1]))
                    if role == to or (role == T.SYSTEM and s == T.START):
                        offers.append((best[role][0] + dear, "K" + best[role][1]))
                here[s] = min(offers)
            one = {s: min(here[s], (here[T._NEXT[s]][0] + 3, "I" + here[T._NEXT[s]][1])) for s in here}
            best = {s: min(here[s], (one[T._NEXT[s]][0] + 3, "I" + one[T._NEXT[s]][1])) for s in here}
        return best[0]

    rng = random.Random(8)
    for n in (0, 1, 2, 5, 63, 64, 65, 200, 700):
        for weights in ((1, 1, 4, 4), (0, 0, 1, 1), (3, 3, 1, 1), (0, 1, 0, 0), (1, 0, 0, 0)):
            codes = bytes(r * 4 + rng.choice([0, 0, 0, 1, 2, 3]) for r in rng.choices(range(4), weights, k=n))
            for window in (1, 7, T.WINDOW):
                cost, fields = T.solve(codes, window)
                assert (cost, fields.translate(T._FROM_DIGITS)) == plain(codes)


def test_clashing_columns_and_empty_table(spark):
    rows = conversations(11, 25, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("kind", "code", "present", "slice", "seq", "part", "audit", "rows", "hash", "copy", "fields"):
        df = df.withColumn(name, F.lit("clash"))
    assert result(df) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_a_conversation_without_rows_left_is_reported(spark):
    gone = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*gone, "user", "bye.")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [
        (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_keeps_valid_conversations(spark):
    rows = [(5, 0, "system", "s."), (5, 1, "user", "u."), (5, 2, "assistant", "a.")]
    got = T.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["audit"], [(t["role"], t["text"]) for t in r["repaired"]]) for r in got] == [
        ("KKK", [(r[2], r[3]) for r in rows])]
