"""Prefix trie against a brute-force trie of whole turn sequences."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
        turns = {c: turns.get(c - c % 100, [])[:h[c]] + ts[h[c]:] for c, ts in turns.items()}
    members = {}
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(turns[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    len(kids.get(node, [])), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df, run_bytes=P.RUN_BYTES, rebuild=True):
    paths = P.paths(df)
    nodes = P.prefix_trie(P.share_heads(paths) if rebuild else paths, run_bytes)
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=repr)


def conversations(seed, n, depth, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), n):
        for t in range(rng.randrange(1, depth)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("run_bytes", [1, 400, P.RUN_BYTES])
def test_random_conversations_at_every_run_size(spark, run_bytes):
    rows = conversations(run_bytes, 120, 7, ["", "a", "bb", "é€"])
    assert result(spark.createDataFrame(rows, SCHEMA), run_bytes) == brute(rows)


def test_one_first_turn_copies_and_truncations(spark):
    long = [("user", f"t{i}") for i in range(60)]
    rows = [(c, t, *long[t]) for c in range(40) for t in range(60)]             # copies
    rows += [(100 + c, t, *long[t]) for c in range(60) for t in range(c)]        # every prefix of them
    rows += [(200 + c, t, *(long[t] if t < 30 else ("user", f"own {c}"))) for c in range(30) for t in range(33)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df, 600, rebuild=False) == brute(rows, rebuild=False)
    assert result(df, 600) == brute(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "second"),
            (2, None, None, None), (2, 1, "user", ""), (3, 0, "", ""), (0, 0, "user", "x" * 5000), (0, 1, "user", None),
            (4, 2, "user", "b"), (4, 2, "assistant", "b"), (-1, 0, "user", "second"), (150, 7, "user", "no head row")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "path", "depth", "_donor", "_head", "parent", "kind", "n_convs"):
        df = df.withColumn(name, F.lit("clash"))
    own = [r for r in rows if r[0] != -1]           # the sign of % differs between Spark and this test's language
    assert result(df.where("conv_id is null or conv_id <> -1")) == brute(own)
    assert result(df, rebuild=False) == brute(rows, rebuild=False)


def test_roles_and_texts_do_not_run_into_each_other(spark):
    rows = [(1, 0, "us", "er"), (2, 0, "user", ""), (3, 0, "u", "ser")]
    assert len(result(spark.createDataFrame(rows, SCHEMA), rebuild=False)) == 4


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
