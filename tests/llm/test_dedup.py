"""Line, substring and near-duplicate operators against brute force."""

import hashlib
import pathlib
import random
import re
import time

import pyarrow as pa
import pytest
import xxhash
from llm_cases import edge, empty, small_docs  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import components as C
from tidemark.llm import line_dedup, shingle_join, substring_dedup, wordhash
from tidemark.session import cut_lineage, free_finished

WS = re.compile(r"[ \t-\r]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


def corpus(seed, n=60, vocabulary=40, edits=0.04, lines=False):
    """Random texts with exact and near copies and passages shared between them."""
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randint(0, vocabulary), rng.randint(0, vocabulary))}"
    shared = [" ".join(f"s{k}x{i}" for i in range(rng.randint(18, 40))) for k in range(4)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.45:
            base = rng.choice(out)[1].split(" ")
            text = " ".join(word() if rng.random() < edits else w for w in base)
        else:
            text = " ".join(word() for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.3:
            text += " " + rng.choice(shared)
        if lines:
            text = re.sub(r"((?:\S+ ){12}\S+) ", r"\1\n", text)
        out.append((i * 3 - 20, text))
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


# ------------------------------------------------------------------ words

def test_words_are_hashed_as_the_texts_have_them():
    rng = random.Random(8)
    texts = [None, "", " \t", "a", " A\x0bb\r\n\x0c C ", "Ünï\x85x\u3000y \x00 z"]
    texts += ["".join(rng.choice(" \t\n\x0b\x0c\rabÄ日") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for given in (pa.array(texts, pa.string()), pa.array(["x y", *texts], pa.string())[1:], pa.array([], pa.string())):
        for lower in (False, True):
            got = [h.tolist() for h in wordhash.hashed_words(given, lower)]
            assert got == [[xxhash.xxh3_64_intdigest("".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in w))
                            for w in words(t or "")] for t in given.to_pylist()]


def test_words_are_hashed_without_making_strings(monkeypatch):
    given = pa.array(["a b", "b c"], pa.string())
    monkeypatch.setattr(wordhash.xxhash, "xxh3_64_intdigest", lambda w: {b"a": 1, b"b": 2, b"c": 3}[w])
    assert [h.tolist() for h in wordhash.hashed_words(given)] == [[1, 2], [2, 3]]


def test_shuffle_files_of_finished_steps_go(spark, tmp_path):
    def held():
        return {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
                for p in pathlib.Path(d).rglob("shuffle_*.data")}

    before = held()
    kept = cut_lineage(spark.range(1000).repartition(3, "id"))
    made = held() - before
    assert made
    for _ in range(50):
        free_finished(spark)
        time.sleep(0.1)
        if not made & held():
            break
    assert not made & held() and kept.count() == 1000


# ------------------------------------------------------------------ components

def test_connected_components(spark):
    rng = random.Random(5)
    for _ in range(4):
        edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(rng.randint(0, 90))]
        edges += [(k, k + 1) for k in range(200, 240)] + [(500, 300 + k) for k in range(40)]
        above = {}

        def root(x):
            while above.setdefault(x, x) != x:
                x = above[x]
            return x

        for a, b in edges:
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
        want = {(x, root(x)) for a, b in edges for x in (a, b) if any(a != b and x in (a, b) for a, b in edges)}
        got = {tuple(r) for r in C.connected_components(
            spark.createDataFrame(edges, "a bigint, b bigint")).select("node", "component").collect()}
        assert got == want
    assert C.connected_components(spark.createDataFrame([(None, 3), (4, 4)], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ shingles

def brute_components(rows):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {d: shingles(t) for d, t in rows}
    above = {d: d for d in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("seed,hot,edits", [(1, 64, 0.03), (2, 2, 0.03), (3, 1, 0.06), (4, 5, 0.01)])
def test_shingle_components(spark, monkeypatch, seed, hot, edits):
    """Low limits for hot shingles and group chunks make every path run."""
    monkeypatch.setattr(shingle_join, "HOT", hot)
    monkeypatch.setattr(shingle_join, "CHUNK", 3)
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    rows = corpus(seed, edits=edits)
    got = {tuple(r) for r in shingle_join.components(frame(spark, rows)).select(
        "doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(rows)


def test_shingle_threshold_is_exact(spark):
    base = [f"t{i}" for i in range(11)]                       # 7 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:10] + ["z"])),      # 6 of 8: 0.75
            (3, " ".join(["z9"] + base[1:9] + ["q", "r"])), (4, "one two"), (5, "ONE Two"), (6, "two one")]
    got = {tuple(r) for r in shingle_join.components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert (2, 7, 1) in got and (5, 1, 4) in got


def test_shingle_edges(edge, empty):
    got = [tuple(r) for r in shingle_join.components(edge).select("doc_id", "n_shingles", "component_id").collect()]
    assert len(got) == edge.count()
    by = {}
    for d, n, c in got:
        by.setdefault(d, set()).add((n, c))
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[6] == {(1, 6)}
    assert by[7] == by[1] and by[1] == {(12, 1)} and by[10] == {(len({0}) and next(iter(by[10]))[0], 9)}
    assert {c for _, c in by[None]} == {None}
    assert shingle_join.components(empty).count() == 0


# ------------------------------------------------------------------ substrings

def brute_substrings(rows, window):
    seen, out = set(), []
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("seed,vocabulary", [(1, 40), (2, 2), (3, 400)])
def test_substrings(spark, seed, vocabulary):
    rows = corpus(seed, vocabulary=vocabulary, edits=0.02) + [(900, "a b " * 60), (901, "x " + "a b " * 40)]
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(frame(spark, rows)).collect())
    assert got == brute_substrings(rows, substring_dedup.WINDOW)
    digest = substring_dedup.digest(substring_dedup.deduplicate(frame(spark, rows))).collect()
    assert {r.kept_sha256 for r in digest} == {hashlib.sha256(k.encode()).hexdigest() for *_, k in got}


def test_substring_edges(edge, empty):
    got = substring_dedup.deduplicate(edge).collect()
    assert len(got) == edge.count()
    for r in got:
        if r.doc_id not in (10,):
            assert r.n_removed == 0 or r.doc_id in (9,)       # row 9 repeats its own period
    assert next(r for r in got if r.doc_id == 2).kept == ""
    assert substring_dedup.deduplicate(empty).count() == 0


def passage_between_contexts(n):
    """One passage in all documents, between different words."""
    rng = random.Random(7)
    own = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(40))
    passage = " ".join(f"p{i}" for i in range(60))
    return [(i, f"{own()} {passage} {own()}") for i in range(n)]


@pytest.mark.parametrize("shard", [1, 5, 1_000])
def test_substrings_of_hot_anchors(spark, monkeypatch, shard):
    """Low limits take windows instead of automata."""
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (substring_dedup.WINDOW, shard))
    rows = passage_between_contexts(80) + [(i + 200, t) for i, t in corpus(3)] + [(900, "a b " * 60), (901, "x " + "a b " * 40)]
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(frame(spark, rows)).collect())
    assert got == brute_substrings(rows, substring_dedup.WINDOW)


def test_no_automaton_takes_more_than_a_shard(spark):
    rows = frame(spark, passage_between_contexts(300))
    _, classes = substring_dedup._shared(rows, substring_dedup.WINDOW)
    assert classes.groupBy("anchor").count().agg({"count": "max"}).first()[0] > 200
    fetched = substring_dedup._fetched(rows, classes, substring_dedup.WINDOW, 100).where("words is not null")
    assert (fetched.groupBy("anchor").count().agg({"count": "max"}).first()[0] or 0) <= 100


def test_automaton_statistics():
    rng = random.Random(2)
    for _ in range(30):
        known = [[rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        automaton = substring_dedup.SuffixAutomaton()
        for k in known:
            automaton.add(k)
        text = [rng.choice("abcd") for _ in range(20)]
        inside = lambda s: any(s == k[i:i + len(s)] for k in known for i in range(len(k) - len(s) + 1))
        want = [max(n for n in range(e + 1) if n == 0 or inside(text[e - n:e])) for e in range(1, len(text) + 1)]
        assert list(automaton.statistics(text)) == want


# ------------------------------------------------------------------ lines

def brute_lines(rows):
    lines = [(d, n, line) for d, t in sorted(rows, key=lambda r: r[0]) if t is not None
             for n, line in enumerate(t.split("\n"))]
    sets = [(d, n, frozenset(words(line.lower()))) for d, n, line in lines if len(words(line)) >= line_dedup.MIN_WORDS]
    gone = set()
    for i, (d, n, s) in enumerate(sets):
        if any(line_dedup.UNDER * len(s & o) >= line_dedup.OVER * len(s | o) for *_, o in sets[:i]):
            gone.add((d, n))
    return sorted((d, t.count("\n") + 1, sum(1 for x in gone if x[0] == d),
                   hashlib.sha256("\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone).encode()).hexdigest())
                  for d, t in rows)


@pytest.mark.parametrize("seed,vocabulary", [(1, 60), (2, 15), (3, 500)])
def test_lines(spark, seed, vocabulary):
    rows = corpus(seed, vocabulary=vocabulary, edits=0.03, lines=True)
    base = " ".join(f"r{i}" for i in range(40))
    rows += [(700 + k, base.replace(f"r{k}", f"q{k}") + "\n\nok no\nThree short words\n" + base.upper()) for k in range(12)]
    got = sorted(tuple(r) for r in line_dedup.report(frame(spark, rows)).collect())
    assert got == brute_lines(rows)


def test_short_lines_are_removed_if_repeated(spark):
    rows = [(1, "Menu\nRead more\n\nMenu"), (2, "Read more\n\n \t\nmore\nMENU"), (3, "read More\nother"), (4, "\n")]
    got = {r.doc_id: (r.text, r._removed) for r in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert got == {1: ("Menu\nRead more\n", 1), 2: ("\n \t\nmore", 2), 3: ("other", 1), 4: ("\n", 0)}


def test_line_edges(edge, empty):
    got = line_dedup.deduplicate(edge)
    assert got.columns == [*edge.columns, "_lines", "_removed"]
    rows = got.collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].text is None and by[3].text == "" and by[4].text == " \t\n " and by[7].text == "" and by[7]._removed == 2
    assert all(r._removed == 0 for r in rows if r.doc_id is None)
    assert line_dedup.deduplicate(empty).count() == 0 and line_dedup.report(empty).count() == 0


def test_line_columns_of_any_name(spark):
    names = ("_kept", "_kept_for", "_all", "_stay", "_0", "_1", "_2", "_3", "c0", "c1", "all", "nth", "other_no")
    rows = frame(spark, [(1, "one two\nthree"), (2, "One two\nfour")])
    for name in (*names, "_lines", "_removed"):
        rows = rows.withColumn(name, F.lit(name))
    got = line_dedup.deduplicate(rows)
    assert got.columns == ["doc_id", "text", *names, "_lines", "_removed"]
    assert sorted((r.doc_id, r.text, r._lines, r._removed) for r in got.collect()) == [(1, "one two\nthree", 2, 0), (2, "four", 2, 1)]
    assert all(r[n] == n for r in got.collect() for n in names)


def test_line_family_costs_a_pair_each(spark, monkeypatch):
    base = [f"r{i}" for i in range(40)]
    rows = [(k, " ".join([*base, f"q{k}"])) for k in range(400)]
    tried = []
    whole = line_dedup._matched
    monkeypatch.setattr(line_dedup, "_matched", lambda docs, pairs: tried.append(pairs.count()) or whole(docs, pairs))
    assert sum(r.n_removed for r in line_dedup.report(frame(spark, rows)).collect()) == 399
    assert tried == [399, 0]                        # the earliest candidates settle all


def test_line_family_is_settled_before_the_join_with_all(spark, monkeypatch):
    base = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join([*base[:k % 40], f"q{k}", *base[k % 40:]])) for k in range(120)]
    joined, whole = [], line_dedup._met
    monkeypatch.setattr(line_dedup, "_met", lambda x, y: joined.append(whole(x, y).count()) or whole(x, y))
    assert sum(r.n_removed for r in line_dedup.report(frame(spark, rows)).collect()) == 119
    prefix = 41 - 37 + 1
    assert len(joined) == 2 and joined[0] <= 120 * prefix * line_dedup.PIVOTS and joined[1] == 0


def test_line_rounds_reach_every_candidate(spark, monkeypatch):
    """Earlier lines that pass the filters but do not match come before the one that does: with
    signatures of the prefix alone and one more candidate a round, several rounds are needed."""
    monkeypatch.setattr(line_dedup, "SIGNED", 1)
    monkeypatch.setattr(line_dedup, "WIDER", 2)
    rounds = []
    whole = line_dedup.candidate_pairs
    monkeypatch.setattr(line_dedup, "candidate_pairs", lambda *a: rounds.append(a[2]) or whole(*a))
    rare = [f"r{i}" for i in range(12)]
    common = [f"c{i}" for i in range(60)]
    filler = [(500 + k, " ".join(common[j] for j in range(k % 7, 60, 7)) + f" f{k}") for k in range(60)]
    decoys = [(k, " ".join(rare + random.Random(k).sample(common, 28))) for k in range(9)]
    last = rare + random.Random(99).sample(common, 28)
    rows = [*filler, *decoys, (100, " ".join(last)), (101, " ".join([*last, "one"]))]
    got = sorted(tuple(r) for r in line_dedup.report(frame(spark, rows)).collect())
    assert got == brute_lines(rows) and len(rounds) > 1


def test_line_join_uses_no_python(small_docs):
    plan = line_dedup.deduplicate(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
