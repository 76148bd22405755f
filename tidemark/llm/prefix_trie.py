"""Prefix trie of conversations by truncation peeling.

A conversation becomes its path: one fixed-width key a turn (a hash of role and
text, and the text's code points), concatenated.  Texts are reduced to keys
before the first shuffle; a path prefix is a trie node, and the byte order of
paths keeps the conversations below a node side by side.

:func:`peel` descends from the deepest level: conversations that end there join
the nodes that survived from below, every node is finished, loses its last turn
and meets its siblings again one level up.  Discovering a node and aggregating it
is the same step.

Paths are dealt to tasks by range, so neighbours share a task whatever the shape
of the trie, and a task peels runs of bounded size.  A node that is a prefix of
the first or last path of its run may go on in the next one: instead of being
finished it is handed on as an item that carries what is known of it (members,
finished children, their leaves and savings), and the next round peels these
items in runs four times as large, until one run holds them all.  A first turn
that all conversations share, or a conversation copied a million times, is thus
one item a run, not a group in one task.  The ids of conversations that end at
such a node are hashed in order by a streaming pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Bytes of a turn's key: 16 of the hash, 4 of the text's length in code points.
WIDTH = 20

#: Path bytes (and 64 for each item) that a run of the first round holds.
RUN_BYTES = 4_000_000

#: Ways in which the children of one node are dealt when they fetch its conv_id.
SALTS = 64

_NODE, _ITEM, _END = 0, 1, 2
_OUT = ("kind int, key binary, path binary, conv_id bigint, depth int, parent binary, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
_ITEMS = ("path", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path): the turns of every conversation as keys, in order of turn (null first).

    Null roles and texts count as empty; rows without a conversation id take no
    part.  Rows of one turn are ordered by role, then by the key; repeated rows are
    turns of their own.  Other columns are ignored.  A path takes 20 bytes a turn
    and has to fit into one value (2 GB: a hundred million turns).
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    key = F.concat(F.substring(F.sha2(marked, 256), 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
                                 role.alias("role"), key.alias("key")).where("conv_id is not null")
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key"))).alias("t"))
    return ordered.select("conv_id", F.unhex(F.array_join(F.col("t.key"), "")).alias("path"))


def share_heads(path_rows: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by the first h of conversation
    c - c % ``block`` (all if fewer, none if absent); h = crc32(c) % ``most``."""
    heads = path_rows.where(f"conv_id % {block} = 0").select(
        F.col("conv_id").alias("_donor"), F.expr(f"substring(path, 1, {(most - 1) * WIDTH})").alias("_head"))
    h = f"cast(crc32(cast(conv_id as string)) % {most} as int) * {WIDTH}"
    return (path_rows.join(heads, F.expr(f"conv_id - conv_id % {block} = _donor"), "left")
            .select("conv_id", F.expr(f"concat(coalesce(substring(_head, 1, {h}), X''), "
                                      f"substring(path, {h} + 1))").alias("path")))


class _Live:
    """What is known of a node while its level is peeled."""

    __slots__ = ("conv", "n", "kids", "leaves", "saved", "ends", "waiting")

    def __init__(self):
        self.conv, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[list] = []      # finished children that need this node's conv_id

    def add(self, conv, n, kids, leaves, saved) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.n += n
        self.kids += kids
        self.leaves += leaves
        self.saved += saved


def key_of(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


def peel(items: list[tuple], *, ended: bool, whole: bool) -> list[list]:
    """Rows of ``_OUT`` for a run of items (path, conv_id, n, children, leaves, saved) in path order.

    ``ended``: items are conversations that end at their path.  ``whole``: the run
    is the whole trie, so that every node can be finished."""
    first, last = items[0][0], items[-1][0]
    starting: dict[int, dict[bytes, _Live]] = {}
    for path, *known in items:
        node = starting.setdefault(len(path), {}).setdefault(path, _Live())
        node.add(*known)
        if ended:
            node.ends.append(known[0])
    out: list[list] = []
    live: dict[bytes, _Live] = {}
    for size in range(max(starting), -1, -WIDTH):
        for path, node in starting.get(size, {}).items():      # newly ended meet the survivors
            there = live.get(path)
            if there is None:
                live[path] = node
            else:
                there.add(node.conv, node.n, node.kids, node.leaves, node.saved)
                there.ends = node.ends
        edges = () if whole else (first[:size] if len(first) >= size else None,
                                  last[:size] if len(last) >= size else None)
        stripped: dict[bytes, _Live] = {}
        for path, node in live.items():
            if path in edges:                                   # may go on in another run
                key = key_of(path)
                out.append([_ITEM, key, path, node.conv, None, None, None,
                            node.n, node.kids, node.leaves, node.saved, None])
                out += [[_END, key, None, c] + [None] * 8 for c in node.ends]
                for child in node.waiting:
                    child[5] = key
                continue
            leaves = node.leaves if node.kids else 1
            last_chars = int.from_bytes(path[-4:], "big") if size else 0
            saved = node.saved + (node.n - 1) * last_chars
            sha = hashlib.sha256(",".join(map(str, sorted(node.ends))).encode()).hexdigest() if ended else None
            row = [_NODE, key_of(path) if not ended else None, None, node.conv, size // WIDTH, None, None,
                   node.n, node.kids, leaves, saved, sha]
            out.append(row)
            for child in node.waiting:
                child[6] = node.conv
            if size:
                parent = stripped.setdefault(path[:-WIDTH], _Live())
                parent.add(node.conv, node.n, 1, leaves, saved)
                parent.waiting.append(row)
        live = stripped
    return out


def _table(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(),
             pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _OUT.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _peel_runs(items: DataFrame, *, ended: bool, whole: bool, run_bytes: int) -> DataFrame:
    """One round: the items of every task, in order, peeled run by run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for item in zip(*[c.to_pylist() for c in batch.columns]):
                if held and not whole and size + len(item[0]) + 64 > run_bytes:
                    yield _table(peel(held, ended=ended, whole=False))
                    held, size = [], 0
                held.append(item)
                size += len(item[0]) + 64
        if held:
            yield _table(peel(held, ended=ended, whole=whole))

    dealt = items.repartition(1) if whole else items.repartitionByRange("path", "conv_id")
    return dealt.sortWithinPartitions("path", "conv_id").mapInArrow(run, _OUT)


def _hash_ends(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the ids of each key in numeric order, hashed as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(b",%d" % conv)
            yield _pairs(done)
        if key is not None:
            yield _pairs([(key, sha.hexdigest())])

    def _pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()),
                                           pa.array([s for _, s in rows], pa.string())], names=["key", "ends_sha256"])

    return (ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(run, "key binary, ends_sha256 string"))


def prefix_trie(path_rows: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row a node of the trie over (conv_id, path) rows of distinct conversations.

    conv_id (smallest member) and depth identify a node; parent_conv_id is null for
    the root; n_convs, n_children, n_leaves and saved_tokens count members, children,
    childless nodes of the subtree and, over the subtree, (members - 1) times the
    code points of the last turn; ends_sha256 hashes the ids that end at the node.
    A conversation without turns is a member of the root alone.  No conversations:
    no rows, not even a root.
    """
    spark = path_rows.sparkSession
    items = path_rows.select("path", "conv_id", F.lit(1).cast("bigint").alias("n_convs"),
                             *[F.lit(0).cast("bigint").alias(c) for c in _ITEMS[3:]])
    round_one = cut_lineage(_peel_runs(items, ended=True, whole=False, run_bytes=run_bytes))
    early, late = round_one.where(f"kind = {_NODE}"), None
    items = round_one.where(f"kind = {_ITEM}").select(*_ITEMS)
    whole = False
    while not whole:
        run_bytes *= 4
        weight = items.agg(F.sum(F.expr("octet_length(path) + 64"))).first()[0] or 0
        whole = weight <= run_bytes
        found = cut_lineage(_peel_runs(items, ended=False, whole=whole, run_bytes=run_bytes))
        nodes = found.where(f"kind = {_NODE}")
        late = nodes if late is None else late.unionByName(nodes)
        items = found.where(f"kind = {_ITEM}").select(*_ITEMS)

    shas = _hash_ends(round_one.where(f"kind = {_END}"))
    late = late.drop("ends_sha256").join(shas, "key", "left").fillna(_EMPTY_SHA, "ends_sha256")
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    nodes = early.select("parent", *cols).unionByName(late.select("parent", *cols))
    # Only nodes that were finished late (a few a run) can be parents that a run did not see
    # finished.  A node may have most conversations as children, so the children are salted.
    parents = late.select(F.col("key").alias("parent"), F.col("conv_id").alias("_conv"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    open_ended = (nodes.where("parent is not null").drop("parent_conv_id")
                  .withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
                  .join(parents, ["parent", "_salt"], "left"))
    return (nodes.where("parent is null").select(*cols)
            .unionByName(open_ended.withColumnRenamed("_conv", "parent_conv_id").select(*cols))
            .withColumn("depth", F.col("depth").cast("bigint")))
