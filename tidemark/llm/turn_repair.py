"""Repair of conversation structure by an integer shortest path.

The turns of a conversation have to read ``(s?(ua)+)?`` by the initials of their
roles.  Rows may be kept, given the role user or assistant, or deleted, and turns
without text may be inserted; every edit has a cost and a letter, and the audit is
the letters in order.  Of all cheapest repairs the one with the ASCII-least audit
is taken.

:func:`solve` finds it as an ordinary minimum over one integer a node: an edit's
weight is its cost above all digits plus its letter at a fixed place, so a path's
weight is (cost, audit) as one number and weights just add.  Each row owns a field
of three octal digits, for up to two insertions and its own letter; a field is
padded with zeros at its end.  A row's letter is never an insertion's, so fields
compare as the plain strings do.  More than two insertions in a row are never
cheapest: a neighbouring pair of them can always be left out.

Rows are dealt to tasks by range of (conversation, turn, role, text), so a
conversation lies in one task or runs over a few neighbours, however long it is,
and tasks read it as a stream.  One that lies inside a task and fits into a block
is solved there.  Any other is emitted as blocks: repeated rows are found across
blocks by hash, one byte a row (role and fault) is gathered and solved, and each
block gets its own piece of the audit back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Any way to go on from one state can be followed from any other at this extra cost at most: two
#: insertions, and one kept system turn deleted.
DETOUR = 2 * INSERT + DELETE

#: Rows of a conversation after which agreed fields are settled.
WINDOW = 64

BLOCK_ROWS = 2_000
BLOCK_BYTES = 4_000_000

_LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}                  # in ASCII order; 0 pads
_FROM_DIGITS = str.maketrans({"0": None, **{str(d): c for c, d in _LETTERS.items()}})

# fault of a row (low two bits of its code), the first that applies
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
# role of a row (code // 4) by its initial, and state after a kept role
OTHER, SYSTEM, USER, ASSISTANT = range(4)
START = 0
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}     # the only turn besides s that may follow
_NAMES = {USER: "user", ASSISTANT: "assistant"}

_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
_TURNS = "array<struct<role:string,text:string>>"
_OUT = f"conv_id bigint, part int, n_parts int, {_SUMMARY}, audit string, repaired {_TURNS}"
_FOUND = (f"{_OUT}, slice int, seq int, codes binary, hashes array<binary>, first_turn bigint, "
          "last_turn bigint, n_turns bigint")


def solve(codes: bytes, window: int = WINDOW) -> tuple[int, str]:
    """(cost, fields): the cheapest, then ASCII-least repair of rows given by their codes
    (role * 4 + fault).  ``fields`` has three octal digits a row and three for the end.

    After every ``window`` rows the leading fields on which all states agree are settled and
    leave the integers, as they cannot change a comparison; a state that costs over ``DETOUR`` more
    than another is given up.  Long conversations so take time in proportion to their rows unless
    their states never agree."""
    settled: list[str] = []
    best: list[int | None] = [0, None, None, None]           # by state: START, after s, u, a
    held = 0                                                 # digits in the integers
    for at in range(0, len(codes), window):
        part = codes[at:at + window]
        digits = held + 3 * len(part)
        best = _rows(part, [v if v is None else v << 9 * len(part) for v in best], held, digits)
        low = (1 << 3 * digits) - 1
        dearest = (min(v for v in best if v is not None) >> 3 * digits) + DETOUR
        best = [None if v is None or v >> 3 * digits > dearest else v for v in best]
        live = [v & low for v in best if v is not None]
        differ = 0
        for v in live:
            differ |= v ^ live[0]
        keep = -(-differ.bit_length() // 9) * 3              # digits from the first field that differs
        if keep < digits:
            settled.append(format(live[0] >> 3 * keep, f"0{digits - keep}o"))
        best = [v if v is None else (v >> 3 * digits << 3 * keep) | (v & ((1 << 3 * keep) - 1)) for v in best]
        held = keep
    digits, ends = held + 3, []
    best = [v if v is None else v << 9 for v in best]
    for used in range(3):
        ends += [best[s] for s in (START, ASSISTANT) if best[s] is not None]
        if used < 2:
            best = _inserted(best, held + used, digits)
    cost, low = divmod(min(ends), 1 << 3 * digits)
    return cost, "".join(settled) + format(low, f"0{digits}o")


def _inserted(before: list[int | None], place: int, digits: int) -> list[int | None]:
    """Weights by state after one more insertion, whose letter goes to digit ``place`` of ``digits``."""
    weight = (INSERT << 3 * digits) + (_LETTERS["I"] << 3 * (digits - 1 - place))
    after: list[int | None] = [None] * 4
    for state, value in enumerate(before):
        if value is not None:
            to = _NEXT[state]
            if after[to] is None or value + weight < after[to]:
                after[to] = value + weight
    return after


def _rows(codes: bytes, best: list[int | None], held: int, digits: int) -> list[int | None]:
    """Weights by state after the rows of ``codes``, whose fields begin at digit ``held``."""
    for i, code in enumerate(codes):
        role, fault = divmod(code, 4)
        extra = TRUNCATED if fault == CUT_OFF else 0
        after: list[int | None] = [None] * 4
        for used in range(3):
            place = held + 3 * i + used
            shift = 3 * (digits - 1 - place)
            delete = (DELETE << 3 * digits) + (_LETTERS["D"] << shift)
            keep = (extra << 3 * digits) + (_LETTERS["K"] << shift)
            rerole = (REROLE + extra << 3 * digits) + (_LETTERS["R"] << shift)
            for state, value in enumerate(best):
                if value is None:
                    continue
                offers = [(state, value + delete)]
                if fault not in (BLANK, DUPLICATE):
                    to = _NEXT[state]
                    offers.append((to, value + rerole))
                    if role == to:
                        offers.append((to, value + keep))
                    elif role == SYSTEM and state == START:
                        offers.append((SYSTEM, value + keep))
                for to, offer in offers:
                    if after[to] is None or offer < after[to]:
                        after[to] = offer
            if used < 2:
                best = _inserted(best, place, digits)
        best = after
    return best


solve_short = lru_cache(maxsize=50_000)(solve)


def faults(codes: bytes) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of rows given by their codes."""
    counts = [0] * 4
    for code in codes:
        counts[code % 4] += 1
    roles = [code // 4 for code in codes]
    illegal = sum(pair not in _LEGAL for pair in zip(roles, roles[1:]))
    return counts[BLANK], counts[DUPLICATE], counts[CUT_OFF], illegal


def apply(rows: list[tuple[str, str]], fields: str, state: int = START) -> tuple[list[tuple[str, str]], int]:
    """(repaired rows, state after them): the edits of ``fields`` on (role, text) rows."""
    out = []
    edits = re.findall("...", fields)
    for i, field in enumerate(edits):
        for digit in field:
            if digit == "0":
                break
            if digit == "1":
                continue
            if digit == "2":
                state = _NEXT[state]
                out.append((_NAMES[state], ""))
            elif digit == "3":
                role, text = rows[i]
                state = _INITIALS[role[0]]
                out.append((role, text))
            else:
                state = _NEXT[state]
                out.append((_NAMES[state], rows[i][1]))
    return out, state


def _state_after(codes: bytes, fields: str, state: int) -> int:
    """State after the edits of ``fields`` on rows known by their codes alone."""
    for i in range(0, len(fields), 3):
        for digit in fields[i:i + 3]:
            if digit in "24":
                state = _NEXT[state]
            elif digit == "3":
                state = codes[i // 3] // 4
    return state


def damage(conversations: DataFrame) -> DataFrame:
    """The stated damage by crc32(``conv_id:turn``) % 20, nulls standing for one space: 0 drops
    a row (it stays as a mark with ``present`` false), 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 sets its role to user."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    hit = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                               F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    changed = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
               .otherwise(F.col("text")))
    return hit.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"), (F.col("kind") != 0).alias("present"),
        F.expr("explode(array_repeat(1, if(kind = 3, 2, 1)))").alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, code): nulls as empty, code null for rows that are not there."""
    names = {c: F.col(c) for c in ("conv_id", "turn", "role", "text")}
    role = F.coalesce(names["role"], F.lit("")).alias("role")
    text = F.coalesce(names["text"], F.lit("")).alias("text")
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    held = rows.select(names["conv_id"].cast("bigint").alias("conv_id"), names["turn"].cast("bigint").alias("turn"),
                       role, text, present.alias("present"))
    end = F.expr(r"rtrim(' \t\n\u000b\u000c\r', text)")
    fault = (F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_OFF))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return held.select("conv_id", "turn", "role", "text",
                       F.when(F.col("present"), (kind * 4 + fault).cast("int")).alias("code"))


def _turns(lists: list[list[tuple[str, str]] | None]) -> pa.Array:
    """Lists of (role, text) as an Arrow column."""
    flat = [t for rows in lists for t in rows or ()]
    offsets, at = [], 0
    for rows in lists:
        offsets.append(None if rows is None else at)
        at += len(rows or ())
    values = pa.StructArray.from_arrays([pa.array([r for r, _ in flat], pa.string()),
                                         pa.array([t for _, t in flat], pa.string())], names=["role", "text"])
    return pa.ListArray.from_arrays(pa.array(offsets + [at], pa.int32()), values)


class _Block:
    """Consecutive rows of one conversation, with repeats inside the block marked."""

    def __init__(self):
        self.turns, self.rows, self.codes, self.seen, self.size = [], [], bytearray(), set(), 0

    def add(self, turn, role, text, code) -> None:
        if code % 4 != BLANK:
            if (role, text) in self.seen:
                code = code // 4 * 4 + DUPLICATE
            self.seen.add((role, text))
        self.turns.append(turn)
        self.rows.append((role, text))
        self.codes.append(code)
        self.size += len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.size >= BLOCK_BYTES

    def span(self) -> tuple[int | None, int | None, int]:
        """(first, last, number) of the distinct turns that are not null; rows are in order."""
        known = [t for t in self.turns if t is not None]
        return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _hash(row: tuple[str, str]) -> bytes:
    role = row[0].encode()
    return hashlib.blake2b(b"%d:" % len(role) + role + row[1].encode(), digest_size=16).digest()


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _solved(conv: int | None, block: _Block) -> list:
    codes = bytes(block.codes)
    cost, fields = solve_short(codes) if len(codes) <= 32 else solve(codes)
    repaired, _ = apply(block.rows, fields)
    return [conv, 0, 1, _gaps(*block.span()), *faults(codes), cost, fields.translate(_FROM_DIGITS), repaired,
            None, None, None, None, None, None, None]


def _open(conv: int | None, slice_no: int, seq: int, block: _Block) -> list:
    hashes = [None if code % 4 in (BLANK, DUPLICATE) else _hash(row) for row, code in zip(block.rows, block.codes)]
    return [conv, None, None, *[None] * 6, None, block.rows, slice_no, seq, bytes(block.codes), hashes, *block.span()]


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(),
          "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[list], ddl: str) -> pa.RecordBatch:
    columns, names = [], []
    fields = [f.split(" ", 1) for f in ddl.replace(_TURNS, "turns").split(", ")]
    for (name, kind), values in zip(fields, zip(*rows) if rows else [()] * len(fields)):
        names.append(name)
        columns.append(_turns(list(values)) if kind == "turns" else pa.array(list(values), _TYPES[kind]))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _streamed(rows: DataFrame, block_rows: int) -> DataFrame:
    """Every task's conversations in order: solved, or as blocks where they may go on elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_no = TaskContext.get().partitionId()
        nobody = object()
        conv, block, seq, first = nobody, _Block(), 0, True
        out: list[list] = []
        for batch in batches:
            for c, turn, role, text, code in zip(*[col.to_pylist() for col in batch.columns]):
                if c != conv or conv is nobody:
                    if conv is not nobody:
                        # the task's first conversation may have begun in another one
                        out.append(_open(conv, slice_no, seq, block) if first or seq else _solved(conv, block))
                        first = False
                    conv, block, seq = c, _Block(), 0
                if code is None:
                    continue
                if block.full(block_rows):
                    out.append(_open(conv, slice_no, seq, block))
                    block, seq = _Block(), seq + 1
                    if len(out) > 1:
                        yield _batch(out, _FOUND)
                        out = []
                block.add(turn, role, text, code)
            yield _batch(out, _FOUND)
            out = []
        if conv is not nobody:                                  # the last one may go on in the next task
            yield _batch([_open(conv, slice_no, seq, block)], _FOUND)

    order = ("conv_id", "turn", "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return dealt.sortWithinPartitions(*order).mapInArrow(run, _FOUND)


_PLACE = ("conv_id", "slice", "seq")


def _join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on equal keys, null ids being equal; the keys are kept once."""
    renamed = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, on, how).drop(*[f"_{c}" for c in keys])


def _repeats(blocks: DataFrame) -> DataFrame:
    """(conv_id, slice, seq, repeated): positions whose row an earlier block of the conversation holds.
    A block holds a hash once, so a row repeated without end is one row a block here."""
    at = blocks.select(*_PLACE, F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    first = (at.groupBy("conv_id", "hash").agg(F.min(F.struct("slice", "seq")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    later = _join(at, first, ("conv_id", "hash")).where(F.struct("slice", "seq") > F.col("first"))
    return later.groupBy(*_PLACE).agg(F.collect_list("pos").alias("repeated"))


_SHARE = f"conv_id bigint, slice int, seq int, part int, n_parts int, state int, {_SUMMARY}, fields string"


def _solve_blocks(narrow: DataFrame) -> DataFrame:
    """Each block's share of its conversation's repair; one byte a row is gathered a conversation."""
    def solved(conv, held: list[tuple]) -> list[list]:
        codes = [bytearray(h[3]) for h in held]
        for code, h in zip(codes, held):
            for pos in h[7] or ():
                code[pos] = code[pos] // 4 * 4 + DUPLICATE
        cost, fields = solve(b"".join(map(bytes, codes)))
        spans = [h[4:7] for h in held if h[4] is not None]
        distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        gaps = _gaps(spans[0][0], spans[-1][1], distinct) if spans else 0
        summary = [gaps, *faults(b"".join(map(bytes, codes))), cost]
        out, at, state = [], 0, START
        for part, (h, code) in enumerate(zip(held, codes)):
            to = at + 3 * len(code) if part < len(held) - 1 else len(fields)     # the last block takes the end
            out.append([conv, h[1], h[2], part, len(held), state, *summary, fields[at:to]])
            state = _state_after(code, fields[at:to], state)
            at = to
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    out += solved(held[0][0], held)
                    held = []
                held.append(row)
            yield _batch(out, _SHARE)
        if held:
            yield _batch(solved(held[0][0], held), _SHARE)

    return narrow.repartition("conv_id").sortWithinPartitions(*_PLACE).mapInArrow(run, _SHARE)


def _apply_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their shares as rows of ``_OUT``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):                     # a block at a time: up to BLOCK_BYTES of text
                row = batch.slice(i, 1).to_pylist()[0]
                turns = [(t["role"], t["text"]) for t in row["rows"]]
                repaired, _ = apply(turns, row["fields"], row["state"])
                yield _batch([[row["conv_id"], row["part"], row["n_parts"], row["gaps"], row["blank"],
                               row["duplicate"], row["truncated"], row["illegal"], row["cost"],
                               row["fields"].translate(_FROM_DIGITS), repaired]], _OUT)

    return blocks.mapInArrow(run, _OUT)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repaired conversations: (conv_id, part, n_parts, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired).

    ``rows`` has conv_id, turn, role and text, and may have ``present``: a row where it is false only
    names its conversation.  ``repaired`` is the array of (role, text) turns; a conversation that spans
    blocks has several parts in order, which share the summary columns and split audit and turns.

    Rows are taken by turn (null first); rows of one turn by role, then text.  Null roles and texts
    count as empty; a row without conversation id belongs to the conversation with the null id.  A role
    other than s..., u... or a... (the empty one, too) cannot be kept as it is.  Repeated rows are
    duplicates.  Other columns are ignored; an empty table gives no rows.  A conversation takes one
    byte a row in the task that solves it.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "turn-repair")
    _streamed(_coded(rows), block_rows).write.parquet(path)
    found = spark.read.parquet(path)
    names = [f.split(" ", 1)[0] for f in _OUT.replace(_TURNS, "turns").split(", ")]
    blocks = found.where("seq is not null")
    narrow = blocks.select(*_PLACE, "codes", "first_turn", "last_turn", "n_turns")
    shares = _solve_blocks(_join(narrow, _repeats(blocks.select(*_PLACE, "hashes")), _PLACE, "left"))
    parts = _apply_blocks(_join(shares, blocks.select(*_PLACE, F.col("repaired").alias("rows")), _PLACE))
    return found.where("seq is null").select(*names).unionByName(parts)


def digest(repaired: DataFrame) -> DataFrame:
    """One row a conversation: the summary columns, the whole audit and repaired_sha256, the SHA-256
    of the repaired turns as ``role:text``, joined by line ends.  Parts are hashed as they stream by."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    summary = [f.split(" ")[0] for f in _SUMMARY.split(", ")]
    single = repaired.where("n_parts = 1").select("conv_id", *summary, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    ddl = f"conv_id bigint, {_SUMMARY}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, audit, sha, begun = None, [], hashlib.sha256(), False
        for batch in batches:
            out = []
            for part, n_turns, text, letters, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if part == 0:
                    if kept is not None:
                        out.append([*kept, "".join(audit), sha.hexdigest()])
                    kept, audit, sha, begun = row, [], hashlib.sha256(), False
                audit.append(letters)
                if n_turns:
                    sha.update((("\n" if begun else "") + text).encode())
                    begun = True
            yield _batch(out, ddl)
        if kept is not None:
            yield _batch([[*kept, "".join(audit), sha.hexdigest()]], ddl)

    several = (repaired.where("n_parts > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part")
               .select("part", F.size("repaired").alias("n"), lines.alias("lines"), "audit", "conv_id", *summary))
    return single.unionByName(several.mapInArrow(run, ddl))
