"""Conversation structure repair: the cheapest edits that make turns alternate, by a dynamic program with square-root checkpoints.

An edit keeps a row, gives it another role, deletes it, or inserts an empty
turn; the roles left must read system? (user assistant)+, or nothing. Rows of a
conversation stream by in order, and a task keeps a byte a row of what the
program needs. Its vectors of least costs to the end, one cost a state of the
pattern, are computed backwards and kept at every n-th of n*n rows only; the
walk forward computes those between two of them anew, a stretch at a time, and
takes at each point the first edit in ASCII order that reaches the least cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space, which makes no text.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. An edit other than deleting leads from each to one state.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
_NEXT = (2, 2, 3, 2)
_ROLE = (USER, USER, ASSISTANT, USER)
_ENDS = (True, False, False, True)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60
#: A row in a byte: its role's class, and 4 if truncated or 8 if it must go.
CUT, GONE = 4, 8

_KEY = "conv_id long, turn long, role string, digest string"
_EDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TURNS = "conv_id long, position long, role string, text string, edit string"


def _settled(v: list[int]) -> list[int]:
    """Least costs with insertions before the next row counted."""
    start, system, user, assistant = v
    u, a = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(start, INSERT + u), min(system, INSERT + u), u, a]


def _before(after: list[int], row: int) -> list[int]:
    """Least costs to the end before a row, by state, from those after it."""
    costs = [DELETE + x for x in after]
    if not row & GONE:
        cut, role = TRUNCATED if row & CUT else 0, row & 3
        for q in range(4):
            costs[q] = min(costs[q], cut + after[_NEXT[q]] + (0 if role == _ROLE[q] else REROLE))
        if role == SYSTEM:
            costs[0] = min(costs[0], cut + after[1])
    return _settled(costs)


def _walk(rows: bytes) -> tuple[int, str]:
    n = len(rows)
    step = math.isqrt(n) + 1
    end = _settled([0 if x else _FAR for x in _ENDS])
    kept, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0:
            kept[i + 1] = v
        v = _before(v, rows[i])
    cost, audit, q = v[0], [], 0
    for at in range(0, n, step):
        to = min(at + step, n)
        stretch = [kept.get(to, end)]
        for i in range(to - 1, at - 1, -1):
            stretch.append(_before(stretch[-1], rows[i]))
        stretch.reverse()
        for i in range(at, to):
            here, after, row = stretch[i - at], stretch[i - at + 1], rows[i]
            while True:
                if DELETE + after[q] == here[q]:
                    audit.append("D")
                    break
                if INSERT + here[_NEXT[q]] == here[q]:
                    audit.append("I")
                    q = _NEXT[q]
                    continue
                cut, role = TRUNCATED if row & CUT else 0, row & 3
                if q == 0 and role == SYSTEM and cut + after[1] == here[q]:
                    audit.append("K")
                    q = 1
                    break
                audit.append("K" if role == _ROLE[q] and cut + after[_NEXT[q]] == here[q] else "R")
                q = _NEXT[q]
                break
    while not _ENDS[q]:
        audit.append("I")
        q = _NEXT[q]
    return cost, "".join(audit)


_short = lru_cache(1 << 16)(_walk)


def cheapest(rows: bytes) -> tuple[int, str]:
    """Least cost of repairing rows (a byte each), and of the edits that reach it the ASCII-least, by their initials."""
    return _short(rows) if len(rows) <= 64 else _walk(rows)


def _rows(turns: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"))


class _Conversation:
    """What is kept of a conversation while its rows go by."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.rows, self.counts, self.turns = conv, bytearray(), [0, 0, 0], [None, None, 0]

    def add(self, turn: int | None, fault: int, kind: int) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if fault:
            self.counts[fault - 1] += 1
        self.rows.append(kind | (0, GONE, GONE, CUT)[fault])

    def row(self) -> tuple:
        first, last, distinct = self.turns
        roles = bytes(x & 3 for x in self.rows)
        legal = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        illegal = sum(p not in legal for p in zip(roles, roles[1:]))
        gaps = 0 if first is None else last - first + 1 - distinct
        return (self.conv, gaps, *self.counts, illegal, *cheapest(bytes(self.rows)))


def _table(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split() for x in names.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=pa.schema(fields)) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema(fields))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, last = None, None
    for batch in batches:
        out = []
        for conv, turn, role, digest, fault, seen in zip(*(batch[n].to_pylist() for n in ("conv_id", "turn", "role", "digest", "fault", "seen"))):
            if held is None or conv != held.conv:
                out += [held.row()] if held else []
                held, last = _Conversation(conv), None
            row = (turn, role, digest)
            again = seen or row == last
            last = row
            held.add(turn, 2 if again and fault != 1 else fault, {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER))
        if out:
            yield _table(out, _EDITS)
    if held:
        yield _table([held.row()], _EDITS)


def find_edits(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``turns`` (conv_id, turn, role, text).

    Rows go by turn, null turns first, ties by role and a digest of the text. A
    row's first fault counts: blank (only white space), duplicate (role and text
    stood earlier), truncated (last character that is not white space is none
    of . ! ?). Blank and duplicate rows must go. ``gaps`` are turn numbers
    missing between the first and last, ``illegal`` neighbours whose role
    initials are not su, ua or au. ``audit`` has the initial of each edit (Keep,
    Rerole, Delete, Insert) in order. Null roles and texts are empty, a null
    conv_id is a conversation, other columns are ignored.

    Whether a text stood earlier is found by an aggregate, which combines
    before it shuffles; texts stay out of all shuffles here. A task streams its
    rows and keeps a byte a row of the conversation at hand, as much as the
    audit that it returns.
    """
    rows = _rows(turns)
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    marked = rows.select("conv_id", "turn", "role", "digest", fault.alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("p"), F.col("turn").alias("t"))
    firsts = marked.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    known = marked.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    seen = F.col("first").isNotNull() & (F.col("first") < place)
    known = known.select("conv_id", "turn", "role", "digest", "fault", seen.alias("seen"))
    return known.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").mapInArrow(_edited, _EDITS)


class _Reader:
    """The turns that a conversation's edits make of its rows, one row after another."""

    def __init__(self, conv: int | None, audit: str) -> None:
        self.conv, self.audit, self.at, self.state, self.position = conv, audit, 0, 0, 0

    def _turn(self, role: str, text: str, edit: str) -> tuple:
        self.position += 1
        return (self.conv, self.position - 1, role, text, edit)

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._turn(_NAMES[_ROLE[self.state]], "", "I")
            self.at, self.state = self.at + 1, _NEXT[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._turn(role if edit == "K" else _NAMES[_ROLE[self.state]], text, edit)
            self.state = 1 if edit == "K" and role[:1] == "s" else _NEXT[self.state]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        out = []
        for conv, head, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "head", "role", "text"))):
            if head:
                out += held.inserts() if held else []
                held = _Reader(conv, text)
            else:
                out += held.row(role, text)
        if out:
            yield _table(out, _TURNS)
    if held and (out := list(held.inserts())):
        yield _table(out, _TURNS)


def apply_edits(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the repaired turns of ``turns``, from the edits found for them.

    Texts are shuffled once. A task streams its rows, a conversation's audit
    before them; the result's partitions hold whole conversations in order.
    """
    rows = _rows(turns).withColumn("head", F.lit(False))
    heads = edits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), F.lit(True).alias("head"))
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "digest")
    return both.select("conv_id", "head", "role", "text").mapInArrow(_repaired, _TURNS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    conv, digest = None, None
    for batch in batches:
        out = []
        for c, position, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "position", "role", "text"))):
            if position == 0:
                out += [(conv, digest.hexdigest())] if digest else []
                conv, digest = c, hashlib.sha256()
            digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
        if out:
            yield _table(out, "conv_id long, sha256 string")
    if digest:
        yield _table([(conv, digest.hexdigest())], "conv_id long, sha256 string")


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` of turns, a line each, as ``apply_edits`` gives them: read in its partitions' order, without a shuffle. Conversations without turns have no row."""
    return repaired.mapInArrow(_hashed, "conv_id long, sha256 string")
