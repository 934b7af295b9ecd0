"""Mixing sources to target weights by Pfair scheduling, by DataFrame functions only."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Mapping
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.ranks import spread_rank

#: Sources that a mixture may have: their counts and weights are held by the driver.
MAX_SOURCES = 65_536


def _shares(targets: Mapping[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of the targets (a float is a fraction)."""
    exact = {s: Fraction(t) for s, t in targets.items()}
    scale = math.lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * scale) for s, f in exact.items()}


def pfair(blocks: Mapping[str, int], targets: Mapping[str, float]) -> list[tuple[str, int]]:
    """(source, phase) of each slot, so that every block of every source gets one.

    Of a source with the share w of the targets, block j may run from slot
    floor(j / w) of a phase on and must have run before slot
    ceil((j + 1) / w). Each slot goes to the released block with the earliest
    deadline (ties by source name). As the shares sum to one, every window is
    met, so after each slot every source is less than one block from its
    share, whatever the weights and however long the phase. When the slot's
    source has no block left, a new phase begins without it. Sources of weight
    0 come when all others are used up, with equal weights.
    """
    out: list[tuple[str, int]] = []
    phase = 0
    for group in ({s: targets[s] for s in blocks if targets[s] > 0}, {s: 1.0 for s in blocks if not targets[s] > 0}):
        left = {s: blocks[s] for s in group if blocks[s] > 0}
        while left:
            share = _shares({s: group[s] for s in left})
            whole = sum(share.values())
            waiting = [(0, s, 0) for s in left]
            heapq.heapify(waiting)
            ready: list[tuple[int, str, int]] = []
            slot = 0
            while True:
                while waiting and waiting[0][0] <= slot:
                    _, s, j = heapq.heappop(waiting)
                    heapq.heappush(ready, (-(-(j + 1) * whole // share[s]), s, j))
                _, s, j = heapq.heappop(ready)
                if not left[s]:
                    del left[s]
                    break
                left[s] -= 1
                out.append((s, phase))
                heapq.heappush(waiting, ((j + 1) * whole // share[s], s, j + 1))
                slot += 1
            phase += 1
    return out


def timetable(counts: Mapping[str, int], targets: Mapping[str, float], blocks: int = 1 << 14, stretch: int = 256) -> tuple[list[tuple], list[tuple]]:
    """(spans, steps) that deal slots 0 to n - 1 to the rows of all sources, each once.

    All rows together make about ``blocks`` blocks of b rows, which ``pfair``
    puts in order. In a stretch of up to ``stretch`` of these, rows do not
    come block by block: the stretch's order of sources is gone through b
    times, a row a time. So sources alternate by the row, and still after each
    row every source is less than one block from its share. What is left of
    sources (less than a block each) is dealt in the same way, in smaller
    blocks, until those are of one row.

    A span is (source, level, first, last, b): rows first to last - 1 of a
    source are in that level. A step is (source, level, block, slot0, length,
    turn, j, at, phase): the ``block``-th block of the source in the level
    lies in the stretch from slot0 on, of ``length`` sources, ``turn`` of
    which are the source's; it is the j-th of these and stands at ``at``.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    blocks = max(blocks, 2 * len(left))
    done, base, level, phases = dict.fromkeys(left, 0), 0, 0, 0
    spans: list[tuple] = []
    steps: list[tuple] = []
    while left:
        b = -(-sum(left.values()) // blocks)
        whole = {s: n // b for s, n in left.items() if n >= b}
        order = pfair(whole, {s: targets[s] for s in whole})
        spans += [(s, level, done[s], done[s] + n * b, b) for s, n in whole.items()]
        used = dict.fromkeys(whole, 0)
        a = 0
        while a < len(order):
            z = a
            while z < len(order) and z - a < stretch and order[z][1] == order[a][1]:
                z += 1
            turns: dict[str, int] = {}
            for s, _ in order[a:z]:
                turns[s] = turns.get(s, 0) + 1
            seen = dict.fromkeys(turns, 0)
            for at, (s, phase) in enumerate(order[a:z]):
                steps.append((s, level, used[s] + seen[s], base + a * b, z - a, turns[s], seen[s], at, phases + phase))
                seen[s] += 1
            for s, n in turns.items():
                used[s] += n
            a = z
        base += len(order) * b
        phases += order[-1][1] + 1
        for s, n in whole.items():
            done[s] += n * b
        left = {s: n % b if s in whole else n for s, n in left.items()}
        left = {s: n for s, n in left.items() if n}
        level += 1
    return spans, steps


def dealer(counts: Mapping[str, int], targets: Mapping[str, float], **sizes: int) -> Callable[[str, np.ndarray], np.ndarray]:
    """A function from a source and ranks in it to slots 0 to n - 1, each once, by ``timetable``."""
    spans, steps = timetable(counts, targets, **sizes)
    by: dict[str, list] = {}
    for s, level, first, last, b in spans:
        by.setdefault(s, []).append((first, b, []))
    at = {(s, level): by[s][i][2] for s in by for i, level in enumerate(x[1] for x in spans if x[0] == s)}
    for s, level, block, slot0, length, turn, j, place, _ in steps:
        at[s, level].append((block, slot0, length, turn, j, place))
    tables = {s: [(first, b, np.array(sorted(x), np.int64)) for first, b, x in parts] for s, parts in by.items()}

    def slots(source: str, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        parts = tables[source]
        of = np.searchsorted(np.array([p[0] for p in parts]), rank, "right") - 1
        for i, (first, b, step) in enumerate(parts):
            here = np.flatnonzero(of == i)
            r = rank[here] - first
            block, slot0, length, turn, j, place = step[r // b].T
            times, which = np.divmod(r - (block - j) * b, turn)
            out[here] = slot0 + times * length + step[block - j + which, 5]
        return out

    return slots


def source_counts(docs: DataFrame) -> dict[str, int]:
    """Rows of each source, at most ``MAX_SOURCES``; null is the source ""."""
    found = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).count().limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: r["count"] for r in found}


def mix_sources(docs: DataFrame, targets: Mapping[str, float] | None = None, blocks: int = 1 << 14, stretch: int = 256, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` (doc_id, source, ...) in ``row``, with source, slot, block, phase.

    Rows of a source are put in hash order. ``slot`` (0 to n - 1, each once) is
    the row's place in the mixture, ``block`` the number of its block in its
    source, ``phase`` counts the stretches in which the same sources take
    part. After each slot of a phase every source is less than one block from
    its target share (see ``timetable``); a block has one row up to ``blocks``
    rows in all, and 1/``blocks`` of them beyond. A new phase begins when a
    source is used up; rows less than a block come at the end. Every row gets
    a slot.

    Targets not given are the square roots of the row counts, which lifts
    small sources. Sources that ``targets`` lacks, or gives 0, follow when all
    others are used up; a negative or non-finite target is an error. A null
    source is a source of its own, "". Rows that repeat, and rows whose doc_id
    is null, get a slot each. An empty table gives no rows. Only the row
    counts of sources (at most ``MAX_SOURCES``) come to the driver, and the
    schedule of some ``blocks`` blocks goes out from there.
    """
    spark = docs.sparkSession
    doc_id, source = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.source").cast("string"), F.lit(""))
    text = F.xxhash64(F.col("row.text").cast("string")) if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    k = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = rows.select("row", source.alias("source"), k.alias("k"), F.coalesce(doc_id, F.lit(0)).alias("tie1"), text.alias("tie2"))
    counts = source_counts(docs)
    given = {s: n**0.5 for s, n in counts.items()} if targets is None else {s: float(targets.get(s, 0.0)) for s in counts}
    if any(not math.isfinite(t) or t < 0 for t in given.values()):
        raise ValueError("targets must be finite and not negative")
    spans, steps = timetable(counts, given, blocks, stretch)
    per_range = max(1024, sum(counts.values()) >> 16)
    # at most MAX_SOURCES groups and 2**16 ranges more than that, whatever the rows
    ranked = spread_rank(rows, ["source"], "k", per_range, ["tie1", "tie2"], few=True)
    # bounded by the numbers of sources and blocks, not by the rows
    span = spark.createDataFrame(spans, "source string, level int, first long, last long, b long")
    step = spark.createDataFrame(steps, "source string, level int, block long, slot0 long, length long, turn long, j long, at long, phase int")
    leveled = ranked.join(F.broadcast(span), "source").where("rank >= first and rank < last").withColumn("block", F.expr("(rank - first) div b"))
    inside = leveled.join(F.broadcast(step.drop("at")), ["source", "level", "block"]).withColumn("i", F.expr("rank - first - (block - j) * b"))
    where = step.select("source", "level", F.col("block").alias("own"), "at")
    placed = inside.withColumn("own", F.expr("block - j + i % turn")).join(F.broadcast(where), ["source", "level", "own"])
    return placed.select("row", "source", F.expr("slot0 + (i div turn) * length + at").alias("slot"), F.expr("first div b + block").alias("block"), "phase")


def in_order(mixed: DataFrame, n: int, parts: int) -> DataFrame:
    """``mixed`` in ``parts`` range partitions of its ``n`` slots, sorted; slots are gapless, so no sample is needed."""
    return mixed.repartitionById(parts, F.expr(f"cast(slot div {max(1, -(-n // parts))} as int)")).sortWithinPartitions("slot")
