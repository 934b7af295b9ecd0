"""Structure repair: edits against a search over all of them, whole conversations against a plain model, odd inputs."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from corpusloom.llm import queries, repair

BLANK = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """Least (cost, audit, roles) by a search over all edits in order of cost and letters."""
    import heapq

    n = len(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if (i, roles[:1], roles[-1:]) in done:
            continue
        if i == n and (not roles or roles[-1] == "a" and roles[0] in "su"):
            return cost, audit, out
        done.add((i, roles[:1], roles[-1:]))
        steps = []
        if i < n:
            role, text, gone, cut = rows[i]
            steps.append(("D", 3, None, None))
            if not gone:
                steps.append(("K", cut, role, text))
                steps += [("R", 2 + cut, x, text) for x in ("user", "assistant")]
        steps += [("I", 2, x, "") for x in ("user", "assistant")]
        for letter, more, role, text in steps:
            if role is None:
                heapq.heappush(heap, (cost + more, audit + letter, i + 1, roles, out))
                continue
            fits = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
            if role[:1] and role[0] in fits:
                heapq.heappush(heap, (cost + more, audit + letter, i + (letter != "I"), roles + role[0], (*out, (role, text))))
    raise AssertionError


def model(turns):
    """What ``op13`` gives for (turn, role, text) rows that are damaged already."""
    rows = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, counts, kinds = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            counts[fault - 1] += 1
        kinds.append((role, text, fault in (1, 2), int(fault == 3)))
    nums = [t for t, _, _ in rows if t is not None]
    gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = plain_edits(kinds)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


CODES = [k | f for k in range(4) for f in (0, repair.CUT, repair.GONE)]


def as_row(code):
    return ("system", "user", "assistant", "tool")[code & 3], "t", bool(code & repair.GONE), int(bool(code & repair.CUT))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_all_short_conversations(n):
    for rows in itertools.product(CODES, repeat=n):
        assert repair.cheapest(bytes(rows)) == plain_edits([as_row(c) for c in rows])[:2], rows


def test_long_conversations_by_checkpoints():
    rng = np.random.default_rng(4)
    for n in [4, 5, 8, 9, 15, 16, 17, 40, 99, 100, 101, 300]:
        rows = bytes(int(x) for x in rng.choice(CODES, n))
        assert repair._walk(rows) == plain_edits([as_row(c) for c in rows])[:2]
    cost, audit = repair._walk(bytes([1, 2] * 100_000))
    assert (cost, audit) == (0, "K" * 200_000)


def check(spark, path, rows):
    spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_structure_repair(spark, str(path)).collect()}
    want = {c: [] for c, *_ in rows}
    text = lambda v: " " if v is None else str(v)
    for conv, turn, role, words in rows:
        role, words = text(role), text(words)
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        if kind == 1:
            words = ""
        if kind == 2:
            words = "".join(c for c in words if c not in ".!?")
        if kind == 4:
            role = "user"
        want[conv] += [(turn, role, words)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == {c: model(t) for c, t in want.items()}
    return got


def test_query_equals_plain_model(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = ["Yes.", "No", "Why? ", " \t", "Go on!\n\n", "é。", "So... "]
    rows = []
    for c in range(150):
        turn = 0
        for _ in range(rng.integers(1, 12)):
            turn += int(rng.integers(1, 3))
            rows.append((c, turn, str(rng.choice(["user", "assistant", "system", "tool", "ai"])), str(rng.choice(texts))))
    check(spark, tmp_path, rows)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (7, None, "user", "a."), (7, None, "assistant", "b."), (8, 1, "", "x."), (8, 2, "User", "x."), (9, 5, "user", "w " * 50_000 + "."), (9, 6, "assistant", "ok.")]
    rows += [(10, 2, "user", "same."), (10, 2, "user", "same."), (10, 9, "user", "same.")]
    rows += [(c, 0, "user", "gone.") for c in range(100, 140)]
    got = check(spark, tmp_path, rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert nothing in got.values()


def test_query_on_an_empty_table(spark, tmp_path):
    assert check(spark, tmp_path, []) == {}


def test_rows_of_a_long_conversation_stream(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [(c, i, ("user", "assistant")[i % 2], f"{c} {i}.") for c in (1, 2) for i in range(1000)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        edits = repair.find_edits(df)
        assert {(r.conv_id, r.cost, r.audit) for r in edits.collect()} == {(c, 0, "K" * 1000) for c in (1, 2)}
        got = {r.conv_id: r.sha256 for r in repair.turn_digests(repair.apply_edits(df, edits)).collect()}
        assert got == {c: hashlib.sha256("\n".join(f"{r}:{t}" for x, _, r, t in rows if x == c).encode()).hexdigest() for c in (1, 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
