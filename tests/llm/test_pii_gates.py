"""Disguised personal data: gates lose nothing, no bound on labels, linear time, planted data is caught."""

import time

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import pii

BITS = (
    "one two three four five six seven eight nine zero oh un uno null eins fünf FÜNF ZÉRO zéro dos TRES plus + dash hyphen dot point punto punkt at arroba . , - @ [at] (dot) {punkt} _at_ _dot_ <@> [.] "
    "1 2 33 444 5551234 192 168 10 john mail example com org a b é — … ‘       \n \t ſix K İ １２ о а x"
).split(" ")


def through_rows(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [s for out in pii._rows([batch]) for s in out.column(6).to_pylist()]


def test_gated_equals_ungated():
    rng = np.random.default_rng(8)
    texts = ["".join(x + rng.choice([" ", " ", " ", "", ".", ", ", "  "]) for x in rng.choice(BITS, rng.integers(1, 22))) for _ in range(20_000)]
    texts += ["plus un oh un un oh oh un oh un oh un oh", "…one 2 3 4 5 6 7 8 9 1", "+1 2 3 4 5 6 7 8 9 four—", "+FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF FÜNF"]
    got = through_rows(texts)
    want = [pii.joined(pii.find(t)[1]) for t in texts]
    assert got == want
    spelled = sum(1 for t in texts if {s for s in pii.find(t)[1]} - set(pii.find(t)[0]))
    assert spelled > 100 and got[-4] and got[-2] and got[-1]


@pytest.mark.parametrize(
    "text,part",
    [
        ("john (at) mail dot a dot b dot c dot d dot e dot com", None),
        ("a dot b dot c dot d dot e dot f at x dot org", None),
        ("mail john_at_example_dot_com now", "john_at_example_dot_com"),
        ("see jane.doe [at] mail.example [dot] co [dot] uk.", "jane.doe [at] mail.example [dot] co [dot] uk"),
    ],
)
def test_addresses_with_any_number_of_labels(text, part):
    assert [text[a:b] for k, a, b in pii.find(text)[1]] == [part or text]


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_any_number_of_blanks_beside_signs(n):
    gap = " " * n
    for text in (f"john{gap}(at){gap}mail{gap}(dot){gap}org", f"john{gap}[{gap}at{gap}]{gap}mail{gap}[{gap}dot{gap}]{gap}org", f"john{gap}at{gap}mail{gap}dot{gap}org"):
        assert pii.find(text)[1] == [("email", 0, len(text))], text
    assert through_rows([f"see 10{gap}dot{gap}0{gap}dot{gap}0{gap}dot{gap}7"]) == [f"ip:4:{4 + 5 + 3 * (3 + 2 * n)}"]


def test_blanks_elsewhere_stay():
    for text in ("4539  1488  0343  6467", "we met at   noon.  The point  (made  at  length)  was dot  by dot", "1  2  3  4 (at) 5"):
        assert pii.find(text) == ([], []), text


def test_kinds_may_overlap():
    text = "4539148803436467@mail (dot) com"
    base, full = pii.find(text)
    assert base == [("card", 0, 16)] and full == [("email", 0, len(text)), ("card", 0, 16)]
    assert through_rows([text]) == [pii.joined(full)]
    # a plain span of the same kind stays as it is
    assert pii.find("a@b.co (dot) uk")[1] == [("email", 0, 6)]


def test_time_is_linear():
    for unit in ("dot ", "a dot ", "at dot ", "at at dot ", "1 ", "1.", "_at_", "@ ", "one ", "one 2 ", "+1 ", "[at] ", "a at b dot 1 ", "  ", "[  ", "  at", "(  at  ", "at   dot   "):
        began = time.time()
        pii.find(unit * 40_000)
        assert time.time() - began < 8, unit


def test_recall_over_all_kinds():
    """Each kind in each disguise, in prose: all are found at their source offsets, and the prose alone has none."""
    rng = np.random.default_rng(3)
    names = "zero one two three four five six seven eight nine".split()
    prose = "It was at noon, the point of it all. One two things, dot by dot, were un peu late at home; 3 of 4 came.".split(" ")
    assert pii.find(" ".join(prose))[1] == []
    far = str.maketrans("aeopc", "аеорс")
    for i in range(300):
        phone = "".join(map(str, rng.integers(0, 10, 11)))
        ip = ".".join(map(str, rng.integers(1, 255, 4)))
        base = "".join(map(str, rng.integers(0, 10, 15)))
        card = next(base + str(d) for d in range(10) if pii.luhn(base + str(d)))
        spell = lambda t: " ".join(names[int(c)] for c in t)
        wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in t)
        for kind, text in (
            ("email", "peace.copa@example.com".translate(far)), ("email", "joe at mail dot example dot org"), ("email", "joe [at] example [dot] org"), ("ip", ip.replace(".", " dot ")), ("ip", wide(ip)),
            ("ip", ip.replace(".", "[.]")), ("card", spell(card)), ("card", wide(card)), ("phone", f"plus {spell(phone)}"), ("phone", "+" + wide(phone)), ("phone", f"+{phone}"), ("card", card), ("ip", ip),
        ):
            cut = int(rng.integers(0, len(prose)))
            whole = " ".join([*prose[:cut], "|", text, "|", *prose[cut:]])
            at = whole.index("| ") + 2
            assert (kind, at, at + len(text)) in pii.find(whole)[1], (kind, whole)
