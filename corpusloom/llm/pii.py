"""Personal data: plain patterns, and disguised ones found through offset-preserving normalisation."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive, and from the start of a run of digits only: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_ANY = re.compile(r"[0-9@]")

# Letters and signs that look like ASCII ones.
_HOMOGLYPHS = {
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "İ": "I", "ſ": "s", "\u212a": "K", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "۔": ".", "。": ".", "․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "﹢": "+",
}
for _c in range(0x21, 0x7F):  # full-width forms
    _HOMOGLYPHS[chr(_c + 0xFEE0)] = chr(_c)
for _base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other digits
    for _d in range(10):
        _HOMOGLYPHS[chr(_base + _d)] = chr(48 + _d)
for _base in (0x1D400, 0x1D434, 0x1D468, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):  # mathematical alphabets
    for _d in range(26):
        _HOMOGLYPHS[chr(_base + _d)] = chr(65 + _d)
        _HOMOGLYPHS[chr(_base + 26 + _d)] = chr(97 + _d)
_INVISIBLE = "­​‌‍⁠﻿"
#: All white space beyond ASCII.
_WIDE_SPACE = "".join(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace())
_STRANGE = re.compile("[" + re.escape("".join(_HOMOGLYPHS) + _INVISIBLE + _WIDE_SPACE) + "]")
# Digits in words.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_JOIN = r"(?:[ ,\-]{1,2}|\.\ ?)"
#: A run of at least four digits of which one is a word, with an optional spoken plus or dots between.
_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:plus[ ]|\+[ ]?))?(?:{_WORD}|[0-9]+)(?:(?:{_JOIN}|[ ](?:dot|point|punto|punkt|dash|hyphen)[ ])(?:{_WORD}|[0-9]+)){{3,}}(?!\w)")
_PIECE = re.compile(rf"(?i)(plus)|\b(dot|point|punto|punkt)\b|\b(dash|hyphen)\b|({_WORD})|([0-9]+)|(\+)|(.)")
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_WORD})(?!\w)")
_S = r"[^\S\n]"
_AT = rf"(?:{_S}{{0,2}}[\[({{<]{_S}?(?:at|arroba|@){_S}?[\])}}>]{_S}{{0,2}}|{_S}{{1,2}}(?:at|arroba){_S}{{1,2}}|_at_|{_S}?@{_S}?)"
_DOT = rf"(?:{_S}{{0,2}}[\[({{<]{_S}?(?:dot|punto|punkt|point|\.){_S}?[\])}}>]{_S}{{0,2}}|{_S}{{1,2}}(?:dot|punto|punkt|point){_S}{{1,2}}|_dot_|\.)"
_AT_ONE, _DOT_ONE = re.compile(rf"(?i){_AT}"), re.compile(rf"(?i){_DOT}")
_BARE = re.compile(rf"(?i){_S}+(?:at|arroba){_S}+")
_TAIL = re.compile(rf"(?i)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_DOT_BEFORE = re.compile(rf"(?i){_DOT}\Z")
_DOT_LENGTH = 14
_TOP = re.compile(r"[A-Za-z]{2,63}\Z")
_LABEL = _LOCAL - {"."}
_DISGUISE = re.compile(r"(?i)(?:[\[({<]\s*(?:at|arroba|@|dot|punto|punkt|point|\.)\s*[\])}>])|(?:\s(?:dot|punto|punkt|point)\s)|_at_|_dot_|\s@|@\s")
#: Blanks in a row, and the signs (brackets, words for at and dot) beside which they count as one.
_BLANKS = re.compile(rf"{_S}{{2,}}")
_SIGN_AFTER = re.compile(r"(?i)[\[({<\])}>@]|(?:at|arroba|dot|punto|punkt|point)(?!\w)")
_SIGN_BEFORE = re.compile(r"(?i)(?:[\[({<\])}>@]|(?<!\w)(?:at|arroba|dot|punto|punkt|point))\Z")
_SIGN_LENGTH = 8
_IP_DOT = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Spans of the four plain patterns, leftmost and non-overlapping within a kind."""
    if not _ANY.search(text):
        return []
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            found.append(("email", a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class Mapped:
    """A text under rewriting that knows the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the (ascending, disjoint) ranges; each new character stands for its whole range."""
        if not edits:
            return
        parts, start, end, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        parts.append(self.text[at:])
        self.start, self.end = [*start, *self.start[at:]], [*end, *self.end[at:]]
        self.text = "".join(parts)


def _look_alikes(m: Mapped) -> None:
    m.rewrite([(x.start(), x.end(), _HOMOGLYPHS.get(x[0], "" if x[0] in _INVISIBLE else " ")) for x in _STRANGE.finditer(m.text)])


def _wide_blanks(m: Mapped) -> None:
    """Blanks beside a sign for at or dot become one, however many they are; those elsewhere stay."""
    runs = [(x.start(), x.end()) for x in _BLANKS.finditer(m.text)]
    m.rewrite([(a, b, " ") for a, b in runs if _SIGN_AFTER.match(m.text, b) or _SIGN_BEFORE.search(m.text, max(0, a - _SIGN_LENGTH), a)])


def _spoken_digits(m: Mapped) -> None:
    edits = []
    for run in _RUN.finditer(m.text):
        if not _SPELLED.search(run[0]):
            continue
        for x in _PIECE.finditer(run[0]):
            plus, dot, dash, word, digits, sign, other = x.groups()
            new = "+" if plus or sign else "." if dot else "-" if dash else _DIGITS[word.lower()] if word else digits or ("." if other == "." else "")
            a = run.start() + x.start()
            if new != x[0]:
                edits.append((a, run.start() + x.end(), new))
    m.rewrite(edits)


def _mails(text: str) -> Iterator[tuple[int, int, int, int, list[re.Match]]]:
    """(start, at from, at to, end, dots of the tail) of each address, with any number of labels.

    Each sign for at is tried from left to right: first what follows it, then,
    back to the last address, what leads to it.
    """
    at, free = _AT_ONE.search(text), 0
    while at:
        tail = _TAIL.match(text, at.end())
        if not tail:
            at = _AT_ONE.search(text, at.start() + 1)
            continue
        dots = list(_DOT_ONE.finditer(text, tail.start(), tail.end()))
        # a bare " at " is an address only if a dot is spelled or bracketed too: prose has "at" everywhere
        bare = _BARE.fullmatch(at[0]) and all(d[0] == "." for d in dots)
        if bare or not _TOP.search(text, dots[-1].end(), tail.end()):
            # any sign within this tail has the same end
            at = _AT_ONE.search(text, at.start() + 1 if bare else tail.end())
            continue
        a = at.start()
        while a > free and text[a - 1] in _LABEL:
            a -= 1
        if a == at.start():
            at = _AT_ONE.search(text, at.start() + 1)
            continue
        while dot := _DOT_BEFORE.search(text, max(free, a - _DOT_LENGTH), a):
            b = dot.start()
            while b > free and text[b - 1] in _LABEL:
                b -= 1
            if b == dot.start():
                break
            a = b
        yield a, at.start(), at.end(), tail.end(), dots
        free = tail.end()
        at = _AT_ONE.search(text, free)


def _at_and_dot(m: Mapped) -> None:
    edits = []
    for a, at, to, _, dots in _mails(m.text):
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONE.finditer(m.text, a, at) if d[0] != "."]
        if m.text[at:to] != "@":
            edits.append((at, to, "@"))
        edits += [(d.start(), d.end(), ".") for d in dots if d[0] != "."]
    for ip in _IP_DOT.finditer(m.text):
        edits += [(ip.start() + d.start(), ip.start() + d.end(), ".") for d in _DOT_ONE.finditer(ip[0]) if d[0] != "."]
    edits.sort()
    kept: list[tuple[int, int, str]] = []
    for e in edits:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    m.rewrite(kept)


def disguised(text: str, speaks: bool, hides: bool) -> list[Span]:
    """Spans that show only after normalisation, in source offsets. ``speaks``, ``hides``: may it spell digits, or at and dot."""
    strange = not text.isascii() and _STRANGE.search(text)
    hides = hides and _DISGUISE.search(text)
    if not (strange or speaks or hides):
        return []
    m = Mapped(text)
    if strange:
        _look_alikes(m)
    _wide_blanks(m)
    if strange or speaks:
        _spoken_digits(m)
    _at_and_dot(m)
    if m.text == text:
        return []
    return [(kind, m.start[a], m.end[b - 1]) for kind, a, b in plain(m.text)]


def find(text: str | None, speaks: bool = True, hides: bool = True) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by start, then kind as in KINDS.

    Plain spans stay as they are; a disguised span joins them unless it
    overlaps a plain one of its kind, and no two disguised spans of a kind
    overlap.
    """
    if not text:
        return [], []
    order = lambda s: (s[1], KINDS.index(s[0]))
    base = sorted(plain(text), key=order)
    more = disguised(text, speaks, hides)
    if more and base:
        for kind in {s[0] for s in more}:
            # plain spans of a kind do not overlap: the last that starts before an end decides
            own = [b for b in base if b[0] == kind]
            starts = [b[1] for b in own]
            more = [s for s in more if s[0] != kind or not (n := bisect_left(starts, s[2])) or own[n - 1][2] <= s[1]]
    return base, sorted(base + more, key=order)


def _known(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words as textbytes gives them, and which top 16 bits they have."""
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    h = np.sort(tb.words(raw, np.array([0, len(raw)]), tb.BY_PUNCTUATION)[3])
    top = np.zeros(1 << 16, bool)
    top[(h >> np.uint64(48)).astype(np.int64)] = True
    return h, top


#: Words that spell a digit or part two spelled ones (A-Z as a-z, other letters in both cases), and those for a dot.
_SPEAK_WORDS = _known([w for d in (*_DIGITS, "dot", "point", "punto", "punkt", "dash", "hyphen") for w in sorted({d, d.replace("ü", "Ü").replace("é", "É")})])
_DOT_WORDS = _known("dot punto punkt point".split())
#: For bytes.translate: what plain patterns need; lead bytes of letters beyond Latin; and brackets and signs that hide an at.
_PLAIN_BYTES, _FAR_BYTES, _SIGN_BYTES = b"0123456789@", bytes(range(0xC9, 0xF5)), b"[({<@_"
_NEAR_STRANGE = tuple(c.encode() for c in _HOMOGLYPHS.keys() | set(_INVISIBLE) | set(_WIDE_SPACE) if ord(c) < 0x250)


def _holds(h: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which words are of the list."""
    out = np.zeros(len(h), bool)
    at = np.flatnonzero(known[1][(h >> np.uint64(48)).astype(np.int64)])
    out[at] = np.isin(h[at], known[0])
    return out


def _speaking(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Rows that may hold a run of _RUN.

    Of its four digits and more, the first and the last may touch a letterless
    sign beyond ASCII, which the words here are not parted at; those between
    are words of their own. So two words that follow one another must each be
    a digit word, a number or what may part them.
    """
    spoken = _holds(h, _SPEAK_WORDS)
    upto = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    like = spoken | (upto[end] - upto[start] == end - start)
    two = like[1:] & like[:-1] & (row[1:] == row[:-1])
    return np.bincount(row[1:][two], minlength=n) > 0


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without a byte or word that any pattern needs are passed over; all others are read whole, with the same result as without."""
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        bases, spans = [], []
        for a, b, data, offsets in tb.slices(batch.column(1)):
            start, end, row, h = tb.words(data, offsets, tb.BY_PUNCTUATION)
            speaks, dots = _speaking(data, start, end, row, h, b - a), np.bincount(row[_holds(h, _DOT_WORDS)], minlength=b - a) > 0
            raw = data.tobytes()
            for i in range(b - a):
                text = raw[offsets[i] : offsets[i + 1]]
                n = len(text)
                lacks = lambda drop: len(text.translate(None, drop)) == n
                hides = bool(dots[i]) or not lacks(_SIGN_BYTES)
                strange = not text.isascii() and (not lacks(_FAR_BYTES) or any(c in text for c in _NEAR_STRANGE))
                base: list[Span] = []
                full: list[Span] = []
                if speaks[i] or hides or strange or not lacks(_PLAIN_BYTES):
                    base, full = find(text.decode("utf-8", "replace"), bool(speaks[i]), hides)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in full) if full else 0)
                bases.append(joined(base) if base else "")
                spans.append(joined(full) if full else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(bases, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
        )


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans for every row of ``docs``.

    ``base`` holds the plain spans, ``spans`` all, both as kind:start:end
    (code points, end exclusive) joined by commas; counts are of ``spans``. A
    null or empty text has none; rows that repeat get a row each; other
    columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    )


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets."""
    if not text:
        return text
    parts, at = [], 0
    for kind, a, b in find(text)[1]:
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])
