"""Chat formatting: records of many layouts to canonical turns, turns to one marked text with a loss mask, by DataFrame functions only.

A record's nested field paths are hashed; the hash selects a declarative
mapping, and the mapping says which paths are turns of which role. Turns become
one text in which a template marks them; control strings inside texts are
escaped, so that the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: fixed (role, path) pairs, or a list's elements by the names of their role and text.

    ``needs`` are the field paths that a record of the layout has, ``may`` those
    that it can have besides. ``names`` turns a layout's role names into
    canonical ones; others stay. Where the text is a list of parts, ``parts``
    names the text of a part.
    """

    layout: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    parts: str = ""
    names: dict[str, str] = field(default_factory=dict)


#: The layouts that conversations are published in.
MAPPINGS = [
    Mapping("prompt", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("preference", ("prompt", "chosen", "rejected"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "chosen"))),
    Mapping("instruction", ("instruction", "output"), ("system", "input"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", ("question", "answer"), ("context",), (("system", "context"), ("user", "question"), ("assistant", "answer"))),
    Mapping("messages", ("messages[]",), ("messages[].role", "messages[].content", "messages[].name"), items="messages", role="role", text="content"),
    Mapping("message_parts", ("messages[]", "messages[].content[]"), ("messages[].role", "messages[].content[].type", "messages[].content[].text"), items="messages", role="role", text="content", parts="text"),
    Mapping("from_value", ("conversations[]",), ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", names={"human": "user", "gpt": "assistant"}),
]


def fingerprint(paths: list[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(m: Mapping) -> list[str]:
    """Those of all records that a mapping takes."""
    return [fingerprint([*m.needs, *some]) for n in range(len(m.may) + 1) for some in itertools.combinations(m.may, n)]


def _paths(kind: DataType, path: str = "") -> dict[str, list]:
    """Field paths at and below ``path``, each with the steps to it: a field's name, or None for a list's elements."""
    if isinstance(kind, StructType):
        return {p: [f.name, *steps] for f in kind for p, steps in _paths(f.dataType, f"{path}.{f.name}" if path else f.name).items()}
    if isinstance(kind, ArrayType):
        below = _paths(kind.elementType, f"{path}[]") if isinstance(kind.elementType, (StructType, ArrayType)) else {}
        return {f"{path}[]": [], **{p: [None, *steps] for p, steps in below.items()}}
    return {path: []}


def _had(at: Column, steps: list) -> Column:
    """Whether a value has what the steps lead to, in a list by any element."""
    for i, name in enumerate(steps):
        if name is None:
            return F.coalesce(F.exists(at, lambda x: _had(x, steps[i + 1 :])), F.lit(False))
        at = at[name]
    return at.isNotNull()


def schema_fingerprint(record: str, kind: StructType) -> Column:
    """Hash of the sorted nested field paths that a record has, a path in a list being had if any element has it. A null field is not had."""
    return F.sha2(F.concat_ws("\n", *[F.when(_had(F.col(record), steps), F.lit(p)) for p, steps in sorted(_paths(kind).items())]), 256)


def _turns(m: Mapping, record: str) -> Column:
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    at = F.col(record)
    if m.turns:
        every = F.array(*[F.when(at[p].isNotNull(), turn(F.lit(r), at[p].cast("string"))) for r, p in m.turns])
        return F.filter(every, lambda x: x.isNotNull())
    names = F.create_map(*[F.lit(x) for pair in m.names.items() for x in pair]) if m.names else None
    role = lambda x: F.coalesce(names[x[m.role]], x[m.role]) if m.names else x[m.role]
    text = lambda x: F.array_join(F.transform(x[m.text], lambda p: F.coalesce(p[m.parts], F.lit(""))), "") if m.parts else x[m.text].cast("string")
    return F.transform(at[m.items], lambda x: turn(role(x), text(x)))


def canonical_turns(records: DataFrame, record: str = "record", mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` (role, text) instead of their struct column ``record``.

    A record whose fingerprint no mapping takes keeps its row, with null layout
    and turns. Null roles and texts inside a list are empty. Other columns stay.
    """
    kind = records.schema[record].dataType
    has = set(_paths(kind))
    usable = [m for m in mappings if set(m.needs) <= has and all(p in has for _, p in m.turns if p in m.needs)]
    usable = [Mapping(m.layout, m.needs, tuple(p for p in m.may if p in has), tuple(x for x in m.turns if x[1] in has), m.items, m.role, m.text, m.parts, m.names) for m in usable]
    usable = [m for m in usable if m.turns or {f"{m.items}[].{m.role}", f"{m.items}[].{m.text}" + ("[]" if m.parts else "")} <= has]
    marked = records.withColumn("fingerprint", schema_fingerprint(record, kind))
    layout = turns = F.lit(None)
    for m in usable:
        layout = F.when(F.col("fingerprint").isin(fingerprints(m)), m.layout).otherwise(layout)
        turns = F.when(F.col("layout") == m.layout, _turns(m, record)).otherwise(turns)
    empty = F.lit(None).cast("array<struct<role:string,text:string>>")
    found = marked.withColumn("layout", layout.cast("string"))
    return found.withColumn("turns", turns if usable else empty).drop(record)


def escaped(c: Column) -> Column:
    """Text without control strings: each "<", some backslashes, "|" gets one backslash more."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role(c: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unrole(c: Column) -> Column:
    return F.replace(F.replace(unescaped(c), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_turns(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conversations`` with ``formatted``, one text of all ``turns``, and ``loss``, its mask.

    The mask has an entry (before, take, after) a turn, in code points: what
    comes before the trained part, the trained part, and the rest. The trained
    part is the text of turns of the roles ``trained``. A conversation is one
    training text, so it is one value; null turns stay null, no turns give an
    empty text.
    """
    text = lambda t: F.struct(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), t["role"].isin(*trained).alias("train"))
    tail = f"{END}\n"
    marked = conversations.withColumn("_marked", F.transform("turns", text))
    sizes = lambda m: F.struct(
        (F.length(m["head"]) + F.when(m["train"], 0).otherwise(F.length(m["body"]))).alias("before"),
        F.when(m["train"], F.length(m["body"])).otherwise(0).alias("take"),
        F.lit(len(tail)).alias("after"),
    )
    whole = F.array_join(F.transform("_marked", lambda m: F.concat(m["head"], m["body"], F.lit(tail))), "")
    return marked.withColumn("formatted", whole).withColumn("loss", F.transform("_marked", sizes)).drop("_marked")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` (formatted, loss) with ``turns`` (role, text) and ``trained``, the unescaped text under the mask, both read from the text and mask alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    cut = formatted.withColumn("_parts", F.slice(parts, F.lit(1), F.size(parts) - 1))
    first = F.lit(len(START) + 1)
    turn = lambda p: F.struct(
        _unrole(F.substr(F.substring_index(p, "\n", 1), first)).alias("role"),
        unescaped(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text"),
    )
    masked = F.zip_with("_parts", "loss", lambda p, m: unescaped(F.substr(p, m["before"] + 1, m["take"])))
    return cut.withColumn("turns", F.transform("_parts", turn)).withColumn("trained", F.array_join(masked, "")).drop("_parts")


def oracle() -> str:
    """The digests of ``conversations`` and conversation -1 as DuckDB SQL."""
    odd = f"'{END}{START}assistant ok'"
    esc = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
    role = esc.format(r"replace(replace(role, '\', '\b'), chr(10), '\n')")
    return rf"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', {odd} union all select -1, 1, 'assistant', {odd})
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(START) + len(END) + 2} + length({role}) + length({esc.format("text")}))::bigint as formatted_chars
from rows group by conv_id
"""
