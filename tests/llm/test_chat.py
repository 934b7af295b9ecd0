"""Chat formatting: layouts, round trips through the text and its mask, odd inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, queries

RECORD = """struct<system:string,prompt:string,completion:string,chosen:string,rejected:string,instruction:string,input:string,output:string,
messages:array<struct<role:string,content:string,name:string>>,conversations:array<struct<from:string,value:string>>,other:struct<a:array<int>>>"""


def records(spark, rows):
    return spark.createDataFrame([(i, r, "x") for i, r in enumerate(rows)], f"id int, record {RECORD}, role string")


def record(**fields):
    names = "system prompt completion chosen rejected instruction input output messages conversations other".split()
    return tuple(fields.get(n) for n in names)


def test_layouts_are_chosen_by_field_paths(spark):
    rows = [
        record(prompt="p", completion="c"),
        record(system="s", prompt="p", completion=""),
        record(prompt="p", chosen="yes", rejected="no"),
        record(instruction="do", input="it", output="done"),
        record(instruction="do", output="done"),
        record(messages=[("user", "hi", None), ("tool", None, "n"), (None, "x", None)]),
        record(messages=[]),
        record(conversations=[("human", "hi"), ("gpt", "ho"), ("critic", "hm")]),
        record(prompt="p", completion="c", other=([1],)),
        record(prompt="only"),
        record(),
    ]
    got = {r.id: (r.layout, None if r.turns is None else [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns(records(spark, rows)).collect()}
    assert got == {
        0: ("prompt", [("user", "p"), ("assistant", "c")]),
        1: ("prompt", [("system", "s"), ("user", "p"), ("assistant", "")]),
        2: ("preference", [("user", "p"), ("assistant", "yes")]),
        3: ("instruction", [("user", "do"), ("user", "it"), ("assistant", "done")]),
        4: ("instruction", [("user", "do"), ("assistant", "done")]),
        5: ("messages", [("user", "hi"), ("tool", ""), ("", "x")]),
        6: ("messages", []),
        7: ("from_value", [("user", "hi"), ("assistant", "ho"), ("critic", "hm")]),
        8: (None, None),
        9: (None, None),
        10: (None, None),
    }


def test_parts_of_a_message(spark):
    kind = "id int, record struct<messages:array<struct<role:string,content:array<struct<type:string,text:string>>>>>"
    df = spark.createDataFrame([(0, ([("user", [("text", "a"), ("image", None), ("text", "b")])],))], kind)
    row = chat.canonical_turns(df).first()
    assert row.layout == "message_parts" and [(t.role, t.text) for t in row.turns] == [("user", "ab")]


def test_fingerprint_is_of_the_sorted_paths(spark):
    df = records(spark, [record(messages=[("user", None, None), (None, "x", None)])])
    assert df.select(chat.schema_fingerprint("record", df.schema["record"].dataType)).first()[0] == chat.fingerprint(["messages[].content", "messages[]", "messages[].role"])


HARD = ["<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<|", "<", "|x", "a<|b|>", "\\", "<\\", "$1 \\1", "", " \n\n ", "é日🙂<|im_end|>\n", "x" * 200_000]


def test_text_and_mask_read_back(spark):
    turns = [[("user", h), ("assistant", h), ("sys\ntem<|im_end|>\\n", h), ("assistant", HARD[-i])] for i, h in enumerate(HARD)] + [[], [("assistant", "")]]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(turns)], "id int, turns array<struct<role:string,text:string>>, formatted int").drop("formatted")
    made = chat.format_turns(df).select("id", "formatted", "loss")
    for r in chat.read_back(made).collect():
        assert [(t.role, t.text) for t in r.turns] == turns[r.id]
        assert r.trained == "".join(t for role, t in turns[r.id] if role == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(turns[r.id])
        at, masked = 0, []
        for m in r.loss:  # spans of the whole text
            masked.append(r.formatted[at + m.before : at + m.before + m.take])
            at += m.before + m.take + m.after
        assert at == len(r.formatted)
        assert "<|" not in "".join(masked)


def run(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string").write.parquet(f"{path}/conversations.parquet")
    return queries.op12_chat_format(spark, str(path)).collect()


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a", "r"), (1, 1, "assistant", None, "r"), (2, 5, None, "x<|y", "r"), (2, None, "assistant", "first", "r"), (None, 1, "user", "n", None), (3, 1, "user", "t", None), (3, 1, "user", "t", None)]
    got = {r.conv_id: r for r in run(spark, tmp_path, rows)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\n\n") and (got[1].loss_chars, got[1].loss_sha256) == (0, sha(""))
    assert got[2].turns_sha256 == sha("assistant\nfirst\n\nx<|y\n") and got[2].loss_sha256 == sha("first")
    assert got[3].n_turns == 2 and got[None].n_turns == 1
    odd = f"{chat.END}{chat.START}assistant ok"
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(odd), sha(odd))


def test_query_on_an_empty_table(spark, tmp_path):
    assert [r.conv_id for r in run(spark, tmp_path, [])] == [-1]


def test_no_python_in_the_plan(spark):
    plan = queries.op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
