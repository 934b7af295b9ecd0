"""Reference lists of both styles, and lines that are none."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import references as R


def parse(spark, *lists):
    df = spark.createDataFrame([(i, label, text, 7) for i, (label, text) in enumerate(lists)], "work_id long, label string, text string, year int")
    out = {i: [] for i in range(len(lists))}
    for r in R.references(df).orderBy("work_id", "ordinal").collect():
        out[r.work_id].append(r)
    return out


def test_numbered_and_named(spark):
    numbered = "## References\n[1] A. Smith, B. Jones. A fine title here. Journal, 2001. doi:10.1000/AB.1.\n   continued line\n[2] C. Brown. Another title. Venue, 2003.\n12\n[3] D. Green. Third title of all. arXiv:2101.00001v2, 2021."
    named = "Smith, J. (1999). On things. Press.\nDoe, A. (2005). On more things.\n  and their ends. Press.\n———. (2006). Again. Press."
    got = parse(spark, ("References", numbered), ("Bibliography", named))
    assert [r.author for r in got[0]] == ["Smith", "Brown", "Green"] and [r.year for r in got[0]] == [2001, 2003, 2021]
    assert [r.title for r in got[0]] == ["A fine title here", "Another title", "Third title of all"]
    assert got[0][0].doi == "10.1000/ab.1" and got[0][2].arxiv == "2101.00001" and "continued line" in got[0][0].raw
    assert [r.author for r in got[1]] == ["Smith", "Doe", "Doe"] and got[1][2].continued and got[1][1].title == "On more things"


def test_a_line_of_several_entries_is_cut_in_plain_lists_only(spark):
    text = "Smith, J. (1999). One. Press. Doe, A. (2005). Two. Press. Roe, B. 2006. Three."
    got = parse(spark, ("References", text), ("Rejoinder References", text), ("References", "[1] I. Smith. One. X, 1999.\n[2] J. Doe. Two. Venue, 2000. Roe, B. says so.\n[3] K. Roe. Three. Y, 2001."))
    assert [r.author for r in got[0]] == ["Smith", "Doe", "Roe"]
    assert len(got[1]) == 1 and len(got[2]) == 3


def test_surnames_without_a_year_go_on_with_the_entry(spark):
    got = parse(spark, ("References", "Smith, J.,\nDoe, A., and\nRoe, B. (1999). One. Press.\nand more\nZed, C. (2001). Two."))
    assert [r.raw for r in got[0]][-1] == "Zed, C. (2001). Two."
    assert not any(r.raw == "Doe, A., and" for r in got[0])


def test_few_numbers_are_trusted_in_a_list_of_its_own_kind(spark):
    text = "some words before\n(7) I. Smith. One. X, 1999.\n(8) J. Doe. Two. Y, 2000."
    got = parse(spark, ("References in Discussion", text), ("References", text))
    assert [r.raw[:3] for r in got[0]] == ["(7)", "(8)"]
    assert [r.raw for r in got[1]][0] == "some words before"


def test_no_year_gives_no_title_and_no_author_before_a_dash_stays_null(spark):
    got = parse(spark, ("References", "———. (2006). Again. Press."), ("References", None), ("References", ""), (None, "Smith, J. (1999). One."))
    assert got[0][0].author is None and not got[0][0].continued and got[0][0].title == "Again"
    assert got[1] == got[2] == [] and len(got[3]) == 1


LINES = {
    "# Heading": True, "12": True, "12345": False, "Downloaded from X": True, "This content downloaded from Y on": True, "All use subject to JSTOR terms": True, "[No. 3": True, "Vol. 12, 1999": True, "DISCUSSION OF THE PAPER": True,
    "https://x.org/a": True, "https://doi.org/10.1/x": False, "http://dx.doi.org/10.1/x": False, "RICHARDSON AND GREEN": True, "SMITH, JONES": True, "SMITH, 1999": False, "THE TITLE": False, "Smith, J. (1999)": False,
}


def test_debris(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    assert {r.line: r.d for r in df.select("line", R.is_debris("line").alias("d")).collect()} == LINES


@pytest.mark.parametrize(
    "line,clean",
    [
        ('<span id="a"></span>- **[Title](http://x.org/a(1)b)**, 1999', "Title, 1999"),
        ("[CrossRef](https://doi.org/10.1234/xy.z)", "CrossRef 10.1234/xy.z"),
        ("text [1, 2](#page-1) more", "text more"),
        ("pp. 10�12 na�ve a_b", "pp. 10-12 na�ve a_b"),
        ("$HORROCKS, Combridge", "Shorrocks, Cambridge"),
        ("[3] A. Smith", "[3] A. Smith"),
    ],
)
def test_clean_lines(spark, line, clean):
    assert spark.range(1).select(R.clean_line(F.lit(line))).first()[0] == clean


def test_fallback_ranges(spark):
    texts = ["a\n**References**\nx\ny\n__7. Bibliography__:\nz", "a\nReferences\nb\nWorks Cited:\nc", "see the references\nno", "*References*\nReferences\nx", None, "**References**"]
    df = spark.createDataFrame(list(enumerate(texts)), "work_id long, text string")
    got = sorted((r.work_id, r.label, r.text) for r in R.fallback_ranges(df).collect())
    assert got == [(0, "Bibliography", "z"), (0, "References", "x\ny"), (1, "References", "b"), (1, "Works Cited", "c"), (3, "References", "References\nx"), (5, "References", "")]


def test_lists_are_read_once_and_their_kind_told_once_a_range(spark):
    read = spark.sparkContext.accumulator(0)
    text = "[1] I. Smith. One. X, 1999.\n[2] J. Doe. Two. Y, 2000.\nmore of it.\n[3] K. Roe. Three. Z, 2001."

    def seen(r):
        read.add(1)
        return r

    lists = [(i, "References" if i % 2 else "Rejoinder References", text if i < 8 else "[1] I. Smith. One. X, 1999. Doe, J. 2000. Two.") for i in range(10)]
    ranges = spark.createDataFrame(spark.sparkContext.parallelize(lists, 2).map(seen), "work_id long, label string, text string")
    got = R.entries(ranges)
    rows = got.collect()
    assert read.value == len(lists)
    assert [sum(r.work_id == i for r in rows) for i in range(10)] == [3] * 8 + [1, 2]
    assert {r.raw for r in rows if r.work_id == 0} == {"[1] I. Smith. One. X, 1999.", "[2] J. Doe. Two. Y, 2000. more of it.", "[3] K. Roe. Three. Z, 2001."}


def test_with_enumerated_tells_what_monotone_runs_tells(spark):
    from corpusloom.operators.windows import monotone_runs, with_enumerated

    runs = {1: [1, 2, 3, None], 2: [3, 2, 1], 3: [None, 5, None, 6, 6, 7, 8, 9, 10], 4: [1, 2], 5: [None, None], 6: [1, 3, 2, 4, 5, 6], 7: [1, 1, 1, 2]}
    df = spark.createDataFrame([(k, i, n) for k, ns in runs.items() for i, n in enumerate(ns)], "k long, line int, n int")
    want = {r.k: r.enumerated for r in monotone_runs(df, ["k"], "line", "n").collect()}
    got = {(r.k, r.enumerated) for r in with_enumerated(df, ["k"], "line", "n").collect()}
    assert got == {(k, want.get(k, False)) for k in runs} and {True, False} == set(want.values())
