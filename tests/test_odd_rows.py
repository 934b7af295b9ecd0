"""Queries against their SQL on rows that the small tables lack."""

import duckdb
import pytest

from corpusloom import registry

LONG = "Of the word and that there is more to read here in this line of plain text, then more again. " * 4
TEXTS = [
    "\n\n", "\t \n", " a b ", "  ", "  abc", "", None, "x" * 9, "\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n\n12 abc", "$1 2 3 4 5 6 7 8 9 0 1 2 3 4$ 12 34", "\\alpha \\[ 1 2 3 \\] 4 5 6 7",
    "# Head\n\n## Part\n\nwords of a text\n\n# Bibliography", "See the REFERENCES here", "wordéreferences to all", "12345678 ab", LONG, "The " * 90, LONG + "\nThe" + " The" * 80, "Aié " * 70,
    "no no no no no", "say no no yes no no no no yes", "ab ab ab", "a b a b a b a",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(TEXTS + TEXTS[15:19] + TEXTS[15:19])], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "no"), (1, "no no"), (2, "ab"), (3, "a b a"), (4, "a b"), (5, "The The")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.range(2500).selectExpr("id as s_suppkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(4000).selectExpr("id div 4 as l_orderkey", "cast(id % 4 as int) as l_linenumber", "(id * 37 + id div 7) % 2500 as l_suppkey", "array('A', 'N', 'R')[cast(id % 3 as int)] as l_returnflag", "0.05d as l_discount", "timestamp '1995-01-01' + make_dt_interval(cast(id % 900 as int)) as l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["c10_quality_screen", "f22_text_quality", "e8_collapse_works", "p11_context", "r2_phrase_search"])
def test_odd_rows_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in ("documents", "benchmark", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, odd)
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]}) x").fetchall()
    assert got == sorted(map(repr, want))
