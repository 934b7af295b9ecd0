"""Queries of bibliographies. The tables have none, so each query writes lists from rows and reads them back; the SQL gives the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import references as R
from corpusloom.registry import Tables, query

_NAME = "case o_orderstatus when 'F' then 'Fulfilled' when 'O' then 'O’Pending' else 'Partly-Done' end"
_TITLE = "'On the order K' || o_orderkey || ' and its parts'"
_CITED = f"""cited as (select o_custkey as work_id, row_number() over (partition by o_custkey order by o_orderkey) as ordinal, {_NAME} as author, cast(year(o_orderdate) as int) as year, {_TITLE} as title,
  '10.1000/o.' || o_orderkey as doi, case when o_orderkey % 5 = 0 then '2101.' || lpad(cast(o_orderkey % 100000 as varchar(9)), 5, '0') end as arxiv,
  o_custkey % 3 as style, {_NAME} = lag({_NAME}) over (partition by o_custkey order by o_orderkey) as again from {{orders}})"""


def _lists(t: Tables) -> DataFrame:
    """(work_id, label, text): each customer's orders as a bibliography.

    By customer: surname and year, with several entries on a line, wrapped
    lines, page-break lines, and dashes for an author that comes again; numbers
    and initials, wrapped; or a list of its own kind that may be short.
    """
    rows = t.spark.sql(f"with {_CITED} select * from cited", orders=t.orders)
    venue = F.concat(F.lit("doi:"), "doi", F.coalesce(F.concat(F.lit(". arXiv "), "arxiv"), F.lit("")), F.lit("."))
    first = F.concat(F.when(F.col("again"), "———").otherwise(F.concat("author", F.lit(", I."))), F.lit(" ("), "year", F.lit("). "), "title")
    dated = F.concat(first, F.when(F.col("ordinal") % 3 == 0, ".\npp. 7 of Orders, ").otherwise(". Orders, "), venue)
    numbered = F.concat(F.lit("["), "ordinal", F.lit("] I. "), "author", F.lit(" and B. Other. "), "title", F.lit(". Some\nvenue, "), "year", F.lit(". "), venue)
    mark = F.when((F.col("style") == 0) & (F.col("ordinal") % 2 == 0) & ~F.coalesce("again", F.lit(False)), " ").when((F.col("style") == 0) & (F.col("ordinal") % 4 == 1), "\nDownloaded from a library\n213\nORDERS AND PARTS\n").otherwise("\n")
    line = F.struct("ordinal", F.concat(mark, F.when(F.col("style") == 0, dated).otherwise(numbered)).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["x"]), "")
    label = F.when(F.col("style") == 2, "Rejoinder References").otherwise("**6. References:**")
    return rows.groupBy("work_id", "style").agg(text.alias("text")).select("work_id", label.alias("label"), F.concat(F.lit("## References\n"), "text").alias("text"))


@query(f"""with {_CITED} select work_id, ordinal::int as ordinal, author, year, title, doi, arxiv, coalesce(style = 0 and again, false) as continued from cited""")
def c7_references(t: Tables) -> DataFrame:
    got = R.references(_lists(t))
    return got.select("work_id", "ordinal", "author", "year", "title", "doi", "arxiv", "continued")


@query("""select s_suppkey as work_id, case s_suppkey % 4 when 0 then 'References' when 1 then 'BIBLIOGRAPHY' when 2 then 'Works cited' end as label, '' || chr(10) || s_name || ', 1999.' || chr(10) || s_acctbal as text from {supplier} where s_suppkey % 4 <> 3
union all select s_suppkey, 'Literature Cited', s_nationkey from {supplier} where s_suppkey % 4 = 1""")
def c8_fallback_ranges(t: Tables) -> DataFrame:
    """Lists after a title line in bold or alone; titles inside a sentence, and bare ones beside bold ones, open none."""
    cue = F.when(F.col("s_suppkey") % 4 == 0, '<span id="p"></span>**7. References**:').when(F.col("s_suppkey") % 4 == 1, "*BIBLIOGRAPHY*").when(F.col("s_suppkey") % 4 == 2, "  Works cited:").otherwise("See the references below")
    more = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("\n__Literature Cited__\n"), "s_nationkey")).otherwise("")
    text = F.concat(F.lit("Intro\n"), F.when(F.col("s_suppkey") % 4 == 0, "References\n").otherwise("no references\n"), cue, F.lit("\n\n"), "s_name", F.lit(", 1999.\n"), "s_acctbal", more)
    return R.fallback_ranges(t.supplier.select(F.col("s_suppkey").alias("work_id"), text.alias("text")))


@query("select c_custkey, c_custkey % 5 > 1 as sublist from {customer}")
def c9_sublists(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    label = F.when(k % 5 == 0, "**3) Works   Cited:**").when(k % 5 == 1, '<span id="x"></span>References and Notes').when(k % 5 == 2, F.concat(F.lit("References in Discussion by "), "c_name")).when(k % 5 == 3, "Rejoinder References").otherwise("Sources")
    return t.customer.select("c_custkey", R.is_sublist(label).alias("sublist"))


@query("""select p_partkey, p_name || ' by Shorrocks, pp. ' || p_size || '-' || (p_size + 9) || '.' || case when p_partkey % 2 = 0 then ' CrossRef 10.1000/p.' || p_partkey else ' a_b' end as line, p_partkey % 4 = 3 as debris from {part}""")
def f14_reference_lines(t: Tables) -> DataFrame:
    """Lines with the marks that converted pages have, and debris of page breaks."""
    k = F.col("p_partkey")
    link = F.when(k % 2 == 0, F.concat(F.lit(" [CrossRef](https://doi.org/10.1000/p."), k, F.lit(")"))).otherwise(" a_b")
    line = F.concat(F.lit('- <span id="page-1"></span>**['), "p_name", F.lit("](http://x.org/a(2)b)** by $HORROCKS, pp. "), "p_size", F.lit("�"), F.col("p_size") + 9, F.lit(".[1, 2](#page-3)"), link)
    junk = F.when(k % 16 == 3, "Downloaded from somewhere").when(k % 16 == 7, "[Vol. 12, No. 3]").when(k % 16 == 11, "https://www.jstor.org/stable/1").otherwise("PARTS AND SIZES")
    rows = t.part.select("p_partkey", F.explode(F.array(R.clean_line(line))).alias("line"), junk.alias("junk"))
    return rows.select("p_partkey", "line", R.is_debris(F.when(k % 4 == 3, F.col("junk")).otherwise(F.col("line"))).alias("debris"))


@query("""select o_orderkey, case o_orderkey % 4 when 3 then null else 'Writer' end as author, case o_orderkey % 4 when 3 then null else cast(year(o_orderdate) as int) end as year,
  case o_orderkey % 4 when 3 then null else 'Title of order K' || o_orderkey end as title, case o_orderkey % 4 when 0 then '10.1000/a(' || o_orderkey when 2 then '10.1000/b.' || o_orderkey end as doi, case o_orderkey % 4 when 1 then 'math.st/0101001' end as arxiv from {orders}""")
def f13_entry_fields(t: Tables) -> DataFrame:
    """Fields of single entries of each style: surname first, initials first with a title in quotes, or before the venue, and one without a year."""
    k, year, title = F.col("o_orderkey"), F.year("o_orderdate"), F.concat(F.lit("Title of order K"), "o_orderkey")
    entry = (
        F.when(k % 4 == 0, F.concat(F.lit("Writer, A. ("), year, F.lit("). “"), title, F.lit(". Orders 3.” https://doi.org/10.1000/A("), k, F.lit(").")))
        .when(k % 4 == 1, F.concat(F.lit("[12] A.-B. Writer, C. Other, “"), title, F.lit(",” arXiv: math.ST/0101001v2, "), year))
        .when(k % 4 == 2, F.concat(F.lit("7. A. Writer and C. Other. "), title, F.lit(". In Orders, "), year, F.lit(". doi: 10.1000/b."), k, F.lit(".")))
        .otherwise(F.concat(F.lit("nobody wrote of order K"), k))
    )
    rows = t.orders.select("o_orderkey", F.explode(F.array(entry)).alias("entry"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in R.fields(F.col("entry")).items() if n != "continued"])
