"""Queries of the W family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import windows as N
from corpusloom.operators.rows import latest
from corpusloom.registry import Tables, query

_LATEST = "select {cols} from (select *, row_number() over (partition by {keys} order by {order}) as r from {src}) x where r = 1"


@query(_LATEST.format(cols="note_id, work_id, schema_id", keys="work_id, schema_id", order="created_at desc, note_id desc", src="{v_notes}"))
def w1_current_notes(t: Tables) -> DataFrame:
    return latest(t.v_notes, ["work_id", "schema_id"], "created_at", "note_id").select("note_id", "work_id", "schema_id")


@query(_LATEST.format(cols="run_id, event as lens_id, seq", keys="run_id, event", order="seq desc", src="{v_runs}"))
def w2_current_lens_runs(t: Tables) -> DataFrame:
    return latest(t.v_runs.select("run_id", "event", "seq"), ["run_id", "event"], "seq").withColumnRenamed("event", "lens_id")


@query(_LATEST.format(cols="user_id as source_file_id, event_id as markdown_id", keys="user_id", order="ts desc, event_id desc", src="(select * from {events} where event_type = 'purchase') e"))
def w3_current_markdown(t: Tables) -> DataFrame:
    return latest(t.events.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("source_file_id"), F.col("event_id").alias("markdown_id"))


@query(_LATEST.format(cols="note_id, work_id", keys="work_id", order="created_at desc, note_id desc", src="(select * from {v_notes} where schema_id = 'click' and note_id % 3 = 0) n"))
def w4_current_note_for_versions(t: Tables) -> DataFrame:
    return latest(t.v_notes.where("schema_id = 'click' and note_id % 3 = 0"), ["work_id"], "created_at", "note_id").select("note_id", "work_id")


@query("""with cur as (select user_id, max(event_id) % 5 as h from {events} group by 1) select event_id as lens_run, user_id as work_id from (select e.*, row_number() over (partition by e.user_id order by ts desc, event_id desc) as r from {events} e join cur c on c.user_id = e.user_id and e.event_id % 5 = c.h) x where r = 1""")
def w5_latest_fresh_lens_run(t: Tables) -> DataFrame:
    current = t.events.groupBy("user_id").agg((F.max("event_id") % 5).alias("h"))
    fresh = t.events.withColumn("h", F.col("event_id") % 5).join(current, ["user_id", "h"])
    return latest(fresh, ["user_id"], "ts", "event_id").select(F.col("event_id").alias("lens_run"), F.col("user_id").alias("work_id"))


@query("""select source, work_id, place, running::bigint as running from (select source, work_id, row_number() over (partition by source order by year desc, work_id) as place, sum(greatest(1, length(text) // 4)) over (partition by source order by year desc, work_id rows unbounded preceding) as running from {v_works}) x where running <= 6000 or place = 1""")
def w6_budget_prefix(t: Tables) -> DataFrame:
    w = t.v_works.withColumn("tokens", F.greatest(F.lit(1), F.expr("length(text) div 4")).cast("long"))
    return N.budget_prefix(w, ["source"], [F.desc("year"), F.asc("work_id")], "tokens", 6000).select("source", "work_id", "place", "running")


@query("""select source, work_id, place, case when place > 12 then 'cut_rank' when running <= 6000 or place = 1 then 'shown' else 'cut_budget' end as disposition from (select source, work_id, row_number() over (partition by source order by year desc, work_id) as place, sum(greatest(1, length(text) // 4)) over (partition by source order by year desc, work_id rows unbounded preceding) as running from {v_works}) x""")
def w7_dispositions(t: Tables) -> DataFrame:
    w = t.v_works.withColumn("tokens", F.greatest(F.lit(1), F.expr("length(text) div 4")).cast("long"))
    return N.dispositions(w, ["source"], [F.desc("year"), F.asc("work_id")], "tokens", 6000, 12).select("source", "work_id", "place", "disposition")


@query("""with r as (select event_id, ym, round(sum(coalesce(cost, 0)) over (partition by ym, provider order by ts, event_id rows unbounded preceding), 4) as running, coalesce(sum(coalesce(cost, 0)) over (partition by ym, provider order by ts, event_id rows between unbounded preceding and 1 preceding), 0) >= 5000 as stopped from {v_usage}) select * from r""")
def w8_spend_latch(t: Tables) -> DataFrame:
    got = N.spend_latch(t.v_usage, ["ym", "provider"], ["ts", "event_id"], "cost", 5000.0)
    return got.select("event_id", "ym", F.round("running", 4).alias("running"), "stopped")


_LINES = """lines as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from {documents}),
offs as (select doc_id, line, body, coalesce(sum(length(body) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as start from lines)"""


@query(f"with {_LINES} select doc_id, line, start, start + length(body) as \"end\" from offs")
def w9_line_offsets(t: Tables) -> DataFrame:
    return N.line_rows(t.documents, "doc_id", "text").select("doc_id", "line", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""with {_LINES}, i as (select *, sum((length(body) < 20)::int) over (partition by doc_id order by line rows unbounded preceding) as island from offs)
select doc_id, island::bigint as island, count(*) as lines, min(start) as start from i group by 1, 2""")
def w10_islands(t: Tables) -> DataFrame:
    lines = N.line_rows(t.documents, "doc_id", "text")
    return N.islands(lines, ["doc_id"], "line", F.length("body") < 20).groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("lines"), F.min("start").cast("long").alias("start"))


@query(f"""with {_LINES} select doc_id, line, last_value(case when length(body) >= 60 then substr(body, 1, 8) end ignore nulls) over (partition by doc_id order by line rows unbounded preceding) as author from offs""")
def w11_carry_forward(t: Tables) -> DataFrame:
    lines = N.line_rows(t.documents, "doc_id", "text")
    return N.carry(lines, ["doc_id"], "line", F.when(F.length("body") >= 60, F.substring("body", 1, 8)), "author").select("doc_id", "line", "author")


@query(f"""with {_LINES}, s as (select doc_id, line, length(body) as n, case when lag(length(body)) over (partition by doc_id order by line) is null then null else (length(body) > lag(length(body)) over (partition by doc_id order by line))::int::double end as up from offs)
select doc_id, count(*) as numbers, round(coalesce(avg(up), 0), 6) as upward, count(*) >= 3 and coalesce(avg(up), 0) >= 0.8 as enumerated from s group by 1""")
def w12_monotone_runs(t: Tables) -> DataFrame:
    lines = N.line_rows(t.documents, "doc_id", "text").withColumn("n", F.length("body"))
    return N.monotone_runs(lines, ["doc_id"], "line", "n")


@query("""with h as (select conv_id, turn, 1 + (turn * 7 + conv_id) % 4 as level from {conversations}) select h.conv_id, h.turn, (select max(p.turn) from h p where p.conv_id = h.conv_id and p.turn < h.turn and p.level < h.level) as parent from h""")
def w13_heading_parent(t: Tables) -> DataFrame:
    h = t.conversations.select("conv_id", "turn", (1 + (F.col("turn") * 7 + F.col("conv_id")) % 4).alias("level"))
    return N.outline(h, "conv_id", "turn", "level").select("conv_id", "turn", "parent")


@query("select run_id, case when event in ('purchase') then 'completed' when event = 'click' then 'failed' else 'running' end as status from (select run_id, event, row_number() over (partition by run_id order by seq desc) as r from {v_runs}) x where r = 1")
def w14_run_status(t: Tables) -> DataFrame:
    from corpusloom.streaming.state import status_of

    return latest(t.v_runs.select("run_id", "seq", "event"), ["run_id"], "seq").select("run_id", status_of("event").alias("status"))


@query("""with g as (select item_id, doc_id, row_number() over (partition by item_id order by doc_id) as place from {v_gold}) select item_id, count(*) as ranked, min(case when doc_id % 2 = 1 then place end) as first_relevant from g group by 1""")
def w15_first_relevant(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    g = t.v_gold.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy("doc_id")))
    return g.groupBy("item_id").agg(F.count(F.lit(1)).alias("ranked"), F.min(F.when(F.col("doc_id") % 2 == 1, F.col("place"))).alias("first_relevant"))
