"""Queries of the T family: streams over the event files, drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators.kept import Kept
from corpusloom.operators.textindex import kept_index
from corpusloom.operators.windows import line_rows
from corpusloom.plans import corpus, retrieval  # noqa: F401  their SQL is the same
from corpusloom.plans.lineage import shared_dir
from corpusloom.registry import Tables, query
from corpusloom.streaming import events as E
from corpusloom.streaming import state as T


def _stream(t: Tables) -> DataFrame:
    table = t.events
    return E.tail(t.spark, f"{t.sf_dir}/event[s].parquet", table.schema)


def _runs(t: Tables) -> DataFrame:
    return _stream(t).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"))


@query("select event_id, user_id, event_type from {events} where event_id > 9000 or event_id % 10 = 0")
def t1_tail(t: Tables) -> DataFrame:
    return E.drained(_stream(t).where("event_id > 9000 or event_id % 10 = 0").select("event_id", "user_id", "event_type"), "append")


@query("select run_id, seq, case event when 'purchase' then 'completed' when 'click' then 'failed' else 'running' end as status from (select user_id as run_id, max(event_id) over (partition by user_id) as seq, event_type as event, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {events}) x where r = 1")
def t2_live_status(t: Tables) -> DataFrame:
    return E.drained(T.live_status(_runs(t), "400 days", 86_400), "update", ["run_id"])


@query("""with last as (select user_id, max(ts) as m, arg_max(event_type, (ts, event_id)) as e, count(*) as n from {events} group by 1)
select user_id as run_id, m::timestamp as silent_from, n as events from last where e not in ('purchase', 'click') and m + interval 6 hours <= (select max(ts) - interval 1 hour from {events})""")
def t3_interrupted(t: Tables) -> DataFrame:
    """Runs silent for six hours at the watermark, an hour behind the newest event."""
    return E.drained(T.interrupted(_runs(t), "1 hour", 6 * 3600), "append")


@query("select date_trunc('day', ts)::timestamp as day, user_id % 4 as provider, round(sum(coalesce(value, 0)), 4) as spend, sum(coalesce(value, 0)) >= 2000 as stopped from {events} group by 1, 2")
def t4_daily_spend(t: Tables) -> DataFrame:
    usage = _stream(t).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("provider"), F.col("value").alias("cost"))
    return E.drained(E.daily_spend(usage, 2000.0, "400 days"), "update", ["day", "provider"])


@query("""select event_id, day, provider, round(running, 4) as running, coalesce(max(running) over (partition by day, provider order by ts, event_id rows between unbounded preceding and 1 preceding), 0) >= 2000 as stopped
from (select event_id, ts, date_trunc('day', ts)::timestamp as day, user_id % 4 as provider, sum(coalesce(value, 0)) over (partition by date_trunc('day', ts), user_id % 4 order by ts, event_id rows unbounded preceding) as running from {events}) x""")
def t4_spend_latch(t: Tables) -> DataFrame:
    usage = _stream(t).select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("provider"), F.col("value").alias("cost"))
    return E.drained(T.latched_spend(usage, 2000.0, "400 days"), "append").withColumn("running", F.round("running", 4))


@query()
def t5_fresh_responses(t: Tables) -> DataFrame:
    cache = _stream(t).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return E.drained(E.fresh_responses(cache, ["user_id", "event_type"], "365 days").select("user_id", "event_type"), "append")


@query("select user_id as run_id, date_trunc('day', ts)::timestamp as day, event_type as event, count(*) as n from {events} group by 1, 2, 3")
def t7_step_counts(t: Tables) -> DataFrame:
    return E.drained(E.step_counts(_runs(t), "400 days"), "update", ["run_id", "day", "event"])


@query("select doc_id, line, start, start + length(body) as \"end\" from (select doc_id, line, body, coalesce(sum(length(body) + 1) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as start from (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from {documents}) l) o where trim(body) <> ''")
def t6_incremental_spans(t: Tables) -> DataFrame:
    """Line spans kept up to date by foreachBatch, then read back."""
    build = lambda df: line_rows(df, "doc_id", "text").where("trim(body) <> ''").select("doc_id", "line", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    kept = Kept(f"{shared_dir(t.spark)}/kept-{uuid.uuid4().hex}", "doc_id", "text", {"lines": build})
    docs = t.documents.select("doc_id", "text")
    return _redone(t, kept, docs).read(docs, "lines").drop("bucket")


def _redone(t: Tables, kept: Kept, docs: DataFrame) -> Kept:
    """Kept tables after two streams of documents: drafts of a third of them, then all as they are."""
    base = f"{shared_dir(t.spark)}/arriving-{uuid.uuid4().hex}"
    drafts = docs.where(F.pmod(F.col(kept.key), F.lit(3)) == 0).withColumn(kept.text, F.concat(F.lit("# Draft\n\nof "), F.col(kept.text)))
    for i, rows in enumerate((drafts, docs)):
        rows.write.parquet(f"{base}/{i}")
        stream = t.spark.readStream.schema(docs.schema).parquet(f"{base}/{i}")
        E.maintain(stream, kept, f"{base}/state{i}", first=1000 * i).awaitTermination()
    return kept


@query(like="c1_sections")
def t6_incremental_sections(t: Tables) -> DataFrame:
    """Sections kept up to date beside paragraph spans."""
    kept = Kept(f"{shared_dir(t.spark)}/kept-{uuid.uuid4().hex}", "work_id", "text", {"sections": C.sections, "spans": C.paragraph_spans})
    docs = t.v_docs
    return _redone(t, kept, docs).read(docs, "sections").drop("bucket")


@query(like="r1_postings")
def t6_incremental_index(t: Tables) -> DataFrame:
    """The inverted index kept up to date: its vocabulary of all buckets."""
    kept = kept_index(f"{shared_dir(t.spark)}/kept-{uuid.uuid4().hex}", "doc_id", "text")
    docs = t.documents.select("doc_id", "text")
    words = _redone(t, kept, docs).read(docs, "vocabulary")
    return words.groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.min("first").alias("first"))
