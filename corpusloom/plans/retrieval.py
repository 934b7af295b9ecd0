"""Queries of the R family: benchmark items as questions, documents as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import search as S
from corpusloom.operators.textindex import index_texts
from corpusloom.operators.windows import budget_prefix, dispositions
from corpusloom.plans.lineage import stored
from corpusloom.registry import Tables, query

_WORDS = "list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\\pL\\pN]+'), lambda x: x <> '')"
_POST = f"""w as (select doc_id, {_WORDS.format(c="text")} as w from {{documents}}),
post as (select doc_id, len(w) as size, unnest(w) as token, generate_subscripts(w, 1) - 1 as pos from w)"""


_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9_-]*'), lambda x: length(x) >= {n} and x not in (" + _STOP + ")))"
_QUOTED = "list_filter(regexp_extract_all({c}, '\"([^\"]+)\"', 1), lambda x: trim(x) <> '')"


def _units(questions: str, name: str) -> str:
    """SQL of the units of the questions of a view, as ``name``_u (question, unit) and ``name``_w (unit, words)."""
    q, tok = _QUOTED.format(c="text"), _TOKENS.format(c="text", n=3)
    return f"""{name}_u as (select distinct question, unnest(case when len({q}) > 0 then {q} else {tok} end) as unit from {questions}),
{name}_w as (select unit, ' ' || array_to_string({_WORDS.format(c="unit")}, '  ') || ' ' as words from (select distinct unit from {name}_u) x)"""


def _score(docs: str, key: str, text: str, name: str) -> str:
    """SQL of bm25 scores of a table's texts, as ``name``_s (question, item_id, score), given ``name``_u and ``name``_w."""
    return f"""{name}_d as (select {key} as item_id, {_WORDS.format(c=text)} as w from {docs}), {name}_t as (select item_id, len(w) as size, ' ' || array_to_string(w, '  ') || ' ' as body from {name}_d where len(w) > 0),
{name}_tf as (select unit, item_id, size, (length(body) - length(replace(body, words, ''))) / length(words) as tf from {name}_t join {name}_w on length(words) > 2 and contains(body, words)),
{name}_df as (select unit, count(*) as df from {name}_tf group by 1), {name}_c as (select count(*) as docs, avg(size) as mean from {name}_t),
{name}_s as (select question, item_id, -sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) as score from {name}_tf join {name}_df using (unit) join {name}_u using (unit), {name}_c group by 1, 2)"""


def _phrases(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("question"), F.col("text").alias("phrase"))


@query(f"with {_POST} select token, count(*) as n, count(distinct doc_id) as df, min(pos) as first from post group by 1")
def r1_postings(t: Tables) -> DataFrame:
    return t.document_index().vocabulary.groupBy("token").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.min("first").alias("first"))


_PH = f"""p as (select item_id as question, ' ' || array_to_string({_WORDS.format(c="text")}, ' ') || ' ' as words from {{benchmark}}), body as (select doc_id, ' ' || array_to_string({_WORDS.format(c="text")}, ' ') || ' ' as body from {{documents}}),
ph as (select question, doc_id, ((length(body) - length(replace(body, words, ' '))) / (length(words) - 1))::bigint as hits from body join p on contains(body, words))"""


@query(f"with {_PH} select * from ph")
def r2_phrase_search(t: Tables) -> DataFrame:
    return S.phrase_hits(t.document_index(), _phrases(t))


@query(f"with {_units('{v_questions}', 'a')}, {_score('{documents}', 'doc_id', 'text', 'a')} select question, item_id as doc_id, round(score, 6) as score from a_s")
def r3_bm25(t: Tables) -> DataFrame:
    return S.bm25(t.document_index(), S.match_units(t.v_questions)).select("question", "doc_id", F.round("score", 6).alias("score"))


@query(f"with {_units('{v_questions}', 'a')} select question, unit from a_u")
def r4_match_units(t: Tables) -> DataFrame:
    return S.match_units(t.v_questions)


_PHQ = f"""{_units("{v_questions}", "a")}, {_score("{documents}", "doc_id", "text", "a")}, bm as (select question, item_id as doc_id, score from a_s), isp as (select question from {{v_questions}} where len({_QUOTED.format(c="text")}) > 0),
ph as (select question, doc_id, 1 as hits from bm join isp using (question))"""
_CAND = f"""cand as (select b.question, b.doc_id, b.score, coalesce(h.hits, 0) > 0 as phrase_hit, g.doc_id is not null as has_claim from bm b left join ph h using (question, doc_id) left join (select distinct doc_id from {{labels}}) g on g.doc_id = b.doc_id join {{v_works}} w on w.work_id = b.doc_id and w.status <> 'excluded'),
rk as (select question, doc_id, phrase_hit, round(greatest(0, -score) / (greatest(0, -score) + 1) + 0.05 + case when phrase_hit then 0.30 else 0 end + case when has_claim then 0.15 else 0 end, 9) as s from cand),
pl as (select *, row_number() over (partition by question order by s desc, doc_id) as place from rk)"""


def _ranked(t: Tables) -> DataFrame:
    """Documents that match a question, ranked. What a question with phrases finds holds one of them."""
    claims = t.labels.select("doc_id", F.lit(True).alias("claimed")).distinct()
    allowed = t.v_works.where("status <> 'excluded'").select(F.col("work_id").alias("doc_id"))
    with_phrase = t.v_questions.select("question", (F.size(S.quoted("text")) > 0).alias("phrase_hit"))
    rows = S.bm25(t.document_index(), S.match_units(t.v_questions)).join(allowed, "doc_id", "left_semi").join(claims, "doc_id", "left").join(with_phrase, "question")
    rows = rows.select("question", F.col("doc_id").alias("item_id"), F.lit("span").alias("kind"), F.col("score").alias("bm25"), "phrase_hit", F.coalesce("claimed", F.lit(False)).alias("has_claim"), F.lit(False).alias("claim_type_match"), F.lit(None).cast("double").alias("weight"))
    return S.rank_candidates(rows)


@query(f"with {_PHQ}, {_CAND} select question, doc_id as item_id, place, phrase_hit, round(s, 6) as rank_score from pl where place <= 10")
def r5_top_spans(t: Tables) -> DataFrame:
    return _ranked(t).where("place <= 10").select("question", "item_id", "place", "phrase_hit", F.round(F.round("rank_score", 9), 6).alias("rank_score"))


_CLAIMS = f"""{_units("{v_ask}", "q")}, cl as (select * from {{v_claims}} where access_class = 'open_access' and work_id % 10 <> 0), {_score("cl", "claim_id", "label", "q")},
claims as (select question, item_id, score from (select *, row_number() over (partition by question order by round(score, 9), item_id) as k from q_s) x where k <= 5)"""
_NOTES = f"""nt as (select note_id, text from (select *, row_number() over (partition by work_id, schema_id order by created_at desc, note_id desc) as k from {{v_note_texts}}) x where k = 1 and work_id % 10 <> 0), {_units("{v_ask}", "n")}, {_score("nt", "note_id", "text", "n")},
notes as (select question, item_id, score from (select *, row_number() over (partition by question order by round(score, 9), item_id) as k from n_s) x where k <= 5)"""
_LONG = "list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]*'), lambda x: length(x) >= 4 and x not in (" + _STOP + "))"
_LOOK = f"""tok as (select distinct question, unnest(list_concat(list_filter({_LONG}, lambda x, i: list_position({_LONG}, x) = i)[1:12], list_transform({_QUOTED.format(c="text")}, lambda x: lower(trim(x))))) as token from {{v_ask}}),
con as (select question, concept_id, count(*) as tokens from tok join (select distinct concept_id, label from {{v_claim_concepts}}) c on contains(lower(label), token) group by 1, 2)"""


def _claims(t: Tables) -> DataFrame:
    """Current claims that may be shown, of works that are not excluded: filtered before the limit."""
    shown = t.v_claims.where("access_class = 'open_access' and work_id % 10 <> 0")
    shown = stored(shown.select("claim_id", "label"), "claims")  # of a group by claim, and read twice
    return S.best_of_copies(shown, "claim_id", "label", S.match_units(t.v_ask), 5, "claim")


def _notes(t: Tables) -> DataFrame:
    from corpusloom.operators.rows import latest

    current = latest(t.v_note_texts, ["work_id", "schema_id"], "created_at", "note_id").where("work_id % 10 <> 0")
    return S.best_matches(index_texts(current, "note_id", "text"), S.match_units(t.v_ask), 5, "note")


def _concepts(t: Tables) -> DataFrame:
    from corpusloom.operators.joins import containing

    concepts = t.v_claim_concepts.select("concept_id", "label").distinct()
    tokens = t.v_ask.select("question", F.explode(S.concept_tokens("text")).alias("token")).distinct()
    return containing(concepts, "concept_id", "label", tokens, "token").groupBy("question", "concept_id").agg(F.count(F.lit(1)).alias("tokens"))


@query(f"with {_CLAIMS} select question, item_id as claim_id, label, span_id, epistemic_type, round(score, 6) as score from claims join {{v_claims}} on claim_id = item_id")
def r6_claims(t: Tables) -> DataFrame:
    return _claims(t).withColumnRenamed("item_id", "claim_id").join(t.v_claims, "claim_id").select("question", "claim_id", "label", "span_id", "epistemic_type", F.round("score", 6).alias("score"))


@query(f"with {_NOTES} select question, item_id as note_id, round(score, 6) as score from notes")
def r7_notes(t: Tables) -> DataFrame:
    return _notes(t).select("question", F.col("item_id").alias("note_id"), F.round("score", 6).alias("score"))


@query(f"with {_LOOK} select * from con")
def r8_concept_lookup(t: Tables) -> DataFrame:
    return _concepts(t)


@query(f"""with {_CLAIMS}, {_NOTES}, {_LOOK}, {_units("{v_ask}", "d")}, dd as (select doc_id, text from {{documents}} where doc_id % 10 <> 0), {_score("dd", "doc_id", "text", "d")},
sp as (select question, item_id, score from (select *, row_number() over (partition by question order by round(score, 9), item_id) as k from d_s) x where k <= 5),
hit as (select distinct question, claim_id from con join {{v_claim_concepts}} using (concept_id) where work_id % 10 <> 0),
every as (select question, item_id::varchar as item_id, 'span' as kind, 0 as b, round(score, 9) as s from sp union all select question, item_id, 'claim', 1, round(score, 9) from claims union all select question, claim_id, 'claim', 2, 0 from hit union all select question, item_id::varchar, 'note', 3, round(score, 9) from notes),
once as (select question, item_id, arg_min(kind, (b, s)) as kind, min((b, s)) as spot from every group by 1, 2)
select question, item_id, kind, place from (select *, row_number() over (partition by question order by spot, item_id) as place from once) x where place <= 20""")
def r9_merged(t: Tables) -> DataFrame:
    """Spans, claims, the claims of concepts, notes: each item once, the first twenty of a question."""
    spans = S.best_matches(t.document_index().where("doc_id % 10 <> 0"), S.match_units(t.v_ask), 5, "span")
    concepts = stored(_concepts(t), "concepts")
    claims = S.first_of_groups(t.v_claim_concepts.where("work_id % 10 <> 0").select("concept_id", "claim_id").join(concepts.select("concept_id").distinct(), "concept_id", "left_semi"), "concept_id", "claim_id", 20)
    hits = concepts.join(claims, "concept_id").select("question", F.col("claim_id").alias("item_id"), F.lit("claim").alias("kind"), F.lit(0.0).alias("score")).distinct()
    return S.merged_items([spans, _claims(t), hits, _notes(t)], 20)


@query(f"""with {_PHQ}, {_CAND}, seed as (select question, doc_id as work_id from pl where place <= 12), e as (select source, target from {{v_edges}} union select target, source from {{v_edges}}),
near as (select distinct question, target as work_id from seed join e on source = work_id)
select n.question, n.work_id, case when w.status = 'metadata_only' then 'metadata_only' else 'unavailable' end as status from near n left join {{v_works}} w using (work_id) where not exists (select 1 from seed s where s.question = n.question and s.work_id = n.work_id) and coalesce(w.status, '') not in ('included', 'excluded')""")
def r12_citation_search(t: Tables) -> DataFrame:
    e = t.v_edges.select("source", "target")
    both = e.union(e.select("target", "source")).distinct()
    works = t.v_works.select("work_id", "status")
    seeds = _ranked(t).where("place <= 12").select("question", F.col("item_id").alias("work_id"))
    return S.citation_search(seeds, both, works.where("status = 'included'"), works)


@query(f"with {_PHQ}, {_CAND} select question, count(*) as candidates, count(*) filter (phrase_hit) as with_phrase, round(max(s), 6) as top from pl group by 1")
def r10_rank_summary(t: Tables) -> DataFrame:
    return _ranked(t).groupBy("question").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("phrase_hit").alias("with_phrase"), F.round(F.round(F.max("rank_score"), 9), 6).alias("top"))


@query(f"with {_PHQ}, {_CAND}, s as (select p.question, p.doc_id as item_id, w.source, row_number() over (partition by p.question, w.source order by p.place) as k from pl p join {{v_works}} w on w.work_id = p.doc_id) select question, item_id, source from s where k <= 2")
def r11_per_work_partitions(t: Tables) -> DataFrame:
    from corpusloom.operators.rows import top_k_by

    src = t.v_works.select(F.col("work_id").alias("item_id"), "source")
    rows = _ranked(t).drop("place").join(src, "item_id")
    return top_k_by(rows, ["question", "source"], 2, F.desc(F.round("rank_score", 9)), F.asc("item_id")).select("question", "item_id", "source")


@query(f"""with {_PHQ}, {_CAND}, tk as (select p.question, p.doc_id, p.place, greatest(1, length(w.text) // 4) as tokens from pl p join {{v_works}} w on w.work_id = p.doc_id where place <= 40),
r as (select *, sum(tokens) over (partition by question order by place rows unbounded preceding) as running from tk) select question, doc_id as item_id, place, running::bigint as running from r where running <= 6000 or place = 1""")
def r13_pack_evidence(t: Tables) -> DataFrame:
    size = t.v_works.select(F.col("work_id").alias("item_id"), X.estimate_tokens("text").alias("tokens"))
    return budget_prefix(_ranked(t).where("place <= 40").withColumnRenamed("place", "p").join(size, "item_id"), ["question"], [F.asc("p")], "tokens", 6000).select("question", "item_id", "place", "running")


@query(f"with {_PHQ}, {_CAND}, m as (select question, max(s) as top from pl where phrase_hit group by 1) select item_id as question, case when coalesce(top, 0) <= 0 then 'abstain' when top < 0.15 then 'weak' else 'answer' end as outcome from {{benchmark}} left join m on question = item_id")
def r14_short_circuit(t: Tables) -> DataFrame:
    return S.short_circuit(_ranked(t).where("phrase_hit"), t.benchmark.select(F.col("item_id").alias("question")))


@query("""select e.user_id as answer, l.p as work_id, string_agg(distinct l.s::varchar, ',' order by l.s::varchar) as spans, any_value(b.dropped) as dropped from (select user_id, count(*) filter (event_id % 3 = 0) as dropped from {events} group by 1) b
left join (select user_id, event_id % 10 as p, event_id % 17 as s from {events} where event_id % 3 <> 0) l using (user_id) join (select distinct user_id from {events}) e using (user_id) group by 1, 2""")
def r15_citations(t: Tables) -> DataFrame:
    e = t.events
    markers = e.select(F.col("user_id").alias("answer"), F.col("event_id").alias("marker"))
    index = e.where("event_id % 3 <> 0").select(F.col("user_id").alias("answer"), F.col("event_id").alias("marker"), (F.col("event_id") % 10).alias("work_id"), (F.col("event_id") % 17).alias("span_id"))
    got = S.materialise_citations(markers, index)
    return got.select("answer", "work_id", F.array_join(F.array_sort(F.transform("spans", lambda x: x.cast("string"))), ",").alias("spans"), "dropped")


@query("""with c as (select distinct user_id as answer, event_id % 10 as work_id from {events}), ok as (select * from c where work_id % 2 = 0 and work_id <> 4)
select a.answer, count(ok.work_id) as cited, (select count(*) from c where c.answer = a.answer) - count(ok.work_id) as dropped, case when count(ok.work_id) >= 1 then 'supported' else 'insufficient_evidence' end as category from (select distinct user_id as answer from {events}) a left join ok using (answer) group by 1""")
def r16_guard(t: Tables) -> DataFrame:
    c = t.events.select(F.col("user_id").alias("answer"), (F.col("event_id") % 10).alias("work_id")).distinct()
    return S.guard_answers(c, c.where("work_id % 2 = 0"), t.spark.range(4, 5).withColumnRenamed("id", "work_id"), t.events.select(F.col("user_id").alias("answer")).distinct())


@query(f"""with {_PHQ}, {_CAND}, tk as (select p.question, p.doc_id, p.place, sum(greatest(1, length(w.text) // 4)) over (partition by question order by place rows unbounded preceding) as running from pl p join {{v_works}} w on w.work_id = p.doc_id)
select question, doc_id as item_id, place, case when place > 40 then 'cut_rank' when running <= 6000 or place = 1 then 'shown' else 'cut_budget' end as disposition from tk where place <= 60""")
def r17_trace(t: Tables) -> DataFrame:
    size = t.v_works.select(F.col("work_id").alias("item_id"), X.estimate_tokens("text").alias("tokens"))
    rows = _ranked(t).where("place <= 60").withColumnRenamed("place", "p").join(size, "item_id")  # later places change nothing before them
    return dispositions(rows, ["question"], [F.asc("p")], "tokens", 6000, 40).select("question", "item_id", "place", "disposition")


@query(f"with {_PHQ}, {_CAND} select question, doc_id % 7 as work, min(place) as place, string_agg(doc_id::varchar, ',' order by place) as spans from pl where place <= 12 group by 1, 2")
def r18_retrieval_answer(t: Tables) -> DataFrame:
    rows = _ranked(t).where("place <= 12").withColumn("work", F.col("item_id") % 7)
    got = rows.groupBy("question", "work").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "item_id"))).alias("s"))
    return got.select("question", "work", F.col("first").alias("place"), F.array_join(F.transform("s", lambda x: x["item_id"].cast("string")), ",").alias("spans"))
