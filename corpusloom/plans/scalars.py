"""Queries of the F family: scalar rules over table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.textindex import with_lists
from corpusloom.registry import Tables, query


@query("select work_id, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) as key, sha1(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g'))) as title_hash from {v_works}")
def f1_f2_title_key(t: Tables) -> DataFrame:
    return t.v_works.select("work_id", X.normalize_title("title").alias("key"), X.title_hash("title").alias("title_hash"))


_RAW = "case when doc_id % 4 = 0 then 'https://doi.org/10.1000/ABC' || doc_id when doc_id % 4 = 1 then 'doi:10.48550/arXiv.2101.' || (10000 + doc_id) || 'v2' end as doi, case when doc_id % 3 = 0 then 'arXiv:2101.' || (10000 + doc_id) || 'v3' when doc_id % 3 = 1 then ' ' end as arxiv, case when doc_id % 5 = 0 then 'https://openalex.org/w' || doc_id end as openalex"


@query(f"""with r as (select doc_id, {_RAW} from {{documents}}), n as (select doc_id, nullif(lower(regexp_replace(regexp_replace(trim(doi), '^(https?://)?(dx\\.)?doi\\.org/', '', 'i'), '^doi:', '', 'i')), '') as doi,
 nullif(regexp_replace(regexp_replace(trim(arxiv), '^arxiv:', '', 'i'), 'v[0-9]+$', ''), '') as arxiv, nullif(regexp_replace(regexp_replace(trim(openalex), '^(https?://)?openalex\\.org/', '', 'i'), '^w', 'W'), '') as openalex from r)
select doc_id, coalesce(case when doi not like '10.48550/arxiv.%' then 'doi:' || doi end, 'openalex:' || openalex, 'arxiv:' || coalesce(arxiv, case when doi like '10.48550/arxiv.%' then regexp_replace(substr(doi, 16), 'v[0-9]+$', '') end), '') as canonical,
 cast(doi is not null and doi not like '10.48550/arxiv.%' as int) + cast(openalex is not null as int) + cast(arxiv is not null or coalesce(doi like '10.48550/arxiv.%', false) as int) as ids from n""")
def f3_f5_strong_ids(t: Tables) -> DataFrame:
    ids = {"doi": "doi", "arxiv": "arxiv", "openalex": "openalex"}
    raw = t.spark.sql(f"select doc_id, {_RAW} from {{d}}", d=t.documents)
    return raw.select("doc_id", X.canonical_key(ids).alias("canonical"), F.size(X.strong_ids(ids)).alias("ids"))


@query("select distinct p_name, trim(regexp_replace(lower(p_name || ' (v' || p_partkey % 3 || ')'), '[^a-z0-9]+', ' ', 'g')) as merge_key from {part}")
def f6_merge_key(t: Tables) -> DataFrame:
    return t.part.select("p_name", X.merge_key(F.concat(F.col("p_name"), F.lit(" (v"), F.col("p_partkey") % 3, F.lit(")"))).alias("merge_key")).distinct()


@query("""with l as (select distinct p_type, p_name, list_distinct(string_split(p_name, ' ')) as t from {part})
select a.p_name as a, b.p_name as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as j from (select distinct p_name, t from l) a join (select distinct p_name, t from l) b on a.p_name < b.p_name and split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)""")
def f7_token_jaccard(t: Tables) -> DataFrame:
    n = t.part.select("p_name").distinct().withColumn("w", F.split("p_name", " ")[0])
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.p_name") < F.col("b.p_name"))).select(
        F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"), F.round(X.jaccard(X.tokens("a.p_name"), X.tokens("b.p_name")), 6).alias("j")
    )


@query("""select p_partkey, case p_partkey % 4 when 1 then not list_contains(string_split(p_name, ' '), 'large') when 2 then true else false end as conflict from {part}""")
def f8_discriminating(t: Tables) -> DataFrame:
    suffix = F.element_at(F.array(F.lit("same"), F.lit("large"), F.lit("v2"), F.lit("plain")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", X.discriminating_conflict(X.tokens(F.concat_ws(" ", "p_name", suffix)), X.tokens(F.concat_ws(" ", "p_name", F.lit("same")))).alias("conflict"))


@query("""select work_id, len(list_distinct(list_filter(regexp_extract_all(lower(title), '\\p{L}+'), lambda x: length(x) > 1 and x not in ('a','an','the','and','or','of','for','to','in','on','at','by','with','from','as','is','are','be','this','that','into','über','der','die','das','und','le','la','les','de','du'))))::int as n from {v_works}""")
def f9_content_tokens(t: Tables) -> DataFrame:
    return t.v_works.select("work_id", F.size(X.content_tokens("title")).alias("n"))


@query("select work_id, greatest(1, length(text) // 4)::bigint as tokens, round(greatest(1, length(text) // 4) * 3.0 / 1000000, 8)::double as cost from {v_works}")
def f21_tokens_and_cost(t: Tables) -> DataFrame:
    return t.v_works.select("work_id", X.estimate_tokens("text").alias("tokens"), F.round(X.estimate_tokens("text") * F.lit(3.0) / 1000000, 8).alias("cost"))


@query("""select doc_id, case when trim(text) = '' then 'empty' when length(trim(text)) < 8 then 'short' when 1 - length(regexp_replace(text, '[A-Za-z]{2,}', '', 'g')) / length(text) < 0.2 then 'noise' else 'ok' end as verdict from {documents}""")
def f22_text_quality(t: Tables) -> DataFrame:
    q = X.text_quality("text", markdown=False)
    return t.documents.select("doc_id", F.when(q["ok"], "ok").otherwise(q["notes"][0]).alias("verdict"))


@query("select c_custkey, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_mktsegment || ' ' || (1990 + c_custkey % 30) else c_custkey::varchar end as label from {customer}")
def f23_display_label(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(" ").alias("title"), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("A. "), F.col("c_mktsegment"))).alias("author"), (F.col("c_custkey") % 30 + 1990).alias("year"))
    return c.select("c_custkey", X.display_label("title", "author", "year", "c_custkey").alias("label"))


@query("select doc_id, array_to_string(string_split(text, ' '), ' ') as abstract from {documents}")
def f24_inverted_abstract(t: Tables) -> DataFrame:
    rows = with_lists(t.documents.select("doc_id", F.split("text", " ").alias("_w")).withColumn("some", F.col("_w").isNotNull()), "_w")
    return rows.select("doc_id", F.when(F.col("some"), F.map_from_entries("lists")).alias("m")).select("doc_id", X.inverted_abstract("m").alias("abstract"))


@query("select event_id, case when event_type in ('view', 'click') then event_type else 'other' end as kind from {events}")
def f25_vocabulary(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.one_of(F.concat(F.lit(" "), F.upper("event_type")), ["view", "click"], "other").alias("kind"))


_Q = """case item_id % 9 when 0 then 'Who cites the work on ' || text when 1 then 'What is meant by ' || text when 2 then 'Which OPEN QUESTION remains in ' || text when 3 then 'Compare "' || text || '" versus "x"'
when 4 then 'Compare ' || text when 5 then 'Under which Assumption holds ' || text when 6 then 'Show me where it says ' || text when 7 then 'Summarise ' || text else text end"""
_KIND = " ".join("when " + " or ".join("contains(q, '" + x.replace("'", "''") + "')" for x in cues) + (" then case when length(raw) - length(replace(raw, chr(34), '')) >= 4 then 'comparative' else 'factual' end" if kind == "comparative" else f" then '{kind}'") for kind, cues in X.QUESTION_CUES)


@query(f"select item_id, case {_KIND} else 'factual' end as kind from (select item_id, {_Q} as raw, lower(trim({_Q})) as q from {{benchmark}}) x")
def f26_question_type(t: Tables) -> DataFrame:
    q = t.spark.sql(f"select item_id, {_Q} as q from {{b}}", b=t.benchmark)
    return q.select("item_id", X.question_type("q").alias("kind"))


_PAIR = """select a.doc_id, a.title, b.title as found_title, case when a.doc_id % 7 = 0 then '10.1000/x' end as doi, case when a.doc_id % 5 = 0 then '2101.00001' end as arxiv,
case a.doc_id % 4 when 0 then '10.1093/ref:odnb/' || a.doc_id when 1 then '10.4135/978' when 2 then '10.1093/biomet/' || a.doc_id end as found_doi
from (select doc_id, split_part(text, chr(10), 1) as title from {documents}) a join (select doc_id, split_part(text, chr(10), 1) as title from {documents}) b on b.doc_id = a.doc_id - a.doc_id % 3"""
_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({c}), '\\p{{L}}+'), lambda x: length(x) > 1 and x not in (" + ", ".join(f"'{w}'" for w in X.OVERLAP_STOPWORDS) + ")))"


@query(f"""select doc_id, case when doi is null and doc_id % 4 in (0, 1) then 'refwork_doi_denylist' when doi is null and arxiv is null and least(len(a), len(b)) > 0 and len(list_intersect(a, b)) < case when least(len(a), len(b)) <= 2 then 1 else 2 end then 'low_title_overlap' end as reason,
round(least(0.9, 0.7 + 0.2 * case when len(a) = 0 or len(b) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end), 4) as confidence
from (select *, {_CONTENT.format(c="title")} as a, {_CONTENT.format(c="found_title")} as b from ({_PAIR}) p) x""")
def f10_f12_resolution_guards(t: Tables) -> DataFrame:
    pairs = t.spark.sql(_PAIR.replace("{documents}", "{d}"), d=t.documents)
    a, b = X.content_tokens("title"), X.content_tokens("found_title")
    share = F.when((F.size(a) > 0) & (F.size(b) > 0), X.jaccard(a, b)).otherwise(0.0)
    return pairs.select("doc_id", X.false_resolution("doi", "arxiv", "title", "found_doi", "found_title").alias("reason"), X.title_year_confidence(share).alias("confidence"))


_HEADS = """select doc_id, case doc_id % 4 when 0 then '# 12' || chr(10) || '# Title of ' || doc_id || '  ' when 1 then 'x' else '# A ' || doc_id end || chr(10) || case doc_id % 3 when 0 then 'see https://doi.org/10.1000/AB' || doc_id || '). ' when 1 then 'arXiv: 2101.' || (10000 + doc_id) || 'v2, ' else 'bare 2101.12345 ' end
|| case when doc_id % 5 = 0 then 'https://arxiv.org/abs/2202.' || (20000 + doc_id) || 'v1' else '' end || chr(10) || text || ' doi:10.5555/late' as text from {documents}"""


@query(f"""select doc_id, case when doc_id % 3 = 0 then '10.1000/ab' || doc_id when length(text) <= 2603 then substr('10.5555/late', 1, 2612 - length(text)) end as doi,
case when doc_id % 5 = 0 then '2202.' || (20000 + doc_id) when doc_id % 3 = 1 then '2101.' || (10000 + doc_id) end as arxiv, case doc_id % 4 when 1 then null when 0 then null else 'A ' || doc_id end as title
from ({_HEADS}) h""")
def f15_f16_own_identity(t: Tables) -> DataFrame:
    heads = t.spark.sql(_HEADS.replace("{documents}", "{d}"), d=t.documents)
    return heads.select("doc_id", X.own_identity("text").alias("o")).select("doc_id", "o.*")


@query("""select p_partkey, case when lower(p_type) = 'identification' then 'identification_assumption' when p_partkey % 3 = 0 then 'regularity_condition' else 'general_assumption' end as assumption, case when p_partkey % 2 = 0 then 'model' else 'method' end as method from {part}""")
def f28_claim_types(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, " Regularity ").otherwise(F.col("p_type")).alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Linear MODEL of "), "p_name")).alias("m"))
    return p.select("p_partkey", X.assumption_claim_type("a").alias("assumption"), X.method_claim_type("m").alias("method"))


@query("select event_id, round(value / (value + 1), 6)::double as score from {events}")
def f27_base_score(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(X.base_score(-F.col("value")), 6).alias("score"))


@query("select conv_id, turn, case when (conv_id + turn) % 5 = 0 then 'references' when (conv_id + turn) % 5 = 1 then 'abstract' when (conv_id + turn) % 5 = 2 then 'appendix' when (conv_id + turn) % 5 = 3 then 'acknowledgments' else 'body' end as kind from {conversations}")
def f17_section_kind(t: Tables) -> DataFrame:
    h = F.element_at(F.array(F.lit("6. **References**"), F.lit("*Abstract*"), F.lit("A.1 Appendix B"), F.lit("Acknowledgements"), F.lit("Notes on earlier references")), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", X.section_kind(h).alias("kind"))


@query("select doc_id, 'sec_' || substr(sha256(doc_id || '|' || source), 1, 16) as section_id, sha256(text) as quote_hash from {documents}")
def f18_f19_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.content_id("sec_", 16, F.col("doc_id"), F.col("source")).alias("section_id"), X.quote_hash("text").alias("quote_hash"))


@query("""with q as (select doc_id, text, substr(text, 5, 12) as q from {documents}) select doc_id, case when length(q) > 0 and instr(text, q) > 0 and instr(substr(text, instr(text, q) + 1), q) = 0 then instr(text, q) - 1 end as "offset" from q""")
def f20_unique_offset(t: Tables) -> DataFrame:
    d = t.documents.withColumn("q", F.substring("text", 5, 12))
    return d.select("doc_id", X.unique_offset(F.col("text"), F.col("q")).cast("long").alias("offset"))


@query("select p_partkey, p_name as shown from {part}")
def f31_clean_concept(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.concat(F.lit("concept:: "), F.regexp_replace("p_name", " ", "_"), F.lit("  ")).alias("c"))
    return named.select("p_partkey", X.clean_concept("c").alias("shown"))


@query("select p_partkey, 'https://doi.org/10.1/' || p_partkey as link, sha256('{\"a\":' || p_partkey || ',\"b\":\"' || p_name || '\"}') as print from {part}")
def f29_f32_links(t: Tables) -> DataFrame:
    p = t.part.withColumn("doi", F.concat(F.lit("10.1/"), F.col("p_partkey")))
    return p.select("p_partkey", X.link_out({"doi": "doi"})[0]["url"].alias("link"), X.fingerprint(b=F.col("p_name"), a=F.col("p_partkey")).alias("print"))


_LINKED = """select doc_id, case doc_id % 3 when 0 then '10.1000/a b&c(' || doc_id || ')*~' when 1 then ' ' end as doi, case when doc_id % 4 = 0 then '2101.' || (10000 + doc_id) end as arxiv, case doc_id % 5 when 0 then 'https://openalex.org/W' || doc_id when 1 then 'W' || doc_id end as openalex,
case when doc_id % 7 = 0 then 'abc' || doc_id end as s2, case when doc_id % 6 = 0 then doc_id end as ssrn, case when doc_id % 10 < 8 then substr(text, 1, 40) end as title, case doc_id % 3 when 1 then source || ', Ann' when 2 then 'Ann B. ' || source end as author, case when doc_id % 10 < 9 then 1990 + doc_id % 30 end as year, nullif(lang, 'en') as venue from {documents}"""


@query(f"""with l as ({_LINKED}), n as (select *, nullif(trim(doi), '') as d, trim(title) as t from l), q as (select *, case when d is not null then 'url_ver=Z39.88-2004&rfr_id=info%3Asid%2Flibrary.example&rft_id=' || replace(url_encode('info:doi/' || d), '%20', '+')
when t is not null or author is not null or year is not null or venue is not null then concat_ws('&', 'url_ver=Z39.88-2004', 'rfr_id=info%3Asid%2Flibrary.example', 'rft_val_fmt=info%3Aofi%2Ffmt%3Akev%3Amtx%3Ajournal', 'rft.genre=article', 'rft.atitle=' || replace(url_encode(nullif(t, '')), '%20', '+'), 'rft.aulast=' || replace(url_encode(source_name), '%20', '+'), 'rft.date=' || year, 'rft.jtitle=' || replace(url_encode(venue), '%20', '+')) end as open
 from (select n.*, case when author is not null then s.source end as source_name from n join (select doc_id, source from {{documents}}) s using (doc_id)) x)
select doc_id, concat_ws(' ', 'DOI=https://doi.org/' || d, 'arXiv=https://arxiv.org/abs/' || arxiv, 'OpenAlex=https://openalex.org/' || replace(openalex, 'https://openalex.org/', ''), 'S2=https://www.semanticscholar.org/paper/' || s2, 'SSRN=https://papers.ssrn.com/sol3/papers.cfm?abstract_id=' || ssrn, 'OpenURL=https://find.example/?v=1&' || open, 'EZproxy=https://login.example/login?qurl=https://doi.org/' || replace(url_encode(d), '%2F', '/')) as links from q""")
def f32_link_out(t: Tables) -> DataFrame:
    """Public pages of all ids, an OpenURL by DOI or by what is known, and a proxied address."""
    works = t.spark.sql(_LINKED.replace("{documents}", "{d}"), d=t.documents)
    links = X.link_out({k: k for k in ("doi", "arxiv", "openalex", "s2", "ssrn")}, "https://find.example/?v=1", "https://login.example/login?qurl={url}", "library.example", title="title", author="author", year="year", venue="venue")
    return works.select("doc_id", F.array_join(F.transform(links, lambda x: F.concat_ws("=", x["label"], x["url"])), " ").alias("links"))


_ASKED = """select doc_id, case doc_id % 4 when 0 then '10.1000/ABC' || doc_id when 1 then '10.48550/arXiv.2101.' || (10000 + doc_id) || 'v2' end as doi, case when doc_id % 6 = 0 then '2102.' || (10000 + doc_id) || 'V1' end as arxiv, case when doc_id % 5 = 0 then 'W' || doc_id end as openalex,
case when doc_id % 7 = 0 then doc_id end as pmid, case when doc_id % 9 = 0 then 'S' || doc_id end as s2, case when doc_id % 11 <> 0 then substr(text, 1, 60) end as title, case when doc_id % 3 <> 0 then 1990 + doc_id % 30 end as year from {documents}"""


@query(f"""with a as ({_ASKED}), k as (select *, trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', ' ', 'g')) as t from a),
r as (select *, coalesce('openalex=' || lower(openalex), case doc_id % 4 when 0 then 'doi=10.1000/abc' || doc_id when 1 then 'arxiv=2101.' || (10000 + doc_id) end, 'arxiv=' || lower(arxiv), 'pmid=' || pmid, 's2=' || lower(s2), 'title=' || case when title <> '' then t end, 'anon') as id from k)
select doc_id, 'referenced_works:src=' || id as referenced, 'oa_pdf_candidates:src=' || id as candidates, 'by_doi:doi=' || lower(doi) as by_doi, 'by_title:title=' || t || '|year=' || coalesce(year::varchar, '') as by_title, 'by_openalex_ids:ids=' || list_aggregate(list_sort(list_distinct(['w' || doc_id, 'w' || (doc_id + 1)])), 'string_agg', '|') as batch from r""")
def f5_request_keys(t: Tables) -> DataFrame:
    """Keys of what is asked of providers: by the strongest id, by DOI, by title and year, by a batch of ids."""
    a = t.spark.sql(_ASKED.replace("{documents}", "{d}"), d=t.documents)
    own = X.request_id({k: k for k in ("doi", "arxiv", "openalex", "pmid", "s2")}, "title")
    w = lambda n: F.concat(F.lit("W"), F.col("doc_id") + n)
    batch = F.array(w(1), F.concat(F.lit("https://openalex.org/w"), F.col("doc_id")), w(0), F.lit("A17"), F.lit(None).cast("string"))
    return a.select("doc_id", F.concat(F.lit("referenced_works:src="), own).alias("referenced"), F.concat(F.lit("oa_pdf_candidates:src="), own).alias("candidates"), F.concat(F.lit("by_doi:doi="), F.lower("doi")).alias("by_doi"), X.title_request("title", "year").alias("by_title"), X.batch_request(batch).alias("batch"))


@query("select conv_id, string_agg((turn + 1)::varchar, ',' order by turn) as pages from {conversations} where turn % 3 <> 2 group by 1")
def f30_page_marks(t: Tables) -> DataFrame:
    """Page marks on lines of their own, from 1; what only looks like one is none."""
    k = F.col("turn")
    line = F.when(k % 3 == 0, F.format_string("{%d}------------", k)).when(k % 3 == 1, F.format_string("  {%d}---  ", k)).otherwise(F.format_string("see {%d}----- here", k))
    texts = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(line, F.lit("\n"), "text").alias("x")))), lambda e: e["x"]), "\n\n").alias("text"))
    return texts.select("conv_id", F.array_join(F.transform(X.page_marks("text"), lambda x: x.cast("string")), ",").alias("pages")).where("pages <> ''")


@query("""select p_partkey, case p_partkey % 4 when 0 then 'https://www.biorxiv.org/content/10.1101/' || p_partkey || '.full.pdf' when 1 then 'https://osf.io/' || lpad((p_partkey % 100000)::varchar, 5, '0') || '/download' when 2 then 'https://www.nber.org/system/files/working_papers/w' || p_partkey || '/w' || p_partkey || '.pdf' end as file from {part}""")
def f33_file_candidates(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    page = (
        F.when(k % 4 == 0, F.concat(F.lit("https://www.biorxiv.org/content/10.1101/"), k, F.lit("v2.full")))
        .when(k % 4 == 1, F.concat(F.lit("https://osf.io/preprints/socarxiv/"), F.lpad((k % 100000).cast("string"), 5, "0")))
        .when(k % 4 == 2, F.concat(F.lit("https://www.nber.org/papers/w"), k))
        .otherwise(F.concat(F.lit("https://example.org/"), k))
    )
    return t.part.select("p_partkey", page.alias("page")).select("p_partkey", F.try_element_at(X.file_candidates("page"), F.lit(1)).alias("file"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'T' || o_orderkey when o_orderkey % 3 = 1 then 'D' || o_orderkey else 'N' || o_orderkey end as title, case when o_orderkey % 2 = 0 then year(o_orderdate)::int else 1900 end as year from {orders}""")
def f34_provider_records(t: Tables) -> DataFrame:
    """Fields of provider records under their several names: the first that is there and not blank."""
    k = F.col("o_orderkey")
    record = t.orders.select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("T"), k)).when(k % 3 == 1, " ").alias("title"), F.when(k % 3 == 1, F.concat(F.lit("D"), k)).alias("display_name"), F.concat(F.lit("N"), k).alias("name"), F.when(k % 2 == 0, F.year("o_orderdate")).alias("year"), F.lit(1900).alias("publication_year"))
    return record.select("o_orderkey", X.first_of(["title", "display_name", "name"]).alias("title"), X.first_of(["year", "publication_year"]).alias("year"))


@query("select doc_id, sha256(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) as nfc from {documents}")
def x3_composed(t: Tables) -> DataFrame:
    """Texts in composed form; Python is given only those with a combining mark."""
    c = F.replace(F.col("text"), F.lit("e"), F.lit("e\u0301"))
    return t.documents.select("doc_id", F.sha2(F.when(c.rlike(r"\p{M}"), X.nfc(c)).otherwise(c), 256).alias("nfc"))
