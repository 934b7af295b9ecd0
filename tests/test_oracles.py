"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from corpusloom import registry
from corpusloom.sources.views import TABLES

DIR = "/root/testdata/sf0.001"
#: One or two of each family; the driver compares all of them at a larger size.
NAMES = "s2_ingest s10_insert p4_export_gate p8_anchor_match j10_as_of j14_similar_labels a1_usage_rollup a5_authoritative_edges a6_co_occurrence w6_budget_prefix w9_line_offsets w13_heading_parent o6_label_cutoff u1_priority_union f1_f2_title_key f3_f5_strong_ids c1_sections c2_paragraph_spans c5_reanchor_spans c14_merge_chunk_drafts e5_resolve_references e8_collapse_works e9_candidate_clusters e10_fold_groups g3_components g4_degree g6_walk g7_neighborhood g10_modularity r2_phrase_search r5_top_spans q7_ranking_metrics q10_q12_rates t2_live_status t4_daily_spend r3_bm25 r4_match_units r6_claims r7_notes r8_concept_lookup r9_merged r12_citation_search f26_question_type f10_f12_resolution_guards f15_f16_own_identity f28_claim_types p13_get_span c18_lens_projection x5_lens_staleness q11_merge_noise q10_faithful q17_bibliography_overlap j8_token_containment t1_tail f32_link_out f5_request_keys x1_proposals x2_provider_records x4_record_rules g2_full_graph g20_trace_subgraph j20_edge_evidence j22_citation_matrix".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def order(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    assert sorted(rel.columns) == cols
    assert got == want


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert rows and {"question", "item_id", "place"} <= set(rows[0].asDict())
