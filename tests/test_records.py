"""Record rules, provider records, proposals, links and request keys on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import concepts, identity, joins, select

RULES = {
    "name": {"type": "string", "required": True},
    "n": {"type": "integer"},
    "x": {"type": "number"},
    "ok": {"type": "boolean"},
    "kind": {"type": "string", "allowed": ["a", "b"]},
    "tags": {"type": "array", "allowed": ["a", 1]},
    "more": {"type": "object"},
    "any": {"type": "something"},
}
GOOD = {"name": "N", "evidence_span_ids": ["s"]}


@pytest.mark.parametrize(
    "record, want",
    [
        (GOOD, ("found", [])),
        (GOOD | {"n": 1, "x": 1.5, "ok": True, "kind": "b", "tags": ["a", 1], "more": {}, "any": []}, ("found", [])),
        (GOOD | {"x": 2}, ("found", [])),
        (GOOD | {"n": None, "kind": None}, ("found", [])),
        ({"evidence_span_ids": ["s"]}, ("extraction_failed", ["missing:name"])),
        (GOOD | {"name": 3}, ("extraction_failed", ["type:name"])),
        (GOOD | {"n": 1.5, "x": "1", "ok": 1, "more": []}, ("extraction_failed", ["type:n", "type:x", "type:ok", "type:more"])),
        (GOOD | {"n": True}, ("extraction_failed", ["type:n"])),
        (GOOD | {"kind": "c"}, ("extraction_failed", ["value:kind"])),
        (GOOD | {"tags": ["a", "1"]}, ("extraction_failed", ["value:tags"])),
        ({"name": "N", "status": "not_found"}, ("not_found", [])),
        ({"name": 1, "status": "not_found"}, ("extraction_failed", ["type:name"])),
        (GOOD | {"stated_or_inferred": "inferred"}, ("extraction_failed", ["no notes"])),
        (GOOD | {"assertion_status": "inferred", "notes": " "}, ("extraction_failed", ["no notes"])),
        (GOOD | {"assertion_status": "inferred", "notes": "why"}, ("found", [])),
        (GOOD | {"stated_or_inferred": "stated", "assertion_status": "inferred"}, ("found", [])),
        ({"name": "N"}, ("ambiguous", ["no span"])),
        ({"name": "N", "evidence_span_ids": ["", None]}, ("ambiguous", ["no span"])),
        ([1], ("extraction_failed", ["missing:name", "record"])),
        ("{broken", ("extraction_failed", ["missing:name", "record"])),
        (None, ("extraction_failed", ["missing:name", "record"])),
    ],
)
def test_record_rules(spark, record, want):
    text = record if record is None or isinstance(record, str) else json.dumps(record)
    df = spark.createDataFrame([(text,)], "record string")
    assert tuple(df.select(select.record_status("record", RULES).alias("r")).select("r.*").first()) == want


def test_record_rules_without_evidence_policy(spark):
    df = spark.createDataFrame([('{"name": "N", "stated_or_inferred": "inferred"}',)], "record string")
    assert df.select(select.record_status("record", RULES, need_span=False, explain_inferred=False)["status"]).first()[0] == "found"


def test_provider_identities(spark):
    rows = [("1", " ", "https://openalex.org/w5", None, "S", "A Théory of x", 1999), ("2", "doi:10.48550/arXiv.2101.00001v2", None, None, None, "  ", None), ("3", None, None, None, None, "Bare", 2000)]
    df = spark.createDataFrame(rows, "record string, doi string, openalex_id string, s2_id string, s2 string, title string, year int")
    got = {r["record"]: r for r in identity.provider_identities(df, "record").collect()}
    assert (got["1"]["doi"], got["1"]["openalex"], got["1"]["s2"], got["1"]["canonical"], got["1"]["title_key"]) == (None, "W5", "S", "openalex:W5", "a theory of x")
    assert (got["2"]["doi"], got["2"]["arxiv"], got["2"]["canonical"], got["2"]["title_key"]) == (None, "2101.00001", "arxiv:2101.00001", None)
    assert (got["3"]["canonical"], got["3"]["ssrn"]) == (None, None)


def test_resolution_by_records(spark):
    records = spark.createDataFrame([(7, "10.1/A", "Sampling theory"), (8, None, "Graph theory now"), (9, "10.1/c", "Twin title"), (10, "10.1/d", "Twin title")], "record long, doi string, title string")
    entries = spark.createDataFrame([("a", "https://doi.org/10.1/a", None, "other"), ("b", None, None, "SAMPLING   theory."), ("c", None, None, "Graph theory now"), ("d", None, None, "Twin title"), ("e", "10.9/none", None, None), ("f", None, "arXiv:2101.1v1", "none")], "entry_id string, doi string, arxiv string, title string")
    got = {r[0]: tuple(r)[1:] for r in identity.resolve_by_records(entries, identity.provider_identities(records, "record"), "record").collect()}
    assert got == {"a": (7, "resolved", 1.0), "b": (7, "resolved", 0.8), "c": (None, "suspect", None), "d": (None, "ambiguous", None), "e": (None, "unresolved", None), "f": (None, "resolved", 1.0)}


def test_no_proposals(spark):
    none = concepts.no_proposals(spark)
    assert concepts.review_pairs(none, none, none, none).count() == 0


def links(spark, row, **options):
    df = spark.createDataFrame([row], "doi string, arxiv string, title string, author string, year int, venue string")
    about = {k: k for k in ("title", "author", "year", "venue")}
    return [tuple(x) for x in df.select(X.link_out({"doi": "doi", "arxiv": "arxiv"}, **options, **about).alias("l")).first()["l"]]


def test_links(spark):
    assert links(spark, (None, None, None, None, None, None), resolver="https://r", proxy="p") == []
    assert links(spark, ("10.1/a", "2101.1", "T", None, None, None)) == [("DOI", "https://doi.org/10.1/a"), ("arXiv", "https://arxiv.org/abs/2101.1")]
    got = dict(links(spark, (None, None, "A & B", "de Vries, Jan", 1999, "J"), resolver="https://r?x"))
    assert got == {"OpenURL": "https://r?x&url_ver=Z39.88-2004&rft_val_fmt=info%3Aofi%2Ffmt%3Akev%3Amtx%3Ajournal&rft.genre=article&rft.atitle=A+%26+B&rft.aulast=Vries&rft.date=1999&rft.jtitle=J"}
    assert dict(links(spark, ("10.1/a b", None, None, None, None, None), resolver="https://r"))["OpenURL"] == "https://r?url_ver=Z39.88-2004&rft_id=info%3Adoi%2F10.1%2Fa+b"
    proxied = lambda p: dict(links(spark, ("10.1/a&b", None, None, None, None, None), proxy=p)).get("EZproxy")
    assert proxied("https://p/?q={url}") == "https://p/?q=https://doi.org/10.1/a%26b"
    assert proxied("https://p/{doi}") == "https://p/10.1%2Fa%26b"
    assert proxied("p.example") == "https://p.example/login?url=https://doi.org/10.1/a%26b"
    assert proxied("https://p.example") is None


def test_request_keys(spark):
    df = spark.createDataFrame([("10.1/A", "W9", "T"), ("10.48550/arXiv.2101.1v3", None, "T"), (" ", None, "Ünder Way"), (None, None, "")], "doi string, openalex string, title string")
    assert [r[0] for r in df.select(X.request_id({"doi": "doi", "openalex": "openalex"}, "title")).collect()] == ["openalex=w9", "arxiv=2101.1", "title=under way", "anon"]
    batch = df.limit(1).select(X.batch_request(F.array(F.lit("w2"), F.lit("https://openalex.org/W1"), F.lit("W2"), F.lit("x"), F.lit(None))))
    assert batch.first()[0] == "by_openalex_ids:ids=w1|w2"


def test_tokens_anywhere(spark):
    texts = spark.createDataFrame([(1, "Abcabc"), (2, "xb"), (3, ""), (4, None)], "k long, t string")
    tokens = spark.createDataFrame([("b",), ("BC",), ("cab",), ("abcabc",), ("abd",), ("",), (None,)], "token string")
    got = {(r["k"], r["token"]) for r in joins.containing(texts, "k", "t", tokens, "token").collect()}
    assert got == {(1, "b"), (2, "b"), (1, "BC"), (1, "cab"), (1, "abcabc")}
