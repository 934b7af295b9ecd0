"""Documents to sections, spans, chunks, references and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.joins import section_at
from corpusloom.functions.access import most_restrictive
from corpusloom.operators.windows import islands, line_rows, outline


def sections(docs: DataFrame, doc: str = "work_id", text: str = "text") -> DataFrame:
    """ATX headings tile each document.

    doc, ordinal, level (0 for the text before the first heading), heading,
    parent (ordinal), path, kind, start_char, end_char, section_id. Lines end at
    \\n; offsets are code points, half-open; a document without text has none.
    """
    size = docs.select(doc, F.length(text).alias("_size"), F.sha2(text, 256).alias("_hash"))
    lines = line_rows(docs, doc, text)
    mark = F.regexp_extract("body", r"^(#{1,6})[ \t]+(?:.+?)[ \t]*#*[ \t]*$", 1)
    heads = lines.withColumn("_m", mark).where("_m <> ''").select(doc, F.col("start").alias("start_char"), F.length("_m").alias("level"), F.trim(F.regexp_extract("body", r"^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)).alias("heading"))
    firsts = heads.groupBy(doc).agg(F.min("start_char").alias("_first"))
    pre = docs.select(doc, text).join(firsts, doc, "left").withColumn("_to", F.coalesce("_first", F.length(text)))
    pre = pre.where(F.trim(F.regexp_replace(F.substring(F.col(text), F.lit(1), F.col("_to")), r"\s+", " ")) != "").select(doc, F.lit(0).alias("start_char"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("heading"))
    rows = heads.unionByName(pre).join(size, doc)
    w = W.partitionBy(doc).orderBy("start_char")
    rows = rows.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("end_char", F.coalesce(F.lead("start_char").over(w), F.col("_size")))
    rows = outline(rows, doc, "ordinal", "level").withColumn("parent", F.when(F.col("level") > 0, F.col("parent")))
    up = rows.select(doc, F.col("ordinal").alias("_o"), F.col("heading").alias("_h"), F.col("parent").alias("_p"))
    chain = rows.select(doc, "ordinal", F.col("parent").alias("_at"), F.array("heading").alias("_path"))
    for _ in range(5):  # six levels at most
        chain = chain.join(up, (chain[doc] == up[doc]) & (F.col("_at") == F.col("_o")), "left").select(chain[doc], "ordinal", F.col("_p").alias("_at"), F.when(F.col("_h").isNotNull(), F.concat(F.array("_h"), "_path")).otherwise(F.col("_path")).alias("_path"))
    out = rows.join(chain.select(doc, "ordinal", "_path"), [doc, "ordinal"])
    return out.select(
        doc, "ordinal", "level", "heading", "parent", F.when(F.col("level") > 0, F.array_join("_path", " > ")).alias("path"),
        F.coalesce(X.section_kind("heading"), F.lit("body")).alias("kind"), F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"),
        X.content_id("sec_", 16, F.col("_hash"), F.col("ordinal")).alias("section_id"),
    )


def paragraph_spans(docs: DataFrame, doc: str = "work_id", text: str = "text", blank_lines: bool = True) -> DataFrame:
    """Paragraphs (between blank lines, or single lines) trimmed to their text, with verbatim offsets and ids."""
    lines = line_rows(docs, doc, text).withColumn("_blank", F.trim(F.regexp_replace("body", r"\s+", " ")) == "")
    if blank_lines:
        w = W.partitionBy(doc).orderBy("line")
        begins = ~F.col("_blank") & F.coalesce(F.lag("_blank").over(w), F.lit(True))
        groups = islands(lines.withColumn("_b", begins), [doc], "line", F.col("_b"), "_g").where("not _blank")
        blocks = groups.groupBy(doc, "_g").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    else:
        blocks = lines.where("not _blank").select(doc, F.col("start").alias("s"), F.col("end").alias("e"))
    cut = blocks.join(docs.select(doc, text), doc).withColumn("_q", F.substring(F.col(text), F.col("s") + 1, F.col("e") - F.col("s")))
    lead = F.length("_q") - F.length(F.regexp_replace("_q", r"^\s+", ""))
    tail = F.length("_q") - F.length(F.regexp_replace("_q", r"\s+$", ""))
    got = cut.select(doc, (F.col("s") + lead).cast("long").alias("start_char"), (F.col("e") - tail).cast("long").alias("end_char"), F.sha2(text, 256).alias("_hash"), text)
    quote = F.substring(F.col(text), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return got.select(doc, "start_char", "end_char", quote.alias("exact_quote"), X.quote_hash(quote).alias("quote_hash"), X.content_id("span_", 24, F.col("_hash"), F.col("start_char"), F.col("end_char"), F.lit("paragraph")).alias("span_id"))


def ensure_spans(quotes: DataFrame, docs: DataFrame, doc: str = "work_id") -> DataFrame:
    """Quotes (doc, quote, access_class) that occur exactly once in their document, one a document and quote, access tightened."""
    got = quotes.join(docs.select(doc, "text"), doc).withColumn("start_char", X.unique_offset(F.col("text"), F.col("quote"))).where("start_char is not null")
    return got.withColumn("quote_hash", X.quote_hash("quote")).groupBy(doc, "quote_hash").agg(F.min("start_char").cast("long").alias("start_char"), F.max(F.length("quote")).cast("long").alias("size"), most_restrictive("access_class").alias("access_class"))


def verify_spans(spans: DataFrame, docs: DataFrame, doc: str = "work_id") -> DataFrame:
    """``status``: anchored if the document's slice is the quote, stale if not, orphaned if its text is gone."""
    got = spans.join(docs.select(F.col(doc).alias("_d"), F.col("text").alias("_t")), F.col(doc) == F.col("_d"), "left")
    slice_ = F.substring(F.col("_t"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    return got.withColumn("status", F.when(F.col("_t").isNull(), "orphaned").when(slice_ == F.col("exact_quote"), "anchored").otherwise("stale")).drop("_d", "_t")


def reanchor_spans(stale: DataFrame, docs: DataFrame, doc: str = "work_id") -> DataFrame:
    """Where a stale quote now stands in the newest text if it occurs once; else orphaned, for review."""
    got = stale.join(docs.select(doc, F.col("text").alias("_t")), doc, "left").withColumn("_at", X.unique_offset(F.col("_t"), F.col("exact_quote")))
    return got.select(doc, "span_id", F.col("_at").cast("long").alias("start_char"), (F.col("_at") + F.length("exact_quote")).cast("long").alias("end_char"), F.when(F.col("_at").isNull(), "orphaned").otherwise("anchored").alias("status"))


def chunk_plan(units: DataFrame, doc: str, budget: int, overlap: int) -> DataFrame:
    """Greedy packing of each document's ordered units (start_char, end_char) into chunks of ``budget`` tokens.

    A unit over the budget is a chunk of its own. Chunks after the first start
    ``overlap`` tokens earlier, but not before the previous chunk. The fold runs
    over the document's own units inside one row.
    """
    tokens = lambda a, b: F.greatest(F.lit(1), F.floor((b - a) / 4))
    ordered = units.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("start_char").cast("long").alias("a"), F.col("end_char").cast("long").alias("b")))).alias("u"))
    empty = F.array().cast("array<struct<a:bigint,b:bigint,big:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        big = tokens(x["a"], x["b"]) > budget
        joins = last.isNotNull() & ~big & ~F.coalesce(last["big"], F.lit(True)) & (tokens(last["a"], x["b"]) <= budget)
        fresh = F.struct(x["a"].alias("a"), x["b"].alias("b"), big.alias("big"))
        grown = F.struct(last["a"].alias("a"), x["b"].alias("b"), F.lit(False).alias("big"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    chunks = ordered.select(doc, F.posexplode(F.aggregate("u", empty, step)).alias("chunk", "c"))
    before = F.lag(F.col("c.a")).over(W.partitionBy(doc).orderBy("chunk"))
    start = F.when(F.col("chunk") == 0, F.col("c.a")).otherwise(F.greatest(before, F.col("c.a") - 4 * overlap))
    got = chunks.select(doc, "chunk", start.alias("start_char"), F.col("c.b").alias("end_char"), F.col("c.big").alias("oversize"))
    return got.withColumn("tokens", tokens(F.col("start_char"), F.col("end_char")).cast("long"))


def note_claims(notes: DataFrame, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One claim for each scalar field and array element of notes (note_id, work_id, and the fields as struct columns label, quote, status, note).

    A field that is absent makes a not_found row; an inferred one without an explanation fails.
    """
    status = lambda v: F.when(v.isNull() | v["label"].isNull(), "not_found").when((v["status"] == "inferred") & (F.coalesce(F.trim(v["note"]), F.lit("")) == ""), "extraction_failed").otherwise(F.coalesce(v["status"], F.lit("found")))
    row = lambda name, v, i: F.struct(F.lit(name).alias("field_key"), i.cast("int").alias("item"), v["label"].alias("label"), status(v).alias("status"))
    def items(name: str) -> Column:
        each = F.transform(F.col(name), lambda v, i: row(name, v, i))
        none = F.struct(F.lit(name).alias("field_key"), F.lit(0).alias("item"), F.lit(None).cast("string").alias("label"), F.lit("not_found").alias("status"))
        return F.when(F.coalesce(F.size(F.col(name)), F.lit(0)) > 0, each).otherwise(F.array(none))

    whole = F.concat(F.array(*[row(s, F.col(s), F.lit(0)) for s in scalars]), *[items(a) for a in arrays])
    return notes.select("note_id", "work_id", F.explode(whole).alias("c")).select("note_id", "work_id", "c.*")


def merge_chunk_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts (work_id, chunk, field_key, claim_type, label, confidence, is_array) of chunks as one set.

    A scalar keeps its best confidence, then the earliest chunk; array items are
    one a (type, label), numbered in order of first chunk, with chunks listed;
    a field is not_found only if no chunk found it.
    """
    found = drafts.where("label is not null")
    one = found.where("not is_array").groupBy("work_id", "field_key").agg(F.min_by(F.struct("claim_type", "label", "chunk"), F.struct((-F.col("confidence")).alias("c"), F.col("chunk"), F.col("label"), F.col("claim_type"))).alias("p"))
    one = one.select("work_id", "field_key", F.lit(1).alias("item"), F.col("p.claim_type").alias("claim_type"), F.col("p.label").alias("label"), F.col("p.chunk").cast("string").alias("chunks"))
    many = found.where("is_array").groupBy("work_id", "field_key", "claim_type", "label").agg(F.array_sort(F.collect_set("chunk")).alias("cs"))
    many = many.withColumn("item", F.row_number().over(W.partitionBy("work_id", "field_key").orderBy(F.col("cs")[0], "claim_type", "label")))
    many = many.select("work_id", "field_key", "item", "claim_type", "label", F.array_join(F.transform("cs", lambda x: x.cast("string")), ",").alias("chunks"))
    none = drafts.select("work_id", "field_key").distinct().join(found.select("work_id", "field_key"), ["work_id", "field_key"], "left_anti")
    empty = none.select("work_id", "field_key", F.lit(0).alias("item"), F.lit(None).cast("string").alias("claim_type"), F.lit(None).cast("string").alias("label"), F.lit("").alias("chunks"))
    return one.unionByName(many).unionByName(empty)


def live_spans(spans: DataFrame, docs: DataFrame, sections: DataFrame, doc: str = "work_id", text: str = "text") -> DataFrame:
    """Spans with ``live``, the text that stands there now (null where the document is gone), and the section they lie in."""
    at = section_at(spans.select(doc, F.col("start_char").alias("offset")).distinct(), sections, doc).withColumnRenamed("offset", "start_char")
    got = spans.join(docs.select(doc, F.col(text).alias("_now")), doc, "left").join(at, [doc, "start_char"], "left")
    return got.withColumn("live", F.substring("_now", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).drop("_now")


def project_lens(records: DataFrame) -> DataFrame:
    """Records (quote, status, ...) with ``part``: claim for found ones with a quote, review for those that failed or, found without a quote, are ambiguous; none for others."""
    bare = (F.col("status") == "found") & (F.coalesce(F.trim("quote"), F.lit("")) == "")
    status = F.when(bare, "ambiguous").otherwise(F.col("status"))
    part = F.when(status == "found", "claim").when(status.isin("ambiguous", "extraction_failed"), "review").otherwise("none")
    return records.withColumn("part", part).withColumn("status", status)


def stale_runs(runs: DataFrame, lenses: DataFrame, texts: DataFrame) -> DataFrame:
    """Runs (lens_id, work_id, definition_hash, markdown_hash) with ``stale``: made with another definition or text than the present ones, or with one that is gone."""
    now = runs.join(lenses.select("lens_id", F.col("definition_hash").alias("_d")), "lens_id", "left").join(texts.select("work_id", F.col("markdown_hash").alias("_m")), "work_id", "left")
    same = F.col("definition_hash").eqNullSafe(F.col("_d")) & F.col("markdown_hash").eqNullSafe(F.col("_m"))
    return now.withColumn("stale", ~same).drop("_d", "_m")
