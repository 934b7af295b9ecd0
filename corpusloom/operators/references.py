"""Bibliographies: ranges of a text to entries, entries to fields, in two styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.windows import carry, islands, line_rows, with_enumerated

# Labels of plain reference lists; any other label is a list of its own kind, whose numbering is trusted.
PLAIN_LABELS = ["references", "bibliography", "works cited", "literature cited", "reference list", "references and notes", "literature"]
# Titles of a reference list that stand on a line of their own, where no heading marks the list.
LIST_TITLES = ["references", "bibliography", "works cited", "literature cited", "reference list"]
# How lines open that page breaks leave in a list, and how issue marks open (a digit follows).
DEBRIS = ["downloaded from", "this content downloaded from", "all use subject to jstor", "discussion of the paper"]
ISSUE = ["no.", "vol."]
# What a line opens with that goes on with the entry before it, besides a small letter.
GOES_ON = [",", "&", "-", "pp.", "ed.", "eds.", "ch.", "vol.", "no."]
# Words that scans misread.
MISREAD = {"$HORROCKS": "Shorrocks", "Combridge": "Cambridge"}

_SPAN = r"<span[^>]*>\s*</span>\s*"
_NUMBER = r"^\s*[\[(]?\s*([0-9]{1,3})\s*[\]).]\s+"
_DASHES = r"^\s*(?:-{2,}|[—–\x{FFFD}]+)[\s.:]*"
_LOST = "\x01"


def is_sublist(label: Column | str) -> Column:
    """Whether a label names a list of its own kind: none of the plain labels, once numbering, emphasis and a colon are off."""
    bare = F.regexp_replace(F.translate(F.regexp_replace(label, _SPAN, ""), "*_`", ""), r"^\s*[0-9]{1,3}[.)]\s*", "")
    return ~F.lower(F.regexp_replace(F.regexp_replace(F.trim(bare), r"[:\s]+$", ""), r"\s+", " ")).isin(*PLAIN_LABELS)


def clean_line(c: Column | str) -> Column:
    """A line without page anchors, bullet, back links and emphasis; links become their text, and keep a DOI they point to; scan faults mended."""
    c = F.regexp_replace(c, _SPAN, "")
    c = F.regexp_replace(c, r"^\s*[-*+•]\s+", "")
    c = F.regexp_replace(c, r"\s*\[[0-9,\s]+\]\(#[^)]*\)", "")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^()\s]*?(10\.[0-9]{4,9}/[^\s()]+)[^()]*\)", "$1 $2")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\((?:[^()]|\([^()]*\))*\)", "$1")
    c = F.regexp_replace(F.translate(c, "*", ""), r"([0-9])\x{FFFD}(?=[0-9])", "$1-")
    for bad, good in MISREAD.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def is_debris(c: Column | str) -> Column:
    """Whether a page break left a line: heading, page number, download note, issue mark, bare link (a DOI's is none), running head in capitals."""
    line = F.trim(F.col(c) if isinstance(c, str) else c)
    low = F.lower(line)
    opens = F.lit(False)
    for words in DEBRIS:
        opens = opens | low.startswith(words)
    for words in ISSUE:
        opens = opens | F.regexp_replace(low, r"^\[\s*", "").rlike("^" + words.replace(".", r"\.") + r"\s*[0-9]")
    link = low.startswith("http") & low.contains("://") & ~low.contains(" ") & ~low.rlike(r"^https?://(?:dx\.)?doi\.org/")
    capitals = (F.upper(line) == line) & (low != line) & F.length(line).between(3, 60) & ~line.rlike("[0-9]") & (line.contains("AND") | line.contains(","))
    return line.rlike(r"^#{1,6}[ \t]+\S") | opens | link | line.rlike("^[0-9]{1,4}$") | capitals


def _dated_opening(c: Column) -> Column:
    """Whether a text opens with a surname, a comma and, with no brackets between and not far on, a year and its mark."""
    until = F.regexp_extract(F.trim(c), r"^[\"“]?\p{Lu}[\p{L}0-9_'’.-]+,\s+(.*?)\(?(?:1[5-9]|20)[0-9]{2}[).,]", 1)
    found = F.trim(c).rlike(r"^[\"“]?\p{Lu}[\p{L}0-9_'’.-]+,\s+.*?\(?(?:1[5-9]|20)[0-9]{2}[).,]")
    return found & (F.length(until) <= 160) & ~until.rlike("[()]")


def _goes_on(c: Column) -> Column:
    line = F.ltrim(c)
    out = line.rlike("^[a-z]")
    for words in GOES_ON:
        out = out | line.startswith(words)
    return out


def _first_year(c: Column) -> Column:
    return F.try_element_at(F.filter(F.regexp_extract_all(c, F.lit(r"\b([0-9]{4})\b"), F.lit(1)), lambda y: y.between("1500", "2099")), F.lit(1))


def fields(entry: Column) -> dict[str, Column]:
    """author, year, title, doi, arxiv and whether the author is carried on, of an entry on one line.

    A numbered entry that does not open with surname and year has its title in
    quotes, or as the last clause before venue, year and identifiers; other
    entries after the year. An entry without a year has no title in that style.
    """
    body = F.regexp_replace(entry, _DASHES, "")
    bare = F.trim(F.regexp_replace(body, _NUMBER, ""))
    numbered = body.rlike(_NUMBER) & ~_dated_opening(bare)
    by_comma = F.regexp_extract(bare, r"^[\"“]?\s*(\p{Lu}[\p{L}0-9_'’.-]+)\s*,", 1)
    by_initials = F.regexp_extract(bare, r"^(?:\p{Lu}\.-?\s*){1,4}(\p{Lu}[\p{L}'’-]+)", 1)
    after = F.regexp_extract(bare, r"\b(?:1[5-9]|20)[0-9]{2}\b[).,:\s]*(.*)$", 1)
    clause = F.element_at(F.split(F.trim(F.regexp_replace(after, r"^[\"“”'\s]+|[\"“”'\s]+$", "")), r"\.\s+"), 1)
    quoted = F.regexp_replace(F.regexp_extract(bare, r"[\"“]([^\"“”]{6,})[\"”]", 1), r"^[,.\s]+|[,.\s]+$", "")
    head = F.regexp_replace(bare, r"(?i)(?:\bdoi\b[:\s]*)?(?:https?://\S*)?10\.[0-9]{4,9}/.*$|\barxiv\b.*$", "")
    clauses = F.transform(F.split(F.regexp_replace(head, r"\b[Ii]n:?\s*$", ""), r"\.\s+"), lambda s: F.regexp_replace(s, r"^[ .,]+|[ .,]+$", ""))
    fit = F.filter(clauses, lambda s: s.rlike("[A-Za-z]") & ~s.rlike(r",\s*(?:1[5-9]|20)[0-9]{2}\b"))
    none = lambda c: F.nullif(F.regexp_replace(c, r"^[ .]+|[ .]+$", ""), F.lit(""))
    title = F.when(numbered, F.when(F.length(quoted) >= 6, quoted).otherwise(F.try_element_at(fit, F.lit(-1)))).when(_first_year(bare).isNotNull(), none(clause))
    return {
        "author": F.coalesce(F.nullif(by_comma, F.lit("")), F.nullif(by_initials, F.lit(""))),
        "year": _first_year(body).try_cast("int"),
        "title": title,
        "doi": X.doi_in(body),
        "arxiv": X.arxiv_in(body),
        "continued": entry.rlike(_DASHES),
    }


def entries(ranges: DataFrame, doc: str = "work_id") -> DataFrame:
    """(doc, label, ordinal, raw): the entries of reference ranges (doc, label, text), each on one line.

    Lines are cleaned and debris is dropped. A numbered list, that is three
    numbers and more that mostly rise, or any number in a list of its own kind,
    begins an entry at a number or dash, and what stands before the first is no
    entry. Elsewhere an entry begins at a number, a dash, or a surname with a
    year, unless the line goes on with the one before; and there, in plain
    lists, a line that holds several entries is cut where a sentence ends and
    the next opens with a surname. Null and empty texts have no entries.
    """
    keys = [doc, "label"]
    cleaned = F.transform(F.split("text", "\n"), clean_line)  # before the explode: a filter on its result is not written out for each use
    ranges = ranges.select(*keys, "text", is_sublist(F.coalesce("label", F.lit(""))).alias("_own"))  # told once a range, not once a line
    lines = ranges.select(*keys, "_own", F.posexplode(cleaned).alias("line", "body")).where((F.trim("body") != "") & ~is_debris("body"))
    lines = lines.withColumn("number", F.nullif(F.regexp_extract("body", _NUMBER, 1), F.lit("")).cast("int"))
    lines = with_enumerated(lines, keys, "line", "number").withColumn("enumerated", F.col("enumerated") | (F.col("_own") & F.max(F.col("number").isNotNull()).over(W.partitionBy(*keys))))
    marked = F.col("number").isNotNull() | F.col("body").rlike(_DASHES)
    opens = marked | (~F.col("enumerated") & ~_goes_on(F.col("body")) & _dated_opening(F.col("body")))
    groups = islands(lines.withColumn("_open", opens), keys, "line", F.col("_open"), "_g").where("_g > 0 or not enumerated")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: F.trim(x["body"])), " ")
    raw = groups.groupBy(*keys, "_g").agg(joined.alias("raw"), F.bool_or(F.col("enumerated") | F.col("_own")).alias("whole")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    cut = F.split(F.regexp_replace("raw", r"([.’\"”])\s+(?=\p{Lu}[\p{L}0-9_'’-]+,\s+\p{Lu})", f"$1{_LOST}"), _LOST)
    each = raw.select(*keys, "_g", F.posexplode(F.when(F.col("whole"), F.array("raw")).otherwise(cut)).alias("_i", "raw")).where("trim(raw) <> ''")
    return each.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("_g", "_i")).alias("ordinal"), F.trim("raw").alias("raw"))


def references(ranges: DataFrame, doc: str = "work_id") -> DataFrame:
    """doc, label, ordinal, raw, author, year, title, doi, arxiv, continued of the entries of reference ranges (doc, label, text). Where a dash repeats it, the author before is carried on, inside its range."""
    rows = entries(ranges, doc)
    rows = rows.select("*", *[c.alias(n) for n, c in fields(F.col("raw")).items()])
    rows = carry(rows, [doc, "label"], "ordinal", F.col("author"), "_carried").withColumn("author", F.coalesce("author", F.when(F.col("continued"), F.col("_carried"))))
    return rows.withColumn("continued", F.col("continued") & F.col("author").isNotNull()).drop("_carried")


def fallback_ranges(docs: DataFrame, doc: str = "work_id", text: str = "text") -> DataFrame:
    """(doc, label, text) of lists without a heading: from each line that is a list's title in bold or italics, or where a document has none such, bare, to the next or the end."""
    lines = line_rows(docs, doc, text).withColumn("_s", F.regexp_replace("body", _SPAN, ""))
    bare = F.regexp_replace(F.trim("_s"), r"\s*:$", "")
    marked = F.col("_s").rlike(r"^[ \t]{0,3}[*_]") & bare.rlike("[*_]$")
    label = F.regexp_replace(F.trim(F.translate(bare, "*_", "")), r"^[0-9]{1,3}[.)]?\s+|\s*:$", "")
    kind = F.when(marked & F.lower(label).isin(*LIST_TITLES), 1).when(F.lower(bare).isin(*LIST_TITLES) & F.col("_s").rlike(r"^[ \t]{0,3}\S"), 2)
    lines = lines.withColumn("_kind", kind).withColumn("_best", F.min("_kind").over(W.partitionBy(doc))).withColumn("_cue", F.coalesce(F.col("_kind") == F.col("_best"), F.lit(False)))
    groups = islands(lines.withColumn("_l", F.when(F.col("_cue"), label)), [doc], "line", F.col("_cue"), "_g").where("_g > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_cue"), F.struct("line", "body")))), lambda x: x["body"]), "\n")
    return groups.groupBy(doc, "_g").agg(F.max("_l").alias("label"), body.alias("text")).select(doc, "label", "text")
