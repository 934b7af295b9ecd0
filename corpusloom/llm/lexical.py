"""Ranked lexical search over a stored inverted index: short lists term by term, long lists document by document.

``build_index`` cuts the documents into segments and writes each term's list in
each segment once. ``top_documents`` reads the lists of the terms asked for,
puts those of a segment together and searches every segment for every item:
the short lists of an item are summed into accumulators (term at a time), which
then are one more bounded iterator beside the long lists. Documents are then
evaluated in order, a window of positions at a time: what no sum of bounds can
lift into the best ``k`` is skipped, unread.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm import textbytes
from corpusloom.plans.lineage import stored

#: A term: a run of what is neither ASCII punctuation, space nor control; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: A segment is written when it has so many postings or documents, which bounds a search task's memory.
POSTINGS, DOCUMENTS = 1 << 21, 1 << 16
#: Positions of documents that are evaluated together.
WINDOW = 2048
#: A list is short if it holds at most one in so many of its segment's documents.
SHORT = 32
#: Pairs of item and term that are sent out at once.
PAIRS = 1 << 17

_INDEX = "seg long, term string, df int, at array<int>, tf array<int>, ids array<long>"
_LISTS = pa.schema([("seg", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])


def counted(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of consecutive rows: first row, end row, terms of each row; then distinct terms and, of each row and term that meet, row, term's number and count."""
    for a, b, data, offsets in textbytes.slices(text, 1 << 20):
        plain = pa.StringArray.from_buffers(b - a, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes().translate(_PLAIN)))
        parts = pc.ascii_split_whitespace(plain)
        each = parts.values
        full = pc.greater(pc.binary_length(each), 0)
        row = np.repeat(np.arange(b - a), np.diff(parts.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
        coded = each.filter(full).dictionary_encode()
        size = max(1, len(coded.dictionary))
        met, tf = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
        yield a, b, np.bincount(row, minlength=b - a), coded.dictionary, met // size, met % size, tf


class _Segment:
    """Documents gathered so far, and their counts."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.terms: list[pa.Array] = []
        self.at: list[np.ndarray] = []
        self.code: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.docs = self.postings = self.codes = 0

    def add(self, ids: pa.Array, sizes: np.ndarray, terms: pa.Array, row: np.ndarray, code: np.ndarray, tf: np.ndarray) -> None:
        some = sizes > 0
        place = np.cumsum(some) - 1 + self.docs
        self.ids.append(ids.filter(pa.array(some)))
        self.sizes.append(sizes[some])
        self.terms.append(terms)
        self.at.append(place[row].astype(np.int32))
        self.code.append(code + self.codes)
        self.tf.append(tf.astype(np.int32))
        self.docs += int(some.sum())
        self.postings += len(row)
        self.codes += len(terms)

    def batch(self, seg: int) -> pa.RecordBatch:
        """One row a term with its list, and one without a term for the documents: ids and numbers of terms."""
        one = pa.concat_arrays(self.terms).dictionary_encode()
        code = one.indices.to_numpy()[np.concatenate(self.code)]
        order = np.argsort(code, kind="stable")
        n = len(one.dictionary)
        ends = np.searchsorted(code[order], np.arange(n + 1)).astype(np.int32)
        sizes = np.concatenate(self.sizes).astype(np.int32)
        offsets = pa.array(np.append(ends, ends[-1] + len(sizes)), pa.int32())
        at = pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1]), pa.int32()), pa.array(np.concatenate(self.at)[order]))
        tf = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.concatenate(self.tf)[order], sizes])))
        ids = pa.ListArray.from_arrays(pa.array([None] * n + [0, len(sizes)], pa.int32()), pa.concat_arrays(self.ids))
        terms = pa.concat_arrays([one.dictionary, pa.nulls(1, pa.string())])
        df = pa.array(np.append(np.diff(ends), len(sizes)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, seg, np.int64)), terms, df, at, tf, ids], schema=_LISTS)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    seg, held = TaskContext.get().partitionId() << 32, _Segment()
    for batch in batches:
        for a, b, sizes, terms, row, code, tf in counted(batch["text"]):
            held.add(batch["doc_id"].slice(a, b - a), sizes, terms, row, code, tf)
            if held.postings >= POSTINGS or held.docs >= DOCUMENTS:
                yield held.batch(seg)
                seg, held = seg + 1, _Segment()
    if held.docs:
        yield held.batch(seg)


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of ``docs`` (doc_id, text) as a stored table: (seg, term, df, at, tf) a list, (seg, df, tf, ids) the documents of a segment.

    ``at`` are positions in the segment's ``ids``; there ``tf`` is the number of
    a document's terms. Documents without a term are not in it. Each text is
    read once and whole, no row is shuffled; a segment is at most POSTINGS and
    one text's terms, so no task holds more.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_indexed, _INDEX), "lexical-index")


class Postings:
    """One list of a segment, scored: positions, scores, and the highest score of each window."""

    def __init__(self, at: np.ndarray, score: np.ndarray, windows: int) -> None:
        self.at, self.score = at, score
        self.bounds = np.zeros(windows, np.int64)
        np.maximum.at(self.bounds, at // WINDOW, score)
        self.cuts = np.searchsorted(at, np.arange(windows + 1) * WINDOW)

    def window(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[j], self.cuts[j + 1]
        return self.at[a:b] - j * WINDOW, self.score[a:b]


def best_of_segment(lists: list[Postings], size: int, place: np.ndarray, k: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` highest sums above 0 over ``lists`` in a segment of ``size`` documents, ties by ``place``."""
    windows = -(-size // WINDOW)
    few = [x for x in lists if len(x.at) * short <= size]
    kept = [x for x in lists if len(x.at) * short > size]
    if few:  # term at a time: the accumulators are one more list
        sums = np.zeros(size, np.int64)
        for x in few:
            sums[x.at] += x.score
        held = np.flatnonzero(sums)
        kept.append(Postings(held, sums[held], windows))
    at, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for j in range(windows):  # document at a time
        here = sorted((x for x in kept if x.bounds[j]), key=lambda x: x.bounds[j])
        reach = np.cumsum([x.bounds[j] for x in here])
        if not here or reach[-1] < least:
            continue
        first = int(np.searchsorted(reach, least))  # what only lists before this one hold cannot reach the best k
        dense = np.zeros(WINDOW, np.int64)
        for x in here[first:]:
            p, s = x.window(j)
            dense[p] += s
        found = np.flatnonzero(dense)
        got = dense[found]
        for i in range(first - 1, -1, -1):
            able = got + reach[i] >= least
            found, got = found[able], got[able]
            p, s = here[i].window(j)
            spot = np.minimum(np.searchsorted(p, found), len(p) - 1)
            got = got + np.where(p[spot] == found, s[spot], 0)
        able = got >= least
        if not able.any():
            continue
        at, score = np.concatenate([at, found[able] + j * WINDOW]), np.concatenate([score, got[able]])
        if len(at) > k:
            order = np.lexsort((place[at], -score))[:k]
            at, score = at[order], score[order]
        if len(at) == k:
            least = max(1, int(score.min()))
    return at, score


def _searcher(asked: dict[int | None, list[tuple[str, int]]], docs: int, total: int, k: int):
    """The search of one segment's lists for all items of a block."""
    weights = dict(x for terms in asked.values() for x in terms)
    out = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        terms = table["term"].to_pylist()
        own = terms.index(None)
        ids, n = table["ids"][own].values, table["tf"][own].values.to_numpy().astype(np.int64)
        m = 50 + (50 * n * docs) // total
        windows = -(-len(n) // WINDOW)
        number = ids.fill_null(0).to_numpy()
        place = np.empty(len(n), np.int64)
        place[np.lexsort((number, ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(n))
        lists = {}
        for i, t in enumerate(terms):
            if i == own:
                continue
            at, tf = table["at"][i].values.to_numpy().astype(np.int64), table["tf"][i].values.to_numpy().astype(np.int64)
            lists[t] = Postings(at, weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at])), windows)
        items, at, score = [], [], []
        for item, pairs in asked.items():
            a, s = best_of_segment([lists[t] for t, _ in pairs if t in lists], len(n), place, k)
            items += [item] * len(a)
            at.append(a)
            score.append(s)
        return pa.table([pa.array(items, pa.int64()), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(score))], schema=out)

    return search


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an item_id are one item."""
    lower = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def top_documents(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: of each item (item_id, text) the ``k`` highest-scoring documents of an index, score above 0.

    A term counts floor(1000 ln((2N+2)/(2df+1))) times its occurrences, damped
    by the text's length, in whole numbers. Ties go by ascending doc_id, null
    ids last. Each row of the index's documents is one document, so repeated
    rows are ranked one by one. An item without terms, or none that a document
    has, gets no row. Items are sent out in blocks of about PAIRS pairs of item
    and term; a block reads the lists of its terms alone. A segment gives at
    most ``k`` rows an item, and these are cut to ``k`` again before they are
    shuffled.
    """
    spark = index.sparkSession
    whole = index.where("term is null")
    size = whole.agg(F.sum("df").alias("docs"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total")).first()
    docs, total = size.docs or 0, size.total or 0
    pairs = item_terms(items)
    df = index.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    pairs = stored(pairs.join(df.select("term", weight.alias("w")).where("w > 0"), "term"), "lexical-items")
    blocks = max(1, -(-pairs.count() // PAIRS))
    found = None
    for b in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else pairs
        asked: dict[int | None, list[tuple[str, int]]] = {}
        for r in block.collect():
            asked.setdefault(r.item_id, []).append((r.term, r.w))
        lists = index.join(F.broadcast(block.select("term").distinct()), "term", "left_semi")  # at most a block's pairs
        rows = lists.select("seg", "term", "at", "tf", "ids").unionByName(whole.select("seg", "term", "at", "tf", "ids"))
        part = rows.groupBy("seg").applyInArrow(_searcher(asked, docs, total, k), "item_id long, doc_id long, score long") if asked else spark.createDataFrame([], "item_id long, doc_id long, score long")
        part = _ranked(part, k)
        part = stored(part, "lexical-found") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle() -> str:
    """The same over ``documents`` and ``benchmark`` as DuckDB SQL, k 50."""
    terms = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"
    return f"""
with docs as (select row_number() over () as r, doc_id, {terms} as t from documents where text is not null),
held as (select r, doc_id, len(t)::bigint as n from docs where len(t) > 0),
total as (select count(*)::bigint as nn, sum(n)::bigint as ll from held),
asked as (select distinct item_id, unnest({terms}) as term from benchmark),
post as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from docs) where term in (select term from asked) group by 1, 2),
weight as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, total group by term, nn),
score as (select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score from asked join post using (term) join weight using (term) join held using (r), total group by 1, 2, 3),
best as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from score where score > 0)
select item_id, rank, doc_id, score from best where rank <= 50
"""
