"""A stored inverted index of a table's texts, searched instead of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusloom.functions import text as X
from corpusloom.operators.kept import Kept
from corpusloom.plans.lineage import stored


def words_of(c: Column | str) -> Column:
    """Lower-case words of letters and digits without diacritics, in order."""
    return F.filter(F.split(F.lower(X.folded(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def posting_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, pos, size): where each token stands, and how many the text has."""
    d = docs.select(key, words_of(text).alias("_w"))
    return d.select(key, F.size("_w").alias("size"), F.posexplode("_w").alias("pos", "token"))


def _pieces(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows, of one row or at most so many words."""
    a, held = 0, 0
    for z, n in enumerate(sizes.tolist()):
        if z > a and held + n > most:
            yield a, z
            a, held = z, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def _lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, words, as lists of (token, at)."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, z in _pieces(sizes):
            part, n = batch.slice(a, z - a), sizes[a:z]
            held = part.column(part.num_columns - 1).flatten().dictionary_encode()
            k, ends = max(1, len(held.dictionary)), np.cumsum(n)
            of = np.repeat(np.arange(z - a), n) * k + held.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            of, place = of[order], (np.arange(len(of)) - np.repeat(ends - n, n))[order]
            new = np.flatnonzero(np.diff(of, prepend=-1))
            at = pa.ListArray.from_arrays(pa.array(np.append(new, len(of)), pa.int32()), pa.array(place, pa.int32()))
            pairs = pa.StructArray.from_arrays([held.dictionary.take(pa.array(of[new] % k)), at], names=["token", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new] // k, np.arange(z - a + 1)), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "lists"])


def with_lists(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with the array ``words`` replaced by ``lists``: (token, at) of each of its words, ``at`` its places in order.

    Made row by row, without a shuffle of words.
    """
    rest = [c for c in rows.columns if c != words]
    kind = StructType([*rows.select(*rest).schema, StructField("lists", ArrayType(StructType().add("token", "string").add("at", ArrayType(IntegerType()))))])
    return rows.select(*rest, words).mapInArrow(_lister, kind)


def list_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, size, at): the same by text and token, ``at`` the places in order."""
    d = docs.select(key, words_of(text).alias("_w"))
    d = with_lists(d.select(key, F.size("_w").alias("size"), "_w"), "_w")
    return d.select(key, "size", F.explode("lists").alias("_l")).select(key, "_l.token", "size", "_l.at")


def spread(lists: DataFrame) -> DataFrame:
    """A row for each place of the lists, as ``pos``."""
    return lists.select(*[c for c in lists.columns if c != "at"], F.explode("at").alias("pos"))


def _vocabulary(lists: DataFrame) -> DataFrame:
    """Of each bucket and token: texts that hold it, places, the most in one text, the first place."""
    n = F.size("at").cast("long")
    return lists.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"), F.sum(n).alias("n"), F.max(n).alias("most"), F.min(F.get("at", F.lit(0))).cast("long").alias("first"))


def _totals(lists: DataFrame) -> DataFrame:
    """Of each bucket: texts that have words, and words."""
    return lists.groupBy("bucket").agg(F.count_if(F.get("at", F.lit(0)) == 0).alias("docs"), F.sum(F.size("at")).alias("words"))


def kept_index(base: str, key: str, text: str, version: str | None = None, buckets: int = 16) -> Kept:
    """Lists of places in buckets of the document, inside a bucket by token; vocabulary and totals of each bucket."""
    return Kept(
        base, key, text,
        {"lists": lambda docs: list_rows(docs, key, text)},
        {"vocabulary": ("lists", _vocabulary), "totals": ("lists", _totals)},
        {"lists": ["token", key], "vocabulary": ["token"]}, version, buckets,
        {"postings": ("lists", spread)},
    )


@dataclass(frozen=True)
class TextIndex:
    """An index as it stands: lists (token, key, size, at), vocabulary, totals, and the texts it was made of."""

    key: str
    text: str
    texts: DataFrame
    lists: DataFrame
    vocabulary: DataFrame
    totals: DataFrame

    def where(self, rows: str) -> TextIndex:
        """The index of the texts whose key fits a condition; its counts are of these alone, its vocabulary stays that of all."""
        held = self.lists.where(rows)
        totals = held.where("at[0] = 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"))
        return replace(self, texts=self.texts.where(rows), lists=held, totals=totals)


def index_texts(docs: DataFrame, key: str, text: str) -> TextIndex:
    """An index of ``docs`` for the searches of one query: its lists are stored once, its counts made from them when they are asked for."""
    rows = docs.select(key, text)
    lists = stored(list_rows(rows, key, text), "lists")
    flat = lists.withColumn("bucket", F.lit(0))
    return TextIndex(key, text, rows, lists, _vocabulary(flat).drop("bucket"), _totals(flat).drop("bucket"))


def open_index(kept: Kept, docs: DataFrame) -> TextIndex:
    lists, vocabulary, totals = (kept.read(docs, t).drop("bucket") for t in ("lists", "vocabulary", "totals"))
    return TextIndex(kept.key, kept.text, docs, lists, vocabulary, totals)
