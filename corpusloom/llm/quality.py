"""Quality classifier: supervised subword embeddings trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb

GRAMS = (2, 3, 4)
BITS = 16
_MULT = np.uint32(0x9E3779B1)
#: Tables for bytes.translate: 1 for white space; all white space as one code.
_GAP = bytes(bool(x) for x in tb.SPACE)
_CODE = bytes(32 if tb.SPACE[i] else i for i in range(256))
_AGAIN = 1  # feature of every word that repeats the one before it: the word bigrams of that kind share a vector
_EMPTY = 0  # feature that every document has, so that an empty text has one too


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature: each word, each doubled word, and each 2- to 4-byte gram of a word with its end marks.

    A gram may have white space (or the text's edge) only as its first or last
    byte. Letter case is kept: it tells shouted text from prose.
    """
    n = len(data)
    rows, ids = [np.arange(len(offsets) - 1)], [np.full(len(offsets) - 1, _EMPTY, np.int64)]
    if n:
        shift = np.uint32(32 - BITS)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        raw = data.tobytes()
        code = np.frombuffer(raw.translate(_CODE), np.uint8).astype(np.uint32)
        gap = np.frombuffer(raw.translate(_GAP), np.uint8)
        gaps = np.concatenate([[0], np.cumsum(gap, dtype=np.int32)])
        h = code * _MULT
        for size in range(2, max(GRAMS) + 1):
            if n < size:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULT + code[size - 1 :]
            if size not in GRAMS:
                continue
            m = n - size + 1
            good = row[:m] == row[size - 1 :]
            if size > 2:
                good &= gaps[size - 1 : size - 1 + m] == gaps[1 : 1 + m]  # none inside
            good &= (gap[:m] & gap[size - 1 :]) == 0
            at = np.flatnonzero(good)
            x = h[at] * _MULT
            ids.append(((x ^ (x >> np.uint32(13))) * _MULT >> shift).astype(np.int64))
            rows.append(row[at])
        _, _, word_row, word = tb.words(data, offsets)
        ids.append((word >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(word_row)
        again = np.flatnonzero((word[1:] == word[:-1]) & (word_row[1:] == word_row[:-1])) + 1
        ids.append(np.full(len(again), _AGAIN, np.int64))
        rows.append(word_row[again])
    return np.concatenate(rows), np.concatenate(ids)


def fit(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Margin of label 1 over label 0 for each feature bucket.

    A document is the average of its feature vectors, softmax over two output
    rows on top, plain SGD with a rate that falls to nothing. As the output is
    linear in the average, a bucket's part of the logit is one number, and
    that is what scoring needs.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    emb = ((rng.random((size, dim)) - 0.5) / dim).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bags = []
    # short slices: the arrays of a slice take some hundred bytes for each of its bytes
    for a, b, data, offsets in tb.slices(pa.array(texts, pa.string()), 1 << 17):
        row, ids = features(data, offsets)
        order = np.argsort(row, kind="stable")
        ids, cuts = ids[order], np.searchsorted(row[order], np.arange(b - a + 1))
        for i in range(b - a):
            u, c = np.unique(ids[cuts[i] : cuts[i + 1]], return_counts=True)
            bags.append((u.astype(np.int32), (c / c.sum()).astype(np.float32)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            u, w = bags[i]
            hidden = w @ emb[u]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            lr = rate * (1 - done / steps)
            grad = out @ p
            out -= lr * np.outer(hidden, p)
            # the vectors of a long average move little each; fastText moves each by the whole gradient
            emb[u] -= lr * np.minimum(1.0, w * len(u))[:, None] * grad
            done += 1
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float64)


def _scorer(margin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = margin.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if m is not None:
                for a, b, data, offsets in tb.slices(batch.column(1)):
                    row, ids = features(data, offsets)
                    total = np.bincount(row, weights=m[ids], minlength=b - a)
                    z = np.clip(total / np.bincount(row, minlength=b - a), -500, 500)
                    scores[a:b] = 1.0 / (1.0 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["key", "score"])

    return run


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The margins as one binary, in the order of hash that ``training_rows`` gives; nothing without rows."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, labels).tobytes()], pa.binary())], names=["margin"])


def learn(docs: DataFrame, labels: DataFrame, sample: int) -> np.ndarray | None:
    """``fit`` on ``training_rows``, in one task: the driver gets the margins (0.5 MB), not the texts. None without rows.

    A lost executor costs one more fit; the rows and their order, and so the margins, stay the same.
    """
    rows = training_rows(docs, labels, sample).select("text", "quality").coalesce(1)
    got = rows.mapInArrow(_fitter, "margin binary").collect()
    return np.frombuffer(bytes(got[0]["margin"])) if got else None


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, quality of at most ``sample`` labelled documents whose crc32(doc_id) mod 4 is not 2, by hash order."""
    ids = labels.where("doc_id is not null and quality in (0, 1)").where("crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "quality").limit(sample)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, keep: float = 0.7) -> DataFrame:
    """Rows of ``docs`` with held_out, score and predicted added; learns from ``labels`` (doc_id, quality).

    ``sample`` bounds the labelled rows that one task learns from (the
    first by hash of doc_id); scoring covers every row and whole texts. Null
    and empty texts get the score of a document without words. Without any
    usable label every score is 0.5. Rows that repeat get a row each; columns
    of ``docs`` other than text and doc_id pass through, save those named
    like the added ones, which are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    keyed = docs.select(F.struct(*kept).alias("key"), F.col("text").cast("string").alias("body"))
    scored = keyed.mapInArrow(_scorer(shared), keyed.select("key").schema.add("score", "double"))
    return scored.select(
        *[F.col("key")[c].alias(c) for c in kept],
        F.coalesce(F.expr("crc32(cast(key.doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= keep).cast("int").alias("predicted"),
    )
