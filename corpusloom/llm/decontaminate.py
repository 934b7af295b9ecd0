"""Benchmark decontamination: latent semantic retrieval, then longest common subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textbytes as tb

#: Buckets that document frequencies are kept in, and columns of the TF-IDF matrix (words by hash).
BUCKETS, COLUMNS = 1 << 16, 1 << 14
PASSAGE = 48  # words in a row of A
HALF = 12  # words in a block; what is searched with is two blocks
WIDTH = 256  # columns of the random test matrix
RANK = 128  # latent dimensions
#: Columns that as many words of a slice have, but no more than DENSE of them, are multiplied as a dense matrix, STRETCH passages at a time.
OFTEN, DENSE, STRETCH = 24, 1024, 2048
_NONZERO = 4  # entries of a column's row of the test matrix
#: Items of fewer words are looked for as they stand; those of fewer than LEAST only as a whole text.
SHORT, LEAST = 8, 4
LEAKS = T.ArrayType(
    T.StructType().add("item_id", "long").add("cosine", "double").add("lcs", "long").add("item_words", "long").add("answer", "boolean").add("at_word", "long")
)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word: runs of letters and digits, A-Z as a-z."""
    _, _, row, h = tb.words(data, offsets, tb.BY_PUNCTUATION)
    return row, h


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _column(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


_SIGNS = tb.mix(np.arange(1, COLUMNS + 1, dtype=np.uint64))


def sketch(h: np.ndarray, idf: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Rows of A @ omega, one a group of words: omega has _NONZERO signs in each column's row, which follow from its number."""
    out = np.zeros(n * WIDTH)
    weight, signs, base = idf[_bucket(h)], _SIGNS[_column(h)], group * WIDTH
    for i in range(_NONZERO):
        part = signs >> np.uint64(9 * i)
        sign = 1.0 - 2.0 * ((part >> np.uint64(8)) & np.uint64(1)).astype(np.float64)
        out += np.bincount(base + (part & np.uint64(255)).astype(np.int64), weights=sign * weight, minlength=n * WIDTH)
    return out.reshape(n, WIDTH).astype(np.float32)


def _sums(table: np.ndarray, row: np.ndarray, weight: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Weighted sums of stretches of rows of a table, given where each starts; none is longer than ``size``."""
    stop = np.append(start[1:], len(row))
    at = start[:, None] + np.arange(size)
    inside = at < stop[:, None]
    at[~inside] = 0
    return ((weight[at] * inside)[:, None, :] @ table[row[at]])[:, 0]


def _blocks(row: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word, first block of each row and the end): rows are cut into blocks of ``words``."""
    cuts = np.searchsorted(row, np.arange(n + 1))
    per = -(-np.diff(cuts) // words)
    first = np.concatenate([[0], np.cumsum(per)])
    return first[row] + (np.arange(len(row)) - cuts[row]) // words, first


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that hold a word of each bucket; bucket -1 counts passages."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for a, b, data, offsets in tb.slices(batch.column(0)):
            row, h = _tokens(data, offsets)
            block, first = _blocks(row, b - a, PASSAGE)
            n += int(first[-1])
            key = np.sort(block * BUCKETS + _bucket(h))
            df += np.bincount(key[_starts(key)] & (BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[n], df[at]]))], names=["bucket", "n"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def _passages(batches: Iterator[pa.RecordBatch], limit: int = tb.SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes of words, passage of each, passages) a slice of texts; passages do not overlap here."""
    for batch in batches:
        for a, b, data, offsets in tb.slices(batch.column(0), limit):
            row, h = _tokens(data, offsets)
            group, first = _blocks(row, b - a, PASSAGE)
            yield h, group, int(first[-1])


def _gram(shared):
    """Y'Y over the rows Y = A omega (A's rows scaled so that Y's are units) of this partition's passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, out = shared.value, np.zeros((WIDTH, WIDTH))
        for h, group, n in _passages(batches):
            y = _unit(sketch(h, idf, group, n))
            out += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH)), pa.array([r.tobytes() for r in out], pa.binary())], names=["part", "sums"])

    return run


def _add_product(out: np.ndarray, q: np.ndarray, column: np.ndarray, weight: np.ndarray, group: np.ndarray) -> None:
    """Adds q'A to ``out``, A given by column and weight of each word of the groups.

    The commonest columns hold most words: they are a dense matrix, a stretch
    of groups at a time, and the words of the others are added one by one.
    """
    n = np.bincount(column, minlength=COLUMNS)
    dense = np.argsort(-n, kind="stable")[: min(DENSE, np.count_nonzero(n >= OFTEN))]
    place = np.full(COLUMNS, -1)
    place[dense] = np.arange(len(dense))
    at = place[column]
    words = np.flatnonzero(at >= 0)
    for lo in range(0, len(q) if len(dense) else 0, STRETCH):
        held = words[slice(*np.searchsorted(group[words], [lo, lo + STRETCH]))]
        part = q[lo : lo + STRETCH]
        a = np.bincount((group[held] - lo) * len(dense) + at[held], weights=weight[held], minlength=len(part) * len(dense))
        out[:, dense] += part.T @ a.reshape(len(part), len(dense)).astype(np.float32)
    words = np.flatnonzero(at < 0)
    column, weight, group = column[words], weight[words], group[words]
    for d, values in enumerate(np.ascontiguousarray(q.T, np.float64)):
        out[d] += np.bincount(column, weights=values[group] * weight, minlength=COLUMNS)


def _project(shared, parts: int):
    """B' = A'Q over this partition's passages, Q = Y turn, in ``parts`` stretches of A's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Emitted as 32-bit numbers; they are summed in 64."""
        idf, turn = shared.value
        out = np.zeros((turn.shape[1], COLUMNS), np.float32)
        for h, group, n in _passages(batches, 1 << 19):
            if not len(h):
                continue
            y = sketch(h, idf, group, n)
            size = np.maximum(np.linalg.norm(y, axis=1), 1e-12)
            q = (y / size[:, None]) @ turn
            # rows of A are scaled like those of Y
            _add_product(out, q, _column(h), idf[_bucket(h)] / size[group], group)
        out = np.ascontiguousarray(out.T)
        step = COLUMNS // parts
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts)), pa.array([out[i * step : (i + 1) * step].tobytes() for i in range(parts)], pa.binary())], names=["part", "sums"]
        )

    return run


def _adder(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the arrays of each part, in 64 bits, as they stream by; a task holds one a part and emits ``kind`` again."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(sums.as_buffer(), kind).astype(np.float64)
                total[part] = total[part] + x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.astype(kind).tobytes() for x in total.values()], pa.binary())], names=["part", "sums"])

    return run


class Space:
    """Weights of words, and the latent coordinates of each column: its right singular vectors, scaled."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray):
        self.idf, self.vectors = idf, vectors.astype(np.float32)

    def place(self, h: np.ndarray, group: np.ndarray, n: int, size: int) -> np.ndarray:
        """Coordinates of groups of words, each of at most ``size``."""
        out = np.zeros((n, self.vectors.shape[1]), np.float32)
        first = _starts(group)
        if len(first):
            out[group[first]] = _sums(self.vectors, _column(h), self.idf[_bucket(h)].astype(np.float32), first, size)
        return out


def _sum_parts(rows: DataFrame, parts: int, kind: type = np.float64) -> dict[int, np.ndarray]:
    """The sum of each part, whole: all rows of a part are in one task."""
    summed = rows.repartition(parts, "part").mapInArrow(_adder(kind), "part long, sums binary")
    return {part: np.frombuffer(bytes(x), kind) for part, x in summed.collect()}


def latent_space(docs: DataFrame, rank: int = RANK) -> Space:
    """Randomised SVD of the TF-IDF matrix A of all passages (48 words each) of all documents.

    Three distributed passes over all texts: document frequencies; the range
    of A, as Y = A omega with a sparse sign matrix omega of 256 columns, of
    which Y'Y gives the turn that makes Y's columns orthonormal, Q = Y turn;
    and the projection B = Q'A, whose singular value decomposition B = U S V'
    gives A's leading right singular vectors V. A text's latent coordinates
    are its TF-IDF row times V / S: words that occur in the same
    passages get near coordinates, and what all texts of a language share
    counts for no more than the rest. What comes to the driver has a fixed size (8 MB).
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    got = dict(text.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    n = got.pop(-1, 0)
    df = np.zeros(BUCKETS)
    for bucket, c in got.items():
        df[bucket] = c
    idf = np.log((n + 1.0) / (df + 1.0)) if n else np.ones(BUCKETS)
    gram = np.zeros((WIDTH, WIDTH))
    for part, x in _sum_parts(text.mapInArrow(_gram(spark.sparkContext.broadcast(idf)), "part long, sums binary"), 16).items():
        gram[part] = x
    power, turn = np.linalg.eigh(gram)
    power, turn = power[::-1][:rank], turn[:, ::-1][:, :rank]
    real = power > max(power[0], 1e-12) * 1e-9
    turn = (turn[:, real] / np.sqrt(power[real])).astype(np.float32)
    if not turn.shape[1]:
        return Space(idf, np.zeros((COLUMNS, 1)))
    parts = 64
    # a task emits 8 MB whatever it reads, so there are as many tasks as can run at once (twice that, to even out)
    few = text.coalesce(2 * spark.sparkContext.defaultParallelism)
    sums = _sum_parts(few.mapInArrow(_project(spark.sparkContext.broadcast((idf, turn)), parts), "part long, sums binary"), parts, np.float32)
    dims = turn.shape[1]
    b = np.empty((COLUMNS, dims), np.float32)
    inner = np.zeros((dims, dims))
    step = COLUMNS // parts
    for i in range(parts):
        rows = sums.pop(i).reshape(step, dims)
        b[i * step : (i + 1) * step] = rows
        inner += (wide := rows.astype(np.float64)).T @ wide
    power, left = np.linalg.eigh(inner)
    real = power > max(power[-1], 1e-12) * 1e-9
    value = np.sqrt(power[real])
    # V = B'U / S
    return Space(idf, b @ (left[:, real] / value / value).astype(np.float32))


def lcs_masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def lcs_length(masks: dict[int, int], m: int, other: list[int]) -> int:
    """Length of the longest common subsequence, 64 and more cells at a time in one integer."""
    full = v = (1 << m) - 1
    get = masks.get
    for w in other:
        x = get(w)
        if x:
            u = v & x
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _hashes(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _tokens(raw, np.array([0, len(raw)]))[1].tolist() if len(raw) else []


_LANES = np.arange(4, dtype=np.uint64)


def _marks(h: np.ndarray) -> np.ndarray:
    """A row of 256 bits, in four numbers, for each word: one bit is set."""
    bit = np.uint64(1) << ((h >> np.uint64(8)) & np.uint64(63))
    return np.where((h & np.uint64(3))[:, None] == _LANES, bit[:, None], np.uint64(0))


def _bits(marks: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(marks).view(np.uint8), axis=1)


class Items:
    """A block of benchmark items made ready for search."""

    def __init__(self, rows: list[tuple[object, str, str | None]], space: Space):
        self.ids, self.sizes, self.masks, self.answers, at = [], [], [], [], []
        #: of short items, by their number of words: hash of the sequence to (item, words)
        self.short: dict[int, dict[int, list[object]]] = {}
        for item, text, answer in rows:
            h = _hashes(text)
            if len(h) < SHORT:
                if h:
                    own = np.array(h, np.uint64)
                    self.short.setdefault(len(h), {}).setdefault(int(_runs(own, len(h))[0]), []).append(item)
                continue
            tail = _hashes(answer) if answer else _hashes(next((s for s in reversed(re.split(r"[.!?\n]+", text)) if _hashes(s)), ""))
            self.ids.append(item)
            self.sizes.append(len(h))
            self.masks.append(lcs_masks(h))
            self.answers.append((len(tail), lcs_masks(tail)))
            # a longer item is looked for by all its stretches of two blocks, the last of which ends with it
            own = np.array(h, np.uint64)
            starts = [*range(0, len(h) - 2 * HALF, 2 * HALF), max(0, len(h) - 2 * HALF)]
            at.append([(i, space.place(x := own[i : i + 2 * HALF], np.zeros(len(x), np.int64), 1, 2 * HALF)[0]) for i in starts])
        self.item_of = np.array([i for i, x in enumerate(at) for _ in x], np.int64)
        self.start = np.array([i for x in at for i, _ in x], np.int64)
        self.size_of = np.array(self.sizes, np.int64)
        self.counts = [{w: x.bit_count() for w, x in masks.items()} for masks in self.masks]
        self.words = [frozenset(x) for x in self.masks]
        #: words of each item by their bit, with repeats
        self.by_bit = np.zeros((len(self.ids), 256), np.float32)
        for i, x in enumerate(self.counts):
            if x:
                np.add.at(self.by_bit[i], _bits(_marks(np.array(list(x), np.uint64))).argmax(axis=1), list(x.values()))
        self.repeats = [m - len(x) for m, x in zip(self.sizes, self.words)]
        self.points = _unit(np.array([p for x in at for _, p in x], np.float32).reshape(-1, space.vectors.shape[1]))


    def possible(self, seen: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the stretches of blocks may hold ``least`` of an item's words, as the bits of their words, ``seen``, tell; none that does is left out."""
        ok = [np.zeros(0, np.int64)]
        for a in range(0, len(item), 2048):
            z = a + 2048
            met = _bits(np.bitwise_or.reduceat(seen, np.stack([lo[a:z], hi[a:z]], 1).ravel(), axis=0)[::2])
            ok.append(a + np.flatnonzero(np.einsum("ij,ij->i", met, self.by_bit[item[a:z]]) >= least[a:z]))
        return np.concatenate(ok)


def _runs(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of each m words that follow one another."""
    s = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        s = tb.mix(s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - m + 1 + i])
    return s


def _hit(item: object, cosine: float, lcs: int, words: int, answer: bool, at: int) -> dict:
    return {"item_id": item, "cosine": cosine, "lcs": lcs, "item_words": words, "answer": answer, "at_word": at}


def _short_hits(items: Items, h: np.ndarray) -> Iterator[dict]:
    """Short items whose words follow one another in a text (of fewer than LEAST words: are the text)."""
    for m, known in items.short.items():
        if len(h) < m or (m < LEAST and len(h) != m):
            continue
        got = _runs(h, m)
        for at in np.flatnonzero(np.isin(got, np.array(list(known), np.uint64))):
            for item in known[int(got[at])]:
                yield _hit(item, 1.0, m, m, True, int(at))


def _searcher(shared, cosine: float, share: float, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items = shared.value
        for batch in batches:
            key, before = batch.column(0), batch.column(1).to_pylist()
            found: list[list[dict]] = []
            for a, b, data, offsets in tb.slices(key.field("text").cast(pa.string())):
                hits: list[dict[object, dict]] = [{} for _ in range(b - a)]
                row, h = _tokens(data, offsets)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                if items.short:
                    for r in range(b - a):
                        for hit in _short_hits(items, h[cuts[r] : cuts[r + 1]]):
                            hits[r].setdefault(hit["item_id"], hit)
                if len(h) and len(items.ids):
                    block, first = _blocks(row, b - a, HALF)
                    sums = space.place(h, block, int(first[-1]), HALF)
                    whole = sums.copy()
                    whole[:-1] += sums[1:]
                    ends = first[1:][np.diff(first) > 0] - 1
                    whole[ends] = sums[ends]  # a row's last block stands alone
                    whole = _unit(whole)
                    words = h.tolist()
                    seen = np.bitwise_or.reduceat(_marks(h), _starts(block), axis=0)
                    seen = np.concatenate([seen, np.zeros((1, 4), np.uint64)])  # where the last range ends
                    for lo in range(0, len(whole), 2048):
                        cos = whole[lo : lo + 2048] @ items.points.T
                        cell = np.flatnonzero(cos.ravel() >= cosine)
                        (w, p), near_to = np.divmod(cell, cos.shape[1]), cos.ravel()[cell]
                        item = items.item_of[p]
                        order = np.lexsort((-near_to, item, w))
                        # of an item's stretches the nearest
                        order = order[_starts(w[order] * np.int64(len(items.ids)) + item[order])]
                        w, p, item, near_to = w[order] + lo, p[order], item[order], near_to[order]
                        r = np.searchsorted(first, w, "right") - 1
                        m = items.size_of[item]
                        # where the item would begin, and half of it more to either side
                        at = cuts[r] + (w - first[r]) * HALF - items.start[p]
                        start, stop = np.maximum(cuts[r], at - HALF - m // 2), np.minimum(cuts[r + 1], at + 2 * HALF + m + m // 2)
                        # the bits of the blocks around tell of most that too few of the item's words occur
                        ok = items.possible(seen, first[r] + (start - cuts[r]) // HALF, first[r] + (stop - 1 - cuts[r]) // HALF + 1, item, share * m)
                        r, item, near_to, start, stop = r[ok], item[ok], near_to[ok], start[ok], stop[ok]
                        for r, item, score, start, begin, stop in zip(r.tolist(), item.tolist(), near_to.tolist(), start.tolist(), cuts[r].tolist(), stop.tolist()):
                            m, near = items.sizes[item], words[start:stop]
                            # no subsequence is longer than the item's words that occur at all, with their repeats
                            met, least = items.words[item].intersection(near), share * m
                            if len(met) + items.repeats[item] < least or sum(map(items.counts[item].__getitem__, met)) < least:
                                continue
                            n = lcs_length(items.masks[item], m, near)
                            if n < share * m or ((known := hits[r].get(items.ids[item])) and known["lcs"] >= n):
                                continue
                            size, masks = items.answers[item]
                            answer = size > 0 and lcs_length(masks, size, near) >= sure * size
                            if answer or n >= sure * m:
                                hits[r][items.ids[item]] = _hit(items.ids[item], round(score, 6), n, m, bool(answer), start - begin)
                found += [[v for _, v in sorted(x.items())] for x in hits]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("answer", pa.bool_()), ("at_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([key, pa.array([x + y for x, y in zip(before, found)], kind)], names=["key", "leaks"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, share: float = 0.6, sure: float = 0.75, item_block: int = 16384, space: Space | None = None) -> DataFrame:
    """Rows of ``docs`` with ``leaks`` added: the benchmark items whose text, whole or reworded, they hold.

    Each stretch of a text (two blocks of 12 words, stepping one block, so
    whole texts are covered) whose latent cosine with one of an item reaches
    ``cosine`` is a candidate; its words and those around it must share a
    common subsequence of ``share`` of the item's words, and either the item's answer (column
    ``answer`` if there is one, else its last sentence) by ``sure`` of its
    words, or ``sure`` of the whole item.

    Items of fewer than SHORT words, too short for a subsequence to say
    anything, are found where all their words follow one another; those of
    fewer than LEAST only where they are the whole text. Items without words
    are found nowhere.

    Items are sent out in blocks of about ``item_block``; a block takes a pass
    over the texts. Null and empty texts leak nothing; an empty benchmark or
    corpus leaks nothing; rows that repeat get a row each. Other columns pass
    through; one named ``leaks`` is replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "leaks"]
    if space is None:
        space = latent_space(docs)
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    asked = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    blocks = max(1, -(-asked.count() // item_block))
    found = docs.select(F.struct(*kept).alias("key"), F.array().cast(LEAKS).alias("leaks"))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast((space, Items([tuple(r) for r in rows], space)))
        # what earlier blocks found travels with the row
        found = found.mapInArrow(_searcher(shared, cosine, share, sure), found.schema)
    return found.select(*[F.col("key")[c].alias(c) for c in kept], "leaks")
