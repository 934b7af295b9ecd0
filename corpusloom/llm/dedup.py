"""Near-duplicate groups: b-bit MinHash, bands, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textbytes as tb
from corpusloom.operators.components import connected_components
from corpusloom.plans.lineage import cut, stored

_SEED = 91


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words count as one shingle."""
    if not len(h):
        return h
    n = min(k, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
            s ^= s >> np.uint64(29)
        return np.unique(tb.mix(s))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    text = batch.column(batch.schema.get_field_index("text"))
    for a, b, data, offsets in tb.slices(text):
        _, _, row, h = tb.words(data, offsets)
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, shingle_hashes(h[cuts[i] : cuts[i + 1]], k)


def _signer(k: int, bands: int, rows: int):
    """mapInArrow function: texts to set identity, band keys and packed two-bit minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(_SEED)
        m = bands * rows
        mul = rng.integers(1, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, m, dtype=np.uint64)
        salt = rng.integers(1, 1 << 63, bands, dtype=np.uint64)
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("lo", "hi", "n", "bands", "bits")}
            for _, s in _sets(batch, k):
                out["n"].append(len(s))
                if not len(s):
                    for c in ("lo", "hi", "bands", "bits"):
                        out[c].append(None)
                    continue
                low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
                for x in range(0, len(s), 2048):
                    part = mul[:, None] * s[None, x : x + 2048]
                    part += add[:, None]
                    np.minimum(low, part.min(axis=1), out=low)
                # the low bits of a multiply-shift hash are weak: the minima are mixed before bits are kept
                low = tb.mix(low)
                key = salt.copy()
                for r in range(rows):
                    key = tb.mix(key ^ low.reshape(bands, rows)[:, r])
                two = (low & np.uint64(3)).astype(np.uint8)
                packed = np.zeros(-(-m // 32) * 32, np.uint8)
                packed[:m] = two
                four = packed.reshape(-1, 4)
                byte = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
                out["bits"].append(byte.astype(np.uint8).view(np.int64).tolist())
                out["bands"].append(key.view(np.int64).tolist())
                out["lo"].append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                out["hi"].append(int(tb.mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["hi"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64())), pa.array(out["bits"], pa.list_(pa.int64()))],
                names=["doc_id", "n", "lo", "hi", "bands", "bits"],
            )

    return run


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), lo and hi (128-bit identity of the set), bands (keys), bits (two bits of each minimum)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signer(k, bands, rows), "doc_id long, n long, lo long, hi long, bands array<long>, bits array<long>"
    )


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [s.tobytes() for _, s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "members"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sizes of intersection and union of each row's sets x and y, and which members of y (by rank, 64 a long) x has."""
    for batch in batches:
        both, either, inside = [], [], []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            has = np.zeros(-(-len(y) // 64) * 64, bool)
            has[at[y[at] == x]] = True
            n = int(has.sum())
            both.append(n)
            either.append(len(x) + len(y) - n)
            inside.append(np.packbits(has).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64()), pa.array(inside, pa.list_(pa.int64()))], names=["a", "b", "both", "either", "inside"]
        )


def estimate(x: str, y: str, minima: int) -> F.Column:
    """Jaccard estimate from two packed signatures: bit counts of equal two-bit cells, corrected for chance (1/4)."""
    low = 0x5555555555555555
    diff = F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    unequal = F.aggregate(
        F.transform(diff, lambda d: F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(low)))), F.lit(0), lambda s, c: s + c
    )
    same = F.lit(1.0) - unequal / F.lit(float(minima))
    return (same - 0.25) / 0.75


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, member) for each member of each set."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(ids), 256):
            sets = [np.frombuffer(m.as_buffer(), np.int64) for m in batch.column(1)[a : a + 256]]
            owner = np.repeat(ids[a : a + 256], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(sets), pa.int64())], names=["doc_id", "member"])


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, members (sorted 64-bit hashes) of the documents in ``ids``, stored."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    return stored(wanted.mapInArrow(_set_rows(k), "doc_id long, members binary"), "sets")


def close(classes: DataFrame, pairs: DataFrame, percent: int, minima: int, margin: float) -> DataFrame:
    """Of the pairs (a, b), those that set sizes and two-bit estimates do not rule out, cut off from their lineage.

    The estimate rules a pair out when it lies more than ``margin`` (about six
    standard deviations) below the threshold.
    """
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    return cut(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(estimate("bits_a", "bits_b", minima) >= percent / 100 - margin)
        .select("a", "b")
    )


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """both, either and inside (see _overlap) of the full sets of each pair (a, b)."""
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return full.mapInArrow(_overlap, "a long, b long, both long, either long, inside array<long>")


def linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, margin: float = 0.3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Texts are cut into words at ASCII white space with A-Z lower-cased; a
    document's set holds its distinct ``k``-word shingles (a shorter text is
    one shingle). Two documents are linked when 100 * intersection >=
    ``percent`` * union; component_id is the smallest doc_id reachable.

    Rows with equal sets are one class, so copies never make pairs. Classes
    that share a band are compared first with the smallest of the bucket and
    joined into components; then, in buckets that still hold several
    components, each class outside the largest one is compared with all
    classes of other components. So every pair that shares a band is either
    compared or already joined. With 24 bands of 4 minima a pair at 0.8
    shares no band with probability 3e-6.

    A null or empty text has no shingles and links with nothing. A null
    doc_id stays alone: component_id null, kept false. doc_id is meant to be a
    key; whole rows that repeat are copies of one node. Other columns are ignored.
    """
    minima = bands * rows
    signed = stored(signatures(docs, k, bands, rows), "signed")
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = stored(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = cut(banded.join(sizes, "key"))
    # a bucket is headed by the class that shares most bands with others: the text that copies were made from, if it is there
    degree = shared.groupBy("rep").agg(F.sum("c").alias("degree"))
    ranked = shared.join(degree, "rep").select("key", "rep", F.struct((-F.col("degree")).alias("d"), "rep").alias("order"))
    heads = ranked.groupBy("key").agg(F.min("order").alias("head")).select("key", F.col("head.rep").alias("head"))
    crowded = cut(shared.select("key", "rep").join(heads, "key"))
    stars = crowded.where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    near = close(classes, stars, percent, minima, margin)
    ids = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    tried = cut(compare(near, sets_of(docs, ids, k)))
    links = linked(tried, percent)
    labels = connected_components(links, "a", "b")

    # what the heads have not settled: buckets that still hold several components
    named = crowded.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "head", F.coalesce("component", "rep").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", "c").alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", "main")
    open_rows = cut(named.join(mixed, "key"))
    sets = sets_of(docs, open_rows.select(F.col("rep").alias("doc_id")).distinct(), k)
    # two texts share what both share with the head, and beyond that no shingle that one of them has alone
    alone = sets.select("doc_id", "members").distinct().mapInArrow(_each, "doc_id long, member long").groupBy("member").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"))
    own = alone.where("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    facts = classes.select("rep", "n").join(own, "rep", "left").select("rep", "n", F.coalesce("own", F.lit(0)).alias("own"))
    of_head = tried.select(F.col("a").alias("rep"), F.col("b").alias("head"), "both", "inside")
    open_rows = cut(open_rows.join(facts, "rep").join(of_head, ["rep", "head"], "left"))
    side = lambda c: open_rows.select(F.col("key").alias(f"key_{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("rep", "comp", "n", "own", "both", "inside")])
    could = lambda shared: 100 * shared >= percent * (F.col("n_p") + F.col("n_q") - shared)
    first = F.least(F.col("n_p") - F.col("own_p"), F.col("n_q") - F.col("own_q"))
    through_head = F.aggregate(F.zip_with("inside_p", "inside_q", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda x, y: x + y)
    beside_head = F.least(F.col("n_p") - F.col("both_p") - F.col("own_p"), F.col("n_q") - F.col("both_q") - F.col("own_q"))
    met = (F.col("key_p") == F.col("key_q")) & (F.col("comp_p") != F.col("comp_q")) & could(first) & F.coalesce(could(through_head + beside_head), F.lit(True))
    outside = side("p").join(mixed.withColumnRenamed("key", "key_p"), "key_p").where("comp_p <> main").drop("main")
    rest = outside.join(side("q"), met).select(F.greatest("rep_p", "rep_q").alias("a"), F.least("rep_p", "rep_q").alias("b")).distinct()
    known = tried.select(F.greatest("a", "b").alias("ta"), F.least("a", "b").alias("tb"))
    rest = rest.join(known, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
    more = cut(linked(compare(close(classes, rest, percent, minima, margin), sets), percent))
    if not more.isEmpty():
        labels = connected_components(links.union(more), "a", "b")

    ids = classes.select("lo", "hi", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("lo", "hi", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(ids, ["lo", "hi"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
