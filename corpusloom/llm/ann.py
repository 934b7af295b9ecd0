"""Nearest neighbours: score-aware four-bit codes, table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import stored

CENTRES = 16


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Which rows hold a vector that takes part; their values, end to end; their lengths."""
    keep, parts = np.zeros(len(column), bool), []
    for i, v in enumerate(column):
        if not v.is_valid:
            continue
        x = v.values
        if not len(x) or x.null_count:
            continue
        x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
        if np.isfinite(x).all() and x.any():
            keep[i] = True
            parts.append(x)
    return keep, np.concatenate(parts) if parts else np.zeros(0), [len(p) for p in parts]


class Quantiser:
    """Product quantiser of unit vectors, 16 centres a subspace, with the anisotropic loss.

    The error of a code counts more along the vector than across it:
    loss = |r|^2 + (eta - 1) * (r . x)^2 for residual r of unit vector x. That
    ties the subspaces together, so codes are chosen by coordinate descent and
    centres by solving the weighted normal equations.
    """

    def __init__(self, dim: int, width: int = 2, threshold: float = 0.2):
        self.dim, self.width = dim, width
        self.parts = -(-dim // width)
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.centres = np.zeros((self.parts, CENTRES, width))

    def split(self, x: np.ndarray) -> np.ndarray:
        """Unit rows, padded with zeros, as (rows, parts, width)."""
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        full = np.zeros((len(x), self.parts * self.width))
        full[:, : self.dim] = unit
        return full.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        s = self.split(x)
        across = ((s[:, :, None, :] - self.centres[None]) ** 2).sum(-1)
        along = np.einsum("npw,npkw->npk", s, s[:, :, None, :] - self.centres[None])
        code = across.argmin(-1)
        n = np.arange(len(s))
        if self.eta > 1:
            total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
            for _ in range(sweeps):
                for p in range(self.parts):
                    rest = total - along[n, p, code[:, p]]
                    cost = across[:, p] + (self.eta - 1) * (rest[:, None] + along[:, p]) ** 2
                    code[:, p] = cost.argmin(-1)
                    total = rest + along[n, p, code[:, p]]
        return code.astype(np.uint8)

    def fit(self, x: np.ndarray, rounds: int = 8, seed: int = 5) -> "Quantiser":
        rng = np.random.default_rng(seed)
        s = self.split(x)
        pick = rng.choice(len(s), CENTRES, replace=len(s) < CENTRES)
        self.centres = s[pick].transpose(1, 0, 2).copy() + rng.normal(0, 1e-4, self.centres.shape)
        for _ in range(rounds):
            code = self.encode(x, 1)
            got = self.centres[np.arange(self.parts)[None], code]
            along = ((s - got) * s).sum(-1)
            total = along.sum(1)
            for p in range(self.parts):
                rest = total - along[:, p]
                for k in range(CENTRES):
                    at = code[:, p] == k
                    if not at.any():
                        self.centres[p, k] = s[rng.integers(len(s)), p]
                        continue
                    v = s[at, p]
                    left = at.sum() * np.eye(self.width) + (self.eta - 1) * v.T @ v
                    right = (v * (1 + (self.eta - 1) * (rest[at] + (v * v).sum(1)))[:, None]).sum(0)
                    self.centres[p, k] = np.linalg.solve(left, right)
                total = rest + ((s[:, p] - self.centres[p, code[:, p]]) * s[:, p]).sum(1)
                along[:, p] = total - rest
        return self

    def pack(self, code: np.ndarray) -> np.ndarray:
        if self.parts % 2:
            code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], 1)
        return code[:, 0::2] | code[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, pairs, 256) part scores of each packed byte."""
        lut = np.einsum("qpw,pkw->qpk", self.split(queries), self.centres)
        if self.parts % 2:
            lut = np.concatenate([lut, np.zeros((len(lut), 1, CENTRES))], 1)
        low, high = lut[:, 0::2], lut[:, 1::2]
        return (low[:, :, None, :] + high[:, :, :, None]).reshape(len(lut), lut.shape[1] // 2, 256).astype(np.float32)


def _encoder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = model.value
        for batch in batches:
            keep, flat, sizes = _usable(batch.column(1))
            same = np.array(sizes, int) == q.dim
            keep[np.flatnonzero(keep)[~same]] = False
            x = flat.reshape(-1, q.dim) if same.all() else np.concatenate([p for p, ok in zip(np.split(flat, np.cumsum(sizes)[:-1]), same) if ok] or [np.zeros(0)]).reshape(-1, q.dim)
            code = q.pack(q.encode(x)) if len(x) else np.zeros((0, -(-q.parts // 2)), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "code", "vector"]
            )

    return run


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal rows give equal values."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _searcher(shared, k: int, rerank: int, block: int = 2048):
    """Scans the codes of a partition for a block of queries; exact scores for the best ``rerank`` and all that tie with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, vectors = shared.value
        lut = q.tables(vectors)
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                vec = rows.column(0).to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(len(vec), -1)
                x = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.float64).reshape(len(vec), -1)
                for a in range(0, len(ids), 64):
                    score = np.zeros((min(64, len(ids) - a), len(vec)), np.float32)
                    for p in range(lut.shape[1]):
                        score += lut[a : a + 64, p][:, code[:, p]]
                    n = min(rerank, len(vec))
                    edge = np.partition(score, len(vec) - n, axis=1)[:, len(vec) - n]
                    for i in range(len(score)):
                        near = np.flatnonzero(score[i] >= edge[i])
                        near = near[vec[near] != ids[a + i]]
                        exact = cosine(x[near], vectors[a + i])
                        order = np.lexsort((vec[near], -exact))[:k]
                        best[a + i] = sorted(best[a + i] + [(-exact[o], int(vec[near[o]])) for o in order])[:k]
        out = [(int(i), v, -s) for i, b in zip(ids, best) for s, v in b]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, sample: int = 20_000, width: int = 2) -> tuple[DataFrame, Quantiser | None]:
    """(vec_id, code, vector) of every row that takes part, and the quantiser.

    Codebooks are fitted on the first ``sample`` rows by hash of vec_id (a
    fixed bound); every row is coded. Rows whose vector is null, zero, or holds
    a null or non-finite component take no part, nor do rows whose length is
    not the commonest length of the sample.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    _, flat, sizes = _usable(picked)
    if not sizes:
        return spark.createDataFrame([], "vec_id long, code binary, vector binary"), None
    dim = int(np.bincount(sizes).argmax())
    x = np.concatenate([p for p in np.split(flat, np.cumsum(sizes)[:-1]) if len(p) == dim]).reshape(-1, dim)
    model = Quantiser(dim, width).fit(x)
    coded = rows.mapInArrow(_encoder(spark.sparkContext.broadcast(model)), "vec_id long, code binary, vector binary")
    return stored(coded, "ann-index"), model


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 40, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by cosine of each row whose vec_id is a multiple of ``every``.

    Queries go out in blocks of at most ``query_block`` vectors, one pass over
    the codes a block, so what is broadcast has a fixed bound. Each partition
    keeps its exact best ``k`` of the ``rerank`` best codes in each stretch of
    2048 rows (and of all that tie with the last of them); the best ``k`` over
    partitions are returned, ties to the smaller vec_id, fewer where there are
    fewer candidates. Rows that repeat a vec_id are candidates each, but no
    candidate of a query with that id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    index, model = build_index(vectors)
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    if model is not None:
        asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "vector").dropDuplicates(["vec_id"])
        blocks = max(1, -(-asked.count() // query_block))
        for b in range(2 * blocks if blocks > 1 else 1):
            part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks)) == b)
            got = part.orderBy("vec_id").collect()
            if not got:
                continue
            shared = spark.sparkContext.broadcast((model, np.array([r[0] for r in got]), np.frombuffer(b"".join(bytes(r[1]) for r in got)).reshape(len(got), -1)))
            out = out.union(index.mapInArrow(_searcher(shared, k, rerank), "query_id long, vec_id long, score double"))
    top = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("rank", "t")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t")["vec_id"].alias("vec_id"), (-F.col("t")["s"]).alias("score")
    )
