"""Training order: token ids in fixed-length sequences, a keyed permutation for their slots, fixed-stride shards."""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from corpusloom.llm import textbytes as tb
from corpusloom.plans.lineage import shared_dir, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
SLOT_ROUNDS = 6
#: The split that byte-level BPE of this kind is defined by (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII's common five; texts with any are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


class Encoder:
    """Byte-level BPE over many texts at once.

    Texts are cut where the split pattern always cuts: before the single space
    (or after the other white space) that a word follows. Each distinct piece
    of a slice is encoded once, most of them in one string, and the ids are
    gathered by piece.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(1 << 16, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start of every piece, ascending; pieces tile the bytes and never cross rows."""
        gap = tb.SPACE[data]
        cut = np.zeros(len(data), bool)
        word = ~gap
        word[1:] &= gap[:-1]  # first byte of a word after white space
        at = np.flatnonzero(word)
        at = at[at > 0]
        blank = data[at - 1] == 32
        cut[at[~blank]] = True  # after other white space
        cut[at - 1] = True  # the run's last byte parts from the run
        run = gap.copy()
        run[1:] &= ~gap[:-1]
        cut[np.flatnonzero(run)] = True  # a run of white space begins
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[first] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, where each row's ids begin and the end)."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        starts = self.pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        key = tb.spans_hash(data, starts, ends)
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        a, b = starts[one], ends[one]
        # words led by one space can be encoded end to end: the split pattern parts them before the space
        led = (data[a] == 32) & (b - a > 1)
        led[led] = ~tb.SPACE[data[a[led] + 1]]
        size = (b - a)[led]
        upto = np.cumsum(size)
        at = np.repeat(a[led] - (upto - size), size) + np.arange(int(size.sum()))
        run = np.array(self.bpe.encode_ordinary(data[at].tobytes().decode("utf-8", "replace")), np.uint16)
        cut = np.searchsorted(np.cumsum(self.lengths[run]), upto) + 1
        raw = data.tobytes()
        rest = [self.bpe.encode_ordinary(raw[x:y].decode("utf-8", "replace")) for x, y in zip(a[~led].tolist(), b[~led].tolist())]
        sizes, base = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        sizes[led] = np.diff(cut, prepend=0)
        base[led] = cut - sizes[led]
        sizes[~led] = np.fromiter(map(len, rest), np.int64, len(rest))
        base[~led] = len(run) + np.cumsum(sizes[~led]) - sizes[~led]
        flat = np.concatenate([run, np.fromiter((t for x in rest for t in x), np.uint16, int(sizes[~led].sum()))])
        n = sizes[back]
        ends_at = np.cumsum(n)
        take = np.repeat(base[back] - (ends_at - n), n) + np.arange(int(n.sum()))
        cuts = np.concatenate([[0], ends_at])[np.searchsorted(starts, offsets)]
        return flat[take], cuts

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.uint16)


#: Bytes before the ids of a record: doc_id, number of the sequence in its document, real ids, 1 if doc_id is null.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("n_tokens", "<u2"), ("none", "<u2")])


def _sequences(encoder: Encoder, texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, number, ids) of each sequence of each text."""
    for a, b, data, offsets in tb.slices(texts, 1 << 20):
        ids, cuts = encoder.encode(data, offsets)
        for r in range(b - a):
            own = ids[cuts[r] : cuts[r + 1]]
            piece = data[offsets[r] : offsets[r + 1]]
            if (piece >= 128).any() or ((piece >= 28) & (piece < 32)).any():
                s = piece.tobytes().decode("utf-8", "replace")
                if _ODD_SPACE.search(s):
                    own = encoder.whole(s)
            own = np.append(own, np.uint16(END)).astype("<u2")
            for j in range(0, len(own), length):
                yield a + r, j // length, own[j : j + length]


def permute(index: np.ndarray, n: int, key: int, rounds: int = SLOT_ROUNDS) -> np.ndarray:
    """A keyed bijection of 0..n-1: Feistel rounds over the next even power of two, walked until inside."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (tb.mix(right + k) & low)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (out >= n).any():
        outside = out >= n
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _above(left: np.ndarray, right: np.ndarray, half: int, bits: int) -> np.ndarray:
    """The number of halves left and right without its lowest ``bits``; what is left has at most 64."""
    if bits >= half:
        return left >> np.uint64(bits - half) if bits - half < 64 else np.zeros_like(left)
    return (left << np.uint64(half - bits)) | (right >> np.uint64(bits))


def permute_wide(high: np.ndarray, low: np.ndarray, n_high: int, low_bits: int, key: int, rounds: int = SLOT_ROUNDS) -> tuple[np.ndarray, np.ndarray, int]:
    """``permute`` of high * 2**low_bits + low, high under ``n_high``, low of ``low_bits``: (left, right, half), halves of numbers up to 128 bits."""
    half = max(1, -(-((n_high - 1).bit_length() + low_bits) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 63, rounds, dtype=np.uint64)
    high, low = high.astype(np.uint64), low.astype(np.uint64)
    left = high >> np.uint64(half - low_bits) if half >= low_bits else (high << np.uint64(low_bits - half)) | (low >> np.uint64(half))
    right = ((high << np.uint64(low_bits)) | low) & mask if low_bits < 64 else low & mask

    def once(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in keys:
            left, right = right, left ^ (tb.mix(right + k) & mask)
        return left, right

    left, right = once(left, right)
    while len(out := np.flatnonzero(_above(left, right, half, low_bits) > np.uint64(n_high - 1))):
        left[out], right[out] = once(left[out], right[out])
    return left, right, half


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


#: Bits of a row's tie and of a sequence's number in the permutation's domain.
_TIE, _SEQ = 32, 32


def _cut_bits(n_high: int) -> int:
    """Lowest bits of a place that its order leaves out, so that it fits a long."""
    return 2 * -(-((n_high - 1).bit_length() + _TIE + _SEQ) // 2) - 62


def _placer(path: str, length: int, low: int, n_high: int, key: int):
    """Sequences with their order: the top bits of the permuted (doc_id - low, tie, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cut = Encoder(path), _cut_bits(n_high)
        for batch in batches:
            docs, tie = batch.column(0), batch.column(2).to_numpy().astype(np.uint64)
            # differences modulo 2**64 are right for any two longs
            own = docs.fill_null(low).to_numpy().astype(np.uint64) - np.uint64(low % (1 << 64))
            ids = docs.to_pylist()
            rows: list[tuple] = []

            def out() -> pa.RecordBatch:
                at, j = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64)
                left, right, half = permute_wide(own[at], (tie[at] << np.uint64(_SEQ)) | j, n_high, _TIE + _SEQ, key)
                order = _above(left, right, half, cut).astype(np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary()), pa.array(order)],
                    names=["doc_id", "seq", "n_tokens", "ids", "order"],
                )

            for row, j, own_ids in _sequences(encoder, batch.column(1), length):
                rows.append((row, j, len(own_ids), own_ids.tobytes()))
                if len(rows) == 2048:
                    yield out()
                    rows.clear()
            yield out()

    return run


def _sequencer(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), Counter()
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        names = ["doc_id", "seq", "n_tokens", "ids", "source", "part", "i"]
        for batch in batches:
            docs, sources = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple] = []
            for row, j, ids in _sequences(encoder, batch.column(1), length):
                source = sources[row]
                rows.append((docs[row], j, len(ids), ids.tobytes(), source, part, seen[source]))
                seen[source] += 1
                if len(rows) == 2048:
                    yield _table(rows, names, types)
                    rows.clear()
            yield _table(rows, names, types)

    return run


def _placed(docs: DataFrame, key: int, length: int, shard_rows: int, tokenizer: str) -> tuple[DataFrame, int]:
    """(shard, order, doc_id, seq, n_tokens, ids) of every sequence, the permutation taken over (doc_id, tie, number).

    The tie is a hash of the text, so rows that share a doc_id, or have none,
    lie apart; rows that are equal altogether take one from their place in the
    input besides. The places of the permutation that no sequence has are left
    out: a shard is a range of places, and slots follow from the counts of shards.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.isnull("doc_id"), text).alias("h"), F.monotonically_increasing_id().alias("at"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    # 32 bytes a row: what repeats, and the whole's size
    held = stored(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.sum(1 + F.floor(size / (4 * length))).alias("about")), "rows")
    every = held.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("about").alias("n")).first()
    low = every["low"] or 0
    n_high = (every["high"] or 0) - low + 1
    shards = max(1, -(-(every["n"] or 0) // shard_rows))
    # a table of its own, so that its size is known before the join: texts are shuffled only if it is large
    repeats = stored(held.where("n > 1").select(F.col("doc_id").alias("d"), F.col("h").alias("g")), "repeats")
    marked = rows.join(repeats, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    tie = F.when(F.col("g").isNotNull(), F.xxhash64("h", "at")).otherwise(F.col("h")).bitwiseAND(F.lit((1 << _TIE) - 1))
    placed = marked.select("doc_id", "text", tie.alias("tie")).mapInArrow(_placer(tokenizer, length, low, n_high, key), "doc_id long, seq int, n_tokens int, ids binary, order long")
    span = (((n_high << (_TIE + _SEQ)) - 1) >> _cut_bits(n_high)) + 1
    return placed.withColumn("shard", F.expr(f"cast(order div {-(-span // shards)} as int)")), shards


def _dealt(docs: DataFrame, key: int, length: int, shard_rows: int, tokenizer: str, targets: Mapping[str, float]) -> tuple[DataFrame, int]:
    """The same with a source's sequences permuted among themselves and slots dealt to sources by the Pfair schedule."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    table = stored(rows.mapInArrow(_sequencer(tokenizer, length), "doc_id long, seq int, n_tokens int, ids binary, source string, part long, i long"), "sequences", compression="zstd")
    sizes = table.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("source", "part", (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    counts = mixing.source_counts(table)
    deal = mixing.dealer(counts, {s: targets.get(s, 0.0) for s in counts})
    keys = {s: key + at for at, s in enumerate(sorted(counts))}

    @F.pandas_udf("long")
    def slot(source: pd.Series, index: pd.Series) -> pd.Series:
        out = np.zeros(len(index), np.int64)
        for s, at in source.groupby(source).indices.items():
            out[at] = deal(s, permute(index.to_numpy()[at], counts[s], keys[s]))
        return pd.Series(out)

    # one row for each source and scan task, so the sequences need no shuffle here
    placed = table.join(F.broadcast(starts), ["source", "part"]).withColumn("order", slot("source", F.col("base") + F.col("i")))
    shards = max(1, -(-sum(counts.values()) // shard_rows))
    return placed.select(F.expr(f"cast(order div {shard_rows} as int)").alias("shard"), "order", "doc_id", "seq", "n_tokens", "ids"), shards


def _packer(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, its records end to end) for rows in the order of shards."""
        shard, parts = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["shard", "value"])

        pad = np.full(length, END, "<u2").tobytes()
        for batch in batches:
            heads = np.zeros(batch.num_rows, HEADER)
            heads["doc_id"] = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            heads["seq"], heads["n_tokens"] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            heads["none"] = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for s, head, ids in zip(batch.column(0).to_pylist(), heads, batch.column(4)):
                if s != shard and parts:
                    yield row()
                    parts = []
                shard = s
                ids = ids.as_py()
                parts += [head.tobytes(), ids, pad[len(ids) :]]
        if parts:
            yield row()

    return run


def write_training_order(docs: DataFrame, path: str, key: int = 1, length: int = 512, shard_rows: int = 16384, tokenizer: str = TOKENIZER, targets: Mapping[str, float] | None = None) -> None:
    """Every sequence of every row of ``docs`` in training order, as files ``path``/shard=N/part-*.

    A document's token ids and an end mark are cut into sequences of
    ``length``. A record is a HEADER and the sequence's ids as little-endian
    16-bit numbers, filled up with end marks: 16 + 2 * ``length`` bytes for
    every record, without separators, so record i of a shard begins at i times
    that. (One newline ends a file.) Slots number the records from 0, shard
    after shard; ``read_training_order`` resumes at any of them.

    A keyed Feistel permutation with cycle walking scatters the sequences.
    Without ``targets`` it permutes all triples of doc_id (any long, null is
    the smallest), hash of the text and sequence number, whatever files the
    rows lie in; a shard is one range partition of its places, with about
    ``shard_rows`` records. Only where rows repeat, their places follow from
    where they lie in the input, so that copies lie apart. With ``targets`` (a weight for each value of
    ``source``, "" for null) a source's sequences, numbered as they are read,
    are permuted among themselves, and the Pfair schedule of ``mixing`` deals
    the slots to the sources; each shard but the last has ``shard_rows``
    records.

    A null or empty text is one sequence that holds the end mark. Rows that
    repeat have their own sequences; an empty table writes no shard. Other
    columns are ignored. The tokenizer file must be readable on every executor.
    """
    placed, shards = _placed(docs, key, length, shard_rows, tokenizer) if targets is None else _dealt(docs, key, length, shard_rows, tokenizer, targets)
    ordered = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order", "doc_id", "seq", "ids")
    packed = ordered.select("shard", "doc_id", "seq", "n_tokens", "ids").mapInArrow(_packer(length), "shard int, value binary")
    # the cast keeps the bytes as they are, and the text writer writes a string's bytes
    packed.select("shard", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy("shard").text(path)


def _reader(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = HEADER.itemsize + 2 * length
        record = np.dtype([("head", HEADER), ("ids", f"V{2 * length}")])
        for batch in batches:
            for shard, base, skip, content in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                raw = content.as_buffer()
                every = np.frombuffer(raw, record, (len(raw) - 1) // stride)
                for at in range(skip, len(every), 4096):
                    part = every[at : at + 4096]
                    i = np.arange(at, at + len(part))
                    head = part["head"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(base + i), pa.array(np.full(len(i), shard, np.int32)), pa.array(i * stride), pa.array(head["doc_id"], mask=head["none"] == 1),
                            pa.array(head["seq"].astype(np.int32)), pa.array(head["n_tokens"].astype(np.int32)), pa.array([x.tobytes() for x in part["ids"]], pa.binary()),
                        ],
                        names=["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "record"],
                    )

    return run


def read_training_order(spark: SparkSession, path: str, length: int = 512, first_slot: int = 0) -> DataFrame:
    """slot, shard, offset, doc_id, seq, n_tokens, record (the ids' bytes) of the records from ``first_slot`` on.

    A record begins at ``offset`` of its shard's file; shards before
    ``first_slot`` are not read. A task holds one shard. A folder without
    shards gives no rows.
    """
    stride = HEADER.itemsize + 2 * length
    kind = "slot long, shard int, offset long, doc_id long, seq int, n_tokens int, record binary"
    # a folder without any shard has no column for it
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:
        return spark.createDataFrame([], kind)
    files = files.withColumn("shard", F.col("shard").cast("int"))
    held = files.select("shard", F.expr(f"(length - 1) div {stride}").alias("n"))
    # one row a shard, a millionth of the records' bytes
    starts = held.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"), "n").where(F.col("base") + F.col("n") > first_slot)
    rows = files.join(F.broadcast(starts), "shard").select("shard", "base", F.greatest(F.lit(0).cast("long"), F.lit(first_slot) - F.col("base")).alias("skip"), "content")
    return rows.mapInArrow(_reader(length), kind)


def training_order(docs: DataFrame, label: str = "training-shards", length: int = 512, **options: object) -> DataFrame:
    """The rows of ``read_training_order`` after ``write_training_order`` to a folder of its own in the shared folder."""
    path = f"{shared_dir(docs.sparkSession)}/{label}-{uuid.uuid4().hex}"
    write_training_order(docs, path, length=length, **options)
    return read_training_order(docs.sparkSession, path, length)
