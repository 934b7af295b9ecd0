"""Training order and mixing: every sequence and row has one slot, records lie at their offset, sources keep to their shares."""

import collections
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, queries, tokenorder

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, slot long, record string, shard int, block string"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "word " * 60_000), (5, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, " \n\t ")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s" if i is not None and i % 2 else None, None, 5, "r", 7, "b") for i, t in rows], DOC)


def naive(blocks, shares):
    """Earliest deadline first, slot by slot over all blocks, in fractions; ends with the first source used up."""
    whole = sum(Fraction(x) for x in shares.values())
    done, out = dict.fromkeys(blocks, 0), []
    while True:
        t, ready = len(out), []
        for s, j in done.items():
            w = Fraction(shares[s]) / whole
            if (j / w).__floor__() <= t:
                ready.append((((j + 1) / w).__ceil__(), s))
        s = min(ready)[1]
        if done[s] == blocks[s]:
            return out
        done[s] += 1
        out.append(s)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1}, {"a": 7, "b": 7}, {str(i): i + 1 for i in range(12)}, {"x": 3**-0.5, "y": 7**-0.5, "z": 2**-0.5}])
def test_pfair_equals_a_naive_schedule(weights):
    blocks = dict.fromkeys(weights, 60)
    got = mixing.pfair(blocks, weights)
    first = [s for s, p in got if p == 0]
    assert first == naive(blocks, weights)
    assert collections.Counter(s for s, _ in got) == blocks


def test_deviation_stays_under_a_block_for_irrational_targets():
    weights = {"a": 3**-0.5, "b": 7**-0.5, "c": 2**-0.5}
    order = [s for s, p in mixing.pfair(dict.fromkeys(weights, 120_000), weights) if p == 0]
    assert len(order) > 240_000
    for s, w in weights.items():
        lead = np.cumsum(np.array(order) == s) - np.arange(1, len(order) + 1) * (w / sum(weights.values()))
        assert -1 < lead.min() and lead.max() < 1


def test_deviation_in_rows_of_larger_blocks():
    weights = {"a": 3**-0.5, "b": 7**-0.5, "c": 2**-0.5}
    counts = {"a": 100_000, "b": 90_001, "c": 70_777}
    spans, steps = mixing.timetable(counts, weights, blocks=1000, stretch=64)
    b = spans[0][4]
    assert b == 261
    end = max(x[3] + x[4] * b for x in steps if x[8] == 0)
    deal = mixing.dealer(counts, weights, blocks=1000, stretch=64)
    of = np.empty(sum(counts.values()), object)
    for s, n in counts.items():
        of[deal(s, np.arange(n))] = s
    assert end > 150_000 and None not in of
    for s, w in weights.items():
        lead = np.cumsum(of[:end] == s) - np.arange(1, end + 1) * (w / sum(weights.values()))
        assert -b < lead.min() and lead.max() < b
    # sources alternate by the row, not by the block
    assert all(len(set(of[i : i + 64])) == 3 for i in range(0, end, 64))


@pytest.mark.parametrize("counts", [{"a": 1000, "b": 37, "c": 5, "": 300}, {"a": 1}, {"a": 50, "b": 60}, {str(i): i for i in range(40)}])
def test_dealer_gives_each_slot_once(counts):
    for targets in ({s: n**0.5 for s, n in counts.items()}, dict.fromkeys(counts, 0.0), {s: float(i % 2) for i, s in enumerate(counts)}):
        deal = mixing.dealer(counts, targets, blocks=100, stretch=16)
        at = [deal(s, np.arange(n)) for s, n in counts.items() if n]
        assert sorted(np.concatenate(at).tolist()) == list(range(sum(counts.values())))


def test_mixing_rows(spark):
    df = docs(spark, [(i, "t") for i in range(3000)]).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") % 2 == 0, "b").otherwise(F.lit(None)))
    weights = {"hot": 2.0, "b": 1.0, "": 1.0}
    got = sorted(mixing.mix_sources(df, weights, blocks=600).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(3000)) and sorted(r.row.doc_id for r in got) == list(range(3000))
    deal = mixing.dealer({"hot": 2000, "b": 500, "": 500}, weights, blocks=600)
    want = {s: sorted(deal(s, np.arange(n)).tolist()) for s, n in (("hot", 2000), ("b", 500), ("", 500))}
    assert {s: [r.slot for r in got if r.source == s] for s in want} == want
    # a source that targets lack, or give nothing, follows when the others are used up
    late = sorted(mixing.mix_sources(df, {"hot": 1.0, "b": 0.0}).collect(), key=lambda r: r.slot)
    assert {r.source for r in late[:2000]} == {"hot"} and {r.source for r in late[2000:2010]} == {"b", ""}
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, {"hot": bad})


def test_mixing_odd_rows(spark):
    got = mixing.mix_sources(docs(spark, ODD)).collect()
    assert sorted(r.slot for r in got) == list(range(len(ODD))) and sorted(map(str, (r.row.doc_id for r in got))) == sorted(str(i) for i, _ in ODD)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    many = docs(spark, [(i, "t") for i in range(700)]).withColumn("source", F.col("doc_id").cast("string"))
    assert mixing.mix_sources(many).select("slot").distinct().count() == 700


def test_op8_has_every_row(spark):
    got = queries.op8_pfair_mixing(spark, DIR)
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert got.columns == ["doc_id", "source", "slot", "block", "phase"] and got.count() == n and got.agg(F.max("slot")).first()[0] == n - 1


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(tokenorder.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    assert (tokenorder.permute(np.arange(1000), 1000, 1) != tokenorder.permute(np.arange(1000), 1000, 2)).any()
    big = tokenorder.permute(np.arange(1000), (1 << 62) - 1, 3)
    assert len(set(big.tolist())) == 1000 and big.min() >= 0 and big.max() < (1 << 62) - 1


@pytest.mark.parametrize("n_high, low_bits", [(1, 1), (5, 3), (1, 6), (37, 2), (256, 4), (1000, 1)])
def test_wide_permutation_is_a_bijection(n_high, low_bits):
    every = np.arange(n_high << low_bits)
    left, right, half = tokenorder.permute_wide(every >> low_bits, every & ((1 << low_bits) - 1), n_high, low_bits, 5)
    assert sorted(((int(a) << half) | int(b)) for a, b in zip(left, right)) == every.tolist()
    other = tokenorder.permute_wide(every >> low_bits, every & ((1 << low_bits) - 1), n_high, low_bits, 6)
    assert len(every) < 20 or (other[0] != left).any() or (other[1] != right).any()


@pytest.mark.parametrize("n_high", [1, 2, 60_000, (1 << 62) + 5, 1 << 64])
def test_wide_places_spread_over_their_range(n_high):
    rng = np.random.default_rng(1)
    high = np.array([int(x) % n_high for x in rng.integers(0, 1 << 63, 4000)], np.uint64)
    low = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    left, right, half = tokenorder.permute_wide(high, low, n_high, 64, 2)
    cut = tokenorder._cut_bits(n_high)
    span = (((n_high << 64) - 1) >> cut) + 1
    places = [((int(a) << half) | int(b)) for a, b in zip(left, right)]
    order = tokenorder._above(left, right, half, cut).tolist()
    assert order == [p >> cut for p in places] and max(places) < n_high << 64 and span <= 1 << 62
    counts = np.bincount([o * 10 // span for o in order], minlength=10)
    assert len(counts) == 10 and counts.min() > 300


def sizes(spark, df):
    got = tokenorder.training_order(df, length=64, shard_rows=100).select("slot", "shard", "doc_id", "seq").collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    return got, collections.Counter(r.shard for r in got)


def test_ids_of_any_size_and_hot_ids_spread(spark):
    few = spark.range(3000).select(F.xxhash64("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got, by = sizes(spark, few)
    assert len(got) == 3000 and len(by) == 30 and max(by.values()) < 160
    edge = spark.createDataFrame([(-(1 << 63), "a"), ((1 << 63) - 1, "b"), (0, "c"), (None, "d"), (-(1 << 63), "d")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in sizes(spark, edge)[0]))) == sorted(map(str, [-(1 << 63), (1 << 63) - 1, 0, None, -(1 << 63)]))
    for hot in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        for text in (F.concat(F.lit("text "), "id"), F.lit("the same")):
            got, by = sizes(spark, spark.range(3000).select(hot.alias("doc_id"), text.alias("text")))
            assert len(got) == 3000 and len(by) == 30 and max(by.values()) < 160


def check_files(folder, rows, length):
    """Every record is at its offset of its shard's file, and slots number records shard after shard."""
    stride = 16 + 2 * length
    first = 0
    for s in sorted({r.shard for r in rows}):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.offset)
        (file,) = folder.glob(f"shard={s}/part-*")
        raw = file.read_bytes()
        assert len(raw) == stride * len(own) + 1
        for i, r in enumerate(own):
            head = np.frombuffer(raw[r.offset : r.offset + 16], tokenorder.HEADER)[0]
            assert r.offset == i * stride and r.slot == first + i and len(r.record) == 2 * length
            assert (None if head["none"] else head["doc_id"], head["seq"], head["n_tokens"]) == (r.doc_id, r.seq, r.n_tokens)
            assert raw[r.offset + 16 : r.offset + stride] == bytes(r.record)
        first += len(own)


@pytest.mark.parametrize("targets", [None, {"s": 2.0, "": 1.0}])
def test_records_lie_at_their_offset_and_hold_the_texts(spark, tmp_path, targets):
    rows = [*ODD, (11, "a\r\nb ☃ " * 500), (12, "Été  a b\n\n c 123 don't, stop")]
    path = str(tmp_path / "records")
    for _ in range(2):  # a second run overwrites
        tokenorder.write_training_order(docs(spark, rows), path, length=64, shard_rows=64, targets=targets)
    got = tokenorder.read_training_order(spark, path, 64).collect()
    assert len({r.shard for r in got}) > 3 and sorted(r.slot for r in got) == list(range(len(got)))
    check_files(tmp_path / "records", got, 64)
    bpe = tokenorder.Encoder(tokenorder.TOKENIZER).bpe
    parts = collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.record), "<u2").tolist()
        assert set(ids[r.n_tokens :]) <= {tokenorder.END}
        parts[r.doc_id].append((r.seq, ids[: r.n_tokens]))
    want = collections.defaultdict(list)
    for i, t in rows:
        ids = bpe.encode_ordinary(t or "") + [tokenorder.END]
        want[i] += [(j // 64, ids[j : j + 64]) for j in range(0, len(ids), 64)]
    assert {i: sorted(x) for i, x in parts.items()} == {i: sorted(x) for i, x in want.items()}
    # reading resumes at any slot
    for at in (0, 1, 70, len(got) - 1, len(got)):
        assert sorted(r.slot for r in tokenorder.read_training_order(spark, path, 64, at).collect()) == list(range(at, len(got)))


def test_order_does_not_depend_on_files(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    key = lambda f: sorted((r.slot, r.doc_id, r.seq) for r in f.select("slot", "doc_id", "seq").collect())
    one = key(tokenorder.training_order(d, shard_rows=50))
    assert one == key(tokenorder.training_order(d.repartition(7), shard_rows=50)) and one != key(tokenorder.training_order(d, shard_rows=50, key=2))
    ids = [i for _, i, _ in one]
    assert ids != sorted(ids) and abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.2


def test_no_rows_no_shards(spark):
    assert tokenorder.training_order(docs(spark, [])).count() == 0
    assert tokenorder.training_order(docs(spark, []), targets={}).count() == 0


def test_op1_and_the_pipeline_write_shards(spark):
    from corpusloom.plans.lineage import shared_dir

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = Path(shared_dir(spark).removeprefix("file:"))
    before = set(base.iterdir())
    got = queries.op1_training_order(spark, DIR).collect()
    (mine,) = [p for p in set(base.iterdir()) - before if p.name.startswith("training-shards")]
    check_files(mine, got, 512)
    got = corpus_pipeline.order_stage(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR).collect()
    (mine,) = [p for p in set(base.iterdir()) - before if p.name.startswith("pipeline-shards")]
    check_files(mine, got, 512)
