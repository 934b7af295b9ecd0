"""What the mix stage decides, the order stage does."""

import pytest
from pyspark.sql import functions as F


def test_the_mixture_decides_the_order(spark):
    pipe = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"some words of text {i}", "a" if i % 10 else "b") for i in range(400)] + [(400, "more", None), (400, "more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = pipe.mix_stage(spark, docs, "")
    assert sorted((r.doc_id, r.text, r.source or "") for r in mixed.collect()) == sorted((i, t, s or "") for i, t, s in rows)

    def early(d):
        got = pipe.order_stage(spark, d, "").collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        return sum(1 for r in got if r.slot < 80 and r.doc_id < 400 and r.doc_id % 10 == 0)

    assert early(mixed) >= 15  # sqrt(40) to sqrt(360): a quarter of the first slots
    assert early(docs) < 15  # a tenth, without the mixture
    assert early(mixed.withColumn("mix_share", F.when(F.col("source") == "b", 0.0).otherwise(F.col("mix_share")))) == 0  # other targets, another order
