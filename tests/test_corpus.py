"""Corpus tools: block packing, sampling, mixing, bootstrap weights."""

import math

from pyspark.sql import functions as F

from textdrift.operators import corpus as cp


def _ids(spark, rows):
    return spark.createDataFrame(rows, "id long, toks array<string>")


def test_pack_blocks_drops_remainder(spark):
    toks = [str(i) for i in range(130)]
    df = _ids(spark, [(1, toks[:70]), (2, toks[70:])])
    out = cp.pack_blocks(df, block=64, batch_size=1000, tokens=F.col("toks")).orderBy("block").collect()
    assert [len(r.input_ids) for r in out] == [64, 64]          # 130 tokens: 2 blocks, 2 dropped
    assert out[0].input_ids == toks[:64] and out[1].input_ids == toks[64:128]
    assert out[0].labels == out[0].input_ids and sum(out[0].attention_mask) == 64


def test_pack_blocks_short_batch_kept(spark):
    df = _ids(spark, [(5, [str(i) for i in range(40)])])
    out = cp.pack_blocks(df, block=64, tokens=F.col("toks")).collect()
    assert len(out) == 1 and len(out[0].input_ids) == 40


def test_pack_blocks_batches_are_separate(spark):
    a = [f"a{i}" for i in range(60)]
    b = [f"b{i}" for i in range(70)]
    df = _ids(spark, [(999, a), (1000, b)])       # two batches of 1000 ids
    out = cp.pack_blocks(df, block=64, tokens=F.col("toks")).orderBy("batch").collect()
    assert [(r.batch, len(r.input_ids)) for r in out] == [(0, 60), (1, 64)]


def test_sample_is_reproducible_and_whole_when_n_le_0(spark):
    df = spark.range(500).withColumnRenamed("id", "id")
    a = [r.id for r in cp.sample_texts(df, 50, seed=7).collect()]
    b = [r.id for r in cp.sample_texts(df, 50, seed=7).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 50
    assert cp.sample_texts(df, 0).count() == 500


def test_mix_is_complementary(spark):
    df = spark.range(2000)
    mixed = cp.mix_corpora(df, df, ratio=0.3, seed=1)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts["original"] + counts["generated"] == 2000   # same ids: buckets split them
    assert abs(counts["original"] / 2000 - 0.3) < 0.05


def test_bootstrap_weights_are_poisson(spark):
    df = spark.range(2000)
    w = cp.bootstrap_weights(df, 5, "id", seed=3)
    per_rep = w.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()
    for r in per_rep:
        assert abs(r.s - 2000) < 5 * math.sqrt(2000)
    share_zero = 1 - w.filter("replicate = 1").count() / 2000
    assert abs(share_zero - math.exp(-1)) < 0.04


def test_kfold_covers_all_rows(spark):
    df = spark.range(900)
    f = cp.kfold(df, 3, "id").groupBy("fold").count().collect()
    assert sorted(r.fold for r in f) == [0, 1, 2] and sum(r["count"] for r in f) == 900


def test_pack_blocks_equals_concatenation(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, [f"t{i}_{k}" for k in range(rnd.choice([0, 1, 5, 63, 64, 65, 200]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, toks array<string>")
    got = {(r["batch"], r["block"]): r["input_ids"]
           for r in cp.pack_blocks(df, block=64, batch_size=20, tokens=F.col("toks")).collect()}
    want = {}
    for b in range(3):
        flat = [t for _, toks in rows[20 * b:20 * b + 20] for t in toks]
        want |= {(b, k): flat[64 * k:64 * k + 64] for k in range(len(flat) // 64)}
    assert got == want
