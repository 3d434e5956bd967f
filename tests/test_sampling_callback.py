"""Samples by geometric skips (M4, L6) and a user's function as a source (F2)."""

import json
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textdrift.operators.corpus import bootstrap_weights, taken_by
from textdrift.plans.monitor_queries import EVENT_RULES
from textdrift.sources.callback import callback_source, read_callback
from textdrift.streaming import monitor as mon

OBS = "event_id long, ts timestamp, Run long, Generation int, Perplexity double, HighFreq double, Diversity double, METEOR double"


def test_each_sample_takes_its_share(spark):
    rows, samples = 20_000, 40
    df = spark.range(rows, numPartitions=4)
    for p in (0.004, 0.1, 0.7):
        got = df.select("id", F.explode(taken_by("id", samples, p, 3)).alias("s")).toPandas()
        assert not got.duplicated().any() and got.s.between(0, samples - 1).all()
        share = got.groupby("s").size().reindex(range(samples), fill_value=0).to_numpy() / rows
        assert abs(share - p).max() < 5 * math.sqrt(p * (1 - p) / rows)
        assert abs(share.mean() - p) < 5 * math.sqrt(p * (1 - p) / rows / samples)
        if p == 0.1:  # neighbouring samples are independent of each other
            taken = np.zeros((rows, samples))
            taken[got.id, got.s] = 1
            assert abs(np.corrcoef(taken.T)[np.triu_indices(samples, 1)]).max() < 5 / math.sqrt(rows)
    assert df.select(F.sum(F.size(taken_by("id", samples, 1.0))).alias("n")).first().n == rows * samples
    assert df.select(F.sum(F.size(taken_by("id", samples, 0.0))).alias("n")).first().n == 0


def test_bootstrap_weights_are_poisson(spark):
    df = spark.range(2000).withColumn("x.y", F.lit(1))
    w = bootstrap_weights(df, 20, "id", 1)
    assert w.columns == ["id", "x.y", "replicate", "weight"]
    counts = w.groupBy("weight").count().toPandas().set_index("weight")["count"] / 40_000
    for k in (1, 2, 3):
        want = math.exp(-1) / math.factorial(k)
        assert abs(counts[k] - want) < 5 * math.sqrt(want / 40_000)
    assert counts.index.min() == 1


def _observations():
    rng = np.random.default_rng(6)
    return [{"event_id": i, "ts": f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "Run": i % 2, "Generation": i, "Perplexity": 1.0,
             "HighFreq": float(rng.integers(0, 40)), "Diversity": float(rng.integers(0, 4)) / 2,
             "METEOR": None if i % 9 == 0 else float(rng.integers(0, 3)) / 50, "further": "x"} for i in range(90)]


def test_callback_stream_equals_replay(spark, tmp_path):
    folder = tmp_path / "polls"
    folder.mkdir()
    where, rows = str(folder), _observations()

    def poll(feed, number):
        with open(f"{where}/{number}.json") as f:
            found = [r | {"ts": pd.Timestamp(r["ts"], tz="UTC")} for r in json.load(f) if r["Run"] == feed]
        if number == 1:
            return pd.DataFrame(found)
        return None if not found else found[0] if len(found) == 1 else found

    source = callback_source(poll, lambda: len(os.listdir(where)), OBS, feeds=2, name="polled_metrics")
    assert read_callback(spark, source).count() == 0
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for number, part in enumerate((rows[:40], rows[40:70], rows[70:71], rows[71:])):
            (folder / f"{number}.json").write_text(json.dumps(part))
            out = mon.monitor_stream(read_callback(spark, source, stream=True), EVENT_RULES)
            q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
            assert q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    table = read_callback(spark, source)
    assert table.columns == [c.split()[0] for c in OBS.split(", ")]
    assert [r.event_id for r in table.orderBy("event_id").collect()] == list(range(90))
    columns = ["event_id", "seq", "hist_len", "warning_count", "status", "Diversity_change", "relation_residual"]
    plain = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()])
    assert plain(spark.read.schema(out.schema).parquet(str(tmp_path / "out"))) == plain(mon.monitor_replay(table, EVENT_RULES))
