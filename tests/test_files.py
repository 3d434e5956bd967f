"""File sources/sinks (S1-S11) and the monitor runner."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textdrift.sources import files as fs


def test_metrics_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="td-files-")
    path = os.path.join(d, "m.csv")
    with open(path, "w") as fh:
        fh.write(",".join(fs.METRIC_FILE_COLUMNS) + "\n")
        fh.write("0,1,33.8,25000.5,0.5,9.1,0.41,0.2,0.39,0.45\n")
    df = fs.read_metrics(spark, path)
    r = df.first()
    assert r.Generation == 0 and r.Run == 1 and r["3gram_Diversity"] == 25000.5
    out = os.path.join(d, "matrix")
    fs.write_matrix(df.drop("Generation", "Run"), out, header=False, digits=6)
    back = fs.read_matrix(spark, out, 8).first()
    assert back.c0 == 33.8 and back.c7 == 0.45


def test_read_first_existing(spark):
    d = tempfile.mkdtemp(prefix="td-files-")
    good = os.path.join(d, "ok.csv")
    with open(good, "w") as fh:
        fh.write("a\n1\n")
    df = fs.read_first_existing(spark, [os.path.join(d, "missing.csv"), good], header=True)
    assert df.count() == 1
    with pytest.raises(FileNotFoundError):
        fs.read_first_existing(spark, [os.path.join(d, "x.csv"), os.path.join(d, "y.csv")])


def test_append_metrics_partitioned(spark):
    d = tempfile.mkdtemp(prefix="td-files-")
    df = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0)], "Generation int, Run int, METEOR double")
    fs.append_metrics(df, os.path.join(d, "flat"))
    fs.append_metrics(df, os.path.join(d, "flat"))
    assert spark.read.parquet(os.path.join(d, "flat")).count() == 4
    fs.append_metrics(df, os.path.join(d, "part"), partitioned=True)
    back = spark.read.parquet(os.path.join(d, "part"))
    assert "scored_at" in back.columns and back.count() == 2


def test_text_records_default_input(spark):
    d = tempfile.mkdtemp(prefix="td-files-")
    spark.createDataFrame([(1, "hello")], "id long, generated_text string").write.parquet(d + "/t")
    df = fs.read_text_records(spark, d + "/t")
    assert df.first().input_text == ""


def test_run_monitor_writes_alerts(spark):
    from textdrift.plans.monitor_queries import EVENT_RULES
    from textdrift.streaming.monitor import run_monitor
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("double")
    obs = stream.select("event_id", "ts", F.col("user_id").alias("Run"),
                        F.lit(0).alias("Generation"), F.col("value").alias("Perplexity"),
                        F.col("value").alias("Diversity"), (k / 100.0).alias("HighFreq"),
                        (F.col("value") / 50.0).alias("METEOR"))
    d = tempfile.mkdtemp(prefix="td-mon-")
    q = run_monitor(obs, EVENT_RULES, d + "/alerts", d + "/ckpt", available_now=True)
    q.awaitTermination()
    alerts = spark.read.parquet(d + "/alerts/alerts")
    suggestions = spark.read.parquet(d + "/alerts/suggestions")
    assert alerts.count() > 0 and suggestions.where("target is null").count() == 0
    assert {r.seq for r in alerts.collect()} == {r.seq for r in suggestions.collect()}
