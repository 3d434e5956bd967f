"""Monitor replay against a pandas restatement of the polling loop, and the
streaming monitor against the replay (R3, R7, W5-W8)."""

import os
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textdrift.plans.monitor_queries import EVENT_RULES
from textdrift.sources.tables import events_observations
from textdrift.streaming import monitor as mon
from textdrift.streaming.rules import MonitorRules, merge_config

SF = "/root/testdata/sf0.001"


def brute_force(pdf: pd.DataFrame, rules: MonitorRules) -> list:
    """Row-by-row restatement: keep the last W rows, pct_change by Run
    inside the history, z-score + least squares for rule 6."""
    W = rules.history_window
    hist = pd.DataFrame()
    out = []
    for _, row in pdf.iterrows():
        hist = pd.concat([hist, row.to_frame().T], ignore_index=True).iloc[-W:].reset_index(drop=True)
        for c in ("Diversity", "HighFreq"):
            hist[c] = hist[c].astype(float)
        fired = []
        if len(hist) >= 2:
            last = hist.iloc[-1]
            dch = hist.groupby("Run")["Diversity"].pct_change().iloc[-1]
            hch = hist.groupby("Run")["HighFreq"].pct_change().iloc[-1]
            if last["HighFreq"] > rules.highfreq_threshold:
                fired.append(1)
            if last["Diversity"] < rules.diversity_threshold:
                fired.append(2)
            if last["METEOR"] < rules.meteor_threshold:
                fired.append(3)
            if not pd.isna(dch) and abs(dch) > rules.diversity_change_threshold:
                fired.append(4)
            if not pd.isna(hch) and abs(hch) > rules.highfreq_change_threshold:
                fired.append(5)
            if len(hist) >= 10:
                x, y = hist["HighFreq"].to_numpy(float), hist["Diversity"].to_numpy(float)
                zx = (x - x.mean()) / (x.std() if x.std() > 0 else 1.0)
                zy = (y - y.mean()) / (y.std() if y.std() > 0 else 1.0)
                A = np.column_stack([zx, np.ones_like(zx)])
                coef = np.linalg.lstsq(A, zy, rcond=None)[0]
                res = zy[-1] - (coef[0] * zx[-1] + coef[1])
                if abs(res) > rules.relation_residual_threshold:
                    fired.append(6)
        out.append(",".join(map(str, fired)))
    return out


def test_replay_matches_brute_force(spark):
    obs = events_observations(spark, SF)
    pdf = obs.toPandas().sort_values(["ts", "event_id"]).reset_index(drop=True)
    expected = brute_force(pdf, EVENT_RULES)
    for chunk in (50, 100_000):
        got = mon.monitor_replay(obs, EVENT_RULES, chunk=chunk)
        got = got.withColumn("fired", mon.fired_rules(got)).orderBy("seq").select("fired").toPandas()
        assert got["fired"].tolist() == expected


def test_sticky_status_across_chunks(spark):
    obs = events_observations(spark, SF)
    small = mon.monitor_replay(obs, EVENT_RULES, chunk=30).orderBy("seq").select("status", "level")
    big = mon.monitor_replay(obs, EVENT_RULES, chunk=100_000).orderBy("seq").select("status", "level")
    assert small.collect() == big.collect()
    rows = big.collect()
    status = "normal"
    for r in rows:
        if r.level is not None:
            status = r.level
        assert r.status == status


def test_stream_equals_replay(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    src = tempfile.mkdtemp(prefix="td-stream-src-")
    for i, part in enumerate(np.array_split(ev, 3)):
        path = os.path.join(src, f"part-{i}.parquet")
        part.to_parquet(path, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    k = F.get_json_object("props", "$.k").cast("double")
    obs = stream.select("event_id", "ts", F.col("user_id").alias("Run"),
                        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("Generation"),
                        (F.col("value") * k).alias("Perplexity"), F.col("value").alias("Diversity"),
                        (k / 100.0).alias("HighFreq"), (F.col("value") / 50.0).alias("METEOR"))
    out = mon.monitor_stream(obs, EVENT_RULES)
    sink = tempfile.mkdtemp(prefix="td-stream-out-")
    q = (out.writeStream.format("parquet").option("path", sink + "/o")
         .option("checkpointLocation", sink + "/c").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(sink + "/o").orderBy("seq").select("seq", "fired", "status").collect()
    rep = mon.monitor_replay(events_observations(spark, SF), EVENT_RULES)
    rep = rep.withColumn("fired", mon.fired_rules(rep)).orderBy("seq").select(
        "seq", "fired", "status").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in rep]


def _naive_residual(x, y, i, window):
    lo = max(0, i - window + 1)
    vx, vy = np.array(x[lo:i + 1]), np.array(y[lo:i + 1])
    sx = 0.0 if len(set(vx[~np.isnan(vx)])) < 2 else np.nanstd(vx)
    sy = 0.0 if len(set(vy[~np.isnan(vy)])) < 2 else np.nanstd(vy)
    both = ~np.isnan(vx) & ~np.isnan(vy)
    cov = np.mean((vx[both] - vx[both].mean()) * (vy[both] - vy[both].mean())) if both.any() else np.nan
    rho = cov / (sx * sy) if sx * sy > 0 and both.any() else 0.0
    return (vy[-1] - np.nanmean(vy)) / (sy or 1.0) - rho * (vx[-1] - np.nanmean(vx)) / (sx or 1.0)


def test_rolling_residuals_match_a_loop(monkeypatch):
    from textdrift.streaming import rolling
    monkeypatch.setattr(rolling, "STEP", 7)
    rng = np.random.default_rng(0)
    for gaps in (0.0, 0.3, 0.9):
        x, y = rng.normal(size=60).round(1), rng.normal(size=60).round(1)
        x[20:45], y[30:60] = 0.1, 0.3  # stretches without variance
        x[rng.random(60) < gaps] = np.nan
        y[rng.random(60) < gaps] = np.nan
        got = rolling.relation_residuals(x, y, 15, 20)
        with np.errstate(all="ignore"):
            want = [_naive_residual(x, y, i, 20) for i in range(15, 60)]
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_carried_equals_a_loop(spark):
    from textdrift.streaming.carry import carried
    rng = np.random.default_rng(1)
    rows = [(k, u, f"v{k}-{u}" if rng.random() < 0.1 else None) for k in range(3) for u in range(130 if k else 1)]
    df = spark.createDataFrame(rows, "k int, u long, v string").repartition(4)
    want, last = {}, {}
    for k, u, v in rows:
        want[k, u] = last.get(k)
        last[k] = v or last.get(k)
    for block in (2, 10, 1000):
        got = {(r.k, r.u): r.out for r in carried(df, ["k"], "u", "v", "out", block).collect()}
        assert got == want
    assert carried(df.limit(0), ["k"], "u", "v", "out").collect() == []


def _odd_observations():
    """Two users with gaps, missing values, zero bases and one without a run."""
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for i in range(240):
        at += int(rng.choice([60, 600, 4 * 3600]))
        value = [None if rng.random() < 0.1 else float(v) for v in (rng.integers(0, 4) / 2, rng.integers(0, 40), rng.integers(0, 3) / 50)]
        if rng.random() < 0.05:
            value[1] = float("nan")
        run = [1, 2, None][i % 3]
        rows.append((i, datetime(2024, 1, 1) + timedelta(seconds=at), run, None if i % 17 == 0 else i, 1.0, *value))
    return rows


OBS = "event_id long, ts timestamp, Run long, Generation int, Perplexity double, HighFreq double, Diversity double, METEOR double"
COMPARED = ["event_id", "seq", "Diversity_change", "HighFreq_change", "METEOR_change", "relation_residual", "hist_len",
            "warning_count", "warnings", "level", "status"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small streams: a state store per partition is what takes the time."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _run_stream(spark, tmp_path, parts, **settings):
    """The monitor over ``parts``, one micro-batch each; rows and the query."""
    src = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, OBS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(src)
    out = mon.monitor_stream(stream, EVENT_RULES, **settings)
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")), q


def _plain(df):
    return sorted([tuple(tuple(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.select(*COMPARED).collect()])


def test_odd_stream_equals_replay_over_batches(spark, tmp_path):
    rows = _odd_observations()
    parts = [rows[:100], rows[100:101], rows[101:180], rows[180:]]
    for i, idle in enumerate((None, 3 * 3600)):
        got, _ = _run_stream(spark, tmp_path / str(i), parts, idle_seconds=idle)
        want = mon.monitor_replay(spark.createDataFrame(rows, OBS), EVENT_RULES, chunk=20, block=3, idle_seconds=idle)
        assert _plain(got) == _plain(want)
        big = mon.monitor_replay(spark.createDataFrame(rows, OBS), EVENT_RULES, idle_seconds=idle)
        assert _plain(big) == _plain(want)
    assert want.select("session_start").distinct().count() > 20
    assert got.where("arrived is null or session_start is null or late").count() == 0


def test_idle_keys_leave_the_state(spark, tmp_path):
    def obs(i, hours, run):
        return (i, datetime(2024, 1, 1) + timedelta(hours=hours), run, 0, 1.0, 0.5, 10.0, 0.5)
    parts = [[obs(1, 0, 1), obs(2, 0, 2)], [obs(3, 50, 1)], [obs(4, 51, 1)], [obs(5, 52, 1), obs(6, 53, 2)]]
    got, q = _run_stream(spark, tmp_path, parts, key=F.col("Run"), idle_seconds=24 * 3600, delay="1 hour")
    rows = {r.event_id: (r.seq, r.session_start.hour, r.status) for r in got.collect()}
    assert rows == {1: (0, 0, "normal"), 2: (0, 0, "normal"), 3: (0, 2, "normal"), 4: (1, 2, "normal"), 5: (2, 2, "normal"), 6: (0, 5, "normal")}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) == 2 and 1 in states[1:]  # user 2 left before it came back


def test_late_rows_have_a_defined_result(spark, tmp_path):
    def obs(i, hours):
        return (i, datetime(2024, 1, 1) + timedelta(hours=hours), 1, 0, 1.0, 0.95, 10.0, 0.5)
    parts = [[obs(1, 10), obs(2, 11)], [obs(3, 10.5), obs(4, 12)], [obs(5, 20)], [obs(7, 21)], [obs(6, 13), obs(8, 22)]]
    kept, _ = _run_stream(spark, tmp_path / "a", parts)
    rows = {r.event_id: (r.seq, r.late, r.warning_count, r.status) for r in kept.collect()}
    assert rows[3] == (-1, True, 0, "notice") and rows[6] == (-1, True, 0, "notice")
    assert [rows[i][0] for i in (1, 2, 4, 5, 7, 8)] == list(range(6)) and not any(rows[i][1] for i in (1, 2, 4, 5, 7, 8))
    # with a watermark the row behind it is dropped and counted
    got, q = _run_stream(spark, tmp_path / "b", parts, idle_seconds=7 * 86400, delay="1 hour")
    assert {r.event_id for r in got.collect()} == {1, 2, 3, 4, 5, 7, 8}
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    assert dropped == 1


def test_cycle_sinks_equal_the_batch_forms(spark, tmp_path):
    rows = _odd_observations()
    src = str(tmp_path / "in")
    for part in (rows[:90], rows[90:150], rows[150:]):
        spark.createDataFrame(part, OBS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(src)
    mon.run_monitor(stream, EVENT_RULES, str(tmp_path / "sink"), str(tmp_path / "ckpt"), available_now=True).awaitTermination()
    replay = mon.monitor_replay(spark.createDataFrame(rows, OBS), EVENT_RULES)
    names = ["seq", "Run", "Generation", "target", "suggestion", "priority"]
    got = spark.read.parquet(str(tmp_path / "sink/suggestions"))
    want = mon.suggest_actions(replay)
    assert sorted(got.select(*names).collect(), key=str) == sorted(want.select(*names).collect(), key=str)
    assert got.where("target = 'composite'").count() > 0
    names = ["seq", "Run", "rule", "description", "severity", "warning_count", "level"]
    alerts = spark.read.parquet(str(tmp_path / "sink/alerts"))
    assert sorted(alerts.select(*names).collect(), key=str) == sorted(mon.flat_alerts(replay).select(*names).collect(), key=str)
    assert alerts.where("arrived is null").count() == 0
    # a replayed epoch replaces its rows
    mon.write_cycle(replay.withColumns({c: F.current_timestamp() for c in ("session_start", "arrived")}), str(tmp_path / "again"), 0)
    first = spark.read.parquet(str(tmp_path / "again/alerts")).count()
    mon.write_cycle(replay.withColumns({c: F.current_timestamp() for c in ("session_start", "arrived")}), str(tmp_path / "again"), 0)
    assert spark.read.parquet(str(tmp_path / "again/alerts")).count() == first


def test_missing_order_columns(spark):
    obs = events_observations(spark, SF).drop("event_id")
    try:
        mon.monitor_stream(obs, EVENT_RULES)
    except ValueError as e:
        assert "event_id" in str(e)
    else:
        raise AssertionError("no error")


def test_config_merge():
    deep = merge_config({"warning_rules": {"meteor_threshold": 0.5}})
    assert deep["warning_rules"]["meteor_threshold"] == 0.5
    assert deep["warning_rules"]["highfreq_threshold"] == 0.8236
    shallow = merge_config({"warning_rules": {"meteor_threshold": 0.5}}, merge="shallow")
    assert shallow["warning_rules"] == {"meteor_threshold": 0.5}


def test_suggestions_composite(spark):
    obs = events_observations(spark, SF)
    rep = mon.monitor_replay(obs, EVENT_RULES)
    sug = mon.suggest_actions(rep)
    n3 = rep.filter("warning_count >= 3").count()
    assert sug.filter("target = 'composite'").count() == n3
    # one row per (observation, target)
    assert sug.count() == sug.select("seq", "target").distinct().count()


def test_load_rules_file_and_fallback(spark, tmp_path):
    from textdrift.streaming.rules import load_rules
    path = tmp_path / "rules.json"
    path.write_text('{"warning_rules": {"meteor_threshold": 0.5},\n "monitoring": {"history_window": 30}}')
    r = load_rules(spark, str(path))
    assert r.meteor_threshold == 0.5 and r.highfreq_threshold == 0.8236 and r.history_window == 30
    assert load_rules(spark, str(tmp_path / "missing.json")).meteor_threshold == 0.3727


def test_any_warning_in(spark):
    obs = events_observations(spark, SF)
    rep = mon.monitor_replay(obs, EVENT_RULES)
    a = rep.filter(mon.any_warning_in([1, 5])).count()
    b = rep.filter("r1 or r5").count()
    assert a == b


def test_shallow_section_keeps_other_settings():
    cfg = merge_config({"monitoring": {"history_window": 30}}, merge="shallow")
    rules = MonitorRules.from_config(cfg)
    assert rules.history_window == 30 and rules.check_interval == 10 and rules.level_thresholds == [1, 2, 3]
