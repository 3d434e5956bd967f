"""Feature table, statistics and anomalies against pandas/numpy restatements."""

import math

import numpy as np
import pandas as pd

from textdrift.operators import anomaly as an
from textdrift.operators import features as ft
from textdrift.operators import stats as st
from textdrift.sources.tables import METRICS, lineitem_metrics

SF = "/root/testdata/sf0.001"


def test_lagrange_golden_values(spark):
    assert np.allclose(ft.lagrange_weights(9, [8, 10, 11]), [1 / 3, 1, -1 / 3])
    rows = [(1, 8, 89.2504245168255), (1, 10, 108.39883102119366), (1, 11, 127.73363956059576)]
    df = spark.createDataFrame(rows, "Run int, Generation int, Perplexity double")
    three = ft.lagrange_fill(df, 9, [8, 10, 11], cols=["Perplexity"]).first().Perplexity
    two = ft.lagrange_fill(df, 9, [8, 10], cols=["Perplexity"]).first().Perplexity
    assert math.isclose(three, 95.57109267327, rel_tol=1e-12)
    assert math.isclose(two, 98.82462776901, rel_tol=1e-12)


def test_lagrange_missing_node_gives_no_row(spark):
    df = spark.createDataFrame([(1, 8, 1.0), (1, 10, 2.0)], "Run int, Generation int, x double")
    assert ft.lagrange_fill(df, 9, [8, 10, 11], cols=["x"]).count() == 0


def test_features_match_pandas(spark):
    m = lineitem_metrics(spark, SF)
    got = ft.build_features(m).toPandas().sort_values(["Run", "Generation"]).reset_index(drop=True)
    pdf = m.toPandas().sort_values(["Run", "Generation"]).reset_index(drop=True)
    g = pdf.groupby("Run")
    for c in ft.LAGGED:
        exp_lag = g[c].shift(1)
        exp_chg = pdf[c] / exp_lag - 1
        assert np.allclose(got[f"{c}_lag1"], exp_lag, equal_nan=True)
        assert np.allclose(got[f"{c}_change"].astype(float), exp_chg.replace([np.inf, -np.inf], np.nan),
                           equal_nan=True)
    for c in METRICS:
        sd = pdf[c].std(ddof=0)
        exp = (pdf[c] - pdf[c].mean()) / (sd if sd > 0 else 1.0)
        assert np.allclose(got[f"{c}_scaled"], exp)
    coll = pdf["METEOR"] < 0.4
    assert (got["is_collapsed"] == coll).all()
    nxt = coll.groupby(pdf["Run"]).shift(-1).fillna(False).astype(bool)
    assert (got["next_gen_collapse"] == nxt).all()


def test_correlation_and_pca_match_numpy(spark):
    m = lineitem_metrics(spark, SF)
    pdf = m.toPandas()[METRICS]
    corr = st.matrix_from_long(st.correlation_matrix(m, METRICS).collect(), METRICS, "corr")
    assert np.allclose(corr, pdf.corr().to_numpy())
    vals, vecs, ratio, cum = st.pca(m, METRICS)
    assert np.allclose(vals, np.sort(np.linalg.eigvalsh(pdf.corr().to_numpy()))[::-1])
    assert math.isclose(cum[-1], 1.0) and (vecs[0] >= 0).all()
    table = st.pca_table(m, METRICS).toPandas().set_index("label")
    assert math.isclose(table.loc["cumulative_ratio", "a_8"], 1.0, rel_tol=1e-9)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5), (3.0, 0.5)], "x double, y double")
    rows = {(r.var_a, r.var_b): r.corr for r in st.correlation_matrix(df, ["x", "y"]).collect()}
    assert rows[("x", "y")] is None and math.isclose(rows[("x", "x")], 1.0)


def test_relation_residual_constant_x(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, 3.0)], "x double, y double")
    res = [r.res for r in st.relation_residual(df, "x", "y", "res").orderBy("y").collect()]
    assert res == [-1.0, 1.0]


def test_change_anomalies_match_pandas(spark):
    f = ft.build_features(lineitem_metrics(spark, SF))
    got = an.detect_anomalies(f).toPandas().sort_values(["Run", "Generation"]).reset_index(drop=True)
    pdf = f.toPandas().sort_values(["Run", "Generation"]).reset_index(drop=True)
    for mname in an.CHANGE_METRICS:
        chg = pdf.groupby("Run")[mname].pct_change()
        thr = 3 * chg.std()
        exp = (chg.abs() > thr).fillna(False)
        assert (got[f"{mname.lower()}_change_anomaly"] == exp).all()
    x, y = pdf["HighFreq_scaled"], pdf["Diversity_scaled"]
    b, a = np.polyfit(x, y, 1)
    resid = y - (a + b * x)
    assert np.allclose(got["diversity_relation_residual"], resid)
    assert (got["combined_anomaly"] == (got["change_anomaly"] | got["relation_anomaly"])).all()


def test_dispersion_matches_pandas(spark):
    rows = [(g, s, float(v)) for g in range(2) for s, v in enumerate([1, 4, 2, 8, 5, 7])]
    df = spark.createDataFrame(rows, "Generation int, Sample int, Perplexity double")
    got = ft.dispersion(df, ["Perplexity"]).orderBy("Generation").first()
    v = pd.Series([1, 4, 2, 8, 5, 7], dtype=float)
    assert math.isclose(got.Perplexity_STD, v.std())
    assert math.isclose(got.Perplexity_IQR, v.quantile(0.75) - v.quantile(0.25))
    assert math.isclose(got.Perplexity_CV, v.std() / v.mean())


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=1001).round(3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, x double")
    for q in (0.1, 0.5, 0.9, 0.975):
        got = st.exact_quantile(df, "x", q, "id").first().quantile
        assert math.isclose(got, float(np.quantile(vals, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_ensure_scaled_reuses_or_computes(spark):
    m = lineitem_metrics(spark, SF)
    f = ft.build_features(m)
    assert ft.ensure_scaled(f) is f
    z = ft.ensure_scaled(m)
    assert all(f"{c}_scaled" in z.columns for c in METRICS)


def test_pca_leaves_constant_columns_out(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(a + b), 5.0, float(b)) for a, b in rng.normal(size=(40, 2))]
    table = st.pca_table(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).toPandas().set_index("label")
    corr = np.corrcoef(np.array(rows)[:, [0, 1, 3]].T)
    want = np.linalg.eigvalsh(corr)[::-1]
    np.testing.assert_allclose([table.loc["eigenvalue", f"a_{j}"] for j in (1, 2, 3)], want, atol=1e-9)
    assert abs(table.loc["cumulative_ratio", "a_3"] - 1) < 1e-9
    assert table.loc["c"].isna().all() and "a_4" not in table.columns
    scores = st.pca_scores(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"])
    assert scores.dropna().count() == 40


def test_two_rules_make_an_alert(spark):
    rules = spark.createDataFrame([(1, 0.5), (2, 10.0), (3, 0.2), (4, 1.0), (5, 1.0), (6, None)], "rule int, threshold double")
    rows = [(0, 0.6, 9.0, 0.3, 0.0, 0.0, 9.0), (1, 0.6, 11.0, 0.3, -2.0, None, 9.0), (2, 0.5, 10.0, 0.2, 1.0, -1.0, 9.0),
            (3, None, None, 0.1, None, None, None)]
    df = spark.createDataFrame(rows, "id int, HighFreq double, Diversity double, METEOR double, Diversity_change double, "
                                     "HighFreq_change double, diversity_relation_residual double")
    got = {r.id: (r.rules_held, r.alert) for r in an.rule_alerts(df, rules).collect()}
    assert got == {0: ([1, 2], True), 1: ([1, 4], True), 2: ([], False), 3: ([3], False)}
