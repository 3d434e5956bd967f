"""Isolation-forest properties (M4)."""

import numpy as np

from textdrift.operators.forest import c_factor, isolation_forest


def test_c_factor():
    assert c_factor(1) == 0.0 and c_factor(2) == 1.0
    assert abs(c_factor(256) - 10.2448) < 1e-3


def test_outlier_is_flagged_and_share_is_contamination(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 3)).tolist()
    pts[0] = [12.0, -12.0, 12.0]
    rows = [(i, *p) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out = isolation_forest(df, ["a", "b", "c"], "id", trees=50, psi=128).toPandas()
    assert set(out["anomaly_score"]) <= {-1, 1}
    assert out.loc[out["id"] == 0, "anomaly_score"].item() == -1
    share = (out["anomaly_score"] == -1).mean()
    assert 0.08 <= share <= 0.12
    again = isolation_forest(df, ["a", "b", "c"], "id", trees=50, psi=128).toPandas()
    assert (out.sort_values("id")["score"].to_numpy() == again.sort_values("id")["score"].to_numpy()).all()
