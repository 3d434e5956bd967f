"""Exact quantiles and pair moments against numpy; sketches of batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.operators import diversity as dv
from textdrift.operators import stats as st
from textdrift.operators.quantiles import column_quantiles, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.975, 1.0]


@pytest.mark.parametrize("blocks", [1, 7])
def test_quantiles_of_groups_match_numpy(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), float(x) if rng.random() > 0.1 else None, float(y))
            for g, x, y in zip(rng.choice([0, 0, 0, 1, 3], 900), rng.normal(size=900).round(2), rng.integers(0, 3, 900))]
    rows += [(9, None, 4.0)]  # a group of one value, and none of x
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {(r.k, r.metric): r.quantiles for r in exact_quantiles(df, ["x", "y"], PROBS, ["k"], blocks).collect()}
    want = {}
    for k in (None, 0, 1, 9):
        for i, c in ((1, "x"), (2, "y")):
            own = [r[i] for r in rows if r[0] == k and r[i] is not None]
            if own:
                want[k, c] = np.quantile(own, PROBS)
    assert got.keys() == want.keys()
    for key, value in want.items():
        np.testing.assert_allclose(got[key], value, rtol=1e-12, atol=1e-12)


def test_one_hot_value_and_no_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1.5).otherwise(F.col("id").cast("double")).alias("x"),
                                  F.lit(None).cast("double").alias("none"))
    got = {r.metric: r.quantiles for r in column_quantiles(df, ["x", "none"], PROBS).collect()}
    np.testing.assert_allclose(got["x"], np.quantile([1.5 if i % 3 else float(i) for i in range(5000)], PROBS))
    assert got["none"] == [None] * len(PROBS)
    empty = column_quantiles(df.limit(0), ["x"], [0.5]).collect()
    assert [tuple(r) for r in empty] == [("x", [None])]


def test_correlations_over_complete_pairs_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + [0, 1e6, -3, 0, 5]
    x[:, 4] = 7.1
    holes = rng.random((400, 5)) < 0.2
    rows = [tuple(None if h else float(v) for v, h in zip(a, b)) for a, b in zip(x, holes)]
    cols = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    corr = st.matrix_from_long(st.correlation_matrix(df, cols).collect(), cols, "corr")
    cov = st.matrix_from_long(st.moment_matrix(df, cols).collect(), cols, "cov")
    for i in range(5):
        for j in range(5):
            both = ~holes[:, i] & ~holes[:, j]
            assert np.isclose(cov[i, j], np.cov(x[both, i], x[both, j], ddof=0)[0, 1], rtol=1e-8, atol=1e-9)
            if 4 in (i, j):
                assert np.isnan(corr[i, j])
            else:
                assert np.isclose(corr[i, j], np.corrcoef(x[both, i], x[both, j])[0, 1], atol=1e-9)


def test_moments_of_empty_table_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r["corr"] for r in st.correlation_matrix(df, ["a", "b"]).collect()} == {None}
    none = st.correlation_matrix(df.limit(0), ["a", "b"]).collect()
    assert all(r["corr"] is None for r in none)


def test_sketches_of_batches_add_up(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) % 2, " ".join(f"w{k}" for k in rng.integers(0, 40, 30))) for i in range(300)] + [(5, "one two"), (6, None)]
    records = spark.createDataFrame(rows, "run int, generated_text string")
    halves = [records.where(F.expr(f"pmod(hash(generated_text), 2) = {h}")) for h in (0, 1)]
    parts = dv.ngram_sketches(halves[0], ["run"]).unionByName(dv.ngram_sketches(halves[1], ["run"]))
    parts = parts.unionByName(dv.ngram_sketches(records.where("generated_text is null"), ["run"]))
    merged = {r.run: r for r in dv.sketch_diversity(dv.merge_sketches(parts, ["run"]), ["run"]).collect()}
    whole = {r.run: r.diversity for r in dv.sketch_diversity(dv.ngram_sketches(records, ["run"]), ["run"]).collect()}
    exact = {r.run: r.diversity for r in dv.ngram_diversity(records, ["run"]).collect()}
    assert merged.keys() == whole.keys() == exact.keys()
    for run, r in merged.items():
        assert abs(r.diversity - exact[run]) <= 3 * r.standard_error + 0.5
        assert abs(r.diversity - whole[run]) <= r.standard_error + 0.5
    assert exact[5] == merged[5].diversity == merged[6].diversity == 0
