"""Registered queries over the metric table derived from ``lineitem``
(A1, A11-A21, A26, M1-M3, M5-M8, P1-P12, U1, W1-W4, W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textdrift.operators import anomaly as an
from textdrift.operators import features as ft
from textdrift.operators import stats as st
from textdrift.operators.quantiles import exact_quantiles
from textdrift.plans.common import rounded
from textdrift.plans.registry import query
from textdrift.session import materialize
from textdrift.sources.tables import (METRICS, lineitem_metric_exprs, lineitem_metrics,
                                      lineitem_metrics_sql, read_table)

LAGGED = ft.LAGGED


def _metrics(spark, sf_dir):
    return materialize(lineitem_metrics(spark, sf_dir))


def _features(spark, sf_dir):
    return materialize(ft.build_features(_metrics(spark, sf_dir)))


def _anomalies(spark, sf_dir):
    return materialize(an.detect_anomalies(_features(spark, sf_dir)))


# ---------------------------------------------------------------------------
# DuckDB text of the same chain
# ---------------------------------------------------------------------------

def _features_ctes() -> str:
    lags = ", ".join(f"lag({c}) OVER w AS {c}_lag1" for c in LAGGED)
    changes = ", ".join(f"{c} / NULLIF(lag({c}) OVER w, 0) - 1 AS {c}_change" for c in LAGGED)
    stats = ", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in METRICS)
    scaled = ", ".join(
        f"({c} - {c}__m) / CASE WHEN {c}__s IS NULL OR {c}__s = 0 THEN 1 ELSE {c}__s END "
        f"AS {c}_scaled" for c in METRICS)
    return f"""
    m AS ({lineitem_metrics_sql()}),
    f0 AS (SELECT *, {lags}, {changes},
                  pow(HighFreq, 2) AS HighFreq_sq, pow(Diversity, 2) AS Diversity_sq,
                  coalesce(METEOR < 0.4, false) AS is_collapsed,
                  coalesce(lead(METEOR < 0.4) OVER w, false) AS next_gen_collapse
           FROM m WINDOW w AS (PARTITION BY Run ORDER BY Generation)),
    mst AS (SELECT {stats} FROM m),
    f AS (SELECT f0.*, {scaled} FROM f0, mst)
    """


def _anomaly_ctes() -> str:
    cm = an.CHANGE_METRICS
    thr = ", ".join(f"3.0 * stddev_samp({m}_change) AS {m}_change_threshold" for m in cm)
    flags = ", ".join(
        f"coalesce(abs({m}_change) > {m}_change_threshold, false) AS {m.lower()}_change_anomaly"
        for m in cm)
    any_change = " OR ".join(f"{m.lower()}_change_anomaly" for m in cm)
    fits = ", ".join(
        f"regr_slope({y}, {x}) AS {n}__b, regr_intercept({y}, {x}) AS {n}__a"
        for x, y, n in an.RELATIONS)
    resid = ", ".join(f"{y} - ({n}__a + {n}__b * {x}) AS {n}_residual" for x, y, n in an.RELATIONS)
    rthr = ", ".join(f"2.5 * stddev_samp({n}_residual) AS {n}_threshold" for _, _, n in an.RELATIONS)
    rflags = ", ".join(f"coalesce(abs({n}_residual) > {n}_threshold, false) AS {n}_anomaly"
                       for _, _, n in an.RELATIONS)
    return f"""
    {_features_ctes()},
    cthr AS (SELECT {thr} FROM f),
    a1 AS (SELECT f.*, cthr.*, {flags} FROM f, cthr),
    a2 AS (SELECT *, {any_change} AS change_anomaly FROM a1),
    fit AS (SELECT {fits} FROM a2),
    a3 AS (SELECT a2.*, {resid} FROM a2, fit),
    rthr AS (SELECT {rthr} FROM a3),
    a4 AS (SELECT a3.*, rthr.*, {rflags} FROM a3, rthr),
    a AS (SELECT *, diversity_relation_anomaly OR meteor_relation_anomaly AS relation_anomaly,
                 false AS is_anomaly,
                 change_anomaly OR diversity_relation_anomaly OR meteor_relation_anomaly
                     AS combined_anomaly
          FROM a4)
    """


def _round_cols(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


FEATURE_COLS = (["Run", "Generation"] + METRICS + [f"{c}_lag1" for c in LAGGED]
                + [f"{c}_change" for c in LAGGED] + ["HighFreq_sq", "Diversity_sq",
                                                       "is_collapsed", "next_gen_collapse"]
                + [f"{c}_scaled" for c in METRICS])
_FLOATS = [c for c in FEATURE_COLS if c not in ("Run", "Generation", "is_collapsed",
                                                 "next_gen_collapse")]


@query("metric_table", f"SELECT Run, Generation, {_round_cols(METRICS)} "
       f"FROM ({lineitem_metrics_sql()})")
def q_metric_table(spark, sf_dir):
    """The observation table: 8 metrics per (Run, Generation)."""
    return rounded(_metrics(spark, sf_dir))


@query("features", f"WITH {_features_ctes()} SELECT Run, Generation, is_collapsed, "
       f"next_gen_collapse, {_round_cols(_FLOATS)} FROM f")
def q_features(spark, sf_dir):
    """Lags, percent changes, squares, z-scores, flags."""
    return rounded(_features(spark, sf_dir).select(*FEATURE_COLS))


@query("mean_by_generation", f"""
    SELECT experiment, Generation, {', '.join(f'round(avg({c}), 6) AS {c}' for c in METRICS)}
    FROM ({lineitem_metrics_sql(experiment=True)}) GROUP BY experiment, Generation""")
def q_mean_by_generation(spark, sf_dir):
    """A1 + U1: the table of every experiment (line status) stacked with its
    name kept, then the mean of each metric over runs per generation."""
    return rounded(ft.mean_by_generation(lineitem_metrics(spark, sf_dir, experiment="experiment")))


def _lagrange_sql(target, nodes):
    ws = ft.lagrange_weights(target, nodes)
    case = " ".join(f"WHEN {n} THEN {w!r}" for n, w in zip(nodes, ws))
    sums = ", ".join(f"round(sum({c} * (CASE Generation {case} END)), 6) AS {c}" for c in METRICS)
    return (f"SELECT Run, {target} AS Generation, {sums} FROM ({lineitem_metrics_sql()}) "
            f"WHERE Generation IN ({', '.join(map(str, nodes))}) GROUP BY Run "
            f"HAVING count(*) = {len(nodes)}")


@query("lagrange_fill", _lagrange_sql(9, [8, 10, 11]))
def q_lagrange_fill(spark, sf_dir):
    """M1: generation 9 of every run interpolated through generations 8, 10, 11."""
    return rounded(ft.lagrange_fill(_metrics(spark, sf_dir), 9, [8, 10, 11]))


_DISP_METRICS = ["Perplexity", "Rouge_1", "Rouge_2", "Rouge_L"]


def _dispersion_samples(spark, sf_dir):
    """Sample table: one metric row per (Generation, Sample = line number)."""
    li = read_table(spark, sf_dir, "lineitem")
    gen = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("Generation")
    exprs = lineitem_metric_exprs()
    return li.groupBy(gen, F.col("l_linenumber").alias("Sample")).agg(
        *[exprs[m].alias(m) for m in _DISP_METRICS])


def _dispersion_sql():
    cols = []
    for c in _DISP_METRICS:
        n = c.replace("_", "")
        cols += [f"round(avg({c}), 6) AS {n}_Mean", f"round(stddev_samp({c}), 6) AS {n}_STD",
                 f"round(stddev_samp({c}) / NULLIF(avg({c}), 0), 6) AS {n}_CV",
                 f"round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS {n}_IQR"]
    return f"""
    SELECT Generation, {', '.join(cols)}
    FROM (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER)
                     AS Generation, l_linenumber AS Sample,
                 exp(avg(ln(l_extendedprice))) AS Perplexity,
                 avg(round(l_discount * 100)) / 10.0 AS Rouge_1,
                 avg(round(l_tax * 100)) / 10.0 AS Rouge_2,
                 avg(CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS Rouge_L
          FROM lineitem GROUP BY 1, 2)
    GROUP BY Generation"""


@query("dispersion", _dispersion_sql())
def q_dispersion(spark, sf_dir):
    """Mean, sample std, CV and IQR per generation over its samples."""
    return rounded(ft.dispersion(_dispersion_samples(spark, sf_dir), _DISP_METRICS))


@query("null_counts", "SELECT column_name AS \"column\", CAST(n AS BIGINT) AS null_count FROM ("
       f"WITH {_features_ctes()} SELECT "
       + ", ".join(f"count(*) - count({c}) AS \"{c}\"" for c in FEATURE_COLS)
       + " FROM f) UNPIVOT (n FOR column_name IN ("
       + ", ".join(f'"{c}"' for c in FEATURE_COLS) + "))")
def q_null_counts(spark, sf_dir):
    """NULLs per column of the feature table."""
    return st.null_counts(_features(spark, sf_dir).select(*FEATURE_COLS))


def _describe_sql():
    parts = []
    for c in METRICS:
        parts.append(
            f"SELECT '{c}' AS metric, count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM m")
    return f"WITH m AS ({lineitem_metrics_sql()}) " + " UNION ALL ".join(parts)


@query("describe_metrics", _describe_sql())
def q_describe_metrics(spark, sf_dir):
    """Count, mean, std, min, quartiles, max of each metric."""
    return rounded(st.describe_metrics(_metrics(spark, sf_dir), METRICS))


def _pairs_sql(expr_fn, name):
    parts = []
    for a in METRICS:
        for b in METRICS:
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {expr_fn(a, b)} AS {name} FROM m")
    return f"WITH m AS ({lineitem_metrics_sql()}) " + " UNION ALL ".join(parts)


@query("correlation_matrix", _pairs_sql(
    lambda a, b: f"round(covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0), 6)",
    "corr"))
def q_correlation_matrix(spark, sf_dir):
    """Pearson correlation of the 8 metrics (long format)."""
    return rounded(st.correlation_matrix(_metrics(spark, sf_dir), METRICS))


@query("moment_matrix", _pairs_sql(
    lambda a, b: f"round(covar_pop({a}, {b}), 6)", "cov").replace(
        " AS cov FROM m", " AS cov, count(*) AS n FROM m"))
def q_moment_matrix(spark, sf_dir):
    """Population covariance matrix and row count."""
    return rounded(st.moment_matrix(_metrics(spark, sf_dir), METRICS))


def _embedding_columns(spark, sf_dir):
    """Names and frame of the 64 components, beside the row's id and label."""
    names = [f"e{i}" for i in range(64)]
    dims = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)]
    return names, read_table(spark, sf_dir, "embeddings").select("vec_id", "label", *dims)


@query("embedding_correlation", """
    WITH r AS (SELECT row_number() OVER () AS r, embedding FROM embeddings),
    u AS (SELECT r, unnest(range(64)) AS i, unnest(embedding[1:64]) AS x FROM r),
    v AS (SELECT r, i, CAST(x AS DOUBLE) AS x FROM u WHERE x IS NOT NULL)
    SELECT 'e' || a.i AS var_a, 'e' || b.i AS var_b,
           round(covar_pop(a.x, b.x) / NULLIF(stddev_pop(a.x) * stddev_pop(b.x), 0), 6) AS corr
    FROM v a JOIN v b USING (r) GROUP BY a.i, b.i""")
def q_embedding_correlation(spark, sf_dir):
    """A20 on the 64 components of ``embeddings``: all 2,080 pairs in one pass."""
    names, x = _embedding_columns(spark, sf_dir)
    return rounded(st.correlation_matrix(x, names))


@query("embedding_quantiles", """
    WITH v AS (SELECT label, unnest(range(64)) AS i, unnest(embedding[1:64]) AS x FROM embeddings)
    SELECT label, 'e' || i AS metric, round(quantile_cont(CAST(x AS DOUBLE), 0.25), 6) AS p25,
           round(quantile_cont(CAST(x AS DOUBLE), 0.5), 6) AS p50,
           round(quantile_cont(CAST(x AS DOUBLE), 0.75), 6) AS p75
    FROM v WHERE x IS NOT NULL GROUP BY label, i""")
def q_embedding_quantiles(spark, sf_dir):
    """Exact quartiles of each of the 64 components per label."""
    names, x = _embedding_columns(spark, sf_dir)
    found = exact_quantiles(x, names, [0.25, 0.5, 0.75], ["label"])
    return rounded(found.select("label", "metric", *[F.col("quantiles")[i].alias(n)
                                                     for i, n in enumerate(("p25", "p50", "p75"))]))


@query("pca_table")
def q_pca_table(spark, sf_dir):
    """M2: loadings, eigenvalues and explained shares of the metric table
    (eigen-decomposition has no SQL form; tested against numpy)."""
    return rounded(st.pca_table(_metrics(spark, sf_dir), METRICS))


@query("relation_residual", f"""
    WITH m AS ({lineitem_metrics_sql()}),
    fit AS (SELECT regr_slope(Diversity, HighFreq) AS b, regr_intercept(Diversity, HighFreq) AS a
            FROM m)
    SELECT Run, Generation, round(Diversity - (a + b * HighFreq), 6) AS residual FROM m, fit""")
def q_relation_residual(spark, sf_dir):
    """M3: residual of Diversity on HighFreq over the whole table."""
    r = st.relation_residual(_metrics(spark, sf_dir), "HighFreq", "Diversity", "residual")
    return rounded(r.select("Run", "Generation", "residual"))


_CHANGE_OUT = (["Run", "Generation"] + [f"{m}_change" for m in an.CHANGE_METRICS]
               + [f"{m}_change_threshold" for m in an.CHANGE_METRICS]
               + [f"{m.lower()}_change_anomaly" for m in an.CHANGE_METRICS] + ["change_anomaly"])
_REL_OUT = (["Run", "Generation"] + [f"{n}_residual" for _, _, n in an.RELATIONS]
            + [f"{n}_threshold" for _, _, n in an.RELATIONS]
            + [f"{n}_anomaly" for _, _, n in an.RELATIONS] + ["relation_anomaly"])


def _sel(cols):
    return ", ".join(f"round({c}, 6) AS {c}" if ("change" in c and "anomaly" not in c)
                     or "residual" in c or "threshold" in c else c for c in cols)


@query("change_anomalies", f"WITH {_anomaly_ctes()} SELECT {_sel(_CHANGE_OUT)} FROM a")
def q_change_anomalies(spark, sf_dir):
    """M5: percent-change anomalies at 3 sample standard deviations."""
    return rounded(an.change_anomalies(_features(spark, sf_dir)).select(*_CHANGE_OUT))


@query("relation_anomalies", f"WITH {_anomaly_ctes()} SELECT {_sel(_REL_OUT)} FROM a")
def q_relation_anomalies(spark, sf_dir):
    """M6: relation-residual anomalies at 2.5 sample standard deviations."""
    return rounded(an.relation_anomalies(_features(spark, sf_dir)).select(*_REL_OUT))


_DETECT_OUT = ["Run", "Generation", "is_anomaly", "change_anomaly", "relation_anomaly",
               "combined_anomaly"]


@query("detect_anomalies", f"WITH {_anomaly_ctes()} SELECT {', '.join(_DETECT_OUT)} FROM a")
def q_detect_anomalies(spark, sf_dir):
    """M7 without the forest: change OR relation anomalies."""
    return _anomalies(spark, sf_dir).select(*_DETECT_OUT)


@query("compare_groups", f"""
    WITH {_anomaly_ctes()}
    {' UNION ALL '.join(
        f"SELECT '{m}' AS metric, round(avg({m}) FILTER (WHERE combined_anomaly), 6) AS anomaly_mean, "
        f"round(avg({m}) FILTER (WHERE NOT combined_anomaly), 6) AS normal_mean, "
        f"round((avg({m}) FILTER (WHERE combined_anomaly) - avg({m}) FILTER (WHERE NOT combined_anomaly))"
        f" / avg({m}) FILTER (WHERE NOT combined_anomaly) * 100, 6) AS pct_difference FROM a"
        for m in an.GROUP_METRICS)}""")
def q_compare_groups(spark, sf_dir):
    """Anomaly vs normal means and percent difference."""
    return rounded(an.compare_groups(_anomalies(spark, sf_dir)))


@query("anomaly_summary", f"""
    WITH {_anomaly_ctes()}
    {' UNION ALL '.join(
        f"SELECT '{c}' AS flag, CAST(sum(CAST({c} AS BIGINT)) AS BIGINT) AS n_flagged, "
        f"round(sum(CAST({c} AS BIGINT)) / count(*), 6) AS share FROM a"
        for c in an.SUMMARY_FLAGS)}""")
def q_anomaly_summary(spark, sf_dir):
    """Count and share of each anomaly flag."""
    return rounded(an.anomaly_summary(_anomalies(spark, sf_dir)))


@query("anomaly_rate_by_run", f"WITH {_anomaly_ctes()} SELECT Run, "
       "round(avg(CAST(combined_anomaly AS DOUBLE)), 6) AS anomaly_rate FROM a GROUP BY Run")
def q_anomaly_rate_by_run(spark, sf_dir):
    """A18 + L1: anomaly rate per run, sorted descending."""
    return rounded(an.anomaly_rate_by_run(_anomalies(spark, sf_dir)))


@query("anomalies_by_generation", f"WITH {_anomaly_ctes()} SELECT Generation, "
       "count(*) FILTER (WHERE NOT combined_anomaly) AS normal, "
       "count(*) FILTER (WHERE combined_anomaly) AS anomalous FROM a GROUP BY Generation")
def q_anomalies_by_generation(spark, sf_dir):
    """Normal and anomalous rows per generation."""
    return an.anomalies_by_generation(_anomalies(spark, sf_dir))


@query("rule_quantiles", f"""
    WITH {_anomaly_ctes()}
    {' UNION ALL '.join(
        f"SELECT '{m}' AS metric, round(min({m}), 6) AS min, round(quantile_cont({m}, 0.25), 6) AS p25, "
        f"round(quantile_cont({m}, 0.5), 6) AS median, round(quantile_cont({m}, 0.75), 6) AS p75, "
        f"round(max({m}), 6) AS max FROM a WHERE combined_anomaly"
        for m in ('HighFreq', 'Diversity', 'METEOR'))}""")
def q_rule_quantiles(spark, sf_dir):
    """Quantiles of the flagged rows."""
    return rounded(an.rule_quantiles(_anomalies(spark, sf_dir)))


@query("extract_rules", f"""
    WITH {_anomaly_ctes()},
    q AS (SELECT quantile_cont(HighFreq, 0.75) AS r1, quantile_cont(Diversity, 0.25) AS r2,
                 quantile_cont(METEOR, 0.25) AS r3 FROM a WHERE combined_anomaly),
    t AS (SELECT any_value(Diversity_change_threshold) AS r4,
                 any_value(HighFreq_change_threshold) AS r5,
                 any_value(diversity_relation_threshold) AS r6 FROM a)
    SELECT 1 AS rule, 'HighFreq' AS metric, '>' AS op, round(r1, 6) AS threshold, 'medium' AS severity FROM q
    UNION ALL SELECT 2, 'Diversity', '<', round(r2, 6), 'high' FROM q
    UNION ALL SELECT 3, 'METEOR', '<', round(r3, 6), 'high' FROM q
    UNION ALL SELECT 4, 'Diversity_change', 'abs>', round(r4, 6), 'medium' FROM t
    UNION ALL SELECT 5, 'HighFreq_change', 'abs>', round(r5, 6), 'medium' FROM t
    UNION ALL SELECT 6, 'relation_residual', 'abs>', round(r6, 6), 'high' FROM t""")
def q_extract_rules(spark, sf_dir):
    """M8: the six alert rules derived from the anomalies."""
    return rounded(an.extract_rules(_anomalies(spark, sf_dir)))


@query("rule_alerts", f"""
    WITH {_anomaly_ctes()},
    q AS (SELECT quantile_cont(HighFreq, 0.75) AS r1, quantile_cont(Diversity, 0.25) AS r2,
                 quantile_cont(METEOR, 0.25) AS r3 FROM a WHERE combined_anomaly),
    h AS (SELECT Run, Generation,
                 list_filter([CASE WHEN HighFreq > r1 THEN 1 END, CASE WHEN Diversity < r2 THEN 2 END,
                              CASE WHEN METEOR < r3 THEN 3 END,
                              CASE WHEN abs(Diversity_change) > Diversity_change_threshold THEN 4 END,
                              CASE WHEN abs(HighFreq_change) > HighFreq_change_threshold THEN 5 END,
                              CASE WHEN abs(diversity_relation_residual) > diversity_relation_threshold THEN 6 END],
                             lambda r: r IS NOT NULL) AS held FROM a, q)
    SELECT Run, Generation, array_to_string(held, ',') AS rules_held, len(held) >= 2 AS alert FROM h""")
def q_rule_alerts(spark, sf_dir):
    """M8: the rules that hold on each row; an alert is due when any two do."""
    rows = _anomalies(spark, sf_dir)
    found = an.rule_alerts(rows, an.extract_rules(rows))
    return found.select("Run", "Generation", F.array_join("rules_held", ",").alias("rules_held"), "alert")


@query("distinct_runs", f"SELECT DISTINCT Run FROM ({lineitem_metrics_sql()})")
def q_distinct_runs(spark, sf_dir):
    """Distinct runs."""
    return _metrics(spark, sf_dir).select("Run").distinct()


@query("runs_over_10_rows", f"""
    WITH m AS ({lineitem_metrics_sql()})
    SELECT Run, count(*) AS n_rows FROM m GROUP BY Run HAVING count(*) > 10""")
def q_runs_over_10_rows(spark, sf_dir):
    """Runs with more than 10 rows (group filter + left-semi join)."""
    m = _metrics(spark, sf_dir)
    big = m.groupBy("Run").count().filter(F.col("count") > 10)
    kept = m.join(big.select("Run"), on="Run", how="left_semi")
    return kept.groupBy("Run").agg(F.count(F.lit(1)).alias("n_rows"))


@query("collapsed_split", f"""
    WITH {_features_ctes()}
    SELECT is_collapsed, count(*) AS n_rows, round(avg(METEOR), 6) AS mean_meteor
    FROM f GROUP BY is_collapsed""")
def q_collapsed_split(spark, sf_dir):
    """P4 + P11: rows below / above the collapse threshold."""
    f = _features(spark, sf_dir)
    low, high = an.split_by_flag(f, "is_collapsed")
    part = lambda df, v: df.agg(F.count(F.lit(1)).alias("n_rows"),
                                F.avg("METEOR").alias("mean_meteor")).withColumn(
        "is_collapsed", F.lit(v))
    return rounded(part(low, True).unionByName(part(high, False)).filter(F.col("n_rows") > 0))


# ---------------------------------------------------------------------------
# Isolation forest (no SQL form: property tests in tests/test_forest.py)
# ---------------------------------------------------------------------------

SCALED = [f"{c}_scaled" for c in METRICS]


def _forest_labels(spark, sf_dir):
    from textdrift.operators.forest import isolation_forest
    f = _features(spark, sf_dir).withColumn("row_key", F.concat_ws(":", "Run", "Generation"))
    return isolation_forest(f, SCALED, "row_key", keep=["Run", "Generation"])


@query("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    """M4: isolation-forest labels (-1 / 1) of the feature rows."""
    return rounded(_forest_labels(spark, sf_dir).select("Run", "Generation", "score",
                                                        "anomaly_score"))


@query("detect_anomalies_full")
def q_detect_anomalies_full(spark, sf_dir):
    """M7: isolation forest OR change OR relation anomalies."""
    labels = _forest_labels(spark, sf_dir)
    full = an.detect_anomalies(_features(spark, sf_dir), forest_labels=labels)
    return full.select(*_DETECT_OUT)


@query("embedding_outliers")
def q_embedding_outliers(spark, sf_dir):
    """M4 on the 64-dimensional ``embeddings`` table: the top 10 % by
    isolation score get -1."""
    from textdrift.operators.forest import isolation_forest
    emb = read_table(spark, sf_dir, "embeddings")
    dims = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    x = emb.select("vec_id", "label", *dims)
    out = isolation_forest(x, [f"e{i}" for i in range(64)], "vec_id", keep=["label"])
    return rounded(out.select("vec_id", "label", "score", "anomaly_score"))
