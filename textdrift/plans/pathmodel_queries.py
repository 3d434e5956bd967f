"""Registered path-model queries over the feature table.

Fits have no SQL form; the moment matrix they start from is checked by the
``moment_matrix`` oracle, the fits by tests on known models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textdrift.operators import pathmodel as pm
from textdrift.plans.analysis_queries import _features
from textdrift.plans.common import rounded
from textdrift.plans.registry import query
from textdrift.session import materialize


def _keyed(spark, sf_dir):
    return _features(spark, sf_dir).withColumn("row_key", F.concat_ws(":", "Run", "Generation"))


@query("path_model_parameters")
def q_path_model_parameters(spark, sf_dir):
    """M9 + P14: parameter table of the base model."""
    res = pm.fit_path_model(_features(spark, sf_dir), pm.BASE_MODEL)
    return rounded(pm.parameters_frame(spark, res))


@query("path_model_comparison")
def q_path_model_comparison(spark, sf_dir):
    """M11 + M12 + A24: fit indices of four models, best by AIC."""
    return rounded(pm.compare_models(_features(spark, sf_dir)))


@query("path_effects")
def q_path_effects(spark, sf_dir):
    """Direct, indirect and total effect of HighFreq on SQ."""
    res = pm.fit_path_model(_features(spark, sf_dir), pm.BASE_MODEL)
    return rounded(spark.createDataFrame(pm.effect_decomposition(res),
                                         "effect_type string, path string, value double"))


@query("path_model_by_run")
def q_path_model_by_run(spark, sf_dir):
    """Base model fitted per Run (runs with more than 10 rows)."""
    return rounded(pm.fit_by_group(_features(spark, sf_dir), "Run"))


@query("bootstrap_paths")
def q_bootstrap_paths(spark, sf_dir):
    """M15 + L6: 100 Poisson-bootstrap replicates of the three key paths."""
    return rounded(pm.bootstrap_path_model(_keyed(spark, sf_dir), "row_key", 100))


@query("bootstrap_ci")
def q_bootstrap_ci(spark, sf_dir):
    """A23 + A25: bootstrap mean, std, 95 % interval and significance."""
    boot = materialize(pm.bootstrap_path_model(_keyed(spark, sf_dir), "row_key", 100))
    return rounded(pm.bootstrap_ci(boot))


@query("cross_validation")
def q_cross_validation(spark, sf_dir):
    """M14 + A22 + L7: 3-fold CV, METEOR predicted with METEOR hidden."""
    return rounded(pm.cross_validate(_keyed(spark, sf_dir), "row_key", k=3))


@query("findings")
def q_findings(spark, sf_dir):
    """Findings from the base fit and the bootstrap."""
    f = _keyed(spark, sf_dir)
    res = pm.fit_path_model(f, pm.BASE_MODEL)
    boot = materialize(pm.bootstrap_path_model(f, "row_key", 100))
    return rounded(pm.findings(res, pm.bootstrap_ci(boot)))


@query("bootstrap_long")
def q_bootstrap_long(spark, sf_dir):
    """Bootstrap replicates in long format (replicate, path, value)."""
    from textdrift.operators.stats import coefficients_long
    boot = pm.bootstrap_path_model(_keyed(spark, sf_dir), "row_key", 100)
    paths = [f"{y}~{x}" for y, x in pm.KEY_PATHS]
    wide = boot.select("replicate", *[F.col(f"`{p}`").alias(p.replace("~", "__on__")) for p in paths])
    return rounded(coefficients_long(wide, ["replicate"], [p.replace("~", "__on__") for p in paths]))
