"""Anomaly detection on a feature table and rule extraction (M5-M8,
A11, A15-A19).

Every threshold is a one-row aggregate attached by a broadcast cross join;
flags are NULL-safe (``coalesce(cond, false)``), so the first generation of a
run, whose change is NULL, is never a change anomaly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.operators.features import pct_change, _run_window
from textdrift.operators.quantiles import column_quantiles
from textdrift.operators.stats import relation_residual

# The metrics watched for change anomalies and the two
# relations (x -> y, residual name) watched for relation anomalies.
CHANGE_METRICS = ["Diversity", "HighFreq", "METEOR"]
RELATIONS = [
    ("HighFreq_scaled", "Diversity_scaled", "diversity_relation"),
    ("Diversity_scaled", "METEOR_scaled", "meteor_relation"),
]
CHANGE_SIGMAS = 3.0
RELATION_SIGMAS = 2.5
GROUP_METRICS = ["Perplexity", "Diversity", "HighFreq", "METEOR"]


def flag(cond) -> F.Column:
    """NULL-safe predicate."""
    return F.coalesce(cond, F.lit(False))


def any_of(cols: Sequence[str]) -> F.Column:
    """P10: OR of flag columns."""
    return reduce(or_, [F.col(c) for c in cols])


def change_anomalies(features: DataFrame, metrics: Sequence[str] = CHANGE_METRICS,
                     sigmas: float = CHANGE_SIGMAS, run: str = "Run",
                     order: str = "Generation") -> DataFrame:
    """M5: ``|change| > sigmas * std(change)`` (sample std over all rows).

    Adds ``{m}_change`` (recomputed per run), ``{m}_change_threshold`` and
    ``{m.lower()}_change_anomaly`` per metric, and ``change_anomaly``.
    """
    w = _run_window(run, order)
    df = features.withColumns({f"{m}_change": pct_change(m, w) for m in metrics})
    thr = df.agg(*[(F.lit(sigmas) * F.stddev_samp(f"{m}_change")).alias(f"{m}_change_threshold")
                   for m in metrics])
    df = df.crossJoin(F.broadcast(thr))
    flags = {f"{m.lower()}_change_anomaly":
             flag(F.abs(F.col(f"{m}_change")) > F.col(f"{m}_change_threshold")) for m in metrics}
    df = df.withColumns(flags)
    return df.withColumn("change_anomaly", any_of(list(flags)))


def relation_anomalies(features: DataFrame, relations=RELATIONS,
                       sigmas: float = RELATION_SIGMAS) -> DataFrame:
    """M6: residual of each linear relation, flagged when
    ``|residual| > sigmas * std(residual)``; ``relation_anomaly`` = any."""
    df = features
    for x, y, name in relations:
        df = relation_residual(df, x, y, f"{name}_residual")
    thr = df.agg(*[(F.lit(sigmas) * F.stddev_samp(f"{name}_residual")).alias(f"{name}_threshold")
                   for _, _, name in relations])
    df = df.crossJoin(F.broadcast(thr))
    flags = {f"{name}_anomaly": flag(F.abs(F.col(f"{name}_residual")) > F.col(f"{name}_threshold"))
             for _, _, name in relations}
    return df.withColumns(flags).withColumn("relation_anomaly", any_of(list(flags)))


def detect_anomalies(features: DataFrame, forest_labels: DataFrame | None = None,
                     keys: Sequence[str] = ("Run", "Generation")) -> DataFrame:
    """M7: change, relation and (optionally) isolation-forest anomalies;
    ``combined_anomaly`` is their OR.  ``forest_labels`` has ``keys`` and
    ``anomaly_score`` (-1 anomaly, 1 normal)."""
    df = relation_anomalies(change_anomalies(features))
    if forest_labels is not None:
        df = df.join(forest_labels.select(*keys, "anomaly_score"), on=list(keys), how="left")
        df = df.withColumn("is_anomaly", flag(F.col("anomaly_score") == -1))
    else:
        df = df.withColumn("is_anomaly", F.lit(False))
    return df.withColumn("combined_anomaly", any_of(["is_anomaly", "change_anomaly",
                                                      "relation_anomaly"]))


def split_by_flag(df: DataFrame, col: str = "combined_anomaly") -> tuple[DataFrame, DataFrame]:
    """(flagged rows, other rows)."""
    return df.filter(F.col(col)), df.filter(~F.col(col))


def compare_groups(anomalies: DataFrame, metrics: Sequence[str] = GROUP_METRICS,
                   col: str = "combined_anomaly") -> DataFrame:
    """Mean of each metric among flagged and other rows and the percent
    difference ``(a - n) / n * 100``; one aggregate pass, long format."""
    f = F.col(col)
    row = anomalies.agg(*[F.avg(F.when(f, F.col(m))).alias(f"{m}__a") for m in metrics],
                        *[F.avg(F.when(~f, F.col(m))).alias(f"{m}__n") for m in metrics])
    recs = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}__a").alias("anomaly_mean"),
                     F.col(f"{m}__n").alias("normal_mean"),
                     (F.try_divide(F.col(f"{m}__a") - F.col(f"{m}__n"), F.col(f"{m}__n"))
                      * 100).alias("pct_difference")) for m in metrics]
    return row.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


SUMMARY_FLAGS = ["is_anomaly", "change_anomaly", "relation_anomaly", "combined_anomaly"]


def anomaly_summary(anomalies: DataFrame, flags: Sequence[str] = SUMMARY_FLAGS) -> DataFrame:
    """Count and share of each flag, long format ``(flag, n_flagged, share)``."""
    row = anomalies.agg(F.count(F.lit(1)).alias("__n"),
                        *[F.sum(F.col(c).cast("long")).alias(c) for c in flags])
    recs = [F.struct(F.lit(c).alias("flag"), F.col(c).alias("n_flagged"),
                     (F.col(c) / F.col("__n")).alias("share")) for c in flags]
    return row.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def anomaly_rate_by_run(anomalies: DataFrame, run: str = "Run",
                        col: str = "combined_anomaly") -> DataFrame:
    """A18 + L1: share of flagged rows per run, highest first."""
    return (anomalies.groupBy(run).agg(F.avg(F.col(col).cast("double")).alias("anomaly_rate"))
            .orderBy(F.desc("anomaly_rate"), run))


def anomalies_by_generation(anomalies: DataFrame, order: str = "Generation",
                            col: str = "combined_anomaly") -> DataFrame:
    """Rows per generation split by the flag (pivot with fixed values)."""
    p = anomalies.groupBy(order).pivot(col, [False, True]).count()
    return p.select(order, F.coalesce(F.col("false"), F.lit(0)).alias("normal"),
                    F.coalesce(F.col("true"), F.lit(0)).alias("anomalous"))


# ---------------------------------------------------------------------------
# M8 rule extraction
# ---------------------------------------------------------------------------

def extract_rules(anomalies: DataFrame, col: str = "combined_anomaly") -> DataFrame:
    """M8: six alert rules derived from the flagged rows.

    R1 HighFreq > p75 of flagged rows, R2 Diversity < p25, R3 METEOR < p25
    (exact linear-interpolated quantiles, A15), R4/R5 |change| above the 3
    sigma change thresholds, R6 |residual| above the 2.5 sigma relation
    threshold.  An alert is due when any two rules hold.  Output: one row per
    rule ``(rule, metric, op, threshold, severity)``.
    """
    flagged = anomalies.filter(F.col(col))
    level = column_quantiles(flagged, ["HighFreq", "Diversity", "METEOR"], [0.25, 0.75])
    at = lambda m, i: F.max(F.when(F.col("metric") == m, F.col("quantiles")[i]))
    q = level.agg(at("HighFreq", 1).alias("hf"), at("Diversity", 0).alias("dv"), at("METEOR", 0).alias("mt"))
    t = anomalies.agg(F.first("Diversity_change_threshold").alias("r4"),
                      F.first("HighFreq_change_threshold").alias("r5"),
                      F.first("diversity_relation_threshold").alias("r6"))
    j = q.crossJoin(t)

    def rec(rule, metric, op, thr, sev):
        return F.struct(F.lit(rule).alias("rule"), F.lit(metric).alias("metric"),
                        F.lit(op).alias("op"), thr.cast("double").alias("threshold"),
                        F.lit(sev).alias("severity"))
    recs = [rec(1, "HighFreq", ">", F.col("hf"), "medium"),
            rec(2, "Diversity", "<", F.col("dv"), "high"),
            rec(3, "METEOR", "<", F.col("mt"), "high"),
            rec(4, "Diversity_change", "abs>", F.col("r4"), "medium"),
            rec(5, "HighFreq_change", "abs>", F.col("r5"), "medium"),
            rec(6, "relation_residual", "abs>", F.col("r6"), "high")]
    return j.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def rule_quantiles(anomalies: DataFrame, col: str = "combined_anomaly",
                   metrics: Sequence[str] = ("HighFreq", "Diversity", "METEOR")) -> DataFrame:
    """Min, p25, median, p75, max of each metric among flagged rows."""
    flagged = anomalies.filter(F.col(col))
    names = ("min", "p25", "median", "p75", "max")
    rows = column_quantiles(flagged, metrics, [0.0, 0.25, 0.5, 0.75, 1.0])
    return rows.select("metric", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(names)])


def rule_alerts(features: DataFrame, rules: DataFrame, at_least: int = 2) -> DataFrame:
    """M8 applied: ``rules_held``, the numbers of the rules that hold on a row
    in ascending order, and ``alert``, true where ``at_least`` of them do.

    ``features`` has the columns that :func:`detect_anomalies` adds.  A rule
    whose value or threshold is NULL does not hold.  The thresholds are one
    row, sent to every task.
    """
    value = {"relation_residual": "diversity_relation_residual"}
    known = [(1, "HighFreq", ">"), (2, "Diversity", "<"), (3, "METEOR", "<"), (4, "Diversity_change", "abs>"),
             (5, "HighFreq_change", "abs>"), (6, "relation_residual", "abs>")]
    limits = rules.agg(*[F.max(F.when(F.col("rule") == r, F.col("threshold"))).alias(f"_limit{r}") for r, _, _ in known])
    held = []
    for r, metric, op in known:
        x, limit = F.col(value.get(metric, metric)), F.col(f"_limit{r}")
        holds = {">": x > limit, "<": x < limit, "abs>": F.abs(x) > limit}[op]
        held.append(F.when(holds, F.lit(r)))
    return (features.crossJoin(F.broadcast(limits))
            .withColumn("rules_held", F.array_compact(F.array(*held)))
            .withColumn("alert", F.size("rules_held") >= at_least)
            .drop(*[f"_limit{r}" for r, _, _ in known]))


def rules_dict(rules: DataFrame) -> dict:
    """The six thresholds of :func:`extract_rules` as a monitor rule config
    (6 rows, collected on the driver)."""
    by = {r["rule"]: r["threshold"] for r in rules.collect()}
    return {
        "highfreq_threshold": by[1], "diversity_threshold": by[2], "meteor_threshold": by[3],
        "diversity_change_threshold": by[4], "highfreq_change_threshold": by[5],
        "relation_residual_threshold": by[6],
    }
