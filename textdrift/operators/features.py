"""Feature table of a metric table.

Input: one row per (Run, Generation) with metric columns.  Order is always
explicit (``Generation`` inside each ``Run``), never file order.

Scale notes.  Per-run windows (lag, lead, percent change) are partitioned by
``Run``; a window partition holds one row per generation of a run, so its size
is the number of generations, which does not grow with the volume of scored
text.  Whole-table statistics (means, standard deviations) are computed as a
one-row aggregate and attached with a broadcast cross join, never with an
empty ``over()`` window, which would move every row into a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.operators.quantiles import exact_quantiles, join_groups
from textdrift.sources.tables import METRICS

# Column renames from the metric-file header to feature names.
RENAMES = {
    "3gram_Diversity": "Diversity",
    "HighFreq_Ratio": "HighFreq",
    "Rouge-1": "Rouge_1",
    "Rouge-2": "Rouge_2",
    "Rouge-L": "Rouge_L",
}

# Columns that get lags and percent changes, and squared terms.
LAGGED = ["Perplexity", "Diversity", "HighFreq", "METEOR"]
SQUARED = ["HighFreq", "Diversity"]
COLLAPSE_THRESHOLD = 0.4


def standard_names(df: DataFrame, renames: Mapping[str, str] = RENAMES) -> DataFrame:
    """Rename metric-file columns to feature names (absent ones ignored)."""
    present = {k: v for k, v in renames.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise ValueError naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def available_features(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted features that exist (absent ones dropped, all checked)."""
    return [c for c in wanted if c in df.columns]


def _run_window(run: str, order: str):
    return Window.partitionBy(run).orderBy(order)


def add_lags(df: DataFrame, cols: Sequence[str] = LAGGED, run: str = "Run",
             order: str = "Generation") -> DataFrame:
    """``{c}_lag1`` = previous value within the run."""
    w = _run_window(run, order)
    return df.withColumns({f"{c}_lag1": F.lag(c, 1).over(w) for c in cols})


def pct_change(c: str, w) -> Column:
    """``x / previous - 1``; NULL for the first row and for a zero base."""
    return F.try_divide(F.col(c), F.lag(c, 1).over(w)) - F.lit(1.0)


def add_changes(df: DataFrame, cols: Sequence[str] = LAGGED, run: str = "Run",
                order: str = "Generation") -> DataFrame:
    """W2 for several columns: ``{c}_change``."""
    w = _run_window(run, order)
    return df.withColumns({f"{c}_change": pct_change(c, w) for c in cols})


def add_squares(df: DataFrame, cols: Sequence[str] = SQUARED) -> DataFrame:
    """``{c}_sq``."""
    return df.withColumns({f"{c}_sq": F.pow(F.col(c), 2) for c in cols})


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``{c}__mean`` and population ``{c}__std`` for each column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.agg(*aggs)


def zscore(df: DataFrame, cols: Sequence[str] = METRICS, suffix: str = "_scaled") -> DataFrame:
    """``(x - mean) / std`` with the population std (ddof 0); a
    zero-variance column is divided by 1, so it scales to 0.

    The statistics are a one-row aggregate joined with a broadcast cross
    join (its size is one row by construction).
    """
    stats = column_stats(df, cols)
    joined = df.crossJoin(F.broadcast(stats))
    out = {}
    for c in cols:
        std = F.col(f"{c}__std")
        scale = F.when((std.isNull()) | (std == 0), F.lit(1.0)).otherwise(std)
        out[f"{c}{suffix}"] = (F.col(c) - F.col(f"{c}__mean")) / scale
    drop = [f"{c}__{s}" for c in cols for s in ("mean", "std")]
    return joined.withColumns(out).drop(*drop)


def ensure_scaled(df: DataFrame, cols: Sequence[str] = METRICS,
                  suffix: str = "_scaled") -> DataFrame:
    """Reuse existing ``*_scaled`` columns, else compute the z-scores."""
    if all(f"{c}{suffix}" in df.columns for c in cols):
        return df
    return zscore(df, available_features(df, cols), suffix)


def add_collapse_flag(df: DataFrame, col: str = "METEOR",
                      threshold: float = COLLAPSE_THRESHOLD) -> DataFrame:
    """``is_collapsed`` = metric below the threshold (NULL -> false)."""
    return df.withColumn("is_collapsed", F.coalesce(F.col(col) < F.lit(threshold), F.lit(False)))


def add_next_flag(df: DataFrame, run: str = "Run", order: str = "Generation") -> DataFrame:
    """``next_gen_collapse`` = next generation's flag, false at the end."""
    w = _run_window(run, order)
    return df.withColumn("next_gen_collapse",
                         F.coalesce(F.lead("is_collapsed", 1).over(w), F.lit(False)))


def build_features(metrics: DataFrame, run: str = "Run", order: str = "Generation",
                   metric_cols: Sequence[str] = METRICS) -> DataFrame:
    """The full feature table (P1-P5, W1-W4) in one pass of per-run windows.

    All window expressions share one specification, so Spark evaluates them
    in a single Window operator after a single shuffle on ``run``.
    """
    df = standard_names(metrics)
    w = _run_window(run, order)
    cols = {f"{c}_lag1": F.lag(c, 1).over(w) for c in LAGGED}
    cols.update({f"{c}_change": pct_change(c, w) for c in LAGGED})
    cols.update({f"{c}_sq": F.pow(F.col(c), 2) for c in SQUARED})
    flag = F.coalesce(F.col("METEOR") < F.lit(COLLAPSE_THRESHOLD), F.lit(False))
    cols["is_collapsed"] = flag
    cols["next_gen_collapse"] = F.coalesce(
        F.lead(F.col("METEOR") < F.lit(COLLAPSE_THRESHOLD), 1).over(w), F.lit(False))
    df = df.withColumns(cols)
    df = zscore(df, metric_cols)
    scaled = [f"{c}_scaled" for c in metric_cols]
    return df.dropna(subset=scaled)


# ---------------------------------------------------------------------------
# Gap filling, experiment union, group means, dispersion
# ---------------------------------------------------------------------------

def lagrange_weights(target: float, nodes: Sequence[float]) -> list[float]:
    """Lagrange basis values ``L_j(target)`` for the given nodes."""
    out = []
    for j, xj in enumerate(nodes):
        w = 1.0
        for m, xm in enumerate(nodes):
            if m != j:
                w *= (target - xm) / (xj - xm)
        out.append(w)
    return out


def lagrange_fill(metrics: DataFrame, target: int, nodes: Sequence[int],
                  cols: Sequence[str] = METRICS, run: str = "Run",
                  order: str = "Generation") -> DataFrame:
    """M1: interpolate the metrics of generation ``target`` per run from
    the rows at ``nodes`` (polynomial through all nodes).

    Runs that lack any node get no row.  The basis weights depend only on the
    parameters, so the data work is one grouped weighted sum.
    """
    weights = lagrange_weights(target, nodes)
    wcol = reduce(lambda acc, nw: acc.when(F.col(order) == nw[0], F.lit(nw[1])),
                  zip(nodes[1:], weights[1:]),
                  F.when(F.col(order) == nodes[0], F.lit(weights[0])))
    sel = metrics.filter(F.col(order).isin(list(nodes))).withColumn("_w", wcol)
    agg = sel.groupBy(run).agg(
        F.countDistinct(order).alias("_n"),
        *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in cols])
    return (agg.filter(F.col("_n") == len(nodes))
            .select(F.col(run), F.lit(target).alias(order), *cols))


def fill_generation(metrics: DataFrame, target: int, nodes: Sequence[int],
                    cols: Sequence[str] = METRICS, run: str = "Run",
                    order: str = "Generation") -> DataFrame:
    """M1 applied: runs without generation ``target`` get its interpolation
    where they have all nodes.  Rows that exist stay as they are."""
    present = metrics.filter(F.col(order) == target).select(run).distinct()
    filled = lagrange_fill(metrics, target, nodes, cols, run, order).join(present, run, "left_anti")
    return metrics.select(run, order, *cols).unionByName(filled)


def union_experiments(tables: Mapping[str, DataFrame], name: str = "experiment") -> DataFrame:
    """Stack experiment tables, keeping which experiment a row came from."""
    frames = [df.withColumn(name, F.lit(key)) for key, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mean_by_generation(df: DataFrame, cols: Sequence[str] = METRICS,
                       keys: Sequence[str] = ("experiment", "Generation")) -> DataFrame:
    """A1: mean of each metric per (experiment, Generation)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def dispersion(df: DataFrame, cols: Sequence[str], group: str = "Generation") -> DataFrame:
    """Per group mean, sample std, CV = std/mean, IQR (exact quantiles,
    linearly interpolated, see ``quantiles``); two passes over ``df``."""
    aggs, ranges, out = [], [], []
    for c in cols:
        name = c.replace("_", "").replace("-", "")
        mean, std = F.avg(c), F.stddev_samp(c)
        aggs += [mean.alias(f"{name}_Mean"), std.alias(f"{name}_STD"), F.try_divide(std, mean).alias(f"{name}_CV")]
        width = F.col("quantiles")[1] - F.col("quantiles")[0]
        ranges.append(F.max(F.when(F.col("metric") == c, width)).alias(f"{name}_IQR"))
        out += [f"{name}_{part}" for part in ("Mean", "STD", "CV", "IQR")]
    iqr = exact_quantiles(df, cols, [0.25, 0.75], [group]).groupBy(group).agg(*ranges)
    return join_groups(df.groupBy(group).agg(*aggs), iqr, [group]).select(group, *out)
