"""Statistics on metric and feature tables.

Data-heavy work is one aggregate pass in Spark; only p x p results (p = the
number of metric columns, a parameter) reach the driver, e.g. for the
eigen-decomposition of the correlation matrix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.operators.quantiles import column_quantiles


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, null_count)`` for every column, one aggregate pass."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("null_count"))
             for c in cols]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def describe_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max per column
    (long format: one row per column)."""
    aggs = []
    for c in cols:
        aggs.append(F.struct(F.lit(c).alias("metric"), F.count(c).alias("count"), F.avg(c).cast("double").alias("mean"),
                             F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                             F.max(c).cast("double").alias("max")))
    rows = df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("r")).select("r.*")
    quartile = [F.col("quantiles")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return (rows.join(column_quantiles(df, cols, [0.25, 0.5, 0.75]), "metric")
            .select("metric", "count", "mean", "std", "min", *quartile, "max"))


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments of every column pair a <= b (by place in ``cols``) over the rows
    in which both are not NULL: ``(a, b, n, sum_a, sum_b, sum_aa, sum_bb,
    sum_ab)``, values taken from their column's mean.

    One pass for the means, one for all pairs: a task multiplies its rows'
    matrix with itself, batch by batch, and sends one row per pair; Spark adds
    these up.  Memory and traffic of a task go with the square of the number
    of columns, not with its rows.  NaN makes its column's moments NaN.
    """
    cols = list(cols)
    p = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    i, j = np.triu_indices(p)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, c = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            have = np.column_stack([col.is_valid().to_numpy(zero_copy_only=False) for col in batch.columns]).astype(float)
            x = np.column_stack([col.fill_null(0.0).to_numpy(zero_copy_only=False) for col in batch.columns])
            x = np.where(have > 0, x - shift, 0.0)
            n += have.T @ have
            s += x.T @ have
            q += (x * x).T @ have
            c += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n[i, j].astype(np.int64)), pa.array(s[i, j]),
             pa.array(s[j, i]), pa.array(q[i, j]), pa.array(q[j, i]), pa.array(c[i, j])], names=names)

    names = ["a", "b", "n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab"]
    parts = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)]).mapInArrow(
        run, "a int, b int, n long, " + ", ".join(f"{name} double" for name in names[3:]))
    return parts.groupBy("a", "b").agg(*[F.sum(name).alias(name) for name in names[2:]])


def _both_ways(half: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """``(var_a, var_b, ...)`` for all ordered pairs."""
    named = F.array(*[F.lit(c) for c in cols])
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return (half.select(F.explode(ways).alias("w"), *keep)
            .select(named[F.col("w.a")].alias("var_a"), named[F.col("w.b")].alias("var_b"), *keep))


def _centred(total: str, left: str, right: str) -> Column:
    return F.try_divide(F.col(total) - F.try_divide(F.col(left) * F.col(right), F.col("n")), F.col("n"))


#: A variance below this share of the mean square that it is taken from is
#: rounding error: the column is constant there.
CONSTANT = 1e-10


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair over the rows in which
    both are not NULL, long format ``(var_a, var_b, corr)``; NULL when a
    column is constant there.  All pairs come from :func:`pair_moments`."""
    def spread(square: str, total: str) -> Column:
        var = _centred(square, total, total)
        return F.when(F.isnan(var) | (var > CONSTANT * F.try_divide(F.col(square), F.col("n"))), F.sqrt(var))

    half = pair_moments(df, cols).withColumn("corr", F.try_divide(
        _centred("sum_ab", "sum_a", "sum_b"), spread("sum_aa", "sum_a") * spread("sum_bb", "sum_b")))
    return _both_ways(half, cols, "corr")


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population covariance of every pair plus the row count,
    ``(var_a, var_b, cov, n)``: the sufficient statistic of a path model."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    half = pair_moments(df, cols).withColumn("cov", _centred("sum_ab", "sum_a", "sum_b"))
    return (_both_ways(half, cols, "cov").crossJoin(F.broadcast(rows))  # one row
            .withColumnRenamed("rows", "n"))


def matrix_from_long(rows, cols: Sequence[str], value: str) -> np.ndarray:
    """Collected long rows -> p x p numpy matrix (p = len(cols))."""
    idx = {c: i for i, c in enumerate(cols)}
    m = np.full((len(cols), len(cols)), np.nan)
    for r in rows:
        v = r[value]
        m[idx[r["var_a"]], idx[r["var_b"]]] = np.nan if v is None else v
    return m


def pca_from_correlation(corr: np.ndarray):
    """M2: eigenpairs of a correlation matrix, eigenvalues descending, each
    eigenvector's sign fixed so its first loading is >= 0."""
    vals, vecs = np.linalg.eigh(corr)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    signs = np.where(vecs[:1, :] < 0, -1.0, 1.0)
    vecs = vecs * signs
    ratio = vals / len(vals)
    return vals, vecs, ratio, np.cumsum(ratio)


def pca(df: DataFrame, cols: Sequence[str]):
    """M2: one Spark aggregate for the correlation matrix, then the p x p
    eigen-decomposition on the driver.  Returns numpy arrays.

    A column without variance has no correlations: it is left out, so there
    are as many components as columns that vary and their shares end at 1;
    its loadings are NaN."""
    rows = correlation_matrix(df, cols).collect()  # p*p rows, p is a parameter
    corr = matrix_from_long(rows, cols, "corr")
    vary = np.flatnonzero(~np.isnan(np.diag(corr)))
    if not len(vary):
        raise ValueError(f"no column varies: {', '.join(cols)}")
    vals, own, ratio, total = pca_from_correlation(np.nan_to_num(corr[np.ix_(vary, vary)]))
    vecs = np.full((len(cols), len(vary)), np.nan)
    vecs[vary] = own
    return vals, vecs, ratio, total


def pca_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2 as a table: one row per variable with its loadings ``a_1..a_p``,
    then the rows ``eigenvalue``, ``explained_ratio`` and, computed with a
    running-sum window over the p components (W9), ``cumulative_ratio``."""
    spark = df.sparkSession
    vals, vecs, _, _ = pca(df, cols)
    p = len(vals)  # the columns that vary
    comp = spark.createDataFrame(
        [(j + 1, float(vals[j])) for j in range(p)], "component int, eigenvalue double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    comp = comp.withColumn("explained_ratio", F.col("eigenvalue") / F.lit(float(p)))
    comp = comp.withColumn("cumulative_ratio", F.sum("explained_ratio").over(w))  # p rows
    loadings = spark.createDataFrame(
        [(c, j + 1, None if np.isnan(vecs[i, j]) else float(vecs[i, j])) for i, c in enumerate(cols) for j in range(p)],
        "label string, component int, value double")
    stats = comp.select(F.col("component"), F.explode(F.array(
        F.struct(F.lit("eigenvalue").alias("label"), F.col("eigenvalue").alias("value")),
        F.struct(F.lit("explained_ratio").alias("label"), F.col("explained_ratio").alias("value")),
        F.struct(F.lit("cumulative_ratio").alias("label"), F.col("cumulative_ratio").alias("value")),
    )).alias("s")).select(F.col("s.label").alias("label"), "component", F.col("s.value").alias("value"))
    long = loadings.unionByName(stats)
    return (long.groupBy("label").pivot("component", list(range(1, p + 1)))
            .agg(F.first("value"))
            .select("label", *[F.col(str(j)).alias(f"a_{j}") for j in range(1, p + 1)]))


def pca_scores(df: DataFrame, cols: Sequence[str], k: int | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """Project z-scored rows onto the first ``k`` components.  The loadings
    are literals in a column expression, so scoring is a map-only pass."""
    vals, vecs, _, _ = pca(df, cols)
    k = min(k or len(cols), len(vals))
    vary = [i for i in range(len(cols)) if not np.isnan(vecs[i]).any()]
    vecs, cols = vecs[vary], [cols[i] for i in vary]  # constant columns have no scores
    stats = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                   *[F.stddev_pop(c).alias(f"{c}__s") for c in cols])
    x = df.crossJoin(F.broadcast(stats))
    z = {c: F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s")) for c in cols}
    comps = []
    for j in range(k):
        expr = None
        for i, c in enumerate(cols):
            term = F.coalesce(z[c], F.lit(0.0)) * F.lit(float(vecs[i, j]))
            expr = term if expr is None else expr + term
        comps.append(expr.alias(f"pc_{j + 1}"))
    return x.select(*keep, *comps)


def relation_residual(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """M3: least-squares line of ``y`` on ``x`` over the whole table and the
    residual ``y - (a + b x)`` in column ``out``.  The fit is a one-row
    aggregate (``regr_slope``/``regr_intercept``) joined by broadcast."""
    fit = df.agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"),
                 F.avg(y).alias("__ybar"))
    j = df.crossJoin(F.broadcast(fit))
    # A constant x gives NULL slope/intercept: the least-squares answer is
    # then slope 0 and intercept mean(y).
    b = F.coalesce(F.col("__b"), F.lit(0.0))
    a = F.coalesce(F.col("__a"), F.col("__ybar"))
    return j.withColumn(out, F.col(y) - (a + b * F.col(x))).drop("__a", "__b", "__ybar")


def mae(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Mean absolute error."""
    return df.agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"))


def coefficients_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                      name: str = "path", value: str = "value") -> DataFrame:
    """Wide -> long (``unpivot``)."""
    return df.unpivot(list(ids), list(values), name, value)


def exact_quantile(df: DataFrame, col: str, q: float, tiebreak: str) -> DataFrame:
    """Exact linear-interpolated quantile of a large column without holding
    all values in one aggregation buffer: rows are ranked by a range-
    partitioned sort (distributed sequence numbers), then the two rows around
    position ``q * (n - 1)`` are read.  One row ``(quantile)``."""
    from textdrift.streaming.monitor import assign_sequence
    ranked = assign_sequence(df.select(col, tiebreak).filter(F.col(col).isNotNull()),
                             [col, tiebreak])
    n = ranked.count()
    if n == 0:
        return df.sparkSession.createDataFrame([(None,)], "quantile double")
    pos = q * (n - 1)
    lo, hi = int(pos // 1), int(-(-pos // 1))
    two = ranked.filter(F.col("seq").isin(lo, hi)).agg(
        F.min(F.when(F.col("seq") == lo, F.col(col))).alias("_lo"),
        F.min(F.when(F.col("seq") == hi, F.col(col))).alias("_hi"))
    frac = float(pos - lo)
    return two.select((F.col("_lo") + F.lit(frac) * (F.col("_hi") - F.col("_lo")))
                      .cast("double").alias("quantile"))
