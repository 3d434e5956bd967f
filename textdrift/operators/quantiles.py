"""Exact quantiles of many columns and groups at once.

The values are reduced to (group, column, value, count) by an ordinary
two-step aggregate, so a value that a third of all rows share is one row.
These are range-partitioned and written once with the number of their block.
Counts per block, at most one row per block, group and column, say which block
holds each rank that is asked for; only those blocks are read again and
numbered, block by block.  No buffer grows with a group's distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.session import materialize


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``(group..., metric, quantiles)``: for every group and column the exact
    quantiles at ``probs``, interpolated linearly between the two ranks around
    ``p * (n - 1)``.

    NULL values are left out; a group and column without any value has no row.
    NaN ranks above all numbers; NULL is a group of its own.
    """
    spark = df.sparkSession
    keys = [f"_g{i}" for i in range(len(group_cols))] + ["_metric"]
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    counted = (df.select(*[F.col(c).alias(k) for c, k in zip(group_cols, keys)], F.explode(values).alias("v"))
               .select(*keys[:-1], F.col("v.metric").alias("_metric"), F.col("v.value").alias("_value"))
               .where(F.col("_value").isNotNull())
               .groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_count")))
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(counted.repartitionByRange(n, *keys, "_value").withColumn("_block", F.spark_partition_id()))

    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (stored.groupBy(*keys, "_block").agg(F.sum("_count").alias("_size"))
             .withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0)))
             .withColumn("_n", F.sum("_size").over(whole)))

    place = F.col("_place")
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    ranks = (sizes.withColumn("_p", F.explode(asked)).withColumn("_place", F.col("_p.p") * (F.col("_n") - 1))
             .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
             .where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_size"))))
    wanted = ranks.groupBy(*keys, "_block").agg(F.collect_list(F.struct(  # at most two ranks per probability
        F.col("_p.i").alias("i"), (F.col("_rank") - F.col("_first")).alias("rank"),
        (1 - F.abs(place - F.col("_rank"))).alias("weight"))).alias("_wanted"))

    own = wanted.select(*[F.col(k).alias(f"{k}_w") for k in [*keys, "_block"]], "_wanted")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_w")) for k in [*keys, "_block"]])
    up_to = Window.partitionBy(*keys, "_block").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    found = (stored.join(own, match).withColumn("_end", F.sum("_count").over(up_to))
             .withColumn("_hit", F.explode(F.filter("_wanted", lambda w: (w["rank"] < F.col("_end"))
                                                    & (w["rank"] >= F.col("_end") - F.col("_count"))))))
    parts = [F.sum(F.when(F.col("_hit.i") == i, F.col("_hit.weight") * F.col("_value"))) for i in range(len(probs))]
    return (found.groupBy(*keys).agg(F.array(*parts).alias("quantiles"))
            .select(*[F.col(k).alias(c) for c, k in zip(group_cols, keys)], F.col("_metric").alias("metric"), "quantiles"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(metric, quantiles)`` with a row for every column, NULL quantiles
    where it has no value."""
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "metric string")
    none = F.array(*[F.lit(None).cast("double") for _ in probs])
    return (every.join(exact_quantiles(df, cols, probs), "metric", "left")
            .select("metric", F.coalesce("quantiles", none).alias("quantiles")))


def join_groups(left: DataFrame, right: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, one row per group there, groups
    compared null-safely."""
    return left.join(right, _same(left, right, group_cols), "left").drop(*[right[c] for c in group_cols])
