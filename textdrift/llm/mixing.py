"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear
between knots.  Its integral is the source's weight in the whole mix; its
running integral, scaled to the source's target, is the cumulative token
demand.  A document copy that starts after ``c`` of its source's tokens is
needed when the demand reaches ``c``: inverting the running integral at
``c / target`` gives its training position, and the mix is range-sorted by
position.  Everything is DataFrame expressions.

Targets: the sources, ordered by code point with null last, take the
schedules in turn.  They share ``budget`` times all tokens by weight; no
target exceeds ``max_epochs`` times its source, the excess is shared by
weight among the others until none is above.  A source is repeated pass by
pass in one fixed pseudo-random order (MD5 of the id).

No window covers a source: its order is cut into buckets by the leading
digits of the MD5, as many as its rows ask for, and the running sum is the
sum of the earlier buckets (one row per bucket) plus a window inside the
bucket.  Only the table of sources, one row each, is ordered in one task.

Defined cases.  A null text has no tokens.  A null source is a source of its
own, the last.  A document without tokens takes none.  Repeated rows, and rows
without an id, are separate rows of the order.  Empty input gives an empty
result.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialize, text_or_empty

#: (time, weight) knots.  Integrals over 0..1: 5, 2 and 1.
SCHEDULES = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
ROWS_PER_BUCKET = 20_000

Knots = Sequence[tuple[float, float]]


def integral(knots: Knots) -> float:
    """The area below a piecewise linear schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def time_of(share: Column, knots: Knots) -> Column:
    """The time at which the running integral reaches ``share`` of the whole;
    beyond 1 the demand has ended and the share itself is returned."""
    whole, area = integral(knots), 0.0
    out = F.when(share >= 1.0, share)
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        piece = (t1 - t0) * (w0 + w1) / 2
        rest = share * whole - area
        slope = (w1 - w0) / (t1 - t0)
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
        if piece > 0:
            out = out.when(share * whole < area + piece, F.lit(t0) + F.when(root > 0, rest * 2 / root).otherwise(0.0))
        area += piece
    return out.otherwise(F.lit(1.0))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          row: str | None = None) -> DataFrame:
    """``doc_id, source, size, place`` and, if named, ``row``: size in words,
    place the MD5 of the id (of the text, where there is no id)."""
    key = [] if row is None else [F.col(row).alias("row")]
    name = F.concat(F.lit("text "), text_or_empty(text))
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), name)).alias("place"), *key)


def targets(sizes: DataFrame, schedules: Sequence[Knots] = SCHEDULES, budget: float = 1.5,
            max_epochs: float = 2.0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per source: ``source, source_size, schedule, target, buckets``.

    The water level is found without a loop: ordered by the level at which
    they fill, a source is full if filling all earlier ones leaves enough for
    it, and the full ones are a prefix of that order.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(integral(k)) for k in schedules]), F.col("schedule") + 1)
    named = (per_source
             .withColumn("schedule", ((F.row_number().over(turn) - 1) % len(schedules)).cast("int"))
             .withColumn("weight", weight)
             .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    share = F.sum("source_size").over(everything) * F.lit(float(budget))
    full = (named.withColumn("share", share)
            .withColumn("full", F.col("cap") * F.sum("weight").over(after)
                        <= (F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) * F.col("weight")))
    held = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    return (full.withColumn("held", held).withColumn("open_weight", open_weight)
            .select("source", "source_size", "schedule",
                    F.when(F.col("full"), F.col("cap"))
                    .otherwise((F.col("share") - F.col("held")) * F.col("weight") / F.col("open_weight")).alias("target"),
                    F.ceil(F.col("n") / rows_per_bucket).cast("int").alias("buckets")))


def mix(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, budget: float = 1.5,
        max_epochs: float = 2.0, cut_last: bool = True, rows_per_bucket: int = ROWS_PER_BUCKET,
        doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """The mix, one row per document: ``doc_id, source, size, source_size,
    target, copies, taken, positions`` and, if ``row`` names a column of
    ``docs`` with a key per row, that key as ``row``.

    ``positions`` has the training position of each copy.  With ``cut_last``
    the copy that crosses the end of its source's demand is taken up to that
    word, so a source's ``taken`` sums to its target's whole part; without it
    copies are whole and the one that crosses is taken if at least half of it
    lies inside.  Documents that no pass reaches have ``copies = 0``.
    """
    sizes = materialize(sized(docs, doc_id, text, source, row))
    own = [] if row is None else ["row"]
    plan = materialize(targets(sizes, schedules, budget, max_epochs, rows_per_bucket))
    # 32 bits of the MD5 as a number in 0..1, then the bucket inside the source
    unit = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    p = plan.select(F.col("source").alias("plan_source"), "source_size", "schedule", "target", "buckets")
    rows = sizes.join(p, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")
    rows = rows.withColumn("bucket", F.floor(unit * F.col("buckets")).cast("int"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = (Window.partitionBy("source").orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
                           F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("b_start"))
    inside = (Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", *own)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
              .withColumn("start", F.col("b_start") + F.col("within")))
    passes = F.sequence(F.lit(0), F.lit(math.ceil(max_epochs) - 1))
    begin = lambda k: F.col("start") + k * F.col("source_size")
    if cut_last:
        inside_demand = lambda k: begin(k) < F.floor("target")
        words = lambda k: F.least(F.col("size"), F.floor("target") - begin(k))
    else:
        inside_demand = lambda k: begin(k) + F.col("size") / 2 <= F.col("target")
        words = lambda k: F.col("size")
    positions = F.lit(None)

    def times(knots: Knots) -> Column:
        return F.transform("used", lambda k: time_of(begin(k) / F.col("target"), knots))

    for i, knots in enumerate(schedules):
        positions = F.when(F.col("schedule") == i, times(knots)).otherwise(positions)
    return (placed.withColumn("used", F.filter(passes, inside_demand))
            .withColumn("taken", F.aggregate("used", F.lit(0).cast("long"), lambda s, k: s + words(k)))
            .withColumn("positions", F.when(F.col("target") > 0, positions))
            .select("doc_id", "source", "size", "source_size", "target",
                    F.size("used").alias("copies"), "taken", "positions",
                    F.when(F.col("target") > 0, F.col("start") / F.col("target")).alias("reach"), "place", *own))


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sort the mix by the first copy's position; documents the mix
    does not reach come after, in the order in which it would reach them."""
    key = F.when(F.col("copies") > 0, F.col("positions")[0]).otherwise(F.lit(1.0) + F.coalesce("reach", F.lit(0.0)))
    rows = materialize(mixed.withColumn("position", key))
    return rows.repartitionByRange("position", "place").sortWithinPartitions("position", "place")


def training_places(mixed: DataFrame, key: str) -> DataFrame:
    """``mix_key, mix_part, mix_order`` of every copy: ranges of positions are
    dealt out and sorted here, on narrow rows, so that the documents
    themselves need be moved only once."""
    copies = mixed.where("copies > 0").select(F.col(key).alias("mix_key"), F.col("place").alias("mix_place"),
                                              F.explode("positions").alias("mix_position"))
    return materialize(copies.repartitionByRange("mix_position", "mix_place").sortWithinPartitions("mix_position", "mix_place")
                       .select("mix_key", F.spark_partition_id().alias("mix_part"), F.monotonically_increasing_id().alias("mix_order")))


def in_training_order(rows: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with their places, sorted by them: one copy of a row
    goes to the part that holds its position.  The places were written, so
    Spark knows their size: few are sent to the rows, many are joined by sort-merge."""
    parts = (places.agg(F.max("mix_part")).first()[0] or 0) + 1
    return (rows.join(places, F.col(key).eqNullSafe(F.col("mix_key"))).repartitionById(parts, F.col("mix_part"))
            .sortWithinPartitions("mix_order"))


def curriculum(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in training order.

    Each row meets its own row of the mix: by ``row``, the key that ``mix``
    was given, or else by the id, which must then tell all rows apart."""
    key, name = (doc_id, "doc_id") if row is None else (row, "row")
    if row is None and not docs.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1").isEmpty():
        raise ValueError(f"{key} does not tell the rows apart: give mix and curriculum a key per row")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc")
    rows = docs.select(F.col(key).alias("mix_own"), whole)
    return in_training_order(rows, training_places(mixed, name), "mix_own").select("mix_doc.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = by_position(mix(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies",
                        F.round("position", 9).alias("first_position"))


OP2_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS place FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), named AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS schedule FROM per
), weighed AS (
  SELECT *, CASE schedule WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS share FROM named
), filled AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (share - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM weighed
), plan AS (
  SELECT source, source_size, schedule,
         CASE WHEN is_full THEN cap ELSE (share - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * weight
              / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target FROM filled
), o AS (
  SELECT s.doc_id, s.size, p.source_size, p.schedule, p.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), t AS (
  SELECT *, (CASE WHEN start < floor(target) THEN 1 ELSE 0 END + CASE WHEN start + source_size < floor(target) THEN 1 ELSE 0 END) AS copies,
         greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS taken,
         start / target AS u FROM o
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, copies::INTEGER AS copies, round(
  CASE WHEN copies = 0 THEN 1.0 + u
       WHEN schedule = 0 THEN u * 5 * 2 / (6 + sqrt(36 - 4 * (u * 5)))
       WHEN schedule = 1 THEN u
       WHEN u < 0.375 THEN u * 2 / (0.5 + sqrt(0.25 + 2 * u))
       ELSE 0.5 + (u - 0.375) * 2 / (1 + sqrt(1 + 2 * (u - 0.375))) END, 9) AS first_position
FROM t
"""
