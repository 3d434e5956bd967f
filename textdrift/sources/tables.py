"""Driver tables and their mapping onto the library's data model.

The library works on three shapes (see README):

* text records  ``(id, run, generation, input_text, generated_text)``
* metric observations ``(Run, Generation, 8 metric doubles)``
* monitor observations ``(monitor_id, seq order, Run, Generation, Perplexity,
  Diversity, HighFreq, METEOR)``

The functions below derive those shapes from the given parquet tables with
plain projections and aggregations, so every query reads whole tables and its
work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work at least one task per core.

    A large input already arrives in many splits and is left alone.  A small
    file with a single row group scans as one task; only then are its rows
    spread round-robin before tokenising.  Planning the scan runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as text records: Run = lang, Generation = source number.

    The document text is the generated text; there is no input text.
    """
    d = spread(read_table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("run"),
        F.substring("source", 4, 8).cast("int").alias("generation"),
        F.lit("").alias("input_text"),
        F.col("text").alias("generated_text"),
    )


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` texts: the reference corpus of the n-gram model."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


# Metric names of the observation table, in the order of the metric files.
METRICS = ["Perplexity", "Diversity", "HighFreq", "Entropy",
           "Rouge_1", "Rouge_2", "Rouge_L", "METEOR"]


def _share(cond) -> "F.Column":
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def lineitem_metric_exprs() -> dict:
    """The eight stand-in metrics as aggregate expressions.

    Each one is either exact in floating point (shares and means of integers,
    so every engine gets the same bits) or irrational (a geometric mean), so
    fixed-precision output never lands on a rounding tie.
    """
    return {
        "Perplexity": F.exp(F.avg(F.ln("l_extendedprice"))),
        "Diversity": F.countDistinct("l_partkey").cast("double"),
        "HighFreq": _share(F.col("l_quantity") > 25),
        "Entropy": F.avg("l_quantity"),
        "Rouge_1": F.avg(F.round(F.col("l_discount") * 100)) / 10.0,
        "Rouge_2": F.avg(F.round(F.col("l_tax") * 100)) / 10.0,
        "Rouge_L": _share(F.col("l_discount") >= 0.05),
        "METEOR": _share(F.col("l_quantity") <= 20),
    }


LINEITEM_METRIC_SQL = """
           exp(avg(ln(l_extendedprice))) AS Perplexity,
           CAST(count(DISTINCT l_partkey) AS DOUBLE) AS Diversity,
           avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS HighFreq,
           avg(l_quantity) AS Entropy,
           avg(round(l_discount * 100)) / 10.0 AS Rouge_1,
           avg(round(l_tax * 100)) / 10.0 AS Rouge_2,
           avg(CASE WHEN l_discount >= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS Rouge_L,
           avg(CASE WHEN l_quantity <= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS METEOR
"""


def lineitem_metrics(spark: SparkSession, sf_dir: str, experiment: str | None = None) -> DataFrame:
    """A metric observation table from ``lineitem``.

    One row per (Run = return flag, Generation = ship month since 1995-01).
    Eight aggregates stand in for the eight text metrics; their value ranges
    resemble the originals (a distinct count for Diversity, shares in [0, 1]
    for HighFreq and the overlap scores, a geometric mean for Perplexity).
    With ``experiment`` the rows are also split by line status and the column
    ``experiment`` is kept.
    """
    li = read_table(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("Run"),
            ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("Generation")]
    if experiment:
        keys = [F.col("l_linestatus").alias("experiment")] + keys
    return li.groupBy(*keys).agg(*[e.alias(n) for n, e in lineitem_metric_exprs().items()])


def lineitem_metrics_sql(experiment: bool = False) -> str:
    """DuckDB text of :func:`lineitem_metrics` (for oracles)."""
    exp = "l_linestatus AS experiment, " if experiment else ""
    grp = "l_linestatus, " if experiment else ""
    return f"""
    SELECT {exp}l_returnflag AS Run,
           CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS Generation,
           {LINEITEM_METRIC_SQL}
    FROM lineitem
    GROUP BY {grp}l_returnflag, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1
    """


def events_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of monitor observations.

    Arrival order is ``(ts, event_id)``; Run = user_id, Generation = day index.
    Diversity = value, HighFreq = k/100 from the JSON props, METEOR = value/50,
    Perplexity = value * k.
    """
    return events_observations_of(read_table(spark, sf_dir, "events"))


def events_observations_of(ev: DataFrame) -> DataFrame:
    """:func:`events_observations` of rows of ``events``, stored or streamed."""
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("event_id"), F.col("ts"),
        F.col("user_id").alias("Run"),
        F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("Generation"),
        (F.col("value") * k).alias("Perplexity"),
        F.col("value").alias("Diversity"),
        (k / 100.0).alias("HighFreq"),
        (F.col("value") / 50.0).alias("METEOR"),
    )


EVENTS_OBSERVATIONS_SQL = """
    SELECT event_id, ts, user_id AS Run,
           CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS Generation,
           value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS Perplexity,
           value AS Diversity,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS HighFreq,
           value / 50.0 AS METEOR
    FROM events
"""
