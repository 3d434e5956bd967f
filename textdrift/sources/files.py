"""File sources and sinks (S1-S11) with explicit schemas (no inference)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# Header of the metric files (Generation, Run, 8 metrics).
METRIC_FILE_COLUMNS = ["Generation", "Run", "Perplexity", "3gram_Diversity", "HighFreq_Ratio",
                       "Entropy", "Rouge-1", "Rouge-2", "Rouge-L", "METEOR"]

METRICS_SCHEMA = T.StructType(
    [T.StructField("Generation", T.IntegerType()), T.StructField("Run", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in METRIC_FILE_COLUMNS[2:]])

TEXT_RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("generation", T.IntegerType()),
    T.StructField("run", T.IntegerType()), T.StructField("input_text", T.StringType()),
    T.StructField("generated_text", T.StringType())])


def read_metrics(spark: SparkSession, path: str, schema: T.StructType = METRICS_SCHEMA) -> DataFrame:
    """Metric CSV with a header, typed by an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def matrix_schema(p: int, prefix: str = "c") -> T.StructType:
    return T.StructType([T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(p)])


def read_matrix(spark: SparkSession, path: str, p: int) -> DataFrame:
    """Headerless all-double CSV with ``p`` columns."""
    return spark.read.schema(matrix_schema(p)).option("header", False).csv(path)


def read_text_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: text records; ``generated_text`` is required, a missing
    ``input_text`` becomes ''."""
    df = spark.read.format(fmt).load(path)
    if "generated_text" not in df.columns:
        raise ValueError("text records need a generated_text column")
    if "input_text" not in df.columns:
        df = df.withColumn("input_text", F.lit(""))
    return df.withColumn("input_text", F.coalesce(F.col("input_text"), F.lit("")))


def read_corpus(spark: SparkSession, path: str, split: str, text_col: str | None = None) -> DataFrame:
    """One split of a corpus with a ``split`` column; the text column is
    ``text`` or else the first non-split column."""
    df = spark.read.parquet(path).filter(F.col("split") == split)
    col = text_col or ("text" if "text" in df.columns else [c for c in df.columns if c != "split"][0])
    return df.select(F.col(col).alias("text"), *[c for c in df.columns if c not in (col, "split")])


def read_first_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "csv",
                        **options) -> DataFrame:
    """The first path that can be read; error listing all when none can."""
    errors = []
    for p in paths:
        try:
            df = spark.read.format(fmt).options(**options).load(p)
            df.schema  # noqa: B018 - resolves the path now
            return df
        except AnalysisException as e:
            errors.append(f"{p}: {e.getMessage() if hasattr(e, 'getMessage') else e}")
    raise FileNotFoundError("none of the paths exists: " + "; ".join(errors))


def write_matrix(df: DataFrame, path: str, header: bool = False, digits: int | None = None) -> None:
    """S7 + S10: CSV without index, with or without header, optional fixed
    precision (``round(col, digits)``)."""
    out = df
    if digits is not None:
        out = df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                          if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                          for f in df.schema.fields])
    out.write.mode("overwrite").option("header", header).csv(path)


def append_metrics(df: DataFrame, path: str, partitioned: bool = False) -> None:
    """Append metric rows (one per scored generation and run);
    ``partitioned`` adds a ``scored_at`` timestamp and partitions the files by
    generation and run."""
    out = df
    writer = None
    if partitioned:
        out = df.withColumn("scored_at", F.current_timestamp())
        writer = out.write.mode("append").partitionBy(
            *[c for c in ("Generation", "Run", "generation", "run") if c in df.columns])
    else:
        writer = out.write.mode("append")
    writer.parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append the flat alert table as JSON lines."""
    alerts.write.mode("append").json(path)
