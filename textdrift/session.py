"""Session helpers.

The library never creates a global session: every function takes a
``SparkSession`` or a ``DataFrame``.  ``local_session`` exists for tests,
``bench.py`` and the examples only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "textdrift") -> SparkSession:
    """A local session tuned for small scale factors (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEXTDRIFT_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only a local-mode session without the setting (tests, bench) gets a
    fresh folder under the system temp directory; a cluster session without
    the setting is an error, because a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this job")
    folder = tempfile.mkdtemp(prefix="textdrift-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df):
    """Write an intermediate table once as parquet into the shared
    checkpoint folder and read it back: the lineage is cut (a lost executor
    re-reads the files instead of recomputing the inputs) and every later
    read is a columnar scan instead of a recomputation."""
    import uuid
    spark = df.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + f"/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
