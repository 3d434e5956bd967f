"""Exact deduplication against a persistent digest index.

The index is a Spark table ``(digest, keep_id, batch)`` bucketed and sorted by
the digest.  A batch of documents is reduced to one row per digest; a
sort-merge anti-join with the index (which is neither shuffled nor sorted again
while it has one file per bucket; only the batch is dealt out) finds the new
digests, these are appended, and the answer for every document is read from
the index.  The first batch goes the same way, through an empty index.

The index lives in its folder: its number of buckets is written beside the
files, and another session that names the same folder finds what is there.
Filled folders are never overwritten.  A batch has a name; documents stay only
where the index says that their own batch brought the digest, so a batch that is
run again, wholly or after a failure, gives the same answer and appends what
is missing.  A name stands for the same rows each time.

Defined cases.  A null text counts as empty; empty and white-space-only texts
form one or two groups like any others ("" and " ").  A null id is larger
than every other, so a row without an id stays only if its group has no id at
all.  Of several rows with the group's smallest id, or without any id, one
stays.  An empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpoint_dir, documents, keyed_rows, materialize, sources_of, text_or_empty

BUCKETS = 64


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``digest``: SHA-256 of the text with every run of white
    space replaced by one space."""
    return docs.withColumn("digest", F.sha2(F.regexp_replace(text_or_empty(text), SPACE, " "), 256))


class DigestIndex:
    """A named, persistent index.  ``path`` is its folder, which all executors
    share; the default is below the checkpoint folder.  An index that is
    there keeps its number of buckets, whatever ``buckets`` says."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None,
                 buckets: int = BUCKETS) -> None:
        self.spark, self.name = spark, name
        self.path = (path or f"{checkpoint_dir(spark).rstrip('/')}/index-{name}").rstrip("/")
        found = self._spec()
        self.buckets = buckets if found is None else found["buckets"]
        self.id_type = None if found is None else found["id_type"]
        if found is not None:
            self._register()

    def _spec(self) -> dict | None:
        try:
            row = self.spark.read.json(f"{self.path}/spec").first()
        except AnalysisException:  # no such folder: no index yet
            return None
        return None if row is None else row.asDict()

    def _register(self) -> None:
        """Name the folder's files as a bucketed table of this session."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest STRING, keep_id {self.id_type}, batch STRING) "
                       f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{self.path}/data'")
        at = self.spark.sql(f"DESCRIBE FORMATTED `{self.name}`").where("col_name = 'Location'").first()[1]
        if not at.rstrip("/").endswith(self.path.split(":", 1)[-1].lstrip("/") + "/data"):
            raise ValueError(f"table {self.name} belongs to another folder: {at}")

    def exists(self) -> bool:
        return self.id_type is not None

    def create(self, id_type: str) -> None:
        """Write an empty index, unless there is one."""
        if not self.exists():
            self.id_type = id_type
            (self.spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string").coalesce(1)
             .write.mode("error").json(f"{self.path}/spec"))
            self._register()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest the index does not hold."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add ``(digest, keep_id, batch)`` rows; one file per bucket and batch."""
        (groups.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
         .write.mode("append").format("parquet").option("path", f"{self.path}/data")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def deduplicate(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id",
                text: str = "text", batch: str | None = None, row: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256,
    seen_before`` and, if ``row`` names a column with a key per row, that key.

    ``group_size`` counts the rows of this batch.  Where an earlier batch
    already holds the digest, ``keep_id`` names that batch's document and no
    row of this batch stays.  ``batch`` is the batch's name, by default a new one.

    A hot group costs little: its rows meet only after a partial count in
    each task, and the join that hands the group's result back to its rows is
    between two plain exchanges, which adaptive execution splits when a
    digest is skewed.
    """
    batch = batch or uuid.uuid4().hex
    own = [] if row is None else [F.col(row).alias("own_row")]
    rows = materialize(with_digest(sources_of(docs, doc_id, text, *([] if row is None else [row])), text)
                       .select(F.col(doc_id).alias("doc_id"), "digest", *own))
    if row is None:
        rows = keyed_rows(rows, "own_row").select("own_row", "doc.doc_id", "doc.digest")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own_row")
    groups = materialize(rows.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("group_size")))
    index.create(rows.schema["doc_id"].dataType.simpleString())
    index.append(materialize(index.unseen(groups).select("digest", F.col("first.doc_id").alias("keep_id"),
                                                         F.lit(batch).alias("batch"))))
    known = index.table().select("digest", "keep_id", (F.col("batch") != batch).alias("seen_before"))
    resolved = materialize(groups.join(known.hint("merge"), "digest")
                           .select("digest", "keep_id", "group_size", "seen_before", F.col("first.own_row").alias("first_row")))
    out = rows.join(resolved, "digest").select(
        "doc_id", "keep_id", "group_size", ((F.col("own_row") == F.col("first_row")) & ~F.col("seen_before")).alias("kept"),
        F.col("digest").alias("text_sha256"), "seen_before", *([] if row is None else [F.col("own_row").alias(row)]))
    return out


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    return (deduplicate(documents(spark, sf_dir), index, batch="documents")
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
