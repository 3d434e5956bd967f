"""A training-data pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.  Stages that drop rows decide row by row,
by a key that is written before the decision, so rows without an id and rows
that share one are kept or dropped one by one; an empty table passes through
all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textdrift.llm.common import documents, keyed_rows, materialize
from textdrift.llm.exact_dedup import DigestIndex, deduplicate
from textdrift.llm.language_id import keep_identified, learn
from textdrift.llm.mixing import in_training_order, mix, training_places
from textdrift.llm.packing import packed_pieces
from textdrift.llm.simhash_golay import near_duplicates


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of ``rows`` (``row, doc``) whose key is not in ``gone``
    (``row``).  The keys are written first, so Spark knows their size: a small
    table is sent to the documents, a large one is joined by sort-merge."""
    keys = materialize(gone.select(F.col("row").alias("gone")))
    return rows.join(keys, F.col("row") == F.col("gone"), "left_anti").select("doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    return keep_identified(docs, learn(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one row stays, that with the smallest id."""
    rows = keyed_rows(docs)
    found = deduplicate(rows.select("row", "doc.doc_id", "doc.text"), DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}"),
                        batch="documents", row="row")
    return _without(rows, found.where(~F.col("kept")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest
    id, rows without one last; ties go by the row's key."""
    rows = keyed_rows(docs)
    rank = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), "row")
    found = near_duplicates(rows.select(rank.alias("doc_id"), F.col("doc.text").alias("text")))
    return _without(rows, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id.row"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them, in training order."""
    rows = keyed_rows(docs)
    mixed = mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), cut_last=False, row="row")
    return in_training_order(rows, training_places(mixed, "row"), "row").select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packed_pieces(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("source_mixing", mixing_stage),
    ("pattern_packing", packing_stage),
]

#: SQL cannot express the language model, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
