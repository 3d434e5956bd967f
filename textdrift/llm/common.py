"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textdrift.session import checkpoint_dir, materialize

__all__ = ["Hasher", "SPACE", "WORD", "checkpoint_dir", "crc_bucket", "documents", "find_components", "keyed_rows",
           "materialize", "release_memory", "sorted_groups", "sources_of", "text_or_empty", "with_row_key"]

#: A run of ASCII white space, and a word: whatever stands between two such runs.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def crc_bucket(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``: the split into folds."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def sources_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns of the
    input, whatever their names, cannot clash with its own."""
    return df.select(*names)


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """``df``, written once, with a number per row, so that rows without an id
    and rows that share one can be told apart in every later read."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def keyed_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """``(row, doc)``: a key per row and the whole row as one struct, so that
    no column of the input can clash with a name beside it.

    A plain read of files needs no copy for that: the key is the file (a
    64-bit hash of its path) and the row's place in it.  Other frames are
    written once with a number per row."""
    doc = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("doc")
    try:
        place = df.metadataColumn("_metadata")
        return df.select(F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")).alias(name), doc)
    except AnalysisException:
        number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
        return materialize(df.select(doc).withColumn(name, number)).select(name, "doc")


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: Python
    workers are reused, and a later stage may need it for something else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str, value: str, limit: int,
                  ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Regroup key-sorted Arrow batches of two integer columns so that a key
    never straddles two chunks, unless its rows exceed ``limit``.

    Yields ``(keys, values)``; a key with more than ``limit`` rows comes in
    several chunks that hold nothing but ``limit`` rows of it (the last one
    may be shorter and be followed by other keys).  Memory stays at one batch
    plus ``limit`` rows.
    """
    held_k = np.empty(0, np.int64)
    held_v = np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        held_k = np.concatenate([held_k, batch.column(key).to_numpy(zero_copy_only=False)])
        held_v = np.concatenate([held_v, batch.column(value).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(held_k, held_k[-1]))
        if last:
            yield held_k[:last], held_v[:last]
            held_k, held_v = held_k[last:], held_v[last:]
        while len(held_k) > limit:
            yield held_k[:limit], held_v[:limit]
            held_k, held_v = held_k[limit:], held_v[limit:]
    if len(held_k):
        yield held_k, held_v


class Hasher(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def find_components(edges: DataFrame, a: str = "a", b: str = "b",
                    write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Connected components: ``(node, component)`` with the smallest node as
    the component's name, for every node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every
    step replaces the edges of a node by edges to its smallest neighbour, so
    the number of edges never grows and the number of steps is logarithmic in
    the diameter.  Each step is a grouped minimum and a join on the node; the
    minima are written first, so both join sides are plain exchanges and a hub
    can be split by adaptive execution.  Every step's edges are written to the
    shared folder, which cuts the lineage.
    """
    def star(pairs: DataFrame) -> DataFrame:
        """``pairs``: (u, v), each u gets the least of its v and itself."""
        least = write(pairs.groupBy("u").agg(F.min("v").alias("m"))
                      .select("u", F.least("u", "m").alias("m")))
        return pairs.join(least, "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u > v").distinct())
    seen = mark(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = write(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .distinct())
        small = star(large)
        current = write(small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                       F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                        .select("e.u", "e.v").where("u > v").distinct())
        now = mark(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node")).distinct()
    return (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
