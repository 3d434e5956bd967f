"""Corpus tools: reproducible sampling, corpus mixing, block packing,
padding, bootstrap weights and folds (L4-L7, T5-T8, U5, W10, W11).

Randomness is hash based (``md5`` of key and seed), so every engine and every
re-run selects the same rows; the reference's numpy seeds cannot be replayed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.functions.text import tokenize


def hash_u32(*cols, seed: int | str = 0) -> Column:
    """First 32 bits of ``md5(col1:col2:...:seed)`` as a non-negative long;
    the same value as ``('0x' || substr(md5(...), 1, 8))::BIGINT`` in DuckDB."""
    key = F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                             for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def sample_texts(records: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``n`` rows without replacement in a reproducible hash order;
    ``n <= 0`` keeps every row.  The limit is the sampling feature itself;
    Spark plans it as a per-partition top-k merged in one small step."""
    if n <= 0:
        return records
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return records.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def head(records: DataFrame, n: int, order_col: str = "id") -> DataFrame:
    """L4: first ``n`` rows by ``order_col``."""
    return records.orderBy(order_col).limit(n)


def mix_corpora(original: DataFrame, generated: DataFrame, ratio: float, seed: int = 42,
                id_col: str = "id", buckets: int = 10_000) -> DataFrame:
    """Keep about ``ratio`` of the original rows and ``1 - ratio`` of the
    generated rows (hash buckets, so the two selections are complementary),
    stacked with a ``source`` column."""
    cut = int(round(ratio * buckets))
    o = original.withColumn("_b", F.pmod(hash_u32(id_col, seed=seed), F.lit(buckets)))
    g = generated.withColumn("_b", F.pmod(hash_u32(id_col, seed=seed), F.lit(buckets)))
    o = o.filter(F.col("_b") < cut).drop("_b").withColumn("source", F.lit("original"))
    g = g.filter(F.col("_b") >= cut).drop("_b").withColumn("source", F.lit("generated"))
    return o.unionByName(g, allowMissingColumns=True)


def pack_blocks(records: DataFrame, block: int = 64, batch_size: int = 1000,
                id_col: str = "id", tokens: Column | None = None) -> DataFrame:
    """T5 + W10: concatenate the token lists of each batch of ``batch_size``
    consecutive ids, cut into blocks of ``block`` tokens and drop the
    remainder of the batch (a batch shorter than one block stays one short
    block); labels equal the ids.

    A batch holds at most ``batch_size`` texts, so the running token offset is
    a window over one batch; each text is then sliced at the block borders
    and its pieces, one row each, are grouped by ``(batch, block)``, which the
    window's exchange has brought together already.  All slices of a text are
    made in one row, so that only its pieces leave it.  The library's own
    tokens hold no blanks and travel as one string.
    """
    own = tokens is None
    toks = F.array_join(tokenize("generated_text"), " ") if own else tokens
    n = F.when(F.col("toks") == "", 0).otherwise(F.size(F.split("toks", " "))) if own else F.size("toks")
    docs = records.select(F.col(id_col).alias("id"), toks.alias("toks")).withColumn(
        "batch", F.floor(F.col("id") / batch_size)).withColumn("n", n)
    w = Window.partitionBy("batch").orderBy("id")
    docs = docs.withColumn(
        "offset", F.sum("n").over(w) - F.col("n")).withColumn(
        "batch_total", F.sum("n").over(Window.partitionBy("batch")))
    keep_to = F.when(F.col("batch_total") < block, F.col("batch_total")).otherwise(
        F.floor(F.col("batch_total") / block) * block)
    end = F.least(F.col("offset") + F.col("n"), keep_to)
    docs = docs.withColumn("end", end).where("end > offset").select(
        "batch", "offset", "end", (F.split("toks", " ") if own else F.col("toks")).alias("toks"))

    def piece(number: Column) -> Column:
        low, high = F.greatest(number * block, F.col("offset")), F.least((number + 1) * block, F.col("end"))
        part = F.slice("toks", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(number.alias("block"), low.alias("pos"), part.alias("part"))

    numbers = F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("end") - 1) / block))
    pieces = docs.select("batch", F.inline(F.transform(numbers, piece)))
    blocks = pieces.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    blocks = blocks.select("batch", "block", F.flatten("parts.part").alias("input_ids"))
    return blocks.select("batch", "block", "input_ids", F.col("input_ids").alias("labels"),
                         F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"))


def _uniform(*cols, seed: int | str) -> Column:
    """Uniform in (0, 1) from the hash of the columns."""
    return (hash_u32(*cols, seed=seed).cast("double") + 0.5) / 4294967296.0


def taken_by(id_col: str, samples: int, p: float, seed: int = 0) -> Column:
    """The samples (0 to ``samples - 1``) that take a row, each with chance
    ``p``, as an array.

    The gaps between the samples that take a row are geometric, so one hash
    says how many samples pass the row over first; only a row that some sample
    takes needs more hashes.  Exploding the array gives the sampled rows and
    no others."""
    if p >= 1.0:
        return F.sequence(F.lit(0), F.lit(samples - 1))
    none = F.array().cast("array<int>")
    if p <= 0.0:
        return none
    scale = F.lit(math.log1p(-p))

    def skip(draw: Column) -> Column:  # at most 22.9 / p, so a double holds it exactly enough
        return F.floor(F.log(_uniform(id_col, draw, seed=seed)) / scale)

    def step(state: Column, draw: Column) -> Column:
        at = F.when(state["at"] < samples, state["at"] + 1 + skip(draw)).otherwise(state["at"])
        return F.struct(at.alias("at"), F.when(at < samples, F.concat(state["out"], F.array(at.cast("int"))))
                        .otherwise(state["out"]).alias("out"))

    first = skip(F.lit(0))
    start = F.struct(first.alias("at"), F.array(first.cast("int")).alias("out"))
    further = F.aggregate(F.sequence(F.lit(1), F.lit(samples)), start, step, lambda s: s["out"])
    return F.when(first < samples, further).otherwise(none)


def bootstrap_weights(df: DataFrame, replicates: int, id_col: str, seed: int = 0) -> DataFrame:
    """Sampling with replacement as Poisson(1) multiplicities per
    (row, replicate), drawn from a hash (inverse CDF): the row's columns plus
    ``replicate`` and ``weight``.  Only the replicates that take a row
    (weight > 0, 63 %) are exploded."""
    thresholds, cdf, p = [], 0.0, math.exp(-1)
    for k in range(13):  # k <= 12 covers u < 1 - 1e-10
        cdf += p
        thresholds.append(cdf)
        p = p / (k + 1)

    def weight(replicate: Column) -> Column:
        # inverse CDF of Poisson(1): the number of thresholds below u
        u = _uniform(id_col, replicate, seed=seed)
        return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t < u))

    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.struct(r.alias("replicate"), weight(r).alias("weight")))
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*names, F.inline(F.filter(drawn, lambda d: d["weight"] > 0)))


def kfold(df: DataFrame, k: int = 3, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Fold number in ``[0, k)`` from a hash of id and seed."""
    return df.withColumn("fold", F.pmod(hash_u32(id_col, seed=seed), F.lit(k)).cast("int"))


def padded(tokens: Column, length: int = 128, pad: str = "<pad>") -> tuple[Column, Column]:
    """T7 for string tokens: ``(padded array, attention mask)``."""
    # the mask by two runs: a lambda would work ``tokens`` out for every place
    n = F.least(F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0)), F.lit(length))
    arr = F.concat(F.slice(tokens, 1, length), F.array_repeat(F.lit(pad), F.lit(length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return arr, mask


def row_numbers(df: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row number inside bounded partitions (folds, pairs)."""
    return df.withColumn("row_number", F.row_number().over(Window.partitionBy(*partition)
                                                           .orderBy(*order)))
