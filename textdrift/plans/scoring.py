"""Score a corpus: one metric row per (run, generation) (A10, flagship).

The reference scores one (generation, run) per process and appends a CSV
row.  Here all groups are scored together: the texts are tokenised once, one
shuffle of compact digests counts tokens and 3-grams per group
(``operators.grams``), bigrams are looked up in the model on the way, and one
more aggregation over the cells' counts yields every metric.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.functions.text import spaced
from textdrift.operators.diversity import ngram_perplexity, stored_model
from textdrift.operators.grams import group_counts


def score_corpus(records: DataFrame, reference: DataFrame | None = None,
                 group_cols: Sequence[str] = ("run", "generation"), n: int = 3,
                 threshold: float = 0.01, k: float = 1.0,
                 text_col: str = "generated_text", ref_text_col: str = "text") -> DataFrame:
    """Per group: n_tokens, vocabulary, distinct n-grams (``diversity``),
    ``high_freq_ratio``, ``entropy`` and, with a ``reference`` corpus, the
    add-k bigram ``perplexity``."""
    g = list(group_cols)
    model, large = None, None
    if reference is not None:
        _, _, model = stored_model(reference, k, ref_text_col)
        if model is None:  # too large to be sent to the texts
            large = ngram_perplexity(records, reference, g, k, text_col, ref_text_col).drop("n_bigrams")
    tokenized = records.select(*g, spaced(text_col).alias("_tok"))
    cells = group_counts(tokenized, g, n=n, vocabulary=True, model=model, threshold=threshold)
    agg = cells.groupBy(*g).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in
          (("_total", "n_tokens"), ("_vocabulary", "vocabulary"), ("_grams", "diversity"))],
        *[F.sum(c).alias(c) for c in ("_s", "_nb", "_num", "_den")],
        F.flatten(F.collect_list("_high")).alias("_high"))
    # a cell's candidates hold every token above the threshold of the group
    high = F.aggregate(F.filter("_high", lambda c: F.try_divide(c, F.col("n_tokens")) > F.lit(threshold)),
                       F.lit(0).cast("long"), lambda a, c: a + c)
    agg = agg.withColumn("high_freq_ratio", F.try_divide(high, F.col("n_tokens")))
    nt = F.col("n_tokens").cast("double")
    cols = [*g, "n_tokens", "vocabulary", "diversity",
            "high_freq_ratio", F.when(nt > 0, F.log2(nt) - F.col("_s") / nt).alias("entropy")]
    if model is not None:
        cols.append(F.when(F.col("_nb") > 0, F.exp((F.col("_den") - F.col("_num")) / F.col("_nb")))
                    .alias("perplexity"))
    scored = agg.select(*cols)
    if large is None:
        return scored
    large = large.select(*[F.col(c).alias(f"_g_{c}") for c in g], "perplexity")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g], F.lit(True))
    return scored.join(large, same, "left").drop(*[f"_g_{c}" for c in g])
