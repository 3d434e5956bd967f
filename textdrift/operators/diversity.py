"""Corpus statistics per group: distinct n-grams, high-frequency ratio,
token entropy and n-gram-model perplexity (A2-A7, A10).

Design.  Every text is tokenised once.  One ``explode`` turns a text into
items of four kinds (token, n-gram, bigram, bigram context) and ONE
aggregation counts ``(group, kind, item)``: a partial (map-side) hash
aggregate followed by a shuffle on the full key, so a hot token such as
"the" is combined inside each task before it is shuffled and a group that
holds a third of all rows is still spread over all reducers by its items.
Everything after that works on the count table, whose size is bounded by
the vocabulary, not by the number of rows.  The group totals that the
high-frequency ratio needs come from per-text token counts (a map-side sum,
no explode), so the count table is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textdrift.functions.text import Tokenizer, heads, last_token, ngrams, spaced, tokenize
from textdrift.operators.grams import BigramModel, group_counts, text_sums
from textdrift.session import materialize

TOKEN, NGRAM, BIGRAM, CONTEXT, LAST = 0, 1, 2, 3, 4


def _tagger(kind: int):
    # One-argument lambda: ``transform`` passes the element index to a
    # second parameter, so the kind must come from the closure.
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("item"))


def _items(tokens: Column, kinds: Sequence[int], n: int) -> Column:
    parts = []
    for kind in kinds:
        if kind == TOKEN:
            arr = tokens
        elif kind == NGRAM:
            arr = ngrams(tokens, n)
        elif kind == BIGRAM:
            arr = ngrams(tokens, 2)
        elif kind == LAST:
            arr = last_token(tokens)
        else:
            arr = heads(tokens)
        parts.append(F.transform(arr, _tagger(kind)))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def item_counts(records: DataFrame, group_cols: Sequence[str], text_col: str = "generated_text",
                kinds: Sequence[int] = (TOKEN, NGRAM), n: int = 3, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """``(group..., kind, item, c)``: occurrences of each item per group.  A
    group without items keeps a row of NULL kind, so it stays in the result."""
    g = list(group_cols)
    # Tokens are materialised in their own projection first: the n-gram
    # lambdas reference the array many times and must not re-run the regex.
    tokenized = records.select(*g, tokenizer(text_col).alias("_tok"))
    exploded = tokenized.select(*g, F.explode_outer(_items(F.col("_tok"), kinds, n)).alias("it"))
    return (exploded.select(*g, F.col("it.kind").alias("kind"), F.col("it.item").alias("item"))
            .groupBy(*g, "kind", "item").agg(F.count(F.lit(1)).alias("c")))


def token_stats(counts: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Per group: total tokens, vocabulary, distinct n-grams, entropy.

    Entropy uses ``-sum p log2 p = log2 N - sum(c log2 c) / N``, so it needs
    no second pass over the counts.
    """
    g = list(group_cols)
    is_tok = F.col("kind") == TOKEN
    is_gram = F.col("kind") == NGRAM
    c = F.col("c").cast("double")
    agg = counts.groupBy(*g).agg(
        F.sum(F.when(is_tok, F.col("c"))).alias("n_tokens"),
        F.count(F.when(is_tok, F.lit(1))).alias("vocabulary"),
        F.count(F.when(is_gram, F.lit(1))).alias("diversity"),
        F.sum(F.when(is_tok, c * F.log2(c))).alias("_s"),
    )
    n = F.col("n_tokens").cast("double")
    return agg.select(
        *g, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "vocabulary", "diversity",
        F.when(n > 0, F.log2(n) - F.col("_s") / n).alias("entropy"))


def high_freq_from_counts(counts: DataFrame, group_cols: Sequence[str],
                          threshold: float = 0.01, totals: DataFrame | None = None) -> DataFrame:
    """A3 on a count table: share of token occurrences whose relative
    frequency is strictly above ``threshold``.

    Group totals (one row per group) are joined back to the counts; Spark
    broadcasts them when their measured size allows and falls back to a
    shuffle join otherwise.  Conditional aggregates instead of filters keep
    both reads of ``counts`` identical, so their shuffle is reused.
    """
    g = list(group_cols)
    joined = with_group_totals(counts, g, totals)
    return joined.groupBy(*g).agg(high_freq_expr(threshold).alias("high_freq_ratio"))


def group_totals(records: DataFrame, group_cols: Sequence[str],
                 text_col: str = "generated_text", tokenizer: Tokenizer = tokenize) -> DataFrame:
    """``(group..., _n)``: token occurrences per group, summed from the
    token-array size of each text (partial aggregation, one row per group
    leaves each task)."""
    g = list(group_cols)
    return records.groupBy(*g).agg(F.sum(F.size(tokenizer(text_col))).alias("_n"))


def with_group_totals(counts: DataFrame, group_cols: Sequence[str],
                      totals: DataFrame | None = None) -> DataFrame:
    """Attach ``_n`` = token occurrences of the row's group (from
    :func:`group_totals` when given, else summed from the count table)."""
    g = list(group_cols)
    if totals is None:
        totals = counts.groupBy(*g).agg(
            F.sum(F.when(F.col("kind") == TOKEN, F.col("c"))).alias("_n"))
    if not g:
        return counts.crossJoin(F.broadcast(totals))
    # A null-safe condition: Catalyst infers no IS NOT NULL filter from it,
    # so both reads of ``counts`` stay identical and share one shuffle.
    t = totals.select(*[F.col(c).alias(f"_t_{c}") for c in g], "_n")
    cond = None
    for c in g:
        e = F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        cond = e if cond is None else cond & e
    return counts.join(t, on=cond, how="left").drop(*[f"_t_{c}" for c in g])


def high_freq_expr(threshold: float) -> Column:
    is_high = (F.col("kind") == TOKEN) & (F.try_divide("c", "_n") > F.lit(threshold))
    return F.try_divide(F.coalesce(F.sum(F.when(is_high, F.col("c"))), F.lit(0)), F.first("_n"))


def ngram_diversity(records: DataFrame, group_cols: Sequence[str], n: int = 3,
                    text_col: str = "generated_text", approximate: bool = False,
                    rsd: float = 0.01, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """A2: number of distinct word n-grams per group (n-grams never cross texts).

    ``approximate=True`` uses HyperLogLog++ (``approx_count_distinct``) on
    the exploded n-grams and skips the exact shuffle of every distinct n-gram,
    which goes by 128-bit digests (``operators.grams``).
    """
    g = list(group_cols)
    if approximate:
        tokenized = records.select(*g, tokenizer(text_col).alias("_tok"))
        grams = tokenized.select(*g, F.explode(ngrams(F.col("_tok"), n)).alias("item"))
        return grams.groupBy(*g).agg(F.approx_count_distinct("item", rsd).alias("diversity"))
    split = spaced if tokenizer is tokenize else tokenizer
    tokenized = records.select(*g, split(text_col).alias("_tok"))
    return group_counts(tokenized, g, n=n).groupBy(*g).agg(F.coalesce(F.sum("_grams"), F.lit(0)).alias("diversity"))


def ngram_sketches(records: DataFrame, group_cols: Sequence[str], n: int = 3, text_col: str = "generated_text",
                   lg_k: int = 12, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """``(group..., sketch)``: a HyperLogLog sketch of each group's distinct
    n-grams, at most 2 ** ``lg_k`` bytes or so, to be stored per batch of
    texts and added up by :func:`merge_sketches`.  A group without n-grams has
    an empty sketch.  Sketches are built in the map stage; a group of any size
    sends one per task."""
    g = list(group_cols)
    tokenized = records.select(*g, tokenizer(text_col).alias("_tok"))
    # shifted copies of the tokens side by side: no function call per n-gram
    parts = [f"_t{i}" for i in range(n)]
    size = F.greatest(F.size("_tok") - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("_tok", i + 1, size).alias(c) for i, c in enumerate(parts)])
    side = tokenized.select(*g, F.inline_outer(shifted)).toDF(*g, *parts)
    item = F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(" ", *parts))
    grams = side.select(*g, item.alias("item"))
    return grams.groupBy(*g).agg(F.hll_sketch_agg("item", F.lit(lg_k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """One sketch per group from those of any number of batches, without
    counting the texts again."""
    return sketches.groupBy(*group_cols).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_diversity(sketches: DataFrame, group_cols: Sequence[str], lg_k: int = 12) -> DataFrame:
    """``(group..., diversity, standard_error)``: the estimated number of
    distinct n-grams and its standard error, ``1.04 / sqrt(2 ** lg_k)`` of it."""
    found = F.hll_sketch_estimate("sketch")
    return sketches.select(*group_cols, found.alias("diversity"),
                           (found * F.lit(1.04 / 2 ** (lg_k / 2))).alias("standard_error"))


def high_freq_ratio(records: DataFrame, group_cols: Sequence[str], threshold: float = 0.01,
                    text_col: str = "generated_text") -> DataFrame:
    """A3: high-frequency ratio per group."""
    counts = item_counts(records, group_cols, text_col, kinds=(TOKEN,))
    totals = group_totals(records, group_cols, text_col)
    return high_freq_from_counts(counts, group_cols, threshold, totals)


def token_entropy(records: DataFrame, group_cols: Sequence[str],
                  text_col: str = "generated_text") -> DataFrame:
    """A4: Shannon entropy (base 2) of the token distribution per group."""
    counts = item_counts(records, group_cols, text_col, kinds=(TOKEN,))
    return token_stats(counts, group_cols).select(*group_cols, "n_tokens", "vocabulary", "entropy")


# ---------------------------------------------------------------------------
# n-gram language model
# ---------------------------------------------------------------------------

def bigram_model(reference: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of a bigram model trained on ``reference`` texts.

    Returns ``(table, vocab)``.  ``table(kind, item, tc)`` holds the bigram
    counts under kind BIGRAM (item ``"v w"``) and the context counts (how
    often ``v`` starts a bigram) under kinds TOKEN and LAST, so that they join
    directly to the token and last-token rows of the scored texts.  ``vocab``
    is a one-row frame with ``V`` = distinct reference tokens + 1 (an
    unknown-word slot).
    """
    counts = item_counts(reference, [], text_col, kinds=(TOKEN, BIGRAM, CONTEXT))
    bi = counts.filter(F.col("kind") == BIGRAM).select("kind", "item", F.col("c").alias("tc"))
    ctx = counts.filter(F.col("kind") == CONTEXT).select("item", F.col("c").alias("tc"))
    table = bi.unionByName(ctx.withColumn("kind", F.lit(TOKEN))).unionByName(
        ctx.withColumn("kind", F.lit(LAST)))
    vocab = counts.filter(F.col("kind") == TOKEN).agg((F.count(F.lit(1)) + 1).alias("V"))
    return table, vocab


# The scored texts need token, bigram and last-token items: the context count
# of v in a group is its token count minus the texts that end with v.
PERPLEXITY_KINDS = (TOKEN, BIGRAM, LAST)


def perplexity_aggs(k: float) -> list:
    """Aggregates over count rows joined to the model (``tc``, ``V``):
    ``_nb`` bigrams, ``_num`` = sum c log(c(v w) + k), ``_den`` = sum over
    contexts c log(c(v) + k V)."""
    kind, c = F.col("kind"), F.col("c").cast("double")
    tc = F.coalesce(F.col("tc"), F.lit(0)).cast("double")
    ctx_term = c * F.log(tc + F.lit(k) * F.col("V"))
    return [
        F.sum(F.when(kind == BIGRAM, F.col("c"))).alias("_nb"),
        F.sum(F.when(kind == BIGRAM, c * F.log(tc + F.lit(k)))).alias("_num"),
        (F.coalesce(F.sum(F.when(kind == TOKEN, ctx_term)), F.lit(0.0))
         - F.coalesce(F.sum(F.when(kind == LAST, ctx_term)), F.lit(0.0))).alias("_den"),
    ]


#: A bigram model of at most so many rows is sent to the scored texts; a larger
#: one is joined to their items by shuffle.
MODEL_ROWS = 1_000_000


def stored_model(reference: DataFrame, k: float, text_col: str = "text") -> tuple[DataFrame, DataFrame, BigramModel | None]:
    """:func:`bigram_model`, written once, and the model to be sent to the
    texts, if it is of MODEL_ROWS at most."""
    table, vocab = bigram_model(reference, text_col)
    # the contexts stand in the table twice (TOKEN and LAST)
    table = materialize(table)
    if table.count() > MODEL_ROWS:
        return table, vocab, None
    rows = table.where(F.col("kind") != LAST).collect()  # at most MODEL_ROWS
    sides = [([r["item"] for r in rows if r["kind"] == kind], [r["tc"] for r in rows if r["kind"] == kind]) for kind in (TOKEN, BIGRAM)]
    return table, vocab, BigramModel.of(*sides, vocab.first()["V"], k)


def _log_prob_agg(records: DataFrame, reference: DataFrame, k: float, keys: Sequence[str],
                  text_col: str = "generated_text", ref_text_col: str = "text") -> DataFrame:
    """Per key: ``n_bigrams`` and mean negative log-likelihood ``loss``.

    log P(w | v) = log(c(v w) + k) - log(c(v) + k V).  A small model is looked
    up in place, so that a text sends its sums on instead of its items.  With a
    large one, bigram rows carry the first term, token and last-token rows the
    second, so no join key is a hot context word (the count table has one row
    per key and item)."""
    table, vocab, model = stored_model(reference, k, ref_text_col)
    if model is not None:
        tokenized = records.select(*keys, spaced(text_col).alias("_tok"))
        sums = text_sums(tokenized, keys, model)
        agg = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_nb", "_num", "_den")])
    else:
        counts = item_counts(records, keys, text_col, kinds=PERPLEXITY_KINDS)
        joined = counts.join(table, on=["kind", "item"], how="left").crossJoin(F.broadcast(vocab))
        agg = joined.groupBy(*keys).agg(*perplexity_aggs(k))
    loss = (F.col("_den") - F.col("_num")) / F.col("_nb")
    return agg.select(*keys, F.coalesce("_nb", F.lit(0)).alias("n_bigrams"),
                      F.when(F.col("_nb") > 0, loss).alias("loss"))


def ngram_perplexity(records: DataFrame, reference: DataFrame, group_cols: Sequence[str],
                     k: float = 1.0, text_col: str = "generated_text",
                     ref_text_col: str = "text") -> DataFrame:
    """A7 (re-aimed): perplexity per group under an add-k bigram model of
    ``reference``: ``exp(-(1/N) sum log P(w_i | w_{i-1}))`` over the N
    bigrams of the group's texts."""
    g = list(group_cols)
    res = _log_prob_agg(records, reference, k, g, text_col, ref_text_col)
    return res.select(*g, "n_bigrams", F.exp("loss").alias("perplexity"))


def text_losses(records: DataFrame, reference: DataFrame, id_col: str = "id",
                keep_cols: Sequence[str] = (), k: float = 1.0,
                text_col: str = "generated_text", ref_text_col: str = "text") -> DataFrame:
    """Per-text mean negative log-likelihood ``loss`` and bigram count
    ``n_tokens``: the ``(loss, length)`` table that A5/A6 aggregate."""
    keys = [id_col, *keep_cols]
    res = _log_prob_agg(records, reference, k, keys, text_col, ref_text_col)
    # a text without a bigram has no loss
    return res.where("n_bigrams > 0").select(*keys, F.col("n_bigrams").alias("n_tokens"), "loss")


def weighted_perplexity(losses: DataFrame, group_cols: Sequence[str], loss_col: str = "loss",
                        length_col: str = "n_tokens") -> DataFrame:
    """A5: ``exp(sum(loss * n) / sum(n))`` per group."""
    l, n = F.col(loss_col), F.col(length_col).cast("double")
    return losses.groupBy(*group_cols).agg(
        F.exp(F.sum(l * n) / F.sum(F.when(l.isNotNull(), n))).alias("weighted_perplexity"))


def mean_perplexity(losses: DataFrame, group_cols: Sequence[str], loss_col: str = "loss") -> DataFrame:
    """Mean of per-batch perplexities ``avg(exp(loss))`` and the
    perplexity of the mean loss ``exp(avg(loss))`` per group."""
    l = F.col(loss_col)
    return losses.groupBy(*group_cols).agg(
        F.avg(F.exp(l)).alias("mean_batch_perplexity"),
        F.exp(F.avg(l)).alias("perplexity_of_mean_loss"))
