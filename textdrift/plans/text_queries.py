"""Registered queries over ``documents`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textdrift.operators import diversity as dv
from textdrift.operators.quantiles import join_groups
from textdrift.plans.common import rounded
from textdrift.plans.registry import query
from textdrift.plans.scoring import score_corpus
from textdrift.plans.sql_common import DOC_TOKENS, bigram_model_ctes, ngram_rows
from textdrift.session import materialize
from textdrift.sources.tables import benchmark_corpus, documents_as_records

GROUP = ["run", "generation"]

_TOKEN_COUNTS = f"""
    dt AS ({DOC_TOKENS}),
    tc AS (SELECT run, generation, t AS item, count(*) AS c
           FROM (SELECT run, generation, unnest(tok) AS t FROM dt) GROUP BY ALL),
    tg AS (SELECT g.*, coalesce(v.vocabulary, 0) AS vocabulary
           FROM (SELECT run, generation, sum(len(tok)) AS n_tokens FROM dt GROUP BY ALL) g
           LEFT JOIN (SELECT run, generation, count(*) AS vocabulary FROM tc GROUP BY ALL) v
           USING (run, generation)),
    grams AS (SELECT run, generation, count(DISTINCT item) AS diversity
              FROM ({ngram_rows('SELECT run, generation, tok FROM dt', 'run, generation', 3)})
              GROUP BY ALL),
    ent AS (SELECT tc.run, tc.generation,
                   -sum((c / n_tokens) * log2(c / n_tokens)) AS entropy,
                   sum(CASE WHEN c / n_tokens > 0.01 THEN c ELSE 0 END) / any_value(n_tokens)
                       AS high_freq_ratio
            FROM tc JOIN tg USING (run, generation) GROUP BY ALL)
"""

_PERPLEXITY = f"""
    epairs AS (SELECT run, generation, tok[i] AS v, array_to_string(tok[i:i + 1], ' ') AS item
               FROM (SELECT run, generation, tok, unnest(range(1, len(tok))) AS i
                     FROM dt WHERE len(tok) >= 2)),
    ppl AS (SELECT run, generation, count(*) AS n_bigrams,
                   exp(-avg(ln(coalesce(bm_bi.tc, 0) + 1.0)
                            - ln(coalesce(bm_ctx.tc, 0) + 1.0 * bm_v.V))) AS perplexity
            FROM epairs LEFT JOIN bm_bi USING (item)
                        LEFT JOIN bm_ctx ON epairs.v = bm_ctx.item
                        CROSS JOIN bm_v
            GROUP BY ALL)
"""

SCORE_CORPUS_SQL = f"""
WITH {_TOKEN_COUNTS}, {bigram_model_ctes()}, {_PERPLEXITY}
SELECT tg.run, tg.generation, tg.n_tokens, tg.vocabulary,
       coalesce(grams.diversity, 0) AS diversity,
       round(ent.high_freq_ratio, 6) AS high_freq_ratio,
       round(ent.entropy, 6) AS entropy,
       round(ppl.perplexity, 6) AS perplexity
FROM tg LEFT JOIN ent USING (run, generation)
        LEFT JOIN grams USING (run, generation)
        LEFT JOIN ppl USING (run, generation)
"""


@query("score_corpus", SCORE_CORPUS_SQL)
def q_score_corpus(spark, sf_dir):
    """A10 flagship: all corpus metrics per (run = lang, generation = source)."""
    return rounded(score_corpus(documents_as_records(spark, sf_dir), benchmark_corpus(spark, sf_dir)))


@query("ngram_diversity", f"WITH {_TOKEN_COUNTS} "
       "SELECT run, generation, coalesce(diversity, 0) AS diversity "
       "FROM tg LEFT JOIN grams USING (run, generation)")
def q_ngram_diversity(spark, sf_dir):
    """A2: distinct 3-grams per group, 0 where there is none."""
    return dv.ngram_diversity(documents_as_records(spark, sf_dir), GROUP, n=3)


@query("ngram_diversity_approx", f"WITH {_TOKEN_COUNTS} "
       "SELECT run, generation, diversity > 0 AS has_ngrams FROM grams")
def q_ngram_diversity_approx(spark, sf_dir):
    """A2 with HyperLogLog++: checked on row set and positivity only."""
    d = dv.ngram_diversity(documents_as_records(spark, sf_dir), GROUP, n=3, approximate=True)
    return d.select(*GROUP, (F.col("diversity") > 0).alias("has_ngrams"))


@query("ngram_diversity_sketches", f"WITH {_TOKEN_COUNTS} "
       "SELECT run, generation, coalesce(diversity, 0) AS diversity, true AS estimate_holds "
       "FROM tg LEFT JOIN grams USING (run, generation)")
def q_ngram_diversity_sketches(spark, sf_dir):
    """A2 by stored sketches: one per group and batch (two, by a hash of
    the id), merged; ``estimate_holds``: the estimate is within three standard
    errors (and 0.5, as it is a whole number) of the exact count beside it."""
    records = documents_as_records(spark, sf_dir)
    batch = F.pmod(F.xxhash64("id"), F.lit(2)).alias("batch")
    stored = materialize(dv.ngram_sketches(records.select("*", batch), [*GROUP, "batch"]))
    merged = dv.sketch_diversity(dv.merge_sketches(stored, GROUP), GROUP).withColumnRenamed("diversity", "estimate")
    both = join_groups(dv.ngram_diversity(records, GROUP, n=3), merged, GROUP)
    holds = F.abs(F.col("estimate") - F.col("diversity")) <= 3 * F.col("standard_error") + 0.5
    return both.select(*GROUP, "diversity", holds.alias("estimate_holds"))


@query("high_freq_ratio", f"WITH {_TOKEN_COUNTS} "
       "SELECT run, generation, round(high_freq_ratio, 6) AS high_freq_ratio "
       "FROM tg LEFT JOIN ent USING (run, generation)")
def q_high_freq_ratio(spark, sf_dir):
    """A3: share of token occurrences with relative frequency > 0.01."""
    return rounded(dv.high_freq_ratio(documents_as_records(spark, sf_dir), GROUP, 0.01))


@query("token_entropy", f"WITH {_TOKEN_COUNTS} "
       "SELECT run, generation, n_tokens, vocabulary, round(entropy, 6) AS entropy "
       "FROM tg LEFT JOIN ent USING (run, generation)")
def q_token_entropy(spark, sf_dir):
    """A4: base-2 entropy of the token distribution per group."""
    return rounded(dv.token_entropy(documents_as_records(spark, sf_dir), GROUP))


@query("ngram_perplexity", f"WITH dt AS ({DOC_TOKENS}), {bigram_model_ctes()}, {_PERPLEXITY} "
       "SELECT run, generation, coalesce(n_bigrams, 0) AS n_bigrams, round(perplexity, 6) AS perplexity "
       "FROM (SELECT DISTINCT run, generation FROM dt) LEFT JOIN ppl USING (run, generation)")
def q_ngram_perplexity(spark, sf_dir):
    """Add-1 bigram perplexity of each group under the benchmark corpus."""
    return rounded(dv.ngram_perplexity(documents_as_records(spark, sf_dir),
                                       benchmark_corpus(spark, sf_dir), GROUP))


_DOC_LOSSES = f"""
    dt AS ({DOC_TOKENS}), {bigram_model_ctes()},
    epairs AS (SELECT doc_id, run, generation, tok[i] AS v,
                      array_to_string(tok[i:i + 1], ' ') AS item
               FROM (SELECT doc_id, run, generation, tok, unnest(range(1, len(tok))) AS i
                     FROM dt WHERE len(tok) >= 2)),
    losses AS (SELECT doc_id, run, generation, count(*) AS n_tokens,
                      -avg(ln(coalesce(bm_bi.tc, 0) + 1.0)
                           - ln(coalesce(bm_ctx.tc, 0) + 1.0 * bm_v.V)) AS loss
               FROM epairs LEFT JOIN bm_bi USING (item)
                           LEFT JOIN bm_ctx ON epairs.v = bm_ctx.item
                           CROSS JOIN bm_v
               GROUP BY ALL)
"""


def _doc_losses(spark, sf_dir):
    recs = documents_as_records(spark, sf_dir)
    return dv.text_losses(recs, benchmark_corpus(spark, sf_dir), id_col="id",
                          keep_cols=GROUP)


@query("weighted_perplexity", f"WITH {_DOC_LOSSES} "
       "SELECT run, generation, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) "
       "AS weighted_perplexity FROM losses GROUP BY ALL")
def q_weighted_perplexity(spark, sf_dir):
    """A5: token-weighted perplexity over per-document losses."""
    return rounded(dv.weighted_perplexity(_doc_losses(spark, sf_dir), GROUP))


@query("mean_perplexity", f"WITH {_DOC_LOSSES} "
       "SELECT run, generation, round(avg(exp(loss)), 6) AS mean_batch_perplexity, "
       "round(exp(avg(loss)), 6) AS perplexity_of_mean_loss FROM losses GROUP BY ALL")
def q_mean_perplexity(spark, sf_dir):
    """Mean of per-document perplexities and perplexity of the mean loss."""
    return rounded(dv.mean_perplexity(_doc_losses(spark, sf_dir), GROUP))
