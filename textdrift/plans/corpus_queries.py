"""Registered corpus-tool queries over ``documents`` and ``benchmark``
(L4, L5, L7, T5-T8, U5, W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textdrift.functions.text import tokenize
from textdrift.operators import corpus as cp
from textdrift.plans.registry import query
from textdrift.plans.sql_common import WORD_RE
from textdrift.sources.tables import benchmark_corpus, documents_as_records

_HASH = "(('0x' || substr(md5(CAST({c} AS VARCHAR) || ':42'), 1, 8))::BIGINT % 10000)"


@query("sample_texts", """
    SELECT doc_id AS id, lang AS run, CAST(substr(source, 4, 8) AS INTEGER) AS generation
    FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42') LIMIT 100""")
def q_sample_texts(spark, sf_dir):
    """100 documents in a reproducible hash order (seed 42)."""
    recs = documents_as_records(spark, sf_dir)
    return cp.sample_texts(recs, 100, seed=42).select("id", "run", "generation")


@query("mix_corpora", f"""
    SELECT 'original' AS source, item_id AS id, length(text) AS n_chars FROM benchmark
    WHERE {_HASH.format(c='item_id')} < 1000
    UNION ALL
    SELECT 'generated', doc_id, length(text) FROM documents
    WHERE {_HASH.format(c='doc_id')} >= 1000""")
def q_mix_corpora(spark, sf_dir):
    """10 % of the benchmark texts mixed with 90 % of the documents."""
    orig = benchmark_corpus(spark, sf_dir)
    gen = documents_as_records(spark, sf_dir).select("id", F.col("generated_text").alias("text"))
    mixed = cp.mix_corpora(orig, gen, ratio=0.1, seed=42)
    return mixed.select("source", "id", F.length("text").alias("n_chars"))


@query("pack_blocks", f"""
    WITH d AS (SELECT doc_id AS id, doc_id // 1000 AS batch,
                      regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}') AS toks
               FROM documents),
    o AS (SELECT *, sum(len(toks)) OVER (PARTITION BY batch ORDER BY id) - len(toks) AS "offset",
                 sum(len(toks)) OVER (PARTITION BY batch) AS total FROM d),
    e AS (SELECT batch, "offset" + i - 1 AS pos, toks[i] AS tok,
                 CASE WHEN total < 64 THEN total ELSE total // 64 * 64 END AS keep_to
          FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM o))
    SELECT batch, pos // 64 AS block, count(*) AS n_tokens,
           string_agg(tok, ' ' ORDER BY pos) AS block_text
    FROM e WHERE pos < keep_to GROUP BY ALL""")
def q_pack_blocks(spark, sf_dir):
    """T5: token blocks of 64 per batch of 1,000 documents, remainder dropped."""
    b = cp.pack_blocks(documents_as_records(spark, sf_dir), block=64, batch_size=1000)
    return b.select("batch", "block", F.size("input_ids").alias("n_tokens"),
                    F.array_join("input_ids", " ").alias("block_text"))


@query("pad_tokens", f"""
    SELECT doc_id AS id, least(len(t), 128) AS n_real,
           CASE WHEN len(t) >= 128 THEN t[128] ELSE '<pad>' END AS last_token
    FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}') AS t
          FROM documents)""")
def q_pad_tokens(spark, sf_dir):
    """Tokens padded or cut to 128 with an attention mask."""
    # the tokens stand in a projection of their own, so that each text is split once
    recs = documents_as_records(spark, sf_dir).select("id", tokenize("generated_text").alias("toks"))
    arr, mask = cp.padded(F.col("toks"), 128)
    x = recs.select("id", arr.alias("ids"), mask.alias("mask"))
    return x.select("id", F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("n_real"),
                    F.element_at("ids", 128).alias("last_token"))


@query("kfold_sizes", f"""
    SELECT CAST({_HASH.format(c='doc_id').replace('% 10000', '% 3')} AS INTEGER) AS fold,
           count(*) AS n_rows
    FROM documents GROUP BY 1""")
def q_kfold_sizes(spark, sf_dir):
    """Hash-based 3-fold assignment of documents (seed 42)."""
    recs = documents_as_records(spark, sf_dir)
    return cp.kfold(recs, 3, "id", seed=42).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("head_texts", """
    SELECT doc_id AS id, length(text) AS n_chars FROM documents ORDER BY doc_id LIMIT 10""")
def q_head_texts(spark, sf_dir):
    """L4: the first 10 documents by id (a top-k report)."""
    recs = documents_as_records(spark, sf_dir)
    return cp.head(recs, 10).select("id", F.length("generated_text").alias("n_chars"))
