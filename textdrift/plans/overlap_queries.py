"""Registered overlap queries over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from textdrift.operators import overlap as ov
from textdrift.plans.common import rounded
from textdrift.plans.registry import query
from textdrift.sources.tables import conversation_turns

KEYS = ["conv_id", "turn"]

PAIRS_SQL = """
    SELECT u.conv_id, u.turn, u.text AS input_text, a.text AS generated_text
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'
"""

_ROUGE_CTES = f"""
    p AS ({PAIRS_SQL}),
    t AS (SELECT conv_id, turn,
                 regexp_extract_all(lower(coalesce(generated_text, '')), '[a-z0-9]+') AS g,
                 regexp_extract_all(lower(coalesce(input_text, '')), '[a-z0-9]+') AS r FROM p),
    items AS (
        SELECT conv_id, turn, 'g' AS side, 1 AS n, unnest(g) AS gram FROM t
        UNION ALL SELECT conv_id, turn, 'r', 1, unnest(r) FROM t
        UNION ALL SELECT conv_id, turn, 'g', 2, g[i] || ' ' || g[i + 1]
            FROM (SELECT conv_id, turn, g, unnest(range(1, len(g))) AS i FROM t WHERE len(g) >= 2)
        UNION ALL SELECT conv_id, turn, 'r', 2, r[i] || ' ' || r[i + 1]
            FROM (SELECT conv_id, turn, r, unnest(range(1, len(r))) AS i FROM t WHERE len(r) >= 2)),
    c AS (SELECT conv_id, turn, n, gram, count(*) FILTER (WHERE side = 'g') AS cg,
                 count(*) FILTER (WHERE side = 'r') AS cr FROM items GROUP BY ALL),
    o AS (SELECT conv_id, turn, sum(least(cg, cr)) FILTER (WHERE n = 1) AS ov1,
                 sum(least(cg, cr)) FILTER (WHERE n = 2) AS ov2 FROM c GROUP BY ALL),
    s AS (SELECT t.conv_id, t.turn, len(g) AS lg, len(r) AS lr,
                 coalesce(ov1, 0) AS ov1, coalesce(ov2, 0) AS ov2
          FROM t LEFT JOIN o USING (conv_id, turn)),
    m AS (SELECT conv_id, turn,
                 CASE WHEN lg > 0 AND lr > 0 THEN ov1 / lg ELSE 0.0 END AS p1,
                 CASE WHEN lg > 0 AND lr > 0 THEN ov1 / lr ELSE 0.0 END AS r1,
                 CASE WHEN lg > 1 AND lr > 1 THEN ov2 / (lg - 1) ELSE 0.0 END AS p2,
                 CASE WHEN lg > 1 AND lr > 1 THEN ov2 / (lr - 1) ELSE 0.0 END AS r2
          FROM s),
    f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
                    CASE WHEN p2 + r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0.0 END AS f2
          FROM m)
"""


def _pairs(spark, sf_dir):
    return ov.conversation_pairs(conversation_turns(spark, sf_dir))


@query("pair_texts", f"SELECT conv_id, turn, length(input_text) AS ref_chars, "
       f"length(generated_text) AS gen_chars FROM ({PAIRS_SQL})")
def q_pair_texts(spark, sf_dir):
    """User turn t paired with assistant turn t + 1."""
    p = _pairs(spark, sf_dir)
    return p.select(*KEYS, F.length("input_text").alias("ref_chars"),
                    F.length("generated_text").alias("gen_chars"))


@query("rouge_pairs", f"WITH {_ROUGE_CTES} SELECT conv_id, turn, "
       "round(p1, 6) AS rouge1_p, round(r1, 6) AS rouge1_r, round(f1, 6) AS rouge1_f, "
       "round(p2, 6) AS rouge2_p, round(r2, 6) AS rouge2_r, round(f2, 6) AS rouge2_f FROM f")
def q_rouge_pairs(spark, sf_dir):
    """Unstemmed ROUGE-1 and ROUGE-2 per pair by clipped n-gram overlap."""
    return rounded(ov.rouge_n(_pairs(spark, sf_dir), KEYS, (1, 2), stem=False))


@query("rouge", f"WITH {_ROUGE_CTES} SELECT count(*) AS n_pairs, round(avg(f1), 6) AS Rouge_1, "
       "round(avg(f2), 6) AS Rouge_2 FROM f")
def q_rouge(spark, sf_dir):
    """Corpus averages of unstemmed ROUGE-1/2 F1."""
    return rounded(ov.corpus_overlap(ov.rouge_n(_pairs(spark, sf_dir), KEYS, (1, 2))))


@query("rouge_stemmed_pairs")
def q_rouge_stemmed_pairs(spark, sf_dir):
    """T3 + T4: ROUGE-1/2 with Porter stems (distinct vocabulary stemmed once)."""
    return rounded(ov.rouge_n(_pairs(spark, sf_dir), KEYS, (1, 2), stem=True))


@query("rouge_l_pairs")
def q_rouge_l_pairs(spark, sf_dir):
    """ROUGE-L from the exact LCS of whole texts (bit-parallel, per pair)."""
    return rounded(ov.rouge_l(_pairs(spark, sf_dir), KEYS, stem=True))


@query("meteor_pairs")
def q_meteor_pairs(spark, sf_dir):
    """METEOR per pair (exact + stem stages)."""
    return rounded(ov.meteor(_pairs(spark, sf_dir), KEYS))


@query("overlap_corpus")
def q_overlap_corpus(spark, sf_dir):
    """A8 + A9: corpus ROUGE-1/2/L (stemmed) and METEOR over all pairs."""
    return rounded(ov.corpus_overlap(ov.overlap_scores(_pairs(spark, sf_dir), KEYS)))


@query("zip_texts", """
    WITH g AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pair_id,
                      length(text) AS gen_chars FROM documents),
         r AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pair_id,
                      length(text) AS ref_chars FROM benchmark)
    SELECT pair_id, gen_chars, ref_chars FROM g JOIN r USING (pair_id)""")
def q_zip_texts(spark, sf_dir):
    """J1 by position: the i-th document (by id) with the i-th benchmark text,
    cut to the shorter side; positions from distributed sequence numbers."""
    from textdrift.sources.tables import benchmark_corpus, documents_as_records
    gen = documents_as_records(spark, sf_dir).select("id", "generated_text")
    ref = benchmark_corpus(spark, sf_dir).select("id", F.col("text").alias("generated_text"))
    z = ov.zip_texts(gen, ref, "id")
    return z.select("pair_id", F.length("generated_text").alias("gen_chars"),
                    F.length("input_text").alias("ref_chars"))
