"""Shared DuckDB fragments for the oracle SQL (plain text, no Spark)."""

# The word-tokenizer pattern (same text as functions.text.WORD_PATTERN).
WORD_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

DOC_TOKENS = f"""
    SELECT doc_id, lang AS run, CAST(substr(source, 4, 8) AS INTEGER) AS generation,
           regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}') AS tok
    FROM documents
"""

BENCH_TOKENS = f"""
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_RE}') AS tok
    FROM benchmark
"""


def ngram_rows(src: str, keys: str, n: int) -> str:
    """One row per n-gram: ``keys, item``."""
    return f"""
    SELECT {keys}, array_to_string(tok[i:i + {n - 1}], ' ') AS item
    FROM (SELECT {keys}, tok, unnest(range(1, len(tok) - {n - 2})) AS i
          FROM ({src}) WHERE len(tok) >= {n})
    """


def bigram_model_ctes() -> str:
    """CTEs ``bm_bi(item, tc)``, ``bm_ctx(item, tc)``, ``bm_v(V)``."""
    return f"""
    bt AS ({BENCH_TOKENS}),
    bm_v AS (SELECT count(DISTINCT t) + 1 AS V FROM (SELECT unnest(tok) AS t FROM bt)),
    bm_pairs AS (SELECT tok[i] AS v, array_to_string(tok[i:i + 1], ' ') AS item
                 FROM (SELECT tok, unnest(range(1, len(tok))) AS i FROM bt WHERE len(tok) >= 2)),
    bm_bi AS (SELECT item, count(*) AS tc FROM bm_pairs GROUP BY item),
    bm_ctx AS (SELECT v AS item, count(*) AS tc FROM bm_pairs GROUP BY v)
    """
