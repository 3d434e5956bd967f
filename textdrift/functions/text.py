"""Scalar text and array functions.

All of them return Column expressions, so they run inside whole-stage codegen
on the JVM; nothing here calls Python per row but a tokenizer of the user's own
(:func:`arrow_tokenizer`).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tokenizer takes a text column and gives an array of strings without
#: blanks; NULL text gives an empty array.
Tokenizer = Callable[["str | Column"], Column]

# The word-tokenizer rule is "a run of letters, digits or
# underscore, or one single character that is neither of those nor
# whitespace" on lower-cased text.  Written without SQL escaping; it is
# passed to Spark as a literal, so the backslashes reach the regex engine.
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: The second kind of token.
OTHER_PATTERN = WORD_PATTERN.split("|")[1]

# The ROUGE token rule keeps runs of [a-z0-9] of the
# lower-cased text; tokens longer than 3 characters are stemmed.
ROUGE_PATTERN = r"[a-z0-9]+"
ROUGE_MIN_STEM_LEN = 4


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text, pattern: str = WORD_PATTERN) -> Column:
    """Lower-case and split into word and punctuation tokens.

    NULL text gives an empty array, so aggregates over tokens never see NULL.
    """
    t = F.coalesce(_col(text), F.lit(""))
    return F.regexp_extract_all(F.lower(t), F.lit(pattern), 0)


def spaced(text) -> Column:
    """The tokens of :func:`tokenize`, in order, as one text with ASCII white
    space between them: whatever is no word stands alone, so that splitting
    at white space gives the tokens without a regex match for every word."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.regexp_replace(F.lower(t), F.lit(OTHER_PATTERN), F.lit(" $0 "))


def arrow_tokenizer(split: Callable[[list[str]], list[list[str]]]) -> Tokenizer:
    """a tokenizer from a Python function of many texts, run on Arrow
    batches.  NULL texts reach it as empty ones; blanks inside its tokens become
    U+2581, so that n-grams stay unambiguous."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[t.replace(" ", "\u2581") for t in tokens] for tokens in split(texts.tolist())])

    return lambda text: run(F.coalesce(_col(text).cast("string"), F.lit("")))


def ngrams(tokens, n: int, sep: str = " ") -> Column:
    """Word n-grams of a token array, each joined with ``sep``.

    Tokens never contain whitespace, so a space separator is unambiguous.
    Arrays shorter than ``n`` give an empty array (no error).
    """
    t = _col(tokens)
    if n == 1:
        return t
    grams = F.transform(
        F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)),
        lambda i: F.concat_ws(sep, *[F.element_at(t, i + j) for j in range(n)]),
    )
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def last_token(tokens) -> Column:
    """The last token as a one-element array (empty for an empty array)."""
    t = _col(tokens)
    return F.when(F.size(t) >= 1, F.slice(t, -1, 1)).otherwise(F.array().cast("array<string>"))


def heads(tokens) -> Column:
    """Every token that has a successor: the contexts of the bigrams."""
    t = _col(tokens)
    return F.when(F.size(t) >= 2, F.slice(t, 1, F.size(t) - 1)).otherwise(
        F.array().cast("array<string>"))


def rouge_tokens(text) -> Column:
    """T3 without stemming: lower-case, keep runs of ``[a-z0-9]``."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.regexp_extract_all(F.lower(t), F.lit(ROUGE_PATTERN), 0)


def f1(precision, recall) -> Column:
    """``2PR/(P+R)``, zero when both are zero (or NULL)."""
    p, r = _col(precision), _col(recall)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def truncate_tokens(tokens, max_len: int = 512) -> Column:
    """Keep the first ``max_len`` elements."""
    return F.slice(_col(tokens), 1, max_len)


def pad_tokens(tokens, length: int = 128, pad=0) -> Column:
    """Pad with ``pad`` or truncate to exactly ``length`` elements."""
    t = _col(tokens)
    filler = F.array_repeat(F.lit(pad), F.lit(length))
    return F.slice(F.concat(t, filler), 1, length)


def attention_mask(tokens, length: int = 128) -> Column:
    """1 for a real element, 0 for padding, ``length`` entries."""
    t = _col(tokens)
    return F.transform(F.sequence(F.lit(1), F.lit(length)),
                       lambda i: F.when(i <= F.size(t), F.lit(1)).otherwise(F.lit(0)))


def first_text(*cols) -> Column:
    """The first non-missing text, else the empty string."""
    return F.coalesce(*[_col(c) for c in cols], F.lit(""))
