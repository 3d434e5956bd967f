"""Text pairing and overlap scores: ROUGE-1/2/L and METEOR (J1-J4, A8, A9,
T3, T4, T9-T11).

A pair's tokens stay in its row: the clipped overlap of two n-gram multisets,
``sum(least(c_gen, c_ref))``, the sequence alignments of ROUGE-L and METEOR and
the stems are all worked out by Arrow-batched pandas UDFs on the token arrays
of one pair, so a task holds a batch of pairs and no table of n-grams.  Rows
that share their keys are one pair.  Stemming runs once per distinct token of
a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textdrift.functions.alignment import lcs_length, meteor_pair, prf
from textdrift.functions.porter import stem as porter_stem
from textdrift.functions.text import ROUGE_MIN_STEM_LEN, Tokenizer, f1, rouge_tokens, tokenize
from textdrift.session import materialize

PAIR = "pair_id"


# ---------------------------------------------------------------------------
# Pairing
# ---------------------------------------------------------------------------

def conversation_pairs(turns: DataFrame) -> DataFrame:
    """J1 on conversations: a user turn ``t`` is the reference text
    (``input_text``) and the assistant turn ``t + 1`` of the same
    conversation the generated text.  An equi-join on (conv_id, turn)."""
    u = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("input_text"))
    a = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated_text"))
    return u.join(a, on=["conv_id", "turn"], how="inner")


def self_pairs(records: DataFrame) -> DataFrame:
    """A record's own ``input_text`` is its reference (no join)."""
    return records.withColumn("input_text", F.coalesce("input_text", F.lit("")))


def zip_texts(generated: DataFrame, reference: DataFrame, order_col: str,
              text_col: str = "generated_text") -> DataFrame:
    """J1 by position: the i-th generated text (by ``order_col``) with the
    i-th reference text; the longer side is cut.  Positions come from the
    distributed sequence numbering of the monitor (no single-partition
    window), then one inner equi-join.  The texts go through the numbering, so
    rows that share an ``order_col`` value keep a position each (by text)."""
    from textdrift.streaming.monitor import assign_sequence
    g = generated.select(order_col, F.col(text_col).alias("generated_text"))
    r = reference.select(order_col, F.col(text_col).alias("input_text"))
    g = assign_sequence(g, [order_col, "generated_text"]).select("seq", "generated_text")
    r = assign_sequence(r, [order_col, "input_text"]).select("seq", "input_text")
    return g.join(r, on="seq", how="inner").withColumnRenamed("seq", PAIR)


# ---------------------------------------------------------------------------
# Tokens, stems
# ---------------------------------------------------------------------------

def _stem_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        yield pd.DataFrame({"tok": pdf["tok"], "stem": [porter_stem(t) for t in pdf["tok"]]})


def stem_vocabulary(tokens: DataFrame, col: str = "tok",
                    min_len: int = ROUGE_MIN_STEM_LEN) -> DataFrame:
    """T4: ``(tok, stem)`` for every distinct token of at least ``min_len``
    characters, each stemmed once."""
    vocab = tokens.select(F.col(col).alias("tok")).filter(F.length("tok") >= min_len).distinct()
    return vocab.mapInPandas(_stem_batches, "tok string, stem string")


def pair_tokens(pairs: DataFrame, keys: Sequence[str], stem: bool = False,
                salt: int = 1, tokenizer: Tokenizer = rouge_tokens) -> DataFrame:
    """T3 (+T4): long table ``(keys..., side, pos, tok)`` of ROUGE tokens of
    both texts, side ``g`` = generated and ``r`` = reference.

    ``salt > 1`` spreads the occurrences of every token over ``salt`` join
    keys (the stem table is replicated ``salt`` times), so a very frequent
    word does not load one reducer; results are identical."""
    k = list(keys)
    sides = F.array(
        F.struct(F.lit("g").alias("side"), tokenizer("generated_text").alias("toks")),
        F.struct(F.lit("r").alias("side"), tokenizer("input_text").alias("toks")))
    s = pairs.select(*k, F.explode(sides).alias("s")).select(*k, "s.side", "s.toks")
    # outer: a pair whose texts have no tokens keeps a (NULL) row
    long = s.select(*k, "side", F.posexplode_outer("toks").alias("pos", "tok"))
    if stem:
        vocab = stem_vocabulary(long)
        on = ["tok"]
        if salt > 1:
            long = long.withColumn("_salt", F.pmod(F.xxhash64(*k, "side", "pos"), F.lit(salt)))
            vocab = vocab.withColumn("_salt", F.explode(
                F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
            on = ["tok", "_salt"]
        long = (long.join(vocab, on=on, how="left")
                .select(*k, "side", "pos", F.coalesce("stem", "tok").alias("tok")))
    return long


def side_lengths(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.select(*keys, F.size(rouge_tokens("generated_text")).alias("n_gen"),
                        F.size(rouge_tokens("input_text")).alias("n_ref"))


# ---------------------------------------------------------------------------
# ROUGE
# ---------------------------------------------------------------------------

def rouge_n(pairs: DataFrame, keys: Sequence[str], ns: Sequence[int] = (1, 2),
            stem: bool = False, salt: int = 1, tokenizer: Tokenizer = rouge_tokens) -> DataFrame:
    """A8 for ROUGE-N: per pair precision, recall and F1 for each ``n``.

    The n-grams of a pair are counted in its row; the clipped overlap is
    ``sum(least(c_gen, c_ref))``.  The n-grams of rows that share their keys
    are counted together.
    """
    k = list(keys)
    if stem:
        arr = token_arrays(pairs, k, stem, salt, tokenizer).select(
            *k, F.array("gen_toks").alias("gen"), F.array("ref_toks").alias("ref"))
    else:
        arr = token_arrays(pairs, k, tokenizer=tokenizer).groupBy(*k).agg(
            F.collect_list("gen_toks").alias("gen"), F.collect_list("ref_toks").alias("ref"))
    per_pair = arr.select(*k, _overlap_udf(tuple(ns))("gen", "ref").alias("o")).select(*k, "o.*")
    cols = []
    for n in ns:
        ov, tg, tr = F.col(f"ov{n}"), F.col(f"tg{n}"), F.col(f"tr{n}")
        valid = (tg > 0) & (tr > 0)
        p = F.when(valid, ov / tg).otherwise(F.lit(0.0))
        r = F.when(valid, ov / tr).otherwise(F.lit(0.0))
        cols += [p.alias(f"rouge{n}_p"), r.alias(f"rouge{n}_r"), f1(p, r).alias(f"rouge{n}_f")]
    return per_pair.select(*k, *cols)


def _gram_counts(texts: Sequence[Sequence[str]], n: int) -> Counter:
    return Counter(gram for t in texts for gram in zip(*[t[i:] for i in range(n)]))


def _overlap_udf(ns: Sequence[int]):
    """Per pair and ``n``: the clipped overlap and both sides' n-grams."""
    names = [f"{c}{n}" for n in ns for c in ("ov", "tg", "tr")]

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in names]))
    def udf(gen: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = []
        for g, r in zip(gen, ref):
            g, r = [t.tolist() for t in g], [t.tolist() for t in r]
            row = []
            for n in ns:
                cg, cr = _gram_counts(g, n), _gram_counts(r, n)
                row += [sum(min(c, cr[gram]) for gram, c in cg.items() if gram in cr), cg.total(), cr.total()]
            rows.append(row)
        return pd.DataFrame(rows, columns=names)
    return udf


_PRF = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
                     T.StructField("f", T.DoubleType())])


@F.pandas_udf(_PRF)
def _rouge_l_udf(gen: pd.Series, ref: pd.Series) -> pd.DataFrame:
    out = [prf(lcs_length(list(g), list(r)), len(g), len(r)) for g, r in zip(gen, ref)]
    return pd.DataFrame(out, columns=["p", "r", "f"])


def token_arrays(pairs: DataFrame, keys: Sequence[str], stem: bool = False,
                 salt: int = 1, tokenizer: Tokenizer = rouge_tokens) -> DataFrame:
    """Per pair: ``gen_toks`` and ``ref_toks`` ROUGE token arrays; with
    ``stem`` their stems, and one row for the rows that share their keys, whose
    tokens then stand by position.  ``salt`` is not needed any more: stems do
    not go through a join by token."""
    k = list(keys)
    arr = pairs.select(*k, tokenizer("generated_text").alias("gen_toks"), tokenizer("input_text").alias("ref_toks"))
    if not stem:
        return arr
    stemmed = arr.select(*k, _stems("gen_toks").alias("gen_toks"), _stems("ref_toks").alias("ref_toks"))
    lists = stemmed.groupBy(*k).agg(F.collect_list("gen_toks").alias("g"), F.collect_list("ref_toks").alias("r"))

    def together(col: str) -> Column:
        placed = F.transform(col, lambda t: F.transform(t, lambda tok, pos: F.struct(pos.alias("pos"), tok.alias("tok"))))
        return F.when(F.size(col) == 1, F.col(col)[0]).otherwise(F.sort_array(F.flatten(placed))["tok"])
    return lists.select(*k, together("g").alias("gen_toks"), together("r").alias("ref_toks"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(texts: pd.Series) -> pd.Series:
    """T4: tokens of at least ROUGE_MIN_STEM_LEN characters stemmed, each
    distinct one of the batch once."""
    stems = {t: porter_stem(t) if len(t) >= ROUGE_MIN_STEM_LEN else t for t in {t for text in texts for t in text}}
    return pd.Series([[stems[t] for t in text] for text in texts])


def rouge_l(pairs: DataFrame, keys: Sequence[str], stem: bool = False,
            tokenizer: Tokenizer = rouge_tokens) -> DataFrame:
    """ROUGE-L precision, recall and F1 per pair from the exact LCS of
    the whole token sequences."""
    k = list(keys)
    arr = token_arrays(pairs, k, stem, tokenizer=tokenizer)
    s = _rouge_l_udf("gen_toks", "ref_toks")
    return arr.select(*k, s["p"].alias("rougeL_p"), s["r"].alias("rougeL_r"),
                      s["f"].alias("rougeL_f"))


# ---------------------------------------------------------------------------
# METEOR
# ---------------------------------------------------------------------------

def _meteor_udf(alpha: float, beta: float, gamma: float, use_stem: bool):
    @F.pandas_udf(T.DoubleType())
    def udf(gen: pd.Series, ref: pd.Series, words: pd.Series, classes: pd.Series) -> pd.Series:
        st = porter_stem if use_stem else None
        # a class is a tuple, so that it never equals a word
        return pd.Series([meteor_pair(list(g), list(r), alpha, beta, gamma, st, {a: (b,) for a, b in zip(w, c)})
                          for g, r, w, c in zip(gen, ref, words, classes)])
    return udf


def word_classes(pairs: DataFrame, keys: Sequence[str], synonyms: DataFrame,
                 tokenizer: Tokenizer = tokenize) -> DataFrame:
    """``(key..., words, classes)``: the words of each pair that stand in
    ``synonyms (word, class)``, with their class; at most its distinct words.

    The table is written first, so its size is known: Spark sends a small one
    to the words and joins a large one by sort-merge.  A word with several
    classes takes the smallest; NULL words and classes are left out.
    """
    k = list(keys)
    table = materialize(synonyms.where(F.col("word").isNotNull() & F.col("class").isNotNull())
                        .groupBy("word").agg(F.min(F.col("class").cast("string")).alias("class")))
    both = F.array_union(tokenizer("generated_text"), tokenizer("input_text"))
    found = pairs.select(*k, F.explode(both).alias("word")).join(table, "word")
    rows = found.groupBy(*k).agg(F.collect_list(F.struct("word", "class")).alias("_found"))
    return rows.select(*k, F.col("_found.word").alias("words"), F.col("_found.class").alias("classes"))


def meteor(pairs: DataFrame, keys: Sequence[str], alpha: float = 0.9, beta: float = 3.0,
           gamma: float = 0.5, stem: bool = True, synonyms: DataFrame | None = None,
           tokenizer: Tokenizer = tokenize) -> DataFrame:
    """METEOR per pair on word tokens (T1) of lower-cased text:
    exact matches, then Porter-stem matches, then, if a table ``synonyms
    (word, class)`` is given, words of one class.  ``keys`` name a pair."""
    k = list(keys)
    u = _meteor_udf(alpha, beta, gamma, stem)
    none = F.array().cast("array<string>")
    if synonyms is None:
        rows = pairs.withColumns({"words": none, "classes": none})
    else:
        own = word_classes(pairs, k, synonyms, tokenizer).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)], "words", "classes")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(k)])
        rows = pairs.select(*k, "generated_text", "input_text").join(own, same, "left")
    return rows.select(*k, u(tokenizer("generated_text"), tokenizer("input_text"),
                             F.coalesce("words", none), F.coalesce("classes", none)).alias("meteor"))


def overlap_scores(pairs: DataFrame, keys: Sequence[str], stem: bool = True) -> DataFrame:
    """Per pair ROUGE-1/2/L F1 and METEOR."""
    k = list(keys)
    rn = rouge_n(pairs, k, (1, 2), stem).select(*k, "rouge1_f", "rouge2_f")
    rl = rouge_l(pairs, k, stem).select(*k, "rougeL_f")
    mt = meteor(pairs, k)
    return rn.join(rl, on=k).join(mt, on=k)


def corpus_overlap(scores: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Corpus averages of the per-pair scores (per group)."""
    cols = [c for c in ("rouge1_f", "rouge2_f", "rougeL_f", "meteor") if c in scores.columns]
    names = {"rouge1_f": "Rouge_1", "rouge2_f": "Rouge_2", "rougeL_f": "Rouge_L",
             "meteor": "METEOR"}
    aggs = [F.count(F.lit(1)).alias("n_pairs")] + [F.avg(c).alias(names[c]) for c in cols]
    return scores.groupBy(*group_cols).agg(*aggs)
