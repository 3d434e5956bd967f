"""Hand-computed text fixtures."""

import math

from pyspark.sql import functions as F

from textdrift.functions.text import attention_mask, f1, ngrams, pad_tokens, tokenize
from textdrift.operators import diversity as dv
from textdrift.plans.scoring import score_corpus


def _one(spark, text):
    return spark.createDataFrame([(1, "r", 0, "", text)],
                                 "id long, run string, generation int, input_text string, "
                                 "generated_text string")


def test_tokenize_words_and_punctuation(spark):
    df = spark.createDataFrame([("Été, it's a TEST.",)], "t string")
    toks = df.select(tokenize("t").alias("x")).first().x
    assert toks == ["été", ",", "it", "'", "s", "a", "test", "."]


def test_tokenize_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tokenize("t").alias("x")).first().x == []


def test_ngrams_short_array_gives_nothing(spark):
    df = spark.createDataFrame([(["a", "b"],)], "t array<string>")
    assert df.select(ngrams("t", 3).alias("g")).first().g == []
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>")
    assert df.select(ngrams("t", 3).alias("g")).first().g == ["a b c", "b c d"]


def test_corpus_metrics_fixture(spark):
    rec = _one(spark, "the cat sat on the mat the cat ran")
    row = score_corpus(rec, threshold=0.2).first()
    assert row.n_tokens == 9 and row.vocabulary == 6 and row.diversity == 7
    assert math.isclose(row.entropy, 2.4193819456, rel_tol=1e-9)
    assert math.isclose(row.high_freq_ratio, 5 / 9, rel_tol=1e-12)


def test_entropy_bounds_and_diversity_bound(spark):
    rec = _one(spark, "a b a c d e a b f g h")
    row = score_corpus(rec).first()
    assert 0 <= row.entropy <= math.log2(row.vocabulary) + 1e-12
    assert row.diversity <= row.n_tokens - 2


def test_partition_count_does_not_change_results(spark):
    from textdrift.sources.tables import documents_as_records
    rec = documents_as_records(spark, "/root/testdata/sf0.001")
    a = sorted(map(tuple, score_corpus(rec).collect()))
    b = sorted(map(tuple, score_corpus(rec.repartition(3)).collect()))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert (u == v) or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9))


def test_weighted_and_mean_perplexity(spark):
    losses = spark.createDataFrame([("g", 1.0, 10), ("g", 2.0, 30)], "k string, loss double, n_tokens long")
    w = dv.weighted_perplexity(losses, ["k"]).first()
    assert math.isclose(w.weighted_perplexity, math.exp(1.75))
    m = dv.mean_perplexity(losses, ["k"]).first()
    assert math.isclose(m.mean_batch_perplexity, (math.e + math.e ** 2) / 2)


def test_pad_and_mask(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "t array<int>")
    r = df.select(pad_tokens("t", 5).alias("p"), attention_mask("t", 5).alias("m")).first()
    assert r.p == [1, 2, 3, 0, 0] and r.m == [1, 1, 1, 0, 0]


def test_f1_zero_when_both_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0)], "p double, r double")
    vals = [r.f for r in df.select(f1("p", "r").alias("f")).collect()]
    assert vals[0] == 0.0 and math.isclose(vals[1], 2 / 3)


def test_bigram_perplexity_brute_force(spark):
    ref = spark.createDataFrame([(1, "a b a c"), (2, "b a")], "id long, text string")
    rec = _one(spark, "a b c d")
    got = dv.ngram_perplexity(rec, ref, ["run"]).first().perplexity
    # brute force: V = |{a,b,c}| + 1 = 4; bigrams of ref: ab, ba, ac, ba
    big = {("a", "b"): 1, ("b", "a"): 2, ("a", "c"): 1}
    ctx = {"a": 2, "b": 2, "c": 0}
    lp = [math.log((big.get((v, w), 0) + 1) / (ctx.get(v, 0) + 4))
          for v, w in [("a", "b"), ("b", "c"), ("c", "d")]]
    assert math.isclose(got, math.exp(-sum(lp) / 3), rel_tol=1e-12)


def test_groups_without_items_stay(spark):
    from textdrift.operators import diversity as dv
    rows = [("a", 0, "one two three four"), ("b", 0, ""), ("c", 0, "single"), ("c", 0, None)]
    rec = spark.createDataFrame(rows, "run string, generation int, generated_text string")
    ref = spark.createDataFrame([("one two three",)], "text string")
    g = ["run", "generation"]
    got = {r.run: r for r in score_corpus(rec, ref).collect()}
    assert [got[k].n_tokens for k in "abc"] == [4, 0, 1]
    assert [got[k].vocabulary for k in "abc"] == [4, 0, 1] and [got[k].diversity for k in "abc"] == [2, 0, 0]
    assert got["b"].entropy is None and got["b"].high_freq_ratio is None and got["b"].perplexity is None
    assert got["c"].entropy == 0 and got["c"].perplexity is None and got["a"].perplexity > 0
    assert {r.run: r.diversity for r in dv.ngram_diversity(rec, g).collect()} == {"a": 2, "b": 0, "c": 0}
    assert {r.run for r in dv.token_entropy(rec, g).collect()} == {"a", "b", "c"}
    assert {r.run: r.high_freq_ratio for r in dv.high_freq_ratio(rec, g).collect()} == {"a": 1.0, "b": None, "c": 1.0}
    assert {r.run: r.n_bigrams for r in dv.ngram_perplexity(rec, ref, g).collect()} == {"a": 3, "b": 0, "c": 0}
