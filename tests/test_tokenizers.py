"""the same operators with a column tokenizer and one of the user's own."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textdrift.functions.text import arrow_tokenizer, tokenize
from textdrift.operators import diversity, overlap
from textdrift.operators.corpus import pack_blocks

TEXTS = ["The cat, the dog and the cat.", "a b a b a b", None, "", "One two  three four; one two"]


def _pieces(texts):
    """Pieces of three characters, blanks among them."""
    return [[t[i:i + 3] for i in range(0, len(t), 3)] for t in texts]


@pytest.fixture(params=["words", "arrow_words", "pieces"])
def tokenizer(request):
    """(the tokenizer, the tokens it must give)"""
    words = lambda t: re.findall(r"\w+|[^\w\s]", (t or "").lower())
    if request.param == "words":
        return tokenize, words
    if request.param == "arrow_words":
        return arrow_tokenizer(lambda texts: [words(t) for t in texts]), words
    return arrow_tokenizer(_pieces), lambda t: [x.replace(" ", "▁") for x in _pieces([t or ""])[0]]


def test_counts_and_blocks(spark, tokenizer):
    use, expect = tokenizer
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(TEXTS)], "id long, g int, generated_text string")
    got = {(r.g, r.kind, r.item): r.c for r in diversity.item_counts(df, ["g"], n=2, tokenizer=use).collect() if r.kind is not None}
    want = Counter()
    for i, t in enumerate(TEXTS):
        tokens = expect(t)
        want.update((i % 2, diversity.TOKEN, x) for x in tokens)
        want.update((i % 2, diversity.NGRAM, f"{a} {b}") for a, b in zip(tokens, tokens[1:]))
    assert got == dict(want)
    totals = {r.g: r._n for r in diversity.group_totals(df, ["g"], tokenizer=use).collect()}
    assert totals == {g: sum(len(expect(t)) for t in TEXTS[g::2]) for g in (0, 1)}
    distinct = {r.g: r.diversity for r in diversity.ngram_diversity(df, ["g"], 2, tokenizer=use).collect()}
    assert distinct == {g: sum(k[:2] == (g, diversity.NGRAM) for k in want) for g in (0, 1)}
    sketches = diversity.sketch_diversity(diversity.ngram_sketches(df, ["g"], 2, tokenizer=use), ["g"])
    assert {r.g: r.diversity for r in sketches.collect()} == distinct
    blocks = pack_blocks(df, block=4, id_col="id", tokens=use("generated_text")).orderBy("block").collect()
    every = [x for t in TEXTS for x in expect(t)]
    assert [x for b in blocks for x in b.input_ids] == every[:len(every) // 4 * 4]


def test_overlap(spark, tokenizer):
    use, expect = tokenizer
    pairs = [(0, TEXTS[0], "the dog and a cat"), (1, TEXTS[4], "one two four"), (2, None, "x"), (3, "same text", "same text")]
    df = spark.createDataFrame(pairs, "id long, generated_text string, input_text string")
    rouge = {r.id: r for r in overlap.rouge_n(df, ["id"], (1,), tokenizer=use).collect()}
    lcs = {r.id: r for r in overlap.rouge_l(df, ["id"], tokenizer=use).collect()}
    met = {r.id: r.meteor for r in overlap.meteor(df, ["id"], stem=False, tokenizer=use).collect()}
    for i, a, b in pairs:
        x, y = expect(a), expect(b)
        both = sum((Counter(x) & Counter(y)).values())
        assert rouge[i].rouge1_p == pytest.approx(both / len(x) if x else 0.0)
        assert rouge[i].rouge1_r == pytest.approx(both / len(y) if x else 0.0)
        rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for s in range(len(x)):
            for t in range(len(y)):
                rows[s + 1][t + 1] = rows[s][t] + 1 if x[s] == y[t] else max(rows[s][t + 1], rows[s + 1][t])
        assert lcs[i].rougeL_r == pytest.approx(rows[-1][-1] / len(y) if x else 0.0)
        assert (met[i] > 0) == (both > 0)
    assert overlap.rouge_n(df, ["id"], (1,)).where(F.col("id") == 3).first().rouge1_f == 1.0
