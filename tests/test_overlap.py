"""ROUGE, METEOR, LCS and stemming fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textdrift.functions.alignment import count_chunks, lcs_length, meteor_pair
from textdrift.functions.porter import stem
from textdrift.operators import overlap as ov


def _pairs(spark, rows):
    return spark.createDataFrame([(i, g, r) for i, (g, r) in enumerate(rows)],
                                 "pair_id long, generated_text string, input_text string")


def test_rouge_fixture(spark):
    p = _pairs(spark, [("the cat sat", "the cat ran")])
    r = ov.rouge_n(p, ["pair_id"], (1, 2)).first()
    assert math.isclose(r.rouge1_f, 2 / 3) and math.isclose(r.rouge2_f, 1 / 2)
    l = ov.rouge_l(p, ["pair_id"]).first()
    assert math.isclose(l.rougeL_f, 2 / 3)
    m = ov.meteor(p, ["pair_id"]).first()
    assert math.isclose(m.meteor, 0.625)


def test_empty_side_scores_zero(spark):
    p = _pairs(spark, [("", "the cat"), ("the cat", "")])
    for r in ov.rouge_n(p, ["pair_id"]).collect():
        assert r.rouge1_f == 0.0 and r.rouge2_f == 0.0
    for r in ov.meteor(p, ["pair_id"]).collect():
        assert r.meteor == 0.0


def test_identical_texts(spark):
    p = _pairs(spark, [("a quick brown fox", "a quick brown fox")])
    r = ov.rouge_n(p, ["pair_id"]).first()
    assert r.rouge1_f == 1.0 and r.rouge2_f == 1.0
    assert ov.rouge_l(p, ["pair_id"]).first().rougeL_f == 1.0


def test_clipped_overlap(spark):
    # generated has "the" three times, reference once: overlap is clipped to 1
    p = _pairs(spark, [("the the the", "the cat")])
    r = ov.rouge_n(p, ["pair_id"], (1,)).first()
    assert math.isclose(r.rouge1_p, 1 / 3) and math.isclose(r.rouge1_r, 1 / 2)


def test_lcs_matches_dynamic_programming():
    rnd = random.Random(7)

    def dp(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]
    for _ in range(200):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        assert lcs_length(a, b) == dp(a, b)


def test_meteor_chunks_and_stems():
    assert count_chunks([(0, 0), (1, 1), (3, 2)]) == 2
    # "running" and "run" share the stem "run": 2 matches, 1 chunk
    s = meteor_pair(["he", "running"], ["he", "run"])
    p = r = 1.0
    assert math.isclose(s, (p * r / (0.9 * p + 0.1 * r)) * (1 - 0.5 * (1 / 2) ** 3))


def test_porter_full_stems():
    expected = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre",
                "motoring": "motor", "hopping": "hop", "happy": "happi", "relational": "relat",
                "generalizations": "gener", "hopefulness": "hope", "adjustment": "adjust",
                "controll": "control", "sky": "sky", "be": "be"}
    for w, s in expected.items():
        assert stem(w) == s, w


def test_stemmed_rouge_uses_stems(spark):
    p = _pairs(spark, [("cats running", "cat runs")])
    plain = ov.rouge_n(p, ["pair_id"], (1,)).first().rouge1_f
    stemmed = ov.rouge_n(p, ["pair_id"], (1,), stem=True).first().rouge1_f
    # "cats"/"cat": cat is 3 letters and is not stemmed, "cats" -> "cat";
    # "running" -> "run", "runs" -> "run"
    assert plain == 0.0 and stemmed == 1.0


def test_salted_stem_join_is_identical(spark):
    p = _pairs(spark, [("the cats were running home", "the cat runs home"),
                       ("the the the running", "the runner ran"), ("", "x")])
    a = sorted(map(tuple, ov.rouge_n(p, ["pair_id"], (1, 2), stem=True).collect()))
    b = sorted(map(tuple, ov.rouge_n(p, ["pair_id"], (1, 2), stem=True, salt=4).collect()))
    assert a == b


def test_stemmed_rouge_and_rouge_l_match_brute_force(spark):
    import re
    from collections import Counter

    from textdrift.sources.tables import conversation_turns
    pairs = ov.conversation_pairs(conversation_turns(spark, "/root/testdata/sf0.001"))
    rows = pairs.toPandas()

    def toks(t):
        return [stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", (t or "").lower())]

    def lcs_dp(a, b):
        prev = [0] * (len(b) + 1)
        for x in a:
            cur = [0]
            for j, y in enumerate(b):
                cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
            prev = cur
        return prev[-1]

    def f(o, n1, n2):
        if n1 == 0 or n2 == 0:
            return 0.0
        p, r = o / n1, o / n2
        return 0.0 if p + r == 0 else 2 * p * r / (p + r)

    exp = {}
    for _, r in rows.iterrows():
        g, ref = toks(r.generated_text), toks(r.input_text)
        grams = lambda t, n: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
        o1 = sum((grams(g, 1) & grams(ref, 1)).values())
        o2 = sum((grams(g, 2) & grams(ref, 2)).values())
        exp[(r.conv_id, r.turn)] = (f(o1, len(g), len(ref)), f(o2, len(g) - 1, len(ref) - 1),
                                    f(lcs_dp(g, ref), len(g), len(ref)))
    got_n = {(x.conv_id, x.turn): (x.rouge1_f, x.rouge2_f)
             for x in ov.rouge_n(pairs, ["conv_id", "turn"], (1, 2), stem=True).collect()}
    got_l = {(x.conv_id, x.turn): x.rougeL_f
             for x in ov.rouge_l(pairs, ["conv_id", "turn"], stem=True).collect()}
    assert set(got_n) == set(exp) == set(got_l)
    for k, (e1, e2, el) in exp.items():
        assert abs(got_n[k][0] - e1) < 1e-12 and abs(got_n[k][1] - e2) < 1e-12
        assert abs(got_l[k] - el) < 1e-12


def test_meteor_stack_matching_equals_naive_scan(spark):
    """The O(n+m) matcher equals the plain scan: each hypothesis word from the
    end takes the last unmatched reference word with the same key."""
    import re

    def naive(hyp, ref):
        h, r = list(enumerate(hyp)), list(enumerate(ref))
        matches = []
        for key in (lambda w: w, stem):
            for i in range(len(h))[::-1]:
                for j in range(len(r))[::-1]:
                    if key(h[i][1]) == key(r[j][1]):
                        matches.append((h[i][0], r[j][0]))
                        h.pop(i)
                        r.pop(j)
                        break
        if not matches:
            return 0.0
        matches.sort()
        m = len(matches)
        chunks = 1 + sum(1 for a, b in zip(matches, matches[1:])
                         if not (b[0] == a[0] + 1 and b[1] == a[1] + 1))
        p, rc = m / len(hyp), m / len(ref)
        return (1 - 0.5 * (chunks / m) ** 3) * p * rc / (0.9 * p + 0.1 * rc)

    from textdrift.sources.tables import conversation_turns
    rows = ov.conversation_pairs(conversation_turns(spark, "/root/testdata/sf0.001")).toPandas()
    for _, r in rows.head(40).iterrows():
        g = [t for t in re.findall(r"[\w]+|[^\w\s]", (r.generated_text or "").lower())]
        ref = [t for t in re.findall(r"[\w]+|[^\w\s]", (r.input_text or "").lower())]
        assert abs(meteor_pair(g, ref) - naive(g, ref)) < 1e-12


def test_zip_texts_with_repeated_order_values(spark):
    gen = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "id long, generated_text string")
    ref = spark.createDataFrame([(5, "x"), (5, "y"), (6, "z")], "id long, generated_text string")
    got = sorted((r.pair_id, r.generated_text, r.input_text) for r in ov.zip_texts(gen, ref, "id").collect())
    assert got == [(0, "a", "x"), (1, "b", "y"), (2, "c", "z")]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_meteor_synonyms_sent_and_merged(spark, threshold):
    words = [("car", "v"), ("auto", "v"), ("car", "w"), ("quick", "s"), ("fast", "s"), ("5", "t"), ("nap", None), (None, "v")]
    table = spark.createDataFrame(words, "word string, class string")
    classes = {"car": ("v",), "auto": ("v",), "quick": ("s",), "fast": ("s",), "5": ("t",)}
    texts = [("a quick car", "the fast auto"), ("car car fast", "auto quick"), ("nap", "v"), ("t", "5"), (None, "car"), ("", "")]
    p = _pairs(spark, texts).withColumn("words", F.lit("a clashing name"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r.pair_id: r.meteor for r in ov.meteor(p, ["pair_id"], synonyms=table).collect()}
        plain = {r.pair_id: r.meteor for r in ov.meteor(p, ["pair_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for i, (g, r) in enumerate(texts):
        g, r = (g or "").split(), (r or "").split()
        assert math.isclose(got[i], meteor_pair(g, r, synonyms=classes))
        assert math.isclose(plain[i], meteor_pair(g, r))
    assert got[0] > plain[0] == 0 and got[2] == got[3] == 0
