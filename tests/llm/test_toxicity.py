"""Toxicity: the kernel against a direct computation, and words that are spaced
out, interleaved or stretched."""

import itertools

import numpy as np
import pytest

from textdrift.llm import toxicity

INSULTS = ("blockhead", "wretched")


def _direct(word, span, n, decay):
    """Weight of each subsequence, from all choices of letters."""
    found = {}
    for places in itertools.combinations(range(len(word)), n):
        reach = places[-1] - places[0] + 1
        if reach <= span:
            key = "".join(word[p] for p in places)
            found[key] = max(found.get(key, 0.0), decay ** (reach - n))
    return found


def test_kernel_equals_direct_computation():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(1, 14, 60)] + ["abc", "aaaaaaaa"]
    words = list(dict.fromkeys(words))
    marks = [w for w in words if len(w) >= toxicity.LETTERS][:9]
    owner, values = toxicity.Landmarks(marks).kernel(words)
    got = np.zeros((len(words), len(marks)))
    got[owner] = values
    features = {w: _direct(w, toxicity.SPAN, toxicity.LETTERS, toxicity.DECAY) for w in words}
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            want = sum(v * features[m].get(k, 0.0) for k, v in features[w].items())
            assert got[i, j] == pytest.approx(want, rel=1e-5)


def test_words_compared():
    assert toxicity.compared("Go, b l o c k h e a d!") == [["goblockhead"]]
    assert toxicity.compared("bl ockh ead\nsomething else") == [["blockhead"], ["something", "else"]]
    assert toxicity.compared("b·l​o*ckhead today") == [["blockhead", "today"]]
    assert toxicity.compared("bxlxoxcxkxhxexaxd") == [["bxlxoxcxkxhxexaxd", "blockhead"]]
    assert toxicity.compared("banana mississippi") == [["banana", "mississippi"]]
    assert toxicity.compared(None) == toxicity.compared(" .\n! 12") == []
    long = "".join(chr(97 + i % 23) for i in range(5 * toxicity.LONGEST))
    pieces = toxicity.compared(long)[0]
    assert max(map(len, pieces)) <= toxicity.LONGEST
    assert all(any(long[i:i + toxicity.LONGEST // 2] in p for p in pieces) for i in range(len(long) - toxicity.LONGEST // 2))


def test_hidden_insults_are_found(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9)))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, 25))
        if i % 3 == 0:
            words[int(rng.integers(25))] = INSULTS[i % 2]
        rows.append((i, " ".join(words[:12]) + ". " + " ".join(words[12:])))
        labels.append((i, int(i % 3 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    hidden = [f for w in INSULTS for f in (
        w, " ".join(w), f"{w[:2]} {w[2:6]} {w[6:]}", "x".join(w), "".join(c * 3 if k % 2 else c for k, c in enumerate(w)),
        "-".join(w), "·".join(w), w[:4] + "q" + w[4:])]
    clean = [" ".join(rng.choice(plain, 25)) for _ in range(60)] + [None, ""]
    assert (model.score([f"{plain[0]} you {f} now" for f in hidden]) >= toxicity.THRESHOLD).all()
    assert (model.score(clean) < toxicity.THRESHOLD).mean() >= 0.95
    # remembered words and fresh ones are worth the same, in any batch
    both = hidden + clean
    assert np.array_equal(model.score(both), [model.score([t])[0] for t in both])
