"""What a counting step holds at once, and where a frequent word's n-grams lie."""

import glob
import os
import tracemalloc

import numpy as np
import pytest

from textdrift.llm import ngram_trie
from textdrift.llm.elias_fano import EliasFano, encode


def test_a_counting_step_holds_few_bytes_a_token():
    # 124 bytes a token before: two workers' steps and the JVM took more than an executor has
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5021}" for j in range(1000)) for i in range(1200)]
    tracemalloc.start()
    try:
        for _ in ngram_trie.Tokens(texts).ngrams(3, 4):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * 1_200_000


@pytest.mark.parametrize("order", [2, 3])
def test_a_frequent_words_successors_lie_in_several_shards(spark, order):
    # every second word is the same one: it had all its successors in one shard
    docs = spark.createDataFrame([(i, " ".join(f"of v{i * 50 + j}x" for j in range(50))) for i in range(60)], "doc_id long, text string")
    model = ngram_trie.learn(docs, order=order, shard_chars=500)
    sizes = sorted(os.path.getsize(f) for f in glob.glob(f"{model.folder.removeprefix('file:')}/shard-*.bin"))
    assert len(sizes) == len(model.present) > 32 and sizes[-1] < sum(sizes) / 6
    assert (model.tokens, model.distinct) == (60 * 101, 3002)  # no word counts twice
    got = {r.doc_id: r for r in ngram_trie.score(docs, model).collect()}
    whole = ngram_trie.learn(docs, order=order)  # one shard
    for r in ngram_trie.score(docs, whole).collect():
        assert (got[r.doc_id].n_known, got[r.doc_id].base_score) == (101, r.base_score)
        assert got[r.doc_id].score == pytest.approx(r.score, abs=2e-4 * 101)


def test_an_open_shard_takes_no_memory_for_its_nodes(tmp_path):
    # a directory of the zeros, a quarter of a byte a node, was made anew for every shard that a task opened
    parts = encode(np.arange(1 << 20, dtype=np.uint64) * np.uint64(1000))
    for name, a in parts.items():
        a.tofile(tmp_path / name)
    mapped = {name: np.memmap(tmp_path / name, a.dtype, "r") for name, a in parts.items()}
    tracemalloc.start()
    try:
        series = EliasFano(mapped)
        taken = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert taken < 10_000
    assert series.find(np.array([0, 999, 1000, 1000 * ((1 << 20) - 1)], np.uint64)).tolist() == [0, -1, 1, (1 << 20) - 1]
