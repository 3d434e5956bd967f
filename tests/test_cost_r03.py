"""What scoring costs: work done per distinct item (second half of round 3)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.functions.text import spaced, tokenize
from textdrift.llm import ngram_trie as nt
from textdrift.llm.elias_fano import EliasFano, encode
from textdrift.operators import diversity as dv
from textdrift.operators import grams
from textdrift.plans.scoring import score_corpus


def test_elias_fano_against_plain_search():
    rng = np.random.default_rng(7)
    for n, top in ((1, 2), (50, 60), (2000, 1 << 20), (3000, 1 << 60)):
        children = rng.integers(0, 1 << 40, n).astype(np.uint64)
        for v in (np.unique(rng.integers(0, top, n).astype(np.uint64)), np.unique((np.uint64(3) << np.uint64(40)) | children),
                  np.arange(n, dtype=np.uint64)):
            q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 200).astype(np.uint64)])
            at = np.minimum(np.searchsorted(v, q), len(v) - 1)
            series = EliasFano(encode(v))
            assert series.find(q).tolist() == np.where(v[at] == q, at, -1).tolist()
            if len(v) > 1:
                before, after = series.ends(np.arange(len(v) - 1))
                assert before.tolist() == v[:-1].tolist() and after.tolist() == v[1:].tolist()


def test_tokens_are_bytes_between_ascii_white_space():
    texts = ["", " \t\n", " A b\x0b\x0cB\r\na ", "É é x\x85y\xa0z \x1cw", "a"]
    t = nt.Tokens(texts)
    rows = [[nt.BEGIN, *map(nt.xxhash.xxh64_intdigest, x.encode().lower().split()), nt.STOP] for x in texts]
    assert t.words[t.word].tolist() == [h for row in rows for h in row]
    assert t.sizes.tolist() == [len(row) for row in rows]
    assert t.owner.tolist() == [i for i, row in enumerate(rows) for _ in row]


@pytest.mark.parametrize("order", [2, 3])
def test_every_path_is_searched_once(spark, monkeypatch, order):
    text = "a b c a b d " * 500
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = nt.learn(docs, order=order)
    asked = []
    find = EliasFano.find
    monkeypatch.setattr(EliasFano, "find", lambda self, values: asked.append(len(values)) or find(self, values))
    nt.Scorer(model).score([text, text])
    assert sum(asked) < 40  # the distinct words and n-grams, not the 6,000 places


ODD = ["", None, "  \t", "Ab_1 c!!d\n", "...", "a\x0bb\x0cc\rd\x85e\xa0f\u2003g\u3000h\x1ci", "É\u0301Straße İstanbul ΣΑΣ", "naïve—test «x» $1 \\ $0",
       "\U0001f600\U0001d400x ٣४ a\u200bb", "日本、語。ok", "\x00\x01z"]


def test_spaced_text_splits_into_the_tokens(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    rows = df.select("text", tokenize("text").alias("want"), spaced("text").alias("got")).collect()
    for r in rows:
        assert [w.decode() for w in r.got.encode().split()] == r.want
    pieces = df.select("id", spaced("text").alias("t")).orderBy("id").toArrow().column("t").combine_chunks()
    step = grams.Step(pieces)
    words = [w for r in rows for w in r.want]
    assert step.sizes.tolist() == [len(r.want) for r in rows]
    assert step.each.T.tolist() == grams.digests(words).tolist()


def test_scores_match_no_regex_for_every_word(spark):
    rows = [(i, ["x", None][i % 2], i % 3, t) for i, t in enumerate(ODD * 3)]
    records = spark.createDataFrame(rows, "id long, run string, generation int, generated_text string")
    reference = spark.createDataFrame([(1, "a b ok d É . a b")], "id long, text string")
    lists = records.withColumn("tok", tokenize("generated_text"))
    for df in (score_corpus(records, reference), dv.ngram_diversity(records, ["run"]), dv.text_losses(records, reference)):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {r[0]: (r.n, r.d) for r in lists.groupBy("run").agg(
        F.sum(F.size("tok")).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("tok")))).alias("d")).collect()}
    got = {r.run: (r.n_tokens, r.vocabulary) for r in score_corpus(records, reference, ["run"]).collect()}
    assert got == want
    by_lists = dv.ngram_diversity(records, ["run"], tokenizer=lambda c: tokenize(c)).collect()  # as token arrays
    assert sorted(map(str, dv.ngram_diversity(records, ["run"]).collect())) == sorted(map(str, by_lists))


def test_cells_hold_eighty_bits_of_a_digest():
    rng = np.random.default_rng(3)
    d = rng.integers(0, 1 << 64, (300, 2), np.uint64)
    d[0], d[1] = (0, 1 << 40), (0, 1 << 41)  # one shard, the first halves meet
    d = d[rng.integers(0, len(d), 4000)]
    group, counts = rng.integers(0, 3, len(d)), rng.integers(1, 9, len(d))
    want = {}
    for (a, b), g, c in zip(d.tolist(), group.tolist(), counts.tolist()):
        whole = a << 64 | b
        cell = want.setdefault((whole >> 121, g), {})
        cell[whole >> 41 & (1 << 80) - 1] = cell.get(whole >> 41 & (1 << 80) - 1, 0) + c
    for some, size in ((None, 10), (counts, 14)):
        shards, groups, records, starts = grams._cells(d, group, 3, 7, some)
        assert records.nbytes == size * len(records)  # 16 and 24 bytes were shuffled
        got = {}
        for s, g, cell in zip(shards.tolist(), groups.tolist(), np.split(records, starts[1:])):
            kept = got.setdefault((s, g), {})
            for a, b, *c in cell.tolist():
                kept[a << 16 | b] = kept.get(a << 16 | b, 0) + (c or [0])[0]
        assert {k: v.keys() for k, v in got.items()} == {k: v.keys() for k, v in want.items()}
        assert some is None or got == want


def test_digests_alike_in_their_leading_bits_are_told_apart():
    rng = np.random.default_rng(5)
    d = np.array([[1 << 63 | i, j] for i in range(3) for j in (0, 7, 1 << 63)], np.uint64)  # places need these trailing bits
    d = np.concatenate([d, rng.integers(0, 1 << 64, (50, 2), np.uint64)])[rng.integers(0, 59, 3000)]
    order, starts = grams._distinct(d)
    runs = np.split(d[order], starts[1:])
    assert all((r == r[0]).all() for r in runs)
    assert sorted(tuple(r[0]) for r in runs) == sorted(set(map(tuple, d)))
    assert len(grams._distinct(np.empty((0, 2), np.uint64))[1]) == 0
