"""What a text or pair costs: tokens worked out once, pieces and n-grams in
compact form (findings of round 3)."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textdrift.operators import corpus as cp
from textdrift.operators import diversity as dv
from textdrift.operators import grams
from textdrift.operators import overlap as ov
from textdrift.plans.scoring import score_corpus


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_padding_names_no_lambda(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["x"] * 5), (4, None)], "id long, toks array<string>")
    arr, mask = cp.padded(F.col("toks"), 3)
    out = df.select("id", arr.alias("a"), mask.alias("m"))
    assert "lambda" not in plan(out).lower()  # a lambda split the text anew for every place
    got = {r.id: (r.a, r.m) for r in out.collect()}
    assert got == {1: (["a", "b", "<pad>"], [1, 1, 0]), 2: (["<pad>"] * 3, [0] * 3), 3: (["x"] * 3, [1] * 3), 4: (None, [0] * 3)}


def test_pack_blocks_explodes_pieces_only(spark):
    text = " ".join(f"w{i}" for i in range(150))
    df = spark.createDataFrame([(1, text), (2, None), (3, "a  b!\n" * 5), (1003, "")], "id long, generated_text string")
    out = cp.pack_blocks(df, block=64)
    assert "Generate inline" in plan(out) and "Generate explode" not in plan(out)  # the token list went into every piece's row
    whole = text.split() + ["a", "b", "!"] * 5
    assert [r.input_ids for r in out.orderBy("block").collect()] == [whole[:64], whole[64:128]]


ROWS = [(1, "x", 1, "the cat sat on the mat the cat sat"), (2, "x", 1, "the cat ran . the end"), (3, None, 2, "a b"),
        (4, "y", 1, ""), (5, "y", 1, None), (6, None, 2, "A b a B a b")]
REFERENCE = [(1, "the cat sat on a b ."), (2, "the cat ran")]


def _by_hand(rows):
    groups = {}
    for _, run, generation, text in rows:
        groups.setdefault((run, generation), []).append((text or "").lower().split())
    ref = [t.split() for _, t in REFERENCE]
    bi = Counter(p for t in ref for p in zip(t, t[1:]))
    ctx = Counter(v for t in ref for v in t[:-1])
    size = len({w for t in ref for w in t}) + 1
    out = {}
    for key, texts in groups.items():
        counts = Counter(w for t in texts for w in t)
        n = sum(counts.values())
        pairs = [p for t in texts for p in zip(t, t[1:])]
        loss = [math.log(ctx[v] + size) - math.log(bi[v, w] + 1) for v, w in pairs]
        out[key] = (n, len(counts), len({g for t in texts for g in zip(t, t[1:], t[2:])}),
                    sum(c for c in counts.values() if c / n > 0.2) / n if n else None,
                    -sum(c / n * math.log2(c / n) for c in counts.values()) if n else None,
                    math.exp(sum(loss) / len(loss)) if loss else None)
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_scores_by_hand_with_small_and_large_model(spark, monkeypatch, most):
    monkeypatch.setattr(dv, "MODEL_ROWS", most)
    records = spark.createDataFrame(ROWS, "id long, run string, generation int, generated_text string")
    reference = spark.createDataFrame(REFERENCE, "id long, text string")
    out = score_corpus(records, reference, threshold=0.2)
    want = _by_hand(ROWS)
    got = {(r.run, r.generation): tuple(r)[2:] for r in out.collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])
    losses = dv.text_losses(records, reference, keep_cols=["run"]).collect()
    assert sorted(r.id for r in losses) == [1, 2, 3, 6]
    got = {(r.run, r.generation): r.perplexity for r in dv.ngram_perplexity(records, reference, ["run", "generation"]).collect()}
    assert got == pytest.approx({k: v[5] for k, v in want.items()})


def test_small_model_sends_no_items(spark):
    records = spark.createDataFrame(ROWS, "id long, run string, generation int, generated_text string")
    reference = spark.createDataFrame(REFERENCE, "id long, text string")
    for df in (dv.text_losses(records, reference), score_corpus(records, reference), dv.ngram_diversity(records, ["run"])):
        assert "Generate" not in plan(df)  # items were exploded to strings


def test_grams_across_steps_and_batches(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 40}" for j in range(50)) for i in range(60)]
    records = spark.createDataFrame(list(enumerate(texts)), "id long, generated_text string").repartition(5)
    want = len({g for t in texts for w in [t.split()] for g in zip(w, w[1:], w[2:])})
    assert dv.ngram_diversity(records, []).first().diversity == want
    piece = grams.Step
    import pyarrow as pa
    monkeypatch.setattr(grams, "STEP", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([t.split() for t in texts])], names=["t"])
    pieces = list(grams._steps(batch))
    assert len(pieces) == 30 and sum(len(piece(p.column(0)).code) for p in pieces) == 3000
    d = grams.digests(["a", "b"])
    same = grams._distinct(d[[0, 1, 0, 1, 0]])
    assert len(same[1]) == 2
    half = d[[0, 0, 0]].copy()
    half[1, 1] ^= 1  # the first halves meet, the second do not
    assert len(grams._distinct(half)[1]) == 2


def test_sketches_of_short_texts(spark):
    records = spark.createDataFrame([(1, "g", "a b c d"), (2, "g", "a b c"), (3, "h", "a b"), (4, None, None)],
                                    "id long, run string, generated_text string")
    out = dv.sketch_diversity(dv.ngram_sketches(records, ["run"]), ["run"])
    assert {r.run: r.diversity for r in out.collect()} == {"g": 2, "h": 0, None: 0}


PAIRS = [(1, "the cats sat on the mat", "the cat sat on a mat"), (1, "the cats", "running cats"), (2, "", "a"), (None, "a b a", "a b")]


def test_rouge_keeps_grams_in_the_pairs_row(spark):
    pairs = spark.createDataFrame(PAIRS, "pair_id long, generated_text string, input_text string")
    for stem in (False, True):
        out = ov.rouge_n(pairs, ["pair_id"], (1, 2), stem=stem)
        assert "Generate" not in plan(out) and "Join" not in plan(out)  # every n-gram was a row
        got = {r.pair_id: r for r in out.collect()}
        assert got.keys() == {1, 2, None}
        # rows that share their keys count together: 8 words a side
        assert got[1].rouge1_p == pytest.approx((6 if stem else 5) / 8)
        assert (got[2].rouge1_f, got[None].rouge1_p, got[None].rouge2_r) == (0.0, pytest.approx(2 / 3), 1.0)


def test_op4_scores_by_trigrams(spark, tmp_path):
    from textdrift.llm import ngram_trie
    rows = [(i, "a x b" if i % 2 else "c x d") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in ngram_trie.op4(spark, str(tmp_path)).collect()}
    by_pairs = {r.doc_id: r.score for r in ngram_trie.score(
        spark.createDataFrame(rows, "doc_id long, text string"), ngram_trie.learn(
            spark.createDataFrame(rows, "doc_id long, text string"), order=2)).collect()}
    # what follows x is settled by the word before it, which pairs do not see
    assert got[1] > by_pairs[1] + 0.2 and got[2] > by_pairs[2] + 0.2


@pytest.mark.parametrize("idle", [None, 50.0])
def test_stream_takes_many_keys_a_call(spark, tmp_path, monkeypatch, idle):
    from textdrift.streaming import monitor as mon
    monkeypatch.setattr(mon, "BUCKETS", 2)  # a call per key was what took the time
    rules = mon.MonitorRules()
    rows = [(i, i * 7 % 40 + 40 * (i // 40) + (200 if i > 300 and i % 3 else 0), i % 11 if i % 13 else None, i % 4, float(i % 5),
             (i * 37 % 100) / 20, (i * 53 % 100) / 100, (i * 29 % 100) / 500 if i % 9 else None) for i in range(500)]
    obs = spark.createDataFrame(rows, "event_id long, s long, Run long, Generation int, Perplexity double, Diversity double, "
                                      "HighFreq double, METEOR double").withColumn("ts", F.timestamp_seconds(F.col("s") + 100_000)).drop("s")
    for low, high in ((0, 160), (160, 320), (320, 500)):
        part = obs.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = mon.monitor_stream(stream, rules, key=F.col("Run"), idle_seconds=idle, delay="1000 seconds")
    q = (out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2
    cols = ["monitor_id", "event_id", "seq", "hist_len", "warning_count", "level", "status", "relation_residual", "Diversity_change"]
    show = lambda df: sorted((tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()))
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    late = got.where("late").select("monitor_id", "event_id").collect()
    kept = obs.join(got.where("not late").select("event_id"), "event_id")
    want = mon.monitor_replay(kept, rules, key=F.col("Run"), idle_seconds=idle)
    assert len(late) < 100 and got.count() == 500
    # the replay leaves rows without a key out
    assert show(got.where("not late and monitor_id is not null").select(*cols)) == show(want.select(*cols))
    assert got.where("monitor_id is null").count() == 39
