"""The pipeline: columns, decisions and rows of every stage."""

from collections import Counter

import pytest

import corpus_pipeline as P
from tests.llm.test_operators import docs, nothing  # noqa: F401
from textdrift.llm import mixing
from textdrift.llm.common import with_row_key
from textdrift.llm.substring_dedup import remove_repeats


def test_stages_chain(spark, docs, nothing):  # noqa: F811
    columns = docs.columns
    for start in (docs.where("doc_id is not null").dropDuplicates(["doc_id"]), nothing):
        frame, n = start, start.count()
        for name, stage in P.STAGES:
            frame = P.materialize(stage(spark, frame, ""))
            if name != P.STAGES[-1][0]:
                assert frame.columns == columns
            if name in ("language_id", "exact_dedup", "simhash_near_dedup"):
                ids = [r["doc_id"] for r in frame.select("doc_id").collect()]
                assert len(ids) == len(set(ids)) <= n
                n = len(ids)
        assert {"doc_id", "sequence_id", "offset"} <= set(frame.columns)


def test_rows_without_an_id_or_sharing_one_are_decided_one_by_one(spark):
    words = [" ".join(f"{c}{i}{c}" for i in range(30)) for c in "abcdef"]
    rows = [(None, words[0]), (None, words[0]), (None, words[1]), (None, words[2]), (5, words[3]), (5, words[3]), (5, words[4]),
            (6, words[0]), (7, words[5]), (None, words[5])]
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(3)
    want = sorted([(6, words[0]), (None, words[1]), (None, words[2]), (5, words[3]), (5, words[4]), (7, words[5])], key=str)
    for stage in (P.exact_stage, P.near_stage):
        out = stage(spark, frame, "")
        assert out.columns == frame.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want


def test_substring_spans_of_one_row_do_not_touch_rows_with_the_same_id(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(None, text[0]), (None, text[1]), (1, text[0]), (2, text[2]), (2, text[2]), (2, text[1] + " " + text[2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(frame).collect()), key=str)
    ones = [g for g in got if g[0] != 2]
    assert ones == [(1, 40, 40), (None, 40, 0), (None, 40, 0)]
    # of the three rows with the passage, one keeps it; the words before it in the last stand in a row without an id
    assert sum(g[2] for g in got if g[0] == 2) == 120


def test_rows_without_an_id_or_sharing_one_are_mixed_one_by_one(spark):
    rows = [(None if i < 30 else 5 if i < 40 else i, " ".join(f"t{i}" for _ in range(20)), "en", "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    keyed = with_row_key(frame)
    mixed = mixing.mix(keyed, cut_last=False, row="row_key").collect()
    text = {r["row_key"]: r["text"] for r in keyed.collect()}
    out = P.mixing_stage(spark, frame, "")
    assert out.columns == frame.columns
    got = Counter(r["text"] for r in out.collect())
    assert sum(got.values()) == sum(r["copies"] for r in mixed) and max(got.values()) <= 2
    again = mixing.curriculum(keyed, mixing.mix(keyed, cut_last=False, row="row_key"), row="row_key")
    assert Counter(r["text"] for r in again.collect()) == +Counter({text[r["row"]]: r["copies"] for r in mixed})
    with pytest.raises(ValueError):
        mixing.curriculum(frame, mixing.mix(frame, cut_last=False))


CLASHES = ["rank", "row", "row_key", "doc", "gone", "gone_key", "mix_key", "mix_place", "mix_position", "mix_positions", "mix_part",
           "mix_own", "mix_doc", "own_row", "digest", "first", "size", "place", "a b", "x.y", "_metadata"]


def test_clashing_columns_pass_through_all_stages(spark, tmp_path):
    words = [" ".join(f"{c}{i}{c}" for i in range(30)) for c in "abcdefgh"]
    rows = [(i, words[i % 8], "en", "ab"[i % 2], len(words[i % 8]), *[f"{c} {i}" for c in CLASHES]) for i in range(16)]
    rows += [(None, words[0], "en", "a", 3, *[None for _ in CLASHES]), (3, words[3], "en", None, None, *["again" for _ in CLASHES])]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    own = {i: r for i, r in enumerate(rows)}
    for as_file in (True, False):
        frame = spark.createDataFrame(rows, schema).repartition(3)
        if as_file:
            frame.write.parquet(str(tmp_path / "in"))
            frame = spark.read.parquet(str(tmp_path / "in"))
        for name, stage in P.STAGES[1:4]:  # the texts are of no language
            frame = P.materialize(stage(spark, frame, ""))
            assert frame.columns == names
            got = [tuple(r) for r in frame.collect()]
            assert set(got) <= set(own.values())
            if name != "source_mixing":
                assert len(got) == 8 and sorted(r[0] for r in got) == list(range(8))
        assert max(Counter(got).values()) <= 2


def test_index_outlives_its_session_and_a_batch_can_run_again(spark, tmp_path):
    from textdrift.llm.exact_dedup import DigestIndex, deduplicate
    first = spark.createDataFrame([(2, "a b"), (1, "a  b"), (1, "a b"), (None, "c"), (None, "c"), (5, None)], "doc_id long, text string").repartition(3)
    path = str(tmp_path / "index")

    def run(session, frame, batch):
        index = DigestIndex(session, "lasting_index", path, buckets=3)
        assert index.buckets == 3
        frame = session.createDataFrame(frame.collect(), frame.schema)
        rows = deduplicate(frame, index, batch=batch).collect()
        return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["seen_before"]) for r in rows), index
    one, index = run(spark, first, "one")
    assert one == sorted([("2", "1", 3, False, False), ("1", "1", 3, True, False), ("1", "1", 3, False, False),
                          ("None", "None", 2, True, False), ("None", "None", 2, False, False), ("5", "5", 1, True, False)])
    size = index.table().count()
    assert size == 3 and run(spark, first, "one")[0] == one and index.table().count() == size
    other = spark.newSession()  # its own names, the same folder
    other.sql("DROP TABLE IF EXISTS lasting_index")
    two, again = run(other, spark.createDataFrame([(1, "a b"), (9, "new")], "doc_id long, text string"), "two")
    assert two == [("1", "1", 1, False, True), ("9", "9", 1, True, False)]
    assert again.table().count() == 4 and DigestIndex(other, "lasting_index", path, buckets=99).buckets == 3
    plan = again.unseen(spark.createDataFrame([("x",)], "digest string"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    try:
        DigestIndex(other, "lasting_index", str(tmp_path / "elsewhere")).create("bigint")
    except ValueError:
        pass
    else:
        raise AssertionError("a table of another folder was taken over")
