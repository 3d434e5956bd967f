"""Rule forest, Merkle manifest and whitening against brute-force versions."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.llm import merkle, rule_forest, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, number string, tree string, score_symbols string, x string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", "clash", "clash") for r in rows], DOCS).repartition(3)


# --- rule forest -----------------------------------------------------------

def brute_counts(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


def test_rule_counts_match_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b   c é漢字\x85x\x1cy", "a b c d e f g h " * 3, "x\n\nx\n x\nx ", "|#*$%&<> " * 30]
    for _ in range(200):
        texts.append("".join(rng.choice(list("ab# \n\té漢|\x1f")) for _ in range(rng.integers(0, 200))))
    texts += [" ".join(rng.choice(["a", "b"], 400)), " ".join(map(str, range(3000))) + " 1 2 3 4 5 6 7 8"]
    for portion in (1, 500, 4_000_000):
        monkeypatch.setattr(rule_forest, "PORTION", portion)
        counts, features = rule_forest.text_statistics(texts)
        assert [tuple(c) for c in counts.tolist()] == [brute_counts(t) for t in texts]
        assert np.isfinite(features).all()


def test_path_lengths_match_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(64, 2)).round(1)
    nodes = rule_forest.grow(x, np.random.default_rng(5))

    def walk(row, at=0):
        feature, split, left, path = nodes[at]
        return path if feature < 0 else walk(row, left + (row[feature] > split))
    feature, split, left, path = map(np.array, zip(*nodes))
    forest = rule_forest.Forest({"g": [(feature, split, left, path)]}, 64)
    assert np.allclose(forest.paths("g", x), [walk(r) for r in x])
    depth = [p for f, _, _, p in nodes if f < 0]
    assert max(depth) <= 6 + rule_forest.expected_path(64)
    assert rule_forest.expected_path(1) == 0 and rule_forest.expected_path(2) == 1
    assert math.isclose(rule_forest.expected_path(256), 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256, rel_tol=1e-9)


def test_cut_parts_the_labels():
    good, bad = np.array([50, 30, 2, 0]), np.array([0, 1, 9, 10])
    assert rule_forest.choose_cut(good, bad, 0) == (3, 0.5)
    assert rule_forest.choose_cut(good, bad, 2)[0] == 2
    assert rule_forest.choose_cut(good, bad * 0, 5) == (4, 0.0)
    # few good rows would go, but hardly a bad one
    assert rule_forest.choose_cut(np.array([500, 5]), np.array([3, 1]), 5) == (2, 0.0)


def test_judge_finds_junk(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(vocabulary, 60).tolist()
        if i % 10 == 0:
            words = [w + "###" if rng.random() < 0.5 else w for w in words]
        rows.append((i, ". ".join(" ".join(words[k:k + 10]) for k in range(0, 60, 10)), "en", "a"))
        if i % 2 == 0:
            labels += [(i, int(i % 10 != 0), 0)] * (2 if i == 4 else 1)
    rows += [(None, None, None, None), (None, rows[1][1], "en", "a"), (1, rows[1][1], "en", "a"), (9000, "", "en", "a"), (9001, "short text", "en", "a")]
    labels += [(3, None, 0), (None, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rule_forest.judge(_docs(spark, rows), table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (9000, 9001) or r.n_words == 0:
            assert r.base_failed and not r.kept
        else:
            assert r.kept == (r.doc_id is None or r.doc_id % 10 != 0), r
    again = rule_forest.judge(_docs(spark, rows).repartition(5), table).select("doc_id", "kept").collect()
    assert sorted(again, key=str) == sorted([(r.doc_id, r.kept) for r in got], key=str)
    # labels of one kind only drop nothing
    only = rule_forest.judge(_docs(spark, rows), table.where("quality = 1"))
    assert only.where("not base_failed and not kept").count() == 0


def test_judge_without_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rule_forest.judge(_docs(spark, []), labels).collect() == []


# --- Merkle manifest -------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """(top, path of every leaf as a list of (before, after))."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_members = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for i in range(len(run)):
                for leaf in members[at + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1:])))
            up.append(sha("".join(run)))
            up_members.append([x for m in members[at:at + 3] for x in m])
        nodes, members = up, up_members
    return nodes[0], paths


def brute_manifest(rows):
    """Rows as (doc_id, source, leaf, other) -> sorted result rows."""
    groups = {}
    for r in sorted(rows, key=lambda r: ((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), r[2])):
        groups.setdefault(r[1], []).append(r)
    trees = [(g, brute_tree([r[2] for r in g])) for g in groups.values()]
    root, upper = brute_tree([t[0] for _, t in trees])
    out = []
    for (members, (top, paths)), above in zip(trees, upper):
        for r, path in zip(members, paths):
            way = path + above
            digest = r[2] if r[3] is None else r[3]
            for before, after in way:
                digest = sha(before + digest + after)
            out.append((r[0], r[2], top, root, sha("".join(a + b for a, b in way)), digest, digest == root))
    return sorted(out, key=str)


ROWS = ([(i, f"text {i}\nline" if i % 3 else f"text {i}", "en", "big") for i in range(100)]
        + [(200 + i, "same\ntext", None, "émoji" if i % 2 else "z") for i in range(7)]
        + [(300, "alone", "de", "single"), (None, "no id", "en", None), (None, None, None, None), (301, "", "en", "")]
        + [(400, "twin", "en", "twins")] * 4 + [(400, "other", "en", "twins"), (401, "漢字\n\n", "en", "twins")])
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def expected_rows():
    rows = []
    for doc_id, text, lang, source in ROWS:
        values = [doc_id, source, lang, len(text or ""), text]
        tampered = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            tampered = brute_leaf(values[:4] + [None if text is None else text.replace("\n", "")])
        rows.append((doc_id, source, brute_leaf(values), tampered))
    return rows


@pytest.fixture(scope="module")
def manifest_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("merkle"))
    _docs(spark, ROWS).write.parquet(path + "/documents.parquet")
    return path


def test_manifest_matches_brute_force(spark, manifest_dir):
    got = sorted([tuple(r) for r in merkle.op12(spark, manifest_dir).select(*NAMES).collect()], key=str)
    assert got == brute_manifest(expected_rows())


@pytest.mark.parametrize("tier,part", [(1, 5), (2, 7), (3, 1)])
def test_small_tiers_and_partitions(spark, manifest_dir, tier, part):
    docs = spark.read.parquet(manifest_dir + "/documents.parquet")
    manifest = merkle.build(docs, tier=tier)
    got = merkle.multiproofs(manifest, manifest.leaves, part=part).select(*NAMES).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_manifest([(*r[:3], None) for r in expected_rows()])
    assert all(r.verified for r in got)


def test_proofs_of_some_leaves(spark, manifest_dir):
    manifest = merkle.build(spark.read.parquet(manifest_dir + "/documents.parquet"), tier=2)
    some = manifest.leaves.where("doc_id in (0, 41, 42, 99, 203, 300)")
    got = merkle.multiproofs(manifest, some, part=1000).select(*NAMES).collect()
    brute = [r for r in brute_manifest([(*r[:3], None) for r in expected_rows()]) if r[0] in (0, 41, 42, 99, 203, 300)]
    assert sorted([tuple(r) for r in got], key=str) == brute


def test_lacking_coordinates_are_minimal():
    # leaves 0, 1 and 8 of nine: leaf 2, 6, 7 and the middle node are missing
    levels = list(merkle.climb(np.zeros(3, np.int64), np.full(3, 9), np.array([0, 1, 8])))
    missing = [sorted(children[gaps].tolist()) for _, children, gaps in levels]
    assert missing == [[2, 6, 7], [1]]
    whole = list(merkle.climb(np.zeros(10, np.int64), np.full(10, 10), np.arange(10)))
    assert not any(gaps.any() for _, _, gaps in whole) and len(whole) == 3


def test_manifest_sql(manifest_dir, spark):
    # leaves of one id and group are equal here but for their text
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{manifest_dir}/documents.parquet/*.parquet')")
    got = con.execute(f"SELECT {', '.join(NAMES)} FROM ({merkle.OP12_SQL})").fetchall()
    assert sorted(got, key=str) == brute_manifest(expected_rows())


def test_empty_manifest(spark, tmp_path):
    _docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.op12(spark, str(tmp_path)).collect() == []


# --- whitening -------------------------------------------------------------

def brute_sums(x):
    rows = [[int(v) for v in r] for r in x]
    dims = len(rows[0])
    return [sum(r[j] for r in rows) for j in range(dims)], [[sum(r[j] * r[k] for r in rows) for k in range(dims)] for j in range(dims)]


@pytest.mark.parametrize("rows,reach", [(1, 5), (63, 100), (64, 1), (65, 1 << 20), (200, 1 << 40), (300, 1 << 62)])
def test_scatter_is_exact(rows, reach):
    x = np.random.default_rng(rows).integers(-reach, reach, size=(rows, 5))
    x[:, 3] = 7  # no bit planes at all
    sums, products = whitening.scatter(x)
    assert sums.tolist() == brute_sums(x)[0] and products.tolist() == brute_sums(x)[1]
    for value in (0, -1, 3 << 100, -(5 << 120)):
        assert sum(v << whitening.LIMB * i for i, v in enumerate(whitening._limbs(value))) == value


def vectors():
    rng = np.random.default_rng(2)
    own = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(own)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(200)] + [(7, rows[8][1], 1), (None, rows[9][1], 1)]
    bad = [(2000, None, 0), (2001, [1.0] * 19 + [None], 0), (2002, [1.0] * 19 + [math.nan], 0), (2003, [1.0] * 19 + [math.inf], 0)]
    other = [(3000, [1.0, 2.0], 0), (3001, [1.5, -2.0], 0), (3002, [4.0, 4.0], 0), (3003, [], 0), (3004, [1.0, 1.0, 1.0], 0)]
    return rows, bad, other


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_whitening_matches_brute_force(spark):
    rows, bad, other = vectors()
    got = whitening.whiten(spark.createDataFrame(rows + bad + other, SCHEMA).repartition(4)).collect()
    fitted = sorted({tuple(math.floor(64 * c) + 1000000 for c in v) for _, v, _ in rows})
    n = len(fitted)
    sums, products = brute_sums(fitted)
    v = np.array([[float(Fraction(n * products[j][k] - sums[j] * sums[k], n * n)) for k in range(20)] for j in range(20)])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    big = [r for r in got if r.n == n]
    assert len(big) == len(rows) * 16 and {r.component for r in big} == set(range(1, 17))
    by_row = {}
    for r in big:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(r.whitened)
    signs = {}
    for vec_id, vector, _ in rows:
        x = [math.floor(64 * c) + 1000000 for c in vector]
        offsets = [n * a - s for a, s in zip(x, sums)]
        own = by_row[vec_id, str(sum(o * o for o in offsets))]
        for c in range(16):
            want = np.array(offsets, float) / n @ axes[:, c] / math.sqrt(e[c])
            (have,) = own[c + 1]
            assert math.isclose(abs(have), abs(want), rel_tol=1e-7, abs_tol=1e-8)
            if abs(want) > 1e-3:
                signs.setdefault(c, set()).add(math.copysign(1, have * want))
    assert all(len(s) == 1 for s in signs.values())
    for r in big:
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9) and r.identity_error < 1e-9
    assert not {r.vec_id for r in got} & {2000, 2001, 2002, 2003}
    # the other lengths: two dimensions have two components, single vectors none
    small = [r for r in got if r.n == 3]
    assert sorted((r.vec_id, r.component) for r in small) == [(i, c) for i in (3000, 3001, 3002) for c in (1, 2)]
    assert len(got) == len(big) + len(small)


def test_whitening_edges(spark, tmp_path):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    flat = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], SCHEMA)
    got = whitening.whiten(flat).collect()  # the first dimension has no variance
    assert len(got) == 5 and {r.component for r in got} == {1} and all(math.isclose(r.explained, 1) for r in got)
    huge = spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [1e15, 1.0], 0), (3, [2e15, 2.0], 0)], SCHEMA)
    got = whitening.whiten(huge).collect()
    assert {r.vec_id for r in got} == {2, 3} and all(r.n == 2 for r in got)
    flat.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert dict(whitening.op13(spark, str(tmp_path)).dtypes)["deviation"] == "bigint"


# --- letters of the language model -----------------------------------------

def test_numerals_are_no_letters():
    from textdrift.llm.language_id import words_of
    assert words_of("\u00bd \u00b2 \u2167") == [] and words_of(None) == [] and words_of("Ab\u00b2c d\u00bd 1x") == ["ab", "c", "d", "x"]
