"""Quality rules judged by an isolation forest on their statistics.

Every text is reduced to rule statistics: counts that fixed rules use (words,
symbols, repeated lines, words in repeated windows) and shares derived from
them.  Fixed rules come first: a text of fewer than ``MIN_WORDS`` words, or
with more than ``MAX_REPEAT`` percent of its words in repeated windows, fails.
The others go through isolation forests (Liu, Ting and Zhou 2008), one for
each group of related statistics (``GROUPS``): a tree splits a small sample at
random places, and a document that random splits part from the sample after
few steps is anomalous.  Its score is ``2 ** (-mean path / expected path)``,
between 0 and 1.  One forest over all statistics would hide a document that is
odd in one of them only, as most splits fall on the others.  The groups' cuts
are calibrated one after the other from labelled rows: of all cuts that drop
at most ``MAX_LOSS`` of the rows labelled good, and hardly any others than
rows labelled bad (``PURITY``), the one that parts the labels best.  Shares of
a short text are drawn towards zero (``SHRINK``), as a single odd word or line
says little there.

Scale.  One pass over the texts, in bounded portions of an Arrow batch; only
the statistics (one narrow row a document) are written.  The forest is fitted
on a sample bounded by ``trees * psi`` rows, and has at most
``trees * (2 psi - 1)`` nodes a group, so it can be broadcast.  Calibration brings
two counts a score bin to the driver, over all labelled rows.

Defined cases.  A null or empty text, or one without words, has all counts
zero and fails the fixed rules.  Rows without an id and repeated rows are
judged one by one; a row without an id has no label.  A document labelled more
than once counts once a label row; null labels are not used.  Without labelled
rows of both kinds among those that pass the fixed rules, none of these is
dropped.  An empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, sources_of

MIN_WORDS = 20
MAX_REPEAT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
GROUPS = {
    "symbols": ["symbol_share"],
    "repetition": ["dup_line_share", "repeat_share"],
    "letters": ["word_length", "upper_share", "digit_share"],
    "wording": ["stop_share", "comma_share", "variety", "char_entropy"],
}
FEATURES = [f for group in GROUPS.values() for f in group]
SHRINK = 100
TREES = 100
#: Rows of a tree's sample: few, so that odd rows do not shield each other.
PSI = 64
MAX_LOSS = 0.005
PURITY = 0.8
BINS = 4096
#: Bytes of text that are looked at together.
PORTION = 4_000_000


def _repeats(word: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Marks the words in ``window``-word runs that their text holds twice or
    more.  Runs get exact numbers by doubling: equal pairs of equal halves."""
    rank, size = word.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)  # overlapping halves where the length is no power of two
        _, rank = np.unique(rank[:-step] * (rank.max() + 1) + rank[step:], return_inverse=True)
        size += step
    inside = np.flatnonzero(owner[:len(rank)] == owner[window - 1:])
    covered = np.zeros(len(word) + 1, np.int64)
    if len(inside):
        _, at, count = np.unique(owner[inside] * (rank.max() + 1) + rank[inside], return_inverse=True, return_counts=True)
        hit = inside[count[at] > 1]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return np.cumsum(covered[:-1]) > 0


def _portion(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of some texts, one row each."""
    n = len(texts)
    bytes_of = np.zeros((n, 256), np.int64)
    lines, dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    words: list[bytes] = []
    sizes = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        bytes_of[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        own = raw.split()  # at runs of ASCII white space
        sizes[i] = len(own)
        words += own
        full = [x for x in raw.split(b"\n") if x.strip()]
        lines[i], dup_lines[i] = len(full), len(full) - len(set(full))
    repeat, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if words:
        owner = np.repeat(np.arange(n), sizes)
        code = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
        distinct = np.bincount(np.unique(owner * (int(code.max()) + 1) + code) // (int(code.max()) + 1), minlength=n)
        if len(words) >= WINDOW:
            repeat = np.bincount(owner, weights=_repeats(code, owner, WINDOW), minlength=n).astype(np.int64)
    point = bytes_of.copy()
    point[:, 0x80:0xC0] = 0  # bytes that continue a code point
    point[:, list(SPACES)] = 0
    chars = point.sum(axis=1)
    symbols = point[:, list(SYMBOLS)].sum(axis=1)
    upper = point[:, 65:91].sum(axis=1)
    letters = upper + point[:, 97:123].sum(axis=1) + point[:, 0xC0:].sum(axis=1)
    per_char, per_word = np.maximum(chars, 1), np.maximum(sizes, 1)
    share = point / per_char[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1.0))).sum(axis=1)
    counts = np.stack([sizes, chars, symbols, dup_lines, repeat], axis=1)
    features = {
        "symbol_share": symbols / (chars + SHRINK),
        "dup_line_share": dup_lines / np.maximum(lines, 1) * sizes / (sizes + SHRINK),
        "repeat_share": repeat / (sizes + SHRINK),
        "word_length": chars / per_word,
        "upper_share": upper / np.maximum(letters, 1),
        "digit_share": point[:, 48:58].sum(axis=1) / (chars + SHRINK),
        "stop_share": point[:, list(b".!?")].sum(axis=1) / per_word,
        "comma_share": point[:, list(b",;:")].sum(axis=1) / per_word,
        "variety": np.log(np.maximum(distinct, 1)) / np.log(np.maximum(sizes, 2)),
        "char_entropy": entropy,
    }
    return counts, np.stack([features[f] for f in FEATURES], axis=1)


def text_statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the whole texts, in portions of bounded size."""
    counts, features = [], []
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= PORTION or i + 1 == len(texts):
            c, f = _portion(texts[start:i + 1])
            counts.append(c)
            features.append(f)
            start, size = i + 1, 0
    if not counts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate(counts), np.concatenate(features)


def rule_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, the features and ``base_failed`` of every row."""
    rows = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = text_statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in counts.T], *[pa.array(f) for f in features.T]],
                names=["doc_id", *COUNTS, *FEATURES])

    schema = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"{c} long" for c in COUNTS],
                        *[f"{f} double" for f in FEATURES]])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random tree of n points."""
    if n <= 2:
        return max(0.0, n - 1.0)
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, float]]:
    """A random tree over the rows of ``x``: nodes ``(feature, split, left
    child, path)``; the right child follows the left one, a leaf has feature
    -1 and the path length expected at it."""
    depth_limit = max(1, math.ceil(math.log2(max(2, len(x)))))
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        me, own, depth = todo.pop()
        low, high = x[own].min(axis=0), x[own].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or not len(usable):
            nodes[me] = (-1, 0.0, -1, depth + expected_path(len(own)))
            continue
        f = int(rng.choice(usable))
        split = rng.uniform(low[f], high[f])
        below = x[own, f] <= split
        nodes[me] = (f, split, len(nodes), 0.0)
        todo += [(len(nodes), own[below], depth + 1), (len(nodes) + 1, own[~below], depth + 1)]
        nodes += [None, None]
    return nodes


Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Forest:
    """Trees of each group as arrays; ``psi`` is the sample size of a tree."""

    trees: dict[str, list[Tree]]
    psi: int

    def paths(self, group: str, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row of ``x``, which has the group's features."""
        total = np.zeros(len(x))
        for feature, split, left, path in self.trees[group]:
            at = np.zeros(len(x), np.int64)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                here = at[live]
                at[live] = left[here] + (x[live, feature[here]] > split[here])
                live = live[feature[at[live]] >= 0]
            total += path[at]
        return total / max(1, len(self.trees[group]))

    def scores(self, group: str, x: np.ndarray) -> np.ndarray:
        usual = expected_path(self.psi)
        if not self.trees[group] or usual <= 0:
            return np.full(len(x), 0.5)
        return 2.0 ** (-self.paths(group, x) / usual)


def fit_forest(stats: DataFrame, trees: int = TREES, psi: int = PSI, seed: int = 11) -> Forest:
    """A forest for each group over rows with ``doc_id`` and the features.

    The ``trees * psi`` rows with the smallest hashes are dealt out; a smaller
    table gives each row to several different trees.  A tree is grown in the
    task that holds its sample.
    """
    order = F.xxhash64(F.lit(seed), "doc_id", *FEATURES)
    sample = materialize(stats.select(order.alias("place"), *FEATURES).orderBy("place", *FEATURES).limit(trees * psi))
    size = sample.count()  # at most trees * psi rows
    if not size:
        return Forest({g: [] for g in GROUPS}, psi)
    psi = min(psi, size)
    share = min(trees, -(-trees * psi // size))
    ranked = sample.withColumn("number", F.row_number().over(Window.orderBy("place", *FEATURES)) - 1)
    dealt = (ranked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
             .withColumn("tree", ((F.col("number") * share + F.col("tree")) % trees).cast("int")).drop("place"))
    out = pa.schema([("tree", pa.int32()), ("group", pa.string()), ("feature", pa.list_(pa.int32())),
                     ("split", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("path", pa.list_(pa.float64()))])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows, tree = rows.sort_by("number"), key[0].as_py()
        grown = []
        for i, (group, names) in enumerate(GROUPS.items()):
            x = np.stack([rows.column(f).to_numpy() for f in names], axis=1)
            nodes = grow(x, np.random.default_rng([seed, tree, i]))
            grown.append((tree, group, *[list(v) for v in zip(*nodes)]))
        return pa.table(list(map(list, zip(*grown))), names=out.names).cast(out)

    rows = dealt.groupBy("tree").applyInArrow(build, "tree int, group string, feature array<int>, split array<double>, "
                                                     "left array<int>, path array<double>").collect()  # bounded, as above
    return Forest({g: [(np.array(r["feature"], np.int32), np.array(r["split"], float), np.array(r["left"], np.int64),
                        np.array(r["path"], float)) for r in sorted(rows, key=lambda r: r["tree"]) if r["group"] == g]
                   for g in GROUPS}, psi)


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` plus ``score_<group>`` for each group's forest."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # a bounded number of nodes
    names = stats.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for group, features in GROUPS.items():
                x = np.stack([batch.column(f).to_numpy() for f in features], axis=1)
                scores.append(pa.array(shared.value.scores(group, x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], names=[*names, *[f"score_{g}" for g in GROUPS]])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in stats.schema], *[f"score_{g} double" for g in GROUPS]])
    return stats.mapInArrow(run, schema)


def _bin(group: str) -> Column:
    return F.least(F.floor(F.col(f"score_{group}") * BINS), F.lit(BINS - 1))


def choose_cut(good: np.ndarray, bad: np.ndarray, allowed: float) -> tuple[int, float]:
    """(least score bin that is dropped, what it gains).  ``good`` and ``bad``
    count labelled rows by score bin; at most ``allowed`` good rows go.  Bin
    ``len(good)`` drops nothing."""
    lost = np.append(np.cumsum(good[::-1])[::-1], 0)  # dropping bins from b on
    caught = np.append(np.cumsum(bad[::-1])[::-1], 0)
    fit = (lost <= allowed) & (caught >= PURITY * (caught + lost + 1))
    gain = np.where(fit, caught / max(1, bad.sum()) - lost / max(1, good.sum()), 0.0)
    best = len(good) - int(gain[::-1].argmax())  # of equal cuts the highest
    return (best, float(gain[best])) if gain[best] > 0 else (len(good), 0.0)


def calibrate(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, doc_id: str = "doc_id",
              label: str = "quality") -> dict[str, int]:
    """The least score bin that each group drops, from all labelled rows of
    ``scored`` (``doc_id`` and the scores).  The group that gains most comes
    first; the next ones look at what it leaves and at the loss still allowed."""
    marks = (sources_of(labels, doc_id, label).where(F.col(label).isNotNull())
             .select(F.col(doc_id).alias("label_id"), (F.col(label) > 0).alias("good")))
    rows = materialize(scored.join(marks, F.col("doc_id") == F.col("label_id"))
                       .select("good", *[_bin(g).alias(g) for g in GROUPS]))
    cuts: dict[str, int] = {}
    allowed = None
    while len(cuts) < len(GROUPS):
        open_groups = [g for g in GROUPS if g not in cuts]
        left = rows.where(" and ".join([f"{g} < {b}" for g, b in cuts.items()]) or "true")
        found = (left.select("good", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(g).alias("b"))
                                                         for g in open_groups])).alias("x"))
                 .groupBy("good", "x.g", "x.b").count().collect())  # at most two counts a bin
        hist = {g: np.zeros((2, BINS)) for g in open_groups}
        for r in found:
            hist[r["g"]][int(r["good"]), r["b"]] += r["count"]
        if allowed is None:
            allowed = max_loss * hist[open_groups[0]][1].sum()
        choice = {g: choose_cut(h[1], h[0], allowed) for g, h in hist.items()}
        best = max(open_groups, key=lambda g: choice[g][1])
        if choice[best][1] <= 0:
            return cuts | {g: BINS for g in open_groups}
        cuts[best] = choice[best][0]
        allowed -= hist[best][1][cuts[best]:].sum()
    return cuts


def judge(docs: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, trees: int = TREES, psi: int = PSI,
          doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None) -> DataFrame:
    """``doc_id``, counts, features, ``base_failed``, the scores and ``kept``
    of every row.  ``learn``, over the labels' columns, picks the rows that the
    cuts are calibrated from."""
    stats = materialize(rule_statistics(docs, doc_id, text))
    forest = fit_forest(stats.where(~F.col("base_failed")), trees, psi)
    scored = materialize(with_scores(stats, forest))
    cuts = calibrate(scored.where(~F.col("base_failed")), labels if learn is None else labels.where(learn), max_loss, doc_id, label)
    kept = ~F.col("base_failed")
    for group, cut in cuts.items():
        kept &= F.lit(cut == BINS) | (_bin(group) < cut)
    return scored.withColumn("kept", kept)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return judge(documents(spark, sf_dir), labels).select("doc_id", *COUNTS, "base_failed", "kept", *[f"score_{g}" for g in GROUPS])
