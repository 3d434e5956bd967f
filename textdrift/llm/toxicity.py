"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Kernel.  Two words are compared by their common subsequences of four letters
within seven places (every other letter of one), weighted by ``decay`` for
every place they skip (the tightest of several ways counts), so letters that
are skipped or inserted cost little (the gap-weighted subsequence kernel of
Lodhi et al., limited to a span).  Its power ``degree`` sharpens the match;
the kernel of two sentences is the sum over all pairs of different words.

Words.  Characters that are no letters are dropped, so marks between letters
open no gap.  Short words that follow each other are one word (``b l o c k``,
``bl oc k``), which holds all their subsequences.  Gaps wider than the span are
closed by further words beside those of the text (``_unfolded``): a word whose
every other letter is one and the same, without these; a word with letters
three times or more in a row, with each once.  Words over ``LONGEST`` letters
are compared in overlapping pieces, which bounds a word's subsequences.

Nystroem.  A sentence is mapped to its kernel values with landmark words, made
orthonormal by the inverse square root of the landmarks' own kernel matrix.
Landmarks are chosen from the training texts: the words and word beginnings
that tell the labels apart best, each unlike those before it, and common words
as background.

Training.  Labels are per document; a document stands for its most suspicious
sentence (its witness), first by the landmarks alone, then by the fitted
machine (multiple-instance SVM).  The training rows are a bounded sample
(``max_train``); what reaches the driver is one vector per sampled row.  A
logistic curve turns the document's largest sentence value into a score.

Since the machine is linear in the mapped sentence and the sentence in its
words, a word's contribution is one number; scoring adds these up.

Defined cases.  A null or empty text has no sentence and gets the score of a
sentence without words.  Without labels of both kinds the score is the share
of label 1 (0 without labels).  Null labels are not learned from.  Rows
without an id and repeated rows are scored one by one; a document with several
labels is learned from once for each.  Further columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, documents, materialize, sources_of
from .language_id import sample

MAX_TRAIN = 12_000
LANDMARKS = 96
CANDIDATES = 3000
#: Lengths of word beginnings that may be landmarks.
STEMS = (4, 5, 6, 7)
#: Least logarithmic odds of a telling landmark, at the lower bound.
LEAST_ODDS = 2.0
LETTERS = 4
SPAN = 2 * LETTERS - 1
DECAY = 0.7
#: Words of at most so many letters are joined with their neighbours.
SHORT = 4
#: Longer words are compared in pieces of this length, each half over the next.
LONGEST = 64
#: Words whose worth a worker remembers.
REMEMBERED = 200_000
DEGREE = 4
THRESHOLD = 0.3
STEP = 300_000

_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
_NO_LETTER = re.compile(r"[^\w\s]+|[\d_]+")
#: A short word and the space behind it, before another short word.
_SHORT = re.compile(rf"(?<!\S)(\S{{1,{SHORT}}})[^\S\n]+(?=\S{{1,{SHORT}}}(?!\S))")
_THRICE = re.compile(r"(.)\1\1+")
#: A word that ``_unfolded`` or ``_pieces`` may change.
_UNUSUAL = re.compile(rf"(?<!\S)(?:(?=\S*?(\S)\1\1)|(?=\S?(\S)(?:\S\2){{2,}}\S?(?!\S))|(?=\S{{{LONGEST + 1}}}))\S+")
_SYMBOLS = 40  # 26 letters, the others by their number; 0 is none
#: Places of the second to last letter of a subsequence after its first.
_OFFSETS = list(itertools.combinations(range(1, SPAN), LETTERS - 1))


def _unfolded(word: str) -> list[str]:
    """A word, and beside it the word without letters put in between or repeated."""
    found = [word]
    if len(word) >= 2 * LETTERS - 1:
        if _THRICE.search(word):
            found.append(_THRICE.sub(r"\1", word))
        for letters, between in ((word[::2], word[1::2]), (word[1::2], word[::2])):
            if len(set(between)) == 1 < len(set(letters)):
                found.append(letters)
    return found


def _pieces(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[at:at + LONGEST] for at in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _letters(text: str | None) -> str:
    """Letters and spaces in lower case, a line for each sentence."""
    return _NO_LETTER.sub("", _SENTENCE.sub("\n", text.lower())) if text else ""


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence as they are written."""
    return [w for line in _letters(text).split("\n") if (w := line.split())]


def compared(text: str | None) -> list[list[str]]:
    """The different words of each sentence as the kernel compares them."""
    letters = _UNUSUAL.sub(lambda m: " ".join(p for w in _unfolded(m[0]) for p in _pieces(w)),
                           _SHORT.sub(r"\1", _letters(text)))
    return [list(dict.fromkeys(w)) for line in letters.split("\n") if (w := line.split())]


def _symbols(words: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int32)
    plain = (code >= 97) & (code <= 122)
    return np.where(plain, code - 96, 27 + code % (_SYMBOLS - 27))


def subsequences(words: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence code, weight) of all subsequences, or of those
    whose code is ``wanted``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    rows, codes, weights = [], [], []
    for n in np.unique(sizes[sizes >= LETTERS]).tolist():
        own = np.flatnonzero(sizes == n)
        c = _symbols([words[i] for i in own.tolist()]).reshape(len(own), n)
        for offsets in _OFFSETS:
            reach = offsets[-1]
            if reach >= n:
                continue
            code = c[:, :n - reach]
            for o in offsets:
                code = code * _SYMBOLS + c[:, o:n - reach + o]
            code = code.ravel()
            at = np.arange(code.size) if wanted is None else np.flatnonzero(wanted[code])
            rows.append(own[at // (n - reach)])
            codes.append(code[at])
            weights.append(np.full(len(at), DECAY ** (reach + 1 - LETTERS)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


class Landmarks:
    """Kernel values of words with fixed landmark words."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        row, code, weight = subsequences(words)
        self.codes, at = np.unique(code, return_inverse=True)
        self.features = np.zeros((len(self.codes), len(words)), np.float32)
        np.maximum.at(self.features, (at, row), weight)
        self.table: np.ndarray | None = None

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that match at all, their kernel values)."""
        if self.table is None:
            self.table = np.zeros(_SYMBOLS ** LETTERS, bool)
            self.table[self.codes] = True
        row, code, weight = subsequences(words, self.table)
        if not len(row):
            return np.empty(0, np.int64), np.empty((0, len(self.words)), np.float32)
        feature = np.searchsorted(self.codes, code)
        # of several ways to form one subsequence the tightest counts
        pair = row * len(self.codes) + feature
        order = np.lexsort((weight, pair))
        hit = order[np.append(np.diff(pair[order]) > 0, True)]
        owner, start = np.unique(row[hit], return_index=True)
        values = np.empty((len(owner), len(self.words)), np.float32)
        for s in range(0, len(owner), 20_000):  # bounds the expanded rows
            ends = start[s + 20_000] if s + 20_000 < len(owner) else len(hit)
            part = hit[start[s]:ends]
            values[s:s + 20_000] = np.add.reduceat(
                self.features[feature[part]] * weight[part, None].astype(np.float32), start[s:s + 20_000] - start[s])
        return owner, values

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}


def choose(candidates: list[str], most: int, alike: float = 0.5) -> list[str]:
    """The first ``most`` words that are unlike all chosen before."""
    marks = Landmarks(candidates)
    own = marks.features.T @ marks.features
    norm = np.sqrt(np.maximum(np.diag(own), 1e-12))
    near = own / norm[:, None] / norm[None, :]
    taken: list[int] = []
    for i in range(len(candidates)):
        if len(candidates[i]) >= LETTERS and all(near[i, j] < alike for j in taken):
            taken.append(i)
            if len(taken) == most:
                break
    return [candidates[i] for i in taken]


@dataclass
class Model:
    marks: Landmarks
    weights: np.ndarray      # of the landmarks' kernel values
    bias: float
    slope: float             # of the logistic curve
    shift: float
    worth: dict[str, float] = field(default_factory=dict, repr=False)  # of words met before

    def __getstate__(self) -> dict:
        return self.__dict__ | {"worth": {}}

    def values(self, texts: list[str | None], vector: bool = False) -> list:
        """For each text the largest value of its sentences; with ``vector``
        the kernel vector of that sentence."""
        step = self._witnesses if vector else self._tops
        out: list = []
        held: list[list[list[str]]] = []
        n = 0
        for text in texts:
            own = compared(text)
            held.append(own)
            n += sum(map(len, own))
            if n > STEP:
                out += step(held)
                held, n = [], 0
        return out + step(held)

    def _tops(self, held: list[list[list[str]]]) -> list[float]:
        """For each text the largest value of its sentences.  A word's worth is
        its kernel values times the weights; those of usual length are
        remembered."""
        if len(self.worth) > REMEMBERED:
            self.worth.clear()
        words = itertools.chain.from_iterable(itertools.chain.from_iterable(held))
        new = sorted(set(words).difference(self.worth))
        owner, kernel = self.marks.kernel(new)
        worth = np.zeros(len(new))
        worth[owner] = kernel ** DEGREE @ self.weights
        self.worth.update(zip(new, worth.tolist()))
        of = self.worth.__getitem__
        out = [max((sum(map(of, s)) for s in own), default=0.0) + self.bias for own in held]
        for w in new:
            if len(w) > 2 * SPAN:
                del self.worth[w]
        return out

    def _witnesses(self, held: list[list[list[str]]]) -> list[np.ndarray]:
        new: dict[str, int] = {}
        words, sizes, counts = [], [], []
        for own in held:
            counts.append(len(own))
            for sentence in own:
                sizes.append(len(sentence))
                words.extend([new.setdefault(w, len(new)) for w in sentence])
        m = len(self.weights)
        owner, kernel = self.marks.kernel(list(new))
        kernel = kernel ** DEGREE
        worth = np.zeros(len(new))
        worth[owner] = kernel @ self.weights
        word = np.array(words, np.int64)
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        value = np.bincount(sentence, worth[word], len(sizes)) + self.bias
        where = np.full(len(new), -1, np.int64)
        where[owner] = np.arange(len(owner))
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        out, at = [], 0
        for n in counts:
            if n:
                best = at + int(value[at:at + n].argmax())
                row = where[word[begin[best]:begin[best + 1]]]
                out.append(kernel[row[row >= 0]].sum(axis=0))
            else:
                out.append(np.zeros(m))
            at += n
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * np.array(self.values(texts), float) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 500) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM, both classes weighted alike, by accelerated
    gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    s = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    step = 1 / (2 * np.linalg.norm(x1 * np.sqrt(share)[:, None], 2) ** 2 + penalty)
    w = look = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(steps):
        gap = np.maximum(0.0, 1 - s * (x1 @ look))
        grad = -2 * x1.T @ (share * s * gap) + penalty * np.append(look[:-1], 0.0)
        new = look - step * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit_curve(value: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's logistic curve by Newton steps, with his smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([value, np.ones_like(value)], axis=1)
    w = np.array([1.0, 0.0])
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - target @ (x @ w) + 1e-6 * w @ w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - target) + 2e-6 * w
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_train: int = MAX_TRAIN,
          landmarks: int = LANDMARKS, rounds: int = 2, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """Fit on labelled rows for which ``train``, over the labels' columns, holds."""
    chosen = sources_of(labels if train is None else labels.where(train), doc_id, label).where(F.col(label).isNotNull())
    chosen = sample(chosen, doc_id, max_train).select(F.col(doc_id).alias("label_id"), (F.col(label) > 0).cast("int").alias("label"))
    rows = materialize(sources_of(docs, doc_id, text).join(chosen, F.col(doc_id) == F.col("label_id"))
                       .select(F.col(text).cast("string").alias("text"), "label"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for value, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for s in sentences(value) for w in s}
                for word in words | {w[:n] for w in words for n in STEMS if len(w) > n}:
                    found.setdefault(word, [0, 0])[mark] += 1
            n = list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([a for a, _ in n], pa.int64()),
                                              pa.array([b for _, b in n], pa.int64())], names=["word", "clean", "toxic"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:  # nothing to tell apart
        share = np.clip(n1 / max(1, n0 + n1), 1e-6, 1 - 1e-6)
        return Model(Landmarks([]), np.zeros(0), 0.0, 1e-6, float(np.log(share / (1 - share))))
    words = materialize(rows.mapInArrow(count, "word string, clean long, toxic long").groupBy("word")
                        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.length("word") >= LETTERS))
    odds = F.ln((F.col("toxic") / n1) / ((F.col("clean") + 0.5) / n0))
    sure = odds - 1.64 * F.sqrt(1 / F.col("toxic") + 1 / (F.col("clean") + 0.5))  # one-sided 95 % bound
    telling = words.where((F.col("toxic") >= 2) & (sure > LEAST_ODDS)).orderBy((F.col("toxic") * odds).desc(), "word").limit(CANDIDATES)
    common = words.orderBy((F.col("clean") + F.col("toxic")).desc(), "word").limit(landmarks)
    names = choose([r["word"] for r in telling.select("word").collect()], landmarks * 2 // 3)
    n_telling = len(names)
    names += [w for w in choose([r["word"] for r in common.select("word").collect()], landmarks - len(names)) if w not in names]
    marks = Landmarks(names)
    own = (marks.features.T @ marks.features).astype(float) ** DEGREE
    scale = 1 / np.diag(own)  # a landmark's value with itself is 1, however long it is
    value, vector = np.linalg.eigh(own * np.sqrt(scale[:, None] * scale[None, :]))
    kept = value > 1e-2 * value.max()  # directions that the landmarks span well
    root = vector[:, kept] / np.sqrt(value[kept])
    telling_weights = np.where(np.arange(len(names)) < n_telling, scale, 0.0)
    model = Model(marks, telling_weights, 0.0, 1.0, 0.0)

    def witnesses(current: Model) -> tuple[np.ndarray, np.ndarray]:
        shared = docs.sparkSession.sparkContext.broadcast(current)  # a bounded number of landmarks

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = shared.value.values(batch.column(0).to_pylist(), vector=True)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([v.tolist() for v in got], pa.list_(pa.float64()))],
                                                 names=["label", "x"])

        # one vector per sampled row
        got = rows.select("text", "label").mapInArrow(run, "label int, x array<double>").toArrow()
        return np.array(got.column("x").to_pylist()).reshape(got.num_rows, len(names)), got.column("label").to_numpy()

    for _ in range(rounds):
        x, y = witnesses(model)
        weights, bias = fit_svm(x * scale[None, :] @ root, y)
        model = Model(marks, (root @ weights) * scale, bias, 1.0, 0.0)
    x, y = witnesses(model)
    model.slope, model.shift = fit_curve(x @ model.weights + model.bias, y)
    return model


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of landmarks
    rows = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))],
                                             names=["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = learn(docs, labels, F.coalesce(crc_bucket("doc_id", 4) != 2, F.lit(False)))
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
