"""Language identification by word-first backoff.

A word that the training texts contain often enough is scored by its log
frequency in each language.  A word they do not is scored character by
character: each position takes the longest character n-gram ending there that
is known, falling back from 4 characters to 1, and the word counts with the
mean over its positions.  The document's language has the largest sum.

Training counts words and n-grams in Spark over the labelled rows.  Their
number is bounded by ``max_train`` (a classifier's bounded sample: rows whose
hashed id falls below the share that gives about that many), and so is the
model's size, which is broadcast.  Every text is scored whole.

Defined cases.  ``lang_pred`` is ``und`` with score 0 if the text is null or
has no letter, or if nothing could be learned.  Ties go to the language that
comes first by code point.  Null labels are not learned from; rows without an
id and repeated rows are scored one by one.  Further columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, documents, materialize, release_memory, sources_of

MAX_TRAIN = 4000
MIN_COUNT = 3
LONGEST = 4
UNKNOWN = "und"
#: Documents scored at once, in words.
STEP = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case.  The pattern also takes numerals such as
    fractions and raised digits for letters; these part words."""
    found = _LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def gram_keys(words: list[str], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character of every word (and its end mark) the 64-bit keys
    of the 1..longest characters that end there: (keys, valid, word number)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.zeros((longest, len(text)), np.uint64)
    run = np.zeros(len(text), np.uint64)
    power = np.uint64(1)
    for n in range(1, longest + 1):
        shifted = np.zeros_like(text)
        shifted[n - 1:] = text[:len(text) - n + 1]
        run = run + shifted * power
        power = power * _BASE
        keys[n - 1] = (run + np.uint64(n)) * _BASE
    valid = place[None, :] >= np.arange(longest)[:, None]
    last = place > 0  # the start mark alone says nothing
    return keys[:, last].view(np.int64), valid[:, last], owner[last]


@dataclass
class Model:
    languages: list[str]
    vocabulary: dict[str, int]
    word_scores: np.ndarray   # words x languages
    gram_keys: np.ndarray     # sorted
    gram_scores: np.ndarray   # n-grams x languages

    def unseen(self, words: list[str]) -> np.ndarray:
        """Backed-off scores of words outside the vocabulary."""
        keys, valid, owner = gram_keys(words)
        out = np.zeros((len(words), len(self.languages)))
        if not len(self.gram_keys):
            return out
        at = np.full(keys.shape[1], -1, np.int64)
        for n in range(LONGEST - 1, -1, -1):
            open_ = np.flatnonzero((at < 0) & valid[n])
            place = np.minimum(np.searchsorted(self.gram_keys, keys[n, open_]), len(self.gram_keys) - 1)
            hit = self.gram_keys[place] == keys[n, open_]
            at[open_[hit]] = place[hit]
        known = at >= 0
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner[known], self.gram_scores[at[known], k], len(words))
        return out / np.maximum(1, np.bincount(owner, minlength=len(words)))[:, None]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted languages and confidences, in steps of bounded size."""
        names, scores = [], []
        held, n = [], 0
        for text in texts:
            words = words_of(text)
            held.append(words)
            n += len(words)
            if n > STEP:
                self._score(held, names, scores)
                held, n = [], 0
        self._score(held, names, scores)
        release_memory()
        return names, np.array(scores, float)

    def _score(self, held: list[list[str]], names: list[str], scores: list[float]) -> None:
        new: dict[str, int] = {}
        size = len(self.vocabulary)
        get = self.vocabulary.get
        codes = []
        for words in held:
            codes.append(np.array([c if (c := get(w)) is not None else new.setdefault(w, size + len(new)) for w in words], np.int64))
        table = np.concatenate([self.word_scores, self.unseen(list(new))]) if new else self.word_scores
        for own in codes:
            if not len(own) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = table[own].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            # the posterior, with the evidence of n dependent words counted as sqrt(n)
            scores.append(float(1 / np.exp((total - total[best]) / len(own) ** 0.5).sum()))


def sample(labelled: DataFrame, doc_id: str, most: int) -> DataFrame:
    """About ``most`` rows chosen by their id's hash; all if there are fewer."""
    n = labelled.count()
    if n <= most:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def learn(docs: DataFrame, train: Column | None = None, max_train: int = MAX_TRAIN, min_count: int = MIN_COUNT,
          doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count words and n-grams per language over the labelled rows for which
    ``train`` holds."""
    rows = docs.where(train) if train is not None else docs
    rows = sample(sources_of(rows, doc_id, text, lang).where(F.col(lang).isNotNull()), doc_id, max_train)
    pairs = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang_, Counter()).update(words_of(value))
            for lang_, own in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(own), pa.string()), pa.array(list(own), pa.string()),
                                                  pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, number = np.unique(np.array(batch.column(0).to_pylist()), return_inverse=True)
            keys, valid, owner = gram_keys(batch.column(1).to_pylist())
            n = batch.column(2).to_numpy()
            for k, lang_ in enumerate(langs.tolist()):
                for size in range(LONGEST):
                    mine = valid[size] & (number[owner] == k)
                    key, at = np.unique(keys[size, mine], return_inverse=True)
                    total = np.bincount(at, n[owner[mine]], len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(key), pa.string()), pa.array([size + 1] * len(key), pa.int32()),
                                                      pa.array(key), pa.array(total)], names=["lang", "size", "key", "n"])

    words = materialize(pairs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    chars = materialize(words.mapInArrow(grams, "lang string, size int, key long, n long")
                        .groupBy("lang", "size", "key").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    gram_totals = {(r["lang"], r["size"]): r["n"] for r in chars.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals, key=lambda s: s.encode())
    place = {name: i for i, name in enumerate(languages)}
    often = words.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= min_count).select("word")
    word_rows = words.join(often, "word").toPandas()  # bounded by the training sample
    keys_often = chars.groupBy("size", "key").agg(F.sum("n").alias("all")).where(F.col("all") >= min_count).select("size", "key")
    gram_rows = chars.join(keys_often, ["size", "key"]).toPandas()
    vocabulary = {w: i for i, w in enumerate(sorted(set(word_rows["word"])))}
    word_counts = np.zeros((len(vocabulary), len(languages)))
    word_counts[[vocabulary[w] for w in word_rows["word"]], [place[x] for x in word_rows["lang"]]] = word_rows["n"]
    keys = np.unique(gram_rows["key"].to_numpy(np.int64))
    gram_counts = np.zeros((len(keys), len(languages)))
    gram_size = np.zeros(len(keys), np.int64)
    at = np.searchsorted(keys, gram_rows["key"].to_numpy(np.int64))
    gram_counts[at, [place[x] for x in gram_rows["lang"]]] = gram_rows["n"]
    gram_size[at] = gram_rows["size"]
    n_words = np.array([totals[x] for x in languages], float)
    n_grams = np.array([[gram_totals.get((x, s), 0) for x in languages] for s in range(LONGEST + 1)], float).reshape(LONGEST + 1, -1)
    return Model(languages, vocabulary, np.log((word_counts + 0.5) / (n_words + 0.5 * max(1, len(vocabulary)))),
                 keys, np.log((gram_counts + 0.5) / (n_grams[gram_size] + 0.5 * max(1, len(keys)))))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    rows = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, and a
    score of at least ``least`` (just above an even guess among four)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(texts):
        import pandas as pd
        names, scores = shared.value.score([None if x is None else x for x in texts])
        return pd.Series([n != UNKNOWN and s >= least for n, s in zip(names, scores)], dtype=bool)

    return docs.where(told(F.col(text).cast("string")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket("doc_id", 4) == 2
    model = learn(docs, F.coalesce(crc_bucket("doc_id", 4) != 2, F.lit(False)))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
