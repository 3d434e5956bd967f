"""Substring deduplication by seed and extend.

Every window of 20 consecutive words that also starts earlier (in order of
document id and position) is a repeat; the words that repeats cover are
removed.

Seeds.  A window holds 16 hashes of 5 words; its anchor is the (rightmost)
smallest of them, so equal windows have equal anchors at the same place.  An
anchor occurrence owns the run of windows that chose it, and that run is the
occurrence extended both ways as far as its windows reach.

Join.  Occurrences meet by anchor, as a sorted stream.  Those whose extension
is equal word for word form a class: all but the earliest are repeats over
their full extension.  If an anchor has several classes, their earliest
members, the ends of longer matches or chance meetings, are extended window
by window in a second round and joined on (anchor, window).  Each occurrence
is compared with its class, never with every other, so the work is linear in
the occurrences however often a passage is repeated.  Repeats inside one
batch of documents are settled there, before the shuffle: of a passage that
a third of all documents share, a batch sends one occurrence.

Anchors and extensions are compared by independent 64-bit hashes together
(128 bits).  Covered windows of a document are then merged into maximal
repeats.

Defined cases.  A null text has no words; a document of fewer than 20 words
has no window.  A null id is smaller than every other.  Rows without an id and
rows that share one are documents of their own, in the order of a row key that
is written once.  Further columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Hasher, documents, materialize, sources_of, text_or_empty, with_row_key

WINDOW = 20
SEED = 5

_BASE = 0x9E3779B97F4A7C15  # any odd number
_BACK = pow(_BASE, -1, 1 << 64)
_SCHEMA = "anchor long, extent long, doc long, start int, count int"
_NAMES = ["anchor", "extent", "doc", "start", "count"]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of one text with hashes of any run of them in O(1)."""

    def __init__(self, text: str, hasher: Hasher) -> None:
        self.words = text.encode().split()
        n = len(self.words)
        hashes = np.array([hasher[w] for w in self.words], np.uint64)
        self.back = _powers(_BACK, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_BASE, n + 1)[:-1], out=self.total[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.back[start])

    def anchors(self, window: int, seed: int) -> tuple[np.ndarray, ...] | None:
        """(anchor, extent, first window, number of windows) of each anchor."""
        n = len(self.words)
        if n < window:
            return None
        at = np.arange(n - seed + 1)
        seeds = self.runs(at, at + seed)
        width = window - seed + 1
        view = sliding_window_view(seeds, width)
        place = np.arange(len(view)) + width - 1 - view[:, ::-1].argmin(axis=1)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(np.append(first, len(place)))
        chosen = place[first]
        # what is owned, and where the anchor lies in it
        extent = self.runs(first, first + count - 1 + window) ^ _mixed((chosen - first).astype(np.uint64) + np.uint64(1))
        return seeds[chosen].view(np.int64), extent.view(np.int64), first, count


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([p[i] for p in parts]).astype(k)) for i, k in enumerate(kinds)], names=_NAMES)


def _settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Of equal occurrences in a batch of documents the earliest goes on; the
    others are repeats already and go on as runs of windows (extent null),
    dealt out by document."""
    if not parts:
        return
    anchor, extent, doc, start, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((start, doc, extent, anchor))
    a, e, d, s = anchor[order], extent[order], doc[order], start[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (e[1:] != e[:-1])
    leader = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = (d != d[leader]) | (s != s[leader])  # rows at one place are no repeats of each other
    go = order[~later]
    yield _batch([(anchor[go], extent[go], doc[go], start[go], count[go])])
    done = np.sort(order[later])  # by document and position, as they came
    if len(done):
        d, s, c = doc[done], start[done], count[done]
        new = np.ones(len(done), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + c[:-1])
        at = np.flatnonzero(new)
        d, s, c = d[at], s[at], np.add.reduceat(c, at)
        key = _mixed(d.astype(np.int64).view(np.uint64)).view(np.int64)
        batch = _batch([(key, key, d, s, c)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.nulls(len(d), pa.int64()), *batch.columns[2:]], names=_NAMES)


def occurrences(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Anchor occurrences of ``(doc, text)`` rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Words(text, hasher).anchors(window, seed)
                if found is not None:
                    anchor, extent, first, count = found
                    parts.append((anchor, extent, np.full(len(first), doc, np.int64), first, count))
            yield from _settle(parts)

    return docs.mapInArrow(run, _SCHEMA)


def repeats(found: DataFrame, last: bool) -> DataFrame:
    """Meet the occurrences by anchor: ``doc, start, count, anchor, open``.

    Rows with ``open`` false are runs of windows that start earlier elsewhere;
    rows with ``open`` true are the earliest of their class, where the anchor
    has other classes too (left out in the ``last`` round).
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, ...] | None = None  # the last class's earliest row, and whether it has been given out
        given = False
        for batch in batches:
            if not batch.num_rows:
                continue
            ready = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            cols = [batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(5)]
            outs = [(cols[2][ready], cols[3][ready], cols[4][ready], cols[0][ready], np.zeros(int(ready.sum()), bool))]
            a, e, d, s, c = (x[~ready] for x in cols)
            if len(a):
                prev = before or (a[0] ^ 1, 0, 0, 0, 0)
                head = np.ones(len(a), bool)
                head[1:] = (a[1:] != a[:-1]) | (e[1:] != e[:-1])
                head[0] = a[0] != prev[0] or e[0] != prev[1]
                at = np.maximum.accumulate(np.where(head, np.arange(len(a)), -1))
                later = np.where(at >= 0, (d != d[at]) | (s != s[at]), (d != prev[2]) | (s != prev[3]))
                outs.append((d[later], s[later], c[later], a[later], np.zeros(int(later.sum()), bool)))
                heads = np.flatnonzero(head)
                if len(heads):
                    rows = [np.concatenate([np.array([p], x.dtype), x[heads]]) if before else x[heads]
                            for p, x in zip(prev, (a, e, d, s, c))]
                    many = np.zeros(len(rows[0]), bool)
                    many[1:] |= rows[0][1:] == rows[0][:-1]
                    many[:-1] |= rows[0][1:] == rows[0][:-1]
                    last_given = bool(many[-1])
                    if before and given:
                        many[0] = False
                    if not last:
                        outs.append((rows[2][many], rows[3][many], rows[4][many], rows[0][many], np.ones(int(many.sum()), bool)))
                    before, given = tuple(x[-1] for x in rows), last_given
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[i] for o in outs]).astype(k)) for i, k in
                 enumerate((np.int64, np.int32, np.int32, np.int64, bool))],
                names=["doc", "start", "count", "anchor", "open"])

    return (found.repartition("anchor").sortWithinPartitions("anchor", "extent", "doc", "start")
            .mapInArrow(run, "doc long, start int, count int, anchor long, open boolean"))


def windows(docs: DataFrame, opened: DataFrame, window: int = WINDOW) -> DataFrame:
    """The second round's occurrences: every window of the open rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts = []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                own = batch.column(2)[i].values
                words = Words(text, hasher)
                anchor, start, count = (own.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                order = np.argsort(start, kind="stable")
                each = np.repeat(start[order], count[order]) + (
                    np.arange(count.sum()) - np.repeat(np.cumsum(count[order]) - count[order], count[order]))
                parts.append((np.repeat(anchor[order], count[order]), words.runs(each, each + window).view(np.int64),
                              np.full(len(each), doc, np.int64), each, np.ones(len(each), np.int64)))
            yield from _settle(parts)

    lists = opened.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("own"))
    return docs.join(lists, "doc").select("doc", "text", "own").mapInArrow(run, _SCHEMA)


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, doc_id, text``: ``doc`` numbers the rows in order of id, null
    first.  It is the id itself where every row has one of its own."""
    rows = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    number = F.col("doc_id").cast("long")
    ids = rows.groupBy(number.alias("id")).agg(F.count("*").alias("n"))
    if ids.where("id is null or n > 1").isEmpty():
        return rows.select(number.alias("doc"), "doc_id", "text")
    keyed = with_row_key(rows)
    order = [number.asc_nulls_first(), F.col("row_key").asc()]
    numbers = materialize(keyed.select("doc_id", "row_key").repartitionByRange(*order).sortWithinPartitions(*order)
                          .select("row_key", F.monotonically_increasing_id().alias("doc")))
    return materialize(keyed.join(numbers, "row_key").select("doc", "doc_id", "text"))


def find_repeats(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Maximal repeats of ``doc, text`` rows: ``doc, spans``, one row per
    document that has any.  ``spans`` is a sorted array of (start, end) word
    positions, end exclusive."""
    rows = rows.select("doc", "text")
    first = materialize(repeats(occurrences(rows, window, seed), last=False))
    second = repeats(windows(rows, first.where("open"), window), last=True)
    covered = first.where("not open").select("doc", "start", "count").unionByName(second.select("doc", "start", "count"))
    ordered = covered.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start"), (F.col("start") + F.col("count") - 1 + window).alias("end")))).alias("runs"))

    def merge(done, run):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (last["end"] >= run["start"]),
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1),
                               F.array(F.struct(last["start"].alias("start"),
                                                F.greatest(last["end"], run["end"]).alias("end"))))
                      ).otherwise(F.concat(done, F.array(run)))

    return ordered.select("doc", F.aggregate("runs", F.array().cast("array<struct<start:int,end:int>>"), merge).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   seed: int = SEED, digest_only: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` and, unless
    ``digest_only``, ``kept_text``: what is left, joined by single spaces."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = value.encode().split()
                keep, at = [], 0
                for span in spans or ():
                    keep += words[at:span["start"]]
                    at = span["end"]
                keep += words[at:]
                kept = b" ".join(keep)
                for column, x in zip(out, (len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode())):
                    column.append(x)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                      batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays + ([] if digest_only else [pa.array(out[3], pa.string())]), names=names)

    rows = placed(docs, doc_id, text)
    spans = find_repeats(rows, window, seed).withColumnRenamed("doc", "span_doc")
    joined = rows.join(spans, F.col("doc") == F.col("span_doc"), "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"] + ([] if digest_only else ["kept_text"])
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, "
              "spans array<struct<start:int,end:int>>" + ("" if digest_only else ", kept_text string"))
    return joined.mapInArrow(run, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (remove_repeats(documents(spark, sf_dir), digest_only=True)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t FROM x
), f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM g WHERE i <= n - 19
), r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE k > 1
), k AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS t
  FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.i = x.i) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
