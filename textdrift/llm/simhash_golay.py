"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values
(seed 42) of its word shingles.  Fingerprints that differ in at most 4 bits
are linked; documents in one linked group share a component.

Candidate search.  A fingerprint is cut into three segments (22, 21 and 21
bits).  Each is read as a word of the perfect binary Golay code [23, 12, 7]
and hashed to the indices of the codewords to which it and its one-bit
neighbours decode, at most six.  Two segments that differ in at most two bits
have a common neighbour within one bit of both, so they share an index.  By
the pigeonhole principle 4 errors leave at most one segment with 3 or more,
so two fingerprints that should link share an index in at least two segments:
the pairs of indices are the join keys, 24 bits each.  All pairs of a key are
verified by their Hamming distance; nothing is missed.

Skew.  Equal fingerprints are one node, however many documents have them.  The
rows of a key are compared inside one task, as a sorted stream; a key with
more than ``block`` fingerprints leaves the stream as blocks of that size,
and the pairs of blocks are compared as rows of their own, spread over all
tasks.  Of a dense group only a spanning star leaves a task, not its pairs.

Defined cases.  A null or empty text has no words and fingerprint 0, and is
linked like any other.  With fewer words than a shingle the whole sequence is
the only shingle.  A null id is larger than every other; a component that has
only rows without an id has a null name.  Repeated rows share everything.
Further columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, find_components, materialize, release_memory, sorted_groups, sources_of, text_or_empty

SHINGLE = 4
MAX_BITS = 4
BLOCK = 2048
#: Texts held as Python strings at a time.
STEP = 500

SEED = 42
#: Generator polynomial of the Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0xAE3
#: (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in
                       zip(start[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t for at in range(0, batch.num_rows, STEP) for t in batch.column(1).slice(at, STEP).to_pylist())
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        release_memory()

    rows = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class Golay:
    """Nearest-codeword decoding of 23-bit words, vectorised."""

    def __init__(self) -> None:
        high = np.arange(1 << 12, dtype=np.int64) << 11
        self.rest = self._modulo(high)
        error = np.zeros(1 << 11, np.int64)
        one = [0] + [1 << i for i in range(23)]
        patterns = sorted({a | b | c for a in one for b in one for c in one}, key=lambda p: -p.bit_count())
        for p in patterns:  # all errors of weight 3 or less have different syndromes
            error[self.syndrome(np.array([p]))[0]] = p
        self.error = error

    @staticmethod
    def _modulo(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(22, 10, -1):
            word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
        return word

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.rest[word >> 11] ^ (word & 0x7FF)

    def index(self, word: np.ndarray) -> np.ndarray:
        """Index of the codeword nearest to each word."""
        return (word ^ self.error[self.syndrome(word)]) >> 11

    def indices(self, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices to which each word and its neighbours in the lowest
        ``width`` bits decode: a matrix, and which of its cells count."""
        ball = word[:, None] ^ np.array([0] + [1 << i for i in range(width)])
        found = np.sort(self.index(ball), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        most = int(first.sum(axis=1).max(initial=0))
        place = np.cumsum(first, axis=1) - 1
        out = np.full((len(word), most), -1, np.int64)
        rows = np.nonzero(first)[0]
        out[rows, place[first]] = found[first]
        return out, out >= 0


def keyed(nodes: DataFrame) -> DataFrame:
    """``key, fp``: the pairs of segment indices of every distinct fingerprint."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 20_000):
                fp = whole[at:at + 20_000]
                cut = [code.indices((fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1), width)
                       for low, width in SEGMENTS]
                for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                    (a, a_ok), (b, b_ok) = cut[i], cut[j]
                    ok = a_ok[:, :, None] & b_ok[:, None, :]
                    key = (pair << 24) | (a[:, :, None] << 12) | b[:, None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[ok]), pa.array(np.broadcast_to(fp[:, None, None], ok.shape)[ok])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _forest(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within or between two lists of
    fingerprints, one per fingerprint at most: each to the smallest place in
    the list that it can reach."""
    nodes = np.concatenate([left, right]) if right is not left else left
    u = nodes.view(np.uint64)
    label = np.arange(len(nodes))
    near = np.empty((len(nodes), len(nodes)), bool)
    for s in range(0, len(nodes), 256):
        near[s:s + 256] = np.bitwise_count(u[s:s + 256, None] ^ u[None, :]) <= bits
    while True:
        new = label.copy()
        for s in range(0, len(nodes), 256):
            new[s:s + 256] = np.where(near[s:s + 256], label[None, :], len(nodes)).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _pairs(key: np.ndarray, fp: np.ndarray, bits: int, small: int) -> tuple[list, list]:
    """Links inside every key of a chunk: of keys with up to ``small`` rows
    all, of larger ones a spanning forest."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [len(key)]]))
    group_size = np.repeat(size, size)
    outs_a, outs_b = [], []
    low = group_size <= small
    k, f = key[low], fp[low]
    for step in range(1, small):
        if len(k) <= step:
            break
        same = k[step:] == k[:-step]
        if not same.any():
            break
        a, b = f[step:][same], f[:-step][same]
        near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits
        outs_a.append(a[near])
        outs_b.append(b[near])
    for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
        part = fp[s:s + n]
        a, b = _forest(part, part, bits)
        outs_a.append(a)
        outs_b.append(b)
    return outs_a, outs_b


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints in one component, enough to
    connect every component.  ``nodes`` has one row ``fp`` per fingerprint."""
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        number, of = 0, None
        for key, fp in sorted_groups(batches, "key", "fp", block):
            full = len(key) == block and key[0] == key[-1]
            if full or (of is not None and key[0] == of):
                # a key beyond one block: its rows leave as a block
                mine = key == key[0]
                number = number + 1 if key[0] == of else 0
                of = int(key[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of]), pa.array([number], pa.int32()), pa.array([fp[mine]], pa.list_(pa.int64())),
                     pa.array([None], pa.int64()), pa.array([None], pa.int64())], names=names)
                key, fp = key[~mine], fp[~mine]
                if not len(key):
                    continue
            a, b = _pairs(key, fp, max_bits, 16)
            none = np.empty(0, np.int64)
            a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
            if not len(a):
                continue
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            n = pair.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())),
                 pa.array(pair[0]), pa.array(pair[1])], names=names)

    def between(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = np.array(left.values), np.array(right.values)
                a, b = _forest(x, x if np.array_equal(x, y) else y, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    names = ["key", "number", "fps", "a", "b"]
    found = materialize(keyed(nodes).repartition("key").sortWithinPartitions("key")
                        .mapInArrow(compare, "key long, number int, fps array<long>, a long, b long"))
    blocks = found.where("fps is not null").select("key", "number", "fps")
    other = blocks.select("key", F.col("number").alias("other"), F.col("fps").alias("other_fps"))
    crossed = (blocks.join(other, "key").where("number <= other").select("fps", "other_fps", "number", "other", "key")
               .repartition("key", "number", "other").select("fps", "other_fps")
               .mapInArrow(between, "a long, b long"))
    return found.where("a is not null").select("a", "b").unionByName(crossed)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id``; the component's name is its smallest id.

    ``max_bits`` may be 4 or less: the segments guarantee no more.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0..4")
    rows = materialize(fingerprints(docs, doc_id, text, shingle))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = find_components(links(nodes, max_bits, block))
    named = found.select(F.col("node").alias("fp"), "component")
    labelled = nodes.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = materialize(labelled.join(least, "component").select("fp", "component_id"))
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
