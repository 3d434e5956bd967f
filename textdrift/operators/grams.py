"""Distinct n-grams, token counts and bigram log-likelihoods of token arrays, in
compact form.

Tokens come from Spark as Arrow arrays, or as a text of tokens between ASCII white
space (``functions.text.spaced``), which is split here.  A step of texts becomes numbers: every
distinct token has a 128-bit digest, an n-gram is mixed from its tokens' digests
into 128 bits as well.  A step's distinct digests are dealt into cells, (shard,
group), of which one row each is shuffled; a cell's rows lie together in a
sorted partition and are counted one cell at a time.  A group of any size is
spread over all shards.  The shard stands for a digest's first bits; of the rest
80 are sent.  Equal ones stand for equal items: among ten thousand million
different n-grams of one group two meet with a chance below 1e-6 (87 bits), of
tokens below 1e-5 (85 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens taken at once; a longer text is a step of its own.
STEP = 2_000_000
#: A group's n-gram digests are dealt into 2 ** SHARD_BITS shards, those of its
#: tokens, of which there are far fewer, into 2 ** TOKEN_BITS.
SHARD_BITS, TOKEN_BITS = 7, 5
BLOCK = 1 << 14
TOKENS, GRAMS, SUMS = 0, 1, 2
#: What a cell holds of a digest, and with it of a token's count in the step.
_SENT = np.dtype([("first", "<u8"), ("second", "<u2")])
_SENT_COUNT = np.dtype([*_SENT.descr, ("count", "<u4")])

_MIX = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9), (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB))
_DIGEST = T.StructType([T.StructField("_kind", T.IntegerType()), T.StructField("_shard", T.IntegerType()),
                        T.StructField("_cell", T.BinaryType()), T.StructField("_nb", T.LongType()),
                        T.StructField("_num", T.DoubleType()), T.StructField("_den", T.DoubleType())])
_COUNTED = T.StructType([T.StructField("_total", T.LongType()), T.StructField("_vocabulary", T.LongType()),
                         T.StructField("_s", T.DoubleType()), T.StructField("_high", T.ArrayType(T.LongType())),
                         T.StructField("_grams", T.LongType()), T.StructField("_nb", T.LongType()),
                         T.StructField("_num", T.DoubleType()), T.StructField("_den", T.DoubleType())])


def _digested(tokens: Iterable[bytes]) -> np.ndarray:
    raw = b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in tokens])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def digests(tokens: Iterable[str]) -> np.ndarray:
    """128 bits of every token, as two columns."""
    return _digested(map(str.encode, tokens))


def mixed(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Digests of n-grams from their tokens' digests, in order."""
    n = len(parts[0])
    out = np.empty((2, n), np.uint64)  # half by half
    for start in range(0, n, BLOCK):  # a block stays in the cache
        end = min(n, start + BLOCK)
        for lane, (a, b) in enumerate(_MIX):
            h = np.full(end - start, len(parts), np.uint64)
            for p in parts:
                h *= np.uint64(a)
                h += p[start:end, lane]
                h ^= h >> np.uint64(32)
                h *= np.uint64(b)
                h ^= h >> np.uint64(29)
            out[lane, start:end] = h
    return out.T


def values(words: pa.Array) -> list[bytes]:
    """``to_pylist`` of texts in bytes; that takes a call per value."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1].tolist() if offsets else [0]
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


@dataclass
class BigramModel:
    """Counts of an add-k bigram model by digest, sorted: contexts, bigrams."""
    contexts: np.ndarray
    context_counts: np.ndarray
    bigrams: np.ndarray
    bigram_counts: np.ndarray
    vocabulary: int  # with the slot for unknown words
    k: float

    @classmethod
    def of(cls, contexts: tuple[list[str], list[int]], bigrams: tuple[list[str], list[int]], vocabulary: int, k: float) -> BigramModel:
        pairs = [b.split(" ") for b in bigrams[0]]
        sides = [digests([p[i] for p in pairs]) for i in (0, 1)]
        found = []
        for d, c in ((digests(contexts[0]), contexts[1]), (mixed(sides), bigrams[1])):
            order = np.lexsort((d[:, 1], d[:, 0]))
            found += [d[order], np.array(c, np.float64)[order]]
        return cls(*found, vocabulary, k)

    @staticmethod
    def _looked_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(wanted))
        if len(keys):
            first = np.ascontiguousarray(keys[:, 0])
            at = np.minimum(np.searchsorted(first, wanted[:, 0]), len(keys) - 1)
            hit = np.flatnonzero(first[at] == wanted[:, 0])
            hit = hit[keys[at[hit], 1] == wanted[hit, 1]]
            out[hit] = counts[at[hit]]
        return out

    def _log(self, x: np.ndarray) -> np.ndarray:
        return np.log(x, out=np.zeros(len(x)), where=x > 0)  # Spark's log of 0 is null, which a sum skips

    def seen_contexts(self, tokens: np.ndarray) -> np.ndarray:
        return self._looked_up(self.contexts, self.context_counts, tokens)

    def context_term(self, counts: np.ndarray) -> np.ndarray:
        return self._log(counts + self.k * self.vocabulary)

    def bigram_term(self, grams: np.ndarray, known: bool = True) -> np.ndarray:
        counts = self._looked_up(self.bigrams, self.bigram_counts, grams) if known else np.zeros(len(grams))
        return self._log(counts + self.k)


class Step:
    """The tokens of some texts as numbers."""

    def __init__(self, tokens: pa.Array) -> None:
        m = len(tokens)
        lists = tokens if pa.types.is_list(tokens.type) else pc.ascii_split_whitespace(tokens)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, self.text = lists.flatten(), np.repeat(np.arange(m), sizes)
        if lists is not tokens:
            real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
            flat, self.text = flat.filter(pa.array(real)), self.text[real]
        self.sizes = np.bincount(self.text, minlength=m)
        coded = flat.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.digest = _digested(values(coded.dictionary))
        self.each = np.take(np.ascontiguousarray(self.digest.T), self.code, axis=1)  # every token's digest
        self.left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.code))  # tokens to the end of the text

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of all n-grams and the text of each."""
        size, at = max(0, len(self.code) - n + 1), self.starts(n)
        return np.take(mixed([self.each[:, i:i + size].T for i in range(n)]).T, at, axis=1).T, self.text[at]

    def sums(self, model: BigramModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: bigrams, sum of log(c(v w) + k), sum of log(c(v) + k V)."""
        m, at = len(self.sizes), self.starts(2)
        text, code, seen = self.text[at], self.code[at], model.seen_contexts(self.digest)
        # only a bigram of a context that the model has can be in the model
        term = np.repeat(model.bigram_term(np.empty((1, 2), np.uint64), known=False), len(at))
        known = np.flatnonzero((seen > 0)[code])
        first = at[known]
        term[known] = model.bigram_term(mixed([self.each[:, first].T, self.each[:, first + 1].T]))
        # bincount of nothing gives whole numbers, whatever the weights
        return (np.bincount(text, minlength=m).astype(np.int64), np.bincount(text, term, m).astype(float),
                np.bincount(text, model.context_term(seen)[code], m).astype(float))


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about STEP tokens."""
    tokens = batch.column(batch.num_columns - 1)
    lists = pa.types.is_list(tokens.type)
    sizes = pc.fill_null(pc.list_value_length(tokens) if lists else pc.binary_length(tokens), 0).to_numpy(zero_copy_only=False)
    sizes = sizes if lists else sizes // 5  # as words go
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > STEP:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _grouped(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every distinct group, group of every row)."""
    code = np.zeros(rows, np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code, return_inverse=True)[1] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def _changes(digest: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:, 0] != digest[:-1, 0]) | (digest[1:, 1] != digest[:-1, 1])
    return new


def _sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by their leading bits, those bits): places stand in
    the trailing ones, as numbers are sorted far faster than places by number."""
    bits = np.uint64(max(1, (len(key) - 1).bit_length()))
    key = key >> bits << bits
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    return (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.intp), key >> bits


def _cells(digest: np.ndarray, group: np.ndarray, n_groups: int, shard_bits: int, counts: np.ndarray | None = None):
    """Distinct digests by cell: (shards, groups, records of all cells, the
    place where each cell starts).  Digests that stay double are told apart
    when the cells are counted."""
    bits = max(1, int((n_groups << shard_bits) - 1).bit_length())
    first, second = digest[:, 0], digest[:, 1]
    cell = (first >> np.uint64(64 - shard_bits)) * np.uint64(n_groups)
    cell += group.astype(np.uint64)
    order, _ = _sorted_places(cell << np.uint64(64 - bits) | (first << np.uint64(shard_bits)) >> np.uint64(bits))
    cell, first, second = cell[order].astype(np.int64), first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    first, second, cell = first[at], second[at], cell[at]
    records = np.empty(len(at), _SENT if counts is None else _SENT_COUNT)
    records["first"] = first << np.uint64(shard_bits) | second >> np.uint64(64 - shard_bits)  # the shard has the bits before
    records["second"] = second >> np.uint64(48 - shard_bits) & np.uint64(0xFFFF)
    if counts is not None and len(at):
        records["count"] = np.add.reduceat(counts[order], at)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[starts] // n_groups, cell[starts] % n_groups, records, starts


def _binary(records: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(records)).astype(np.int64) * records.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(records)]).cast(pa.binary())


def _distinct(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of the runs of equal digests)."""
    order, leading = _sorted_places(digest[:, 0])
    new = _changes(np.take(digest.T, order, axis=1).T)
    mixed_up = np.flatnonzero(new[1:] & (leading[1:] == leading[:-1]))
    if len(mixed_up):  # order the few runs of equal leading bits that hold different digests
        members = np.flatnonzero(np.isin(leading, leading[mixed_up]))
        inside = order[members]
        order[members] = inside[np.lexsort((digest[inside, 1], digest[inside, 0]))]
        new = _changes(np.take(digest.T, order, axis=1).T)
    return order, np.flatnonzero(new)


def _schema(df: DataFrame, g: Sequence[str], further: T.StructType) -> T.StructType:
    return T.StructType([df.schema[c] for c in g] + further.fields)


def group_counts(tokenized: DataFrame, group_cols: Sequence[str], tokens: str = "_tok", n: int | None = None,
                 vocabulary: bool = False, model: BigramModel | None = None, threshold: float = 0.01) -> DataFrame:
    """Per cell of a group, to be summed by group: ``_total`` tokens, ``_vocabulary``,
    ``_s`` = sum c log2 c, ``_high`` (the counts above ``threshold`` of the
    cell's tokens, which hold all above that share of the group's), ``_grams``
    distinct n-grams, and with a model the sums of :meth:`Step.sums`.  Every
    group has a row.  ``tokens`` is an array or a spaced text."""
    g = list(group_cols)
    k = len(g)
    rows = tokenized.select(*g, tokens)
    spark = tokenized.sparkSession
    shared = None if model is None else spark.sparkContext.broadcast(model)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _steps(batch):
                step = Step(piece.column(k))
                first, group = _grouped([piece.column(i) for i in range(k)], piece.num_rows)
                m = len(first)

                def out(kind, shards, groups, cells, sums=None):
                    size = len(groups)
                    at = pa.array(first[groups])
                    nb, num, den = sums if sums is not None else (np.zeros(size, np.int64), np.zeros(size), np.zeros(size))
                    return pa.RecordBatch.from_arrays(
                        [piece.column(i).take(at) for i in range(k)] +
                        [pa.array(np.full(size, kind, np.int32)), pa.array(shards.astype(np.int32)), cells,
                         pa.array(nb, pa.int64()), pa.array(num), pa.array(den)], names=[*g, *_DIGEST.names])

                sums = None
                if model is not None:
                    nb, num, den = step.sums(shared.value)
                    sums = (np.bincount(group, nb, m).astype(np.int64), np.bincount(group, num, m).astype(float), np.bincount(group, den, m).astype(float))
                yield out(SUMS, np.zeros(m, np.int64), np.arange(m), pa.array([b""] * m, pa.binary()), sums)
                if vocabulary:
                    size = len(step.digest)
                    pairs, counts = np.unique(group[step.text] * size + step.code, return_counts=True)
                    shards, groups, records, starts = _cells(step.digest[pairs % max(size, 1)], pairs // max(size, 1), m, TOKEN_BITS, counts)
                    yield out(TOKENS, shards, groups, _binary(records, starts))
                if n is not None:
                    grams, text = step.grams(n)
                    shards, groups, records, starts = _cells(grams, group[text], m, SHARD_BITS)
                    yield out(GRAMS, shards, groups, _binary(records, starts))

    def counted(kind: int, parts: list[bytes], nb: int, num: float, den: float) -> list:
        whole = b"".join(parts)
        if kind == SUMS:
            return [0, 0, 0.0, [], 0, nb, num, den]
        records = np.frombuffer(whole, _SENT_COUNT if kind == TOKENS else _SENT)
        digest = np.empty((2, len(records)), np.uint64)
        digest[0], digest[1] = records["first"], records["second"]
        order, starts = _distinct(digest.T)
        if kind == GRAMS:
            return [0, 0, 0.0, [], len(starts), 0, 0.0, 0.0]
        c = np.add.reduceat(records["count"][order].astype(np.int64), starts)
        total = int(c.sum())
        return [total, len(c), float((c * np.log2(c)).sum()), c[c / total > threshold].tolist(), 0, 0, 0.0, 0.0]

    result = _schema(tokenized, g, _COUNTED)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, parts, sums = None, None, [], [0, 0.0, 0.0]
        types = None
        done: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.concat_arrays([d[0][i] for d in done]) for i in range(k)]
            for j, kind in enumerate(types):
                columns.append(pa.array([d[1][j] for d in done], kind))
            return pa.RecordBatch.from_arrays(columns, names=result.names)

        for batch in batches:
            types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            names = [batch.column(i).to_pylist() for i in range(k + 2)]
            cells, nbs, nums, dens = (batch.column(k + 2 + i).to_pylist() for i in range(4))
            for i, own in enumerate(zip(*names)):
                if own != key:
                    if key is not None:
                        done.append([values, counted(key[k], parts, *sums)])
                        if len(done) >= 1000:
                            yield flush()
                            done = []
                    key, values, parts, sums = own, [batch.column(j).slice(i, 1) for j in range(k)], [], [0, 0.0, 0.0]
                parts.append(cells[i])
                sums = [sums[0] + nbs[i], sums[1] + nums[i], sums[2] + dens[i]]
        if key is not None:
            done.append([values, counted(key[k], parts, *sums)])
        if done:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = [*g, "_kind", "_shard"]
    return (rows.mapInArrow(count, _schema(tokenized, g, _DIGEST)).repartition(parts, *cell).sortWithinPartitions(*cell)
            .mapInArrow(merge, result))


def text_sums(tokenized: DataFrame, keys: Sequence[str], model: BigramModel, tokens: str = "_tok") -> DataFrame:
    """``keys, _nb, _num, _den`` of every text, by :meth:`Step.sums`."""
    keys = list(keys)
    k = len(keys)
    shared = tokenized.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _steps(batch):
                sums = Step(piece.column(k)).sums(shared.value)
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(k)), *map(pa.array, sums)],
                                                 names=[*keys, "_nb", "_num", "_den"])

    sums = T.StructType(_DIGEST.fields[3:])
    return tokenized.select(*keys, tokens).mapInArrow(run, _schema(tokenized, keys, sums))
