"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become token ids plus an end id; only documents longer than a
sequence are cut, into whole-length pieces.  Packing looks at the histogram of
piece lengths alone, at most ``capacity`` numbers however large the corpus:

1. patterns of few documents whose lengths fill a sequence exactly are
   enumerated (one whole-length piece; pairs; triples around the commonest
   lengths),
2. non-negative least squares fits how often to use each pattern so that the
   patterns together use up the histogram,
3. the repeat counts are rounded and cut to what is there, and
4. the residual is packed by best fit, longest first, on run-lengths of equal
   sequences: short pieces fill the gaps that remain.

The plan is a list of (length, from, to, first sequence, offset) intervals
over the pieces of each length.  Pieces are numbered within their length by
two levels of counting, (length, bucket) totals and a window inside a bucket,
so that a length that a third of all pieces share is spread over all tasks;
a binary search in the plan then gives each its sequence and offset.

Defined cases.  A null or empty text is the end id alone, a piece of length 1.
Repeated rows, rows without an id and ties are pieces like any others; pieces
of equal length are interchangeable.  Further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, release_memory, sources_of, text_or_empty

CAPACITY = 4096
END = 1
ROWS_PER_BUCKET = 50_000
#: For each length, triples are built around this many of the commonest lengths.
PARTNERS = 12

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


# ---------------------------------------------------------------- tokens

class Remembered(dict):
    """A dict that computes missing values and holds at most two generations
    of ``limit`` entries; entries in use survive."""

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Texts held as Python strings at a time.
STEP = 500


class WordEncoder:
    """Token ids of whole texts as little-endian bytes, word by word.

    The tokenizer splits at white space first, so a text's ids are its words'
    ids in turn; words and their pieces are remembered up to a bounded number,
    a piece of letters as the word it is.
    Texts with special tokens or with control characters that Python alone
    counts as white space are encoded whole.
    """

    LIMIT = 250_000
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.words = Remembered(self._word, self.LIMIT)
        self.pieces = Remembered(self._piece, self.LIMIT)

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= "\u0250":  # where lower-casing and normalisation may not be plain
            return self._ids(word)
        low = word.lower()
        if low == word and word.isalpha():
            return self._piece(word)
        if low.isalpha():
            return self._part(low)
        if low[:-1].isalpha():
            return self._part(low[:-1]) + self._part(low[-1])
        return b"".join([self._part(p) for p in _PIECE.findall(low)])

    def _part(self, piece: str) -> bytes:
        """A piece of a word; letters alone are a word too and held once."""
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0250") and piece.lower() == piece:
            return self.words[piece]
        return self.pieces[piece]

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.ODD):
            return self._ids(text)
        words = self.words
        return b"".join([words[w] for w in text.split()])

    def rest(self) -> None:
        """Between tasks only the younger half of what is remembered stays:
        the worker may go on with a stage that has no use for it."""
        self.words.old, self.pieces.old = {}, {}


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept from task to task."""
    return WordEncoder(path)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers use for bytes: printable Latin-1
    stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` and, if asked for,
    ``ids``.  ``row`` is a hash of id and text that spreads the pieces."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of earlier stages
        words = encoder(tokenizer)
        encode = words.encode
        last = array("I", [end]).tobytes()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = (t for k in range(0, batch.num_rows, STEP) for t in batch.column(2).slice(k, STEP).to_pylist())
            for i, value in enumerate(texts):
                raw = encode(value) + last
                for k in range(0, len(raw), 4 * capacity):
                    own = raw[k:k + 4 * capacity]
                    at.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())),
                      pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names)
        words.rest()
        release_memory()

    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    rows = sources_of(docs, doc_id, text).select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"),
                                                 text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, "
                                "length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


# ------------------------------------------------------------------ plan

def patterns(count: np.ndarray, partners: int = PARTNERS) -> np.ndarray:
    """Lengths of up to three documents that fill a sequence exactly, as rows
    padded with 0.  ``count[n]`` is the number of pieces of length n."""
    capacity = len(count) - 1
    have = np.flatnonzero(count)
    out = []
    if count[capacity]:
        out.append([capacity, 0, 0])
    for a in have[have <= capacity // 2].tolist():
        if count[capacity - a]:
            out.append([capacity - a, a, 0])
    # triples: a common length, any other, and what fills the rest
    common = have[np.argsort(-count[have], kind="stable")][:256]
    for a in have.tolist():
        rest = capacity - a - common
        fits = (rest > 0) & (count[np.clip(rest, 0, capacity)] > 0)
        for b, c in zip(common[fits][:partners].tolist(), rest[fits][:partners].tolist()):
            out.append(sorted((a, b, c), reverse=True))
    return np.unique(np.array(out, np.int64).reshape(-1, 3), axis=0)


def fit(count: np.ndarray, rows: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 of the patterns with least
    |A x - count|, A holding how often a pattern uses each length.  Projected
    gradient with Nesterov's momentum."""
    b = count.astype(float)
    scale = max(1.0, b.max())
    b = b / scale
    b[0] = 0.0
    used = rows > 0

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b))
        for k in range(3):
            out += np.bincount(rows[:, k], x * used[:, k], len(b))
        return out

    def backward(r: np.ndarray) -> np.ndarray:
        return (r[rows] * used).sum(axis=1)

    v = np.ones(len(rows))
    norm = 1.0
    for _ in range(20):  # largest eigenvalue of A'A
        v = backward(forward(v))
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-12)
    x = np.zeros(len(rows))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - backward(forward(y) - b) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


@dataclass
class Plan:
    """``length[i]`` pieces numbered ``low[i]`` .. ``high[i] - 1`` go to the
    sequences ``first[i]``, ``first[i] + 1``, ... at ``offset[i]``."""
    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.searchsorted(self.length, length)
        # intervals of one length are consecutive and sorted by `low`
        end = np.searchsorted(self.length, length, "right")
        while (open_ := end - base > 1).any():
            mid = (base + end) // 2
            right = open_ & (self.low[np.minimum(mid, len(self.low) - 1)] <= number)
            base = np.where(right, mid, base)
            end = np.where(open_ & ~right, mid, end)
        return self.first[base] + number - self.low[base], self.offset[base]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fit, round and pack the residual; work and size depend on the number
    of lengths, not of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    groups: list[tuple[tuple[int, ...], int]] = []  # (lengths in order, how many sequences)
    rows = patterns(left)
    if len(rows):
        repeat = fit(left, rows)
        for k in np.argsort(-repeat, kind="stable").tolist():
            want = int(repeat[k])  # rounded down: best fit packs what is over
            if want < 1:
                break
            lengths = tuple(n for n in rows[k].tolist() if n)
            most = min(int(left[n]) // lengths.count(n) for n in lengths)
            if (times := min(want, most)) > 0:
                for n in lengths:
                    left[n] -= times
                groups.append((lengths, times))
    groups += best_fit(left, capacity)
    return _numbered(groups)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack a histogram by best fit, longest pieces first, on groups of equal
    sequences."""
    spaces: list[int] = []  # spaces for which there are open groups, ascending
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(space: int, lengths: tuple[int, ...], times: int) -> None:
        if not space:
            closed.append((lengths, times))
            return
        if space not in open_:
            insort(spaces, space)
            open_[space] = []
        open_[space].append((lengths, times))

    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                each = capacity // n
                full, rest = divmod(todo, each)
                if full:
                    put(capacity - each * n, (n,) * each, full)
                if rest:
                    put(capacity - rest * n, (n,) * rest, 1)
                todo = 0
                continue
            space = spaces[at]
            lengths, times = open_[space].pop()
            if not open_[space]:
                del open_[space], spaces[at]
            each = min(space // n, todo)
            full = min(times, todo // each)
            if full < times:
                put(space, lengths, times - full)
            put(space - each * n, lengths + (n,) * each, full)
            todo -= each * full
    return closed + [g for own in open_.values() for g in own]


def _numbered(groups: list[tuple[tuple[int, ...], int]]) -> Plan:
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in groups:
        offset = 0
        for n in lengths:
            low = used.get(n, 0)
            rows.append((n, low, low + times, first, offset))
            used[n] = low + times
            offset += n
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=first)


# ------------------------------------------------------------------ jobs

def numbered(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """``rows`` plus ``number``, counting from 0 within each length, and the
    histogram ``length, count``."""
    buckets = F.greatest(F.lit(1), F.ceil(F.count("*") / rows_per_bucket)).cast("int")
    per_length = materialize(rows.groupBy("length").agg(F.count("*").alias("count"), buckets.alias("buckets")))
    # at most one row per possible length: bounded by the capacity
    spread = rows.join(F.broadcast(per_length.select("length", "buckets")), "length").withColumn(
        "bucket", F.pmod("row", "buckets").cast("int"))
    totals = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "bucket").orderBy("row", "doc_id", "piece")
    out = (spread.withColumn("inside", F.row_number().over(inside) - 1)
           .join(starts, ["length", "bucket"])
           .withColumn("number", F.col("earlier") + F.col("inside")).drop("bucket", "buckets", "inside", "earlier"))
    return out, per_length


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (see :func:`pieces`) plus ``sequence_id`` and ``offset``."""
    with_number, per_length = numbered(rows)
    histogram = {r["length"]: r["count"] for r in per_length.collect()}  # at most `capacity` rows
    ready = plan(histogram, capacity)
    schema = with_number.drop("number").schema
    shared = rows.sparkSession.sparkContext.broadcast(ready)  # a few intervals per length

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            keep = [i for i, n in enumerate(batch.schema.names) if n != "number"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)],
                                             names=[batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    return with_number.mapInArrow(run, schema.add("sequence_id", "long").add("offset", "long"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, from pieces that
    carry their ids.  A sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def packed_pieces(docs: DataFrame, tokenizer: str | Callable[[], str] = tokenizer_path) -> DataFrame:
    """Tokenise and pack, without the ids themselves."""
    path = tokenizer() if callable(tokenizer) else tokenizer
    return pack(materialize(pieces(docs, path, with_ids=False))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir))
