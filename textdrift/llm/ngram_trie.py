"""Language-model scoring with an Elias-Fano n-gram trie.

Model.  Interpolated absolute discounting over n-grams of any order: a
continuation seen after a context has (count - D) / context count, plus the
context's remaining mass times the probability after the shorter context.  The
shortest context is none: (c + 0.5) / (N + 0.5 (V + 1)), which leaves mass for
unknown words, so the probabilities of a context sum to one.

Trie.  N-grams are dealt into shards by the hashes of their first two words, so
that a frequent word's successors lie in several shards; a first word's count
and its number of successors are added up over them.  In a shard, level 1 holds the sorted 64-bit hashes of first words, and
each further level the (parent, 40-bit word code) pairs of its n-grams.  Both
are monotone and Elias-Fano coded, as are the counts of level 1 (running sums,
exact) and the pointers from a node to its children.  Discounted probabilities
and remaining masses are quantised logarithms, 16 bits each.  A query descends
by successor search among the children of the node it has reached; a text's
places go down one level at a time, each from the node of its context.

Files.  A shard is one file in the checkpoint folder, written by the task that
built it under a temporary name and then renamed, so a repeated task does no
harm.  Scoring tasks map shards into memory and touch only the pages they
look at.  If the folder is not a file system that they can map, a shard is
copied next to the executor's own Spark files first.

Counting emits each batch's distinct n-grams, compressed, one row per shard,
so a frequent n-gram costs a row's few bytes per batch.  Numbers of rows and
places are 32-bit, sorts are in place, and what a step or a shard no longer
needs is let go, as two workers share an executor's memory with its JVM.

Defined cases.  A null text is empty; an empty text is its end token alone.
ASCII capitals are lower-cased.  Rows without an id and repeated rows are
scored one by one.  With nothing to learn from every token has the base's
probability.  Further columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, crc_bucket, documents, release_memory, sources_of, text_or_empty
from .elias_fano import BLOCK, EliasFano, encode

ORDER = 3
DISCOUNT = 0.75
#: Characters of training text per shard, and tokens held at once.
SHARD_CHARS = 16_000_000
STEP = 1_000_000
CODE_BITS = 40
CODE_BYTES = CODE_BITS // 8
#: Logarithms are quantised on [-RANGE, 0].
RANGE = 8.0

# Words are never empty or white space, so these cannot be words.
BEGIN = xxhash.xxh64_intdigest(b"")
STOP = xxhash.xxh64_intdigest(b"\n")
PAD = xxhash.xxh64_intdigest(b" ")

_SHIFT = np.uint64(64 - CODE_BITS)
_CODE = np.uint64(CODE_BITS)


def _codes(hashes: np.ndarray) -> np.ndarray:
    return hashes >> _SHIFT


def _quantised(x: np.ndarray) -> np.ndarray:
    logs = np.log10(np.maximum(x, 10.0 ** -RANGE))
    return np.round(-logs / RANGE * 65535).astype(np.uint16)


def _restored(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-RANGE * q.astype(np.float64) / 65535)


def _values(words: pa.LargeStringArray) -> list[bytes]:
    """``to_pylist`` in bytes; that takes a call per value."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


class Tokens:
    """Tokens of several texts, each as begin, words, end: ``words`` has their
    distinct hashes, sorted, and ``word`` the place of each token's there."""

    def __init__(self, texts: pa.Array | list[str]) -> None:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        sizes, own, coded = [np.empty(0, np.int64)], [np.array([BEGIN, STOP], np.uint64)], []
        for piece in _steps(texts):  # what splitting takes is held for one piece
            lists, m = pc.ascii_split_whitespace(pc.ascii_lower(piece)), len(piece)
            flat = lists.flatten()
            real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
            owner = np.repeat(np.arange(m, dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sizes.append(np.bincount(owner[real], minlength=m) + 2)
            flat = flat.filter(pa.array(real)).dictionary_encode()
            distinct = _values(flat.dictionary.cast(pa.large_string()))
            own.append(np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct)))
            coded.append(flat.indices.to_numpy(zero_copy_only=False))
            del lists, flat, real, owner
        self.sizes = np.concatenate(sizes)
        self.words = np.unique(np.concatenate(own))
        ends = np.cumsum(self.sizes)
        self.word = np.empty(int(self.sizes.sum()), np.int32)
        inner = np.ones(len(self.word), bool)
        begin, stop = np.searchsorted(self.words, own[0])
        for at, place in ((ends - self.sizes, begin), (ends - 1, stop)):
            inner[at] = False
            self.word[at] = place
        at = texts_done = 0
        for hashes, codes, n in zip(own[1:], coded, sizes[1:]):
            texts_done += len(n)
            to = int(ends[texts_done - 1])
            self.word[at:to][inner[at:to]] = np.searchsorted(self.words, hashes).astype(np.int32)[codes]
            at = to
        self.left = np.repeat(ends.astype(np.int32), self.sizes)  # tokens from here to the end
        self.left -= np.arange(len(self.word), dtype=np.int32)

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def after(self, k: int) -> np.ndarray:
        """The place in ``words`` of the token k places on, beyond them after the end."""
        out = np.full(len(self.word), len(self.words), np.int32)
        out[:len(out) - k] = self.word[k:]
        out[self.left <= k] = len(self.words)
        return out

    def ngrams(self, order: int, bits: int = 0) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """Distinct n-grams, PAD beyond a text's end, by the leading bits of
        their first words' hashes: those, then in the order of the hashes the
        first words' hash and the others' codes; their counts."""
        base = len(self.words) + 1
        codes = _codes(np.append(self.words, np.uint64(PAD)))
        heads = np.searchsorted(self.words >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, base])
        if base ** order < 1 << 63:  # one number has them all
            key = self.word.astype(np.int64)
            for k in range(1, order):
                key *= base
                key += self.after(k)
            key = key[self.left > 1]  # all but the end token
            key.sort()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            counts = np.diff(at, append=len(key)).astype(np.uint32)
            key = key[at]
            del at, new
            cut = [int(np.searchsorted(key, h * base ** (order - 1))) if h < base else len(key) for h in heads.tolist()]
            part = lambda lo, hi: [key[lo:hi] // base ** (order - 1 - k) % base for k in range(order)]
        else:
            starts = np.flatnonzero(self.left > 1)
            places, counts = _distinct([self.word[starts]] + [self.after(k)[starts] for k in range(1, order)], np.ones(len(starts), np.int64))
            cut = np.searchsorted(places[0], heads).tolist()
            part = lambda lo, hi: [p[lo:hi] for p in places]
        for number, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if hi > lo:
                places_of = part(lo, hi)
                yield number, [self.words[places_of[0]]] + [codes[p] for p in places_of[1:]], counts[lo:hi]


def _steps(texts: pa.Array, limit: int = STEP) -> Iterator[pa.Array]:
    start = n = 0
    for i, size in enumerate(pc.utf8_length(texts).to_pylist()):
        n += size // 6 + 2
        if n >= limit:
            yield texts[start:i + 1]
            start, n = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _narrow(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]


def _wide(narrow: np.ndarray) -> np.ndarray:
    out = np.zeros((len(narrow), 8), np.uint8)
    out[:, :CODE_BYTES] = narrow
    return out.view(np.uint64).ravel()


def _packed(first: np.ndarray, counts: np.ndarray, others: list[np.ndarray]) -> bytes:
    """Distinct n-grams of one batch and shard, those with a common beginning
    side by side: the first words, then by level the codes that follow a
    beginning; at the end how many follow each beginning, and the counts."""
    n = len(first)
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    at = np.flatnonzero(new)
    parts, numbers = [first[at]], []
    for level, o in enumerate(others, 2):
        if level <= len(others):
            new[1:] |= o[1:] != o[:-1]
            then = np.flatnonzero(new)
        else:
            then = np.arange(n)
        numbers.append(np.diff(np.searchsorted(then, at), append=len(then)).astype(np.uint32))
        parts.append(_narrow(o[then]))
        at = then
    planes = np.concatenate([*numbers, counts.astype(np.uint32)]).view(np.uint8).reshape(-1, 4).T
    meta = np.array([len(parts), *map(len, parts)], np.uint32).tobytes()
    return meta + b"".join(np.ascontiguousarray(x).tobytes() for x in parts) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(blobs: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The n-grams of a shard's batches, which are let go: the distinct first
    words, each row's place there, its other words as narrow codes, its count."""
    order = int(np.frombuffer(blobs[0], np.uint32, 1)[0])
    sizes = [np.frombuffer(b, np.uint32, order, 4).tolist() for b in blobs]
    n, body = sum(s[-1] for s in sizes), 4 * (order + 1)
    heads = np.unique(np.concatenate([np.frombuffer(b, np.uint64, s[0], body) for b, s in zip(blobs, sizes)]))
    parent, counts = np.empty(n, np.uint32), np.empty(n, np.uint32)
    others = [np.empty((n, CODE_BYTES), np.uint8) for _ in range(order - 1)]
    lo = 0
    for i, size in enumerate(sizes):
        blob, blobs[i], hi = blobs[i], None, lo + size[-1]
        at = body + 8 * size[0] + CODE_BYTES * sum(size[1:])
        planes = np.frombuffer(zlib.decompress(memoryview(blob)[at:]), np.uint8).reshape(4, -1).T
        numbers = np.split(np.ascontiguousarray(planes).view(np.uint32).ravel(), np.cumsum(size))
        counts[lo:hi] = numbers[order - 1]
        rows = np.ones(size[-1], np.int64)  # of a beginning, from the longest on
        for level in range(order - 1, 0, -1):
            at -= CODE_BYTES * size[level]
            codes = np.frombuffer(blob, np.uint8, CODE_BYTES * size[level], at).reshape(-1, CODE_BYTES)
            others[level - 1][lo:hi] = codes if level == order - 1 else np.repeat(codes, rows, axis=0)
            rows = np.add.reduceat(rows, np.cumsum(numbers[level - 1], dtype=np.int64) - numbers[level - 1])
        own = np.searchsorted(heads, np.frombuffer(blob, np.uint64, size[0], body)).astype(np.uint32)
        parent[lo:hi] = np.repeat(own, rows)
        lo = hi
    return heads, parent, others, counts


def _distinct(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in lexicographic order with summed counts."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _summed(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for i in range(0, len(at), BLOCK):
        out += np.bincount(at[i:i + BLOCK], weights[i:i + BLOCK], size).astype(np.int64)
    return out


def build_shard(heads: np.ndarray, parent: np.ndarray, others: list[np.ndarray], counts: np.ndarray,
                discount: float) -> dict[str, np.ndarray]:
    """The arrays of one shard from its n-grams, repeats included, as
    :func:`_unpacked` gives them; ``others`` is used up."""
    out: dict[str, np.ndarray] = {}
    total = _summed(parent, counts, len(heads))
    for k, part in encode(heads).items():
        out[f"words.{k}"] = part
    for k, part in encode(np.concatenate([[0], np.cumsum(total)]).astype(np.uint64)).items():
        out[f"counts.{k}"] = part
    pad = np.uint64(PAD >> int(_SHIFT))
    above_n, top = len(heads), len(others) + 1
    for level in range(2, top + 1):
        keys = _wide(others.pop(0))
        real = keys != pad
        if not real.all():
            keys, parent, counts, others = keys[real], parent[real], counts[real], [o[real] for o in others]
        keys |= parent.astype(np.uint64) << _CODE
        order = np.argsort(keys, kind="stable")  # batches are runs that nearly ascend
        del real, parent
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        nodes = keys[first]
        del keys
        seen = np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
        if level < top:
            parent = np.empty(len(order), np.uint32)
            parent[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        del order, new, first
        above = (nodes >> _CODE).astype(np.uint32)
        followed = _summed(above, seen, above_n)  # a node's occurrences that go on
        children = _summed(above, np.ones(len(above), np.uint8), above_n)
        if level > 2:  # a first word's mass takes all shards that have it
            mass = np.empty(above_n, np.uint16)
            for i in range(0, above_n, BLOCK):
                mass[i:i + BLOCK] = _mass(children[i:i + BLOCK], followed[i:i + BLOCK], discount)
            out[f"mass{level - 1}"] = mass
        prob = np.empty(len(nodes), np.uint16)
        for i in range(0, len(nodes), BLOCK):
            prob[i:i + BLOCK] = _quantised((seen[i:i + BLOCK] - discount) / followed[above[i:i + BLOCK]])
        out[f"prob{level}"] = prob
        del seen, above, followed
        for k, part in encode(nodes).items():
            out[f"nodes{level}.{k}"] = part
        for k, part in encode(np.concatenate([[0], np.cumsum(children)]).astype(np.uint64)).items():
            out[f"pointers{level - 1}.{k}"] = part
        above_n = len(nodes)
    return out


def _mass(children: np.ndarray, followed: np.ndarray, discount: float) -> np.ndarray:
    """What a context leaves to the shorter one."""
    return _quantised(np.where(children > 0, discount * children / np.maximum(followed, 1), 1.0))


def _file_bytes(arrays: dict[str, np.ndarray]) -> Iterator[bytes | pa.Buffer]:
    """Header with names, types and places, then the arrays, 64-byte aligned."""
    at, index = 0, {}
    for name, a in arrays.items():
        index[name] = (str(a.dtype), len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(index).encode()
    yield np.uint64(len(head)).tobytes() + head + b" " * (-(8 + len(head)) % 64)
    for a in arrays.values():
        yield pa.py_buffer(a)
        yield b"\0" * (-a.nbytes % 64)


def _file_system(folder: str):
    """File system and path of a folder named by Spark."""
    from pyarrow import fs
    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def _local_file(folder: str, name: str) -> str:
    """A path that can be mapped: the file itself, or a copy of it."""
    from pyarrow import fs
    system, path = _file_system(folder)
    if isinstance(system, fs.LocalFileSystem):
        return f"{path}/{name}"
    from pyspark import SparkFiles
    copy = os.path.join(SparkFiles.getRootDirectory(), f"{os.path.basename(path)}-{name}")
    if not os.path.exists(copy):
        part = f"{copy}.{uuid.uuid4().hex}"
        fs.copy_files(f"{path}/{name}", part, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        os.replace(part, copy)
    return copy


class Shard:
    """A memory-mapped shard."""

    def __init__(self, path: str) -> None:
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view is cheaper to index
        size = int(raw[:8].view(np.uint64)[0])
        index = json.loads(raw[8:8 + size].tobytes())
        start = -(-(8 + size) // 64) * 64
        a = {name: raw[start + at:start + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in index.items()}
        series = lambda name: EliasFano({k: a[f"{name}.{k}"] for k in ("head", "low", "bits", "ones", "zeros")})
        self.words, self.counts = series("words"), series("counts")
        self.levels = {}
        level = 2
        while f"prob{level}" in a:
            self.levels[level] = (series(f"nodes{level}"), series(f"pointers{level - 1}"), a[f"prob{level}"], a.get(f"mass{level - 1}"))
            level += 1

    def count(self, node: np.ndarray) -> np.ndarray:
        begin, end = self.counts.ends(node)
        return (end - begin).astype(np.int64)

    def successors(self, node: np.ndarray) -> np.ndarray:
        begin, end = self.levels[2][1].ends(node)
        return (end - begin).astype(np.int64)


@dataclass
class Model:
    """Where the shards are and the corpus totals; a few numbers."""
    folder: str
    bits: int               # a shard's number is the leading bits of the first word's hash
    splits: int             # and these many of the second word's
    order: int
    discount: float
    texts: int              # training texts: the count of the end token
    tokens: int             # N
    distinct: int           # V
    present: frozenset = field(default_factory=frozenset)

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def split_of(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(CODE_BITS - self.splits)).astype(np.int64)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.open: dict[int, Shard] = {}

    def shard(self, s: int) -> Shard:
        if s not in self.open:
            self.open[s] = Shard(_local_file(self.model.folder, f"shard-{s:05d}.bin"))
        return self.open[s]

    def _by_shard(self, hashes: np.ndarray) -> Iterator[tuple[int, Shard, slice]]:
        """Hashes must be sorted; yields the splits of their shards and the
        places that belong to them."""
        numbers = self.model.shard_of(hashes)
        for s in np.unique(numbers).tolist():
            part = slice(*np.searchsorted(numbers, [s, s + 1]).tolist())
            for split in range(1 << self.model.splits):
                if (number := s << self.model.splits | split) in self.model.present:
                    yield split, self.shard(number), part

    def score(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        model, t = self.model, Tokens(texts)
        words, word = t.words, t.word.astype(np.int64)  # indices of that type need no cast
        node = np.full((1 << model.splits, len(words)), -1, np.int32)
        inside, successors = np.zeros(node.shape, np.int64), np.zeros(len(words), np.int64)
        for split, shard, part in self._by_shard(words):
            node[split, part] = found = shard.words.find(words[part])
            at = np.flatnonzero(found >= 0)
            inside[split, part][at] = shard.count(found[at])
            successors[part][at] += shard.successors(found[at])
        total = inside.sum(axis=0)
        mass = _restored(_mass(successors, total, model.discount))
        count = total.copy()
        count[words == np.uint64(STOP)] = model.texts
        scored = words[word] != np.uint64(BEGIN)
        base = model.unigram(count)[word]
        prob = base.copy()
        start = np.arange(len(word), dtype=np.int32) - np.repeat((np.cumsum(t.sizes) - t.sizes).astype(np.int32), t.sizes)  # places before, in the text
        shards, codes = model.shard_of(words), _codes(words)
        splits = model.split_of(codes)
        here = None  # the node of the n-gram of the last level that ends at a place
        for k in range(2, model.order + 1):
            own = np.flatnonzero(start >= k - 1)
            second = splits[word[own - k + 2]]
            if k == 2:
                prob[own] *= mass[word[own - 1]]
                before = node[second, word[own - 1]]
                share = inside / np.maximum(total, 1)  # of a word's occurrences, in each of its shards
            else:
                before = here[own - 1]
            seen = np.flatnonzero(before >= 0)  # an unseen context leaves the shorter one's probability
            own, second, before = own[seen], second[seen], before[seen]
            part = share[second, word[own - 1]] if k == 2 and model.splits else None
            numbers = shards[word[own - k + 1]] << model.splits | second
            keys = (before.astype(np.uint64) << _CODE) | codes[word[own]]
            here = self._level(numbers, keys, own, prob, k, part)
        n = len(texts)
        add = lambda v: np.bincount(t.owner[scored], v[scored], n)
        return (t.sizes - 1, add((count > 0)[word].astype(float)).astype(np.int64), add(np.log10(base)), add(np.log10(prob)))

    def _level(self, numbers: np.ndarray, keys: np.ndarray, own: np.ndarray, prob: np.ndarray, k: int,
               share: np.ndarray | None) -> np.ndarray:
        """Takes ``prob`` at the places ``own`` from order k - 1 to k; the
        nodes of the k-grams that end at each place.  ``numbers`` are the
        shards, ``keys`` the nodes of the (k - 1)-grams before with the last
        words' codes, so only the last step of a path is searched.  ``share`` is
        the part of a context's occurrences that its shard holds, if not all."""
        model = self.model
        found = np.full(len(prob), -1, np.int32)
        order = np.argsort(numbers.astype(np.uint16) if model.bits + model.splits <= 16 else numbers, kind="stable")
        own, numbers, keys = own[order], numbers[order], keys[order]
        if share is not None:
            share = share[order]
        for s in np.unique(numbers).tolist():
            part = slice(*np.searchsorted(numbers, [s, s + 1]).tolist())
            shard = self.shard(s)
            if k not in shard.levels:
                continue
            nodes, pointers, probs, left = shard.levels[k]
            order = np.argsort(keys[part])
            at, key = own[part][order], keys[part][order]
            parent = (key >> _CODE).astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = parent[1:] != parent[:-1]
            context, back = parent[new], np.cumsum(new) - 1
            if left is not None:
                prob[at] *= _restored(left[context])[back]
            begin, end = pointers.ends(context)
            on = (end > begin)[back]  # a leaf needs no search
            of_all = 1.0 if share is None else share[part][order][on]
            at, key = at[on], key[on]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            child = nodes.find(key[new])[np.cumsum(new) - 1]  # each path is searched once
            hit = np.flatnonzero(child >= 0)
            prob[at[hit]] += _restored(probs[child[hit]]) * (of_all if share is None else of_all[hit])
            found[at] = child
        return found


def learn(docs: DataFrame, train: Column | None = None, order: int = ORDER, discount: float = DISCOUNT,
          shard_chars: int = SHARD_CHARS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Count the n-grams of all texts for which ``train`` holds and write the
    trie's shards."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    rows = sources_of(docs if train is None else docs.where(train), doc_id, text).select(text_or_empty(text).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    bits = max(0, (size // shard_chars).bit_length())
    splits = bits // 3
    bits -= splits
    folder = f"{checkpoint_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _steps(batch.column(0), 4 * STEP):
                for number, columns, counts in Tokens(texts).ngrams(order, bits):
                    second = columns[1] >> np.uint64(CODE_BITS - splits)
                    for split in range(1 << splits):
                        own = np.flatnonzero(second == np.uint64(split)) if splits else slice(None)
                        first = columns[0][own]
                        if len(first):
                            blob = _packed(first, counts[own], [c[own] for c in columns[1:]])
                            yield pa.RecordBatch.from_arrays([pa.array([number << splits | split], pa.int32()), pa.array([blob], pa.binary())],
                                                             names=["shard", "blob"])
        release_memory()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        held: list = []
        current = -1

        def finish() -> pa.RecordBatch:
            heads, parent, others, counts = _unpacked(held)
            held.clear()
            at = np.searchsorted(heads, np.uint64(BEGIN))
            begin = int(counts[parent == at].sum(dtype=np.int64)) if at < len(heads) and heads[at] == np.uint64(BEGIN) else 0
            n = int(counts.sum(dtype=np.int64))
            name = f"{path}/shard-{current:05d}.bin"
            part = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                for piece in _file_bytes(build_shard(heads, parent, others, counts, discount)):
                    out.write(piece)
            system.move(part, name)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([current >> splits], pa.int32()), pa.array([n - begin]),
                                               pa.array([begin]), pa.array([heads.tobytes()], pa.binary())],
                                              names=["shard", "words", "n", "texts", "heads"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s != current and held:
                    yield finish()
                current = s
                held.append(blob.as_buffer())
        if held:
            yield finish()
        release_memory()

    def vocabulary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word stands in up to 2 ** splits shards and counts once
        current, known = -1, np.empty(0, np.uint64)
        for batch in batches:
            v = []
            for words, blob in zip(batch.column(1).to_pylist(), batch.column(4)):
                if words != current:
                    current, known = words, np.array([BEGIN], np.uint64)
                more = np.union1d(known, np.frombuffer(blob.as_buffer(), np.uint64))
                v.append(len(more) - len(known))
                known = more
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(v, pa.int64()), batch.column(3)],
                                             names=["shard", "n", "v", "texts"])

    counted = rows.mapInArrow(count, "shard int, blob binary")
    shards = (counted.repartitionById(1 << bits + splits, "shard").sortWithinPartitions("shard")
              .mapInArrow(build, "shard int, words int, n long, texts long, heads binary"))
    built = (shards.repartitionById(1 << bits, "words").sortWithinPartitions("words", "shard")
             .mapInArrow(vocabulary, "shard int, n long, v long, texts long")).collect()  # one row per shard
    texts = sum(r["texts"] for r in built)
    return Model(folder, bits, splits, order, discount, texts, sum(r["n"] for r in built) + texts, sum(r["v"] for r in built) + int(texts > 0),
                 frozenset(r["shard"] for r in built))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""
    rows = sources_of(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            parts = [scorer.score(texts) for texts in _steps(batch.column(1))]
            n, known, base, own = (np.concatenate([p[i] for p in parts]) if parts else [] for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                 pa.array([model.tokens] * batch.num_rows, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        release_memory()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, "
                                "train_tokens long, base_score double, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 1, F.lit(False))
    model = learn(docs, F.coalesce(crc_bucket("doc_id", 5) != 1, F.lit(False)))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
