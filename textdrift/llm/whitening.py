"""Embedding whitening from an exact scatter matrix by bit slices.

Components become integers, ``x = floor(64 c) + 1000000``, so that all sums
are exact.  The fit uses each distinct vector once.  Cross-products come from
bit planes: a block of rows is shifted by its least value per dimension, each
dimension's bits are packed across rows into 64-bit words, and the number of
rows that have bit p of dimension j and bit q of dimension k is the population
count of the ANDed words.  The counts, weighted by ``2 ** (p + q)``, and the
shifts give the exact sums of ``x_j x_k``.  Covariances are centred in integers,
``n P - S S'``, and only then turned into floating point for ``eigh``.

Scale.  Blocks have a bounded number of rows; a task sends one sum per pair
of dimensions, in limbs of 40 bits, whatever its rows.  What reaches the
driver grows with the square of the dimension only.  Repeats collapse in each
task before the distinct vectors are dealt out.  Whitened rows are computed
where they are read.

Defined cases.  Vectors that are null, hold null or non-finite components, or
components too large for a 64-bit integer, are dropped.  Vectors of different
lengths lie in different spaces: each length is fitted and whitened by itself.
Directions without variance (eigenvalue zero up to rounding) have no whitened
value and are left out, so a length with a single distinct vector, like one
with empty vectors, gives no rows.  Repeated ids and null ids are whitened row
by row.  An empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sources_of

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows of a block; a multiple of 64.
BLOCK = 8192
LIMB = 40
LIMBS = 5
#: Components beyond this size have no 64-bit integer.
LARGEST = 2.0 ** 56


def integers(vector: Column) -> Column:
    """The vector's integers; null if it is null or not usable."""
    values = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(LARGEST)))
    return F.when(~bad, F.transform(values, lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET).cast("long")))


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, weights) of unsigned integers: each plane is one bit of one
    dimension, packed over the rows into 64-bit words; ``weights`` (dimension
    by plane, whole numbers) holds the value of that bit, else 0."""
    rows, dims = y.shape
    planes, of, value = [], [], []
    for j in range(dims):
        for p in range(int(y[:, j].max()).bit_length()):
            packed = np.zeros(-(-rows // 64) * 8, np.uint8)
            bits = np.packbits((y[:, j] >> np.uint64(p) & np.uint64(1)).astype(np.uint8))
            packed[:len(bits)] = bits
            planes.append(packed.view(np.uint64))
            of.append(j)
            value.append(1 << p)
    weights = np.zeros((dims, len(planes)), object)
    weights[of, range(len(planes))] = value
    return np.array(planes, np.uint64).reshape(len(planes), -(-rows // 64)), weights


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of a block of 64-bit integers, as whole numbers: of each
    dimension, and of the products of any two."""
    rows = len(x)
    shift = x.min(axis=0)
    # unsigned, since the distance of two signed numbers may not fit a signed one
    planes, weights = bit_planes(x.astype(np.uint64) - shift.astype(np.uint64))
    both = np.zeros((len(planes), len(planes)), np.int64)
    for a in range(len(planes)):
        both[a, a:] = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64)
    both += np.triu(both, 1).T
    if not planes.size or int(weights.max()) ** 2 * 4 * rows < 2 ** 62:  # a sum of bit values is below twice the largest
        small = weights.astype(np.int64)
        sums, products = (small @ np.diag(both)).astype(object), (small @ both @ small.T).astype(object)
    else:
        sums, products = weights @ np.diag(both).astype(object), weights @ both.astype(object) @ weights.T
    first = np.array(shift.tolist(), object)
    return sums + rows * first, products + np.outer(first, sums) + np.outer(sums, first) + rows * np.outer(first, first)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers) of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.append(0, np.cumsum(sizes))[:-1]
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, flat[starts[own][:, None] + np.arange(size)]


def _limbs(value: int) -> list[int]:
    return [value >> LIMB * i & (1 << LIMB) - 1 for i in range(LIMBS - 1)] + [value >> LIMB * (LIMBS - 1)]


_LIMB_NAMES = [f"limb{i}" for i in range(LIMBS)]
_CELL = pa.schema([("dims", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), *[(n, pa.int64()) for n in _LIMB_NAMES]])


def _scatter_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact sums of a task's vectors.  Cell (j, k) holds the products of
    two dimensions, (-1, k) the sum of one, (-1, -1) the number of rows."""
    totals: dict[int, list] = {}
    for batch in batches:
        for own, x in _by_length(batch.column(0)):
            dims = x.shape[1]
            total = totals.setdefault(dims, [0, np.zeros(dims, object), np.zeros((dims, dims), object)])
            total[0] += len(own)
            for at in range(0, len(own) if dims else 0, BLOCK):
                sums, products = scatter(x[at:at + BLOCK])
                total[1] += sums
                total[2] += products
    for dims, (rows, sums, products) in totals.items():
        cells = [(-1, -1, rows), *[(-1, k, sums[k]) for k in range(dims)],
                 *[(j, k, products[j, k]) for j in range(dims) for k in range(j, dims)]]
        parts = list(zip(*[_limbs(int(v)) for _, _, v in cells]))
        yield pa.RecordBatch.from_arrays([pa.array([dims] * len(cells), pa.int32()), pa.array([c[0] for c in cells], pa.int32()),
                                          pa.array([c[1] for c in cells], pa.int32()), *[pa.array(p, pa.int64()) for p in parts]],
                                         schema=_CELL)


@dataclass
class Whitener:
    """Fit of one vector length: ``n`` distinct vectors with exact ``sums``;
    ``axes`` has a unit eigenvector in each column, by falling ``values``."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact; 64-bit where these numbers fit."""
        reach = max([abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))])
        if self.n * reach < 2 ** 62 and max(map(abs, self.sums), default=0) < 2 ** 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, offsets: np.ndarray) -> list[int]:
        """Sum of the squared offsets of each row, exact."""
        far = int(np.abs(offsets).max(initial=0))
        if far * far * max(1, offsets.shape[1]) >= 2 ** 63:
            offsets = offsets.astype(object)
        return [int(v) for v in (offsets * offsets).sum(axis=1)]

    def whiten(self, offsets: np.ndarray) -> np.ndarray:
        return (offsets.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def fit(vectors: DataFrame, column: str = "x", components: int = COMPONENTS) -> dict[int, Whitener]:
    """A fit for each vector length of ``column`` (integers, each vector once)."""
    cells = (vectors.select(column).mapInArrow(_scatter_task, ", ".join(
        ["dims int, j int, k int", *[f"{n} long" for n in _LIMB_NAMES]]))
        .groupBy("dims", "j", "k").agg(*[F.sum(n).alias(n) for n in _LIMB_NAMES]).collect())  # dims ** 2 / 2 rows
    sums: dict[int, dict] = {}
    for r in cells:
        sums.setdefault(r["dims"], {})[r["j"], r["k"]] = sum(r[n] << LIMB * i for i, n in enumerate(_LIMB_NAMES))
    fits = {}
    for dims, cell in sums.items():
        n, total = cell[-1, -1], [cell[-1, k] for k in range(dims)]
        # V = (n P - S S') / n ** 2, its numerator a whole number
        v = np.array([[(n * cell[min(j, k), max(j, k)] - total[j] * total[k]) / (n * n) for k in range(dims)]
                      for j in range(dims)]).reshape(dims, dims)
        value, vector = np.linalg.eigh(v) if dims else (np.zeros(0), np.zeros((0, 0)))
        value, vector = value[::-1], vector[:, ::-1]
        real = int((value > max(1, dims) * np.finfo(float).eps * value.max(initial=0)).sum())
        take = min(real, components)
        fits[dims] = Whitener(n, total, vector[:, :take], value[:take], value[:take] / max(np.trace(v), np.finfo(float).tiny))
    return fits


def measure(vectors: DataFrame, fits: dict[int, Whitener], column: str = "x") -> dict[int, float]:
    """Of each length, the largest entry of the whitened fit list's
    covariance minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)  # dims * components numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                own = shared.value[x.shape[1]]
                z = own.whiten(own.offsets(x))  # centred, as the offsets are
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + z.T @ z
        for dims, products in total.items():
            a, b = np.indices(products.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dims), pa.int32()), pa.array(a, pa.int32()),
                                              pa.array(b, pa.int32()), pa.array(products.ravel())], names=["dims", "a", "b", "s"])

    rows = (vectors.select(column).mapInArrow(run, "dims int, a int, b int, s double")
            .groupBy("dims", "a", "b").agg(F.sum("s").alias("s")).collect())  # components ** 2 rows
    worst: dict[int, float] = {d: 0.0 for d in fits}
    for r in rows:
        worst[r["dims"]] = max(worst[r["dims"]], abs(r["s"] / fits[r["dims"]].n - (r["a"] == r["b"])))
    return worst


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation`` (text, as it may exceed any integer
    type), ``whitened, explained, identity_error`` for every usable row and
    component."""
    x = materialize(sources_of(rows, vec_id, vector).select(F.col(vec_id).alias("vec_id"), integers(F.col(vector)).alias("x"))
                    .where(F.col("x").isNotNull()))
    distinct = materialize(x.select("x").distinct())
    fits = fit(distinct, components=components)
    for dims, error in measure(distinct, fits).items():
        fits[dims].identity_error = error
    shared = rows.sparkSession.sparkContext.broadcast(fits)  # dims * components numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, values in _by_length(batch.column(1)):
                model = shared.value[values.shape[1]]
                offsets = model.offsets(values)
                z = model.whiten(offsets)
                take = z.shape[1]
                row = np.repeat(np.arange(len(own)), take)
                ids = batch.column(0).take(pa.array(own[row]))
                deviation = pa.array([str(v) for v in model.deviations(offsets)], pa.string()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, take + 1), len(own)), pa.int32()),
                     pa.array(np.full(len(row), model.n), pa.int64()), deviation, pa.array(z.ravel()),
                     pa.array(np.tile(model.explained, len(own))), pa.array(np.full(len(row), model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, "
                             "identity_error double")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's ``deviation`` is a long; one that exceeds it raises."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return whiten(rows).withColumn("deviation", F.col("deviation").cast("long"))
