"""Merkle manifest of a dataset, with octopus multiproofs.

A row's leaf is the digest of its columns.  The leaves of one group (its
``source``), ordered by id, form a tree: every three neighbours become one
node, level by level, until one is left, the group's subroot.  The subroots,
ordered by group, form the root tree in the same way.

Build.  Leaves are numbered in (group, id) order by a range sort, so a group
that holds most rows spans many partitions.  A task takes aligned blocks of
``3 ** TIER`` leaves of a tree and builds all levels inside its block; the block
tops are the next tier's leaves (three tiers reach 10 ** 11 leaves).  All nodes
are kept in a table ``(tree, level, pos, digest)``.

Proofs.  Wanted leaves are dealt out in partitions that follow the leaf order.
Each partition works out the coordinates it lacks: going up from its leaves it
joins neighbours that it can derive itself and notes only the others, so the
set is minimal and shared by all its leaves.  One join with the node table
fetches them.  The partition then derives the interiors that its leaves share
and expands each leaf's own proof from them: the siblings on its way to the
root, and the root that a given leaf digest folds to.

Texts are digested where they are read and never shuffled.  A partition holds
at most ``PART`` leaves and a few fetched nodes a level.

Defined cases.  Null columns enter the digest as ``-``, unlike empty texts.  A
null group is a group of its own and comes first, as do null ids in a group.
Rows that share an id are ordered by their leaf; equal rows are leaves of
their own.  An empty table has no root and gives an empty result.  Further
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

FAN = 3
#: Levels that one task builds from one block.
TIER = 8
#: Wanted leaves of one partition.
PART = 8192
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The root tree's name among the trees, which are named by their first leaf's number.
ROOT = -1
#: Room for positions beside the tree's local number in one integer.
SHIFT = 1 << 42

_NODES = pa.schema([("tree", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("level", pa.int32()),
                    ("pos", pa.int64()), ("digest", pa.string())])
_NODES_DDL = "tree long, place long, size long, level int, pos long, digest string"


def digest_of(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself."""
    def coded(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[coded(v) for v in values]), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, written in that order, with their ``number`` from 0 on."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("slice", F.spark_partition_id()).withColumn("place_in", F.monotonically_increasing_id()))
    sizes = sorted(ranged.groupBy("slice").agg(F.count("*"), F.min("place_in")).collect())  # one row a partition
    starts, total = [], 0
    for part, size, first in sizes:
        starts.append((part, total - first))
        total += size
    shift = spark.createDataFrame(starts, "slice int, shift long")
    return (ranged.join(F.broadcast(shift), "slice").withColumn("number", F.col("place_in") + F.col("shift"))
            .drop("slice", "place_in", "shift"))


def size_at(size: np.ndarray, level: int) -> np.ndarray:
    """Nodes of trees with ``size`` leaves at a level."""
    return -(-size // FAN ** level)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _blocks(level: int, tier: int):
    """Arrow function: all nodes above one tier's rows, which come in (tree,
    block, pos) order; a block never straddles two portions."""
    def build(tree: np.ndarray, place: np.ndarray, size: np.ndarray, pos: np.ndarray, digest: list[str]) -> pa.RecordBatch:
        out: list[tuple] = []
        if level == 0:
            own = np.flatnonzero(size == 1)  # a lone leaf is its tree's subroot
            out.append((tree[own], place[own], size[own], np.zeros(len(own), np.int32), pos[own], [digest[i] for i in own]))
        for up in range(level + 1, level + tier + 1):
            live = np.flatnonzero(size_at(size, up - 1) > 1)
            if not len(live):
                break
            tree, place, size, pos = tree[live], place[live], size[live], pos[live] // FAN
            kids = [digest[i] for i in live]
            first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (pos[1:] != pos[:-1])))
            ends = np.append(first[1:], len(kids)).tolist()
            digest = [_sha("".join(kids[a:b])) for a, b in zip(first.tolist(), ends)]
            tree, place, size, pos = tree[first], place[first], size[first], pos[first]
            out.append((tree, place, size, np.full(len(tree), up, np.int32), pos, digest))
        if not out:
            return pa.RecordBatch.from_pylist([], _NODES)
        columns = [np.concatenate([o[i] for o in out]) for i in range(5)]
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array([d for o in out for d in o[5]], pa.string())],
                                          schema=_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tree, block = held.column("tree").to_numpy(), held.column("pos").to_numpy() // FAN ** tier
            whole = np.flatnonzero((tree != tree[-1:]) | (block != block[-1:]))  # rows before the last block
            if len(whole):
                cut = int(whole[-1]) + 1
                yield build(*_columns(held.slice(0, cut)))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield build(*_columns(held))

    def _columns(table: pa.Table) -> tuple:
        return (*[table.column(c).to_numpy() for c in ("tree", "place", "size", "pos")], table.column("digest").to_pylist())
    return run


def interiors(leaves: DataFrame, largest: int, tier: int = TIER) -> DataFrame:
    """All nodes above ``leaves`` (``tree, place, size, pos, digest``), where
    the largest tree has ``largest`` leaves; lone leaves are nodes, too."""
    rows, found, level = leaves.select("tree", "place", "size", "pos", "digest"), None, 0
    while True:
        sorted_rows = (rows.withColumn("block", F.expr(f"pos div {FAN ** tier}L")).repartition("tree", "block")
                       .sortWithinPartitions("tree", "block", "pos").drop("block"))
        nodes = materialize(sorted_rows.mapInArrow(_blocks(level, tier), _NODES_DDL))
        found = nodes if found is None else found.unionByName(nodes)
        level += tier
        if FAN ** level >= largest:
            return found
        rows = nodes.where((F.col("level") == level) & (F.col("size") > FAN ** level))


@dataclass
class Manifest:
    """``leaves``: number, id, group, leaf and the leaf's place (``tree, pos,
    size, place``); ``nodes``: the interiors of all trees; ``root``: None for
    an empty table; ``trees``: how many groups there are."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    trees: int

    def all_nodes(self) -> DataFrame:
        names = ["tree", "level", "pos", "digest"]
        return (self.nodes.where((F.col("level") > 0) | (F.col("tree") == ROOT)).select(*names)
                .unionByName(self.leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"))))


def build(rows: DataFrame, doc_id: str = "doc_id", group: str = "source", leaf: Column | None = None,
          tier: int = TIER, **further: Column) -> Manifest:
    """The manifest of ``rows``; ``further`` columns, over those of ``rows``,
    are carried along with the leaves."""
    leaf = digest_of([F.col(c) for c in COLUMNS]) if leaf is None else leaf
    own = materialize(rows.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("group"), leaf.alias("leaf"),
                                  *[c.alias(n) for n, c in further.items()]).withColumn("tie", F.monotonically_increasing_id()))
    ordered = numbered(own, "group", "doc_id", "leaf", "tie").drop("tie")
    groups = ordered.groupBy("group").agg(F.min("number").alias("tree"), F.count("*").alias("size"))
    groups = materialize(numbered(groups, "tree").withColumnRenamed("number", "place"))
    trees, largest = groups.agg(F.count("*"), F.max("size")).first()
    leaves = materialize(ordered.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
                         .withColumn("pos", F.col("number") - F.col("tree")).drop("of"))
    if not trees:
        return Manifest(leaves, rows.sparkSession.createDataFrame([], _NODES_DDL), None, 0)
    nodes = interiors(leaves.withColumnRenamed("leaf", "digest"), largest, tier)
    subroots = nodes.where(F.expr(f"size <= power({FAN}, level)"))
    top = interiors(subroots.select(F.lit(ROOT).cast("long").alias("tree"), F.lit(0).cast("long").alias("place"),
                                    F.lit(trees).cast("long").alias("size"), F.col("place").alias("pos"), "digest"), trees, tier)
    # the root tree's own leaves are nodes that others fetch
    bottom = subroots.select(F.lit(ROOT).cast("long").alias("tree"), F.lit(0).cast("long").alias("place"),
                             F.lit(trees).cast("long").alias("size"), F.lit(0).alias("level"), F.col("place").alias("pos"), "digest")
    everything = nodes.unionByName(top.where(F.col("level") > 0)).unionByName(bottom)
    last = top.where(F.expr(f"size <= power({FAN}, level)")).select("digest").first()
    return Manifest(leaves, everything, last[0], trees)


def climb(tree: np.ndarray, size: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
    """Level by level: ``(known, tree, pos, children, missing)``.

    ``tree`` holds local tree numbers, ``known`` the nodes at hand as
    ``tree * SHIFT + pos``, ``children`` all nodes of that level that its
    parents need (-1 where a run is short), one row a parent, and ``missing``
    marks those not at hand."""
    order = np.unique(tree * SHIFT + pos)
    sizes = np.zeros(int(tree.max()) + 1, np.int64)
    sizes[tree] = size
    level = 0
    while True:
        of, at = order // SHIFT, order % SHIFT
        live = size_at(sizes[of], level) > 1
        order, of, at = order[live], of[live], at[live]
        if not len(order):
            return
        parent = np.unique(of * SHIFT + at // FAN)
        of, at = parent // SHIFT, parent % SHIFT
        kid = at[:, None] * FAN + np.arange(FAN)
        children = np.where(kid < size_at(sizes[of], level)[:, None], of[:, None] * SHIFT + kid, -1)
        missing = (children >= 0) & ~np.isin(children, order)
        yield parent, children, missing
        order, level = parent, level + 1


def _places(table: pa.Table) -> tuple:
    """(names of the trees, local tree numbers, sizes, positions, places)."""
    names, local = np.unique(table.column("tree").to_numpy(), return_inverse=True)
    return names, local, *[table.column(c).to_numpy() for c in ("size", "pos", "place")]


def _lacking(trees: int):
    """Arrow function: the coordinates that one partition of leaves lacks."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, local, size, pos, place = _places(table)
        found: list[tuple] = []
        for level, (_, children, missing) in enumerate(climb(local, size, pos)):
            want = children[missing]
            found.append((names[want // SHIFT], np.full(len(want), level, np.int32), want % SHIFT))
        zero = np.zeros(len(place), np.int64)
        for level, (_, children, missing) in enumerate(climb(zero, zero + trees, place)):
            want = children[missing]
            found.append((np.full(len(want), ROOT, np.int64), np.full(len(want), level, np.int32), want))
        tree, level, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"part": pa.array(np.full(len(tree), key[0].as_py(), np.int64)), "tree": pa.array(tree, pa.int64()),
                         "level": pa.array(level, pa.int32()), "pos": pa.array(at, pa.int64())})
    return run


class _Grove:
    """The part of the trees that one partition can derive."""

    def __init__(self, local: np.ndarray, size: np.ndarray, pos: np.ndarray, digest: dict[int, str],
                 fetched: dict[tuple[int, int], str]) -> None:
        #: per level: node -> (siblings before, siblings after)
        self.beside: list[dict[int, tuple[str, str]]] = []
        at_hand = digest
        for level, (parents, children, missing) in enumerate(climb(local, size, pos)):
            beside: dict[int, tuple[str, str]] = {}
            above: dict[int, str] = {}
            for parent, kids, gaps in zip(parents.tolist(), children.tolist(), missing.tolist()):
                run = [fetched[level, k] if gap else at_hand[k] for k, gap in zip(kids, gaps) if k >= 0]
                above[parent] = _sha("".join(run))
                for i, (k, gap) in enumerate(zip(kids, gaps)):
                    if k >= 0 and not gap:
                        beside[k] = ("".join(run[:i]), "".join(run[i + 1:]))
            self.beside.append(beside)
            at_hand = above
        #: per level: node -> its siblings and those of all nodes above it
        self.proofs: list[dict[int, str]] = [{} for _ in range(len(self.beside) + 1)]
        for level in range(len(self.beside) - 1, -1, -1):
            higher = self.proofs[level + 1]
            for k, (before, after) in self.beside[level].items():
                parent = k // SHIFT * SHIFT + k % SHIFT // FAN
                self.proofs[level][k] = before + after + higher.get(parent, "")

    def proof(self, node: int) -> str:
        return self.proofs[0].get(node, "")

    def fold(self, node: int, digest: str) -> str:
        """The tree's top that follows from ``digest`` in place of the leaf."""
        for beside in self.beside:
            found = beside.get(node)
            if found is None:
                break
            digest = _sha(found[0] + digest + found[1])
            node = node // SHIFT * SHIFT + node % SHIFT // FAN
        return digest


def _expand(trees: int, carried: Sequence[str]):
    """Arrow function: the proofs of one partition's leaves."""
    def run(key: tuple, table: pa.Table, nodes: pa.Table) -> pa.Table:
        names, local, size, pos, place = _places(table)
        number = {int(n): i for i, n in enumerate(names)}
        fetched: dict[tuple[int, int], str] = {}
        root_fetched: dict[tuple[int, int], str] = {}
        for tree, level, at, digest in zip(*[nodes.column(c).to_pylist() for c in ("tree", "level", "pos", "digest")]):
            if tree == ROOT:
                root_fetched[level, at] = digest
            else:
                fetched[level, number[tree] * SHIFT + at] = digest
        at = (local * SHIFT + pos).tolist()
        leaf, other = table.column("leaf").to_pylist(), table.column("other").to_pylist()
        grove = _Grove(local, size, pos, dict(zip(at, leaf)), fetched)
        top = [grove.fold(a, d) for a, d in zip(at, leaf)]
        zero = np.zeros(len(place), np.int64)
        spots = place.tolist()
        crown = _Grove(zero, zero + trees, place, dict(zip(spots, top)), root_fetched)
        proofs = [_sha(grove.proof(a) + crown.proof(p)) for a, p in zip(at, spots)]
        folded = [crown.fold(p, t if o is None else grove.fold(a, o)) for a, p, t, o in zip(at, spots, top, other)]
        return pa.table([*[table.column(c) for c in carried], table.column("leaf"), pa.array(top, pa.string()),
                         pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                        names=[*carried, "leaf", "subroot", "proof_sha256", "folded_root"])
    return run


def multiproofs(manifest: Manifest, wanted: DataFrame, other: str | None = None, keep: Sequence[str] = ("doc_id",),
                part: int = PART) -> DataFrame:
    """``keep``, ``leaf, subroot, root, proof_sha256, folded_root, verified``
    for the ``wanted`` rows of ``manifest.leaves`` (any of them).

    ``other`` names a column with another leaf digest to be folded in place
    of the leaf where it is not null; ``verified`` says whether the folded
    root is the manifest's."""
    rows = wanted.select(*keep, "leaf", (F.lit(None).cast("string") if other is None else F.col(other)).alias("other"),
                         "tree", "pos", "size", "place", F.expr(f"number div {part}L").alias("part"))
    lacking = (rows.select("part", "tree", "pos", "size", "place").groupBy("part")
               .applyInArrow(_lacking(manifest.trees), "part long, tree long, level int, pos long"))
    fetched = lacking.join(manifest.all_nodes(), ["tree", "level", "pos"])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in keep], "leaf string, subroot string, proof_sha256 string, folded_root string"])
    out = rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_expand(manifest.trees, keep), schema)
    return (out.withColumn("root", F.lit(manifest.root).cast("string"))
            .withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root"))))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", "\n", "")
    tampered = digest_of([F.col(c) for c in COLUMNS[:-1]] + [text])
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    manifest = build(documents(spark, sf_dir).select(*COLUMNS), other=F.when(even, tampered))
    return (multiproofs(manifest, manifest.leaves, "other")
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))


_H = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in COLUMNS)
_TAMPERED = _H.replace("|| text END", "|| replace(text, chr(10), '') END").replace(
    "strlen(text::VARCHAR)", "strlen(replace(text, chr(10), ''))")


def _crc32_sql(text: str) -> str:
    """DuckDB text of the parity of the unsigned crc32 of a decimal number:
    the checksum is linear, so its last bit is the parity of fixed input bits
    and of a constant for the length.  Both come from zlib, per digit place."""
    import zlib
    longest = 20
    pieces = []
    for size in range(1, longest + 1):
        zero = zlib.crc32(b"0" * size) & 1
        terms = []
        for i in range(size):
            odd = [d for d in "0123456789-" if (zlib.crc32(b"0" * i + d.encode() + b"0" * (size - 1 - i)) & 1) != zero]
            if odd:
                terms.append(f"CAST(substr({text}, {i + 1}, 1) IN ({', '.join(repr(o) for o in odd)}) AS INTEGER)")
        pieces.append(f"WHEN {size} THEN ({' + '.join([str(zero), *terms])}) % 2")
    return f"CASE length({text}) {' '.join(pieces)} END"


OP12_SQL = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, sha256({_H}) AS leaf,
         CASE WHEN {_crc32_sql('doc_id::VARCHAR')} = 0 THEN sha256({_TAMPERED}) ELSE sha256({_H}) END AS other
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS place
  FROM own
), up AS (
  SELECT place, 0 AS level, pos, n, leaf AS d FROM leaves
  UNION ALL
  SELECT place, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1
  GROUP BY place, level, pos // 3, n
), subroots AS (SELECT place, d, count(*) OVER () AS n FROM up WHERE n = 1),
crown AS (
  SELECT 0 AS level, place AS pos, n, d FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM crown WHERE n > 1
  GROUP BY level, pos // 3, n
), beside AS (
  SELECT place, level, pos,
         coalesce(string_agg(d, '') OVER (PARTITION BY place, level, pos // 3 ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') OVER (PARTITION BY place, level, pos // 3 ORDER BY pos
                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT place, level, pos, n, d FROM up UNION ALL SELECT -1, level, pos, n, d FROM crown) WHERE n > 1
), way AS (
  SELECT place, pos AS leaf_pos, 0 AS level, pos, '' AS proof, other AS d, false AS at_crown FROM leaves
  UNION ALL
  SELECT w.place, w.leaf_pos, CASE WHEN b.level IS NULL THEN 0 ELSE w.level + 1 END,
         CASE WHEN b.level IS NULL THEN w.place ELSE w.pos // 3 END, w.proof || coalesce(b.l || b.r, ''),
         CASE WHEN b.level IS NULL THEN w.d ELSE sha256(b.l || w.d || b.r) END, w.at_crown OR b.level IS NULL
  FROM way w LEFT JOIN beside b ON b.place = CASE WHEN w.at_crown THEN -1 ELSE w.place END
       AND b.level = w.level AND b.pos = w.pos
  WHERE NOT w.at_crown OR b.level IS NOT NULL
), ends AS (
  SELECT place, leaf_pos, arg_max(proof, level) AS proof, arg_max(d, level) AS folded FROM way WHERE at_crown
  GROUP BY place, leaf_pos
)
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = r.d AS verified
FROM leaves l JOIN ends e ON l.place = e.place AND l.pos = e.leaf_pos JOIN subroots s ON s.place = l.place
     CROSS JOIN (SELECT d FROM crown WHERE n = 1) r
"""
