"""Embedding near-duplicates by NN-descent.

1. Vectors equal bit for bit are one node with a multiplicity.
2. Each node starts with the best neighbours among the rows that a few random
   hyperplane codes place next to it.
3. Local join: every node introduces its neighbours, and the nodes that list
   it, to each other; a pair in which one member is new to the list is compared
   and offered to both lists, which keep the best ``k``.  This is repeated
   until few entries change.
4. Pairs at the threshold or above are links; linked nodes form components.
5. A list all of whose entries are links is saturated: the node may have more.
   Lists in components with such a node are enlarged to the whole component,
   whose members are compared with each other in blocks, and only counts leave
   a block.  Links between components can be missing only if both ends are
   saturated; these nodes are compared across components, except where the
   triangle inequality rules a link out.
6. Audit: the links of a bounded, hashed sample of nodes (of those in dense
   components, in other components, and without links) are counted by brute
   force against all nodes, in blocks.  The recall is the share of nodes whose
   count is complete, for dense components and for the rest; if either is
   below ``recall`` the search is repeated
   with twice the starting codes, on top of the lists so far; if ``MOST_CODES``
   are not enough, all nodes are compared with each other in blocks.

A group of rows that are compared with each other is cut into chunks of
bounded size, so no task holds an unbounded group.

Defined cases.  Null vectors, zero vectors, vectors with null or non-finite
components, and vectors of another length than most are not compared: no
links, a component of their own.  Rows without an id have null results for
their component and are not compared.  Repeated rows are links of each other;
rows that share an id are one vector, the smallest.  Further columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import find_components, materialize, sources_of

THRESHOLD = 0.95
NEIGHBOURS = 16
CODES = 6
RECALL = 0.98
MOST_CODES = 96
ROUNDS = 12
#: Rows compared with each other at once; nodes checked by brute force.
CHUNK = 256
AUDIT = 400

_EDGE = "u long, w long, sim double"


def _table(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as numpy; a list column as a matrix."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(column), -1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str], most: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows that share ``keys``, from batches sorted by them, at most ``most``
    at a time."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = _table(batch)
        if held is not None:
            t = {k: np.concatenate([held[k], t[k]]) for k in t}
        n = len(t[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= t[k][1:] != t[k][:-1]
        cut = np.flatnonzero(new).tolist()
        begin = 0
        for end in cut:
            for s in range(begin, end, most):
                yield {k: v[s:min(end, s + most)] for k, v in t.items()}
            begin = end
        while n - begin > most:
            yield {k: v[begin:begin + most] for k, v in t.items()}
            begin += most
        held = {k: v[begin:] for k, v in t.items()}
    if held is not None and len(held[keys[0]]):
        yield held


def _edges(u: list, w: list, sim: list) -> pa.RecordBatch:
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0, kind))
    return pa.RecordBatch.from_arrays([cat(u, np.int64), cat(w, np.int64), cat(sim, float)], names=["u", "w", "sim"])


def _gathered(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    u, w, sim, n = [], [], [], 0
    for a, b, s in parts:
        u.append(a)
        w.append(b)
        sim.append(s)
        n += len(a)
        if n >= rows:
            yield _edges(u, w, sim)
            u, w, sim, n = [], [], [], 0
    if n:
        yield _edges(u, w, sim)


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(members ``vec_id, node``, nodes ``id, copies, v``): unit vectors in
    double precision, one node per distinct vector."""
    rows = sources_of(vectors, vec_id, embedding).select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    fine = (F.col("vec_id").isNotNull() & F.col("raw").isNotNull() & ~F.exists("raw", lambda x: x.isNull() | F.isnan(x))
            & (F.col("norm") > 0) & (F.col("norm") < float("inf")))
    rows = rows.withColumn("norm", norm).where(F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("raw", "norm")).alias("r")).select("vec_id", "r.raw", "r.norm")
    rows = materialize(rows)
    usual = rows.groupBy(F.size("raw").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        empty = rows.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), F.col("raw").alias("v"))
        return rows.select("vec_id", F.col("vec_id").alias("node")), empty
    rows = rows.where(F.size("raw") == usual["d"]).withColumn("v", F.transform("raw", lambda x: x / F.col("norm"))).withColumn(
        "key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    nodes = materialize(rows.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")))
    members = materialize(rows.select("vec_id", "key").join(nodes.select("key", F.col("id").alias("node")), "key").select("vec_id", "node"))
    return members, nodes.select("id", "copies", "v")


def starting_pairs(nodes: DataFrame, n: int, k: int, codes: range, chunk: int = CHUNK) -> DataFrame:
    """The best ``k`` of each chunk of rows with neighbouring codes."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / 64)))))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            t = _table(batch)
            if not len(t["id"]):
                continue
            for c in codes:
                if c not in planes:
                    planes[c] = np.random.default_rng(c).standard_normal((t["v"].shape[1], bits + 1))
                side = t["v"] @ planes[c]
                place = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) + (np.int64(c) << 48)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(side[:, bits]), batch.column(0), batch.column(1)],
                                                 names=["place", "along", "id", "v"])

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for g in _groups(batches, ["place"], chunk):
                m = len(g["id"])
                if m < 2:
                    continue
                sim = g["v"] @ g["v"].T
                np.fill_diagonal(sim, -2)
                top = np.argpartition(-sim, min(k, m - 1) - 1, axis=1)[:, :min(k, m - 1)]
                yield np.repeat(g["id"], top.shape[1]), g["id"][top].ravel(), np.take_along_axis(sim, top, 1).ravel()
        yield from _gathered(parts())

    coded = nodes.select("id", "v").mapInArrow(code, "place long, along double, id long, v array<double>")
    return coded.repartition("place").sortWithinPartitions("place", "along").mapInArrow(near, _EDGE)


def best(offers: DataFrame, k: int) -> DataFrame:
    """``u, w, sim, fresh, worst``: the best ``k`` offers of each node, the
    similarity of its worst (-2 while its list is not full)."""
    one = offers.groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "w")
    kept = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    worst = F.max(F.when(F.col("rank") == k, F.col("sim"))).over(Window.partitionBy("u"))
    return kept.withColumn("worst", F.coalesce(worst, F.lit(-2.0))).drop("rank")


def introductions(lists: DataFrame, nodes: DataFrame, chunk: int = 64) -> DataFrame:
    """The local join: pairs worth offering, both ways."""
    limits = lists.select(F.col("u").alias("m"), "worst").distinct()
    forward = lists.select(F.col("u").alias("centre"), F.col("w").alias("m"), "fresh")
    reverse = lists.select(F.col("w").alias("centre"), F.col("u").alias("m"), "fresh")
    both = forward.unionByName(reverse).groupBy("centre", "m").agg(F.max("fresh").alias("fresh"))
    met = (both.join(nodes.select(F.col("id").alias("m"), "v"), "m").join(limits, "m", "left")
           .select("centre", "m", "fresh", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "v"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for g in _groups(batches, ["centre"], chunk):
                new = g["fresh"].astype(bool)
                if len(new) < 2 or not new.any():
                    continue
                sim = g["v"] @ g["v"].T
                useful = (new[:, None] | new[None, :]) & (sim > g["worst"][:, None])
                np.fill_diagonal(useful, False)
                a, b = np.nonzero(useful)
                yield g["m"][a], g["m"][b], sim[a, b]
        yield from _gathered(parts())

    return met.repartition("centre").sortWithinPartitions("centre").mapInArrow(meet, _EDGE)


def descend(nodes: DataFrame, n: int, lists: DataFrame | None, k: int, codes: range, rounds: int = ROUNDS,
            little: float = 0.001) -> DataFrame:
    """Neighbour lists after starting from ``codes`` (and ``lists``)."""
    offers = starting_pairs(nodes, n, k, codes).withColumn("fresh", F.lit(True))
    if lists is not None:
        offers = offers.unionByName(lists.select("u", "w", "sim", F.lit(False).alias("fresh")))
    lists = materialize(best(offers, k))
    for _ in range(rounds):
        changed = lists.where("fresh").count()
        if changed <= little * n * k:
            break
        offers = introductions(lists, nodes).withColumn("fresh", F.lit(True))
        lists = materialize(best(offers.unionByName(lists.select("u", "w", "sim", F.lit(False).alias("fresh"))), k))
    return lists


def _to_pairs(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Every row once for each pair ``lo, hi`` of blocks that its block
    ``own`` is in."""
    return (rows.withColumn("own", F.pmod(F.xxhash64(key), blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors, from their similarities."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a, b)))


def cross_links(full: DataFrame, threshold: float, chunk: int = 512) -> DataFrame | None:
    """Links between saturated nodes (``component, id, copies, v``) of
    different components: ``id, links, component, other``, or None if there
    are no components near enough.

    A component lies in a ball about one of its members.  Balls further apart
    than a link can be long have no links, nor has a member that is so far
    from the other ball; what is left is compared in blocks."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    centres = (full.groupBy("component").agg(F.min(F.struct("id", "v")).alias("c"))
               .select(F.col("component").alias("ball"), F.col("c.v").alias("centre")))

    def far(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _table(batch)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_distance(t["v"], t["centre"]))], names=["component", "far"])

    radius = (full.join(centres, F.col("component") == F.col("ball")).select("component", "v", "centre")
              .mapInArrow(far, "component long, far double").groupBy("component").agg(F.max("far").alias("radius")))
    balls = materialize(centres.join(radius, F.col("ball") == F.col("component")).select("ball", "centre", "radius"))
    n = balls.count()
    if n < 2:
        return None

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["lo", "hi"], 1 << 30):  # two blocks at most
            left, right = g["own"] == g["lo"][0], g["own"] == g["hi"][0]
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * (g["centre"][left] @ g["centre"][right].T)))
            a, b = np.nonzero(gap <= g["radius"][left][:, None] + g["radius"][right][None, :] + reach)
            a, b = g["ball"][left][a], g["ball"][right][b]
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    pairs = materialize(_to_pairs(balls, "ball", F.lit(-(-n // chunk))).repartition("lo", "hi").sortWithinPartitions("lo", "hi")
                        .select("lo", "hi", "own", "ball", "centre", "radius").mapInArrow(close, "a long, b long").distinct())
    if pairs.isEmpty():
        return None
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    towards = both.join(balls, F.col("b") == F.col("ball")).select("a", "b", "centre", "radius")

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = _table(batch)
                yield batch.filter(pa.array(_distance(t["v"], t["centre"]) <= t["radius"] + reach)).select(["a", "b", "id", "copies", "v"])

    sides = materialize(full.join(towards, F.col("component") == F.col("a")).select("a", "b", "id", "copies", "v", "centre", "radius")
                        .mapInArrow(near, "a long, b long, id long, copies long, v array<double>")
                        .select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), (F.col("a") < F.col("b")).alias("left"),
                                "id", "copies", "v"))
    blocks = lambda side: F.ceil(F.sum(side.cast("long")) / chunk).cast("int")
    size = sides.groupBy("p", "q").agg(blocks(F.col("left")).alias("p_blocks"), blocks(~F.col("left")).alias("q_blocks"))
    size = size.where("p_blocks > 0 and q_blocks > 0")
    dealt = (sides.join(size, ["p", "q"])
             .withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("left"), F.col("p_blocks")).otherwise(F.col("q_blocks"))))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("q_blocks")).otherwise(F.col("p_blocks")) - 1)))
             .select("p", "q", F.when(F.col("left"), F.col("own")).otherwise(F.col("other")).cast("long").alias("lo"),
                     F.when(F.col("left"), F.col("other")).otherwise(F.col("own")).cast("long").alias("hi"), "left", "id", "copies", "v"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["p", "q", "lo", "hi"], 1 << 30):  # two blocks at most
            left = g["left"].astype(bool)
            links = (g["v"][left] @ g["v"][~left].T >= threshold).astype(np.int64)
            ids = np.concatenate([g["id"][left], g["id"][~left]])
            n = np.concatenate([links @ g["copies"][~left], g["copies"][left] @ links])
            own = np.where(np.arange(len(ids)) < left.sum(), g["p"][0], g["q"][0])
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, n, own, g["p"][0] + g["q"][0] - own)],
                                             names=["id", "links", "component", "other"])

    return materialize(dealt.repartition("p", "q", "lo", "hi").sortWithinPartitions("p", "q", "lo", "hi")
                       .mapInArrow(compare, "id long, links long, component long, other long"))


def exact_links(nodes: DataFrame, n: int, threshold: float, chunk: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The results of ``count_links``, by comparing all nodes in blocks."""
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["lo", "hi"], 1 << 30):  # two blocks at most
            left, right = g["own"] == g["lo"][0], g["own"] == g["hi"][0]
            a, b = g["id"][left], g["id"][right]
            links = (g["v"][left] @ g["v"][right].T >= threshold) & (a[:, None] != b[None, :])
            # the smallest node that is reached inside the two blocks
            top, low_a, low_b = np.iinfo(np.int64).max, a, b
            while links.any():
                new_a = np.minimum(low_a, np.where(links, low_b[None, :], top).min(axis=1))
                new_b = np.minimum(low_b, np.where(links, new_a[:, None], top).min(axis=0))
                same = (new_a == low_a).all() and (new_b == low_b).all()
                low_a, low_b = new_a, new_b
                if same:
                    break
            parts = [(a, links @ g["copies"][right], low_a)]
            if g["lo"][0] != g["hi"][0]:
                parts.append((b, g["copies"][left] @ links, low_b))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["id", "links", "low"])

    found = materialize(_to_pairs(nodes, "id", F.lit(max(1, -(-n // chunk)))).select("lo", "hi", "own", "id", "copies", "v")
                        .repartition("lo", "hi").sortWithinPartitions("lo", "hi")
                        .mapInArrow(compare, "id long, links long, low long").where("links > 0"))
    links = materialize(found.groupBy("id").agg(F.sum("links").alias("links")))
    component = materialize(find_components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))))
    return links, component.select(F.col("node").alias("id"), "component")


def count_links(lists: DataFrame, nodes: DataFrame, k: int, threshold: float, chunk: int = 512) -> tuple[DataFrame, DataFrame]:
    """(``id, links`` for nodes that have any, ``id, component, dense``).
    ``links`` counts other nodes with their multiplicity."""
    near = materialize(lists.where(F.col("sim") >= threshold))
    pairs = near.select("u", "w").unionByName(near.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct()
    component = materialize(find_components(near.select(F.col("u").alias("a"), F.col("w").alias("b"))))
    full = near.where(F.col("worst") >= threshold).select(F.col("u").alias("node")).distinct()
    dense = component.join(full, "node").select("component").distinct()
    counted = component.join(dense.withColumn("dense", F.lit(True)), "component", "left")
    counted = materialize(counted.select(F.col("node").alias("id"), "component", F.coalesce("dense", F.lit(False)).alias("dense")))
    copies = nodes.select(F.col("id").alias("w"), "copies")
    thin = (pairs.join(counted.where("not dense").select(F.col("id").alias("u")), "u").join(copies, "w")
            .groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("links")))
    # every member goes to all pairs of blocks that its block is in
    size = counted.where("dense").groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("int").alias("blocks"))
    members = (_to_pairs(counted.where("dense").join(size, "component").join(nodes, "id"), "id", F.col("blocks"))
               .select("component", "lo", "hi", "own", "id", "copies", "v"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["component", "lo", "hi"], 1 << 30):  # two blocks at most
            left = g["own"] == g["lo"][0]
            right = g["own"] == g["hi"][0]
            links = (g["v"][left] @ g["v"][right].T >= threshold).astype(np.int64)
            if g["lo"][0] == g["hi"][0]:
                np.fill_diagonal(links, 0)
                ids, n = g["id"][left], links @ g["copies"][right]
            else:
                ids = np.concatenate([g["id"][left], g["id"][right]])
                n = np.concatenate([links @ g["copies"][right], g["copies"][left] @ links])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "links"])

    thick = (members.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
             .mapInArrow(compare, "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))
    saturated = materialize(counted.join(full, F.col("id") == F.col("node")).join(nodes, "id").select("component", "id", "copies", "v"))
    cross = cross_links(saturated, threshold)
    if cross is None:
        return materialize(thin.unionByName(thick)), counted
    joined = find_components(cross.select("component", "other").distinct(), "component", "other")
    joined = joined.select(F.col("node").alias("old"), F.col("component").alias("whole"))
    counted = counted.join(joined, F.col("component") == F.col("old"), "left")
    links = thin.unionByName(thick).unionByName(cross.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    return materialize(links), materialize(counted.select("id", F.coalesce("whole", "component").alias("component"), "dense"))


def audit(links: DataFrame, component: DataFrame, nodes: DataFrame, threshold: float, most: int = AUDIT) -> tuple[float, float]:
    """The share of nodes with links whose count is complete, estimated apart
    for (thin components and nodes without a component, dense components).

    About ``most`` nodes of each of the two kinds and four times as many
    without links are drawn by hash and compared with every node, block by
    block; a kind counts by its size, not by its sample or its links."""
    kinds = (nodes.select("id").join(component, "id", "left").join(links, "id", "left")
             .select("id", F.when(F.col("dense"), F.lit("dense")).when(F.col("links") > 0, F.lit("thin")).otherwise(F.lit("none")).alias("kind"),
                     F.coalesce("links", F.lit(0)).alias("links")))
    kinds = materialize(kinds)
    sizes = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}  # three rows
    share = F.lit(0)
    for kind, size in sizes.items():
        wanted = most * (4 if kind == "none" else 1)
        share = F.when(F.col("kind") == kind, int(min(1.0, wanted / size) * (1 << 30))).otherwise(share)
    chosen = materialize(kinds.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < share).join(nodes.select("id", "v"), "id"))
    queries = chosen.select("id", "v").collect()  # about six times `most` rows
    if not queries:
        return 1.0, 1.0
    shared = nodes.sparkSession.sparkContext.broadcast(
        (np.array([q["id"] for q in queries]), np.array([q["v"] for q in queries])))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            t = _table(batch)
            for s in range(0, len(t["id"]), 4096):
                part = slice(s, s + 4096)
                hit = (t["v"][part] @ q.T >= threshold) & (t["id"][part, None] != ids[None, :])
                total += t["copies"][part] @ hit
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "there"])

    there = nodes.select("id", "copies", "v").mapInArrow(check, "id long, there long").groupBy("id").agg(F.sum("there").alias("there"))
    judged = (chosen.select("id", "kind", "links").join(there, "id").groupBy("kind")
              .agg(F.count("*").alias("drawn"), F.sum((F.col("there") > 0).cast("long")).alias("have"),
                   F.sum(((F.col("there") > 0) & (F.col("links") >= F.col("there"))).cast("long")).alias("complete")).collect())

    def recall(*names: str) -> float:
        have = sum(sizes[r["kind"]] / r["drawn"] * r["have"] for r in judged if r["kind"] in names)
        return sum(sizes[r["kind"]] / r["drawn"] * r["complete"] for r in judged if r["kind"] in names) / have if have else 1.0

    return recall("thin", "none"), recall("dense")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, codes: int = CODES,
                    recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    members, nodes = nodes_of(vectors, vec_id, embedding)
    n = nodes.count()
    lists, done = None, 0
    while True:
        lists = descend(nodes, n, lists, k, range(done, codes))
        links, component = count_links(lists, nodes, k, threshold)
        if min(audit(links, component, nodes, threshold)) >= recall:
            break
        if codes >= MOST_CODES:
            links, component = exact_links(nodes, n, threshold)
            break
        done, codes = codes, 2 * codes
    per_node = (nodes.select("id", "copies").join(links, "id", "left").join(component, "id", "left")
                .select(F.col("id").alias("node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "id").alias("component_id")))
    per_node = materialize(per_node)
    known = members.join(per_node, "node").select(F.col("vec_id").alias("known_id"), "n_links", "component_id")
    return (sources_of(vectors, vec_id).select(F.col(vec_id).alias("vec_id"))
            .join(known, F.col("vec_id") == F.col("known_id"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
