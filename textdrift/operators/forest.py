"""Isolation forest (Liu, Ting & Zhou, 2008) as Spark jobs (M4).

1. Sampling: one hash per row says which trees take it (geometric skips, chance
   1.5 psi / n per tree); only those pairs are made, and a row-number cut in
   hash order keeps at most ``psi`` rows per tree, so a tree's group is bounded
   by ``psi`` whatever the table size.
2. Building: ``groupBy(tree).applyInPandas`` grows one tree per group with
   random features and uniform split points (seeded by the tree number).
3. Scoring: the forest has at most ``trees * (2 psi - 1)`` nodes, a bound
   set by the parameters alone, so it is broadcast; ``mapInPandas`` walks every
   row through every tree in numpy batches.
4. Labels: rows whose score is above the ``1 - contamination`` quantile of
   all scores get -1 (anomaly), others 1.  The exact quantile is read from
   distributed ranks (no single aggregation buffer holds all scores).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textdrift.operators.corpus import hash_u32, taken_by

NODE_SCHEMA = ("tree int, node int, feature int, split double, left int, right int, "
               "size long, leaf boolean, depth int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(tree: int, x: np.ndarray, max_depth: int, rng: np.random.Generator) -> list:
    nodes = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (tree, me, -1, 0.0, -1, -1, len(idx), True, depth)
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[me] = (tree, me, -1, 0.0, -1, -1, len(idx), True, depth)
            return me
        f = int(rng.choice(usable))
        split = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < split
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[me] = (tree, me, f, split, left, right, len(idx), False, depth)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _builder(features: Sequence[str], max_depth: int, seed: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[list(features)].to_numpy(float)
        rng = np.random.default_rng([seed, tree])
        cols = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        return pd.DataFrame(_grow(tree, x, max_depth, rng), columns=cols)
    return fn


def build_forest(df: DataFrame, features: Sequence[str], id_col: str, trees: int = 100,
                 psi: int = 256, seed: int = 42) -> tuple[DataFrame, int]:
    """Steps 1-2: node table of the forest and the effective sample size."""
    n = df.count()
    psi_eff = min(psi, n)
    p = min(1.0, 1.5 * psi_eff / max(n, 1))
    sampled = df.select(id_col, *features, F.explode(taken_by(id_col, trees, p, seed)).alias("tree"))
    u = (hash_u32(id_col, "tree", seed=seed).cast("double") + 0.5) / 4294967296.0
    sampled = sampled.withColumn("_u", u)
    w = Window.partitionBy("tree").orderBy("_u")
    sampled = sampled.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi_eff)
    max_depth = max(1, math.ceil(math.log2(max(psi_eff, 2))))
    nodes = sampled.groupBy("tree").applyInPandas(_builder(features, max_depth, seed), NODE_SCHEMA)
    return nodes, psi_eff


def _scorer(forest: pd.DataFrame, features: Sequence[str], psi: int, keep: Sequence[str]):
    trees = []
    for _, t in forest.groupby("tree"):
        t = t.sort_values("node")
        leaf_len = np.array([d + c_factor(s) for d, s in zip(t["depth"], t["size"])])
        trees.append((t["feature"].to_numpy(), t["split"].to_numpy(), t["left"].to_numpy(),
                      t["right"].to_numpy(), t["leaf"].to_numpy(), leaf_len))
    cn = c_factor(psi)

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = pdf[list(features)].to_numpy(float)
            total = np.zeros(len(x))
            for feat, split, left, right, leaf, leaf_len in trees:
                node = np.zeros(len(x), dtype=np.int64)
                active = ~leaf[node]
                while active.any():
                    f = feat[node[active]]
                    go_left = x[active, f] < split[node[active]]
                    node[active] = np.where(go_left, left[node[active]], right[node[active]])
                    active = ~leaf[node]
                total += leaf_len[node]
            mean_h = total / max(len(trees), 1)
            out = pdf[list(keep)].copy()
            out["path_length"] = mean_h
            out["score"] = np.power(2.0, -mean_h / cn) if cn > 0 else 0.5
            yield out
    return fn


def isolation_forest(df: DataFrame, features: Sequence[str], id_col: str,
                     keep: Sequence[str] = (), trees: int = 100, psi: int = 256,
                     contamination: float = 0.1, seed: int = 42,
                     exact_quantile: bool = True) -> DataFrame:
    """M4: ``keep + (path_length, score, anomaly_score)``; anomaly_score is -1
    for the top ``contamination`` share of scores, else 1."""
    nodes, psi_eff = build_forest(df, features, id_col, trees, psi, seed)
    forest = nodes.toPandas()  # at most trees * (2 * psi - 1) rows
    keep = list(dict.fromkeys([id_col, *keep]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
                       + ["path_length double", "score double"])
    scored = df.mapInPandas(_scorer(forest, features, psi_eff, keep), schema)
    q = 1.0 - contamination
    if exact_quantile:
        # distributed exact quantile: ranks from a range-partitioned sort
        from textdrift.operators.stats import exact_quantile as _exact
        from textdrift.session import materialize
        scored = materialize(scored)
        thr = _exact(scored, "score", q, id_col).select(F.col("quantile").alias("_cut"))
    else:
        thr = scored.agg(F.percentile_approx("score", q, 100000).cast("double").alias("_cut"))
    out = scored.crossJoin(F.broadcast(thr))
    return out.withColumn("anomaly_score", F.when(F.col("score") > F.col("_cut"), -1).otherwise(1)) \
        .drop("_cut")
