"""Isolation forest on feature arrays.

Fit: one hash a row picks a pool of about twice ``n_trees * max_samples`` rows (all, if
there are fewer); within the pool each tree keeps the ``max_samples`` rows with the
smallest hash of (tree, row). Each tree is grown in one ``applyInPandas`` group with numpy
and emitted as a node table.

Score: the node table holds at most ``n_trees * (2 * max_samples - 1)`` rows,
a bound fixed by the parameters, so it is shipped to the executors inside a
vectorised ``pandas_udf`` that walks all trees for a whole Arrow batch.
score = -2^(-E[h(x)] / c(max_samples)); decision = score - offset, where the
offset is the exact ``contamination`` quantile of training scores (between two
scores linear); anomaly iff decision < 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from carelake.operators.sampling import exact_quantile, hash01
from carelake.session import written

EULER = 0.5772156649015329
NODE_SCHEMA = TT.StructType([
    TT.StructField("tree", TT.IntegerType()), TT.StructField("node", TT.IntegerType()),
    TT.StructField("feature", TT.IntegerType()), TT.StructField("threshold", TT.DoubleType()),
    TT.StructField("left", TT.IntegerType()), TT.StructField("right", TT.IntegerType()),
    TT.StructField("size", TT.IntegerType()),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful search in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as (node, feature, threshold, left, right, size) rows."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, int(len(idx))])
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = me
        if depth >= limit or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            continue
        f = int(cand[rng.integers(cand.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        nodes[me][1], nodes[me][2] = f, thr
        stack.append((idx[~go_left], depth + 1, me, True))
        stack.append((idx[go_left], depth + 1, me, False))
    return [tuple(n) for n in nodes]


def _samples(ids: DataFrame, id_col: str, n: int, n_trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, id): for each tree the ``sample`` rows of the pool with the smallest hash.

    A table row costs one hash; only the pool, whose size is set by the parameters, is
    hashed for each tree. A tree that got too few rows (which is checked) makes the shares larger.
    """
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    wide, narrow = min(1.0, 2.0 * n_trees * sample / max(n, 1)), 4.0 * sample
    while True:
        pool = written(ids.select(id_col).where(hash01(seed, "iso-pool", F.col(id_col)) < wide), "iso-pool")
        share = min(1.0, narrow / max(pool.count(), 1))
        unit = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col(id_col)), 11) / F.lit(float(1 << 53))
        # explode_outer + null filter (a plain explode would make the optimizer
        # re-evaluate the hashes in an inferred size() > 0 filter).
        cand = (pool.select(id_col, F.explode_outer(F.filter(F.transform(trees, lambda t: F.struct(t.alias("tree"), unit(t).alias("h"))),
                                                             lambda e: e["h"] < share)).alias("e"))
                .where("e is not null").select(id_col, "e.tree", F.col("e.h").alias("_h")))
        w = Window.partitionBy("tree").orderBy("_h", id_col)
        picked = written(cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample)
                         .select("tree", id_col), "iso-samples")
        if (wide >= 1.0 and share >= 1.0) or picked.count() == n_trees * sample:
            return picked
        wide, narrow = min(1.0, 4 * wide), 4 * narrow


def fit(df: DataFrame, features: str, id_col: str, n_trees: int = 120, max_samples: int = 256,
        seed: int = 42, featurize: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Node table (tree, node, feature, threshold, left, right, size).

    ``featurize`` adds the array column ``features`` where ``df`` has it not yet: it sees
    the sampled rows only, whose number the parameters set.
    """
    n = df.count()
    sample = min(max_samples, n)
    limit = int(math.ceil(math.log2(max(sample, 2))))
    picked = _samples(df.select(id_col), id_col, n, n_trees, sample, seed)
    # At most n_trees * max_samples ids go out; the features of those rows come back.
    if featurize is None:
        picked = df.select(id_col, features).join(F.broadcast(picked), id_col).select("tree", features)
    else:
        # Written, so that what the features are made from is not pulled below the join.
        picked = featurize(written(df.join(F.broadcast(picked), id_col), "iso-rows")).select("tree", features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.vstack(pdf[features].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, t])
        rows = _grow(x, rng, limit)
        return pd.DataFrame([(t, *r) for r in rows], columns=[f.name for f in NODE_SCHEMA.fields])

    return picked.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


class Forest:
    """Node table as numpy arrays (bounded by n_trees x (2 max_samples - 1))."""

    def __init__(self, nodes: pd.DataFrame, max_samples: int, offset: float = 0.0):
        nodes = nodes.sort_values(["tree", "node"])
        self.trees = sorted(nodes["tree"].unique())
        self.per_tree = []
        for t in self.trees:
            g = nodes[nodes["tree"] == t]
            leaf_c = np.array([c_factor(s) for s in g["size"].to_numpy()])
            self.per_tree.append((g["feature"].to_numpy(), g["threshold"].to_numpy(),
                                  g["left"].to_numpy(), g["right"].to_numpy(), leaf_c))
        self.max_samples = max_samples
        self.offset = offset

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feat, thr, left, right, leaf_c in self.per_tree:
            node = np.zeros(len(x), dtype=np.int64)
            depth = np.zeros(len(x))
            active = feat[node] >= 0
            while active.any():
                f = feat[node]
                go_left = x[rows, np.where(f >= 0, f, 0)] <= thr[node]
                nxt = np.where(go_left, left[node], right[node])
                node = np.where(active, nxt, node)
                depth += active
                active = feat[node] >= 0
            total += depth + leaf_c[node]
        mean_h = total / max(len(self.per_tree), 1)
        return -np.power(2.0, -mean_h / c_factor(self.max_samples))


def load_forest(nodes: DataFrame, max_samples: int, offset: float = 0.0) -> Forest:
    return Forest(nodes.toPandas(), max_samples, offset)


def score_column(forest: Forest, features: str):
    """pandas_udf column: score_samples for an array<double> feature column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def _score(col: pd.Series) -> pd.Series:
        x = np.vstack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))
        return pd.Series(forest.score_samples(x))

    # Marked nondeterministic only to keep the optimizer from copying the call
    # into pushed-down filters (which would score every row twice, with the
    # feature chain inlined); the scores themselves are deterministic.
    return _score.asNondeterministic()(F.col(features))


def fit_offset(scored: DataFrame, score_col: str, contamination: float = 0.02) -> float:
    """Offset = exact contamination quantile of training scores."""
    return exact_quantile(written(scored.select(score_col), "iso-scores"), score_col, contamination)


def anomaly_columns(df: DataFrame, forest: Forest, features: str) -> DataFrame:
    """Score (decision, 4 digits) and flag."""
    s = score_column(forest, features)
    d = df.withColumn("_ss", s)
    return (d.withColumn("anomaly_score", F.bround(F.col("_ss") - F.lit(forest.offset), 4))
            .withColumn("is_anomaly", (F.col("_ss") - F.lit(forest.offset)) < 0).drop("_ss"))
