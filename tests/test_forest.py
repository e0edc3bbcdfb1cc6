"""Forests from counts: the rules of Spark ML's trainer, without its dense statistics."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from carelake.operators import forest as FO
from carelake.operators import models as M


def rows(spark, n=900, seed=5):
    """Sparse and dense vectors of eight places, one never filled; three classes that follow some of them."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        v = {i: round(rnd.uniform(0.1, 1), 3) for i in range(5) if rnd.random() < 0.3}
        v |= {5: float(rnd.randrange(-3, 90)), 7: float(rnd.randrange(3))}
        y = (0 if v.get(1, 0) > 0.5 else 1 if v[5] > 40 else 2) if rnd.random() < 0.9 else rnd.randrange(3)
        x = Vectors.sparse(8, {i: w for i, w in v.items() if w})
        out.append((k, Vectors.dense(x.toArray()) if k % 5 == 0 else x, float(y)))
    return spark.createDataFrame(out, ["id", "features", "label_idx"])


@pytest.mark.parametrize("tasks", [1, 3])
def test_a_tree_on_all_rows_and_features_is_spark_mls(spark, tasks, monkeypatch):
    monkeypatch.setattr(FO, "BLOCK_ROWS", 100)
    monkeypatch.setattr(FO, "CHUNK_CELLS", 500)
    monkeypatch.setattr(FO, "HITS_AT_ONCE", 1)
    weights = [1.5, 1.0, 0.5]
    d = rows(spark).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("label_idx").cast("int"))).cache()
    c = RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol="weight", numTrees=1, maxDepth=5, minInstancesPerNode=4,
                               bootstrap=False, featureSubsetStrategy="all", seed=7)
    want, got = c.fit(d), FO.fit(d, c, 900, weights, tasks)
    assert got.toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1] and want.totalNumNodes > 9
    assert got.numFeatures == 8 and got.numClasses == 3
    see = lambda m: {r["id"]: [round(p, 12) for p in r["probability"]] for r in m.transform(d).collect()}
    assert see(got) == see(want)


def test_large_tables_grow_from_counts(spark, monkeypatch):
    """Before, every forest kept its rows and statistics in Spark ML's dense form."""
    def never(self, d, params=None):
        raise AssertionError("the dense trainer on a large table")

    d = rows(spark, 1_500).withColumn("label", F.concat(F.lit("c"), F.col("label_idx").cast("int"))).cache()
    classes = M.classes_of(d, "label", {"x": F.lit(True)})["x"]
    p = M.ForestParams(n_trees=12, max_depth=5, min_leaf=3, rows_per_task=400)
    hits = lambda m: m.transform(d).where("prediction = label_idx").count()
    dense = hits(M.fit_forest(d, "label", classes, p))
    monkeypatch.setattr(RandomForestClassifier, "fit", never)
    model = M.fit_forest(d, "label", classes, replace(p, counted_above=1_499))
    assert model.getNumTrees == 12 and model.numClasses == 3
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 12           # bags and subsets differ
    assert abs(hits(model) - dense) < 0.05 * 1_500 and hits(model) > 0.8 * 1_500
    again = M.fit_forest(d, "label", classes, replace(p, counted_above=1_499))
    assert again.toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]


def test_bags_are_poisson():
    table = FO._poisson_table()
    assert abs(table.mean() - 1) < 1e-3 and abs(table.var() - 1) < 1e-3 and table.max() >= 7


def test_many_values_are_cut_into_bins():
    values = np.random.default_rng(1).random(5_000)
    cuts = FO.thresholds_of(values, np.ones(5_000), 5_000.0, 32)
    assert len(cuts) <= 31 and (np.diff(cuts) > 0).all() and cuts[0] < 0.001
    assert FO.thresholds_of(np.empty(0), np.empty(0), 10.0, 32).size == 0
    assert FO.thresholds_of(np.array([2.0]), np.ones(1), 1.0, 32).tolist() == [1.0]
