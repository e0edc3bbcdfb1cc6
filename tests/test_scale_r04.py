"""What a query trains, and how a forest's rows are dealt to its tasks."""

import os
import tempfile

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from carelake.operators import models as M
from carelake.plans import cohort as CO
from carelake.plans import q_jobs as QJ
from carelake.plans import training as TR
from carelake.plans.runs import RunStore
from carelake.sources import records as R
from carelake.sources.fixture import encounters_raw

SMALL = TR.TrainParams(n_trees=2, disease_depth=3, risk_depth=3, iso_trees=6, iso_samples=32, at_once=2)


@pytest.fixture()
def run(spark, sf_dir, monkeypatch):
    store = RunStore(spark, "r04", root=tempfile.mkdtemp(prefix="scale-", dir="/tmp"))
    got = TR.TrainRun(encounters_raw(spark, sf_dir, with_copy=True), SMALL, store)
    monkeypatch.setattr(QJ, "trained", lambda spark, d: got)
    return got


def made(run):
    return {n for n in os.listdir(run.store.base) if not n.startswith(".")}


def test_anomaly_queries_train_no_classifier(spark, sf_dir, run):
    """The forests' features need the disease model's vocabulary; its trees were trained for nothing."""
    scores = sorted(map(tuple, QJ.m13(spark, sf_dir).collect()))
    found = QJ.m16(spark, sf_dir).collect()
    checked = QJ.a32(spark, sf_dir).first()
    assert checked["anomalies_count"] == len(found) and QJ.p35_anomalies(spark, sf_dir).count() == 1
    assert not {n for n in made(run) if n.startswith(("model_", "features_risk"))}, made(run)
    # The card needs the risk model's trees, but not the disease model's.
    card = QJ.m17(spark, sf_dir).collect()
    assert "model_disease" not in made(run)
    # With the whole disease model the results are the same.
    pats = R.patients(spark, sf_dir)
    whole = CO.anomaly(pats, run.disease, run.forest, "symptoms_translated").select("id", "anomaly_score", "is_anomaly")
    assert sorted(map(tuple, whole.collect())) == scores != []
    again, _ = CO.atypical_patients(pats, run.disease, run.forest, 1000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found))
    from carelake.operators import lookup as L
    assert CO.patient_card(pats, 1, run.disease, run.risk, run.forest, L.default_doctors(spark)).collect() == card


def test_model_info_makes_no_isolation_forest(spark, sf_dir, run):
    info = QJ.m11(spark, sf_dir).first().asDict()
    assert not {n for n in made(run) if n.startswith("iso")}, made(run)
    whole = run.metrics
    assert all(info[k] == whole[k] for k in ("disease_accuracy", "risk_accuracy", "n_samples"))
    assert list(whole)[-1] == "anomaly_offset" and whole["anomaly_offset"] < 0


def test_forest_rows_are_dealt_evenly(spark, monkeypatch):
    """Parts of very different size: put together they left most rows to one task."""
    sizes = []

    class Stop(Exception):
        pass

    def fit(self, d, params=None):
        sizes.extend(n for _, n in sorted(d.groupBy(F.spark_partition_id()).count().collect()))
        raise Stop

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    path = tempfile.mkdtemp(prefix="scale-", dir="/tmp")
    for first, rows in ((0, 7_000), (7_000, 500), (7_500, 500)):
        spark.range(first, first + rows, 1, 1).select(F.col("id").cast("double").alias("features"), F.lit("a").alias("label")).write.mode(
            "append").parquet(path)
    p = M.ForestParams(rows_per_task=2_000)
    with pytest.raises(Stop):
        M.fit_forest(spark.read.parquet(path), "label", M.Classes(["a"], [8_000]), p)
    assert sum(sizes) == 8_000 and len(sizes) == 4 and max(sizes) < 2_200, sizes
