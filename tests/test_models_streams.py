
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from carelake.operators import clean as C
from carelake.operators import features as FE
from carelake.operators import models as M
from carelake.plans import cohort as CO
from carelake.plans import training as TR
from carelake.plans.runs import RunStore
from carelake.sources import files as FS
from carelake.sources.fixture import encounters_raw
from carelake.streaming import streams as ST


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    params = TR.TrainParams(n_trees=10, iso_trees=40)
    return TR.train(encounters_raw(spark, sf_dir, with_copy=True), params, RunStore(spark, root=tempfile.mkdtemp(prefix="runs-", dir="/tmp")))


def test_disease_model_beats_majority(trained):
    acc = trained.metrics["disease_accuracy"]
    dist = trained.metrics["disease_distribution"]
    majority = max(dist.values()) / sum(dist.values())
    assert acc > majority


def test_probabilities_sum_to_one(trained):
    p = trained.disease_test.select(F.aggregate(F.map_values("probabilities"), F.lit(0.0),
                                                lambda a, x: a + x).alias("s"))
    assert p.filter(F.abs(F.col("s") - 1.0) > 0.01).count() == 0


def test_anomaly_share_near_contamination(spark, sf_dir, trained):
    rows = trained.rows.withColumn("gender", F.col("gender"))
    scored = CO.anomaly(rows, trained.disease, trained.forest, "symptoms_clean")
    share = scored.filter("is_anomaly").count() / scored.count()
    assert 0.0 < share < 0.08


def test_bundle_roundtrip(spark, trained):
    path = tempfile.mkdtemp(prefix="bundle-", dir="/tmp")
    TR.save_bundle(trained, path)
    disease, _risk, forest, metrics = TR.load_bundle(spark, path)
    assert M.labels_of(disease) == M.labels_of(trained.disease)
    a = CO.anomaly(trained.rows.limit(50), trained.disease, trained.forest, "symptoms_clean")
    b = CO.anomaly(trained.rows.limit(50), disease, forest, "symptoms_clean")
    ka = sorted((r["row_key"], r["anomaly_score"]) for r in a.collect())
    kb = sorted((r["row_key"], r["anomaly_score"]) for r in b.collect())
    assert ka == kb
    assert metrics["n_samples"] == trained.metrics["n_samples"]


def test_csv_roundtrip_equals_parquet(spark, sf_dir):
    raw = encounters_raw(spark, sf_dir)
    path = tempfile.mkdtemp(prefix="csv-", dir="/tmp") + "/enc"
    FS.write_encounters_csv(raw, path)
    back = FS.read_encounters_csv(spark, path)
    a = C.removed_counts(C.stage_rows(raw.select(*C.CRITICAL, "encounter_id"))).first()
    b = C.removed_counts(C.stage_rows(back.select(*C.CRITICAL, F.col("encounter_id").cast("long")))).first()
    assert a == b


def test_csv_long_rows_dropped_short_padded(spark):
    d = tempfile.mkdtemp(prefix="csvbad-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Age,Gender,Symptoms,Diagnosis\n40,Male,cough,Asthma\n41,Male,cough,Asthma,EXTRA\n42,Female\n")
    df = FS.read_encounters_csv(spark, d)
    got = sorted((r["age_raw"], r["diagnosis"]) for r in df.collect())
    assert got == [("40", "Asthma"), ("42", None)]


def test_clean_stream_equals_batch(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="t01-", dir="/tmp")
    raw = encounters_raw(spark, sf_dir)
    FS.write_encounters_csv(raw, base + "/in")
    ST.run_clean_stream(spark, base + "/in", base + "/out", base + "/ckpt")
    streamed = spark.read.parquet(base + "/out").select("encounter_id", "symptoms_en")
    batch = FE.transform(C.clean(raw)).select("encounter_id", "symptoms_en")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
