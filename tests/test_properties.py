
import math

from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import features as FE
from carelake.operators import sampling as SM
from carelake.sources.fixture import encounters_raw


def rows(spark, sf_dir):
    return FE.model_rows(encounters_raw(spark, sf_dir, with_copy=True))


def test_dropout_is_nonempty_subset(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("d", SM.symptom_dropout(F.col("symptoms_clean"), F.col("encounter_id")))
    bad = r.filter(
        (F.size(T.split_items("symptoms_clean")) > 0)
        & ((F.col("d") == "") | (F.size(F.array_except(F.split("d", ", "), T.split_items("symptoms_clean"))) > 0)))
    assert bad.count() == 0


def test_noise_changes_exactly_floor_5pct(spark, sf_dir):
    r = rows(spark, sf_dir)
    n = r.count()
    out = SM.label_noise(r, "risk_level", "encounter_id", K.RISK_CLASSES, tie_col="row_key")
    changed = out.filter(F.col("label_noisy") != F.col("risk_level")).count()
    assert changed == math.floor(n * 0.05)


def test_k_smallest_exact(spark):
    df = spark.range(0, 5000).select(F.col("id"), SM.hash32(7, F.col("id")).alias("h"),
                                     (F.col("id") % 3).alias("g"))
    flagged = SM.k_smallest(df, "h", "id", {(0,): 100, (1,): 7, (2,): 0}, keys=["g"], flag="s")
    got = {r["g"]: r["c"] for r in flagged.filter("s").groupBy("g").agg(F.count("*").alias("c")).collect()}
    assert got.get(0) == 100 and got.get(1) == 7 and got.get(2) is None
    pdf = df.toPandas()
    want = set(pdf[pdf.g == 0].sort_values(["h", "id"]).head(100)["id"])
    assert set(r["id"] for r in flagged.filter("s AND g = 0").collect()) == want


def test_split_and_folds_cover_every_row_once(spark, sf_dir):
    r = rows(spark, sf_dir)
    s = SM.split_exact(r, "diagnosis", "encounter_id", tie_col="row_key")
    assert s.count() == r.count()
    f = r.select(SM.fold_hash("encounter_id").alias("fold"))
    assert set(x[0] for x in f.distinct().collect()) <= {0, 1, 2}


def test_translation_idempotent_on_english(spark):
    df = spark.createDataFrame([("fever, cough, headache",)], "v string")
    once = df.select(T.translate_symptoms("v").alias("v"))
    twice = once.select(T.translate_symptoms("v").alias("v"))
    assert once.first()[0] == twice.first()[0]
