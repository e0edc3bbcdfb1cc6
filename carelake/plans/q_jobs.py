"""Registered queries: forests, isolation forest and cohort jobs (checked by rows and tests).

All queries of a data folder share one training run, whose products are kept in its store
(``plans.runs``): a query makes what is missing and reads the rest, in this session or a
later one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import oracle as O
from carelake.operators import lookup as L
from carelake.plans import cohort as CO
from carelake.plans import q_models as QM
from carelake.plans import training as TR
from carelake.plans.registry import register
from carelake.sources import files as FS
from carelake.sources import records as R
from carelake.sources.fixture import encounters_raw

_CACHE: dict = {}


def trained(spark, d) -> TR.TrainRun:
    """The training run of a data folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CACHE:
        _CACHE[key] = TR.TrainRun(encounters_raw(spark, d, with_copy=True))
    return _CACHE[key]


def forget() -> None:
    """Forget the runs of this session; their products stay in the store."""
    _CACHE.clear()


@register("m06_disease_forest_report")
def m06(spark, d):
    return trained(spark, d).disease_report


@register("m07_risk_forest_report")
def m07(spark, d):
    return trained(spark, d).risk_report


@register("m08_cross_validation")
def m08(spark, d):
    """3-fold accuracy of both forests (W04 folds), per fold."""
    return trained(spark, d).cv


@register("m09_disease_predictions")
def m09(spark, d):
    return trained(spark, d).disease_test.select(
        "encounter_id", "diagnosis", "predicted", "confidence", "confidence_pct", "top_predictions")


@register("m10_risk_predictions")
def m10(spark, d):
    return trained(spark, d).risk_test.select(
        "encounter_id", "label_noisy", "risk_level_pred", "confidence",
        F.to_json("probabilities").alias("risk_probabilities"),
        F.array_join("recommendations", " | ").alias("recommendations"))


@register("m11_model_info")
def m11(spark, d):
    """Model info as the portal shows it: classes, figures of the last run, features."""
    keep = ("disease_classes", "risk_classes", "disease_accuracy", "risk_accuracy", "n_samples", "features_used")
    rec = trained(spark, d).figures
    return TR.metrics_frame(spark, {k: rec[k] for k in keep})


@register("m11_model_classes", O.with_fixture(
    "SELECT count(*) AS n_samples, string_agg(DISTINCT diagnosis, '|' ORDER BY diagnosis) AS disease_classes, "
    "string_agg(DISTINCT risk_level, '|' ORDER BY risk_level) AS risk_classes, "
    "'symptoms_tfidf|age|gender_enc' AS features_used FROM mrisk", QM.MODEL_ROWS_CTE))
def m11_classes(spark, d):
    """M11 without the forests' figures: what the models know before they are trained."""
    t = trained(spark, d)
    return spark.createDataFrame([(t.n_rows, *("|".join(t.classes[k].labels) for k in ("disease", "risk")), "symptoms_tfidf|age|gender_enc")],
                                 "n_samples long, disease_classes string, risk_classes string, features_used string")


@register("m12_isolation_forest_nodes")
def m12(spark, d):
    return trained(spark, d).iso_nodes


@register("m13_anomaly_scores")
def m13(spark, d):
    t = trained(spark, d)
    return CO.anomaly(R.patients(spark, d), t.anomaly_weights, t.forest, "symptoms_translated").select(
        "id", "anomaly_score", "is_anomaly")


def _numbered(spark, d):
    """The encounters as CSV tables with row numbers."""
    from carelake.plans.q_files import one_csv
    return FS.read_encounters_csv(spark, one_csv(spark, d), null_tokens=False, row_col="row_no", row_scope="folder")


_IMPORT_CTES = (
    "imp AS (SELECT row_number() OVER (PARTITION BY encounter_id % 8 ORDER BY encounter_id) AS row_no, encounter_id, "
    + O.integer_value("coalesce(age_raw, '')") + " AS age, CASE WHEN trim(coalesce(gender, '')) = '' THEN 'Other' "
    "ELSE trim(gender) END AS gender, trim(coalesce(symptoms, '')) AS symptoms, trim(coalesce(diagnosis, '')) AS diagnosis "
    "FROM encounters_raw)")


@register("m14_cohort_import")
def m14(spark, d):
    pats, _summary = CO.import_cohort(_numbered(spark, d), trained(spark, d).risk, L.default_doctors(spark), "encounters")
    return pats


@register("m14_cohort_rows", O.with_fixture(
    "SELECT row_no, 'Paciente DS-' || row_no AS patient_name, age, gender, symptoms, diagnosis, "
    "CAST(1.0 AS DOUBLE) AS diagnosis_confidence, 'encounters' AS source_dataset FROM imp "
    "WHERE age IS NOT NULL AND symptoms <> '' AND diagnosis <> ''", _IMPORT_CTES))
def m14_rows(spark, d):
    """M14 without the forest's two columns: every import rule and the file row numbers."""
    return CO.import_rows(_numbered(spark, d)).select(
        "row_no", F.concat(F.lit("Paciente DS-"), F.col("row_no").cast("string")).alias("patient_name"),
        F.col("age").cast("int").alias("age"), "gender", "symptoms", "diagnosis", F.lit(1.0).alias("diagnosis_confidence"),
        F.lit("encounters").alias("source_dataset"))


@register("a31_import_summary", O.with_fixture(
    "SELECT count(*) AS rows_processed, count_if(age IS NOT NULL AND symptoms <> '' AND diagnosis <> '') AS inserted, "
    "count_if(NOT (age IS NOT NULL AND symptoms <> '' AND diagnosis <> '')) AS skipped, 'encounters' AS dataset FROM imp",
    _IMPORT_CTES))
def a31(spark, d):
    return CO.import_summary(_numbered(spark, d), "encounters")


@register("m15_cohort_analysis")
def m15(spark, d):
    t = trained(spark, d)
    raw = encounters_raw(spark, d)
    from carelake.functions import text as T
    cohort = raw.select(F.col("encounter_id").alias("id"), T.integer_value(F.col("age_raw")).alias("age"),
                        "gender", "symptoms")
    out = CO.analyze_cohort(cohort, t.disease, t.risk, t.forest, L.default_doctors(spark))
    return out.select("id", "predicted_disease", "disease_confidence", "risk_level", "risk_confidence",
                      "anomaly_score", "is_anomaly", "hospital_zone", "specialist_doctor", "error")


@register("m16_atypical_patients")
def m16(spark, d):
    t = trained(spark, d)
    found, _summary = CO.atypical_patients(R.patients(spark, d), t.anomaly_weights, t.forest, 1000)
    return found


@register("a32_anomaly_summary")
def a32(spark, d):
    t = trained(spark, d)
    _found, summary = CO.atypical_patients(R.patients(spark, d), t.anomaly_weights, t.forest, 1000)
    return summary


@register("p35_anomalies_event")
def p35_anomalies(spark, d):
    from carelake.operators import logs as LG
    return LG.event_anomalies(a32(spark, d)).select("level", "source", "title", "message", "meta")


@register("m17_patient_card")
def m17(spark, d):
    t = trained(spark, d)
    return CO.patient_card(R.patients(spark, d), 1, t.anomaly_weights, t.risk, t.forest, L.default_doctors(spark))
