"""Registered queries: patients, doctors, notifications, predictions, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import oracle as O
from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import catalog as CT
from carelake.operators import logs as LG
from carelake.operators import lookup as L
from carelake.operators import patients as PT
from carelake.plans.q_etl import FIRST_DOC_CTE, ROSTER_CTE, sql_assign
from carelake.plans.registry import register
from carelake.sources import records as R
from carelake.sources.fixture import encounters_raw

# ---------------------------------------------------------------- SQL bits
DAYS = "coalesce(datediff('day', date_of_admission, discharge_date), 0)"
PATIENT_CTES = ",\n".join([
    ROSTER_CTE, FIRST_DOC_CTE,
    "pat0 AS (SELECT encounter_id AS id, 'Paciente DS-' || encounter_id AS patient_name, age, gender, "
    "symptoms_raw AS symptoms, symptoms_en AS symptoms_translated, diagnosis, CAST(1.0 AS DOUBLE) AS diagnosis_confidence, "
    + O.assign_risk("diagnosis", "age", DAYS) + " AS risk_level, CAST(1.0 AS DOUBLE) AS risk_confidence, "
    "CASE WHEN encounter_id % 3 = 0 THEN 'active' ELSE 'main' END AS source_dataset, 'import' AS created_by, "
    "CAST(date_of_admission AS TIMESTAMP) AS created_at FROM xf)",
    "patients AS (SELECT * FROM " + sql_assign("pat0") + " t)",
])
NOTIF_CTE = ("notifications AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' "
             "THEN 'success' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level, event_type AS source, "
             "event_type AS title, props AS message, '' AS meta, CAST(user_id % 2 AS INTEGER) AS is_read, "
             "ts AS created_at FROM events)")
_CLS = ", ".join(O.q(c) for c in K.XRAY_CLASSES)
PRED_CTES = (
    "pz AS (SELECT vec_id, label, exp(CAST(embedding[1] AS DOUBLE) * 10.0) AS z0, exp(CAST(embedding[2] AS DOUBLE) * 10.0) AS z1, "
    "exp(CAST(embedding[3] AS DOUBLE) * 10.0) AS z2 FROM embeddings), "
    "pp AS (SELECT vec_id AS pred_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id AS INTEGER)) AS timestamp, "
    "'rx_' || vec_id || '.png' AS filename, [z0 / (z0 + z1 + z2), z1 / (z0 + z1 + z2), z2 / (z0 + z1 + z2)] AS probs, "
    "label AS true_label FROM pz), "
    f"preds AS (SELECT *, [{_CLS}][list_position(probs, list_max(probs))] AS predicted_class, "
    "round_even(list_max(probs), 4) AS confidence, round_even(list_max(probs) * 100, 1) AS confidence_pct, "
    f"[{_CLS}][list_position(probs, list_max(probs))] IN ('covid', 'pneumonia') AND list_max(probs) >= {K.ALERT_THRESHOLD} "
    "AS clinical_alert FROM pp)")


def _pats(spark, d):
    return R.patients(spark, d)


def _notes(spark, d):
    return LG.normalize_notifications(R.notifications(spark, d))


# -------------------------------------------------------------- patients
_SEARCH_COLS = ", ".join(PT.SEARCH_COLUMNS)


@register("p18_patient_by_id", O.with_clean("SELECT * FROM patients WHERE id = 1", PATIENT_CTES))
def p18(spark, d):
    return PT.by_id(_pats(spark, d), 1)


@register("p19_patient_search", O.with_clean(
    f"SELECT {_SEARCH_COLS} FROM patients WHERE patient_name ILIKE '%DS-1%' "
    "ORDER BY created_at DESC, id DESC LIMIT 20", PATIENT_CTES))
def p19(spark, d):
    return PT.search(_pats(spark, d), "ds-1", 20)


@register("p19_patient_search_digits", O.with_clean(
    f"SELECT {_SEARCH_COLS} FROM patients WHERE patient_name ILIKE '%42%' OR id = 42 "
    "ORDER BY created_at DESC, id DESC LIMIT 20", PATIENT_CTES))
def p19d(spark, d):
    return PT.search(_pats(spark, d), " 42 ", 20)


@register("l01_newest_patients", O.with_clean(
    "SELECT id, patient_name, created_at FROM patients ORDER BY created_at DESC, id DESC LIMIT 200", PATIENT_CTES))
def l01(spark, d):
    return PT.newest(_pats(spark, d)).select("id", "patient_name", "created_at")


@register("a13_patient_age_summary", O.with_clean(
    "SELECT count(*) AS total_patients, CASE WHEN count(age) > 0 THEN CAST(((20 * sum(age) + count(age)) // "
    "(2 * count(age))) / 10.0 AS DOUBLE) END AS avg_age, min(age) AS min_age, max(age) AS max_age FROM patients", PATIENT_CTES))
def a13(spark, d):
    return PT.age_summary(_pats(spark, d))


@register("a14_patients_by_diagnosis", O.with_clean(
    "SELECT diagnosis AS name, count(*) AS count FROM patients GROUP BY 1 ORDER BY count DESC, name LIMIT 10",
    PATIENT_CTES))
def a14(spark, d):
    return PT.count_by(_pats(spark, d), "diagnosis", 10)


@register("a15_patients_by_zone", O.with_clean(
    "SELECT hospital_zone AS name, count(*) AS count FROM patients GROUP BY 1", PATIENT_CTES))
def a15(spark, d):
    return PT.count_by(_pats(spark, d), "hospital_zone")


@register("a16_patients_by_risk", O.with_clean(
    "SELECT risk_level AS name, count(*) AS count FROM patients WHERE coalesce(risk_level, '') <> '' GROUP BY 1",
    PATIENT_CTES))
def a16(spark, d):
    return PT.risk_view(_pats(spark, d))


@register("a23_age_histogram", O.with_clean(
    "SELECT b.name, coalesce(c.count, 0) AS count FROM (VALUES "
    + ", ".join(f"({O.q(lbl)})" for lbl, _u in K.AGE_BINS) + ") AS b(name) LEFT JOIN (SELECT "
    + O.age_bin("coalesce(age, 0)") + " AS name, count(*) AS count FROM (SELECT * FROM patients "
    "ORDER BY created_at DESC, id DESC LIMIT 1000) GROUP BY 1) c USING (name)", PATIENT_CTES))
def a23(spark, d):
    return PT.age_histogram(spark, _pats(spark, d))


_FIG_SQL = ("SELECT count(*) AS total_patients, CASE WHEN count(age) > 0 THEN CAST(((20 * sum(age) + count(age)) // "
            "(2 * count(age))) / 10.0 AS DOUBLE) END AS avg_age, min(age) AS min_age, max(age) AS max_age, "
            "(SELECT diagnosis FROM patients GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_diagnosis, "
            "(SELECT hospital_zone FROM patients GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_zone "
            "FROM patients")


@register("a34_report_figures", O.with_clean(_FIG_SQL, PATIENT_CTES))
def a34(spark, d):
    return PT.report_figures(_pats(spark, d))


@register("a33_overview", O.with_clean(
    "SELECT (SELECT count(*) FROM encounters_raw) AS dataset_total_rows, f.* FROM (" + _FIG_SQL + ") f", PATIENT_CTES))
def a33(spark, d):
    rows = encounters_raw(spark, d).agg(F.count(F.lit(1)).alias("dataset_total_rows")).withColumn("_k", F.lit(1))
    figs = PT.report_figures(_pats(spark, d)).withColumn("_k", F.lit(1))
    # Two one-row frames paired on a constant key.
    return rows.join(figs, "_k").drop("_k")


@register("s07_dataset_rows", O.with_fixture("SELECT count(*) AS rows FROM encounters_raw"))
def s07(spark, d):
    return encounters_raw(spark, d).agg(F.count(F.lit(1)).alias("rows"))


@register("p26_recommendations", O.with_clean(
    "SELECT id, risk_level, CASE risk_level "
    + " ".join(f"WHEN {O.q(k)} THEN {O.q(' | '.join(v))}" for k, v in K.RISK_RECOMMENDATIONS.items())
    + " ELSE '' END AS recommendations FROM patients", PATIENT_CTES))
def p26(spark, d):
    return _pats(spark, d).select("id", "risk_level",
                                  F.array_join(T.recommendations("risk_level"), " | ").alias("recommendations"))


# --------------------------------------------------------------- doctors
@register("p24_active_doctors", O.with_clean(
    "SELECT r.id, r.name, r.specialty, r.zone, count(p.id) AS assigned_patients FROM roster r "
    "LEFT JOIN patients p ON p.specialist_doctor = r.name || ' (' || r.specialty || ')' "
    "WHERE r.is_active = 1 GROUP BY ALL", PATIENT_CTES))
def p24(spark, d):
    doc = L.active_doctors(L.default_doctors(spark))
    load = _pats(spark, d).groupBy("specialist_doctor").agg(F.count(F.lit(1)).alias("assigned_patients"))
    key = F.format_string("%s (%s)", F.col("name"), F.col("specialty"))
    return (doc.join(load, key == load["specialist_doctor"], "left")
            .select("id", "name", "specialty", "zone",
                    F.coalesce("assigned_patients", F.lit(0)).alias("assigned_patients")))


@register("j02_zone_doctor", O.with_clean(
    "SELECT hospital_zone, specialist_doctor, count(*) AS patients FROM patients GROUP BY ALL", PATIENT_CTES))
def j02(spark, d):
    return _pats(spark, d).groupBy("hospital_zone", "specialist_doctor").agg(F.count(F.lit(1)).alias("patients"))


_DOC_RE = "'^(.*) \\((.*)\\)$'"


@register("j09_roster_seed", O.with_clean(
    "SELECT name, specialty FROM existing UNION ALL SELECT name, specialty FROM roster r WHERE NOT EXISTS "
    "(SELECT 1 FROM existing e WHERE lower(trim(e.name)) = lower(trim(r.name)) "
    "AND lower(trim(e.specialty)) = lower(trim(r.specialty)))",
    # Existing staff: doctors named in patient assignments; absent defaults are appended.
    PATIENT_CTES + ",\nexisting AS (SELECT DISTINCT name, specialty FROM (SELECT "
    f"regexp_extract(specialist_doctor, {_DOC_RE}, 1) AS name, regexp_extract(specialist_doctor, {_DOC_RE}, 2) "
    "AS specialty FROM patients) WHERE name <> '')"))
def j09(spark, d):
    docs = (_pats(spark, d).select(F.regexp_extract("specialist_doctor", r"^(.*) \((.*)\)$", 1).alias("name"),
                                   F.regexp_extract("specialist_doctor", r"^(.*) \((.*)\)$", 2).alias("specialty"))
            .filter(F.col("name") != "").distinct())
    existing = docs.select(F.lit(0).cast("long").alias("id"), "name", "specialty", F.lit("").alias("zone"),
                           F.lit("").alias("email"), F.lit("").alias("phone"), F.lit("").alias("shift"),
                           F.lit("").alias("notes"), F.lit(1).alias("is_active"))
    return L.seed_roster(existing, spark).select("name", "specialty")


# --------------------------------------------------------- notifications
@register("p31_notifications_clean", O.with_fixture(
    "SELECT id, level, source, title, message, meta, is_read FROM notifications", NOTIF_CTE))
def p31(spark, d):
    return _notes(spark, d).drop("created_at")


@register("p23_unread_notifications", O.with_fixture("SELECT id FROM notifications WHERE is_read = 0", NOTIF_CTE))
def p23(spark, d):
    return LG.unread(_notes(spark, d)).select("id")


@register("a17_unread_count", O.with_fixture("SELECT count(*) AS unread FROM notifications WHERE is_read = 0", NOTIF_CTE))
def a17(spark, d):
    return LG.unread_count(_notes(spark, d))


@register("l02_newest_notifications", O.with_fixture(
    "SELECT id, level, title, created_at FROM notifications ORDER BY created_at DESC, id DESC LIMIT 30", NOTIF_CTE))
def l02(spark, d):
    return LG.newest_notifications(_notes(spark, d)).select("id", "level", "title", "created_at")


@register("j10_new_since_last_poll", O.with_fixture(
    # The last poll saw the newest 30 before the 5 newest arrived.
    "SELECT id FROM (SELECT * FROM notifications ORDER BY created_at DESC, id DESC LIMIT 30) c WHERE is_read = 0 "
    "AND id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rk "
    "FROM notifications) WHERE rk BETWEEN 6 AND 35)", NOTIF_CTE))
def j10(spark, d):
    n = _notes(spark, d)
    cur = LG.newest_notifications(n, 30)
    prev = LG.newest_notifications(n, 35).select("id").exceptAll(LG.newest_notifications(n, 5).select("id"))
    return LG.new_since_last_poll(cur, prev).select("id")


@register("j12_mark_read", O.with_fixture(
    # Marks the ids of error events of every third user as read.
    "SELECT count_if(hit) AS updated, count_if(CASE WHEN hit THEN 1 ELSE is_read END = 0) AS unread_after FROM "
    "(SELECT n.*, m.id IS NOT NULL AS hit FROM notifications n LEFT JOIN (SELECT DISTINCT event_id AS id FROM events "
    "WHERE event_type = 'error' AND user_id % 3 = 0) m ON n.id = m.id)", NOTIF_CTE))
def j12(spark, d):
    ids = (R.table(spark, d, "events").filter((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0))
           .select(F.col("event_id").alias("id")))
    out, changed = LG.mark_read(_notes(spark, d), ids)
    return out.agg(F.count_if(changed).alias("updated"),
                   F.count_if(F.col("is_read") == 0).alias("unread_after"))


@register("p35_new_diagnoses_event", O.with_fixture(
    "SELECT 'warning' AS level, 'dataset' AS source, 'Nuevas enfermedades detectadas' AS title, "
    "'El dataset activo contiene diagnosticos no presentes en el modelo: ' || array_to_string(names[1:8], ', ') "
    "|| CASE WHEN k > 8 THEN ' (+ mas)' ELSE '' END || '. Reentrena el modelo para que los reconozca.' AS message "
    "FROM (SELECT list(diagnosis ORDER BY diagnosis) AS names, count(*) AS k FROM (SELECT DISTINCT "
    "trim(coalesce(diagnosis, '')) AS diagnosis FROM encounters_raw WHERE trim(coalesce(diagnosis, '')) <> '' AND "
    f"trim(coalesce(diagnosis, '')) NOT IN ({', '.join(O.q(k) for k in K.KNOWN_DISEASE_CLASSES)}))) WHERE k > 0"))
def p35(spark, d):
    ev = LG.event_new_diagnoses(CT.new_diagnoses(encounters_raw(spark, d)), "encounters")
    return ev.select("level", "source", "title", "message")


# ------------------------------------------------------------ predictions
def _preds(spark, d):
    return R.xray_predictions(spark, d)


@register("m19_xray_scores", O.with_fixture(
    "SELECT pred_id, predicted_class, confidence, confidence_pct, clinical_alert FROM preds", PRED_CTES))
def m19(spark, d):
    return _preds(spark, d).select("pred_id", "predicted_class", "confidence", "confidence_pct", "clinical_alert")


@register("p22_predictions_by_class", O.with_fixture("SELECT pred_id FROM preds WHERE predicted_class = 'covid'", PRED_CTES))
def p22(spark, d):
    return LG.predictions_by_class(_preds(spark, d), "covid").select("pred_id")


@register("l03_newest_predictions", O.with_fixture(
    "SELECT pred_id, timestamp, predicted_class FROM preds ORDER BY timestamp DESC, pred_id DESC LIMIT 50", PRED_CTES))
def l03(spark, d):
    return LG.newest_predictions(_preds(spark, d)).select("pred_id", "timestamp", "predicted_class")


@register("a18_prediction_stats", O.with_fixture(
    "SELECT predicted_class AS class, count(*) AS count, round_even(avg(confidence), 4) AS avg_confidence "
    "FROM preds GROUP BY 1", PRED_CTES))
def a18(spark, d):
    return LG.prediction_stats(_preds(spark, d))


@register("a19_prediction_totals", O.with_fixture(
    "SELECT count(*) AS total, count_if(clinical_alert) AS alerts FROM preds", PRED_CTES))
def a19(spark, d):
    return LG.prediction_totals(_preds(spark, d))


# ----------------------------------------------------------------- labels
def _label_case(kind: str, v: str, lang: str) -> str:
    tbl = K.label_table(kind)

    def one(lg: str) -> str:
        whens = " ".join(f"WHEN {O.q(k)} THEN {O.q(x)}" for k, x in tbl[lg].items())
        return f"(CASE {v} {whens} ELSE {v} END)"
    body = (f"CASE WHEN {lang} = 'en' THEN {one('en')} WHEN {lang} = 'ca' THEN {one('ca')} ELSE {one('es')} END")
    return f"(CASE WHEN coalesce({v}, '') = '' THEN '—' ELSE {body} END)"


_LANG = "(['es', 'en', 'ca', 'fr'])[id % 4 + 1]"


@register("j07_label_translation", O.with_clean(
    f"SELECT id, lang, {_label_case('diagnosis', 'diagnosis', 'lang')} AS diagnosis_label, "
    f"{_label_case('zone', 'hospital_zone', 'lang')} AS zone_label, {_label_case('risk', 'risk_level', 'lang')} AS risk_label, "
    f"{_label_case('gender', 'gender', 'lang')} AS gender_label FROM (SELECT *, {_LANG} AS lang FROM patients)",
    PATIENT_CTES))
def j07(spark, d):
    p = _pats(spark, d).withColumn("lang", F.get(F.array(*[F.lit(x) for x in ["es", "en", "ca", "fr"]]),
                                                 (F.col("id") % 4).cast("int")))
    return p.select("id", "lang",
                    L.translate_label("diagnosis", F.col("diagnosis"), "lang").alias("diagnosis_label"),
                    L.translate_label("zone", F.col("hospital_zone"), "lang").alias("zone_label"),
                    L.translate_label("risk", F.col("risk_level"), "lang").alias("risk_label"),
                    L.translate_label("gender", F.col("gender"), "lang").alias("gender_label"))


def _sym_case(v: str, lang: str) -> str:
    tbl = K.label_table("symptom")

    def one(lg: str) -> str:
        whens = " ".join(f"WHEN {O.q(k)} THEN {O.q(x)}" for k, x in tbl[lg].items())
        return f"(CASE lower(trim({v})) {whens} ELSE {v} END)"
    return (f"(CASE WHEN coalesce({v}, '') = '' THEN '' WHEN {lang} = 'en' THEN {one('en')} "
            f"WHEN {lang} = 'ca' THEN {one('ca')} ELSE {one('es')} END)")


@register("j08_symptom_list_labels", O.with_clean(
    "SELECT id, lang, array_to_string(list_filter(list_transform(string_split(coalesce(symptoms_translated, ''), ','), "
    f"lambda s: {_sym_case('trim(s)', 'lang')}), lambda s: s <> ''), ', ') AS symptoms_label "
    f"FROM (SELECT *, {_LANG} AS lang FROM patients)", PATIENT_CTES))
def j08(spark, d):
    p = _pats(spark, d).withColumn("lang", F.get(F.array(*[F.lit(x) for x in ["es", "en", "ca", "fr"]]),
                                                 (F.col("id") % 4).cast("int")))
    return p.select("id", "lang", L.translate_symptom_list(F.col("symptoms_translated"), "lang").alias("symptoms_label"))
