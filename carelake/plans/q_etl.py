"""Registered queries: clean, transform, analytics and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import oracle as O
from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import analytics as A
from carelake.operators import clean as C
from carelake.operators import features as FE
from carelake.operators import lookup as L
from carelake.plans.registry import register
from carelake.sources.fixture import encounters_raw


def staged(spark, d):
    return C.stage_rows(encounters_raw(spark, d))


def xf(spark, d):
    return FE.transform(C.clean(encounters_raw(spark, d)))


# ---------------------------------------------------------------- SQL bits
ROSTER_CTE = "roster AS (SELECT * FROM (VALUES {}) AS r(id, name, specialty, zone, is_active))".format(
    ", ".join(f"({i + 1}, {O.q(n)}, {O.q(s)}, {O.q(z)}, 1)" for i, (n, s, z, *_r) in enumerate(K.DEFAULT_DOCTOR_ROSTER)))
FIRST_DOC_CTE = ("first_doc AS (SELECT lower(zone) AS zkey, arg_min(name, id) AS dname, "
                 "arg_min(specialty, id) AS dspec FROM roster WHERE is_active = 1 GROUP BY lower(zone))")


def sql_assign(src: str, dcol: str = "diagnosis") -> str:
    """SELECT list fragment: hospital_zone and specialist_doctor for ``src`` rows."""
    zone = f"coalesce({O.mapped(dcol, 1)}, {O.keyword_zone(dcol)}, {O.q(K.DEFAULT_ZONE)})"
    return (f"(SELECT s.*, z.zone AS hospital_zone, coalesce(fd.dname || ' (' || coalesce(nullif(fd.dspec, ''), z.zone) || ')', "
            f"coalesce(z.mdoc, {O.q(K.DUTY_DOCTOR)})) AS specialist_doctor FROM {src} s, "
            f"LATERAL (SELECT {zone} AS zone, {O.mapped(dcol, 2)} AS mdoc) z "
            f"LEFT JOIN first_doc fd ON fd.zkey = lower(z.zone))")


# ------------------------------------------------------------- flagship
def flagship(spark, d):
    """A06 joined with J01/J02: age figures per diagnosis with zone and doctor."""
    top = A.age_by_diagnosis(xf(spark, d), 15)
    return L.assign(top, L.default_doctors(spark)).select(
        "diagnosis", "avg_age", "min_age", "max_age", "n", "hospital_zone", "specialist_doctor")


_A06_SQL = ("a06 AS (SELECT diagnosis, round_even(avg(age), 1) AS avg_age, min(age) AS min_age, max(age) AS max_age, "
            "count(*) AS n FROM xf GROUP BY diagnosis ORDER BY n DESC, diagnosis LIMIT 15)")
register("a06_age_by_diagnosis_assigned", O.with_clean(
    "SELECT diagnosis, avg_age, min_age, max_age, n, hospital_zone, specialist_doctor FROM "
    + sql_assign("a06") + " t",
    ",\n".join([_A06_SQL, ROSTER_CTE, FIRST_DOC_CTE])))(flagship)


@register("a06_age_by_diagnosis", O.with_clean("SELECT * FROM a06", _A06_SQL))
def a06(spark, d):
    return A.age_by_diagnosis(xf(spark, d), 15)


# ------------------------------------------------------------- row level
@register("p01_dedupe", O.with_clean("SELECT encounter_id, copies FROM dedup"))
def p01(spark, d):
    r = encounters_raw(spark, d)
    return r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("copies")).select("encounter_id", "copies")


@register("p12_reject_reason", O.with_clean("SELECT encounter_id, copies, reject_reason FROM staged"))
def p12(spark, d):
    return staged(spark, d).select("encounter_id", "copies", "reject_reason")


@register("p02_drop_missing", O.with_fixture(
    "SELECT encounter_id FROM encounters_raw WHERE age_raw IS NOT NULL AND gender IS NOT NULL "
    "AND symptoms IS NOT NULL AND diagnosis IS NOT NULL"))
def p02(spark, d):
    return encounters_raw(spark, d).na.drop(subset=C.CRITICAL).select("encounter_id")


@register("p03_age_parse", O.with_fixture(
    f"SELECT encounter_id, age_raw, CAST(trunc({O.numeric_value('age_raw')}) AS INTEGER) AS age FROM encounters_raw "
    f"WHERE {O.numeric_value('age_raw')} IS NOT NULL"))
def p03(spark, d):
    v = T.numeric_value("age_raw")
    return encounters_raw(spark, d).filter(v.isNotNull()).select("encounter_id", "age_raw", v.cast("int").alias("age"))


@register("p04_age_range", O.with_fixture(
    f"SELECT encounter_id, CAST(trunc({O.numeric_value('age_raw')}) AS INTEGER) AS age FROM encounters_raw "
    f"WHERE trunc({O.numeric_value('age_raw')}) BETWEEN 0 AND 120"))
def p04(spark, d):
    v = T.numeric_value("age_raw")
    return (encounters_raw(spark, d).filter(v.isNotNull() & (v > -1) & (v < 121))
            .select("encounter_id", v.cast("int").alias("age")).filter(F.col("age").between(0, 120)))


@register("p05_gender_normalize", O.with_fixture(
    f"SELECT encounter_id, gender AS gender_raw, {O.normalize_gender('gender')} AS gender FROM encounters_raw"))
def p05(spark, d):
    return encounters_raw(spark, d).select("encounter_id", F.col("gender").alias("gender_raw"),
                                           T.normalize_gender("gender").alias("gender"))


@register("p06_assign_risk", O.with_fixture(
    "SELECT encounter_id, "
    + O.assign_risk("diagnosis", f"CAST(trunc({O.numeric_value('age_raw')}) AS INTEGER)",
                    "coalesce(datediff('day', date_of_admission, discharge_date), 0)")
    + " AS risk_level, coalesce(datediff('day', date_of_admission, discharge_date), 0) AS days_stayed FROM encounters_raw "
    f"WHERE age_raw IS NOT NULL AND gender IS NOT NULL AND symptoms IS NOT NULL AND diagnosis IS NOT NULL "
    f"AND {O.numeric_value('age_raw')} IS NOT NULL"))
def p06(spark, d):
    return FE.model_rows(encounters_raw(spark, d)).select("encounter_id", "risk_level", "days_stayed")


@register("p07_gender_code_etl", O.with_clean("SELECT encounter_id, gender, gender_enc FROM xf"))
def p07(spark, d):
    return xf(spark, d).select("encounter_id", "gender", "gender_enc")


@register("p08_gender_code_model", O.with_fixture(
    "SELECT encounter_id, CAST(CASE gender WHEN 'Male' THEN 1 WHEN 'Female' THEN 0 ELSE 2 END AS INTEGER) AS code_train, "
    "CAST(CASE lower(trim(gender)) WHEN 'male' THEN 1 WHEN 'female' THEN 0 ELSE 2 END AS INTEGER) AS code_score "
    "FROM encounters_raw"))
def p08(spark, d):
    return encounters_raw(spark, d).select(
        "encounter_id", T.gender_code_train("gender").alias("code_train"),
        T.gender_code_score("gender").alias("code_score"))


@register("p09_age_bin", O.with_clean("SELECT encounter_id, age, age_bin FROM xf"))
def p09(spark, d):
    return xf(spark, d).select("encounter_id", "age", "age_bin")


@register("p10_symptom_normalize", O.with_fixture(
    f"SELECT encounter_id, {O.normalize_symptoms('symptoms')} AS symptoms FROM encounters_raw WHERE symptoms IS NOT NULL"))
def p10(spark, d):
    return (encounters_raw(spark, d).filter(F.col("symptoms").isNotNull())
            .select("encounter_id", T.normalize_symptoms("symptoms").alias("symptoms")))


@register("p11_drop_blank_text", O.with_clean("SELECT encounter_id, symptoms, diagnosis FROM clean"))
def p11(spark, d):
    return C.clean(encounters_raw(spark, d)).select("encounter_id", "symptoms", "diagnosis")


@register("p13_translate_symptoms", O.with_clean(
    f"SELECT encounter_id, symptoms, {O.translate('symptoms')} AS translated FROM clean"))
def p13(spark, d):
    return C.clean(encounters_raw(spark, d)).select(
        "encounter_id", "symptoms", T.translate_symptoms("symptoms").alias("translated"))


@register("p14_symptoms_en", O.with_clean("SELECT encounter_id, symptoms_en FROM xf"))
def p14(spark, d):
    return xf(spark, d).select("encounter_id", "symptoms_en")


@register("p15_symptom_count", O.with_clean("SELECT encounter_id, symptoms_count FROM xfc"))
def p15(spark, d):
    return xf(spark, d).select("encounter_id", "symptoms_count")


@register("p15_symptom_count_untranslated", O.with_clean(
    f"SELECT encounter_id, len(string_split({O.renormalize('symptoms')}, ',')) AS symptoms_count FROM clean"))
def p15u(spark, d):
    return FE.transform(C.clean(encounters_raw(spark, d)), translator=None).select("encounter_id", "symptoms_count")


@register("p16_stay_days", O.with_fixture(
    "SELECT encounter_id, coalesce(datediff('day', date_of_admission, discharge_date), 0) AS days_stayed FROM encounters_raw"))
def p16(spark, d):
    return encounters_raw(spark, d).select(
        "encounter_id", T.stay_days("date_of_admission", "discharge_date").alias("days_stayed"))


@register("p17_training_text", O.with_fixture(
    "SELECT encounter_id, trim(lower(symptoms)) AS symptoms_clean FROM encounters_raw WHERE symptoms IS NOT NULL"))
def p17(spark, d):
    return (encounters_raw(spark, d).filter(F.col("symptoms").isNotNull())
            .select("encounter_id", T.py_strip(F.lower("symptoms")).alias("symptoms_clean")))


@register("p25_keyword_zone", O.with_fixture(
    f"SELECT encounter_id, {O.keyword_zone('diagnosis')} AS keyword_zone FROM encounters_raw"))
def p25(spark, d):
    return encounters_raw(spark, d).select("encounter_id", T.keyword_zone("diagnosis").alias("keyword_zone"))


@register("p28_term_normalize", O.with_fixture(
    f"SELECT encounter_id, {O.normalize_term('diagnosis')} AS term FROM encounters_raw"))
def p28(spark, d):
    return encounters_raw(spark, d).select("encounter_id", T.normalize_term("diagnosis").alias("term"))


# ------------------------------------------------------------- aggregates
@register("a01_totals", O.with_clean(
    "SELECT count(*) AS rows, count(DISTINCT diagnosis) AS distinct_diagnoses, "
    "count(DISTINCT gender) AS distinct_genders FROM xf"))
def a01(spark, d):
    return A.totals(xf(spark, d))


@register("a02_age_stats", O.with_clean(
    "SELECT round_even(avg(age), 1) AS mean, CAST(trunc(quantile_cont(age, 0.5)) AS INTEGER) AS median, "
    "min(age) AS min, max(age) AS max, round_even(stddev_pop(age), 1) AS std FROM xf"))
def a02(spark, d):
    return A.age_stats(xf(spark, d))


@register("a03_diagnosis_counts", O.with_clean(
    "SELECT diagnosis, count(*) AS n FROM xf GROUP BY diagnosis ORDER BY n DESC, diagnosis LIMIT 15"))
def a03(spark, d):
    return A.diagnosis_counts(xf(spark, d))


@register("a04_gender_counts", O.with_clean("SELECT gender, count(*) AS n FROM xf GROUP BY gender"))
def a04(spark, d):
    return A.gender_counts(xf(spark, d))


@register("a05_age_bin_counts", O.with_clean("SELECT age_bin, count(*) AS n FROM xf GROUP BY age_bin"))
def a05(spark, d):
    return A.age_bin_counts(xf(spark, d))


_MENTIONS = ("mentions AS (SELECT unnest(" + O.split_items("lower(symptoms_en)") + ") AS symptom FROM xf)")


@register("a07_top_symptoms", O.with_clean(
    "SELECT symptom, count(*) AS n FROM mentions GROUP BY symptom ORDER BY n DESC, symptom LIMIT 20", _MENTIONS))
def a07(spark, d):
    return A.top_symptoms(xf(spark, d))


_SETS = ("sets AS (SELECT list_sort(list_distinct(" + O.split_items("lower(coalesce(symptoms, ''))")
         + ")) AS s FROM encounters_raw), "
         "pairs AS (SELECT s[i] || ' + ' || s[j] AS pair FROM sets, range(1, len(s) + 1) a(i), "
         "range(1, len(s) + 1) b(j) WHERE i < j)")


@register("a08_symptom_pairs", O.with_fixture(
    "SELECT pair, count(*) AS n FROM pairs GROUP BY pair ORDER BY n DESC, pair LIMIT 10", _SETS))
def a08(spark, d):
    return A.symptom_pairs(encounters_raw(spark, d))


_RAW_AGES = ("raw_ages AS (SELECT trim(coalesce(diagnosis, '')) AS diagnosis, "
             + O.integer_value("coalesce(age_raw, '')") + " AS age FROM encounters_raw)")


@register("a09_age_by_diagnosis_raw", O.with_fixture(
    "SELECT diagnosis, round_even(avg(age), 1) AS avg_age, min(age) AS min_age, max(age) AS max_age, count(*) AS n "
    "FROM raw_ages WHERE diagnosis <> '' AND age IS NOT NULL GROUP BY diagnosis", _RAW_AGES))
def a09(spark, d):
    return A.age_by_diagnosis_raw(encounters_raw(spark, d))


@register("a10_raw_value_counts", O.with_fixture(
    "SELECT 'diagnosis' AS kind, coalesce(diagnosis, '') AS name, count(*) AS n FROM encounters_raw GROUP BY 2 "
    "UNION ALL SELECT 'gender', coalesce(gender, ''), count(*) FROM encounters_raw GROUP BY 2 "
    "UNION ALL SELECT 'total', '', count(*) FROM encounters_raw"))
def a10(spark, d):
    return A.raw_value_counts(encounters_raw(spark, d))


def profile_ctes(src: str = "encounters_raw", x: str = "") -> str:
    """CTEs ending in ``{x}profiles``: A11 for the rows of ``src``."""
    return (
        f"{x}prow AS (SELECT trim(coalesce(diagnosis, '')) AS diagnosis, "
        + O.integer_value("coalesce(age_raw, '')") + " AS age, coalesce(gender, '') AS gender_raw, "
        + O.split_items("lower(coalesce(symptoms, ''))") + f" AS items FROM {src}), "
        f"{x}pbase AS (SELECT diagnosis, count(*) AS n, coalesce(CAST(round_even(avg(age), 0) AS INTEGER), 0) AS avg_age "
        f"FROM {x}prow WHERE diagnosis <> '' GROUP BY diagnosis), "
        f"{x}psym AS (SELECT diagnosis, symptom, count(*) AS c FROM (SELECT diagnosis, unnest(items) AS symptom FROM {x}prow "
        "WHERE diagnosis <> '') GROUP BY ALL), "
        f"{x}ptop AS (SELECT diagnosis, list(symptom ORDER BY c DESC, symptom) AS syms "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY c DESC, symptom) AS rk FROM {x}psym) "
        "WHERE rk <= 8 GROUP BY diagnosis), "
        f"{x}pgen AS (SELECT diagnosis, array_to_string(list(gender_raw || ':' || c ORDER BY gender_raw), ';') AS genders "
        f"FROM (SELECT diagnosis, gender_raw, count(*) AS c FROM {x}prow WHERE diagnosis <> '' GROUP BY ALL) GROUP BY diagnosis), "
        f"{x}profiles AS (SELECT b.diagnosis, b.n, b.avg_age, coalesce(t.syms, []) AS syms, g.genders "
        f"FROM {x}pbase b LEFT JOIN {x}ptop t USING (diagnosis) LEFT JOIN {x}pgen g USING (diagnosis))")


PROFILE_CTES = profile_ctes()


@register("a11_disease_profiles", O.with_fixture(
    "SELECT diagnosis, n, avg_age, array_to_string(syms, ', ') AS common_symptoms, genders FROM profiles", PROFILE_CTES))
def a11(spark, d):
    return A.flat_profiles(A.disease_profiles(encounters_raw(spark, d)))


@register("a20_removed_counts", O.with_clean(
    "SELECT CAST(sum(copies) AS BIGINT) AS rows_before, count_if(reject_reason IS NULL) AS rows_after, "
    "CAST(sum(copies - 1) AS BIGINT) AS duplicates, "
    + ", ".join(f"count_if(reject_reason = '{r}') AS {r}" for r in C.REASONS)
    + ", round_even(CAST((sum(copies) - count_if(reject_reason IS NULL)) * 100.0 / greatest(1, sum(copies)) AS DOUBLE), 2) AS dropout_pct "
    "FROM staged"))
def a20(spark, d):
    return C.removed_counts(staged(spark, d))


@register("a21_symptom_text_counts", O.with_clean(
    "SELECT count_if(r AND trim(symptoms_raw) <> '') AS normalized_rows, count_if(r AND symptoms <> '') AS rows_with_symptoms, "
    "count_if(r AND symptoms = '') AS empty_after_normalize FROM (SELECT *, (reject_reason IS NULL OR "
    "reject_reason IN ('empty_symptoms', 'empty_text')) AS r FROM staged)"))
def a21(spark, d):
    return C.symptom_text_counts(staged(spark, d))


@register("a22_mean_symptoms", O.with_clean("SELECT round_even(avg(symptoms_count), 2) AS avg_symptoms_per_row FROM xfc"))
def a22(spark, d):
    return A.mean_symptoms(xf(spark, d))


# ---------------------------------------------------------------- lookups
@register("j01_assign_zone_doctor", O.with_clean(
    "SELECT encounter_id, diagnosis, hospital_zone, specialist_doctor FROM " + sql_assign("clean") + " t",
    ",\n".join([ROSTER_CTE, FIRST_DOC_CTE])))
def j01(spark, d):
    return L.assign(C.clean(encounters_raw(spark, d)), L.default_doctors(spark)).select(
        "encounter_id", "diagnosis", "hospital_zone", "specialist_doctor")
