"""Section 8 traps on small hand-made frames; expected values read from the rules."""

from pyspark.sql import functions as F

from carelake.functions import text as T
from carelake.operators import clean as C
from carelake.operators import lookup as L


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_title_case_non_binary(spark):
    # K5: a letter after a non-letter is upper case.
    assert one(spark, T.title_case(F.col("v")), "non-binary") == "Non-Binary"
    assert one(spark, T.normalize_gender(F.col("v")), " m ") == "Male"
    assert one(spark, T.normalize_gender(F.col("v")), "FEMENINO") == "Female"
    assert one(spark, T.normalize_gender(F.col("v")), "otro") == "Other"


def test_unicode_blanks(spark):
    # K4: a no-break space is a blank for strip and collapse; only blanks after
    # a comma are normalised, so the blank before it stays.
    assert one(spark, T.normalize_symptoms(F.col("v")), " Fever ,  Cough ,") == "fever , cough"


def test_age_parse_rules(spark):
    # K3: 40d is not a number; 1e2 is 100; 40.7 truncates; inf is rejected.
    vals = {"40d": None, "1e2": 100, "40.7": 40, " 7 ": 7, "inf": None, "-0.5": 0}
    for raw, want in vals.items():
        got = one(spark, T.numeric_value(F.col("v")).cast("int"), raw)
        assert got == want, raw
    assert one(spark, T.integer_value(F.col("v")), "1_000") == 1000
    assert one(spark, T.integer_value(F.col("v")), "40.0") is None


def test_translation_longest_key_and_case(spark):
    # Substring match, longest key wins; untranslated items keep their case.
    assert one(spark, T.translate_symptoms(F.col("v")), "dolor de cabeza fuerte, Tos, XYZ") == \
        "headache, cough, XYZ"
    # "tos" inside a longer word still matches.
    assert one(spark, T.translate_symptoms(F.col("v")), "tostada") == "cough"
    assert one(spark, T.translate_symptoms(F.col("v")), " , ") == ""


def test_keyword_zone_order(spark):
    # Hepatitis goes to Infectologia before Hepatologia; leukem to Oncologia.
    assert one(spark, T.keyword_zone(F.col("v")), "Viral Hepatitis") == "Infectologia"
    assert one(spark, T.keyword_zone(F.col("v")), "Acute Leukemia") == "Oncologia"
    assert one(spark, T.keyword_zone(F.col("v")), "  ") is None


def test_assignment_prefers_roster(spark):
    # The zone's first active doctor replaces the mapped doctor.
    df = spark.createDataFrame([("Bronchitis",), ("Unknown Thing",)], "diagnosis string")
    out = {r["diagnosis"]: (r["hospital_zone"], r["specialist_doctor"])
           for r in L.assign(df, L.default_doctors(spark)).collect()}
    assert out["Bronchitis"] == ("Neumologia", "Dra. Sofia Ibanez (Neumologia)")
    assert out["Unknown Thing"] == ("Medicina General", "Dr. Equipo de Guardia")


def test_reject_order_and_counts(spark):
    # K1: the first rule that hits after dedupe; counts add up.
    rows = [
        (1, "40", "M", "fever", "Flu"), (1, "40", "M", "fever", "Flu"),        # duplicate
        (2, None, "M", "fever", "Flu"),                                        # missing
        (3, "abc", "M", "fever", "Flu"),                                       # invalid age
        (4, "130", "M", "fever", "Flu"),                                       # outlier
        (5, "30", "M", " , ", "Flu"),                                          # empty symptoms
        (6, "30", "M", "cough", "  "),                                         # empty text
        (7, "30", "f", "Cough", " Flu"),                                       # kept
    ]
    raw = spark.createDataFrame(rows, "encounter_id long, age_raw string, gender string, symptoms string, diagnosis string")
    rc = C.removed_counts(C.stage_rows(raw)).first().asDict()
    assert rc["rows_before"] == 8 and rc["rows_after"] == 2
    assert (rc["duplicates"], rc["missing_critical"], rc["invalid_age"], rc["age_outliers"],
            rc["empty_symptoms"], rc["empty_text"]) == (1, 1, 1, 1, 1, 1)
    assert rc["rows_before"] - rc["rows_after"] == sum(rc[k] for k in ["duplicates"] + C.REASONS)


def test_label_translation_defaults(spark):
    # Unknown language uses es; missing key keeps value; blank shows a dash.
    df = spark.createDataFrame([("Asthma", "fr"), ("Foo", "ca"), ("", "en")], "v string, lang string")
    got = [r[0] for r in df.select(L.translate_label("diagnosis", F.col("v"), "lang")).collect()]
    assert got == ["Asma", "Foo", "—"]
