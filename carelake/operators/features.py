"""Transform stage (P07, P09, P13-P15) and model-side row features.

The translator is a parameter (X01): any ``Column -> Column`` function, by
default the dictionary translation P13; ``None`` keeps the text unchanged.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import text as T

Translator = Callable[[Column], Column]


def transform(clean_df: DataFrame, translator: Translator | None = T.translate_symptoms) -> DataFrame:
    """Add gender_enc, age_bin, symptoms_en and symptoms_count to clean rows."""
    src = F.col("symptoms")
    en = translator(src) if translator is not None else src
    en = T.renormalize_translated(en)
    return (
        clean_df
        .withColumn("gender_enc", T.gender_code_etl("gender"))
        .withColumn("age_bin", T.age_bin("age"))
        .withColumn("symptoms_en", en)
        .withColumn("symptoms_count", T.symptom_count("symptoms_en"))
    )


def model_rows(raw: DataFrame) -> DataFrame:
    """Training rows (P06, P08, P16, P17) from raw encounters.

    Rows need the four critical fields; the age must convert like ``int()`` on
    the parsed number. Stay length feeds only the risk label (K22).
    """
    d = raw.filter(
        F.col("age_raw").isNotNull() & F.col("gender").isNotNull()
        & F.col("symptoms").isNotNull() & F.col("diagnosis").isNotNull()
    ).withColumn("_age_d", T.numeric_value("age_raw"))
    d = d.filter(F.col("_age_d").isNotNull() & (F.abs(F.col("_age_d")) < 2.0 ** 31))
    d = d.withColumn("_days", T.stay_days("date_of_admission", "discharge_date")) \
        .withColumn("_age", F.col("_age_d").cast("int"))
    days, age = F.col("_days"), F.col("_age")
    key = (F.col("encounter_id") * 8 + F.col("copy_no")) if "copy_no" in raw.columns else F.col("encounter_id")
    return d.select(
        "encounter_id",
        key.alias("row_key"),
        age.alias("age"),
        F.col("gender"),
        F.col("diagnosis"),
        days.alias("days_stayed"),
        T.assign_risk(F.col("diagnosis"), age, days).alias("risk_level"),
        T.gender_code_train("gender").alias("gender_enc"),
        T.py_strip(F.lower("symptoms")).alias("symptoms_clean"),
    )
