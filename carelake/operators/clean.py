"""Clean stage: P01-P05, P11, P12 and the counts of A20 and A21.

Duplicates are removed with a grouping over all input columns that also keeps
the multiplicity (``copies``), so one shuffle serves both the dedupe and the
duplicate count. Every remaining row gets the first reject reason that hits,
in the order of the reference's clean steps (K1), and the report counts are
one conditional aggregation over that column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T

CRITICAL = ["age_raw", "gender", "symptoms", "diagnosis"]
REASONS = ["missing_critical", "invalid_age", "age_outliers", "empty_symptoms", "empty_text"]


def stage_rows(raw: DataFrame) -> DataFrame:
    """Distinct input rows with ``copies``, cleaned columns and ``reject_reason``."""
    return annotate(raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("copies")), raw.columns)


def annotate(d: DataFrame, cols: list[str]) -> DataFrame:
    """Cleaned columns and the first reject reason for rows already deduplicated.

    Parsed age, normalised symptoms and stripped diagnosis are columns of
    their own, so each is computed once per row and then only referenced.
    """
    d = (d.withColumn("_age_d", T.numeric_value("age_raw"))
          .withColumn("_sym", T.normalize_symptoms("symptoms"))
          .withColumn("_diag", T.py_strip("diagnosis")))
    age_d, sym, diag = F.col("_age_d"), F.col("_sym"), F.col("_diag")
    any_null = None
    for c in CRITICAL:
        any_null = F.col(c).isNull() if any_null is None else (any_null | F.col(c).isNull())
    # The reason names the count, so a filter on it stays above the grouping: the cleaned text
    # is built once a distinct row.
    reason = (
        F.when(F.col("copies") < 1, "no_row")
        .when(any_null, "missing_critical")
        .when(age_d.isNull(), "invalid_age")
        .when((age_d <= K.AGE_MIN - 1) | (age_d >= K.AGE_MAX + 1), "age_outliers")
        .when(sym == "", "empty_symptoms")
        .when(diag == "", "empty_text")
    )
    d = d.withColumn("_reason", reason)
    passthrough = [c for c in cols if c not in ("age_raw", "gender", "symptoms", "diagnosis")]
    return d.select(
        *passthrough,
        "age_raw",
        F.when(F.col("_reason").isNull(), age_d.cast("int")).alias("age"),
        T.normalize_gender("gender").alias("gender"),
        sym.alias("symptoms"),
        diag.alias("diagnosis"),
        "copies",
        F.col("_reason").alias("reject_reason"),
        F.col("symptoms").alias("symptoms_raw"),
    )


def kept(staged: DataFrame) -> DataFrame:
    """Rows that pass every rule (one per distinct input row)."""
    return staged.filter(F.col("reject_reason").isNull()).drop("reject_reason", "copies")


def clean(raw: DataFrame) -> DataFrame:
    return kept(stage_rows(raw))


def removed_counts(staged: DataFrame) -> DataFrame:
    """Removed rows by reason, before, after and dropout percent."""
    before = F.sum("copies")
    after = F.count_if(F.col("reject_reason").isNull())
    aggs = [
        before.alias("rows_before"),
        after.alias("rows_after"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
    ] + [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]
    return staged.agg(*aggs).select(
        "rows_before", "rows_after", "duplicates", *REASONS,
        F.bround((F.col("rows_before") - F.col("rows_after")) * 100.0
                 / F.greatest(F.lit(1), F.col("rows_before")), 2).alias("dropout_pct"),
    )


def symptom_text_counts(staged: DataFrame) -> DataFrame:
    """Symptom text counts inside the clean step (rows reaching it)."""
    reach = F.col("reject_reason").isNull() | F.col("reject_reason").isin("empty_symptoms", "empty_text")
    return staged.agg(
        F.count_if(reach & (T.py_strip("symptoms_raw") != "")).alias("normalized_rows"),
        F.count_if(reach & (F.col("symptoms") != "")).alias("rows_with_symptoms"),
        F.count_if(reach & (F.col("symptoms") == "")).alias("empty_after_normalize"),
    )
