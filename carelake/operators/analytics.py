"""Descriptive analytics over clean and raw encounters.

Every figure is a grouped or global aggregation with partial (map-side)
aggregation; only (key, partial) rows cross the shuffle. Top-k per group uses
``row_number`` filters, which Spark turns into a group limit before the
shuffle. Ties in counts go by name ascending (stated deviation K8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import text as T


def _top(df: DataFrame, key: str, n: int | None, count_col: str = "n") -> DataFrame:
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
    out = out.orderBy(F.desc(count_col), F.asc(key))
    return out.limit(n) if n else out


def totals(xf: DataFrame) -> DataFrame:
    """A01."""
    return xf.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("diagnosis").alias("distinct_diagnoses"),
        F.count_distinct("gender").alias("distinct_genders"),
    )


def age_stats(xf: DataFrame) -> DataFrame:
    """Mean and population std to 1 digit, median truncated, min, max.

    ``percentile`` keeps a value -> count buffer, so memory is bounded by the
    number of distinct ages, not by rows.
    """
    return xf.agg(
        F.bround(F.avg("age"), 1).alias("mean"),
        F.percentile(F.col("age"), F.lit(0.5)).alias("_median"),
        F.min("age").alias("min"),
        F.max("age").alias("max"),
        F.bround(F.stddev_pop("age"), 1).alias("std"),
    ).select("mean", F.col("_median").cast("int").alias("median"), "min", "max", "std")


def diagnosis_counts(xf: DataFrame, n: int = 15) -> DataFrame:
    """A03."""
    return _top(xf, "diagnosis", n)


def gender_counts(xf: DataFrame) -> DataFrame:
    """A04."""
    return _top(xf, "gender", None)


def age_bin_counts(xf: DataFrame) -> DataFrame:
    """In label order."""
    return xf.groupBy("age_bin").agg(F.count(F.lit(1)).alias("n")).orderBy("age_bin")


def age_by_diagnosis(xf: DataFrame, n: int = 15) -> DataFrame:
    """Mean (1 digit), min, max, count per diagnosis, top n by count."""
    return (
        xf.groupBy("diagnosis")
        .agg(F.bround(F.avg("age"), 1).alias("avg_age"), F.min("age").alias("min_age"),
             F.max("age").alias("max_age"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("diagnosis"))
        .limit(n)
    )


def symptom_mentions(xf: DataFrame, col: str = "symptoms_en") -> DataFrame:
    """Every mention (bag) of a lower-cased, stripped, non-blank item."""
    # explode_outer + null filter: a plain explode makes the optimizer add a
    # size() > 0 filter that recomputes the item list (and any translation).
    return xf.select(F.explode_outer(T.split_items(F.lower(col))).alias("symptom")).filter(F.col("symptom").isNotNull())


def top_symptoms(xf: DataFrame, n: int = 20, col: str = "symptoms_en") -> DataFrame:
    """Every mention counted."""
    return _top(symptom_mentions(xf, col), "symptom", n)


def mean_symptoms(xf: DataFrame) -> DataFrame:
    """A22."""
    return xf.agg(F.bround(F.avg("symptoms_count"), 2).alias("avg_symptoms_per_row"))


# ------------------------------------------------------------ raw rows
def raw_text(c: str):
    """A missing CSV field is read as an empty string by a dict reader."""
    return F.coalesce(F.col(c), F.lit(""))


def symptom_set(c: str = "symptoms"):
    """Distinct, lower-cased, stripped, non-blank items, sorted."""
    return F.array_sort(F.array_distinct(T.split_items(F.lower(raw_text(c)))))


def symptom_pairs(raw: DataFrame, n: int = 10) -> DataFrame:
    """Top pairs of distinct symptoms per row, ``a + b`` with a < b.

    Two generators in a row make the pairs of the sorted set one by one (first symptom,
    then those after it), so no array of pairs exists; counts are partially aggregated.
    """
    firsts = raw.select(symptom_set().alias("s")).select("s", F.posexplode_outer("s").alias("i", "a"))
    later = F.slice("s", F.col("i") + 2, F.greatest(F.size("s"), F.lit(1)))
    pairs = firsts.select("a", F.explode_outer(later).alias("b")).filter(F.col("b").isNotNull())
    return _top(pairs.select(F.concat_ws(" + ", "a", "b").alias("pair")), "pair", n)


def age_by_diagnosis_raw(raw: DataFrame) -> DataFrame:
    """Integer ages only, stripped non-blank diagnosis, by mean ascending."""
    age = T.integer_value(raw_text("age_raw"))
    d = T.py_strip(raw_text("diagnosis"))
    return (
        raw.select(d.alias("diagnosis"), age.alias("age"))
        .filter((F.col("diagnosis") != "") & F.col("age").isNotNull())
        .groupBy("diagnosis")
        .agg(F.bround(F.avg("age"), 1).alias("avg_age"), F.min("age").alias("min_age"),
             F.max("age").alias("max_age"), F.count(F.lit(1)).alias("n"))
        .orderBy("avg_age", "diagnosis")
    )


def raw_value_counts(raw: DataFrame) -> DataFrame:
    """A10: raw diagnosis and gender counts plus the total, one long table."""
    cols = set(raw.columns)

    def counts(kind: str, c: str):
        v = raw_text(c) if c in cols else F.lit("Unknown")
        return raw.groupBy(v.alias("name")).agg(F.count(F.lit(1)).alias("n")) \
            .select(F.lit(kind).alias("kind"), "name", "n")

    total = raw.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("kind"), F.lit("").alias("name"), "n")
    return counts("diagnosis", "diagnosis").unionByName(counts("gender", "gender")).unionByName(total)


def disease_profiles(raw: DataFrame, top_k: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """A11 + W01: per stripped diagnosis (and ``by``), count, top symptoms, whole mean age, genders.

    One pass: each row gives (kind, value) rows for itself, its gender and its
    symptoms; one partial aggregation counts them, and everything after works on
    a row per distinct value.
    """
    keys = [*by, "diagnosis"]
    values = F.concat(
        F.array(F.struct(F.lit("row").alias("kind"), F.lit("").alias("value")),
                F.struct(F.lit("gender").alias("kind"), F.coalesce(F.col("gender"), F.lit("")).alias("value"))),
        F.transform(T.split_items(F.lower(raw_text("symptoms"))),
                    lambda s: F.struct(F.lit("symptom").alias("kind"), s.alias("value"))))
    rows = raw.select(*by, T.py_strip(raw_text("diagnosis")).alias("diagnosis"),
                      T.integer_value(raw_text("age_raw")).alias("age"), values.alias("vs")).filter(F.col("diagnosis") != "")
    counts = (rows.select(*keys, "age", F.explode_outer("vs").alias("v"))
              .groupBy(*keys, "v.kind", "v.value")
              .agg(F.count(F.lit(1)).alias("c"), F.sum("age").alias("age_sum"), F.count("age").alias("ages")))
    rank = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.desc("c"), F.asc("value")))
    counts = counts.withColumn("rk", rank).filter((F.col("kind") != "symptom") | (F.col("rk") <= top_k))
    row = F.col("kind") == "row"
    return (counts.groupBy(*keys).agg(
                F.max(F.when(row, F.col("c"))).alias("n"),
                F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "symptom", F.struct("rk", "value")))),
                            lambda x: x["value"]).alias("common_symptoms"),
                F.bround(F.max(F.when(row & (F.col("ages") > 0), F.col("age_sum") / F.col("ages"))), 0).cast("int").alias("avg"),
                F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "gender", F.struct("value", "c")))))
                .alias("gender_distribution"))
            .select(*keys, "n", "common_symptoms", F.coalesce("avg", F.lit(0)).alias("avg_age"), "gender_distribution"))


def flat_profiles(profiles: DataFrame) -> DataFrame:
    """Render list and map columns as sorted text for value comparison."""
    return profiles.select(
        "diagnosis", "n", "avg_age",
        F.array_join("common_symptoms", ", ").alias("common_symptoms"),
        F.array_join(F.transform(F.map_entries("gender_distribution"),
                                 lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))),
                     ";").alias("genders"),
    )
