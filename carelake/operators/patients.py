"""Stored patients: lookup, search, newest lists and dashboard figures.

P18, P19, L01, A13-A16, A23, A33, A34. Newest-first lists are top-k
(``orderBy(...).limit``), which Spark plans as TakeOrderedAndProject: each
partition keeps its own k rows, so no full sort or single-task gather of
the table happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators.logs import clamp

SEARCH_COLUMNS = ["id", "patient_name", "age", "gender", "diagnosis", "risk_level",
                  "hospital_zone", "specialist_doctor", "created_at"]


def by_id(p: DataFrame, patient_id: int) -> DataFrame:
    """P18."""
    return p.filter(F.col("id") == F.lit(patient_id))


def search(p: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Name contains the text (no case, LIKE wildcards kept) or id equals a digit query.

    A blank query gives no rows. Newest first; ties by id descending.
    """
    q = (query or "").strip()
    k = clamp(limit, 20, 1, 100)
    if not q:
        return p.select(*SEARCH_COLUMNS).limit(0)
    cond = F.col("patient_name").ilike(f"%{q}%")
    if q.isdigit():
        cond = cond | (F.col("id") == F.lit(int(q)))
    return p.filter(cond).select(*SEARCH_COLUMNS).orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def newest(p: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest patients (created_at, id), limit 1..1000, default 200."""
    k = clamp(limit, 200, 1, 1000)
    return p.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def age_summary(p: DataFrame) -> DataFrame:
    """Total, mean age to 1 digit half away from zero (exact), min, max.

    The mean is rounded from the exact integer quotient, as a numeric average
    would be: round_half_up(10 * sum / n) = (20 * sum + n) div (2 * n).
    """
    agg = p.agg(F.count(F.lit(1)).alias("total_patients"), F.sum("age").alias("_s"),
                F.count("age").alias("_c"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    mean = F.when(F.col("_c") > 0, F.expr("(20 * _s + _c) div (2 * _c)") / 10.0)
    return agg.select("total_patients", mean.alias("avg_age"), "min_age", "max_age")


def count_by(p: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """A14 (diagnosis, top 10), A15 (zone), A16 (risk level): ``name, count`` by count."""
    out = (p.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), F.asc("name")))
    return out.limit(limit) if limit else out


def risk_view(p: DataFrame) -> DataFrame:
    """A16 as shown: blank levels hidden."""
    return count_by(p, "risk_level").filter(F.coalesce(F.col("name"), F.lit("")) != "")


def age_histogram(spark: SparkSession, p: DataFrame, newest_n: int = 1000) -> DataFrame:
    """Age bins of the newest patients; every bin present; missing age counts as 0."""
    recent = newest(p, newest_n).select(T.age_bin(F.coalesce(F.col("age"), F.lit(0))).alias("name"))
    counts = recent.groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    bins = T.const_frame(spark, [(b, i) for i, (b, _u) in enumerate(K.AGE_BINS)], "name string, ord int")
    return (bins.join(counts, "name", "left")
            .select("name", F.coalesce("count", F.lit(0)).alias("count"), "ord").orderBy("ord").drop("ord"))


def report_figures(p: DataFrame) -> DataFrame:
    """A34 (+ A33 patient part): totals, mean age, top diagnosis and top zone, one row.

    One grouped aggregation over (diagnosis, zone) with map-side combine reads
    the patients once; the totals and the two top-1 lookups come from that
    small table (its shuffle is reused by the three branches).
    """
    g = p.groupBy("diagnosis", "hospital_zone").agg(
        F.count(F.lit(1)).alias("c"), F.sum("age").alias("s"), F.count("age").alias("ca"),
        F.min("age").alias("mn"), F.max("age").alias("mx"))
    tot = g.agg(F.sum("c").alias("total_patients"), F.sum("s").alias("_s"), F.sum("ca").alias("_c"),
                F.min("mn").alias("min_age"), F.max("mx").alias("max_age"))
    mean = F.when(F.col("_c") > 0, F.expr("(20 * _s + _c) div (2 * _c)") / 10.0)
    s = tot.select("total_patients", mean.alias("avg_age"), "min_age", "max_age", F.lit(1).alias("_k"))
    dx = (g.groupBy("diagnosis").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "diagnosis").limit(1)
          .select(F.col("diagnosis").alias("top_diagnosis"), F.lit(1).alias("_k")))
    zn = (g.groupBy("hospital_zone").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "hospital_zone").limit(1)
          .select(F.col("hospital_zone").alias("top_zone"), F.lit(1).alias("_k")))
    # Each side is exactly one row; the join on the constant key pairs them.
    return s.join(dx, "_k", "left").join(zn, "_k", "left").drop("_k")
