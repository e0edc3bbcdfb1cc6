"""Zone and doctor assignment, label translation, roster seed.

Lookup tables are tiny constant frames or literal maps. Joins carry no
broadcast hint: the planner broadcasts a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` (exact for driver-built frames), and
AQE switches a shuffle join to a broadcast only after measuring the shuffled
side; above the bound the shuffle join stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from carelake.functions import constants as K
from carelake.functions import text as T

DOCTOR_SCHEMA = TT.StructType([
    TT.StructField("id", TT.LongType()), TT.StructField("name", TT.StringType()),
    TT.StructField("specialty", TT.StringType()), TT.StructField("zone", TT.StringType()),
    TT.StructField("email", TT.StringType()), TT.StructField("phone", TT.StringType()),
    TT.StructField("shift", TT.StringType()), TT.StructField("notes", TT.StringType()),
    TT.StructField("is_active", TT.IntegerType()),
])


def default_doctors(spark: SparkSession) -> DataFrame:
    """The seeded roster: id = position from 1, all active."""
    rows = [(i + 1, n, s, z, e, p, sh, "", 1) for i, (n, s, z, e, p, sh) in enumerate(K.DEFAULT_DOCTOR_ROSTER)]
    return T.const_frame(spark, rows, DOCTOR_SCHEMA)


def active_doctors(doctors: DataFrame) -> DataFrame:
    """P24 + L05: active doctors, 11 columns, by lower name."""
    cols = ["id", "name", "specialty", "zone", "email", "phone", "shift", "notes", "is_active"]
    extra = [c for c in ("created_at", "updated_at") if c in doctors.columns]
    return doctors.filter(F.col("is_active") == 1).select(*cols, *extra).orderBy(F.lower("name"), "id")


def first_doctor_per_zone(doctors: DataFrame) -> DataFrame:
    """Lowest-id active doctor per lower(zone), rendered ``name (specialty or zone)``."""
    act = doctors.filter((F.col("is_active") == 1) & (F.lower(T.py_strip("zone")) != ""))
    w = Window.partitionBy(F.lower(T.py_strip("zone"))).orderBy("id")
    spec = F.when(F.coalesce(F.col("specialty"), F.lit("")) == "", None).otherwise(F.col("specialty"))
    return (act.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1")
            .filter(F.coalesce(F.col("name"), F.lit("")) != "")
            .select(F.lower(T.py_strip("zone")).alias("_zone_key"),
                    F.col("name").alias("_doc_name"), spec.alias("_doc_spec")))


def zone_for(diagnosis: Column) -> Column:
    """J01 zone: exact map, else keyword zone, else Medicina General."""
    return F.coalesce(T.mapped_zone(diagnosis), T.keyword_zone(diagnosis), F.lit(K.DEFAULT_ZONE))


def assign(df: DataFrame, doctors: DataFrame, diagnosis_col: str = "diagnosis",
           zone_col: str = "hospital_zone", doctor_col: str = "specialist_doctor") -> DataFrame:
    """J01 + J02 (K15): roster doctor of the zone, else the mapped doctor, else the duty team."""
    d = F.col(diagnosis_col)
    with_zone = (df.withColumn(zone_col, zone_for(d))
                 .withColumn("_mapped_doc", F.coalesce(T.mapped_doctor(d), F.lit(K.DUTY_DOCTOR))))
    roster = first_doctor_per_zone(doctors)
    j = with_zone.join(roster, F.lower(F.col(zone_col)) == roster["_zone_key"], "left")
    doc_text = F.when(F.col("_doc_name").isNotNull(),
                      F.format_string("%s (%s)", F.col("_doc_name"),
                                      F.coalesce(F.col("_doc_spec"), F.col(zone_col))))
    return (j.withColumn(doctor_col, F.coalesce(doc_text, F.col("_mapped_doc")))
            .drop("_zone_key", "_doc_name", "_doc_spec", "_mapped_doc"))


def zone_catalogue(spark: SparkSession) -> DataFrame:
    """One row per mapped diagnosis with its zone and doctor."""
    return T.const_frame(spark, K.DIAGNOSIS_ASSIGNMENTS, "diagnosis string, zone string, doctor string")


def label_map(kind: str, lang: Column | str) -> Column:
    """Literal (lang -> key -> label) map for one kind; unknown language uses es."""
    tbl = K.label_table(kind)
    outer = F.create_map(*[
        v for lg, m in tbl.items()
        for v in (F.lit(lg), F.create_map(*[F.lit(x) for kv in m.items() for x in kv]))
    ])
    lg = F.col(lang) if isinstance(lang, str) else lang
    return F.coalesce(F.try_element_at(outer, lg), F.try_element_at(outer, F.lit(K.DEFAULT_LABEL_LANG)))


def translate_label(kind: str, value: Column, lang: Column | str) -> Column:
    """Missing key keeps the value; blank shows a dash (blank symptom stays blank)."""
    m = label_map(kind, lang)
    if kind == "symptom":
        key = F.lower(T.py_strip(value))
        out = F.coalesce(F.try_element_at(m, key), value)
        return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(out)
    out = F.coalesce(F.try_element_at(m, value), value)
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("—")).otherwise(out)


def translate_symptom_list(value: Column, lang: Column | str) -> Column:
    """J08 list form: split on ',', translate each stripped item, drop blanks, join ', '."""
    items = F.transform(F.split(F.coalesce(value, F.lit("")), ","),
                        lambda s: translate_label("symptom", T.py_strip(s), lang))
    return F.array_join(F.filter(items, lambda s: s != ""), ", ")


def translate_symptom_pair(value: Column, lang: Column | str) -> Column:
    """J08 pair form: split on '+', translate each stripped item, join ' + '."""
    items = F.transform(F.split(F.coalesce(value, F.lit("")), r"\+"),
                        lambda s: translate_label("symptom", T.py_strip(s), lang))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(F.array_join(items, " + "))


def seed_roster(existing: DataFrame, spark: SparkSession) -> DataFrame:
    """Default doctors absent by (lower name, lower specialty) appended to ``existing``.

    New rows take ids after the current maximum, in roster order.
    """
    defaults = default_doctors(spark)
    key = lambda df: [F.lower(T.py_strip(F.col("name"))).alias("_kn"),
                      F.lower(T.py_strip(F.col("specialty"))).alias("_ks")]
    have = existing.select(*key(existing)).distinct()
    pending = (defaults.select("*", *key(defaults))
               .join(have, ["_kn", "_ks"], "left_anti").drop("_kn", "_ks"))
    # One scalar reaches the driver; pending holds at most the 18 roster rows,
    # so its single-partition numbering window is bounded.
    max_id = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    w = Window.orderBy("id")
    pending = pending.withColumn("id", (F.lit(max_id) + F.row_number().over(w)).cast("long"))
    return existing.unionByName(pending.select(*existing.columns))
