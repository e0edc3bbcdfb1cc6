"""Clinical frames derived from the driver's tables (see FIXTURES.md).

``encounters_raw`` stands in for the encounter CSV: one encounter per order,
symptoms built from the order's line items, every defect of the clean stage
planted. The build is one pass over ``lineitem`` (partial aggregation to five
counts per order, so only one small row per order is shuffled) and one join
with ``orders`` on the order key; duplicates are generated in the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: fixture symptom vocabulary (index, English, Spanish or Catalan).
FIXTURE_SYMPTOMS = [
    (0, "fever", "fiebre"), (1, "cough", "tos"), (2, "fatigue", "fatiga"),
    (3, "headache", "dolor de cabeza"), (4, "shortness of breath", "dificultad para respirar"),
    (5, "chest pain", "dolor de pecho"), (6, "chest tightness", "opressio toracica"),
    (7, "nausea", "nauseas"), (8, "dizziness", "mareo"), (9, "sore throat", "dolor de garganta"),
    (10, "body aches", "dolors musculars"), (11, "runny nose", "congestio nasal"),
    (12, "weight loss", "perdida de peso"), (13, "joint pain", "dolor articular"),
    (14, "abdominal pain", "dolor abdominal"), (15, "swelling", "hinchazon"),
    (16, "blurred vision", "vision borrosa"), (17, "confusion", "confusion"),
    (18, "frequent urination", "miccion frecuente"), (19, "increased thirst", "sed excesiva"),
    (20, "jaundice", "ictericia"), (21, "loss of interest", "perdua d'interes"),
    (22, "loss of taste", "perdua del gust"), (23, "numbness", "entumecimiento"),
    (24, "pain", "dolor"), (25, "sadness", "tristeza"),
    (26, "trouble speaking", "dificultat per parlar"), (27, "wheezing", "xiulets al pit"),
]
# FIXED VALUES: fixture diagnoses by index.
FIXTURE_DIAGNOSES = [
    "Heart Disease", "Hypertension", "Stroke", "Asthma", "COVID-19", "Diabetes",
    "Kidney Disease", "Liver Disease", "Cancer", "Depression", "Migraine", "Bacterial Pneumonia",
]
N_RESIDUES = 5          # symptom slot = l_partkey % 5
DUPLICATE_EVERY = 50    # encounters with id % 50 = 0 appear twice

ENCOUNTER_COLUMNS = [
    "encounter_id", "patient_id", "age_raw", "gender", "symptoms", "diagnosis",
    "date_of_admission", "discharge_date",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit_array(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def encounters_raw(spark: SparkSession, sf_dir: str, with_copy: bool = False) -> DataFrame:
    """The encounter table; ``with_copy`` adds ``copy_no`` (1 or 2), the row's
    position among identical copies, which stands in for a file row number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    slots = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", (F.col("l_partkey") % N_RESIDUES).alias("r"))
        .groupBy("l_orderkey")
        .agg(*[F.count_if(F.col("r") == r).alias(f"c{r}") for r in range(N_RESIDUES)])
    )
    en = _lit_array([e for _, e, _ in FIXTURE_SYMPTOMS])
    es = _lit_array([s for _, _, s in FIXTURE_SYMPTOMS])
    dx = _lit_array(FIXTURE_DIAGNOSES)
    k, cust = F.col("o_orderkey"), F.col("o_custkey")

    def token(r: int):
        idx = ((cust % 12) * 3 + r) % len(FIXTURE_SYMPTOMS)
        return (F.when(k % 4 == 0, F.get(es, idx.cast("int")))
                .when(k % 5 == 0, F.upper(F.get(en, idx.cast("int"))))
                .otherwise(F.get(en, idx.cast("int"))))

    bag = F.flatten(F.array(*[F.array_repeat(token(r), F.col(f"c{r}").cast("int"))
                              for r in range(N_RESIDUES)]))
    toks = F.when(F.col("l_orderkey").isNotNull(), F.array_join(F.array_sort(bag), ", "))

    age_raw = (F.when(k % 97 == 0, F.lit(None).cast("string"))
               .when(k % 89 == 0, "unknown").when(k % 83 == 0, "130")
               .when(k % 61 == 0, "-3").when(k % 59 == 0, "40.7")
               .otherwise((cust % 100).cast("string")))
    gender = F.get(_lit_array(["Male", "female", " M ", "f", "Masculino", "FEMENINO", "otro", "Other"]),
                   (k % 8).cast("int"))
    symptoms = (F.when(k % 73 == 0, F.lit(" , "))
                .when(k % 7 == 0, F.replace(toks, F.lit(", "), F.lit(" ,   ")))
                .when(k % 3 == 0, F.replace(toks, F.lit(", "), F.lit(",")))
                .otherwise(toks))
    name = F.get(dx, (cust % 12).cast("int"))
    diagnosis = (F.when(k % 79 == 0, F.lit("  "))
                 .when(k % 6 == 0, F.concat(F.lit(" "), name)).otherwise(name))
    adm = F.col("o_orderdate").cast("date")

    base = (
        orders.join(slots, orders.o_orderkey == slots.l_orderkey, "left")
        .select(
            k.alias("encounter_id"), cust.alias("patient_id"), age_raw.alias("age_raw"),
            gender.alias("gender"), symptoms.alias("symptoms"), diagnosis.alias("diagnosis"),
            adm.alias("date_of_admission"),
            F.date_add(adm, (k % 30).cast("int")).alias("discharge_date"),
            F.explode(F.sequence(F.lit(1), F.when(k % DUPLICATE_EVERY == 0, 2).otherwise(1))).alias("_copy"),
        )
    )
    return base.withColumnRenamed("_copy", "copy_no") if with_copy else base.drop("_copy")


def fixture_sql() -> str:
    """The same fixture as DuckDB CTEs (``encounters_raw`` is the last one)."""
    sym = ",\n  ".join(
        "({}, '{}', '{}')".format(i, e.replace("'", "''"), s.replace("'", "''"))
        for i, e, s in FIXTURE_SYMPTOMS)
    dx = ",\n  ".join("({}, '{}')".format(i, n) for i, n in enumerate(FIXTURE_DIAGNOSES))
    return f"""sym AS (SELECT * FROM (VALUES {sym}) AS s(idx, en, es)),
dx AS (SELECT * FROM (VALUES {dx}) AS d(idx, name)),
tok AS (SELECT o.o_orderkey AS k, CASE WHEN o.o_orderkey % 4 = 0 THEN s.es WHEN o.o_orderkey % 5 = 0 THEN upper(s.en) ELSE s.en END AS tk
 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN sym s ON s.idx = ((o.o_custkey % 12) * 3 + l.l_partkey % 5) % 28),
agg AS (SELECT k, array_to_string(list_sort(list(tk)), ', ') AS toks FROM tok GROUP BY k),
base AS (SELECT o.o_orderkey AS encounter_id, o.o_custkey AS patient_id,
 CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 89 = 0 THEN 'unknown' WHEN o.o_orderkey % 83 = 0 THEN '130' WHEN o.o_orderkey % 61 = 0 THEN '-3' WHEN o.o_orderkey % 59 = 0 THEN '40.7' ELSE CAST(o.o_custkey % 100 AS VARCHAR) END AS age_raw,
 CASE o.o_orderkey % 8 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN ' M ' WHEN 3 THEN 'f' WHEN 4 THEN 'Masculino' WHEN 5 THEN 'FEMENINO' WHEN 6 THEN 'otro' ELSE 'Other' END AS gender,
 CASE WHEN o.o_orderkey % 73 = 0 THEN ' , ' WHEN o.o_orderkey % 7 = 0 THEN replace(a.toks, ', ', ' ,   ') WHEN o.o_orderkey % 3 = 0 THEN replace(a.toks, ', ', ',') ELSE a.toks END AS symptoms,
 CASE WHEN o.o_orderkey % 79 = 0 THEN '  ' WHEN o.o_orderkey % 6 = 0 THEN concat(' ', d.name) ELSE d.name END AS diagnosis,
 CAST(o.o_orderdate AS DATE) AS date_of_admission, CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 30 AS INT) AS discharge_date
 FROM orders o JOIN dx d ON d.idx = o.o_custkey % 12 LEFT JOIN agg a ON a.k = o.o_orderkey),
encounters_raw AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE encounter_id % 50 = 0)"""
