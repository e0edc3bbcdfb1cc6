"""Record tables derived from the driver's data (FIXTURES.md section B2).

In production these are reads of stored tables (S09, S15) with the same
schemas; here Spark derives them from the given tables so every query grows
with them:

  patients           clean encounters with assignment and rule risk
  notifications      ``events``
  xray_predictions   ``embeddings`` (softmax of the first 3 elements)
  manual catalogue   diseases, symptoms and links typed in by staff, taken
                     from encounters whose id is a multiple of 11
  image manifest     ``pages``
  split scores       clean encounters with a shifted prediction every 7th id
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import clean as C
from carelake.operators import lookup as L
from carelake.session import written
from carelake.sources.fixture import encounters_raw, table

PREDICTION_EPOCH = "2024-01-01 00:00:00"
LOGIT_SCALE = 10.0         # the first 3 embedding elements times 10 are the class logits
MANUAL_PART = 2            # the manual catalogue holds the diseases whose name hash is even
MANUAL_EXTRA = "Rare Syndrome"   # FIXED VALUE: one manual disease without symptoms
ACTIVE_EVERY = 3           # second dataset: encounter_id % 3 = 0
MISPREDICT_EVERY = 7       # split scores: every 7th id predicts the next class


def hash_id(c) -> F.Column:
    """Deterministic id from text: first 8 hex digits of md5 (same in DuckDB)."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def dataset_tag(encounter_id) -> F.Column:
    return F.when(F.col(encounter_id) % ACTIVE_EVERY == 0, "active").otherwise("main")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored patients: 15 columns as the patients table."""
    c = C.clean(encounters_raw(spark, sf_dir))
    days = T.stay_days("date_of_admission", "discharge_date")
    c = c.select(
        F.col("encounter_id").alias("id"),
        F.concat(F.lit("Paciente DS-"), F.col("encounter_id").cast("string")).alias("patient_name"),
        "age", "gender", F.col("symptoms_raw").alias("symptoms"),
        T.renormalize_translated(T.translate_symptoms("symptoms")).alias("symptoms_translated"),
        "diagnosis", F.lit(1.0).alias("diagnosis_confidence"),
        T.assign_risk(F.col("diagnosis"), F.col("age"), days).alias("risk_level"),
        F.lit(1.0).alias("risk_confidence"),
        dataset_tag("encounter_id").alias("source_dataset"),
        F.lit("import").alias("created_by"),
        F.col("date_of_admission").cast("timestamp").alias("created_at"),
    )
    a = L.assign(c, L.default_doctors(spark))
    return a.select("id", "patient_name", "age", "gender", "symptoms", "symptoms_translated", "diagnosis",
                    "diagnosis_confidence", "risk_level", "risk_confidence", "hospital_zone",
                    "specialist_doctor", "source_dataset", "created_by", "created_at")


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    level = (F.when(t == "error", "error").when(t == "purchase", "success")
             .when(t == "signup", "warning").otherwise("info"))
    return e.select(
        F.col("event_id").alias("id"), level.alias("level"), t.alias("source"), t.alias("title"),
        F.col("props").alias("message"), F.lit("").alias("meta"),
        (F.col("user_id") % 2).cast("int").alias("is_read"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def xray_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log: class probabilities as an array (order of XRAY_CLASSES) and a map."""
    e = table(spark, sf_dir, "embeddings")
    z = [F.exp(F.get("embedding", i).cast("double") * LOGIT_SCALE) for i in range(3)]
    total = z[0] + z[1] + z[2]
    probs = F.array(*[zi / total for zi in z])
    base = e.select(
        F.col("vec_id").alias("pred_id"),
        (F.to_timestamp(F.lit(PREDICTION_EPOCH)) + F.make_interval(mins=F.col("vec_id").cast("int"))).alias("timestamp"),
        F.concat(F.lit("rx_"), F.col("vec_id").cast("string"), F.lit(".png")).alias("filename"),
        probs.alias("probs"),
        F.col("label").alias("true_label"),
    )
    from carelake.operators.logs import score_xray
    return score_xray(base, "probs")


def manual_catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(diseases, symptoms, disease_symptoms) as the three stored tables, from all encounters."""
    raw = encounters_raw(spark, sf_dir)
    seed = (raw.filter(F.col("diagnosis").isNotNull())
            .select("encounter_id", F.upper(T.normalize_term("diagnosis")).alias("disease"),
                    F.posexplode_outer(T.split_items(F.coalesce("symptoms", F.lit("")))).alias("pos", "spelling"))
            .filter((F.col("disease") != "") & F.col("spelling").isNotNull()
                    & (hash_id(F.lower("disease")) % MANUAL_PART == 0)))
    seed = written(seed.withColumn("spelling", T.collapse_blanks("spelling")), "manual-terms")   # three tables are made from it
    extra = T.const_frame(spark, [(MANUAL_EXTRA,)], "name string")
    dnames = seed.select(F.col("disease").alias("name")).distinct().unionByName(extra)
    diseases = dnames.select(
        hash_id(F.lower("name")).alias("id"), "name", F.lit("staff").alias("created_by"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"))
    norm = T.normalize_term("spelling")
    symptoms = (seed.groupBy(norm.alias("normalized"))
                .agg(F.min_by("spelling", F.struct("encounter_id", "pos")).alias("name"))
                .select(hash_id("normalized").alias("id"), "name", "normalized"))
    links = seed.select(hash_id(F.lower("disease")).alias("disease_id"), hash_id(norm).alias("symptom_id")).distinct()
    return diseases, symptoms, links


def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files from ``pages``: dataset folder, split, class folder, file name."""
    p = table(spark, sf_dir, "pages").select("page_id")
    exts = F.array(*[F.lit(x) for x in [".jpg", ".JPEG", ".png", ".Webp", ".bmp", ".gif", ".txt"]])
    split = F.get(F.array(F.lit("train"), F.lit("test"), F.lit("val")), (F.col("page_id") % 3).cast("int"))
    folder = F.get(F.array(*[F.lit(x) for x in ["covid", "normal", "pneumonia_bac", "pneumonia_vir", "PNEUMONIA"]]),
                   (F.col("page_id") % 5).cast("int"))
    dataset = (F.when(F.col("page_id") % 5 == 4, "chest_xray")
               .when(F.col("page_id") % 5 == 3, "dataset_4_classes").otherwise("dataset_3_classes"))
    name = F.concat(F.lit("img_"), F.col("page_id").cast("string"), F.get(exts, (F.col("page_id") % 7).cast("int")))
    return p.select(
        "page_id", dataset.alias("dataset"), split.alias("split"), folder.alias("folder"), name.alias("file_name"),
        F.concat_ws("/", F.lit("datasets"), dataset, split, folder, name).alias("path"),
        (F.col("page_id") * 37 % 5000 + 100).alias("length"),
    )


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored (y_true, y_pred) pairs: prediction is the next class every 7th id.

    The sorted class names (one a diagnosis) travel as a literal look-up, so the rows
    neither move nor meet on a few frequent names.
    """
    c = written(C.clean(encounters_raw(spark, sf_dir)).select("encounter_id", "diagnosis"), "score-rows")
    names = sorted(r[0] for r in c.select("diagnosis").distinct().collect())
    following = T.literal_maps(dict(zip(names, [*names[1:], *names[:1]])), "string")
    return c.select("encounter_id", F.col("diagnosis").alias("y_true"),
                    F.when(F.col("encounter_id") % MISPREDICT_EVERY == 0, following(F.col("diagnosis")))
                    .otherwise(F.col("diagnosis")).alias("y_pred"))


def image_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image store metadata (files collection) from ``pages``: nested, nullable metadata."""
    p = table(spark, sf_dir, "pages").select("page_id")
    pid = F.col("page_id")
    leaf = F.concat(F.lit("img_"), pid.cast("string"), F.lit(".png"))
    meta = F.struct(
        F.concat(F.lit("user"), (pid % 3).cast("string")).alias("uploaded_by"),
        F.lit("2024-01-01T00:00:00+00:00").alias("uploaded_at"),
        F.when(pid % 5 != 0, leaf).alias("original_filename"),
        F.lit("image/png").alias("content_type"),
        F.when(pid % 2 == 0, "general").otherwise("dental").alias("category"),
        F.when(pid % 4 == 0, F.concat(F.lit("note "), pid.cast("string"))).alias("notes"),
    )
    return p.select(
        pid.alias("file_id"), F.concat(pid.cast("string"), F.lit("_"), leaf).alias("filename"),
        (pid * 37 % 5000 + 100).alias("length"),
        (F.to_timestamp(F.lit(PREDICTION_EPOCH)) + F.make_interval(hours=(pid * 7 % 1000).cast("int"))).alias("upload_date"),
        F.when(pid % 2 == 0, "general").otherwise("dental").alias("category"),
        meta.alias("metadata"))
