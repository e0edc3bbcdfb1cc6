"""Registered queries: ETL report, file sources and sinks, streams.

File and stream queries write their inputs (derived from the given tables)
to a fresh folder under the session's checkpoint directory, run the job
there, and return the result read back from that shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from carelake import oracle as O
from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import logs as LG
from carelake.plans import etl as ETL
from carelake.plans import q_records as QR
from carelake.plans.registry import register
from carelake.session import checkpoint_dir, written
from carelake.sources import files as FS
from carelake.sources import records as R
from carelake.sources.fixture import encounters_raw
from carelake.streaming import streams as ST


def run_dir(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def _csv_copy(spark, d) -> str:
    path = run_dir(spark, "encounters-csv")
    FS.write_encounters_csv(encounters_raw(spark, d), path)
    return path


CSV_FILES = 8


def one_csv(spark, d) -> str:
    """Encounters as CSV tables by id modulo 8, each in id order, so that row numbers are known. A table is a
    folder whose part files follow each other by name: no task holds or sorts a whole one."""
    root = run_dir(spark, "encounters-numbered")
    raw = written(encounters_raw(spark, d).withColumn("part", F.col("encounter_id") % CSV_FILES), "numbered-rows")
    text = raw.select(*[F.col(c).cast("string").alias(ETL.CANONICAL_BACK.get(c, c)) for c in raw.columns], F.col("encounter_id").alias("_id"))
    # Sorted as it is written, by the folder's name first: the writer's own sort by folder would undo the order.
    out = text.repartitionByRange("part", "_id").sortWithinPartitions("part", "_id").drop("_id")
    (out.write.partitionBy("part").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root))
    return f"{root}/part=*"


def _csv_value(c: str, kind: str = "VARCHAR") -> str:
    tokens = ", ".join(O.q(t) for t in K.CSV_NULL_TOKENS)
    return f"CAST(CASE WHEN CAST({c} AS VARCHAR) IN ({tokens}) THEN NULL ELSE CAST({c} AS VARCHAR) END AS {kind}) AS {c}"


# ------------------------------------------------------------------ ETL
@register("a35_etl_report", O.with_clean(
    "SELECT true AS ingest_ok, r.rows_final > 0 AS clean_ok, r.rows_final > 0 AS transform_ok, "
    "r.rows_final > 0 AS analyze_ok, CASE WHEN r.rows_final > 0 THEN NULL ELSE 'clean' END AS failed_stage, "
    "r.rows_final > 0 AS ok, r.rows_raw, r.rows_final, t.distinct_diagnoses FROM "
    "(SELECT CAST(sum(copies) AS BIGINT) AS rows_raw, count_if(reject_reason IS NULL) AS rows_final FROM staged) r, "
    "(SELECT count(DISTINCT diagnosis) AS distinct_diagnoses FROM xf) t"))
def a35(spark, d):
    return ETL.report_row(encounters_raw(spark, d))


@register("p35_etl_finished_event", O.with_clean(
    "SELECT 'info' AS level, 'pipeline' AS source, 'Pipeline ETL completado' AS title, 'encounters: ' || r.rows_raw || ' → ' "
    "|| r.rows_final || ' filas en 0 ms' AS message FROM (SELECT CAST(sum(copies) AS BIGINT) AS rows_raw, "
    "count_if(reject_reason IS NULL) AS rows_final FROM staged) r"))
def p35_etl(spark, d):
    return LG.event_etl_finished(ETL.report_row(encounters_raw(spark, d)), "encounters").select(
        "level", "source", "title", "message")


@register("p34_import_rules", O.with_fixture(
    "SELECT encounter_id AS row_no, " + O.integer_value("coalesce(age_raw, '')") + " AS age, "
    "CASE WHEN trim(coalesce(gender, '')) = '' THEN 'Other' ELSE trim(gender) END AS gender, "
    "(" + O.integer_value("coalesce(age_raw, '')") + ") IS NOT NULL AND trim(coalesce(symptoms, '')) <> '' "
    "AND trim(coalesce(diagnosis, '')) <> '' AS inserted FROM encounters_raw"))
def p34(spark, d):
    raw = encounters_raw(spark, d)
    age = T.integer_value(F.coalesce("age_raw", F.lit("")))
    g = T.py_strip(F.coalesce("gender", F.lit("")))
    ok = age.isNotNull() & (T.py_strip(F.coalesce("symptoms", F.lit(""))) != "") \
        & (T.py_strip(F.coalesce("diagnosis", F.lit(""))) != "")
    return raw.select(F.col("encounter_id").alias("row_no"), age.alias("age"),
                      F.when(g == "", "Other").otherwise(g).alias("gender"), ok.alias("inserted"))


# ---------------------------------------------------------------- files
@register("s01_csv_ingest", O.with_fixture("SELECT " + ", ".join(
    _csv_value(c) for c in ("encounter_id", "patient_id", "age_raw", "gender", "symptoms", "diagnosis"))
    + ", " + ", ".join(_csv_value(c, "DATE") for c in ("date_of_admission", "discharge_date")) + " FROM encounters_raw"))
def s01(spark, d):
    return FS.read_encounters_csv(spark, _csv_copy(spark, d))


@register("s02_required_columns", O.with_fixture(
    "SELECT '' AS missing_required, true AS required_ok, 8 AS column_count, count(*) = 0 AS empty_file, "
    "count(*) > 0 AS ok FROM encounters_raw"))
def s02(spark, d):
    rep = ETL.ingest_check(FS.read_encounters_csv(spark, _csv_copy(spark, d)))
    return spark.createDataFrame([(", ".join(rep["missing_required"]), rep["required_ok"], rep["column_count"],
                                   rep["empty_file"], rep["ok"])],
                                 "missing_required string, required_ok boolean, column_count int, "
                                 "empty_file boolean, ok boolean")


@register("s03_preview", O.with_fixture(
    "SELECT least(15, count(*)) AS rows, 8 AS columns, true AS all_from_file FROM encounters_raw"))
def s03(spark, d):
    """The preview's size, and that each of its rows is one of the file's."""
    df = FS.read_encounters_csv(spark, _csv_copy(spark, d), null_tokens=False, canonical=False)
    shown = ETL.preview(df)
    known = encounters_raw(spark, d).select(F.col("encounter_id").cast("string")).distinct()
    hit = shown.join(known, "encounter_id", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), (F.col("rows") == shown.count()).alias("all_from_file"))


@register("s05_dataset_catalogue")
def s05(spark, d):
    root = run_dir(spark, "datasets")
    raw = encounters_raw(spark, d)
    FS.write_encounters_csv(raw.filter(F.col("encounter_id") % 3 != 0), f"{root}/main")
    FS.write_encounters_csv(raw.filter(F.col("encounter_id") % 3 == 0), f"{root}/uploads")
    return FS.catalogue(spark, root, "/main/").select("type", "size_kb", "newest")


@register("s06_batch_check", O.with_fixture(
    "SELECT '' AS missing, true AS ok, CAST(count(*) AS BIGINT) AS rows FROM encounters_raw"))
def s06(spark, d):
    """The files' checks, summed over the files."""
    found = FS.batch_check(spark, _csv_copy(spark, d))
    return found.groupBy(F.array_join("missing", ",").alias("missing"), "ok").agg(F.sum("rows").alias("rows"))


def _manifest_ctes() -> str:
    from carelake.plans.q_models import MANIFEST_CTES
    return MANIFEST_CTES


@register("s08_image_scan", O.with_fixture(
    "SELECT target_split, class, count(*) AS n FROM man GROUP BY ALL", _manifest_ctes()))
def s08(spark, d):
    """Writes one small file per manifest row (folders from ``pages``) and scans them."""
    from carelake.operators import images as IM
    root = run_dir(spark, "images")
    man = R.image_manifest(spark, d)
    rows = man.select(F.concat_ws("/", "dataset", "split", "folder", "file_name").alias("rel"),
                      F.col("page_id").cast("string").alias("value"))
    # Tasks bring their own files to their place: as many files as rows are too many for the driver to move.
    # Rows of one place meet in one task and make one file.
    (rows.repartition(spark.sparkContext.defaultParallelism, "rel").write.partitionBy("rel").mode("overwrite")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root))
    files = IM.scan_files(spark, root)
    # partitionBy puts the file under "rel=<path>/part-..."; the manifest path is the folder name.
    rel = F.regexp_extract("path", r"rel=([^/]*)/[^/]*$", 1)
    parts = files.select(F.url_decode(rel).alias("path"), "length")
    return IM.manifest(IM.with_path_parts(parts)).groupBy("target_split", "class").agg(F.count(F.lit(1)).alias("n"))


@register("s10_append_patients", O.with_clean(
    "SELECT source_dataset, count(*) + count_if(id % 2 = 0) AS rows FROM patients GROUP BY 1", QR.PATIENT_CTES))
def s10(spark, d):
    path = run_dir(spark, "patients")
    scored = written(R.patients(spark, d), "scored-patients")   # made once, appended twice
    FS.append_patients(scored, path)
    FS.append_patients(scored.filter(F.col("id") % 2 == 0), path)
    return spark.read.parquet(path).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"))


_STATS_SQL = ("SELECT predicted_class AS class, count(*) AS count, round_even(avg(confidence), 4) AS avg_confidence "
              "FROM preds GROUP BY 1")


@register("s11_prediction_log_append", O.with_fixture(_STATS_SQL, QR.PRED_CTES))
def s11(spark, d):
    path = run_dir(spark, "predictions")
    FS.append_predictions(R.xray_predictions(spark, d), path)
    log = spark.read.parquet(path)
    return LG.prediction_stats(log)


def _metric_log(spark, d, kinds: tuple[str, ...]):
    """Appends a training record per kind, and reads the log back."""
    path = run_dir(spark, "train-log")
    stats = LG.prediction_stats(R.xray_predictions(spark, d))
    for month, kind in enumerate(kinds, 1):
        rec = stats.withColumn("kind", F.lit(kind)).withColumn(
            "trained_at", F.to_timestamp(F.lit(f"2024-{month:02d}-01 00:00:00")))
        FS.append_training_metrics(rec, path)
    return spark.read.schema("class string, count long, avg_confidence double, kind string, trained_at timestamp").json(path)


@register("s12_training_log", O.with_fixture(
    f"SELECT k.kind, s.* FROM ({_STATS_SQL}) s, (VALUES ('first'), ('second')) k(kind)", QR.PRED_CTES))
def s12(spark, d):
    return _metric_log(spark, d, ("first", "second")).select("kind", "class", "count", "avg_confidence")


@register("l08_newest_metrics", O.with_fixture(
    "SELECT 'second' AS kind, TIMESTAMP '2024-02-01 00:00:00' AS trained_at, CAST(count(*) AS BIGINT) AS predictions "
    "FROM preds", QR.PRED_CTES))
def l08(spark, d):
    """The newest of two logged records of a run."""
    log = _metric_log(spark, d, ("first", "second")).groupBy("kind", "trained_at").agg(F.sum("count").alias("predictions"))
    return LG.newest_metrics(log)


# -------------------------------------------------------------- streams
@register("t01_clean_stream", O.with_clean(
    "SELECT encounter_id, age, gender, symptoms, diagnosis, gender_enc, age_bin, symptoms_en FROM xf"))
def t01(spark, d):
    src, out = _csv_copy(spark, d), run_dir(spark, "t01-out")
    ST.run_clean_stream(spark, src, out, run_dir(spark, "t01-ckpt"))
    return spark.read.parquet(out).drop("symptoms_count")   # P15 has its own query


@register("t02_alert_stream", O.with_fixture(
    "SELECT pred_id AS id, 'warning' AS level, 'cnn' AS source, 'Alerta radiológica' AS title, 0 AS is_read FROM preds "
    "WHERE clinical_alert", QR.PRED_CTES))
def t02(spark, d):
    log = run_dir(spark, "t02-log")
    preds = R.xray_predictions(spark, d)
    preds.write.parquet(log)
    out = run_dir(spark, "t02-out")
    ST.run_alert_stream(spark, log, spark.read.parquet(log).schema, out, run_dir(spark, "t02-ckpt"))
    return spark.read.parquet(out).select("id", "level", "source", "title", "is_read")


@register("t03_running_counts", O.with_clean(
    "SELECT kind, name, count(*) AS count FROM (SELECT unnest(['diagnosis', 'zone', 'risk']) AS kind, "
    "unnest([diagnosis, hospital_zone, risk_level]) AS name FROM patients) GROUP BY ALL", QR.PATIENT_CTES))
def t03(spark, d):
    src = run_dir(spark, "t03-in")
    R.patients(spark, d).write.parquet(src)
    out = run_dir(spark, "t03-out")
    ST.run_count_stream(spark, src, spark.read.parquet(src).schema, out, run_dir(spark, "t03-ckpt"))
    return ST.latest_counts(spark, out)


@register("t04_unread_stream", O.with_fixture(
    "SELECT id, level, title, created_at FROM notifications WHERE is_read = 0", QR.NOTIF_CTE))
def t04(spark, d):
    src = run_dir(spark, "t04-in")
    LG.normalize_notifications(R.notifications(spark, d)).write.parquet(src)
    out = run_dir(spark, "t04-out")
    ST.run_unread_stream(spark, src, spark.read.parquet(src).schema, out, run_dir(spark, "t04-ckpt"))
    return spark.read.parquet(out)
