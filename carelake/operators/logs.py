"""Notifications and the X-ray prediction log.

P20-P23, P31, P35, J10, J12, A17-A19, L02, L03, L08, M19. Probabilities are
kept as an array in the class order of the scorer; the map form is derived
for output. Newest-first lists are ``orderBy(...).limit(n)``, which Spark runs
as a per-partition top-k (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T


def clamp(n: int | None, default: int, lo: int, hi: int) -> int:
    n = default if n is None else int(n)
    return max(lo, min(n, hi))


# ------------------------------------------------------------ X-ray scores
def score_xray(df: DataFrame, probs: str = "probs") -> DataFrame:
    """P21 + P20 (M19): class by argmax (lowest index on ties), label, confidence, alert."""
    p = F.col(probs)
    idx = F.array_position(p, F.array_max(p))  # 1-based, first maximum
    classes = F.array(*[F.lit(c) for c in K.XRAY_CLASSES])
    cls = F.get(classes, (idx - 1).cast("int"))
    labels = F.create_map(*[F.lit(v) for kv in K.XRAY_CLASS_LABELS.items() for v in kv])
    conf = F.array_max(p)
    pct = F.format_string("%.1f%%", conf * 100)
    alert = cls.isin("covid", "pneumonia") & (conf >= K.ALERT_THRESHOLD)
    msg = (F.when(alert & (cls == "covid"), F.replace(F.lit(K.ALERT_MESSAGE_COVID), F.lit("{pct}"), pct))
           .when(alert & (cls == "pneumonia"), F.replace(F.lit(K.ALERT_MESSAGE_PNEUMONIA), F.lit("{pct}"), pct))
           .otherwise(F.lit("")))
    return df.select(
        "*",
        cls.alias("predicted_class"),
        F.try_element_at(labels, cls).alias("predicted_label"),
        F.bround(conf, 4).alias("confidence"),
        F.bround(conf * 100, 1).alias("confidence_pct"),
        F.map_from_arrays(classes, F.transform(p, lambda x: F.bround(x, 4))).alias("probabilities"),
        alert.alias("clinical_alert"),
        msg.alias("alert_message"),
    )


def predictions_by_class(log: DataFrame, cls: str) -> DataFrame:
    """P22."""
    return log.filter(F.col("predicted_class") == cls)


def newest_predictions(log: DataFrame, limit: int | None = None, cls: str | None = None) -> DataFrame:
    """Newest first, limit 1..200 (default 50), optional class filter."""
    n = clamp(limit, 50, 1, 200)
    src = predictions_by_class(log, cls) if cls else log
    return src.orderBy(F.desc("timestamp"), F.desc("pred_id")).limit(n)


def prediction_stats(log: DataFrame) -> DataFrame:
    """Count and mean confidence (4 digits) per class, by count."""
    return (log.groupBy(F.col("predicted_class").alias("class"))
            .agg(F.count(F.lit(1)).alias("count"), F.bround(F.avg("confidence"), 4).alias("avg_confidence"))
            .orderBy(F.desc("count"), "class"))


def prediction_totals(log: DataFrame) -> DataFrame:
    """Total and alerts."""
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if("clinical_alert").alias("alerts"))


def alert_notifications(log: DataFrame) -> DataFrame:
    """One warning notification per alerting prediction (P31 shape)."""
    meta = F.to_json(F.struct(F.col("predicted_class").alias("class"), F.col("confidence"),
                              F.col("filename")))
    msg = F.when(F.col("alert_message") != "", F.col("alert_message")).otherwise(F.col("predicted_label"))
    return normalize_notifications(log.filter("clinical_alert").select(
        F.col("pred_id").alias("id"), F.lit("warning").alias("level"), F.lit("cnn").alias("source"),
        F.lit("Alerta radiológica").alias("title"), msg.alias("message"), meta.alias("meta"),
        F.lit(0).alias("is_read"), F.col("timestamp").alias("created_at")))


# ---------------------------------------------------------- notifications
def normalize_notifications(df: DataFrame) -> DataFrame:
    """Level outside the 4 values to info; defaults; lengths 240, 4000, 80, 2000."""
    lvl = F.col("level")
    strip = lambda c: T.py_strip(F.coalesce(F.col(c), F.lit("")))
    title = F.substring(strip("title"), 1, K.NOTIF_TITLE_MAX)
    source = F.substring(T.py_strip(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("system"))),
                         1, K.NOTIF_SOURCE_MAX)
    return df.select(
        "id",
        F.when(lvl.isin(*K.NOTIFICATION_LEVELS), lvl).otherwise("info").alias("level"),
        F.when(source == "", "system").otherwise(source).alias("source"),
        F.when(title == "", "Notificacion").otherwise(title).alias("title"),
        F.substring(strip("message"), 1, K.NOTIF_MESSAGE_MAX).alias("message"),
        F.substring(strip("meta"), 1, K.NOTIF_META_MAX).alias("meta"),
        F.coalesce(F.col("is_read"), F.lit(0)).cast("int").alias("is_read"),
        "created_at",
    )


def unread(n: DataFrame) -> DataFrame:
    """P23."""
    return n.filter(F.col("is_read") == 0)


def unread_count(n: DataFrame) -> DataFrame:
    """A17."""
    return unread(n).agg(F.count(F.lit(1)).alias("unread"))


def newest_notifications(n: DataFrame, limit: int | None = None, only_unread: bool = False) -> DataFrame:
    """Newest first (created_at, id), limit 1..200 (default 30)."""
    k = clamp(limit, 30, 1, 200)
    src = unread(n) if only_unread else n
    return src.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def new_since_last_poll(current: DataFrame, previous_ids: DataFrame) -> DataFrame:
    """Unread items of this poll whose id was not in the last poll."""
    return unread(current).join(previous_ids.select("id"), "id", "left_anti")


def mark_read(n: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """New table version with ids (or all) read, plus the changed-row flag.

    Returns (new_version, changed) where ``changed`` is true on rows the
    update touched, so ``count_if(changed)`` is the reference's row count.
    """
    if ids is None:
        changed = F.col("is_read") == 0
        out = n.withColumn("_changed", changed)
    else:
        marks = ids.select(F.col("id").alias("_mid")).distinct().withColumn("_hit", F.lit(True))
        out = n.join(marks, n["id"] == marks["_mid"], "left").drop("_mid") \
            .withColumn("_changed", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")
    out = out.withColumn("is_read", F.when(F.col("_changed"), F.lit(1)).otherwise(F.col("is_read")))
    return out, F.col("_changed")


def newest_metrics(logs: DataFrame) -> DataFrame:
    """The newest training-metric record (max_by on trained_at)."""
    cols = [c for c in logs.columns]
    return logs.agg(F.max_by(F.struct(*cols), F.col("trained_at")).alias("m")).select("m.*")


# ------------------------------------------------------------ job events
def event_new_diagnoses(new_dx: DataFrame, dataset: str, kind: str = "activate") -> DataFrame:
    """Warning row for new diagnoses (first 8 names, then ``(+ mas)``).

    ``new_dx`` holds one distinct ``diagnosis`` per row. The stored meta is cut at
    its character limit (P31): a name takes three characters of it at least, so the
    row gathers as many first names as the limit can show and counts all of them.
    """
    shown = K.NOTIF_META_MAX // 3 + 1
    first = new_dx.orderBy("diagnosis").limit(shown).select(F.col("diagnosis").alias("name"), F.lit(0).alias("one"))
    every = new_dx.select(F.lit(None).cast("string").alias("name"), F.lit(1).alias("one"))
    agg = first.unionByName(every).agg(F.array_sort(F.collect_list("name")).alias("names"),
                                       F.sum("one").alias("k"))
    names = F.col("names")
    head = F.array_join(F.slice(names, 1, 8), ", ")
    more = F.when(F.col("k") > 8, F.lit(" (+ mas)")).otherwise(F.lit(""))
    if kind == "activate":
        msg = F.concat(F.lit("El dataset activo contiene diagnosticos no presentes en el modelo: "), head, more,
                       F.lit(". Reentrena el modelo para que los reconozca."))
    else:
        msg = F.concat(F.lit(f"{dataset} introduce "), F.col("k").cast("string"),
                       F.lit(" diagnosticos nuevos: "), head, more)
    meta = F.to_json(F.struct(names.alias("diagnoses"), F.lit(dataset).alias("dataset")))
    return normalize_notifications(agg.filter(F.col("k") > 0).select(
        F.lit(None).cast("long").alias("id"), F.lit("warning").alias("level"), F.lit("dataset").alias("source"),
        F.lit("Nuevas enfermedades detectadas").alias("title"), msg.alias("message"), meta.alias("meta"),
        F.lit(0).alias("is_read"), F.lit(None).cast("timestamp").alias("created_at")))


def event_etl_finished(report: DataFrame, dataset: str, elapsed_ms: int = 0) -> DataFrame:
    """Info row for a finished ETL run, or warning with the failed stage.

    ``report`` is the one-row stage report of ``plans.etl`` (A35); ``elapsed_ms`` is
    what its actions took.
    """
    ok = F.col("ok")
    msg = F.when(ok, F.format_string("%s: %d → %d filas en %d ms", F.lit(dataset), F.col("rows_raw"), F.col("rows_final"),
                                     F.lit(elapsed_ms))) \
        .otherwise(F.format_string("%s: etapa fallida «%s»", F.lit(dataset), F.coalesce("failed_stage", F.lit("desconocido"))))
    done = F.to_json(F.struct(F.lit(dataset).alias("dataset"), F.struct(
        "rows_raw", "rows_final", "distinct_diagnoses", F.lit(elapsed_ms).alias("total_elapsed_ms")).alias("summary")))
    failed = F.to_json(F.struct(F.lit(dataset).alias("dataset"),
                                F.filter(F.array("failed_stage"), lambda x: x.isNotNull()).alias("failed")))
    return normalize_notifications(report.select(
        F.lit(None).cast("long").alias("id"), F.when(ok, "info").otherwise("warning").alias("level"),
        F.lit("pipeline").alias("source"),
        F.when(ok, "Pipeline ETL completado").otherwise("Pipeline terminado con errores").alias("title"),
        msg.alias("message"), F.when(ok, done).otherwise(failed).alias("meta"), F.lit(0).alias("is_read"),
        F.lit(None).cast("timestamp").alias("created_at")))


def event_anomalies(summary: DataFrame) -> DataFrame:
    """Warning row when the anomaly summary (A32) found any."""
    meta = F.to_json(F.struct(F.col("checked"), F.col("anomalies_count")))
    return normalize_notifications(summary.filter(F.col("anomalies_count") > 0).select(
        F.lit(None).cast("long").alias("id"), F.lit("warning").alias("level"), F.lit("analytics").alias("source"),
        F.lit("Anomalias detectadas").alias("title"),
        F.format_string("%d paciente(s) con perfil clinico atipico.", F.col("anomalies_count")).alias("message"),
        meta.alias("meta"), F.lit(0).alias("is_read"), F.lit(None).cast("timestamp").alias("created_at")))
