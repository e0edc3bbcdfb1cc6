"""Structured Streaming jobs for arriving data: T01-T04.

Every job reads a folder source with a fixed schema, runs the same column
logic as the batch operators, and writes through a checkpointed sink, so a
restart (or a lost executor) resumes from the last committed batch. Tests
and registered queries run them with ``trigger(availableNow=True)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from carelake.functions import constants as K
from carelake.operators import clean as C
from carelake.operators import features as FE
from carelake.operators import logs as LG
from carelake.plans.etl import CANONICAL
from carelake.session import file_system
from carelake.sources import files as FS

ENCOUNTER_HEADER = ["encounter_id", "patient_id", "Age", "Gender", "Symptoms", "Diagnosis",
                    "Date_of_Admission", "Discharge_Date"]


def _run(q_writer, ckpt: str) -> None:
    q = q_writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def clean_stream(spark: SparkSession, in_dir: str, header: list[str] | None = None,
                 dedupe_watermark: str = "1 hour", encoding: str = "UTF-8") -> DataFrame:
    """Arriving encounter CSV files -> clean, transformed rows (streaming frame).

    Records with more fields than the header are dropped as in the batch (S01). A
    stream cannot look at a whole file first, so its encoding is a parameter.
    Exact duplicates are dropped with state bounded by a watermark on the
    file's modification time (``dropDuplicatesWithinWatermark``).
    """
    cols = header or ENCOUNTER_HEADER
    schema = TT.StructType([TT.StructField(c, TT.StringType()) for c in [*cols, FS.CORRUPT]])
    s = (spark.readStream.schema(schema).option("header", True).option("encoding", encoding)
         .option("columnNameOfCorruptRecord", FS.CORRUPT).option("multiLine", True).csv(in_dir)
         .withColumn("_arrived", F.col("_metadata.file_modification_time")).filter(FS.fits(cols)))
    canon = [F.when(F.col(c).isin(*K.CSV_NULL_TOKENS), None).otherwise(F.col(c)).alias(CANONICAL.get(c, c))
             for c in cols]
    s = s.select(*canon, "_arrived").withWatermark("_arrived", dedupe_watermark)
    names = [CANONICAL.get(c, c) for c in cols]
    s = s.dropDuplicatesWithinWatermark(names).drop("_arrived")
    s = s.withColumn("copies", F.lit(1))
    kept = C.kept(C.annotate(s, names))
    return FE.transform(kept)


def run_clean_stream(spark: SparkSession, in_dir: str, out_dir: str, ckpt: str) -> None:
    out = clean_stream(spark, in_dir).select(
        F.col("encounter_id").cast("long"), "age", "gender", "symptoms", "diagnosis",
        "gender_enc", "age_bin", "symptoms_en", "symptoms_count")
    _run(out.writeStream.format("parquet").option("path", out_dir).outputMode("append"), ckpt)


def run_alert_stream(spark: SparkSession, log_dir: str, schema: TT.StructType, out_dir: str, ckpt: str) -> None:
    """Alerts from arriving predictions, in notification shape."""
    s = spark.readStream.schema(schema).parquet(log_dir)
    out = LG.alert_notifications(s)
    _run(out.writeStream.format("parquet").option("path", out_dir).outputMode("append"), ckpt)


def running_counts(patients: DataFrame) -> DataFrame:
    """Counts by diagnosis, zone and risk level (stateful aggregation)."""
    kinds = F.explode(F.array(
        F.struct(F.lit("diagnosis").alias("kind"), F.col("diagnosis").alias("name")),
        F.struct(F.lit("zone").alias("kind"), F.col("hospital_zone").alias("name")),
        F.struct(F.lit("risk").alias("kind"), F.col("risk_level").alias("name")),
    ))
    return patients.select(kinds.alias("k")).select("k.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("count"))


def run_count_stream(spark: SparkSession, in_dir: str, schema: TT.StructType, out_dir: str, ckpt: str,
                     compact_every: int = 50, per_trigger: int | None = None) -> None:
    """T03 sink: each micro-batch writes the totals that it changed (update mode) to ``epoch=N/part=changes``.

    The newest epoch of a key holds its total, so a batch that is run again replaces only
    its own folder. Every ``compact_every`` epochs all totals are written once more
    (``part=totals``), and the epochs before the totals of the time before are deleted:
    what is kept does not grow with the number of batches, a crash at any point leaves
    every key's newest total in place, and readers of the older totals still find them.
    """
    source = spark.readStream.schema(schema)
    s = running_counts((source.option("maxFilesPerTrigger", per_trigger) if per_trigger else source).parquet(in_dir))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}/part=changes")
        if epoch and epoch % compact_every == 0:
            here = batch.sparkSession
            latest_counts(here, out_dir).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}/part=totals")
            fs, path = file_system(here, out_dir)
            for found in fs.listStatus(path):
                name = found.getPath().getName()
                if name.startswith("epoch=") and int(name[6:]) < epoch - compact_every:
                    fs.delete(found.getPath(), True)

    _run(s.writeStream.outputMode("update").foreachBatch(write), ckpt)


def latest_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """The totals: of each key the one of the newest epoch that has it."""
    return spark.read.parquet(out_dir).groupBy("kind", "name").agg(F.max_by("count", "epoch").alias("count"))


def run_unread_stream(spark: SparkSession, in_dir: str, schema: TT.StructType, out_dir: str, ckpt: str,
                      watermark: str = "1 day") -> None:
    """Unread notifications not seen before.

    Old unread notifications may arrive at any time, so lateness is measured on the
    arrival of their file and not on ``created_at``: none is dropped, and the state
    that recognises an id is kept for ``watermark`` after its file arrived.
    """
    s = (spark.readStream.schema(schema).parquet(in_dir)
         .withColumn("_arrived", F.col("_metadata.file_modification_time"))
         .withWatermark("_arrived", watermark).dropDuplicatesWithinWatermark(["id"]))
    out = LG.unread(s).select("id", "level", "title", "created_at")
    _run(out.writeStream.format("parquet").option("path", out_dir).outputMode("append"), ckpt)
