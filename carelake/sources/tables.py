"""Stored tables (patients, doctors, diseases, symptoms, notifications).

Parquet is the default store; a JDBC source with the same schema is an
option (the driver jar must be on the cluster's class path). Filters and
column selections on the returned frame reach the scan (parquet row-group
statistics, JDBC ``WHERE``), so callers just filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, location: str, fmt: str = "parquet", **options) -> DataFrame:
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=location, **options).load()
    return spark.read.format(fmt).options(**options).load(location)


def write_table(df: DataFrame, location: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(location)
