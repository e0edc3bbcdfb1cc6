"""Products of a resumable run: tables, models and records under a key of what they were made from.

A product is made once and read back by every later stage, session or machine that sees
the same folder. It is written beside its place and moved there when it is whole, so a run
that was killed leaves no half product, and the next one goes on after the last whole one.
"""

from __future__ import annotations

import getpass
import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from carelake.session import checkpoint_dir, file_system

SOURCES = ("operators", "functions", "sources", "plans/training.py", "plans/runs.py")


def runs_dir(spark: SparkSession) -> str:
    """``spark.carelake.runs.dir``, else a folder in the shared checkpoint folder; a local master that names neither has one for its user."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.carelake.runs.dir", None)
    if named:
        return named
    if sc.getConf().get("spark.checkpoint.dir", None) or not re.match(r"local(\[|$)", sc.master):
        return f"{checkpoint_dir(spark)}/runs"
    return os.path.join(tempfile.gettempdir(), f"carelake-runs-{getpass.getuser()}")


def code_version() -> str:
    """Hash of the code that makes the products."""
    root, h = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for place in SOURCES:
        path = root / place
        for f in [path] if path.is_file() else sorted(path.glob("*.py")):
            h.update(f.read_bytes())
    return h.hexdigest()


def input_version(df: DataFrame) -> str:
    """Hash of names, sizes and times of the files that ``df`` reads."""
    spark, h = df.sparkSession, hashlib.sha256()
    for name in sorted(df.inputFiles()):
        fs, path = file_system(spark, name)
        status = fs.getFileStatus(path)
        h.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return h.hexdigest()


class RunStore:
    """Products of one run; ``parts`` (inputs, parameters) make its key."""

    def __init__(self, spark: SparkSession, *parts: str, root: str | None = None) -> None:
        self.spark = spark
        key = hashlib.sha256("\n".join([code_version(), *parts]).encode()).hexdigest()[:24]
        self.base = f"{root or runs_dir(spark)}/{key}"

    def has(self, name: str) -> bool:
        fs, p = file_system(self.spark, f"{self.base}/{name}")
        return fs.exists(p)

    def _make(self, name: str, write: Callable[[str], None]) -> str:
        path = f"{self.base}/{name}"
        if not self.has(name):
            fs, new = file_system(self.spark, f"{self.base}/.{name}-{uuid.uuid4().hex}")
            write(new.toString())
            # A run beside this one may have been first: its product is as good.
            if self.has(name) or not fs.rename(new, file_system(self.spark, path)[1]):
                fs.delete(new, True)
        return path

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self._make(name, lambda path: build().write.parquet(path)))

    def model(self, name: str, build: Callable[[], PipelineModel]) -> PipelineModel:
        return PipelineModel.load(self._make(name, lambda path: build().save(path)))

    def record(self, name: str, build: Callable[[], dict | list]) -> dict | list:
        """A small value, kept as JSON text."""
        def write(path: str) -> None:
            self.spark.createDataFrame([(json.dumps(build(), ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
        return json.loads(self.spark.read.text(self._make(name, write), wholetext=True).first()[0])
