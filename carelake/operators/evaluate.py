"""Evaluation from stored (y_true, y_pred) pairs: A25-A30.

Each pair row is expanded into a "true" and a "pred" row, so one grouped
aggregation over the class key yields support, predicted count and true
positives per class; the per-class table is tiny (one row per class) and
the report figures come from it. Division by zero gives 0, as the library
default of the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import text as T

DIGITS = 6


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_counts(pairs: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per class: support, predicted, tp (classes seen in either column)."""
    hit = F.col(y_true) == F.col(y_pred)
    rows = pairs.select(F.explode(F.array(
        F.struct(F.col(y_true).alias("cls"), F.lit(True).alias("is_true"), hit.alias("hit")),
        F.struct(F.col(y_pred).alias("cls"), F.lit(False).alias("is_true"), hit.alias("hit")),
    )).alias("r")).select("r.*")
    return rows.groupBy("cls").agg(
        F.count_if("is_true").alias("support"),
        F.count_if(~F.col("is_true")).alias("predicted"),
        F.count_if(F.col("is_true") & F.col("hit")).alias("tp"),
    )


def per_class(pairs: DataFrame, **kw) -> DataFrame:
    c = class_counts(pairs, **kw)
    p = _safe_div(F.col("tp"), F.col("predicted"))
    r = _safe_div(F.col("tp"), F.col("support"))
    return c.select("cls", p.alias("precision"), r.alias("recall"), "support") \
        .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(pairs: DataFrame, **kw) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg rows."""
    pc = per_class(pairs, **kw)
    tot = pc.agg(
        F.sum("support").alias("n"), F.sum(F.col("recall") * F.col("support")).alias("correct"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    n = F.col("n")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("cls"), _safe_div(F.col("correct"), n).alias("precision"),
                 _safe_div(F.col("correct"), n).alias("recall"), _safe_div(F.col("correct"), n).alias("f1"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), _safe_div(F.col("wp"), n).alias("precision"),
                 _safe_div(F.col("wr"), n).alias("recall"), _safe_div(F.col("wf"), n).alias("f1"),
                 n.alias("support")),
    )).alias("s")).select("s.*")
    rows = pc.select("cls", "precision", "recall", "f1", "support").unionByName(summary)
    return rows.select(F.col("cls").alias("class"),
                       *[F.bround(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")], "support")


def accuracy_f1(pairs: DataFrame, **kw) -> DataFrame:
    """Accuracy and weighted F1."""
    rep = classification_report(pairs, **kw)
    return rep.filter(F.col("class").isin("accuracy", "weighted avg")).agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("precision"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("f1_weighted"))


def confusion_matrix(pairs: DataFrame, classes: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A row for each class, one column per predicted class in fixed order, zeros filled."""
    found = (pairs.groupBy(F.col(y_true).alias("true_class"))
             .agg(*[F.count_if(F.col(y_pred) == c).alias(c) for c in classes]))
    rows = T.const_frame(pairs.sparkSession, [(c,) for c in classes], "true_class string")
    return rows.join(found, "true_class", "left").select(
        "true_class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in classes])


def clinical_misses(pairs: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Covid as normal, covid as pneumonia, pneumonia as normal, normal as covid."""
    t, p = F.col(y_true), F.col(y_pred)
    return pairs.agg(
        F.count_if((t == "covid") & (p == "normal")).alias("covid_missed_as_normal"),
        F.count_if((t == "covid") & (p == "pneumonia")).alias("covid_missed_as_pneumonia"),
        F.count_if((t == "pneumonia") & (p == "normal")).alias("pneumonia_missed_as_normal"),
        F.count_if((t == "normal") & (p == "covid")).alias("normal_missed_as_covid"),
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (k * n_class) per class; the class table has one row per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    whole = Window.partitionBy()
    return c.select(label, "n_class",
                    (F.sum("n_class").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n_class"))).alias("weight"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """A30."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
