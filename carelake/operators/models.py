"""Disease and risk classifiers: M04-M11 as Spark ML pipelines.

A model is a ``PipelineModel``: TF-IDF weights (``tfidf.TermWeights``), an assembler that
adds age and gender code (sparse vectors all the way), a random forest, and
``ClassOutputs``, which turns the probability vector into class, confidence, top
classes and probability map with array functions. It reads the columns of
``MODEL_INPUT``. Scoring jobs take any Transformer with these columns that adds
``predicted`` and ``confidence`` (X02), so another model can take its place.

Labels are indexed alphabetically and classes are weighted n / (k n_c); both come from
one count by class and travel as literals.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import forest as FO
from carelake.operators import sampling as SM
from carelake.operators import tfidf as TF

MODEL_INPUT = ("model_text", "age", "gender_enc")


@dataclass(frozen=True)
class ForestParams:
    n_trees: int = 120
    max_depth: int = 10
    min_leaf: int = 5
    seed: int = K.SEED
    memory_mb: int = 256        # statistics of the nodes that one pass over the rows splits, in each task
    rows_per_task: int = 20_000  # fewer rows are not worth a task's statistics
    rows_at_most: int = 1_000_000  # that a task keeps: some 2 kB each in Spark ML, 60 bytes counted
    counted_above: int = 100_000   # rows from which on the forest grows from counts (``forest``)


def training_rows(rows: DataFrame) -> DataFrame:
    """Model rows with the dropout training text."""
    return rows.withColumn("symptoms_train", SM.symptom_dropout(F.col("symptoms_clean"), F.col("encounter_id")))


def featurize(rows: DataFrame, weights: TF.TermWeights, text_col: str = "model_text", out: str = "features") -> DataFrame:
    """TF-IDF, age, gender code as one sparse vector."""
    d = rows if text_col == "model_text" else rows.withColumn("model_text", F.col(text_col))
    d = TF.assembler(weights, out).transform(weights.transform(d)).drop(weights.getOutputCol())
    return d if text_col == "model_text" else d.drop("model_text")


@dataclass(frozen=True)
class Classes:
    """The classes in index order and their balanced weights."""

    labels: list[str]
    counts: list[int]

    @property
    def weights(self) -> list[float]:
        return [sum(self.counts) / (len(self.counts) * n) for n in self.counts]

    def index(self, label: str) -> Column:
        return (F.array_position(F.array(*[F.lit(c) for c in self.labels]), F.col(label)) - 1).cast("double")

    def weight(self, label: str) -> Column:
        return F.get(F.array(*[F.lit(w) for w in self.weights]), self.index(label).cast("int"))


def classes_of(rows: DataFrame, label: str, subsets: dict[str, Column]) -> dict[str, Classes]:
    """The classes of each subset of the rows, from one count by class."""
    marks = [f"_n{k}" for k in range(len(subsets))]
    counted = rows.groupBy(label).agg(*[F.count_if(c).alias(m) for c, m in zip(subsets.values(), marks)]).collect()   # one row a class
    out = {}
    for name, m in zip(subsets, marks):
        n = {r[label]: r[m] for r in counted if r[label] is not None and r[m]}
        out[name] = Classes(sorted(n), [n[c] for c in sorted(n)])
    return out


def forest_tasks(rows: int, p: ForestParams, cores: int) -> int:
    """Tasks that train a forest. Each sends the statistics of every node to the others, so more tasks than
    cores only add to that: their number grows with the rows up to the cores, beyond by what a task may keep."""
    return max(1, min(-(-rows // p.rows_per_task), cores), -(-rows // p.rows_at_most))


def fit_forest(train: DataFrame, label: str, classes: Classes, p: ForestParams, features: str = "features") -> RandomForestClassificationModel:
    """A forest on rows that have their features. Large tables grow it from counts, by the same rules."""
    d = train.select(F.col(features).alias("features"), classes.index(label).alias("label_idx"), classes.weight(label).alias("weight"))
    rows = int(sum(classes.counts))
    tasks = forest_tasks(rows, p, train.sparkSession.sparkContext.defaultParallelism)
    classifier = RandomForestClassifier(featuresCol="features", labelCol="label_idx", weightCol="weight", numTrees=p.n_trees,
                                        maxDepth=p.max_depth, minInstancesPerNode=p.min_leaf, featureSubsetStrategy="sqrt",
                                        maxMemoryInMB=p.memory_mb, seed=p.seed)
    if rows > p.counted_above:
        return FO.fit(d, classifier, rows, classes.weights, tasks)
    # Dealt evenly: each pass over the rows ends with its largest task, and parts of a file put together differ.
    return classifier.fit(d.repartition(tasks) if tasks > 1 else d.coalesce(1))


class ClassOutputs(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Predicted class, confidence (4 digits), percent (1 digit), top classes, probability map."""

    labels = Param(Params._dummy(), "labels", "classes in index order", TypeConverters.toListString)
    top = Param(Params._dummy(), "top", "classes listed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, labels: list[str] | None = None, top: int = 5):
        super().__init__()
        self._setDefault(labels=[], top=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d = dataset.withColumn("_p", vector_to_array("probability"))
        labels, p = F.array(*[F.lit(c) for c in self.getOrDefault("labels")]), F.col("_p")
        best = F.array_position(p, F.array_max(p))       # lowest index on ties (K17)
        ranked = F.sort_array(F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("i"))), asc=False)
        top = F.filter(F.slice(ranked, 1, self.getOrDefault("top")), lambda e: e["p"] > 0.005)
        top_txt = F.array_join(F.transform(top, lambda e: F.format_string(
            "%s:%s", F.get(labels, e["i"]), F.bround(e["p"], 4).cast("string"))), ";")
        return (d.withColumn("predicted", F.get(labels, (best - 1).cast("int")))
                .withColumn("confidence", F.bround(F.array_max(p), 4))
                .withColumn("confidence_pct", F.bround(F.array_max(p) * 100, 1))
                .withColumn("top_predictions", top_txt)
                .withColumn("probabilities", F.map_from_arrays(labels, F.transform(p, lambda x: F.bround(x, 4))))
                .drop("_p", "tfidf", "features", "rawPrediction", "probability", "prediction"))


def classifier(weights: TF.TermWeights, forest: RandomForestClassificationModel, classes: Classes) -> PipelineModel:
    return PipelineModel([weights, TF.assembler(weights), forest, ClassOutputs(labels=classes.labels)])


def labels_of(model: PipelineModel) -> list[str]:
    return model.stages[-1].getOrDefault("labels")


def predict(model: Transformer, rows: DataFrame, text_col: str) -> DataFrame:
    """The rows with the model's outputs; ``text_col`` is the text that it reads."""
    if text_col == "model_text":
        return model.transform(rows)
    return model.transform(rows.withColumn("model_text", F.col(text_col))).drop("model_text")


def top_percent(top: str) -> Column:
    """L07 percent form: ``name:12.3`` for each entry of the share form."""
    def one(e: Column) -> Column:
        name, share = F.substring_index(e, ":", 1), F.substring_index(e, ":", -1)
        return F.concat(name, F.lit(":"), F.bround(share.cast("double") * 100, 1).cast("string"))
    return F.when(F.col(top) == "", F.lit("")).otherwise(F.array_join(F.transform(F.split(F.col(top), ";"), one), ";"))


def risk_outputs(pred: DataFrame) -> DataFrame:
    """M10 extras: risk level name and recommendations."""
    return pred.withColumnRenamed("predicted", "risk_level_pred") \
        .withColumn("recommendations", T.recommendations("risk_level_pred"))


def pairs(pred: DataFrame, label: str) -> DataFrame:
    return pred.select(F.col(label).alias("y_true"), F.col("predicted").alias("y_pred"))


@dataclass(frozen=True)
class Fold:
    """One training of M08: the label, the fold held out and the column with the features fitted without it."""

    name: str
    label: str
    fold_col: str
    fold: int
    features: str
    forest: ForestParams


def fold_accuracy(table: DataFrame, f: Fold, classes: Classes) -> float:
    """Share of the held-out rows whose class a forest trained on the others finds."""
    forest = fit_forest(table.where(F.col(f.fold_col) != f.fold), f.label, classes, f.forest, f.features)
    held = table.where(F.col(f.fold_col) == f.fold).select(F.col(f.features).alias("features"), classes.index(f.label).alias("y"))
    right = F.coalesce(F.col("prediction") == F.col("y"), F.lit(False))    # a class that only the held-out rows have is missed
    return float(forest.transform(held).agg(F.avg(right.cast("double"))).first()[0] or 0.0)


def in_threads(jobs: list, workers: int) -> list:
    """Results of the calls, in their order; each submits its own Spark jobs, which share the cluster."""
    with ThreadPoolExecutor(max(1, workers)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def cv_summary(folds_df: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds, by model."""
    return folds_df.groupBy("model").agg(F.avg("accuracy").alias("cv_accuracy_mean"), F.stddev_pop("accuracy").alias("cv_accuracy_std"))


def gender_code(col: str) -> Column:
    return T.gender_code_score(col)
