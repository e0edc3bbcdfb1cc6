"""The training run as one driver program over Spark jobs.

prepare (M01, P06, P08, P16, P17) -> label noise (M02) and splits (W03) -> vocabularies of
both models (M03) -> a written feature table for each -> disease and risk forest (M05-M07)
-> isolation forest (M12) and its offset -> metrics record (A26, A27, A30, S13) -> model
bundle (S14). Beside it, after the splits: folds (W04) -> vocabularies of every fold in one
pass -> one feature table -> the folds' forests (M08).

Every stage's product goes to a ``RunStore``: a run that was killed goes on after its last
whole product, and sessions that share the folder share the products. A product is made
when something asks for it: cross-validation needs neither the final forests nor the
isolation forest, and nothing else needs folds. Forests train several at a time while
their rows fit in memory side by side.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.operators import evaluate as EV
from carelake.operators import features as FE
from carelake.operators import isoforest as ISO
from carelake.operators import models as M
from carelake.operators import sampling as SM
from carelake.operators import tfidf as TF
from carelake.plans.runs import RunStore, input_version
from carelake.session import spread


@dataclass(frozen=True)
class TrainParams:
    n_trees: int = 120
    disease_depth: int = 10
    disease_min_leaf: int = 5
    risk_depth: int = 8
    risk_min_leaf: int = 10
    folds: int = 3
    iso_trees: int = 120
    iso_samples: int = 256
    contamination: float = 0.02
    fit_text_on_all_rows: bool = False   # the reference fits TF-IDF before split and folds (a leak)
    at_once: int = 6                     # forests that train at the same time
    rows_at_once: int = 2_000_000        # rows that they may keep then, all together

    def forest(self, name: str) -> M.ForestParams:
        return M.ForestParams(self.n_trees, self.disease_depth if name == "disease" else self.risk_depth,
                              self.disease_min_leaf if name == "disease" else self.risk_min_leaf)


LABELS = {"disease": "diagnosis", "risk": "label_noisy"}


class TrainRun:
    """The stages of one run, each made when it is first asked for and kept in the store."""

    def __init__(self, raw: DataFrame, params: TrainParams | None = None, store: RunStore | None = None) -> None:
        self.raw, self.params = raw, params or TrainParams()
        self.store = store or RunStore(raw.sparkSession, input_version(raw), json.dumps(asdict(self.params), sort_keys=True))

    # ------------------------------------------------------------- rows
    @cached_property
    def rows(self) -> DataFrame:
        """Model rows with the dropout text."""
        return self.store.table("rows", lambda: M.training_rows(FE.model_rows(self.raw)).withColumnRenamed("symptoms_train", "model_text"))

    def _tags(self, name: str) -> DataFrame:
        """The columns that a model's tags depend on, with its label and test flag."""
        def build() -> DataFrame:
            d, label = self.rows.select("row_key", "encounter_id", "diagnosis", "risk_level"), LABELS[name]
            if name == "risk":
                d = SM.label_noise(d, "risk_level", "encounter_id", K.RISK_CLASSES, tie_col="row_key")
            d = SM.split_exact(d.select("row_key", "encounter_id", label), label, "encounter_id", tie_col="row_key")
            return d.withColumnRenamed("is_test", f"test_{name}")
        return self.store.table(f"tags_{name}", build)

    def _folded(self, name: str) -> DataFrame:
        return SM.folds(self._tags(name), LABELS[name], "encounter_id", self.params.folds, tie_col="row_key", out=f"fold_{name}")

    def _joined(self, tags: Callable[[str], DataFrame]) -> DataFrame:
        """The rows with both models' tags, which are made at the same time."""
        assert self.rows
        disease, risk = M.in_threads([lambda: tags("disease").drop("encounter_id", "diagnosis"), lambda: tags("risk").drop("encounter_id")], 2)
        return self.rows.join(disease, "row_key").join(risk, "row_key")

    @cached_property
    def split(self) -> DataFrame:
        """Rows with noisy label and test flag of each model."""
        return self.store.table("split", lambda: self._joined(self._tags))

    @cached_property
    def tagged(self) -> DataFrame:
        """Rows with noisy label, test flag of each model and fold of each model."""
        return self.store.table("tagged", lambda: self._joined(self._folded))

    def _fold_subsets(self) -> dict:
        return {f"{name}_{f}": F.col(f"fold_{name}") != f for name in LABELS for f in range(self.params.folds)}

    def _fitted(self, product: str, rows: DataFrame, subsets: dict) -> dict[str, TF.TermWeights]:
        """The vocabulary of each forest's training rows."""
        def build() -> dict:
            return TF.fit_vocabularies(rows, "model_text", {k: F.lit(True) if self.params.fit_text_on_all_rows else c for k, c in subsets.items()})
        return {k: TF.TermWeights.of(v) for k, v in self.store.record(product, build).items()}

    @cached_property
    def final_vocabularies(self) -> dict[str, TF.TermWeights]:
        return self._fitted("vocabularies", self.split, {name: ~F.col(f"test_{name}") for name in LABELS})

    @property
    def anomaly_weights(self) -> TF.TermWeights:
        """The first stage of the disease model, which makes the features of the isolation forest."""
        return self.final_vocabularies["disease"]

    @cached_property
    def fold_vocabularies(self) -> dict[str, TF.TermWeights]:
        return self._fitted("fold_vocabularies", self.tagged, self._fold_subsets())

    @property
    def vocabularies(self) -> dict[str, TF.TermWeights]:
        return self.final_vocabularies | self.fold_vocabularies

    def _counted(self, product: str, rows: DataFrame, subsets: dict) -> dict[str, M.Classes]:
        """The classes of each forest's training rows."""
        def build() -> dict:
            got = {}
            for name, label in LABELS.items():
                got |= M.classes_of(rows, label, {k: c for k, c in subsets.items() if k.split("_")[0] == name})
            return {k: [c.labels, c.counts] for k, c in got.items()}
        return {k: M.Classes(*v) for k, v in self.store.record(product, build).items()}

    @cached_property
    def classes(self) -> dict[str, M.Classes]:
        return self._counted("classes", self.split, {name: ~F.col(f"test_{name}") for name in LABELS})

    @cached_property
    def fold_classes(self) -> dict[str, M.Classes]:
        return self._counted("fold_classes", self.tagged, self._fold_subsets())

    @staticmethod
    def _featurized(rows: DataFrame, vocabularies: dict[str, TF.TermWeights]) -> DataFrame:
        """The rows with the (sparse) features of each forest."""
        d = TF.with_term_counts(spread(rows), "model_text", TF.COUNTS)
        for k, weights in vocabularies.items():
            d = M.featurize(d, weights, out=f"features_{k}")
        return d.drop(TF.COUNTS, "symptoms_clean", "model_text")

    def features(self, name: str) -> DataFrame:
        """The rows with the features of a final forest: written once, for the forest and the isolation forest's scores."""
        return self.store.table(f"features_{name}", lambda: self._featurized(self.split, {name: self.final_vocabularies[name]}))

    @cached_property
    def fold_features(self) -> DataFrame:
        """The tagged rows with the features of every fold's forest: written once, each forest reads its column."""
        return self.store.table("fold_features", lambda: self._featurized(self.tagged, self.fold_vocabularies))

    def _shared(self) -> tuple:
        """What threads have in common is made before they start."""
        return self.classes, self.final_vocabularies, self.n_rows, self.features("disease")

    def _workers(self) -> int:
        """Forests that train at the same time: what they keep must fit in memory side by side."""
        return max(1, min(self.params.at_once, self.params.rows_at_once // max(self.n_rows, 1)))

    # ----------------------------------------------------------- forests
    def _model(self, name: str) -> PipelineModel:
        def build() -> PipelineModel:
            train = self.features(name).where(~F.col(f"test_{name}"))
            forest = M.fit_forest(train, LABELS[name], self.classes[name], self.params.forest(name), f"features_{name}")
            return M.classifier(self.final_vocabularies[name], forest, self.classes[name])
        return self.store.model(f"model_{name}", build)

    @cached_property
    def disease(self) -> PipelineModel:
        return self._model("disease")

    @cached_property
    def risk(self) -> PipelineModel:
        return self._model("risk")

    def _test_rows(self, name: str) -> DataFrame:
        return spread(self.split.where(f"test_{name}")).withColumnRenamed("model_text", "symptoms_train")

    @cached_property
    def disease_test(self) -> DataFrame:
        return self.store.table("disease_test", lambda: M.predict(self.disease, self._test_rows("disease"), "symptoms_train"))

    @cached_property
    def risk_test(self) -> DataFrame:
        return self.store.table("risk_test", lambda: M.risk_outputs(M.predict(self.risk, self._test_rows("risk"), "symptoms_train")))

    @cached_property
    def disease_report(self) -> DataFrame:
        return EV.classification_report(M.pairs(self.disease_test, "diagnosis"))

    @cached_property
    def risk_report(self) -> DataFrame:
        return EV.classification_report(self.risk_test.select(F.col("label_noisy").alias("y_true"), F.col("risk_level_pred").alias("y_pred")))

    # ------------------------------------------------------------- folds
    def _folds(self) -> list[M.Fold]:
        return [M.Fold(f"{name}_{f}", label, f"fold_{name}", f, f"features_{name}_{f}", self.params.forest(name))
                for name, label in LABELS.items() for f in range(self.params.folds)]

    @cached_property
    def cv(self) -> DataFrame:
        """(model, fold, accuracy). Folds train at the same time, and each one's figure is kept by itself."""
        spark, folds = self.raw.sparkSession, self._folds()
        table, classes = self.fold_features, self.fold_classes
        got = M.in_threads([lambda f=f: self.store.record(f"cv_{f.name}", lambda: {"accuracy": M.fold_accuracy(table, f, classes[f.name])})
                            for f in folds], self._workers())
        return spark.createDataFrame([(f.name.split("_")[0], f.fold, r["accuracy"]) for f, r in zip(folds, got)],
                                     "model string, fold int, accuracy double")

    # -------------------------------------------------- isolation forest
    @staticmethod
    def _arrays(features: DataFrame) -> DataFrame:
        return features.withColumn("feature_array", M.vector_to_array("features_disease"))

    def feature_arrays(self) -> DataFrame:
        return self._arrays(self.features("disease")).select("row_key", "feature_array")

    @cached_property
    def iso_nodes(self) -> DataFrame:
        p = self.params
        return self.store.table("iso_nodes", lambda: ISO.fit(
            self.split, "feature_array", "row_key", p.iso_trees, p.iso_samples,
            featurize=lambda d: self._arrays(self._featurized(d, {"disease": self.final_vocabularies["disease"]}))))

    @cached_property
    def forest(self) -> ISO.Forest:
        p = self.params
        forest = ISO.load_forest(self.iso_nodes, min(p.iso_samples, self.n_rows))
        def build() -> dict:
            scores = self.feature_arrays().select(ISO.score_column(forest, "feature_array").alias("s"))
            return {"offset": ISO.fit_offset(scores, "s", p.contamination)}
        forest.offset = self.store.record("iso_offset", build)["offset"]
        return forest

    # ------------------------------------------------------------ record
    @cached_property
    def n_rows(self) -> int:
        return self.split.count()

    @cached_property
    def figures(self) -> dict:
        """A26, A27, A30 and figures of both classifiers; the isolation forest has no part in them."""
        def build() -> dict:
            self._shared()
            M.in_threads([lambda: self.disease_test, lambda: self.risk_test], self._workers())
            acc_d, f1_d = _acc_f1(self.disease_report)
            acc_r, f1_r = _acc_f1(self.risk_report)
            return {
                "disease_accuracy": acc_d, "disease_f1_weighted": f1_d,
                "risk_accuracy": acc_r, "risk_f1_weighted": f1_r,
                "n_samples": self.n_rows,
                "disease_classes": self.classes["disease"].labels, "risk_classes": self.classes["risk"].labels,
                "disease_distribution": {r[0]: r[1] for r in EV.label_counts(self.split, "diagnosis").collect()},
                "risk_distribution": {r[0]: r[1] for r in EV.label_counts(self.split, "risk_level").collect()},
                "trained_at": dt.datetime.now(dt.timezone.utc).replace(microsecond=0).isoformat(),
                "features_used": ["symptoms_tfidf", "age", "gender_enc"],
                "symptom_dropout_keep_prob": K.SYMPTOM_KEEP_PROB,
                "risk_label_noise_pct": K.LABEL_NOISE_PCT,
            }
        return self.store.record("figures", build)

    @cached_property
    def metrics(self) -> dict:
        """The figures and the isolation forest's offset as one record (S13 shape), without cross-validation."""
        def build() -> dict:
            # Both forests and the isolation forest at the same time; then what is made of them.
            self._shared()
            M.in_threads([lambda: self.disease_test, lambda: self.risk_test, lambda: self.forest], self._workers())
            return self.figures | {"anomaly_offset": self.forest.offset}
        return self.store.record("metrics", build)

    @cached_property
    def record(self) -> dict:
        """The whole record: the metrics and the cross-validation figures, made at the same time."""
        self._shared()
        metrics, cv = M.in_threads([lambda: self.metrics, lambda: self.cv], min(2, self._workers()))
        out = dict(metrics)
        for r in M.cv_summary(cv).collect():
            out[f"{r['model']}_cv_accuracy_mean"], out[f"{r['model']}_cv_accuracy_std"] = r["cv_accuracy_mean"], r["cv_accuracy_std"]
        return out


def train(raw: DataFrame, params: TrainParams | None = None, store: RunStore | None = None) -> TrainRun:
    run = TrainRun(raw, params, store)
    assert run.metrics
    return run


def _acc_f1(rep: DataFrame) -> tuple[float, float]:
    r = {row["class"]: row for row in rep.filter(F.col("class").isin("accuracy", "weighted avg")).collect()}
    return float(r["accuracy"]["precision"]), float(r["weighted avg"]["f1"])


def metrics_frame(spark, rec: dict) -> DataFrame:
    """The record as a one-row frame (lists and maps as JSON text)."""
    flat = {k: (json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v) for k, v in rec.items()}
    return spark.createDataFrame([flat])


def save_bundle(run: TrainRun, path: str) -> None:
    """Both pipelines as Spark ML models, the isolation forest's nodes as parquet, the record as JSON."""
    for name, m in (("disease", run.disease), ("risk", run.risk)):
        m.write().overwrite().save(f"{path}/{name}")
    run.iso_nodes.write.mode("overwrite").parquet(f"{path}/iso_nodes")
    metrics_frame(run.raw.sparkSession, run.metrics).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")


def load_bundle(spark, path: str, iso_samples: int | None = None):
    """S14 load: returns (disease, risk, forest, metrics dict)."""
    disease, risk = (PipelineModel.load(f"{path}/{name}") for name in ("disease", "risk"))
    metrics = spark.read.json(f"{path}/metrics").first().asDict()
    samples = iso_samples or min(TrainParams.iso_samples, int(metrics["n_samples"]))
    forest = ISO.load_forest(spark.read.parquet(f"{path}/iso_nodes"), samples, float(metrics["anomaly_offset"]))
    return disease, risk, forest, metrics
