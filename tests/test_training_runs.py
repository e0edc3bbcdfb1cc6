"""Resumable training, pluggable models, sparse features, exact quantiles, file reading, stream totals, pairs."""

import math
import os
import random
import tempfile
from collections import Counter

import pytest
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from carelake.operators import analytics as A
from carelake.operators import isoforest as ISO
from carelake.operators import lookup as L
from carelake.operators import models as M
from carelake.operators import sampling as SM
from carelake.operators import tfidf as TF
from carelake.plans import cohort as CO
from carelake.plans import training as TR
from carelake.plans.runs import RunStore, input_version
from carelake.sources import files as FS
from carelake.sources.fixture import encounters_raw
from carelake.streaming import streams as ST

SMALL = TR.TrainParams(n_trees=3, disease_depth=4, risk_depth=3, iso_trees=10, iso_samples=64, at_once=3)


def new_dir():
    return tempfile.mkdtemp(prefix="training-", dir="/tmp")


@pytest.fixture(scope="module")
def root():
    return new_dir()


@pytest.fixture(scope="module")
def run(spark, sf_dir, root):
    got = TR.TrainRun(encounters_raw(spark, sf_dir, with_copy=True), SMALL, RunStore(spark, "a", root=root))
    assert got.record
    return got


def test_folds_cover_all_rows_and_figures_are_kept(run):
    cv = run.cv.collect()
    assert sorted((r["model"], r["fold"]) for r in cv) == [(m, f) for m in ("disease", "risk") for f in range(3)]
    assert all(0 <= r["accuracy"] <= 1 for r in cv)
    mean = sum(r["accuracy"] for r in cv if r["model"] == "risk") / 3
    assert math.isclose(run.record["risk_cv_accuracy_mean"], mean)


def test_fold_features_never_saw_the_fold(spark, run):
    """The vocabulary of a fold equals one fitted on the other rows alone."""
    rest = run.tagged.where("fold_disease <> 1").select("row_key", "model_text")
    alone = TF.fit_vocabularies(rest, "model_text", {"x": F.lit(True)})["x"]
    kept = run.vocabularies["disease_1"]
    assert kept.getOrDefault("terms") == [t for t, _, _ in alone]
    assert all(math.isclose(a, b) for a, b in zip(kept.getOrDefault("idf"), (w for _, _, w in alone)))


def test_a_killed_run_goes_on_after_its_last_product(spark, sf_dir, monkeypatch):
    base, raw = new_dir(), encounters_raw(spark, sf_dir, with_copy=True)
    calls = Counter()
    fit, cv = M.fit_forest, M.fold_accuracy

    def counted(*a, **k):
        calls["forest"] += 1
        return fit(*a, **k)

    def dies(table, f, classes):
        if f.name == "risk_2" and not calls["again"]:
            raise RuntimeError("killed")
        calls[f.name] += 1
        return cv(table, f, classes)

    monkeypatch.setattr(M, "fit_forest", counted)
    monkeypatch.setattr(M, "fold_accuracy", dies)
    with pytest.raises(RuntimeError):
        _ = TR.TrainRun(raw, SMALL, RunStore(spark, "a", root=base)).record
    calls["again"] = 1
    before = calls["forest"]
    second = TR.TrainRun(raw, SMALL, RunStore(spark, "a", root=base)).record
    assert calls["risk_2"] == 1 and calls["disease_0"] == 1
    assert calls["forest"] - before == 1                       # only the fold that died
    third = TR.TrainRun(raw, SMALL, RunStore(spark, "a", root=base))
    assert third.record == second and calls["forest"] - before == 1
    # Other inputs or parameters are another run; a product that is not whole is not one.
    assert not RunStore(spark, "b", root=base).has("rows")
    assert not [n for n in os.listdir(third.store.base) if n.startswith(".") and not n.endswith(".crc")] or calls["forest"]


def test_input_version_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    first = input_version(spark.read.parquet(path))
    assert first == input_version(spark.read.parquet(path))
    spark.range(11).coalesce(1).write.mode("overwrite").parquet(path)
    assert first != input_version(spark.read.parquet(path))


# ------------------------------------------------------------------ models
class Always(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A caller's own model: everybody is Low."""

    def _transform(self, dataset):
        return dataset.withColumn("predicted", F.lit("Low")).withColumn("confidence", F.lit(0.5))


def test_import_takes_any_transformer(spark, run, sf_dir):
    raw = encounters_raw(spark, sf_dir).limit(200).withColumn("row_no", F.col("encounter_id"))
    own, _ = CO.import_cohort(raw, PipelineModel([Always()]), L.default_doctors(spark), "x")
    assert {r[0] for r in own.select("risk_level").distinct().collect()} == {"Low"}
    path = new_dir() + "/model"
    run.risk.save(path)
    a, _ = CO.import_cohort(raw, run.risk, L.default_doctors(spark), "x")
    b, _ = CO.import_cohort(raw, PipelineModel.load(path), L.default_doctors(spark), "x")
    key = ["row_no", "risk_level", "risk_confidence"]
    assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect())) != []


def test_features_are_sparse_and_equal_the_weights(spark):
    docs = spark.createDataFrame([(1, "chest pain, back pain, pain", 30, 1), (2, "fever", 4, 0), (3, "", 0, 0), (4, None, 7, 2),
                                  (5, "Fiebre alta ñandú fever", 8, 1)], "row_key long, model_text string, age int, gender_enc int")
    weights = TF.TermWeights.of(TF.fit_vocabularies(docs, "model_text", {"x": F.lit(True)}, min_df=1)["x"])
    terms = weights.getOrDefault("terms")
    got = {r["row_key"]: r["features"] for r in M.featurize(docs, weights).collect()}
    vocab = TF.fit_vocabulary(docs, "row_key", "model_text", min_df=1)
    want = {}
    for r in TF.weights_long(docs, vocab, "row_key", "model_text").collect():
        want.setdefault(r["row_key"], {})[terms.index(r["term"])] = r["weight"]
    for key, age, gender in ((1, 30, 1), (2, 4, 0), (3, 0, 0), (4, 7, 2), (5, 8, 1)):
        v = got[key]
        expected = want.get(key, {}) | {len(terms): float(age), len(terms) + 1: float(gender)}
        assert v.size == len(terms) + 2
        assert {i: round(x, 12) for i, x in enumerate(v.toArray()) if x} == {i: round(x, 12) for i, x in expected.items() if x}
    assert len(got[2].indices) < 4     # stored sparse


def test_run_length_counts_equal_counts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd"]) for _ in range(rnd.randrange(12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: {e["term"]: e["tf"] for e in r["_tc"]} for r in TF.with_term_counts(df, "t").collect()}
    for i, t in enumerate(texts):
        w = t.split()
        assert got[i] == Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


@pytest.mark.parametrize("values", [[0.5], [-0.5] * 50, [random.Random(1).gauss(0, 1) for _ in range(3_000)] + [0.25] * 500])
def test_quantile_equals_a_sort(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "s double")
    ordered = sorted(values)
    for rank in {0, len(values) // 3, len(values) - 1}:
        assert SM.order_statistic(df, "s", rank, cells=7, few=20) == ordered[rank]
    at = 0.02 * (len(values) - 1)
    low = ordered[int(at)]
    assert math.isclose(SM.exact_quantile(df, "s", 0.02), low + (at - int(at)) * (ordered[min(int(at) + 1, len(values) - 1)] - low))


def test_isolation_samples_are_full_and_differ(spark):
    got = ISO._samples(spark.range(5_000).withColumnRenamed("id", "k"), "k", 5_000, 12, 64, 42).collect()
    trees = Counter(r["tree"] for r in got)
    assert trees == {t: 64 for t in range(12)} and len({(r["tree"], r["k"]) for r in got}) == 12 * 64
    assert len({frozenset(r["k"] for r in got if r["tree"] == t) for t in range(12)}) == 12


# ------------------------------------------------------------------ files
HEAD = "encounter_id,patient_id,Age,Gender,Symptoms,Diagnosis,Date_of_Admission,Discharge_Date"


def test_plain_files_are_split_and_broken_ones_read_whole(spark, tmp_path):
    rows = [f'{i},{i},30,Male,"a, b ""c""",Flu,2024-01-01,2024-01-02' for i in range(40_000)]
    (tmp_path / "plain.csv").write_text("\n".join([HEAD, *rows]) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256 * 1024)
    try:
        df = FS.read_encounters_csv(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3 and df.count() == 40_000
        (tmp_path / "broken.csv").write_text("\n".join([HEAD, '1,1,30,Male,"one\ntwo, three",Flu,,', '2,2,31,Male,x,Flu,,']))
        df = FS.read_encounters_csv(spark, str(tmp_path))
        assert df.count() == 40_002 and df.where("symptoms like 'one%three'").count() == 1
        facts = {os.path.basename(r["file"]): (r["rows"], r["ok"]) for r in FS.batch_check(spark, str(tmp_path)).collect()}
        assert {k: n for k, (n, _) in facts.items()} == {"plain.csv": 40_000, "broken.csv": 2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# ------------------------------------------------------------------ pairs
def test_a_row_of_five_thousand_symptoms(spark):
    names = [f"s{i:04d}" for i in range(5_000)]
    raw = spark.createDataFrame([(",".join(names),), ("s0007, s0003",), ("",), (None,), ("s0001",)], "symptoms string")
    top = A.symptom_pairs(raw, 3).collect()
    assert (top[0]["pair"], top[0][1]) == ("s0003 + s0007", 2) and all(r[1] == 1 for r in top[1:])


# ----------------------------------------------------------------- totals
def test_running_totals_over_batches_restart_and_compaction(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "diagnosis string, hospital_zone string, risk_level string"
    rnd, rows = random.Random(2), []
    for part in range(3):                       # three runs of the stream, several files (batches) each
        for _ in range(4):
            more = [(rnd.choice("ABC"), rnd.choice("XY"), rnd.choice(["Low", None])) for _ in range(20)]
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
            rows += more
        ST.run_count_stream(spark, src, spark.read.parquet(src).schema, out, ckpt, compact_every=3, per_trigger=1)
        want = Counter((k, r[i]) for r in rows for i, k in enumerate(("diagnosis", "zone", "risk")))
        got = {(r["kind"], r["name"]): r["count"] for r in ST.latest_counts(spark, out).collect()}
        assert got == dict(want)
    epochs = sorted(int(n[6:]) for n in os.listdir(out) if n.startswith("epoch="))
    assert epochs[-1] == 11 and epochs[0] >= 6      # folders before the totals of epoch 6 are gone
