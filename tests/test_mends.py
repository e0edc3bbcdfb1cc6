"""Hand-made inputs for file reading, streams, the catalogue and the exact cuts."""

import types

import pytest
from pyspark.sql import functions as F

from carelake import session
from carelake.functions import text as T
from carelake.operators import catalog as CT
from carelake.operators import clean as C
from carelake.operators import evaluate as EV
from carelake.operators import lookup as L
from carelake.operators import sampling as SM
from carelake.plans import cohort as CO
from carelake.plans import etl as ETL
from carelake.sources import files as FS
from carelake.streaming import streams as ST

NBSP = " "


def put(tmp_path, name, text, encoding="utf-8"):
    (tmp_path / name).write_bytes(text.encode(encoding))


# ---------------------------------------------------------------- files
def test_files_are_read_by_their_own_header(spark, tmp_path):
    put(tmp_path, "a.csv", "Age,Gender,Symptoms,Diagnosis\n40,Male,cough,Asthma\n")
    put(tmp_path, "b.csv", 'Diagnosis,Age,"Gender",Symptoms\nStroke,70,Female,"fever, cough"\n')
    got = {r["diagnosis"]: (r["age_raw"], r["gender"], r["symptoms"]) for r in FS.read_encounters_csv(spark, str(tmp_path)).collect()}
    assert got == {"Asthma": ("40", "Male", "cough"), "Stroke": ("70", "Female", "fever, cough")}


def test_each_file_has_its_encoding(spark, tmp_path):
    head = "Age,Gender,Symptoms,Diagnosis\n"
    put(tmp_path, "a.csv", head + "40,Male,vómito,Asma\n")
    put(tmp_path, "b.csv", head + "41,Male,náusea,Asma\n", "latin-1")
    put(tmp_path, "c.csv", head + "42,Male,� ó,Asma\n")
    got = {r["age_raw"]: r["symptoms"] for r in FS.read_encounters_csv(spark, str(tmp_path)).collect()}
    assert got == {"40": "vómito", "41": "náusea", "42": "� ó"}


def test_missing_required_columns_are_seen(spark, tmp_path):
    put(tmp_path, "a.csv", "Age,Gender,Symptoms\n40,Male,cough\n")
    df = FS.read_encounters_csv(spark, str(tmp_path))
    rep = ETL.ingest_check(df)
    assert rep["missing_required"] == ["Diagnosis"] and not rep["ok"] and "date_of_admission" in df.columns


@pytest.mark.parametrize("multi_line", [True, False])
def test_row_numbers_count_dropped_records(spark, tmp_path, multi_line):
    put(tmp_path, "a.csv", "Age,Gender,Symptoms,Diagnosis\n1,M,a,x\n2,M,b,y,extra,cells\n3,M,c\n4,M,d,z\n")
    got = FS.read_encounters_csv(spark, str(tmp_path), multi_line=multi_line, row_col="row_no").collect()
    assert sorted((r["row_no"], r["age_raw"], r["diagnosis"]) for r in got) == [(1, "1", "x"), (3, "3", None), (4, "4", "z")]


def test_batch_check_respects_quotes(spark, tmp_path):
    put(tmp_path, "a.csv", '"Age","Gender"," Symptoms ","Diagnosis","a,b"\n1,M,a,x,1\n2,M,b,y,2\n')
    put(tmp_path, "b.csv", "Age,Gender\n1,M\n")
    got = sorted((r["rows"], r["missing"], r["ok"]) for r in FS.batch_check(spark, str(tmp_path)).collect())
    assert got == [(1, ["Diagnosis", "Symptoms"], False), (2, [], True)]


# -------------------------------------------------------------- streams
def test_stream_drops_what_the_batch_drops(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = ",".join(ST.ENCOUNTER_HEADER)
    put(src, "a.csv", f"{head}\n1,1,40,Male,cough,Asthma,2024-01-01,2024-01-02\n"
                      "2,1,41,Male,cough,Asthma,2024-01-01,2024-01-02,too,long\n")
    ST.run_clean_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [r["encounter_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def _notes(spark, path, rows):
    spark.createDataFrame(rows, "id long, level string, title string, created_at timestamp, is_read int") \
        .coalesce(1).write.mode("append").parquet(path)


def test_old_unread_rows_survive_later_batches(spark, tmp_path):
    import datetime as dt
    src, day = str(tmp_path / "in"), lambda n: dt.datetime(2024, 1, n)
    schema = None
    for batch in ([(1, "info", "a", day(20), 0)], [(2, "info", "old", day(1), 0), (1, "info", "a", day(20), 0)]):
        _notes(spark, src, batch)
        schema = spark.read.parquet(src).schema
        ST.run_unread_stream(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_running_counts_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("Flu", "A", "Low")], [("Flu", "B", "High"), ("Cold", "A", "Low")]):
        spark.createDataFrame(batch, "diagnosis string, hospital_zone string, risk_level string").write.mode("append").parquet(src)
        ST.run_count_stream(spark, src, spark.read.parquet(src).schema, out, str(tmp_path / "ck"))
    got = {(r["kind"], r["name"]): r["count"] for r in ST.latest_counts(spark, out).collect()}
    assert got == {("diagnosis", "Flu"): 2, ("diagnosis", "Cold"): 1, ("zone", "A"): 2, ("zone", "B"): 1,
                   ("risk", "Low"): 2, ("risk", "High"): 1}


# ------------------------------------------------------------ catalogue
RAW = "dataset string, diagnosis string, age_raw string, gender string, symptoms string"


def test_spellings_fold_into_one_profile(spark):
    rows = [("main", "Asthma", "40", "M", "cough"), ("main", "ASTHMA", "41", "F", "Wheeze"),
            ("active", "Asthma", "50", "M", "cough, fever"), ("active", " asthma ", None, "F", "")]
    raw = spark.createDataFrame(rows, RAW)
    got = CT.merge_profiles(CT.dataset_profiles(raw), ["main", "active"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["n"], r["name"], r["sources"]) == (4, "ASTHMA", ["main", "main", "active", "active"])
    assert r["common_symptoms"] == ["wheeze", "cough", "fever"] and dict(r["gender_distribution"]) == {"M": 2, "F": 2}
    assert r["avg_age"] == 45   # (41, 40) -> 40; (40, 50) -> 45; an absent mean changes nothing


def test_a_disease_without_symptoms_has_none(spark):
    d = spark.createDataFrame([(1, "Rare", "ana")], "id long, name string, created_by string")
    none = spark.createDataFrame([], "id long, name string, normalized string")
    links = spark.createDataFrame([], "disease_id long, symptom_id long")
    assert CT.manual_diseases(d, none, links).first()["common_symptoms"] == []


def test_an_update_keeps_identity(spark):
    d = spark.createDataFrame([(1, "Rare", "ana"), (2, "Other", "bob")], "id long, name string, created_by string") \
        .withColumn("created_at", F.to_timestamp(F.lit("2020-01-01")))
    s = spark.createDataFrame([(11, "Cough", "cough")], "id long, name string, normalized string")
    li = spark.createDataFrame([(1, 11), (2, 11)], "disease_id long, symptom_id long")
    ups = spark.createDataFrame([(5, "RARE", ["cough", "New  One"]), (6, "Fresh", ["cough"])],
                                "seq long, name string, symptoms array<string>")
    nd, ns, nl = CT.upsert_manual(d, s, li, ups, "eva")
    by = {r["name"]: r for r in nd.collect()}
    assert (by["RARE"]["id"], by["RARE"]["created_by"], by["RARE"]["created_at"].year) == (1, "ana", 2020)
    assert by["Fresh"]["created_by"] == "eva" and by["Other"]["updated_at"] is None
    ids = {r["normalized"]: r["id"] for r in ns.collect()}
    assert ids["cough"] == 11
    assert {tuple(r) for r in nl.collect()} == {(1, 11), (1, ids["new one"]), (2, 11), (by["Fresh"]["id"], 11)}


def test_labels_are_trimmed_as_python_does(spark):
    df = spark.createDataFrame([(f"{NBSP}Cough{NBSP}",)], "s string")
    plain = spark.createDataFrame([("cough",)], "s string")
    for f in (L.translate_symptom_list, L.translate_symptom_pair):
        assert df.select(f(F.col("s"), F.lit("es"))).first()[0] == plain.select(f(F.col("s"), F.lit("es"))).first()[0]


def test_confusion_matrix_has_a_row_for_each_class(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "y_true string, y_pred string")
    got = {r["true_class"]: (r["a"], r["b"]) for r in EV.confusion_matrix(pairs, ["a", "b"]).collect()}
    assert got == {"a": (1, 1), "b": (0, 0)}


def test_import_takes_another_assigner(spark):
    raw = spark.createDataFrame([(1, "40", "M", "cough", "Asthma"), (2, "x", "M", "cough", "Asthma"), (3, "50", "", "a", "b")],
                                "row_no long, age_raw string, gender string, symptoms string, diagnosis string")
    assert [r["row_no"] for r in CO.import_rows(raw, max_rows=2).collect()] == [1]
    s = CO.import_summary(raw, "d").first()
    assert (s["rows_processed"], s["inserted"], s["skipped"]) == (3, 2, 1)


def test_events_of_finished_and_failed_runs(spark):
    from carelake.operators import logs as LG
    rows = "ok boolean, rows_raw long, rows_final long, distinct_diagnoses long, failed_stage string"
    good = LG.event_etl_finished(spark.createDataFrame([(True, 9, 7, 2, None)], rows), "d.csv", 12).first()
    assert good["message"] == "d.csv: 9 → 7 filas en 12 ms" and '"total_elapsed_ms":12' in good["meta"]
    bad = LG.event_etl_finished(spark.createDataFrame([(False, 9, 0, 0, "clean")], rows), "d.csv").first()
    assert (bad["level"], bad["meta"]) == ("warning", '{"dataset":"d.csv","failed":["clean"]}')
    some = spark.createDataFrame([(10, 2)], "checked long, anomalies_count long")
    assert LG.event_anomalies(some).first()["message"].startswith("2 paciente(s)")


def test_image_counts_have_every_cell(spark):
    from carelake.operators import images as IM
    man = spark.createDataFrame([("train", "covid")], "target_split string, class string")
    got = {(r["split"], r["class"]): r["n"] for r in IM.split_class_counts(man).collect()}
    assert len(got) == 6 and sum(got.values()) == 1 and not IM.counts_ok(man).first()["ok"]


# ----------------------------------------------------------- exact cuts
def test_cuts_of_many_labels(spark):
    n = 100_000
    df = spark.range(2 * n).select(F.col("id"), (F.col("id") % n).alias("label"),
                                   SM.hash32(1, F.col("id")).alias("h"))
    got = SM.k_smallest(df, "h", "id", lambda c: F.lit(1), keys=["label"])
    per = got.groupBy("label").agg(F.count_if("selected").alias("k"), F.min(F.when(F.col("selected"), F.col("h"))).alias("a"),
                                   F.min("h").alias("b"))
    assert per.filter((F.col("k") != 1) | (F.col("a") != F.col("b"))).isEmpty() and per.count() == n


def test_ties_in_the_hash_are_cut_exactly(spark):
    df = spark.range(100).select("id", F.lit(7).cast("long").alias("h"))
    got = SM.k_smallest(df, "h", "id", lambda c: F.floor(c * 0.3))
    assert sorted(r["id"] for r in got.filter("selected").collect()) == list(range(30))


def test_folds_are_stratified(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 17, "rare").otherwise("often").alias("y"))
    sizes = SM.folds(df, "y", "id", 3).groupBy("y", "fold").count().collect()
    for y, n in (("rare", 17), ("often", 983)):
        counts = sorted(r["count"] for r in sizes if r["y"] == y)
        assert len(counts) == 3 and sum(counts) == n and counts[-1] - counts[0] <= 1


# ---------------------------------------------------------------- plans
def test_shared_folder_is_asked_for_on_a_cluster():
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None,
                                    getConf=lambda: types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(types.SimpleNamespace(sparkContext=context))


def test_clean_filter_builds_no_text(spark, sf_dir):
    from carelake.sources.fixture import encounters_raw
    plan = C.clean(encounters_raw(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "array_repeat" in line]


def test_keyword_zone_strips_once(spark):
    df = spark.createDataFrame([("x",)], "d string").select(T.keyword_zone("d").alias("z"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
