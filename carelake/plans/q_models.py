"""Registered queries: evaluation, deterministic sampling, TF-IDF, images."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from carelake import oracle as O
from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import evaluate as EV
from carelake.operators import features as FE
from carelake.operators import images as IM
from carelake.operators import sampling as SM
from carelake.operators import tfidf as TF
from carelake.plans.registry import register
from carelake.plans.q_records import PRED_CTES
from carelake.session import spread, written
from carelake.sources import records as R
from carelake.sources.fixture import encounters_raw


# ------------------------------------------------------------ shared frames
def model_rows(spark, d):
    return FE.model_rows(encounters_raw(spark, d, with_copy=True))


def train_docs(spark, d):
    """Model rows with the dropout text."""
    return model_rows(spark, d).withColumn(
        "symptoms_train", SM.symptom_dropout(F.col("symptoms_clean"), F.col("encounter_id")))


def xray_pairs(spark, d):
    cls = F.array(*[F.lit(c) for c in K.XRAY_CLASSES])
    return R.xray_predictions(spark, d).select(
        "pred_id", F.get(cls, (F.col("true_label") % 3).cast("int")).alias("y_true"),
        F.col("predicted_class").alias("y_pred"))


# ---------------------------------------------------------------- SQL bits
def h32(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::UBIGINT AS BIGINT)"


MODEL_ROWS_CTE = (
    "mrows AS (SELECT encounter_id, CAST(trunc(" + O.numeric_value("age_raw") + ") AS INTEGER) AS age, gender, diagnosis, "
    "coalesce(datediff('day', date_of_admission, discharge_date), 0) AS days, trim(lower(symptoms)) AS symptoms_clean "
    "FROM encounters_raw WHERE age_raw IS NOT NULL AND gender IS NOT NULL AND symptoms IS NOT NULL "
    "AND diagnosis IS NOT NULL AND " + O.numeric_value("age_raw") + " IS NOT NULL), "
    "mrisk AS (SELECT *, " + O.assign_risk("diagnosis", "age", "days") + " AS risk_level FROM mrows)")
DROPOUT_CTE = (
    "mscored AS (SELECT *, list_transform(" + O.split_items("symptoms_clean") + ", lambda s, i: {'h': "
    + h32("'42'", "CAST(encounter_id AS VARCHAR)", "CAST(i - 1 AS VARCHAR)") + " / 4294967296.0, 's': s}) AS scored "
    "FROM mrisk), "
    "mdocs AS (SELECT *, CASE WHEN len(scored) = 0 THEN '' WHEN len(list_filter(scored, lambda e: e.h < 0.65)) > 0 "
    "THEN array_to_string(list_transform(list_filter(scored, lambda e: e.h < 0.65), lambda e: e.s), ', ') "
    "ELSE list_min(scored).s END AS symptoms_train FROM mscored)")
SCORES_CTE = (
    "classes AS (SELECT diagnosis, coalesce(lead(diagnosis) OVER (ORDER BY diagnosis), "
    "first_value(diagnosis) OVER (ORDER BY diagnosis)) AS next_class FROM (SELECT DISTINCT diagnosis FROM clean)), "
    "sc AS (SELECT c.encounter_id, c.diagnosis AS y_true, CASE WHEN c.encounter_id % 7 = 0 THEN k.next_class "
    "ELSE c.diagnosis END AS y_pred FROM clean c JOIN classes k USING (diagnosis))")


def report_sql(pairs: str) -> str:
    """CTEs ending in ``rep``: the A27 report over ``pairs`` (y_true, y_pred)."""
    return (
        f"cc AS (SELECT cls, count_if(is_true) AS support, count_if(NOT is_true) AS predicted, "
        f"count_if(is_true AND hit) AS tp FROM (SELECT y_true AS cls, true AS is_true, y_true = y_pred AS hit FROM {pairs} "
        f"UNION ALL SELECT y_pred, false, y_true = y_pred FROM {pairs}) GROUP BY cls), "
        "pc AS (SELECT cls, CASE WHEN predicted <> 0 THEN tp / predicted ELSE 0.0 END AS precision, "
        "CASE WHEN support <> 0 THEN tp / support ELSE 0.0 END AS recall, support FROM cc), "
        "pcf AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) "
        "ELSE 0.0 END AS f1 FROM pc), "
        "tot AS (SELECT CAST(sum(support) AS BIGINT) AS n, sum(recall * support) AS correct, avg(precision) AS mp, avg(recall) AS mr, "
        "avg(f1) AS mf, sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM pcf), "
        "rep0 AS (SELECT cls, precision, recall, f1, support FROM pcf "
        "UNION ALL SELECT 'accuracy', correct / n, correct / n, correct / n, n FROM tot "
        "UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM tot "
        "UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, n FROM tot), "
        "rep AS (SELECT cls AS class, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, "
        "round_even(f1, 6) AS f1, support FROM rep0)")


# --------------------------------------------------------------- evaluation
@register("a27_classification_report", O.with_clean("SELECT * FROM rep", SCORES_CTE + ",\n" + report_sql("sc")))
def a27(spark, d):
    return EV.classification_report(R.split_scores(spark, d))


@register("a26_accuracy_f1", O.with_clean(
    "SELECT max(CASE WHEN class = 'accuracy' THEN precision END) AS accuracy, "
    "max(CASE WHEN class = 'weighted avg' THEN f1 END) AS f1_weighted FROM rep", SCORES_CTE + ",\n" + report_sql("sc")))
def a26(spark, d):
    return EV.accuracy_f1(R.split_scores(spark, d))


_XPAIRS = ("xp AS (SELECT pred_id, ([" + ", ".join(O.q(c) for c in K.XRAY_CLASSES)
           + "])[true_label % 3 + 1] AS y_true, predicted_class AS y_pred FROM preds)")


@register("a28_confusion_matrix", O.with_fixture(
    "SELECT y_true AS true_class, " + ", ".join(f"count_if(y_pred = {O.q(c)}) AS {c}" for c in K.XRAY_CLASSES)
    + " FROM xp GROUP BY 1", PRED_CTES + ", " + _XPAIRS))
def a28(spark, d):
    return EV.confusion_matrix(xray_pairs(spark, d), K.XRAY_CLASSES)


@register("a29_clinical_misses", O.with_fixture(
    "SELECT count_if(y_true = 'covid' AND y_pred = 'normal') AS covid_missed_as_normal, "
    "count_if(y_true = 'covid' AND y_pred = 'pneumonia') AS covid_missed_as_pneumonia, "
    "count_if(y_true = 'pneumonia' AND y_pred = 'normal') AS pneumonia_missed_as_normal, "
    "count_if(y_true = 'normal' AND y_pred = 'covid') AS normal_missed_as_covid FROM xp", PRED_CTES + ", " + _XPAIRS))
def a29(spark, d):
    return EV.clinical_misses(xray_pairs(spark, d))


@register("a27_xray_report", O.with_fixture("SELECT * FROM rep", PRED_CTES + ", " + _XPAIRS + ", " + report_sql("xp")))
def a27x(spark, d):
    return EV.classification_report(xray_pairs(spark, d))


@register("a25_class_weights", O.with_fixture(
    "SELECT diagnosis, count(*) AS n_class, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight "
    "FROM mrows GROUP BY diagnosis", MODEL_ROWS_CTE))
def a25(spark, d):
    return EV.balanced_weights(model_rows(spark, d), "diagnosis")


@register("a30_risk_label_counts", O.with_fixture(
    "SELECT risk_level, count(*) AS count FROM mrisk GROUP BY 1", MODEL_ROWS_CTE))
def a30(spark, d):
    return EV.label_counts(model_rows(spark, d), "risk_level")


@register("m05_label_index", O.with_fixture(
    "SELECT diagnosis, CAST(dense_rank() OVER (ORDER BY diagnosis) - 1 AS DOUBLE) AS label_idx "
    "FROM (SELECT DISTINCT diagnosis FROM mrows)", MODEL_ROWS_CTE))
def m05(spark, d):
    rows = model_rows(spark, d)
    idx = StringIndexer(inputCol="diagnosis", outputCol="label_idx", stringOrderType="alphabetAsc").fit(rows)
    return idx.transform(rows.select("diagnosis").distinct())


# ----------------------------------------------------------------- sampling
@register("m01_symptom_dropout", O.with_fixture(
    "SELECT encounter_id, symptoms_train FROM mdocs", MODEL_ROWS_CTE + ", " + DROPOUT_CTE))
def m01(spark, d):
    return train_docs(spark, d).select("encounter_id", "symptoms_train")


@register("m02_label_noise", O.with_fixture(
    "SELECT encounter_id, risk_level, CASE WHEN encounter_id IN (SELECT encounter_id FROM (SELECT encounter_id, "
    + h32("'42'", "CAST(encounter_id AS VARCHAR)") + " AS h FROM mrisk ORDER BY h, encounter_id LIMIT "
    "(SELECT CAST(floor(count(*) * 0.05) AS BIGINT) FROM mrisk))) THEN "
    "(list_filter(['Low', 'Medium', 'High'], lambda c: c <> risk_level))[("
    + h32("'42'", "'alt'", "CAST(encounter_id AS VARCHAR)") + " % 2) + 1] ELSE risk_level END AS label_noisy "
    "FROM mrisk", MODEL_ROWS_CTE))
def m02(spark, d):
    rows = model_rows(spark, d).select("encounter_id", "row_key", "risk_level")
    return SM.label_noise(rows, "risk_level", "encounter_id", K.RISK_CLASSES, tie_col="row_key") \
        .select("encounter_id", "risk_level", "label_noisy")


@register("w03_stratified_split", O.with_fixture(
    "SELECT encounter_id, diagnosis, row_number() OVER (PARTITION BY diagnosis ORDER BY "
    + h32("'42'", "'split'", "CAST(encounter_id AS VARCHAR)") + ", encounter_id) <= "
    "floor(count(*) OVER (PARTITION BY diagnosis) * 0.2 + 0.5) AS is_test FROM mrows", MODEL_ROWS_CTE))
def w03(spark, d):
    rows = model_rows(spark, d).select("encounter_id", "row_key", "diagnosis")
    return SM.split_exact(rows, "diagnosis", "encounter_id", tie_col="row_key") \
        .select("encounter_id", "diagnosis", "is_test")


@register("w04_folds", O.with_fixture(
    "SELECT encounter_id, diagnosis, CAST(floor((row_number() OVER (PARTITION BY diagnosis ORDER BY "
    + h32("'42'", "'fold'", "CAST(encounter_id AS VARCHAR)") + ", encounter_id) - 1) * 3.0 "
    "/ count(*) OVER (PARTITION BY diagnosis)) AS INTEGER) AS fold FROM mrows", MODEL_ROWS_CTE))
def w04(spark, d):
    rows = model_rows(spark, d).select("encounter_id", "row_key", "diagnosis")
    return SM.folds(rows, "diagnosis", "encounter_id", tie_col="row_key") \
        .select("encounter_id", "diagnosis", "fold")


# -------------------------------------------------------------------- TF-IDF
TFIDF_CTES = (
    "tftok AS (SELECT row_number() OVER () AS doc, encounter_id, regexp_extract_all(lower(symptoms_train), "
    "'\\b\\w\\w+\\b') AS t FROM mdocs), "
    "trm AS (SELECT doc, encounter_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) "
    "AS term FROM tftok), "
    "tfc AS (SELECT doc, encounter_id, term, count(*) AS tf FROM trm GROUP BY ALL), "
    "ndocs AS (SELECT count(*) AS n FROM mdocs), "
    "voc AS (SELECT term, ln((1.0 + (SELECT n FROM ndocs)) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df, "
    "sum(tf) AS total FROM tfc GROUP BY term) WHERE df >= 2 ORDER BY total DESC, term LIMIT 400), "
    "wr AS (SELECT doc, encounter_id, term, (1.0 + ln(tf)) * idf AS w FROM tfc JOIN voc USING (term)), "
    "wn AS (SELECT encounter_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM wr)")


@register("m03_tfidf_weights", O.with_fixture(
    "SELECT encounter_id, term, round_even(weight, 6) AS weight FROM wn",
    MODEL_ROWS_CTE + ", " + DROPOUT_CTE + ", " + TFIDF_CTES))
def m03(spark, d):
    # Two passes (vocabulary, weights) read the documents: write them once.
    docs = spread(written(train_docs(spark, d).select("encounter_id", "symptoms_train"), "tfidf-docs"))
    vocab = TF.fit_vocabulary(docs, "encounter_id", "symptoms_train")
    return TF.weights_long(docs, vocab, "encounter_id", "symptoms_train") \
        .select("encounter_id", "term", F.bround("weight", 6).alias("weight"))


@register("m03_tfidf_vocabulary", O.with_fixture(
    "SELECT term, round_even(idf, 6) AS idf FROM voc", MODEL_ROWS_CTE + ", " + DROPOUT_CTE + ", " + TFIDF_CTES))
def m03v(spark, d):
    docs = train_docs(spark, d).select("encounter_id", "symptoms_train")
    return TF.fit_vocabulary(docs, "encounter_id", "symptoms_train").select("term", F.bround("idf", 6).alias("idf"))


# -------------------------------------------------------------------- images
_EXTS = [".jpg", ".JPEG", ".png", ".Webp", ".bmp", ".gif", ".txt"]
_FOLDERS = ["covid", "normal", "pneumonia_bac", "pneumonia_vir", "PNEUMONIA"]
MANIFEST_CTES = (
    "files AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'chest_xray' WHEN page_id % 5 = 3 THEN "
    "'dataset_4_classes' ELSE 'dataset_3_classes' END AS dataset, (['train', 'test', 'val'])[page_id % 3 + 1] AS split, "
    f"({O.lst(_FOLDERS)})[page_id % 5 + 1] AS folder, 'img_' || page_id || ({O.lst(_EXTS)})[page_id % 7 + 1] "
    "AS file_name FROM pages), "
    "lm AS (SELECT *, CASE dataset || '/' || folder "
    + " ".join(f"WHEN '{ds}/{fo}' THEN '{cl}'" for ds, fo, cl in IM.FOLDER_CLASSES)
    + " END AS class, CASE WHEN split = 'val' THEN 'train' ELSE split END AS target_split FROM files "
    "WHERE ((dataset IN ('dataset_3_classes', 'dataset_4_classes') AND split IN ('train', 'test')) OR dataset = 'chest_xray') "
    f"AND lower(regexp_extract(file_name, '[^.](\\.[^./]+)$', 1)) IN ({', '.join(O.q(e) for e in K.TRAIN_IMAGE_EXTS)})), "
    "lmc AS (SELECT * FROM lm WHERE class IS NOT NULL), "
    f"man AS (SELECT lmc.*, rep FROM lmc, range(CASE WHEN class = 'covid' AND target_split = 'train' THEN "
    f"{K.COVID_TRAIN_OVERSAMPLE} ELSE 1 END) r(rep))")


def _files(spark, d):
    return R.image_manifest(spark, d)


@register("p32_image_label_map", O.with_fixture(
    "SELECT page_id, class, target_split FROM lmc", MANIFEST_CTES))
def p32(spark, d):
    return IM.label_map(_files(spark, d)).select("page_id", "class", "target_split")


@register("u03_oversampled_manifest", O.with_fixture(
    "SELECT page_id, rep, target_split, class FROM man", MANIFEST_CTES))
def u03(spark, d):
    return IM.manifest(_files(spark, d)).select("page_id", "rep", "target_split", "class")


@register("a24_image_counts", O.with_fixture(
    "SELECT target_split AS split, class, count(*) AS n FROM man GROUP BY ALL", MANIFEST_CTES))
def a24(spark, d):
    return IM.split_class_counts(IM.manifest(_files(spark, d)))


@register("a24_image_minimum", O.with_fixture(
    "SELECT count_if(target_split = 'train') AS train, count_if(target_split = 'test') AS test, "
    f"count_if(target_split = 'train') >= {K.MIN_TRAIN_IMAGES} AND count_if(target_split = 'test') >= {K.MIN_TEST_IMAGES} "
    "AS ok FROM man", MANIFEST_CTES))
def a24m(spark, d):
    return IM.counts_ok(IM.manifest(_files(spark, d)))


@register("a25_image_class_weights", O.with_fixture(
    "SELECT class, count(*) AS n_class, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight "
    "FROM man WHERE target_split = 'train' GROUP BY class", MANIFEST_CTES))
def a25i(spark, d):
    return EV.balanced_weights(IM.manifest(_files(spark, d)).filter(F.col("target_split") == "train"), "class")


_UPLOAD = ("ups AS (SELECT page_id, 'C:\\\\uploads\\\\' || CASE WHEN page_id % 11 = 0 THEN '' ELSE 'scan_' || page_id "
           f"|| ({O.lst(_EXTS + ['.DCM', '.tiff'])})[page_id % 9 + 1] END AS file_name FROM pages), "
           "upl AS (SELECT page_id, regexp_extract(replace(file_name, '\\', '/'), '([^/]*)$', 1) AS leaf FROM ups), "
           "upc AS (SELECT page_id, leaf, leaf <> '' AND lower(regexp_extract(leaf, '[^.](\\.[^./]+)$', 1)) IN ("
           + ", ".join(O.q(e) for e in K.UPLOAD_IMAGE_EXTS) + ") AS allowed FROM upl)")


def _uploads(spark, d):
    exts = F.array(*[F.lit(x) for x in _EXTS + [".DCM", ".tiff"]])
    p = R.table(spark, d, "pages").select("page_id")
    name = F.concat(F.lit("C:\\uploads\\"), F.when(F.col("page_id") % 11 == 0, F.lit(""))
                    .otherwise(F.concat(F.lit("scan_"), F.col("page_id").cast("string"),
                                        F.get(exts, (F.col("page_id") % 9).cast("int")))))
    return p.select("page_id", name.alias("file_name"))


@register("p30_upload_check", O.with_fixture("SELECT page_id, leaf, allowed FROM upc", _UPLOAD))
def p30(spark, d):
    return IM.upload_check(_uploads(spark, d)).select("page_id", "leaf", "allowed")


@register("a36_upload_summary", O.with_fixture(
    "SELECT count_if(allowed) AS uploaded, count_if(NOT allowed) AS skipped FROM upc", _UPLOAD))
def a36(spark, d):
    return IM.upload_summary(IM.upload_check(_uploads(spark, d)))


_CATS = ["dental", " RX ", "", "Teeth", "hospital", "xray", "Odontologia", "general"]


@register("p29_study_category", O.with_fixture(
    f"SELECT page_id, CASE WHEN lower(trim(c)) IN ({', '.join(O.q(x) for x in K.DENTAL_SYNONYMS)}) THEN 'dental' "
    f"WHEN lower(trim(c)) IN ({', '.join(O.q(x) for x in K.GENERAL_SYNONYMS)}) OR trim(c) = '' THEN 'general' END "
    f"AS category FROM (SELECT page_id, ({O.lst(_CATS)})[page_id % 8 + 1] AS c FROM pages)"))
def p29(spark, d):
    cats = F.array(*[F.lit(x) for x in _CATS])
    p = R.table(spark, d, "pages").select("page_id", F.get(cats, (F.col("page_id") % 8).cast("int")).alias("c"))
    return p.select("page_id", T.study_category("c").alias("category"))
