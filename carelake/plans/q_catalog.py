"""Registered queries: disease catalogue, manual diseases, symptom bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import oracle as O
from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators import catalog as CT
from carelake.plans.q_etl import profile_ctes
from carelake.plans.registry import register
from carelake.session import written
from carelake.sources import records as R
from carelake.sources.fixture import encounters_raw


def tagged(spark, d):
    """The two datasets as one frame with a source tag per row."""
    raw = encounters_raw(spark, d)
    return raw.withColumn("dataset", R.dataset_tag("encounter_id"))


def merged(spark, d):
    return CT.merge_profiles(CT.dataset_profiles(tagged(spark, d)), ["main", "active"])


def manual(spark, d):
    return CT.manual_diseases(*R.manual_catalogue(spark, d))


# ---------------------------------------------------------------- SQL bits
def sql_hash(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8))::UBIGINT AS BIGINT)"


TAGGED_CTE = ("tagged AS (SELECT *, CASE WHEN encounter_id % 3 = 0 THEN 'active' ELSE 'main' END AS dataset "
              "FROM encounters_raw), main_rows AS (SELECT * FROM tagged WHERE dataset = 'main'), "
              "active_rows AS (SELECT * FROM tagged WHERE dataset = 'active')")


def _union_ci_sql(a: str, b: str) -> str:
    return (f"(({a}) || list_filter({b}, lambda s: NOT list_contains(list_transform({a}, lambda t: lower(t)), "
            f"lower(s))))[1:12]")


MERGE_CTES = ",\n".join([
    TAGGED_CTE, profile_ctes("main_rows", "m_"), profile_ctes("active_rows", "a_"),
    "mgen AS (SELECT key, array_to_string(list(g || ':' || c ORDER BY g), ';') AS genders FROM "
    "(SELECT lower(trim(coalesce(diagnosis, ''))) AS key, coalesce(gender, '') AS g, count(*) AS c "
    "FROM tagged WHERE trim(coalesce(diagnosis, '')) <> '' GROUP BY ALL) GROUP BY key)",
    "merged AS (SELECT coalesce(lower(m.diagnosis), lower(a.diagnosis)) AS key, coalesce(m.diagnosis, a.diagnosis) AS name, "
    "coalesce(m.n, 0) + coalesce(a.n, 0) AS n, "
    "CASE WHEN m.diagnosis IS NULL THEN a.syms WHEN a.diagnosis IS NULL THEN m.syms ELSE "
    + _union_ci_sql("m.syms", "a.syms") + " END AS syms, "
    "CASE WHEN coalesce(m.avg_age, 0) <> 0 AND coalesce(a.avg_age, 0) <> 0 "
    "THEN CAST(round_even((m.avg_age + a.avg_age) / 2.0, 0) AS INTEGER) "
    "WHEN coalesce(m.avg_age, 0) <> 0 THEN m.avg_age ELSE coalesce(a.avg_age, 0) END AS avg_age, "
    "concat_ws(',', CASE WHEN m.diagnosis IS NOT NULL THEN 'main' END, CASE WHEN a.diagnosis IS NOT NULL THEN 'active' END) "
    "AS sources FROM m_profiles m FULL OUTER JOIN a_profiles a ON lower(m.diagnosis) = lower(a.diagnosis))",
])

MANUAL_CTES = ",\n".join([
    "seed0 AS (SELECT encounter_id, upper(" + O.normalize_term("diagnosis") + ") AS disease, "
    + O.split_items("coalesce(symptoms, '')") + " AS items FROM encounters_raw "
    "WHERE diagnosis IS NOT NULL)",
    "seed AS (SELECT encounter_id, disease, pos, " + O.collapse("spelling") + " AS spelling FROM "
    "(SELECT encounter_id, disease, unnest(items) AS spelling, unnest(range(len(items))) AS pos FROM seed0) "
    f"WHERE disease <> '' AND {sql_hash('lower(disease)')} % {R.MANUAL_PART} = 0)",
    f"m_diseases AS (SELECT {sql_hash('lower(name)')} AS id, name, 'staff' AS created_by FROM "
    f"(SELECT DISTINCT disease AS name FROM seed UNION ALL SELECT {O.q(R.MANUAL_EXTRA)}))",
    f"m_symptoms AS (SELECT {sql_hash('normalized')} AS id, name, normalized FROM (SELECT "
    + O.normalize_term("spelling") + " AS normalized, arg_min(spelling, {'e': encounter_id, 'p': pos}) AS name "
    "FROM seed GROUP BY 1))",
    f"m_links AS (SELECT DISTINCT {sql_hash('lower(disease)')} AS disease_id, "
    + sql_hash(O.normalize_term("spelling")) + " AS symptom_id FROM seed)",
    "manual AS (SELECT d.id, d.name, d.created_by, count(l.symptom_id) AS symptoms_count, "
    "coalesce(list(s.name ORDER BY lower(s.name), s.name) FILTER (WHERE s.name IS NOT NULL), []) AS syms "
    "FROM m_diseases d LEFT JOIN m_links l ON d.id = l.disease_id LEFT JOIN m_symptoms s ON l.symptom_id = s.id "
    "GROUP BY d.id, d.name, d.created_by)",
])


# ------------------------------------------------------------------ queries
@register("s04_tagged_datasets", O.with_fixture(
    "SELECT dataset, count(*) AS n, count(DISTINCT encounter_id) AS encounters FROM tagged GROUP BY dataset", TAGGED_CTE))
def s04(spark, d):
    return tagged(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                                   F.count_distinct("encounter_id").alias("encounters"))


@register("a12_profile_merge", O.with_fixture(
    "SELECT name, n, avg_age, array_to_string(syms, ', ') AS common_symptoms, g.genders, sources "
    "FROM merged LEFT JOIN mgen g USING (key)", MERGE_CTES))
def a12(spark, d):
    return CT.flat_catalogue(merged(spark, d))


@register("j03_new_diagnoses", O.with_fixture(
    "SELECT DISTINCT trim(coalesce(diagnosis, '')) AS diagnosis FROM encounters_raw WHERE trim(coalesce(diagnosis, '')) <> '' "
    f"AND trim(coalesce(diagnosis, '')) NOT IN ({', '.join(O.q(k) for k in K.KNOWN_DISEASE_CLASSES)})"))
def j03(spark, d):
    return CT.new_diagnoses(encounters_raw(spark, d))


@register("j05_manual_diseases", O.with_fixture(
    "SELECT id, name, created_by, symptoms_count, array_to_string(syms, ', ') AS common_symptoms, "
    "CAST(0 AS BIGINT) AS count, 0 AS avg_age FROM manual", MANUAL_CTES))
def j05(spark, d):
    return manual(spark, d).withColumn("common_symptoms", F.array_join("common_symptoms", ", "))


@register("s15_manual_tables", O.with_fixture(
    "SELECT 'diseases' AS t, count(*) AS n FROM m_diseases UNION ALL SELECT 'symptoms', count(*) FROM m_symptoms "
    "UNION ALL SELECT 'links', count(*) FROM m_links", MANUAL_CTES))
def s15(spark, d):
    ds, sy, li = R.manual_catalogue(spark, d)
    cnt = lambda df, t: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
    return cnt(ds, "diseases").unionByName(cnt(sy, "symptoms")).unionByName(cnt(li, "links"))


_LOW_KNOWN = ", ".join(O.q(k.lower()) for k in K.KNOWN_DISEASE_CLASSES)


REGISTRY_SQL_J04 = O.with_fixture(
    "SELECT coalesce(d.name, m.name) AS name, coalesce(d.n, 0) AS n, coalesce(d.avg_age, 0) AS avg_age, "
    "array_to_string(CASE WHEN d.key IS NULL THEN m.syms WHEN m.name IS NULL THEN d.syms ELSE "
    + _union_ci_sql("d.syms", "m.syms") + " END, ', ') AS common_symptoms, coalesce(g.genders, '') AS genders, "
    "coalesce(d.sources, '') AS sources, m.name IS NOT NULL AS manual, "
    f"lower(trim(coalesce(d.name, m.name))) NOT IN ({_LOW_KNOWN}) AS new_for_model "
    "FROM merged d FULL OUTER JOIN manual m ON d.key = lower(trim(m.name)) LEFT JOIN mgen g ON g.key = d.key",
    MERGE_CTES + ",\n" + MANUAL_CTES)


@register("j04_catalogue_with_manual", REGISTRY_SQL_J04)
def j04(spark, d):
    cat = CT.flag_new_for_model(CT.with_manual(merged(spark, d), manual(spark, d)))
    out = CT.flat_catalogue(CT.catalogue(cat))
    return out.withColumn("genders", F.coalesce("genders", F.lit("")))


@register("j06_new_for_model", O.with_fixture(
    f"SELECT name, lower(trim(name)) NOT IN ({_LOW_KNOWN}) AS new_for_model FROM merged", MERGE_CTES))
def j06(spark, d):
    return CT.flag_new_for_model(merged(spark, d)).select("name", "new_for_model")


@register("u01_symptom_bank", O.with_fixture(
    "SELECT symptom FROM (SELECT max(trim(name)) AS symptom, lower(trim(name)) AS key FROM m_symptoms GROUP BY 2 "
    "UNION ALL SELECT min(t), lower(t) FROM (SELECT trim(unnest(syms)) AS t FROM merged) WHERE t <> '' "
    "AND lower(t) NOT IN (SELECT lower(trim(name)) FROM m_symptoms) GROUP BY lower(t))",
    MERGE_CTES + ",\n" + MANUAL_CTES))
def u01(spark, d):
    _ds, sy, _li = R.manual_catalogue(spark, d)
    return CT.symptom_bank(sy, merged(spark, d))


@register("u04_zone_catalogue", O.with_fixture(
    "SELECT z.diagnosis, z.zone, z.doctor, coalesce(c.n, 0) AS encounters FROM (VALUES "
    + ", ".join(f"({O.q(a)}, {O.q(b)}, {O.q(c)})" for a, b, c in K.DIAGNOSIS_ASSIGNMENTS)
    + ") AS z(diagnosis, zone, doctor) LEFT JOIN (SELECT trim(diagnosis) AS diagnosis, count(*) AS n FROM encounters_raw "
    "GROUP BY 1) c USING (diagnosis)"))
def u04(spark, d):
    from carelake.operators.lookup import zone_catalogue
    counts = (encounters_raw(spark, d).groupBy(T.py_strip("diagnosis").alias("diagnosis"))
              .agg(F.count(F.lit(1)).alias("n")))
    z = zone_catalogue(spark)
    return (z.join(counts, "diagnosis", "left")
            .select("diagnosis", "zone", "doctor", F.coalesce("n", F.lit(0)).alias("encounters")))


_NM = O.collapse(O.strip("diagnosis"))


# Stored ids differ from the hash that new rows get, so that lost identities show.
STORED_DISEASE, STORED_SYMPTOM = 5_000_000_000, 7_000_000_000


@register("j11_upsert_manual", O.with_fixture(
    "SELECT d.id, d.name, d.created_by, d.stored, count(DISTINCT s.normalized) AS symptoms_count FROM up_d d "
    "LEFT JOIN up_l l ON l.disease_id = d.id LEFT JOIN up_s s ON s.id = l.symptom_id GROUP BY ALL",
    MANUAL_CTES + ",\n" +
    # Upserts: encounters give (diagnosis, symptom items), applied in id order.
    f"upd0 AS (SELECT encounter_id, {_NM} AS nm, " + O.split_items("coalesce(symptoms, '')")
    + " AS items FROM encounters_raw WHERE diagnosis IS NOT NULL AND " + _NM + " <> ''), "
    "upd AS (SELECT lower(nm) AS key, arg_max(nm, encounter_id) AS nm, max(encounter_id) AS last_e FROM upd0 GROUP BY 1), "
    "upd_items AS (SELECT lower(nm) AS key, encounter_id AS e, " + O.normalize_term("it") + " AS normalized "
    "FROM (SELECT nm, encounter_id, unnest(items) AS it FROM upd0)), "
    f"st_d AS (SELECT id + {STORED_DISEASE} AS id, name, created_by, lower(name) AS key FROM m_diseases), "
    f"st_s AS (SELECT id + {STORED_SYMPTOM} AS id, normalized FROM m_symptoms), "
    f"st_l AS (SELECT disease_id + {STORED_DISEASE} AS disease_id, symptom_id + {STORED_SYMPTOM} AS symptom_id FROM m_links), "
    f"up_d AS (SELECT coalesce(s.id, {sql_hash('u.key')}) AS id, coalesce(u.nm, s.name) AS name, "
    "CASE WHEN s.id IS NULL THEN 'editor' ELSE s.created_by END AS created_by, s.id IS NOT NULL AS stored, u.key, u.last_e "
    "FROM st_d s FULL OUTER JOIN upd u ON s.key = u.key), "
    "up_s AS (SELECT id, normalized FROM st_s UNION ALL SELECT DISTINCT " + sql_hash("normalized")
    + ", normalized FROM upd_items WHERE normalized NOT IN (SELECT normalized FROM m_symptoms) AND normalized <> ''), "
    "up_l AS (SELECT * FROM st_l WHERE disease_id NOT IN (SELECT id FROM up_d WHERE last_e IS NOT NULL) "
    "UNION SELECT DISTINCT d.id, s.id FROM up_d d JOIN upd_items i ON d.key = i.key AND d.last_e = i.e "
    "JOIN up_s s ON s.normalized = i.normalized)"))
def j11(spark, d):
    ds, sy, li = R.manual_catalogue(spark, d)
    then = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    ds = ds.withColumn("id", F.col("id") + STORED_DISEASE).withColumn("created_at", then)
    sy = sy.withColumn("id", F.col("id") + STORED_SYMPTOM)
    li = li.select((F.col("disease_id") + STORED_DISEASE).alias("disease_id"),
                   (F.col("symptom_id") + STORED_SYMPTOM).alias("symptom_id"))
    edits = written(CT.upserts_from(encounters_raw(spark, d)), "manual-edits")
    nd, ns, nl = CT.upsert_manual(ds, sy, li, edits, "editor")
    nd = nd.withColumn("stored", F.col("created_at") == then)
    j = nd.join(nl, nd["id"] == nl["disease_id"], "left").join(
        ns.select(F.col("id").alias("sid"), "normalized"), F.col("symptom_id") == F.col("sid"), "left")
    return j.groupBy(nd["id"], "name", "created_by", "stored").agg(F.count_distinct("normalized").alias("symptoms_count"))
