"""Disease catalogue: profiles over datasets, manual diseases, symptom bank.

A12, J03-J06, J11, U01, L06. Inputs are per-disease profiles (A11), already
one row per disease, so every join here is between small aggregated tables;
the heavy work is the grouped aggregation that built them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.operators.analytics import disease_profiles, raw_text
from carelake.session import written

SYMPTOM_CAP = 12


def _union_ci(first: Column, second: Column, cap: int = SYMPTOM_CAP) -> Column:
    """``first`` then items of ``second`` whose lower form is new; at most ``cap``."""
    low = F.transform(first, lambda s: F.lower(s))
    extra = F.filter(second, lambda s: ~F.array_contains(low, F.lower(s)))
    # An item repeated (without case) inside ``extra`` keeps its first spelling.
    extra = F.filter(F.transform(extra, lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
                     lambda e: F.array_position(F.transform(extra, lambda t: F.lower(t)), F.lower(e["s"])) == e["i"] + 1)
    both = F.concat(first, F.transform(extra, lambda e: e["s"]))
    return F.slice(both, 1, cap)


def merge_profiles(profiles: DataFrame, datasets: list[str]) -> DataFrame:
    """Merge the profiles of any number of datasets on lower(name), in dataset order.

    ``profiles`` has a ``dataset`` column. Spellings of one name fold too, within a
    dataset in name order: counts add up, the first name is kept, symptoms are united
    (cap 12), the mean age is the plain mean of the two rounded means or the non-zero
    one (K18), gender maps add up, and the source list grows by one entry a profile.
    """
    order = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset"))
    item = F.struct(order.alias("o"), F.col("diagnosis").alias("name"), "n", F.col("common_symptoms").alias("syms"),
                    "avg_age", F.map_entries("gender_distribution").alias("genders"), F.col("dataset").alias("src"))
    groups = (profiles.withColumn("key", F.lower(T.py_strip("diagnosis"))).filter((F.col("key") != "") & (order > 0))
              .groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("items")))
    head, tail = F.get("items", F.lit(0)), F.slice("items", 2, F.greatest(F.size("items"), F.lit(1)))

    def mean(a: Column, b: Column) -> Column:
        return F.when((a != 0) & (b != 0), F.bround((a + b) / 2.0, 0).cast("int")).when(a != 0, a).otherwise(b)

    empty = F.create_map().cast("map<string,bigint>")
    return groups.select(
        "key", head["name"].alias("name"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n"),
        F.aggregate(tail, head["syms"], lambda acc, x: _union_ci(acc, x["syms"])).alias("common_symptoms"),
        F.aggregate(tail, head["avg_age"], lambda acc, x: mean(acc, x["avg_age"])).alias("avg_age"),
        F.aggregate("items", empty, lambda acc, x: F.map_zip_with(
            acc, F.map_from_entries(x["genders"]),
            lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))).alias("gender_distribution"),
        F.transform("items", lambda x: x["src"]).alias("sources"))


def dataset_profiles(raw: DataFrame, tag_col: str = "dataset") -> DataFrame:
    """S04 + A11: profiles of every tagged dataset in one pass."""
    return disease_profiles(raw.withColumn("dataset", F.col(tag_col)), by=("dataset",))


def manual_diseases(diseases: DataFrame, symptoms: DataFrame, links: DataFrame) -> DataFrame:
    """Manual diseases with symptom count and names sorted by lower name.

    Diseases without symptoms are kept (left joins, ``count(symptom_id)``).
    """
    d = diseases.select("id", "name", "created_by")
    j = (d.join(links, d["id"] == links["disease_id"], "left")
         .join(symptoms.select(F.col("id").alias("sid"), F.col("name").alias("sname")),
               F.col("symptom_id") == F.col("sid"), "left"))
    return (j.groupBy("id", "name", "created_by")
            .agg(F.count("symptom_id").alias("symptoms_count"),
                 F.transform(F.array_sort(F.collect_list(F.when(  # no entry for a disease without symptoms
                     F.col("sname").isNotNull(), F.struct(F.lower("sname").alias("k"), F.col("sname").alias("s"))))),
                             lambda e: e["s"]).alias("common_symptoms"))
            .select("id", "name", "created_by", "symptoms_count", "common_symptoms",
                    F.lit(0).cast("bigint").alias("count"), F.lit(0).alias("avg_age"))
            .orderBy(F.lower("name"), "id"))


def with_manual(merged: DataFrame, manual: DataFrame) -> DataFrame:
    """Add manual diseases on lower name; unite symptoms (cap 12); keep unmatched manual rows."""
    m = manual.select(F.lower(T.py_strip("name")).alias("key"), F.col("name").alias("mname"),
                      F.col("common_symptoms").alias("msyms")).filter(F.col("key") != "")
    d = merged.alias("d")
    j = d.join(m.alias("m"), F.col("d.key") == F.col("m.key"), "full_outer")
    empty_m = F.create_map().cast("map<string,bigint>")
    return j.select(
        F.coalesce("d.key", "m.key").alias("key"),
        F.coalesce("d.name", "m.mname").alias("name"),
        F.coalesce("d.n", F.lit(0)).alias("n"),
        F.when(F.col("d.key").isNull(), F.col("msyms"))
         .when(F.col("m.key").isNull(), F.col("d.common_symptoms"))
         .otherwise(_union_ci(F.col("d.common_symptoms"), F.col("msyms"))).alias("common_symptoms"),
        F.coalesce("d.avg_age", F.lit(0)).alias("avg_age"),
        F.coalesce("d.gender_distribution", empty_m).alias("gender_distribution"),
        F.coalesce("d.sources", F.array().cast("array<string>")).alias("sources"),
        F.col("m.key").isNotNull().alias("manual"),
    )


def flag_new_for_model(df: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Lower name not among known classes, only when known is not empty."""
    known = K.KNOWN_DISEASE_CLASSES if known is None else known
    low = [k.strip().lower() for k in known]
    flag = F.lit(False) if not low else ~F.lower(T.py_strip("name")).isin(*low)
    return df.withColumn("new_for_model", flag & (F.lower(T.py_strip("name")) != ""))


def catalogue(df: DataFrame) -> DataFrame:
    """By count descending, then name."""
    return df.orderBy(F.desc("n"), F.asc("name"))


def new_diagnoses(raw: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Distinct trimmed diagnoses not among the known classes, sorted."""
    known = K.KNOWN_DISEASE_CLASSES if known is None else known
    d = raw.select(T.py_strip(raw_text("diagnosis")).alias("diagnosis")).filter(F.col("diagnosis") != "").distinct()
    if known:
        d = d.filter(~F.col("diagnosis").isin(*[k.strip() for k in known]))
    return d.orderBy("diagnosis")


def symptom_bank(saved: DataFrame, merged: DataFrame) -> DataFrame:
    """U01 + W06: saved terms first, then profile terms not saved (no case); sorted.

    Saved names keyed by lower form keep one spelling (the greatest, as a
    deterministic pick among equal keys); profile terms are already lower case.
    """
    sv = saved.groupBy(F.lower(T.py_strip("name")).alias("key")).agg(F.max(T.py_strip("name")).alias("symptom"))
    prof = (merged.select(F.explode("common_symptoms").alias("t"))
            .select(T.py_strip("t").alias("t")).filter(F.col("t") != "")
            .groupBy(F.lower("t").alias("key")).agg(F.min("t").alias("symptom")))
    extra = prof.join(sv.select("key"), "key", "left_anti")
    return sv.unionByName(extra).select("symptom").orderBy(F.lower("symptom"), "symptom")


def flat_catalogue(df: DataFrame) -> DataFrame:
    cols = df.columns
    out = [F.col("name"), F.col("n"), F.col("avg_age"),
           F.array_join("common_symptoms", ", ").alias("common_symptoms"),
           F.array_join(F.transform(F.array_sort(F.map_entries("gender_distribution")),
                                    lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ";").alias("genders"),
           F.array_join("sources", ",").alias("sources")]
    for c in ("manual", "new_for_model"):
        if c in cols:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------- upserts
def upserts_from(raw: DataFrame) -> DataFrame:
    """Staff edits derived from encounters: (seq, name, symptoms) in seq order."""
    nm = T.collapse_blanks(T.py_strip("diagnosis"))
    return (raw.filter(F.col("diagnosis").isNotNull())
            .select(F.col("encounter_id").alias("seq"), nm.alias("name"),
                    T.split_items(F.coalesce("symptoms", F.lit(""))).alias("symptoms"))
            .filter(F.col("name") != ""))


def upsert_manual(diseases: DataFrame, symptoms: DataFrame, links: DataFrame, ups: DataFrame, editor: str = "staff"):
    """J11 as one batch merge; returns new (diseases, symptoms, links) versions.

    Edits apply in ``seq`` order: per lower name the last edit sets the name and
    replaces the symptom set; every edit adds its new terms once (first spelling).
    A stored disease keeps its id, creator and creation time, a stored symptom its
    id; new ones get a hash id, and new diseases ``editor`` as their creator. The edits
    are read several times: a written table.
    """
    from carelake.sources.records import hash_id
    now = F.current_timestamp()
    last = (ups.groupBy(F.lower("name").alias("key"))
            .agg(F.max_by(F.struct("name", "symptoms"), F.col("seq")).alias("e"))
            .select("key", F.col("e.name").alias("new_name"), F.col("e.symptoms").alias("items")))
    for c in ("created_at", "updated_at"):
        if c not in diseases.columns:
            diseases = diseases.withColumn(c, F.lit(None).cast("timestamp"))
    both = diseases.withColumn("key", F.lower("name")).join(last, "key", "full_outer")
    edited = F.col("new_name").isNotNull()
    new = F.col("id").isNull()
    both = both.select(
        F.when(new, hash_id("key")).otherwise(F.col("id")).alias("id"), F.coalesce("new_name", "name").alias("name"),
        F.when(new, F.lit(editor)).otherwise(F.col("created_by")).alias("created_by"),
        F.when(new, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(edited, now).otherwise(F.col("updated_at")).alias("updated_at"), edited.alias("edited"), "items")
    both = written(both, "upserted")   # one row a disease, read by the diseases and their links
    items = (ups.select("seq", F.posexplode("symptoms").alias("pos", "item"))
             .select("seq", "pos", T.normalize_term("item").alias("normalized"),
                     T.collapse_blanks(T.py_strip("item")).alias("spelling"))
             .filter(F.col("normalized") != ""))
    fresh = (items.groupBy("normalized").agg(F.min_by("spelling", F.struct("seq", "pos")).alias("name"))
             .join(symptoms.select("normalized"), "normalized", "left_anti")
             .select(hash_id("normalized").alias("id"), "name", "normalized"))
    new_s = symptoms.select("id", "name", "normalized").unionByName(fresh)
    gone = both.filter("edited").select(F.col("id").alias("disease_id"))
    terms = both.filter("edited").select(F.col("id").alias("disease_id"), F.explode("items").alias("item")) \
        .select("disease_id", T.normalize_term("item").alias("normalized"))
    new_l = links.select("disease_id", "symptom_id").join(gone, "disease_id", "left_anti").unionByName(
        terms.join(new_s.select("normalized", F.col("id").alias("symptom_id")), "normalized")
        .select("disease_id", "symptom_id")).distinct()
    return both.drop("edited", "items"), new_s, new_l
