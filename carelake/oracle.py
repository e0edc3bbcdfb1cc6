"""DuckDB SQL twins of the Spark operators, for the value oracle.

The oracle sees only the driver's base tables, so every query inlines the
fixture and the clean and transform stages as CTEs. Expressions are
generated from the same fixed values as the Spark code.
"""

from __future__ import annotations

from carelake.functions import constants as K
from carelake.sources.fixture import fixture_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# ----------------------------------------------------------- expressions
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


def normalize_symptoms(x: str) -> str:
    s = collapse(strip(f"lower({x})"))
    s = f"regexp_replace({s}, ',\\s*', ', ', 'g')"
    return f"regexp_replace({s}, '^[ ,]+|[ ,]+$', '', 'g')"


def renormalize(x: str) -> str:
    return collapse(strip(f"lower({x})"))


def normalize_term(x: str) -> str:
    return strip(collapse(f"lower({x})"))


def title_case(x: str) -> str:
    chars = f"string_split(lower({x}), '')"
    return (f"array_to_string(list_transform({chars}, lambda ch, i: CASE WHEN i = 1 OR NOT "
            f"regexp_full_match({chars}[i - 1], '\\p{{L}}') THEN upper(ch) ELSE ch END), '')")


def normalize_gender(x: str) -> str:
    t = title_case(strip(x))
    m = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.GENDER_REPLACE.items())
    return f"(CASE {t} {m} ELSE {t} END)"


def numeric_value(x: str) -> str:
    pat = "^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"
    d = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return f"(CASE WHEN regexp_full_match({x}, '{pat}') AND NOT isinf({d}) THEN {d} END)"


def integer_value(x: str) -> str:
    pat = "^\\s*[+-]?\\d(_?\\d)*\\s*$"
    return f"(CASE WHEN regexp_full_match({x}, '{pat}') THEN TRY_CAST(replace(trim({x}), '_', '') AS BIGINT) END)"


def split_items(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda t: trim(t)), lambda t: t <> '')"


def translate(x: str) -> str:
    keys = ", ".join("{'k': %s, 'v': %s}" % (q(k), q(v)) for k, v in K.symptom_map_by_length())
    exact = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.symptom_map_unique())
    item = (f"coalesce(CASE lower(it) {exact} END, "
            f"(list_filter([{keys}], lambda e: contains(lower(it), e.k)))[1].v, it)")
    return f"array_to_string(list_transform({split_items(x)}, lambda it: {item}), ', ')"


def age_bin(a: str) -> str:
    parts = " ".join(f"WHEN {a} < {u} THEN {q(lbl)}" for lbl, u in K.AGE_BINS if u is not None)
    return f"(CASE {parts} ELSE {q(K.AGE_BINS[-1][0])} END)"


def keyword_zone(d: str) -> str:
    name = f"lower({strip(d)})"
    whens = []
    for words, zone in K.KEYWORD_ZONES:
        hit = " OR ".join(f"contains({name}, {q(w)})" for w in words)
        whens.append(f"WHEN {hit} THEN {q(zone)}")
    return f"(CASE WHEN {name} = '' THEN NULL {' '.join(whens)} END)"


def mapped(d: str, which: int) -> str:
    whens = " ".join(f"WHEN {q(row[0])} THEN {q(row[which])}" for row in K.DIAGNOSIS_ASSIGNMENTS)
    return f"(CASE {d} {whens} END)"


def assign_risk(d: str, a: str, s: str) -> str:
    return (f"(CASE WHEN {d} IN ({', '.join(q(x) for x in K.HIGH_RISK_DIAGNOSES)}) OR {s} > 21 OR {a} >= 75 THEN 'High' "
            f"WHEN {d} IN ({', '.join(q(x) for x in K.MEDIUM_RISK_DIAGNOSES)}) OR {s} > 10 OR {a} >= 60 THEN 'Medium' "
            f"ELSE 'Low' END)")


# ------------------------------------------------------------------ CTEs
def clean_ctes() -> str:
    """fixture -> staged (distinct rows, reason) -> clean -> xf (transformed)."""
    age_d = numeric_value("age_raw")
    sym = normalize_symptoms("symptoms")
    reason = (
        "CASE WHEN age_raw IS NULL OR gender IS NULL OR symptoms IS NULL OR diagnosis IS NULL THEN 'missing_critical' "
        f"WHEN {age_d} IS NULL THEN 'invalid_age' "
        f"WHEN {age_d} <= -1 OR {age_d} >= 121 THEN 'age_outliers' "
        f"WHEN {sym} = '' THEN 'empty_symptoms' "
        f"WHEN {strip('diagnosis')} = '' THEN 'empty_text' END"
    )
    return f"""{fixture_sql()},
dedup AS (SELECT encounter_id, patient_id, age_raw, gender, symptoms, diagnosis, date_of_admission, discharge_date,
  count(*) AS copies FROM encounters_raw GROUP BY ALL),
staged AS (SELECT encounter_id, patient_id, date_of_admission, discharge_date, age_raw,
  CASE WHEN ({reason}) IS NULL THEN CAST(trunc({age_d}) AS INTEGER) END AS age,
  {normalize_gender('gender')} AS gender, {sym} AS symptoms, {strip('diagnosis')} AS diagnosis,
  copies, ({reason}) AS reject_reason, symptoms AS symptoms_raw FROM dedup),
clean AS (SELECT encounter_id, patient_id, date_of_admission, discharge_date, age_raw, age, gender, symptoms,
  diagnosis, symptoms_raw FROM staged WHERE reject_reason IS NULL),
xf AS (SELECT *, CAST(CASE lower(gender) WHEN 'male' THEN 0 WHEN 'female' THEN 1 ELSE 2 END AS INTEGER) AS gender_enc,
  {age_bin('age')} AS age_bin, {renormalize(translate('symptoms'))} AS symptoms_en FROM clean),
xfc AS (SELECT *, len(string_split(symptoms_en, ',')) AS symptoms_count FROM xf)"""


def with_clean(select: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {clean_ctes()}{extra}\n{select}"


def with_fixture(select: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {fixture_sql()}{extra}\n{select}"
