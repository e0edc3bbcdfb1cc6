"""Column expressions for clinical text and scalar rules.

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions`` only, so all of it runs JVM-side inside the
generated code of the stage; there is no Python UDF on this path.

Regexes use ``(?U)`` so that ``\\s`` matches Unicode blanks as Python does.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions import constants as K

# Python's float() grammar for finite decimal numbers (pandas to_numeric).
NUMERIC_RE = r"^(?U)\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Python's int() grammar for base-10 text (underscores between digits allowed).
INTEGER_RE = r"^(?U)\s*[+-]?\d(_?\d)*\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------ constant tables
def const_frame(spark, rows: list[tuple], schema: str):
    """A small constant table as ``inline(array(struct...))`` over one row.

    Unlike a frame built from a Python list (an RDD scan of unknown size), its
    size is known to the planner, which then broadcasts it by its own check.
    """
    from pyspark.sql import types as TT
    st = TT._parse_datatype_string(schema) if not isinstance(schema, TT.StructType) else schema
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]) for r in rows]
    if not structs:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    return spark.range(1).select(F.inline(F.array(*structs)))


# ---------------------------------------------------------------- strings
def py_strip(x) -> Column:
    """``str.strip()``: remove Unicode blanks at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def strip_chars(x, chars: str) -> Column:
    """``str.strip(chars)`` for a set of literal characters."""
    cls = "".join("\\" + ch if ch in r"\^]-[" else ch for ch in chars)
    return F.regexp_replace(_c(x), f"^[{cls}]+|[{cls}]+$", "")


def collapse_blanks(x) -> Column:
    """Runs of Unicode blanks become one space."""
    return F.regexp_replace(_c(x), r"(?U)\s+", " ")


def normalize_term(x) -> Column:
    """``' '.join(x.strip().lower().split())``."""
    return py_strip(collapse_blanks(F.lower(_c(x))))


def normalize_symptoms(x) -> Column:
    """P10: lower, strip, collapse blanks, ``', '`` after commas, strip blanks and commas."""
    s = py_strip(F.lower(_c(x)))
    s = collapse_blanks(s)
    s = F.regexp_replace(s, r"(?U),\s*", ", ")
    return strip_chars(s, " ,")


def renormalize_translated(x) -> Column:
    """Lower, strip, collapse blanks."""
    return collapse_blanks(py_strip(F.lower(_c(x))))


def title_case(x) -> Column:
    """``str.title()``: a letter after a non-letter is upper case, other letters lower.

    Each character is paired with the one before it (a shifted copy of the
    character list), so the list is built once per value.
    """
    def pairs(chars):
        prev = F.concat(F.array(F.lit("")), F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))))
        return F.arrays_zip(chars.alias("c"), prev.alias("p"))
    body = lambda chars: F.array_join(F.transform(
        pairs(chars), lambda e: F.when(~F.regexp_like(e["p"], F.lit(r"\p{L}")), F.upper(e["c"])).otherwise(e["c"])), "")
    return let(F.split(F.lower(_c(x)), ""), body)


def symptom_count(x) -> Column:
    """Number of commas plus one (empty items count)."""
    return F.size(F.split(_c(x), ",", -1))


def split_items(x) -> Column:
    """Comma items, stripped, blanks dropped (keeps case and repeats)."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda t: py_strip(t)), lambda t: t != "")


def parse_symptom_list(x) -> Column:
    """Split on commas, collapse blanks, drop blanks; first spelling of a lower-case key wins."""
    items = F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","),
                                 lambda t: py_strip(collapse_blanks(t))), lambda t: t != "")
    lows = F.transform(items, lambda t: F.lower(t))
    return F.filter(items, lambda t, i: F.array_position(lows, F.lower(t)) == i + 1)


# ------------------------------------------------------------- look-ups
BUCKETS = 64


def literal_maps(entries: dict, value_type: str) -> Callable[[Column], Column]:
    """A look-up of text keys in a constant table: ``f(key)`` is the value, or null.

    A map column is searched entry by entry, so the table is cut into small maps by a cheap
    property of the key. It is one literal for the plan, whatever the number of entries.
    """
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        maps[(ord(key[0]) + 7 * len(key) if key else 0) % BUCKETS][key] = value
    table = F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), f"array<map<string,{value_type}>>")
    return lambda key: F.try_element_at(F.get(table, (F.ascii(key) + 7 * F.length(key)) % BUCKETS), key)


# ------------------------------------------------------------ translation

def _symptom_keys_by_length() -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in K.symptom_map_by_length()
    ])


def trie_regex(words: list[str]) -> str:
    """One regex matching any of ``words``, with shared prefixes factored.

    A flat alternation tries every word at every position; the factored form
    follows one branch per character, so the scan is close to linear.
    """
    import re
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        alts = [re.escape(ch) + emit(sub) for ch, sub in sorted(node.items()) if ch != ""]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        return ("(?:" + body + ")?") if end else body
    return emit(trie)


def _any_key_regex() -> str:
    return trie_regex([k for k, _ in K.symptom_map_by_length()])


def translate_item(item: Column) -> Column:
    """P13 for one stripped item: longest dictionary key contained in it wins.

    An exact key match is the longest possible hit, so the map lookup answers
    most items; an item no key occurs in is rejected by one compiled regex;
    only the rest scan the length-ordered key list.
    """
    low = F.lower(item)
    keys = _symptom_keys_by_length()
    scanned = F.when(F.regexp_like(low, F.lit(_any_key_regex())),
                     F.get(F.filter(keys, lambda e: F.contains(low, e["k"])), 0)["v"])
    return F.coalesce(literal_maps(dict(K.symptom_map_unique()), "string")(low), scanned, item)


def translate_symptoms(x) -> Column:
    """Translate every non-blank comma item; join with ``', '``."""
    return F.array_join(F.transform(split_items(x), translate_item), ", ")


# ----------------------------------------------------------------- ages
def is_numeric_text(x) -> Column:
    return F.coalesce(F.regexp_like(_c(x), F.lit(NUMERIC_RE)), F.lit(False))


def numeric_value(x) -> Column:
    """Number or null (finite only); pandas ``to_numeric(errors='coerce')``.

    The grammar check already excludes nan and inf spellings; only overflow
    to infinity (e.g. 1e400) remains, which the cast-back test rejects.
    """
    d = F.when(is_numeric_text(x), py_strip(x).try_cast("double"))
    # Plain expressions: whole-stage codegen evaluates the repeated ``d`` once.
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def is_integer_text(x) -> Column:
    return F.coalesce(F.regexp_like(_c(x), F.lit(INTEGER_RE)), F.lit(False))


def integer_value(x) -> Column:
    """Python ``int(text)`` or null; used by the raw-row analytics."""
    t = F.regexp_replace(py_strip(x), "_", "")
    return F.when(is_integer_text(x), t.try_cast("long"))


def age_bin(age) -> Column:
    """P09."""
    a = _c(age)
    expr = None
    for label, upper in K.AGE_BINS:
        if upper is None:
            expr = expr.otherwise(F.lit(label))
        elif expr is None:
            expr = F.when(a < upper, F.lit(label))
        else:
            expr = expr.when(a < upper, F.lit(label))
    return expr


# --------------------------------------------------------------- gender
def normalize_gender(x) -> Column:
    """Strip, title case, replace whole spellings (one lookup in a map of
    spellings to themselves plus the replacements)."""
    t = title_case(py_strip(x))
    m = F.create_map(*[F.lit(v) for kv in K.GENDER_REPLACE.items() for v in kv])
    return let(t, lambda v: F.coalesce(F.try_element_at(m, v), v))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Python builds expression trees, so a sub-expression used twice would be
    computed twice; binding it through a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def gender_code_etl(x) -> Column:
    """Male 0, female 1, else 2."""
    g = F.lower(_c(x))
    return F.when(g == "male", 0).when(g == "female", 1).otherwise(2).cast("int")


def gender_code_train(x) -> Column:
    """P08 (training): exact ``Male`` 1, ``Female`` 0, else 2."""
    g = _c(x)
    return F.when(g == "Male", 1).when(g == "Female", 0).otherwise(2).cast("int")


def gender_code_score(x) -> Column:
    """P08 (scoring): folded ``male`` 1, ``female`` 0, else 2."""
    g = py_strip(F.lower(_c(x)))
    return F.when(g == "male", 1).when(g == "female", 0).otherwise(2).cast("int")


# --------------------------------------------------------------- zones
def keyword_zone(diagnosis) -> Column:
    """P25: first ordered keyword group with a substring hit; null if none or blank."""
    def zone_of(name: Column) -> Column:
        expr = None
        for words, zone in K.KEYWORD_ZONES:
            hit = None
            for w in words:
                h = F.contains(name, F.lit(w))
                hit = h if hit is None else (hit | h)
            expr = F.when(hit, F.lit(zone)) if expr is None else expr.when(hit, F.lit(zone))
        return F.when(name != "", expr)
    return let(F.lower(py_strip(diagnosis)), zone_of)


def mapped_zone(diagnosis) -> Column:
    m = F.create_map(*[F.lit(v) for d, z, _ in K.DIAGNOSIS_ASSIGNMENTS for v in (d, z)])
    return F.try_element_at(m, _c(diagnosis))


def mapped_doctor(diagnosis) -> Column:
    m = F.create_map(*[F.lit(v) for d, _, doc in K.DIAGNOSIS_ASSIGNMENTS for v in (d, doc)])
    return F.try_element_at(m, _c(diagnosis))


# ----------------------------------------------------------------- risk
def assign_risk(diagnosis, age, days) -> Column:
    """High, Medium or Low from diagnosis, age and stay length."""
    d, a, s = _c(diagnosis), _c(age), _c(days)
    return (
        F.when(d.isin(*K.HIGH_RISK_DIAGNOSES) | (s > 21) | (a >= 75), "High")
        .when(d.isin(*K.MEDIUM_RISK_DIAGNOSES) | (s > 10) | (a >= 60), "Medium")
        .otherwise("Low")
    )


def stay_days(admission, discharge) -> Column:
    """Day difference of two dates given as text or date; bad or missing is 0."""
    def as_date(c):
        c = _c(c)
        return F.coalesce(F.try_to_date(c.cast("string")), F.lit(None).cast("date"))
    return F.coalesce(F.datediff(as_date(discharge), as_date(admission)), F.lit(0)).cast("int")


def recommendations(level) -> Column:
    """Recommendation list for a risk level (empty for others)."""
    m = F.create_map(*[
        v for lvl, recs in K.RISK_RECOMMENDATIONS.items()
        for v in (F.lit(lvl), F.array(*[F.lit(r) for r in recs]))
    ])
    return F.coalesce(F.try_element_at(m, _c(level)), F.array().cast("array<string>"))


# ------------------------------------------------------ files and paths
def leaf_name(path) -> Column:
    """Backslash to slash, last part, at most 240 characters."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    leaf = F.regexp_extract(p, r"([^/]*)$", 1)
    leaf = F.when(py_strip(_c(path)) == "", F.lit("")).otherwise(leaf)
    return F.substring(leaf, 1, K.LEAF_NAME_MAX)


def extension(name) -> Column:
    """Lower-case suffix with the dot, as ``Path(name).suffix``; '' if none."""
    n = _c(name)
    return F.lower(F.regexp_extract(n, r"[^.](\.[^./]+)$", 1))


def study_category(raw) -> Column:
    """Synonyms to general or dental; blank is general; other is null."""
    v = F.lower(py_strip(F.coalesce(_c(raw), F.lit(""))))
    return (
        F.when(v.isin(*K.DENTAL_SYNONYMS), "dental")
        .when(v.isin(*K.GENERAL_SYNONYMS) | (v == ""), "general")
    )
