"""Helpers: trie regex, constant frames, file row numbers, list parsing."""

import os
import re
import tempfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.sources import files as FS

KEYS = [k for k, _ in K.symptom_map_by_length()]
RX = re.compile(T.trie_regex(KEYS))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeiloprstuz '", max_size=30))
def test_trie_regex_equals_any_substring(s):
    assert bool(RX.search(s)) == any(k in s for k in KEYS)


def test_const_frame_has_rows_and_types(spark):
    df = T.const_frame(spark, [(1, "a"), (2, "b")], "id long, v string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert df.schema.simpleString() == "struct<id:bigint,v:string>"


def test_file_row_numbers(spark):
    d = tempfile.mkdtemp(prefix="w05-", dir="/tmp")
    for name, n in (("a.csv", 7), ("b.csv", 3)):
        with open(os.path.join(d, name), "w") as f:
            f.write("Age,Gender,Symptoms,Diagnosis\n")
            for i in range(n):
                f.write(f"{i},M,cough,Asthma\n")
    df = FS.with_row_number(FS.read_encounters_csv(spark, d, canonical=False))
    got = sorted((int(r["Age"]), r["row_no"]) for r in df.collect())
    # Ages 0..n-1 are written in file order, so row_no = age + 1 in each file.
    assert all(rn == age + 1 for age, rn in got)
    assert len(got) == 10


def test_symptom_list_parse_first_spelling(spark):
    df = spark.createDataFrame([("Fever,  fever , Dry   Cough,, COUGH",)], "v string")
    assert df.select(F.array_join(T.parse_symptom_list("v"), "|")).first()[0] == "Fever|Dry Cough|COUGH"
