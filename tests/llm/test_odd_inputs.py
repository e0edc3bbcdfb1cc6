"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every query and stage."""

import pytest

from carelake.llm.queries import QUERIES
from corpus_pipeline import STAGES

BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "short")]
LABELS = [(5, 1, 1), (6, 1, 0), (7, 0, 0), (None, 1, 1), (8, 0, None), (8, 1, 0)]
CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, ""), (None, 0, "user", "x")]
VECTORS = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, None, 1), (3, [1.0, None] * 4, 1), (4, [float("nan")] * 8, 1),
           (5, [float("inf")] * 8, None), (6, [], None), (None, [0.25] * 9, None), (7, [3e38] * 8, 2), (8, [-0.1] * 8, None)]


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("extra", [False, True])
def test_query_keeps_every_row(spark, tables, odd_rows, name, extra):
    path = tables(odd_rows, LABELS, BENCH, CHATS, extra, VECTORS)
    got = QUERIES[name][0](spark, path).collect()
    if name.startswith("op6_"):
        assert {r["conv_id"] for r in got} == {1, 2, None, -7}
    elif name.startswith("op11_"):
        assert [r["n_convs"] for r in got if r["depth"] == 0] == [2]
    elif name.startswith("op12_"):
        assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "6", "7", "8", "None"]
    elif not name.startswith("op3_"):
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_empty_tables(spark, tables, name):
    got = QUERIES[name][0](spark, tables([])).collect()
    assert len(got) == (1 if name.startswith("op6_") else 0)


@pytest.mark.parametrize("name,stage", STAGES)
def test_stage(spark, tables, make_docs, odd_rows, name, stage):
    path = tables(odd_rows, LABELS, BENCH, CHATS)
    docs = make_docs(odd_rows, extra=True)
    got = stage(spark, docs, path)
    assert got.collect() is not None
    if name != "shard":
        assert got.columns == docs.columns
    assert stage(spark, make_docs([]), tables_empty(spark, path)).collect() == []


def tables_empty(spark, path):
    return path
