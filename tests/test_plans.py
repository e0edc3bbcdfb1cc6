"""Plan shapes that the scale design relies on (read from explain())."""

import contextlib
import io

import __spark_entry__ as E


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_flagship_prunes_columns_and_broadcasts_roster(spark, sf_dir):
    p = plan(E.queries()["a06_age_by_diagnosis_assigned"](spark, sf_dir))
    # Only the needed columns reach the scans.
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in p
    # The roster (a constant table) is broadcast by the planner's own size check.
    assert "BroadcastHashJoin LeftOuter BuildRight" in p
    assert "SortMergeJoin" not in p


def test_top_symptoms_has_no_inferred_generator_filter(spark, sf_dir):
    p = plan(E.queries()["a07_top_symptoms"](spark, sf_dir))
    # An inferred size(...) > 0 filter would re-run the translation chain
    # (the optimizer may turn explode_outer + null filter back into explode).
    assert "size(filter(" not in p
    assert "Generate" in p


def test_pairs_are_partially_aggregated(spark, sf_dir):
    p = plan(E.queries()["a08_symptom_pairs"](spark, sf_dir))
    assert p.count("HashAggregate") >= 2   # partial + final around the shuffle
    assert "TakeOrderedAndProject" in p
