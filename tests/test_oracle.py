"""Every registered query with a SQL twin equals DuckDB at sf0.001."""

import pytest

import __spark_entry__ as E
from tests.conftest import rows_equal

SQLS = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_duckdb(spark, sf_dir, duck, name):
    sdf = QUERIES[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(SQLS[name])
    assert rows_equal(sdf.columns, srows, list(rel.columns), rel.fetchall()), name


def test_every_sql_has_query():
    assert set(SQLS) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["diagnosis", "avg_age", "min_age", "max_age", "n", "hospital_zone", "specialist_doctor"]
    assert df.count() > 0
