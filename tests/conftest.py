import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    from carelake.session import get_session
    s = get_session("local[4]", 4, app_name="carelake-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_equal(a_cols, a_rows, b_cols, b_rows, digits=6):
    def norm(v):
        if isinstance(v, float):
            return round(v, digits)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return v
    order_a = sorted(range(len(a_cols)), key=lambda i: a_cols[i])
    order_b = sorted(range(len(b_cols)), key=lambda i: b_cols[i])
    sa = sorted(repr(tuple(norm(r[i]) for i in order_a)) for r in a_rows)
    sb = sorted(repr(tuple(norm(r[i]) for i in order_b)) for r in b_rows)
    return sorted(a_cols) == sorted(b_cols) and sa == sb
