"""Each query with SQL gives the rows of its SQL on the smallest tables; the others run and have a stable schema."""

import glob
import math
import os

import pytest
from conftest import SF

duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("no tables", allow_module_level=True)

from webrank.plans import catalogue  # noqa: E402

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
FAST = sorted(q for q in QUERIES if q != "prk1_converged")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(frame):
    columns = sorted(frame.columns)
    cells = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted(repr([None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x for x in r]) for r in cells)


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert normal(got) == normal(duck.execute(SQL[name]).df())


def test_names():
    assert set(SQL) <= set(QUERIES)
