"""Every query that has SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessaline import factor_queries as _factor_queries  # noqa: F401 - registers its queries
from tessaline import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: Left out here, if any.
SLOW: set[str] = set()


def rounded(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(rounded(x) for x in v)
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(q.SQL) - SLOW))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(rounded(x) for x in r) for r in got.select(*columns).collect()]
    found = duck.execute(q.SQL[name])
    at = [[c[0] for c in found.description].index(k) for k in columns]
    want = [tuple(rounded(r[k]) for k in at) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-7, abs=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_each_query_has_sql():
    assert set(q.QUERIES) == set(q.SQL)
