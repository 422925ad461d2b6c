"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from casewise.plans import comparison

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view {t} as select * from '{path}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return int(v) if isinstance(v, bool) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", list(comparison.SQL))
def test_against_sql(spark, duck, name):
    df = comparison.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in names) for r in df.collect()]
    found = duck.execute(comparison.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = [tuple(norm(r[columns.index(c)]) for c in names) for r in found.fetchall()]
    assert len(got) == len(want)
    # a tie of round() may fall either way, so values are compared with a tolerance and sorted by what that leaves alike
    key = lambda r: tuple((v is None, f"{v:.3g}" if isinstance(v, float) else str(v)) for v in r)
    for mine, theirs in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(mine, theirs, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6), (mine, theirs)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
