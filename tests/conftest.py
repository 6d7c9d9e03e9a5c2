"""The session of all tests, and a comparison with DuckDB."""

from __future__ import annotations

import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from chunkwright.plans.session import local_session, with_package

    s = local_session(4, "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield with_package(s)
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="session")
def folder():
    return DATA


def plain(v):
    """A value as text that is the same for both engines."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def agree(spark, duck, folder):
    def check(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        found = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
        rel = duck.sql(sql)
        assert sorted(rel.columns) == names
        wanted = sorted(tuple(plain(v) for v in r) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
        assert found == wanted

    return check
