"""Every query against its SQL in DuckDB, and those without SQL against what must hold."""

import math

import duckdb
import pytest

from plumbline.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    ref = duck.sql(catalogue.oracle_sql()[name])
    want = rows(ref.columns, ref.fetchall())
    assert sorted(df.columns) == sorted(ref.columns)
    bad = [(g, w) for g, w in zip(got, want) if not close(g, w)]
    assert len(got) == len(want) and not bad, (len(got), len(want), bad[:3])
    assert got
    assert not [t for t in map(str, ref.types) if t.startswith(("DECIMAL", "HUGEINT"))], ref.types
