"""Every registered query of the core against its SQL in DuckDB, at the smallest scale."""

import decimal
import os

import duckdb
import pytest

from cladeframe.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    """Rows as tuples that both engines agree on: whole and decimal numbers as floats of ten digits, in any order of rows."""

    def cell(x):
        if x is None or isinstance(x, (bool, str, bytes)):
            return x
        if isinstance(x, (list, tuple)):
            return tuple(map(cell, x))
        if isinstance(x, (int, float, decimal.Decimal)):
            return None if x != x else float(f"{float(x):.10g}") + 0.0
        return x

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    ours = plain(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    theirs = plain(duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-7, abs=1e-9) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """No SQL: the query gives the same columns and rows twice, and some rows."""
    rows = [sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]
