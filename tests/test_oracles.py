"""Every registered query with SQL gives the same rows as DuckDB on the test tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tallyloom.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
# Python draws, iterative or approximate results, file listings
WITHOUT_SQL = {
    "file_inventory", "distinct_keys_approx", "nearest_rank_sketch", "train_weighted", "vector_mixup",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def table(rows, names, order):
    place = [names.index(c) for c in order]
    out = [tuple(plain(r[i]) for i in place) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert table(found.collect(), found.columns, columns) == table(cursor.fetchall(), names, columns)


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["trigger", "breached"]
