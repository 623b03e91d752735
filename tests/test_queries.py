"""Every registered analytics query against its SQL in another engine."""

import glob
import os

import duckdb
import pytest

from segrec import catalog


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame):
    """Columns, and rows in an order that small differences of numbers don't change."""
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    plain = [[v if isinstance(v, float) else int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v for v in r] for r in values]
    return columns, sorted(plain, key=lambda r: repr([v for v in r if not isinstance(v, float)] + [f"{v:.3g}" for v in r if isinstance(v, float)]))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, oracle, name):
    columns, rows = rows_of(catalog.QUERIES[name](spark, sf).toPandas())
    names, wanted = rows_of(oracle.execute(catalog.ORACLE_SQL[name]).df())
    assert columns == names and len(rows) == len(wanted)
    for row, want in zip(rows, wanted, strict=True):
        assert row == [pytest.approx(v, rel=1e-6, abs=1.1e-6) if isinstance(v, float) else v for v in want]


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert sql.keys() <= queries.keys() and catalog.QUERIES.keys() <= queries.keys()
    assert entry.entry(spark).limit(1).count() == 1


def test_popularity_plan_pushes_down(spark, sf):
    plan = catalog.QUERIES["a10_item_popularity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_linenumber,1)" in plan.split("PushedFilters", 1)[1]
    scan = next(x for x in plan.splitlines() if "l_linenumber" in x and "ReadSchema" in x)
    read = scan.split("ReadSchema", 1)[1]
    assert "l_tax" not in read and "l_extendedprice" not in read


def test_integrity_covers_all_tables(spark, sf):
    import hashlib

    rows = {r["file"]: (r["sha256"], r["bytes"]) for r in catalog.QUERIES["sk9_integrity"](spark, sf).collect()}
    want = {}
    for path in glob.glob(f"{sf}/**/*.parquet", recursive=True):
        if os.path.isfile(path):
            with open(path, "rb") as file:
                data = file.read()
            want[os.path.relpath(path, sf)] = (hashlib.sha256(data).hexdigest(), len(data))
    assert len(want) > 1 and want.items() <= rows.items()
