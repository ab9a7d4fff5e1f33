"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallyframe.plans import catalog_copies, catalog_files, catalog_graphs, catalog_programs, catalog_rows, catalog_vault, catalog_wide  # noqa: F401  add their queries
from tallyframe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_float_bytes(spark):
    assert all(r.same for r in QUERIES["float_roundtrip"](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0


def test_call_graph_finds_calls_once(spark):
    """Three tables come from the calls, which are searched for in the sources once."""
    out = QUERIES["call_graph_suppliers"](spark, SF)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["call_parameters_suppliers", "arith_risk_suppliers"])
def test_broadcasts_nothing(spark, name):
    """A portfolio's parameters and variables meet its arguments and operands in a shuffle; none of them goes through the driver."""
    out = QUERIES[name](spark, SF)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
