"""Every query of the core that SQL can express, against that SQL on whole tables."""

import importlib

import pytest
from compare import connect, same

import __spark_entry__ as entry_module
from tallyard import plans

MODULES = [importlib.import_module(f"tallyard.plans.{m}") for m in plans.MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, con):
    same(QUERIES[name](spark, sf), con, SQL[name])


def test_every_statement_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.count() == 10 and "passes" in df.columns


@pytest.mark.parametrize("name", ["par05_lineups", "par06_singles", "sta02_clopper_pearson", "sta25_shuffle_floor", "sta37_gee", "sta38_crossed_effects", "tag04_claims", "ml2_logistic"])
def test_query_without_sql_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
