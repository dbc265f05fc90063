"""Every registered query against the same query in DuckDB."""

import pytest
from check_oracles import compare, database

from __spark_entry__ import entry, oracle_sql
from plantlytics.plans.oracles import ORACLES
from plantlytics.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert compare(spark, db, SF, name) == ""


def test_entry(spark):
    assert entry(spark).first().total_records == 1000
