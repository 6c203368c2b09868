"""Every registered query against its oracle SQL. SF_DIR picks the data (default the smallest)."""

import os

import pytest

from groundloom.plans import catalog
from groundloom.plans.verify import differences, duck

catalog.load()
FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert differences(got, want) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
