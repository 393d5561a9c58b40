"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module
from splitlane.plans import queries as library

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")

QUERIES = library.QUERIES
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(result, duck, ORACLES[name]) is None
    else:
        assert result.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 265


def test_results_do_not_depend_on_the_time_zone(spark, duck):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        result = QUERIES["scan_start"](spark, SF_DIR)
        assert difference(result, duck, ORACLES["scan_start"]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
