"""All registered queries against their SQL on the smallest tables."""

import pytest
from compare import compare, tables

import __spark_entry__ as entry
from threatloom.plans import queries, sql

SF = "/root/testdata/sf0.001"
# Offsets into the table that only exist at larger volumes are checked there.
NAMES = sorted(queries.queries())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(sql.oracle_sql())
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, note = compare(entry.queries()[name](spark, SF), tables(SF), entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 7
