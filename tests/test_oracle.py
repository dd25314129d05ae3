"""Every registered query on the smallest tables, beside its SQL twin where there is one."""

import os

import pytest

import __spark_entry__ as entry
from tests import check_oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, name):
    ok, note = check_oracle.compare(spark, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note
