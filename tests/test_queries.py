"""Every registered query runs on the smallest tables, and agrees with its SQL where it has one."""

import oracle
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    _, msg = oracle.check(spark, con, DIR, name)
    assert msg in ("", "rows-only") or msg.startswith("near"), msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0
