"""Every query with SQL gives the SQL's rows on the smallest test data."""

import pytest

import __spark_entry__ as entry
import parity
from sparkfactors import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return parity.connect(SF)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, duck, name):
    said = parity.compare(spark, duck, name, SF)
    assert ": ok" in said, said


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "i", "coherence"] and df.count() == 1


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
