"""Every registered query of the library against its SQL twin, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from oracle import rows_of, twin
from veilframe.plans.oracles import ORACLES
from veilframe.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SLOW = {"tstr", "tstr_mlp", "tstr_rf", "pmse", "tstr_lr"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    df = QUERIES[name](spark, SF)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected_names, expected = twin(ORACLES[name], SF)
    assert names == expected_names
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
