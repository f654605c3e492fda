from __future__ import annotations

import pytest

import __spark_entry__ as E
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
# One query per operator family here; check_oracles.py runs all of them.
NAMES = ["clean_readings", "source_signature", "features_all", "next_critical", "calibrate_local", "forest_score_fixed", "debounce", "monitor_flat"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, name, SF)
    assert ok, note


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())
