"""A sample of registered queries against their twin SQL at the smallest scale."""
import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["FLAGSHIP_value_by_season", "F6_devig_shin", "A5_bootstrap_roi", "A7_breakdowns", "B4_independent_sample", "W3_player_history",
         "W12_W18_staking_report", "X5_X6_boost_legs", "S7_bookmaker_payload", "L9_J13_pick_ledger"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, con, name):
    status, rows, *_, msg = compare(spark, con, SF, name, entry.queries(), entry.oracle_sql())
    assert status == "ok" and rows > 0, msg
