import os

import pytest

from stateloom import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", ["frontier_step", "frontier_step_cross37", "frontier_step_cross49", "frontier_growth", "state_expand_batches", "forecast_balance"])
def test_no_hash_table_of_states(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate(keys=[state" not in plan
