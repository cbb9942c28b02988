"""Tables that grow with the input are dealt out by key, and not sent whole through the driver."""

import pytest

from rasterloom.plans import registry


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange")


@pytest.mark.parametrize("name", ["m02_polygon_zones", "g09_traced_fibers", "j11_greedy_matching"])
def test_nothing_is_broadcast(spark, data, name):
    assert broadcasts(registry.QUERIES[name](spark, data)) == 0
