"""Predictions go by a batch at a time, whatever the number of a model's rows."""

import numpy as np

from rasterloom.operators import boosting as G


def test_no_group_of_rows_is_held_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.random(6000)
    rows = spark.createDataFrame([(i, float(v), int(v > 0.5), i % 2) for i, v in enumerate(x)], "row long, f double, y long, fold long")
    fitted = G.models(rows, ["f"], ["fold"], rounds=3, leaves=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = G.predicted(fitted, rows, ["f"], ["fold"], ["row", "y"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.row: (r.fold, r.y, r.pred) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "CoGroups" not in plan
    assert len(got) == 6000 and all(got[i][:2] == (i % 2, int(v > 0.5)) for i, v in enumerate(x))
    assert np.mean([p == y for _, y, p in got.values()]) > 0.99
