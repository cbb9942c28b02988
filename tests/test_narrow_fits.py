"""A fit's rows stream to its task, where they are kept narrow."""

import pickle
import tracemalloc

import numpy as np

from rasterloom.operators import boosting as G


def test_fits_of_streamed_rows_are_those_of_the_whole_table(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(3000), rng.integers(0, 3, 3000)
    rows = spark.createDataFrame([(i, float(v) if i % 7 else None, int(c), i % 3) for i, (v, c) in enumerate(zip(x, y))], "row long, f double, y long, fold long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        found = G.models(rows, ["f"], ["fold"], rounds=3, leaves=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r.fold: pickle.loads(r.model) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan and sorted(got) == [0, 1, 2]
    x[::7] = np.nan
    for k, model in got.items():
        whole = G.fit(x[k::3][:, None], y[k::3], rounds=3, leaves=4)
        assert (G.probabilities(model, x[:, None]) == G.probabilities(whole, x[:, None])).all()


def test_a_fit_takes_few_bytes_a_row():
    rng = np.random.default_rng(6)
    x, y = rng.random((300_000, 3)), rng.integers(0, 5, 300_000)
    tracemalloc.start()
    G.fit((c.copy() for c in x.T), y, rounds=1, leaves=4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 * len(y)
