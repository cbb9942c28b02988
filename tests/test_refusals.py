"""Refused states of a shuffle: found in passes by few candidates, as one after another has them."""

import numpy as np
import pytest

from rasterloom.operators import draws as D


def plain(n, seed):
    state, at, found = (seed ^ D.MULTIPLIER) & D.MASK, 0, []
    for bound in range(n, 1, -1):
        while True:
            state = (state * D.MULTIPLIER + D.INCREMENT) & D.MASK
            u = state >> 17
            at += 1
            if not bound & (bound - 1) or u - u % bound + bound - 1 < 1 << 31:
                break
            found.append(at - 1)
    return found


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_refusals(spark, most):
    n = 700_000
    expected = plain(n, 42)
    assert len(expected) > 50 and D.refusals(spark, n, 42, most=most).tolist() == expected


def test_jobs_do_not_grow_with_refusals(spark):
    n, tracker = 700_000, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("swaps", "swaps of a shuffle")
    found = D.swaps(spark, n, 42)
    assert len(tracker.getJobIdsForGroup("swaps")) < 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = found.toPandas().sort_values("i", ascending=False)
    assert (rows["i"].to_numpy() == np.arange(n, 1, -1)).all() and ((0 <= rows["j"]) & (rows["j"] < rows["i"])).all()
