"""Gap centers are found by tile; pixels are not sorted to be joined to themselves."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import arrays as A
from rasterloom.operators import features as X


def test_gap_centers_over_borders_of_tiles_without_a_sorted_join(spark):
    rng = np.random.default_rng(4)
    fiber, inside, here = rng.random((530, 24)) < 0.02, rng.random((530, 24)) < 0.9, np.ones((530, 24), bool)
    px = spark.createDataFrame([(3, y, x, bool(fiber[y, x]), bool(inside[y, x])) for y, x in np.argwhere(here).tolist()], "img long, y int, x int, f boolean, i boolean")
    found = X.gap_centers(px, F.col("f"), F.col("i"))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    width = A.gap_centers(fiber, inside)
    assert {(r.y, r.x): r.width for r in found.collect()} == {(y, x): width[y, x] for y, x in np.argwhere(width > 0).tolist()}
