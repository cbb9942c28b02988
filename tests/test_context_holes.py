"""A box without a value has no spread, in the bank as in the single statistics."""

from rasterloom.operators import neighbors as N


def test_no_value_no_spread(spark):
    px = spark.createDataFrame([(0, 0, x, None if x < 3 else float(x)) for x in range(6)], "img long, y int, x int, v double")
    found = {r.x: r for r in N.context_bank(px, ["v"]).collect()}
    assert found[0].v_sd_r1 is None and found[0].v_mean_r1 is None and found[0].v_sd_r3 == 0.0
    assert found[2].v_sd_r1 == 0.0 and found[4].v_sd_r1 is not None
