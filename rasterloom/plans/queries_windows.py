"""Window queries: membership, counts, orientation, gates and the pooled feature bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources import bindings as B
from .registry import query
from .views import FPX, PX

GRID = {"window": 10, "stride": 5, "height": B.SIDE, "width": B.SIDE}
WIN = """win AS (SELECT * FROM unnest(range(9)) AS a(iy), unnest(range(9)) AS b(ix))"""
JOINED = "fpx JOIN win ON y >= iy * 5 AND y < iy * 5 + 10 AND x >= ix * 5 AND x < ix * 5 + 10"


@query("min_slice_window_orientation", f"""
WITH {FPX}, {WIN}, s AS (
  SELECT img, iy, ix, count(theta) AS n, sum(cos(2 * radians(theta))) AS c, sum(sin(2 * radians(theta))) AS s FROM {JOINED} GROUP BY ALL)
SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, n AS n_fiber_px, n >= 5 AS included, n::DOUBLE AS coverage_pct,
  CASE WHEN n >= 10 THEN round(((degrees(atan2(s, c)) / 2) % 180 + 180) % 180, 4) END AS mean_angle_deg,
  CASE WHEN n >= 10 THEN round(sqrt(c * c + s * s) / n, 6) END AS order_parameter FROM s""")
def window_orientation(spark, d):
    """Per-window fiber coverage and orientation, with the coverage gate: the core loop."""
    sums = W.window_sums(B.fiber_pixels(spark, d), W.axial_sums(F.col("theta")), **GRID)
    angle, order = W.axial_mean(least=W.least_pixels(10))
    found = W.gated(sums.withColumns({"mean_angle_deg": F.round(angle, 4), "order_parameter": F.round(order, 6)}),
                    F.round(F.col("n_valid") * 100.0 / 100, 6), 5.0, ["mean_angle_deg", "order_parameter"])
    return found.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.col("n_valid").alias("n_fiber_px"),
                        "included", "coverage_pct", "mean_angle_deg", "order_parameter")


@query("j01_pixel_window_join", f"""
WITH {FPX}, {WIN} SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, count(*) AS n_px, sum(g)::BIGINT AS gray_sum FROM {JOINED} GROUP BY ALL""")
def pixel_window_join(spark, d):
    sums = W.window_sums(B.pixels(spark, d), {"n_px": F.lit(1), "gray_sum": F.col("g")}, **GRID)
    return sums.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "n_px", "gray_sum")


@query("j02_clamped_window_join", f"""
WITH {PX}, win AS (SELECT * FROM unnest(range(7)) AS a(iy), unnest(range(7)) AS b(ix))
SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, count(*) AS n_px, (iy * 7 + 11 > 50 OR ix * 7 + 11 > 50) AS partial
FROM px JOIN win ON y >= iy * 7 AND y < iy * 7 + 11 AND x >= ix * 7 AND x < ix * 7 + 11 GROUP BY ALL""")
def clamped_window_join(spark, d):
    sums = W.window_sums(B.pixels(spark, d), {"n_px": F.lit(1)}, window=11, stride=7, height=50, width=50, partial=True)
    return sums.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "n_px", "partial")


@query("a01_window_mask_counts", f"""
WITH {FPX}, {WIN} SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, count_if(fiber)::BIGINT AS n_fiber, count_if(zone)::BIGINT AS n_zone
FROM {JOINED} GROUP BY ALL""")
def window_mask_counts(spark, d):
    sums = W.window_sums(B.fiber_pixels(spark, d), {"n_fiber": F.col("fiber").cast("long"), "n_zone": F.col("zone").cast("long")}, **GRID)
    return sums.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "n_fiber", "n_zone")


@query("a02_axial_window_mean", f"""
WITH {FPX}, {WIN}, s AS (
  SELECT img, iy, ix, count(theta) AS n, avg(cos(2 * radians(theta))) AS c, avg(sin(2 * radians(theta))) AS s FROM {JOINED} GROUP BY ALL)
SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, n AS n_valid, CASE WHEN n >= 10 THEN round(((degrees(0.5 * atan2(s, c))) % 180 + 180) % 180, 4) END AS angle,
  CASE WHEN n >= 10 THEN round(sqrt(c * c + s * s), 6) END AS order_parameter FROM s""")
def axial_window_mean(spark, d):
    angle, order = W.axial_mean(least=W.least_pixels(10))
    return (W.window_sums(B.fiber_pixels(spark, d), W.axial_sums(F.col("theta")), **GRID)
            .select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "n_valid",
                    F.round(angle, 4).alias("angle"), F.round(order, 6).alias("order_parameter")))


@query("a03_density_mask_region", f"""
WITH {FPX} SELECT img, round(count_if(fiber AND zone) / nullif(count_if(zone), 0)::DOUBLE, 6) AS hdm FROM fpx GROUP BY img""")
def density_mask_region(spark, d):
    return W.density_mask(B.fiber_pixels(spark, d), F.col("fiber"), F.col("zone")).select("img", F.round("hdm", 6).alias("hdm"))


@query("a03_density_mask_window", f"""
WITH {FPX}, {WIN} SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, round(count_if(fiber AND zone) / nullif(count_if(zone), 0)::DOUBLE, 6) AS hdm
FROM {JOINED} GROUP BY ALL""")
def density_mask_window(spark, d):
    sums = W.window_sums(B.fiber_pixels(spark, d), {"a": (F.col("fiber") & F.col("zone")).cast("long"), "b": F.col("zone").cast("long")}, **GRID)
    return sums.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.round(W.ratio(F.col("a"), F.col("b")), 6).alias("hdm"))


@query("a04_region_totals", f"""
WITH {FPX} SELECT img, count(*) AS n_region, count_if(fiber)::BIGINT AS n_fiber, count_if(zone)::BIGINT AS n_zone,
  count_if(fiber AND zone)::BIGINT AS n_fiber_in_zone, round(100.0 * count_if(fiber) / count(*), 6) AS coverage_pct,
  round(count_if(fiber) * 0.25::DOUBLE, 6) AS fiber_area_um2
FROM fpx WHERE y >= 5 AND y < 40 AND x >= 5 AND x < 50 GROUP BY img""")
def region_totals(spark, d):
    """Totals of an owned core, with areas at half a micron a pixel."""
    core = F.expr("y >= 5 AND y < 40 AND x >= 5 AND x < 50")
    return (B.fiber_pixels(spark, d).where(core).groupBy("img").agg(
        F.count("*").alias("n_region"), F.count_if("fiber").alias("n_fiber"), F.count_if("zone").alias("n_zone"),
        F.count_if(F.expr("fiber AND zone")).alias("n_fiber_in_zone"))
        .withColumn("coverage_pct", F.round(100.0 * F.col("n_fiber") / F.col("n_region"), 6))
        .withColumn("fiber_area_um2", F.round(F.col("n_fiber") * 0.25, 6)))


@query("p06_coverage_gate", f"""
WITH {FPX}, {WIN}, s AS (SELECT img, iy, ix, count_if(fiber)::BIGINT AS n, avg(g) AS m FROM {JOINED} GROUP BY ALL)
SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, n AS n_fiber_px, n >= 25 AS included, CASE WHEN n >= 25 THEN round(m, 6) END AS gray_mean FROM s""")
def coverage_gate(spark, d):
    sums = W.window_sums(B.fiber_pixels(spark, d), {"n": F.col("fiber").cast("long"), "g": F.col("g"), "a": F.lit(1)}, **GRID)
    found = W.gated(sums.withColumn("gray_mean", F.round(F.col("g") / F.col("a"), 6)), 100.0 * F.col("n") / 100, 25.0, ["gray_mean"])
    return found.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.col("n").alias("n_fiber_px"), "included", "gray_mean")


@query("w07_mask_box_fraction", f"""
WITH {FPX}, {WIN} SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, round(avg(fiber::INT), 6) AS fraction FROM {JOINED} GROUP BY ALL HAVING count(*) = 100""")
def mask_box_fraction(spark, d):
    found = W.box_fraction(B.fiber_pixels(spark, d), F.col("fiber"), **GRID)
    return found.select("img", F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.round("fraction", 6).alias("fraction"))


@query("w07_mask_centered_fraction", f"""
WITH {FPX}, c AS (SELECT k, least(k * 7 + 3, 49) AS at FROM unnest(range(8)) AS t(k))
SELECT img, cy.k::BIGINT AS gy, cx.k::BIGINT AS gx, round(avg(fiber::INT), 6) AS fraction
FROM fpx JOIN c cy ON y >= cy.at - 5 AND y < cy.at + 5 JOIN c cx ON x >= cx.at - 5 AND x < cx.at + 5 GROUP BY ALL""")
def mask_centered_fraction(spark, d):
    found = W.centered_fraction(B.fiber_pixels(spark, d), F.col("fiber"), window=10, step=7, height=50, width=50)
    return found.select("img", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), F.round("fraction", 6).alias("fraction"))


@query("f01_pooled_features", f"""
WITH {FPX}, win AS (SELECT * FROM unnest(range(7)) AS a(iy), unnest(range(7)) AS b(ix)),
s AS (SELECT img, iy, ix, count(*) AS area, count_if(fiber) AS n, count(theta) AS nv, sum(cos(2 * radians(theta))) AS c, sum(sin(2 * radians(theta))) AS s,
  sum(CASE WHEN fiber THEN g / 65535.0::DOUBLE END) AS gi, sum(CASE WHEN fiber THEN (g / 65535.0::DOUBLE) ** 2 END) AS gi2,
  sum(g / 65535.0::DOUBLE) AS ga, sum((g / 65535.0::DOUBLE) ** 2) AS ga2
  FROM fpx JOIN win ON y >= iy * 7 AND y < iy * 7 + 11 AND x >= ix * 7 AND x < ix * 7 + 11 GROUP BY ALL)
SELECT img, iy::BIGINT AS iy, ix::BIGINT AS ix, (iy * 7 + 11 > 50 OR ix * 7 + 11 > 50) AS partial, n::BIGINT AS n_fiber_px,
  round(n / area::DOUBLE, 6) AS coverage_fraction,
  CASE WHEN nv >= 12 THEN round(sqrt(c * c + s * s) / nv, 6) END AS order_parameter,
  CASE WHEN n > 0 THEN round(gi / n, 6) END AS intensity_mean, CASE WHEN n > 0 THEN round(sqrt(greatest(gi2 / n - (gi / n) ** 2, 0)), 5) END AS intensity_sd,
  round(ga / area, 6) AS signal_density, round(sqrt(greatest(ga2 / area - (ga / area) ** 2, 0)), 5) AS signal_sd FROM s""")
def pooled_features(spark, d):
    """The mask and intensity columns of the feature bank, with clamped edge windows."""
    v = F.col("g") / B.FULL_SCALE
    on = F.col("fiber")
    sums = W.window_sums(B.fiber_pixels(spark, d), W.axial_sums(F.col("theta")) | {
        "area": F.lit(1), "n": on.cast("long"), "gi": F.when(on, v), "gi2": F.when(on, v * v), "ga": v, "ga2": v * v},
        window=11, stride=7, height=50, width=50, partial=True)
    sd = lambda s2, s, n: F.round(F.sqrt(F.greatest(W.ratio(s2, n) - W.ratio(s, n) * W.ratio(s, n), F.lit(0.0))), 5)
    c = F.col
    return sums.select("img", c("iy").cast("long").alias("iy"), c("ix").cast("long").alias("ix"), "partial", c("n").alias("n_fiber_px"),
                       F.round(c("n") / c("area"), 6).alias("coverage_fraction"),
                       F.round(W.axial_mean(least=W.least_pixels(11))[1], 6).alias("order_parameter"),
                       F.round(W.ratio(c("gi"), c("n")), 6).alias("intensity_mean"), F.when(c("n") > 0, sd(c("gi2"), c("gi"), c("n"))).alias("intensity_sd"),
                       F.round(c("ga") / c("area"), 6).alias("signal_density"), sd(c("ga2"), c("ga"), c("area")).alias("signal_sd"))
