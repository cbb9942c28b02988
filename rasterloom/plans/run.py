"""Whole runs: analyze a raster into its tables, and density maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import neighbors as N
from ..operators import texture as T
from ..operators import windows as W


def analyze(px: DataFrame, *, height: int, width: int, window: int = 10, stride: int = 5, least_coverage: float = 5.0,
            full_scale: int = 65535, bins: int = 1024, cut: float | None = None) -> dict[str, DataFrame]:
    """regions, windows, texture and cut of a raster (img, y, x, g).

    The cut is one broadcast row, pooled over all images by Otsu where none is
    given. Angles come as a column theta, if px has one. Nothing is collected.
    """
    v = F.col("g") / full_scale
    spark = px.sparkSession
    cuts = T.otsu(T.histogram(px, v, bins), bins) if cut is None else spark.range(1).select(F.lit(cut).alias("cut"))
    on = px.join(F.broadcast(cuts)).withColumn("fiber", v >= F.col("cut"))
    theta = F.when(F.col("fiber"), F.col("theta").cast("double")) if "theta" in px.columns else F.lit(None).cast("double")
    sums = W.window_sums(on, W.axial_sums(theta) | {"n_fiber_px": F.col("fiber").cast("long"), "area": F.lit(1)}, window=window, stride=stride, height=height, width=width)
    angle, order = W.axial_mean(least=W.least_pixels(window))
    windows = W.gated(sums.withColumns({"mean_angle_deg": angle, "order_parameter": order}), 100.0 * F.col("n_fiber_px") / F.col("area"), least_coverage,
                      ["mean_angle_deg", "order_parameter"]).drop("cos2", "sin2")
    regions = on.groupBy("img").agg(F.count("*").alias("n_region"), F.count_if("fiber").alias("n_fiber")).withColumn("coverage_pct", 100.0 * F.col("n_fiber") / F.col("n_region"))
    shapes = N.ring_codes(on.where("fiber")).groupBy("img").agg(F.count_if("is_junction").alias("branch_points"), F.count_if("is_endpoint").alias("endpoints"))
    levels = on.where("fiber").select("img", "y", "x", T.quantised(v, 0.0, 1.0, 8).alias("level"))
    pairs = T.cooccurrence(levels, [1], window=window, stride=stride, height=height, width=width)
    return {"cut": cuts, "regions": regions.join(shapes, "img", "left"), "windows": windows, "texture": T.haralick(pairs, "img", "iy", "ix")}


def density_tile(px: DataFrame, *, height: int, width: int, window: int, step: int) -> DataFrame:
    """img, gy, gx and the pixel-mode channels of a density map: coverage, order, angle; null where no fiber is, no row where no pixel is."""
    turn = F.radians("theta") * 2
    cells = W.centered_sums(px, {"n": F.col("fiber").cast("long"), "area": F.lit(1), "c": F.coalesce(F.cos(turn), F.lit(0.0)), "s": F.coalesce(F.sin(turn), F.lit(0.0)),
                                 "k": F.col("theta").isNotNull().cast("long")}, window=window, step=step, height=height, width=width)
    angle, order = W.axial_mean(F.col("k"), F.col("c"), F.col("s"))
    return cells.select("img", "gy", "gx", F.when(F.col("n") > 0, F.col("n") / F.col("area")).alias("coverage"), order.alias("order_parameter"), angle.alias("angle"))
