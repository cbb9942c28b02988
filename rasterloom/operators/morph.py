"""Morphometrics of masks and fiber paths."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt
from .neighbors import box_sums


def box_dimension(mask: DataFrame, side: int, sizes: Sequence[int]) -> DataFrame:
    """img and dimension: the slope of log N over log 1/s, of boxes that lie inside; two sizes at least.

    Pixels come down to their smallest boxes before each size counts them.
    """
    usable = [s for s in sizes if s <= side]
    spread = mask.select("img", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.floor(F.col("y") / s).alias("by"), F.floor(F.col("x") / s).alias("bx"), F.lit(side // s).alias("n")) for s in usable))).alias("b"))
    boxes = spread.where("b.by < b.n AND b.bx < b.n").select("img", "b.s", "b.by", "b.bx").distinct()
    counts = boxes.groupBy("img", "s").agg(F.count("*").alias("n"))
    return counts.groupBy("img").agg(F.when(F.count("*") >= 2, F.regr_slope(F.log("n"), F.log(1 / F.col("s")))).alias("dimension"))


def lacunarity(px: DataFrame, mask, size: int) -> DataFrame:
    """img and lacunarity: 1 + variance / mean^2 of centered box sums.

    Boxes are those of a centered filter whose first size - 1 rows and columns
    are cut off, with zeros beyond the image; so the reference counts them.
    """
    lo, hi = size // 2, size - 1 - size // 2
    sums = box_sums(px, {"b": F.when(mask, 1).otherwise(0)}, lo, hi).where(f"y >= {size - 1} AND x >= {size - 1}")
    return sums.groupBy("img").agg(F.avg("b").alias("m"), F.var_pop("b").alias("v")).select("img", F.when(F.col("m") > 0, 1 + F.try_divide(F.col("v"), F.col("m") * F.col("m"))).alias("lacunarity"))


def path_shapes(points: DataFrame, *keys: str) -> DataFrame:
    """fiber (and the keys given that go with it), n, arc, chord, straightness (chord / arc; 1 for a point), cy and cx of points (fiber, seq, y, x)."""
    along = Window.partitionBy("fiber").orderBy("seq")
    dy, dx = F.col("y") - F.lag("y").over(along), F.col("x") - F.lag("x").over(along)
    per = (points.withColumn("step", F.sqrt((dy * dy + dx * dx).cast("double"))).groupBy("fiber", *keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("arc"), F.min(F.struct("seq", "y", "x")).alias("a"), F.max(F.struct("seq", "y", "x")).alias("b"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx")))
    dy, dx = F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")
    chord = F.sqrt((dy * dy + dx * dx).cast("double"))
    return per.select("fiber", *keys, "n", "arc", chord.alias("chord"), F.when(F.col("arc") > 0, F.try_divide(chord, F.col("arc"))).otherwise(1.0).alias("straightness"), "cy", "cx")


def path_curvature(points: DataFrame, reach: int, axial: bool = True, shorter: bool = False) -> DataFrame:
    """fiber and curvature: the turn between the directions over ``reach`` steps at both ends, in radians a pixel of arc; axial turns are at most a right angle.

    Paths of ``reach`` points or fewer have none, or with ``shorter`` take all their steps, if two at least.
    """
    packed = points.groupBy("fiber").agg(F.sort_array(F.collect_list(F.struct("seq", "y", "x"))).alias("p")).where(F.size("p") > (2 if shorter else reach))
    reach = F.least(F.lit(reach), F.size("p") - 1) if shorter else F.lit(reach)
    at = lambda k: F.element_at("p", k)
    angle = lambda a, b: F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    turn = F.abs(angle(at(1), at(reach + 1)) - angle(at(-reach - 1), at(-1)))
    turn = F.least(F.pmod(turn, F.lit(180.0)), 180 - F.pmod(turn, F.lit(180.0))) if axial else F.least(F.pmod(turn, F.lit(360.0)), 360 - F.pmod(turn, F.lit(360.0)))
    return packed.select("fiber", F.radians(turn).alias("turn")).join(dealt(path_shapes(points).select("fiber", "arc")), "fiber").select(
        "fiber", F.try_divide("turn", "arc").alias("curvature"))


def length_summary(shapes: DataFrame, *keys: str, straight: float = 0.85) -> DataFrame:
    """Mean, length-weighted mean, p10, median and sd of straightness, the share below ``straight``, count and median length."""
    s = F.col("straightness")
    return shapes.groupBy(*keys).agg(
        F.count("*").alias("n_fibers"), F.avg(s).alias("mean"), F.try_divide(F.sum(s * F.col("arc")), F.sum("arc")).alias("weighted_mean"),
        F.percentile(s, F.lit(0.1)).alias("p10"), F.percentile(s, F.lit(0.5)).alias("median"), F.stddev_pop(s).alias("sd"),
        (F.count_if(s < straight) / F.count("*")).alias("bent"), F.percentile("arc", F.lit(0.5)).alias("median_length"))


def by_centroid(shapes: DataFrame, stride: int) -> DataFrame:
    """iy, ix, n_fibers and median straightness: each fiber counts in the one cell whose stride holds its centroid."""
    return shapes.groupBy(F.floor(F.col("cy") / stride).alias("iy"), F.floor(F.col("cx") / stride).alias("ix")).agg(
        F.count("*").alias("n_fibers"), F.percentile("straightness", F.lit(0.5)).alias("median"))


def axial_gap(degrees_a: float, degrees_b: float) -> float:
    d = math.fmod(abs(degrees_a - degrees_b), 180.0)
    return min(d, 180.0 - d)
