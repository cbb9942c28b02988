"""Tiling, ownership, merging, sampling and pyramids of grids and maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import all_windows, whole_windows

#: Scalars that tiles add up, those of gaps, and those that tile summaries can't be merged to.
ADDITIVE = ("fiber_pixels", "zone_pixels", "fiber_in_zone_pixels", "region_pixels", "zone_area_um2", "fiber_in_zone_area_um2",
            "morphometrics.total_length_px", "morphometrics.total_length_um", "morphometrics.gap_count")
GAP_COUNT, GAP_MEAN, GAP_MAX = "morphometrics.gap_count", "morphometrics.gap_mean_um", "morphometrics.gap_max_um"
DROPPED = ("morphometrics.fractal_dimension", "straightness.radon.theta_star_deg", "morphometrics.branch_points", "morphometrics.endpoints",
           "straightness.straightness_p10", "straightness.straightness_median", "straightness.straightness_sd", "straightness.median_fiber_len_px")
#: The key that has a tile's number of windows.
WINDOWS = "windows"


def tile_plan(spark: SparkSession, width: int, height: int, window: int, stride: int, budget: int) -> DataFrame:
    """tile, x, y, w and h of tiles within a pixel budget, on stride multiples, that overlap by one window.

    A region within the budget is one tile. A remainder too thin for a window
    has no tile of its own: the one before it holds all its windows.
    """
    if width * height <= budget:
        return spark.range(1).select(*(F.lit(v).cast("long").alias(n) for n, v in (("tile", 0), ("x", 0), ("y", 0), ("w", width), ("h", height))))
    side = max(window, math.isqrt(budget))
    per_side = max(1, (side - window) // stride + 1)
    reach, step = (per_side - 1) * stride + window, max(stride, (per_side - 1) * stride)

    def axis(size: int):
        last = max(0, (size - window) // step)
        at = F.explode(F.sequence(F.lit(0), F.lit(last * step), F.lit(step))).alias("at")
        return spark.range(1).select(at).select("at", F.least(F.lit(reach), F.lit(size) - F.col("at")).alias("size"))

    xs = axis(width).select(F.col("at").alias("x"), F.col("size").alias("w"))
    ys = axis(height).select(F.col("at").alias("y"), F.col("size").alias("h"))
    return ys.crossJoin(xs).withColumn("tile", F.row_number().over(Window.orderBy("y", "x")) - 1)


def owned_boxes(tiles: DataFrame) -> DataFrame:
    """With own_x1 and own_y1: each tile owns from its origin to the next one, the last to its end; a partition of the region."""
    def ends(axis: str, size: str) -> DataFrame:
        edge = tiles.groupBy(axis).agg(F.max(F.col(axis) + F.col(size)).alias("end"))
        return edge.select(axis, F.coalesce(F.lead(axis).over(Window.orderBy(axis)), "end").alias(f"own_{axis}1"))
    return tiles.join(F.broadcast(ends("x", "w")), "x").join(F.broadcast(ends("y", "h")), "y")


def halo(rolling: Column, sigma_max: Column) -> Column:
    """Pixels around a tile that its filters look at."""
    return 2 * rolling + F.ceil(4 * sigma_max) + 1 + (4 + 1 + 16)


def aligned(at: Column, step: Column | int) -> Column:
    return F.floor(at / step) * step


def core_geometry(side: int, window: int, stride: int) -> dict[str, int]:
    whole, total = whole_windows(side, window, stride), all_windows(side, window, stride)
    return {"core": stride, "inset": (window - stride) // 2, "whole": whole, "partial": total - whole, "total": total}


def merged_scalars(scalars: DataFrame) -> DataFrame:
    """key and value of (tile, key, value) merged over tiles.

    Additive keys are summed, largest gaps kept, mean gaps weighted by their
    count, others by windows; order statistics, topology and angles have no
    merge and are left out. Ratios of totals are made from the totals. Missing
    and non-finite values count nothing.
    """
    k, v = F.col("key"), F.col("value")
    scalars = scalars.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    weights = scalars.groupBy("tile").agg(F.max(F.when(k == GAP_COUNT, v)).alias("w_gap"), F.max(F.when(k == WINDOWS, v)).alias("w_win"))
    usable = scalars.where(~k.isin(*DROPPED) & ~k.endswith("_deg") & (k != WINDOWS)).join(weights, "tile")
    weight = F.coalesce(F.when(k == GAP_MEAN, F.col("w_gap")).otherwise(F.greatest(F.col("w_win"), F.lit(0.0))), F.lit(0.0))
    merged = usable.groupBy("key").agg(F.sum(v).alias("total"), F.max(v).alias("most"), F.try_divide(F.sum(v * weight), F.sum(weight)).alias("mean"))
    merged = merged.select("key", F.when(k.isin(*ADDITIVE), F.col("total")).when(k == GAP_MAX, F.col("most")).otherwise(F.col("mean")).alias("value"))
    total = lambda name: F.max(F.when(k == name, v))
    sums = merged.agg(total("zone_pixels").alias("zone"), total("fiber_in_zone_pixels").alias("inside"), total("region_pixels").alias("region"), total("fiber_pixels").alias("fiber"))
    ratio = lambda name, a, b, times: F.struct(F.lit(name).alias("key"), F.when(F.col(b) > 0, times * F.col(a) / F.col(b)).alias("value"))
    made = sums.select(F.explode(F.array(ratio("fiber_coverage_zone_percent", "inside", "zone", 100.0), ratio("fiber_coverage_region_percent", "fiber", "region", 100.0))).alias("r")).select("r.*")
    kept = merged.join(made.where("value IS NOT NULL").select("key"), "key", "left_anti")
    return kept.union(made).where("value IS NOT NULL")


def dropped_keys(scalars: DataFrame) -> DataFrame:
    k = F.col("key")
    return scalars.where(k.isin(*DROPPED) | k.endswith("_deg")).agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("dropped"))


def owner_wins(offered: DataFrame, key: Sequence[str], owns: Column, tile: str) -> DataFrame:
    """One row a key: the one from the tile that owns it, else from the last tile."""
    best = Window.partitionBy(*key).orderBy(owns.desc(), F.desc(tile))
    return offered.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def pyramid_level(cells: DataFrame, value: str, factor: int, period: float | None = None) -> DataFrame:
    """img, gy, gx and the mean of what is there in each block of factor x factor cells; of axial values, their axis."""
    block = ("img", F.floor(F.col("y") / factor).alias("gy"), F.floor(F.col("x") / factor).alias("gx"))
    if period is None:
        return cells.groupBy(*block).agg(F.avg(value).alias(value))
    turn = F.col(value) * (2 * math.pi / period)
    sums = cells.groupBy(*block).agg(F.avg(F.cos(turn)).alias("c"), F.avg(F.sin(turn)).alias("s"))
    return sums.select("img", "gy", "gx", F.pmod(F.atan2("s", "c") * (period / (2 * math.pi)), F.lit(period)).alias(value))


def sample_bilinear(points: DataFrame, cells: DataFrame, value: str, cell: int, period: float | None = None) -> DataFrame:
    """Points (id, img, py, px in pixels) with the value between the four cells around; missing corners are left out and the rest weighted anew.

    Cell centers are at (g + 0.5) * cell. Of axial values the vectors are
    weighted. A point without any corner has no value.
    """
    at = lambda p: F.col(p) / cell - 0.5
    base = points.withColumns({"fy": F.floor(at("py")), "fx": F.floor(at("px"))}).withColumns({"ty": at("py") - F.floor(at("py")), "tx": at("px") - F.floor(at("px"))})
    corner = F.explode(F.array(*(F.struct((F.col("fy") + dy).cast("int").alias("y"), (F.col("fx") + dx).cast("int").alias("x"),
                                          ((F.col("ty") if dy else 1 - F.col("ty")) * (F.col("tx") if dx else 1 - F.col("tx"))).alias("w")) for dy in (0, 1) for dx in (0, 1))))
    spread = base.select("id", "img", corner.alias("k")).select("id", "img", "k.y", "k.x", "k.w")
    met = spread.join(cells.select("img", "y", "x", value), ["img", "y", "x"], "left").withColumn("w", F.when(F.col(value).isNotNull(), F.col("w")))
    if period is None:
        return met.groupBy("id", "img").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias(value))
    turn = F.col(value) * (2 * math.pi / period)
    sums = met.groupBy("id", "img").agg(F.sum(F.col("w") * F.cos(turn)).alias("c"), F.sum(F.col("w") * F.sin(turn)).alias("s"))
    return sums.select("id", "img", F.pmod(F.atan2("s", "c") * (period / (2 * math.pi)), F.lit(period)).alias(value))


def sample_nearest(points: DataFrame, cells: DataFrame, value: str, cell: int) -> DataFrame:
    keyed = points.withColumns({"y": F.floor(F.col("py") / cell).cast("int"), "x": F.floor(F.col("px") / cell).cast("int")})
    return keyed.join(cells.select("img", "y", "x", value), ["img", "y", "x"], "left").select("id", "img", value)


def object_points(objects: DataFrame, cell: int) -> DataFrame:
    """id, img, py and px of sample points in each box (half-open, in pixels), every quarter cell; its center if none falls inside."""
    step = cell / 4
    along = lambda a, b: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col(b) - F.col(a)) / step).cast("int") - 1)), lambda k: F.col(a) + (k + 0.5) * step)
    inside = lambda a, b: F.filter(along(a, b), lambda v: v < F.col(b))
    some = lambda a, b: F.when(F.size(inside(a, b)) > 0, inside(a, b)).otherwise(F.array((F.col(a) + F.col(b)) / 2))
    return objects.withColumn("py", F.explode(some("y0", "y1"))).withColumn("px", F.explode(some("x0", "x1"))).select("id", "img", "py", "px")


def object_means(objects: DataFrame, cells: DataFrame, value: str, cell: int) -> DataFrame:
    """id, img and the mean of the map over each object's sample points."""
    return sample_nearest(object_points(objects, cell), cells, value, cell).groupBy("id", "img").agg(F.avg(value).alias(value))


def display_range(df: DataFrame, value: Column, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """lo and hi by nearest rank (floor below, ceil above) of finite values; 0 and 1 without any.

    Values are counted first; only the different ones are in order in one task.
    """
    per = df.where(value.isNotNull() & ~F.isnan(value.cast("double"))).groupBy(value.cast("double").alias("v")).agg(F.count("*").alias("n"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("v", F.sum("n").over(up).alias("run"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = lambda share, f: f(share * (F.col("all") - 1)) + 1
    return run.agg(F.coalesce(F.min(F.when(F.col("run") >= rank(lo, F.floor), F.col("v"))), F.lit(0.0)).alias("lo"),
                   F.coalesce(F.min(F.when(F.col("run") >= rank(hi, F.ceil), F.col("v"))), F.lit(1.0)).alias("hi"))


def anchored_groups(df: DataFrame, key: str, value: str, within: float = 1.02) -> DataFrame:
    """key, value, n and anchor: values in order join a group while they are within the ratio of its first member.

    Rows are counted by key and value first; the chain then runs over each key's
    different values.
    """
    import pandas as pd
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(value)
        anchor, anchors = None, []
        for v in part[value]:
            if anchor is None or v > anchor * within:
                anchor = v
            anchors.append(anchor)
        return part.assign(anchor=anchors)[[key, value, "n", "anchor"]]

    types = dict(counts.dtypes)
    return counts.groupBy(key).applyInPandas(chain, f"{key} {types[key]}, {value} {types[value]}, n long, anchor {types[value]}")


def accumulated(px: DataFrame, value: str, tile: int) -> DataFrame:
    """img, cells, total of an image's tiles; a tile that has not all pixels of its place, which the image's edge may cut, fails the run."""
    ends = px.groupBy("img").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    tiles = px.groupBy("img", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(F.count("*").alias("n"), F.sum(value).alias("s")).join(ends, "img")
    due = F.least(F.lit(tile), F.col("_h") - F.col("ty") * tile) * F.least(F.lit(tile), F.col("_w") - F.col("tx") * tile)
    strict = F.when(F.col("n") == due, F.col("s")).otherwise(F.raise_error(F.concat(F.lit("tile of another shape in image "), F.col("img"))).cast("long"))
    return tiles.groupBy("img").agg(F.sum("n").alias("cells"), F.sum(strict).alias("total"))
