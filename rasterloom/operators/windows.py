"""Moving windows over rasters: membership, sums, circular statistics and gates.

A window (iy, ix) covers rows iy * stride ... iy * stride + window - 1, and
columns alike. Pixels are first summed up in blocks of the greatest common
divisor of window and stride; only blocks are then spread over the windows that
cover them, so that (window / stride) ** 2 copies are made of block sums and
not of pixels. Both steps combine before they shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells_over(at: Column, window: int, stride: int, cells: int | Column, unit: int = 1) -> Column:
    """Window numbers along one axis that cover unit ``at`` (of ``unit`` pixels); empty, not reversed, where none does."""
    first = F.greatest(F.lit(0), F.ceil((at * unit - window + unit) / F.lit(stride)).cast("int"))
    last = F.least(F.floor(at * unit / F.lit(stride)).cast("int"), F.lit(cells) - 1 if isinstance(cells, int) else cells - 1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def whole_windows(side: int, window: int, stride: int) -> int:
    """Windows along an axis that lie inside it; a trailing strip has none."""
    return 0 if side < window else (side - window) // stride + 1


def all_windows(side: int, window: int, stride: int) -> int:
    """Windows with one more, clamped to the edge, where a strip is left over."""
    whole = whole_windows(side, window, stride)
    covered = (whole - 1) * stride + window if whole else 0
    return whole + 1 if covered < side else whole


def window_sums(px: DataFrame, sums: dict[str, Column], *, window: int, stride: int, height: int, width: int,
                partial: bool = False, keys: Sequence[str] = ("img",)) -> DataFrame:
    """keys, iy, ix and the sum of each expression over each window that has pixels.

    With ``partial`` there is one more row and column of windows that leave the
    raster, flagged so; without, a trailing strip is dropped.
    """
    unit = math.gcd(window, stride)
    count = all_windows if partial else whole_windows
    blocks = (px.groupBy(*keys, F.floor(F.col("y") / unit).cast("int").alias("_by"), F.floor(F.col("x") / unit).cast("int").alias("_bx"))
              .agg(*(F.sum(e).alias(n) for n, e in sums.items())))
    # A block straddles no window's edge, so that it is inside or outside each as a whole.
    spread = (blocks.withColumn("iy", F.explode(cells_over(F.col("_by"), window, stride, count(height, window, stride), unit)))
              .withColumn("ix", F.explode(cells_over(F.col("_bx"), window, stride, count(width, window, stride), unit))))
    found = spread.groupBy(*keys, "iy", "ix").agg(*(F.sum(n).alias(n) for n in sums))
    if partial:
        found = found.withColumn("partial", ((F.col("iy") * stride + window) > height) | ((F.col("ix") * stride + window) > width))
    return found


def axial_sums(theta: Column) -> dict[str, Column]:
    """What to sum up for the mean of an axial angle in degrees (180-periodic)."""
    double = F.radians(theta) * 2
    return {"n_valid": F.when(theta.isNotNull(), 1).otherwise(0), "cos2": F.cos(double), "sin2": F.sin(double)}


def axial_mean(n: Column = None, c: Column = None, s: Column = None, least: Column | int = 1) -> tuple[Column, Column]:
    """Mean angle in [0, 180) and order parameter in [0, 1] from the sums; null below ``least`` values."""
    n, c, s = F.col("n_valid") if n is None else n, F.col("cos2") if c is None else c, F.col("sin2") if s is None else s
    enough = n >= least
    return (F.when(enough, F.pmod(F.degrees(F.atan2(s, c)) / 2, F.lit(180.0))),
            F.when(enough, F.sqrt(c * c + s * s) / n))


def least_pixels(window: int) -> int:
    """The fewest valid angles that a window's mean is given for: a tenth of its area, one at least."""
    return max(1, int(0.1 * window * window))


def gated(df: DataFrame, coverage: Column, least: float, metrics: Sequence[str]) -> DataFrame:
    """With coverage_pct and included; metrics of windows below ``least`` per cent are null, counts and rows stay."""
    df = df.withColumn("coverage_pct", coverage).withColumn("included", F.col("coverage_pct") >= least)
    return df.withColumns({m: F.when(F.col("included"), F.col(m)) for m in metrics})


def ratio(above: Column, below: Column, also: Column | None = None) -> Column:
    """above / below where below is positive (and ``also`` holds), else null."""
    ok = below > 0 if also is None else (below > 0) & also
    return F.when(ok, F.try_divide(above.cast("double"), below))


def density_mask(px: DataFrame, inside: Column, of: Column, keys: Sequence[str] = ("img",)) -> DataFrame:
    """hdm: the share of ``of`` pixels that are also ``inside``, per image; null without any."""
    counts = px.groupBy(*keys).agg(F.count_if(inside & of).alias("n_inside"), F.count_if(of).alias("n_of"))
    return counts.withColumn("hdm", ratio(F.col("n_inside"), F.col("n_of")))


def box_fraction(px: DataFrame, mask: Column, *, window: int, stride: int, height: int, width: int) -> DataFrame:
    """fraction of mask pixels in each whole window; windows that leave the image are not given."""
    sums = window_sums(px, {"n": F.when(mask, 1).otherwise(0), "area": F.lit(1)}, window=window, stride=stride, height=height, width=width)
    return sums.where(F.col("area") == window * window).withColumn("fraction", F.col("n") / F.col("area"))


def centered_sums(px: DataFrame, sums: dict[str, Column], *, window: int, step: int, height: int, width: int) -> DataFrame:
    """img, gy, gx and the sums over the box around each cell's center, of the pixels that are there; a box without pixels gives no row.

    Centers are ``step`` apart, the last one is moved into the frame of height
    and width; the box of even size starts window // 2 before its center. Rows are
    summed up before columns, so that a pixel makes window / step rows, not its square.
    """
    def around(at: Column, side: int) -> Column:
        last, reach = -(-side // step) - 1, window - window // 2 - 1
        near = lambda x: F.greatest(F.lit(0).cast("long"), F.least(F.lit(last).cast("long"), F.floor(x)))
        cells = F.sequence(near((at - reach - step // 2) / step), near((at + window // 2 - step // 2) / step + 1))
        center = lambda c: F.least(c * step + step // 2, F.lit(side - 1))
        return F.filter(cells, lambda c: (at >= center(c) - window // 2) & (at <= center(c) + reach))

    rows = (px.select("img", "y", F.explode(around(F.col("x"), width)).alias("gx"), *(e.alias(f"_{n}") for n, e in sums.items()))
            .groupBy("img", "y", "gx").agg(*(F.sum(f"_{n}").alias(n) for n in sums)))
    return rows.withColumn("gy", F.explode(around(F.col("y"), height))).groupBy("img", "gy", "gx").agg(*(F.sum(n).alias(n) for n in sums))


def centered_fraction(px: DataFrame, mask: Column, *, window: int, step: int, height: int, width: int) -> DataFrame:
    """n, area and fraction of mask pixels in a box around each cell's center, of what the image has of the box."""
    found = centered_sums(px, {"n": F.when(mask, 1).otherwise(0), "area": F.lit(1)}, window=window, step=step, height=height, width=width)
    return found.withColumn("fraction", F.col("n") / F.col("area"))
