"""Neighborhoods of pixels and of grid cells: box statistics, context, ring codes, morphology with small disks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import centered_sums

#: The eight neighbors in ring order, as (dy, dx); and the plus-shaped disk of radius 1.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
PLUS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def box_sums(df: DataFrame, sums: dict[str, Column], before: int, after: int, key: str = "img", y: str = "y", x: str = "x") -> DataFrame:
    """The sum of each expression over the box [-before, after] around each cell; cells outside the grid count nothing.

    The box is summed along rows and then along columns, so that it costs two
    shuffles by row and column whatever its size.
    """
    across = Window.partitionBy(key, y).orderBy(x).rangeBetween(-before, after)
    down = Window.partitionBy(key, x).orderBy(y).rangeBetween(-before, after)
    df = df.withColumns({f"_{n}": F.sum(e).over(across) for n, e in sums.items()})
    return df.withColumns({n: F.sum(f"_{n}").over(down) for n in sums}).drop(*(f"_{n}" for n in sums))


def box_stats(df: DataFrame, value: Column, radius: int, prefix: str, **where) -> DataFrame:
    """With prefix mean, sd (population) and n of the values that are there, in a square of that radius."""
    df = shifted(df, {"_v": value.cast("double")}, where.get("key", "img"))
    v = F.col("_v")
    df = box_sums(df, {f"{prefix}s": F.coalesce(v, F.lit(0.0)), f"{prefix}q": F.coalesce(v * v, F.lit(0.0)), f"{prefix}n": v.isNotNull().cast("long")}, radius, radius, **where)
    s, q, n = (F.col(f"{prefix}{c}") for c in "sqn")
    mean = F.when(n > 0, F.try_divide(s, n))
    sd = F.when(n > 0, F.sqrt(F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))))
    return df.withColumns({f"{prefix}mean": mean + F.col("_v_mean"), f"{prefix}sd": sd}).drop(f"{prefix}s", f"{prefix}q", "_v", "_v_mean")


def shifted(df: DataFrame, values: dict[str, Column], key: str = "img") -> DataFrame:
    """With each value less its mean over the image, under its name, and that mean under the name with _mean.

    Sums of squares of values far from 0 lose their digits; about their image's
    mean they do not. The means are joined on the image.
    """
    means = df.groupBy(key).agg(*(F.avg(v).alias(f"{n}_mean") for n, v in values.items()))
    return df.join(means, key).withColumns({n: v - F.col(f"{n}_mean") for n, v in values.items()})


def orientation_context(df: DataFrame, theta: Column, weight: Column, radius: int, **where) -> DataFrame:
    """With dispersion (1 - R) and deviation (degrees in [0, 90]) of the weighted axis around; no positive weight gives null."""
    w = F.when((weight > 0) & theta.isNotNull(), weight.cast("double")).otherwise(0.0)
    double = F.radians(F.coalesce(theta, F.lit(0.0))) * 2
    df = box_sums(df, {"_c": w * F.cos(double), "_s": w * F.sin(double), "_w": w}, radius, radius, **where)
    axis = F.pmod(F.degrees(F.atan2("_s", "_c")) / 2, F.lit(180.0))
    apart = F.pmod(F.abs(theta - axis), F.lit(180.0))
    some = F.col("_w") > 0
    return df.withColumns({
        "dispersion": F.when(some, 1 - F.try_divide(F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")), F.col("_w"))),
        "deviation": F.when(some, F.least(apart, 180 - apart))}).drop("_c", "_s", "_w")


def gradient(df: DataFrame, value: Column, key: str = "img", y: str = "y", x: str = "x") -> DataFrame:
    """With gy and gx: central differences, one-sided at the edges; null on an axis of one cell."""
    def along(part: list[str], order: str) -> Column:
        w = Window.partitionBy(*part).orderBy(order)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)
    return df.withColumns({"gy": along([key, x], y), "gx": along([key, y], x)})


def context_bank(df: DataFrame, bases: Sequence[str], radii: Sequence[int] = (1, 3), angle: str | None = None, weight: str | None = None,
                 coverage: str | None = None, key: str = "img", y: str = "y", x: str = "x") -> DataFrame:
    """For each radius, mean, sd and deviation from the mean of each base, with the radius in the name.

    With an ``angle`` there are also its dispersion and deviation around, by
    ``weight`` (or one each), and with a ``coverage`` the size of the gradient of
    its mean. All sums of all radii go along rows at once and then along columns.
    """
    c, double = F.col, lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    sums = {}
    values = list(dict.fromkeys([*bases, *([coverage] if coverage else [])]))
    df = shifted(df, {f"_v_{b}": c(b).cast("double") for b in values}, key)
    for b in values:
        sums |= {f"{b}_s": double(f"_v_{b}"), f"{b}_q": double(f"_v_{b}") * double(f"_v_{b}"), f"{b}_n": c(b).isNotNull().cast("long")}
    if angle:
        w = F.when(c(angle).isNotNull() & (c(weight) > 0 if weight else F.lit(True)), c(weight).cast("double") if weight else F.lit(1.0)).otherwise(0.0)
        sums |= {"_c": w * F.cos(F.radians(double(angle)) * 2), "_s": w * F.sin(F.radians(double(angle)) * 2), "_w": w}
    along = lambda part, order, r: Window.partitionBy(key, part).orderBy(order).rangeBetween(-r, r)
    df = df.withColumns({f"_{n}_r{r}": F.sum(e).over(along(y, x, r)) for r in radii for n, e in sums.items()})
    df = df.withColumns({f"{n}_r{r}": F.sum(f"_{n}_r{r}").over(along(x, y, r)) for r in radii for n in sums})
    made = {}
    for r in radii:
        for b in bases:
            n, mean = c(f"{b}_n_r{r}"), F.try_divide(f"{b}_s_r{r}", f"{b}_n_r{r}")
            made |= {f"{b}_mean_r{r}": mean + c(f"_v_{b}_mean"), f"{b}_sd_r{r}": F.when(n > 0, F.sqrt(F.greatest(F.try_divide(c(f"{b}_q_r{r}"), n) - mean * mean, F.lit(0.0)))), f"{b}_dev_r{r}": c(f"_v_{b}") - mean}
        if angle:
            cos, sin, some = c(f"_c_r{r}"), c(f"_s_r{r}"), c(f"_w_r{r}") > 0
            apart = F.pmod(F.abs(c(angle) - F.pmod(F.degrees(F.atan2(sin, cos)) / 2, F.lit(180.0))), F.lit(180.0))
            made |= {f"angular_dispersion_r{r}": F.when(some, 1 - F.least(F.lit(1.0), F.try_divide(F.sqrt(cos * cos + sin * sin), c(f"_w_r{r}")))),
                     f"angle_dev_r{r}": F.when(some, F.least(apart, 180 - apart))}
        if coverage:
            made |= {f"_smooth_r{r}": F.coalesce(F.try_divide(f"{coverage}_s_r{r}", f"{coverage}_n_r{r}") + c(f"_v_{coverage}_mean"), F.lit(0.0)), f"_some_r{r}": c(f"{coverage}_n_r{r}") > 0}
    df = df.withColumns(made)
    if coverage:
        def slope(part: str, order: str, value: Column) -> Column:
            w = Window.partitionBy(key, part).orderBy(order)
            before, after = F.lag(value).over(w), F.lead(value).over(w)
            return F.when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)
        df = df.withColumns({f"_gy_r{r}": slope(x, y, c(f"_smooth_r{r}")) for r in radii})
        df = df.withColumns({f"_gx_r{r}": slope(y, x, c(f"_smooth_r{r}")) for r in radii})
        df = df.withColumns({f"coverage_grad_r{r}": F.when(c(f"_some_r{r}"), F.sqrt(c(f"_gy_r{r}") * c(f"_gy_r{r}") + c(f"_gx_r{r}") * c(f"_gx_r{r}"))) for r in radii})
    spare = [f"_v_{b}{m}" for b in values for m in ("", "_mean")] + [f"{p}{n}_r{r}" for r in radii for n in sums for p in ("_", "")] + [f"_{n}_r{r}" for r in radii for n in ("smooth", "some", "gy", "gx")]
    return df.drop(*spare)


def centered_mean(df: DataFrame, value: Column, size: int, step: int, height: int, width: int) -> DataFrame:
    """img, gy, gx and mean of a centered box of ``size`` at every ``step`` pixels, of what the image has of it."""
    sums = centered_sums(df, {"_s": value.cast("double"), "_n": F.lit(1)}, window=size, step=step, height=height, width=width)
    return sums.select("img", "gy", "gx", (F.col("_s") / F.col("_n")).alias("mean"))


def summed_area(df: DataFrame, value: Column) -> DataFrame:
    """With area_sum: the sum over all pixels above and left, itself included."""
    across = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_r", F.sum(value).over(across)).withColumn("area_sum", F.sum("_r").over(down)).drop("_r")


def ring_codes(mask: DataFrame) -> DataFrame:
    """img, y, x, code, neighbors, crossings, is_junction and is_endpoint of each pixel of a sparse mask (img, y, x).

    Each pixel tells its eight neighbors, whose bits are or-ed together; nothing
    is joined. Crossings are the changes from 0 to 1 around the ring; a junction
    has three at least, an endpoint has exactly one neighbor.
    """
    spread = [F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(RING)]
    told = mask.select("img", "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(256).alias("bit")), *spread)).alias("o"))
    codes = (told.groupBy("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
             .agg(F.bit_or("o.bit").alias("all")).where("(all & 256) != 0").withColumn("code", F.col("all").bitwiseAND(255)).drop("all"))
    turned = F.expr("((code * 2) & 255) | (code div 128)").cast("int")
    codes = codes.withColumns({"neighbors": F.bit_count("code"), "crossings": F.bit_count(F.col("code").bitwiseAND(255 - turned.bitwiseAND(255)))})
    return codes.withColumns({"is_junction": F.col("crossings") >= 3, "is_endpoint": F.col("neighbors") == 1})


def neighbor_extreme(px: DataFrame, value: str, least: bool, offsets=PLUS) -> DataFrame:
    """img, y, x and the smallest (or largest) value among those of a pixel's offsets that the image has.

    Each pixel tells its neighbors; a place that only neighbors tell of is no pixel.
    """
    moves = F.explode(F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in offsets)))
    told = px.select("img", "y", "x", value, moves.alias("o"))
    own = (F.col("o.dy") == 0) & (F.col("o.dx") == 0)
    found = told.groupBy("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(
        (F.min if least else F.max)(value).alias(value), F.bool_or(own).alias("_there"))
    return found.where("_there").drop("_there")


def closed(px: DataFrame, mask: str, offsets=PLUS) -> DataFrame:
    """img, y, x of the mask dilated and then eroded; places without a pixel, in the image or beyond it, neither grow nor shrink it."""
    on = px.select("img", "y", "x", F.coalesce(F.col(mask), F.lit(False)).alias("on"))
    return neighbor_extreme(neighbor_extreme(on, "on", False, offsets), "on", True, offsets).where("on").drop("on")


def top_hat(px: DataFrame, value: str) -> DataFrame:
    """img, y, x, v: the value less its opening by the plus-shaped disk, which takes slow backgrounds away."""
    opened = neighbor_extreme(neighbor_extreme(px, value, True), value, False).withColumnRenamed(value, "opened")
    return px.join(opened, ["img", "y", "x"]).select("img", "y", "x", (F.col(value) - F.col("opened")).alias("v"))
