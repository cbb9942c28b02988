"""Figures of windows that rest on skeletons, distances, traced fibers and gradients, and the segmentation before them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt, written
from . import arrays as A
from . import morph as M
from . import texture as X
from . import tiles as T
from . import tracing as R
from . import windows as W
from .neighbors import closed, ring_codes, top_hat

#: A window whose gradients have less energy than this a pixel is flat.
FLAT = 1e-12
AT = ["img", "y", "x"]
#: Windows a side of an image, for one number an image and window; images are numbered up to 2**23.
WINDOWS = 1 << 20


def segmented(px: DataFrame, value: Column, cut: float | str, least: int = 0, *, ridge: str | None = None, sigmas: Sequence[float] = (1.0,),
              dark: bool = False, flatten: bool = False, close: bool = False, ball: int = 0, bins: int = 1024) -> DataFrame:
    """img, y, x of the fibers: ridge response, background taken off, threshold, closing, and no small objects, in that order.

    ``dark`` fibers are dark ridges, or without a ridge filter bright ones of the
    inverted value, which is then in [0, 1]. ``cut`` is on the scale of the
    response or of the value, or ``otsu`` or ``triangle`` of what stands before
    the threshold, in [0, 1] and pooled over all images, of ``bins`` bins. ``ball``
    is the radius of the background's disk; ``flatten`` stands for the plus-shaped
    one, by which closing goes too.
    """
    plane = px.select(*AT, value.cast("double").alias("v"))
    if ridge:
        plane = T.ridges(plane, "v", sigmas, [ridge], dark).withColumnRenamed(ridge, "v")
    elif dark:
        plane = plane.withColumn("v", 1 - F.col("v"))
    if flatten:
        plane = top_hat(written(plane, "plane"), "v")
    if ball:
        plane = T.rolling_ball(plane, "v", ball)
    if isinstance(cut, str):
        plane = written(plane, "plane")
        found = {"otsu": X.otsu, "triangle": X.triangle}[cut](X.histogram(plane, F.col("v"), bins), bins)
        plane = plane.crossJoin(F.broadcast(found.select(F.col("cut").alias("_cut"))))  # one row
        on = plane.select(*AT, (F.col("v") >= F.col("_cut")).alias("on"))
    else:
        on = plane.select(*AT, (F.col("v") >= cut).alias("on"))
    mask = closed(on, "on") if close else on.where("on").drop("on")
    return T.without_small(mask, least) if least > 0 else mask


def gap_centers(px: DataFrame, fiber: Column, inside: Column) -> DataFrame:
    """img, y, x, width: twice the distance at local maxima of the distance to a fiber, above 1, whose circle stays inside the image."""
    def peaks(d: np.ndarray, room: np.ndarray, here: np.ndarray) -> dict[str, np.ndarray]:
        around = np.pad(d, 1)
        h, w = d.shape
        return {"d": d, "room": room, "top": np.max([around[y:y + h, x:x + w] for y in range(3) for x in range(3)], axis=0)}

    # The room to the edges goes along with the pixels, so that nothing is joined to them again; -1 where no gap is wanted.
    room = F.when(F.col("i"), F.least("y", "x", F.col("_h") - 1 - F.col("y"), F.col("_w") - 1 - F.col("x")).cast("int")).otherwise(-1)
    rows = T.sized(px.select(*AT, fiber.alias("f"), inside.alias("i"))).select(*AT, "f", room.alias("room"), "_h", "_w")
    d = T.distances(rows, F.col("f"), ["room"]).where("d < double('infinity')")
    found = T.per_tile(d, ["d", "room"], peaks, "d double, room int, top double", halo=1, to_edge=False)
    return found.where("d >= top AND d > 1 AND d <= room").select(*AT, (2 * F.col("d")).alias("width"))


def coherence(xx: Column, yy: Column, xy: Column, n: Column | int) -> Column:
    """Of summed gradient products, in [0, 1]; null where n pixels are flat."""
    return F.when(xx + yy > FLAT * n, F.least(F.lit(1.0), F.try_divide(F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy), xx + yy)))


def window_coherence(px: DataFrame, value: str, window: int) -> DataFrame:
    """img, iy, ix, coherence of the windows that lie inside their image."""
    g = T.sized(T.gradients(px, value)).where((F.floor(F.col("y") / window) < F.floor(F.col("_h") / window)) & (F.floor(F.col("x") / window) < F.floor(F.col("_w") / window)))
    gy, gx = F.col("gy"), F.col("gx")
    sums = g.groupBy("img", F.floor(F.col("y") / window).cast("int").alias("iy"), F.floor(F.col("x") / window).cast("int").alias("ix")).agg(
        F.sum(gx * gx).alias("xx"), F.sum(gy * gy).alias("yy"), F.sum(gx * gy).alias("xy"))
    return sums.select("img", "iy", "ix", coherence(F.col("xx"), F.col("yy"), F.col("xy"), window * window).alias("coherence"))


def alignment(px: DataFrame, value: str, window: int) -> DataFrame:
    """img, iy, ix and the Radon figures of each window; a strip left over makes a smaller one."""
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y, x = part["y"] - part["y"].min(), part["x"] - part["x"].min()
        plane = np.zeros((y.max() + 1, x.max() + 1))
        plane[y, x] = part[value]
        return pd.DataFrame([{"img": key[0], "iy": key[1], "ix": key[2]} | A.alignment(plane)])

    cells = px.select(*AT, value, F.floor(F.col("y") / window).cast("int").alias("iy"), F.floor(F.col("x") / window).cast("int").alias("ix"))
    return cells.groupBy("img", "iy", "ix").applyInPandas(run, "img long, iy int, ix int, pmr double, ai double, fwhm double, entropy double, theta double")


def feature_planes(px: DataFrame, fiber: Column, value: str) -> DataFrame:
    """img, y, x and every per-pixel plane whose window sums the features are made of.

    A fiber's straightness and curvature are painted on its pixels, so that their
    means are by length, and 1 / n of each pixel, so that a window with half a
    fiber counts half of one. Where fibers cross, the one traced last counts.
    """
    base = written(px.select(*AT, fiber.alias("fiber"), F.col(value).cast("double").alias("v"), fiber.cast("double").alias("m")), "planes")
    skeleton = written(T.thinned(base.where("fiber").select(*AT)), "skeleton")
    paths = written(R.traced(skeleton), "paths")
    shapes = M.path_shapes(paths).select("fiber", F.col("n").alias("length"), "arc", "straightness").join(dealt(M.path_curvature(paths, 4, axial=False, shorter=True)), "fiber", "left")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    painted = (paths.join(dealt(shapes.where("length >= 2")), "fiber").withColumn("equivalent", 1 / F.col("length"))
               .groupBy(*AT).agg(last("straightness"), last("curvature"), last("equivalent")))
    width = T.distances(base, ~F.col("fiber")).where("d < double('infinity')").select(*AT, (2 * F.col("d")).alias("width"))
    thin = skeleton.withColumn("skeleton", F.lit(1)).join(dealt(ring_codes(skeleton).select(*AT, "is_junction", "is_endpoint")), AT).join(dealt(width), AT, "left").join(dealt(painted), AT, "left")
    theta = T.orientation(base, "m", "fiber")
    # The kernel's two sides weigh one each here, and not a half.
    gradients = T.gradients(base, "v", 1.0).withColumns({"gy": 2 * F.col("gy"), "gx": 2 * F.col("gx")})
    return base.join(dealt(gradients), AT).join(dealt(theta), AT, "left").join(dealt(thin), AT, "left")


def pooled(planes: DataFrame, *, window: int, stride: int, height: int, width: int, pixel_um: float = 1.0,
           crop: tuple[int, int, int, int] | None = None, least: int | None = None) -> DataFrame:
    """img, iy, ix, partial and the 19 features of each window; null where undefined.

    ``crop`` (x, y, w, h) pools the core of a tile only, whose planes were made
    with its halo. Orientation needs ``least`` fiber pixels, a tenth of a window.
    """
    if crop:
        x0, y0, w, h = crop
        if x0 < 0 or y0 < 0 or w <= 0 or h <= 0 or x0 + w > width or y0 + h > height:
            raise ValueError(f"crop {crop} lies outside of {width} x {height}")
        planes = planes.where(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})
        height, width = h, w
    c, on = F.col, F.col("skeleton").isNotNull()
    of_fiber = lambda e: F.when(F.col("fiber"), e)
    sums = W.window_sums(planes, W.axial_sums(c("theta")) | {
        "area": F.lit(1), "n": c("fiber").cast("long"), "thin": on.cast("long"),
        "junctions": F.coalesce(c("is_junction"), F.lit(False)).cast("long"), "ends": F.coalesce(c("is_endpoint"), F.lit(False)).cast("long"),
        "equivalents": F.coalesce(c("equivalent"), F.lit(0.0)), "w1": F.when(on, c("width")), "w2": F.when(on, c("width") * c("width")),
        "straight": F.coalesce(c("straightness"), F.lit(0.0)), "bent": F.coalesce(c("curvature"), F.lit(0.0)),
        "i1": of_fiber(c("v")), "i2": of_fiber(c("v") * c("v")), "s1": c("v"), "s2": c("v") * c("v"),
        "xx": c("gx") * c("gx"), "yy": c("gy") * c("gy"), "xy": c("gx") * c("gy")}, window=window, stride=stride, height=height, width=width, partial=True)
    angle, order = W.axial_mean(least=W.least_pixels(window) if least is None else least)
    um2 = c("area") * (pixel_um * pixel_um)
    spread = lambda two, one, n: F.sqrt(F.greatest(W.ratio(c(two), c(n)) - W.ratio(c(one), c(n)) * W.ratio(c(one), c(n)), F.lit(0.0)))
    return sums.select(
        "img", "iy", "ix", "partial", c("n").alias("n_fiber_px"), (c("n") / c("area")).alias("coverage_fraction"), order.alias("order_parameter"), angle.alias("mean_angle_deg"),
        (c("thin") * pixel_um / um2).alias("length_um_per_um2"), (c("junctions") / um2).alias("branch_per_um2"), (c("ends") / um2).alias("endpoint_per_um2"),
        (c("equivalents") / um2).alias("segment_equivalents_per_um2"), W.ratio(c("junctions"), c("ends")).alias("branch_to_endpoint_ratio"),
        (W.ratio(c("w1"), c("thin")) * pixel_um).alias("width_mean_um"), F.when(c("thin") > 0, spread("w2", "w1", "thin") * pixel_um).alias("width_sd_um"),
        W.ratio(c("straight"), c("thin")).alias("straightness_mean_lenweighted"), (W.ratio(c("bent"), c("thin")) / pixel_um).alias("curvature_mean_per_um"),
        W.ratio(c("i1"), c("n")).alias("intensity_mean"), F.when(c("n") > 0, spread("i2", "i1", "n")).alias("intensity_sd"),
        (c("s1") / c("area")).alias("signal_density"), spread("s2", "s1", "area").alias("signal_sd"),
        coherence(c("xx"), c("yy"), c("xy"), c("area")).alias("intensity_coherence"), ((c("xx") + c("yy")) / c("area")).alias("gradient_energy"))


def as_images(px: DataFrame, window: int) -> DataFrame:
    """The pixels with each window an image of its own: y and x inside it, img the number of image and window."""
    at = lambda c: F.floor(F.col(c) / window)
    return px.withColumns({"img": F.col("img") * WINDOWS * WINDOWS + at("y") * WINDOWS + at("x"), "y": F.col("y") % window, "x": F.col("x") % window})


def of_windows(found: DataFrame) -> DataFrame:
    """What was found by as_images, with img, iy and ix."""
    return found.withColumns({"iy": F.pmod(F.floor(F.col("img") / WINDOWS), F.lit(WINDOWS)).cast("int"), "ix": F.pmod("img", F.lit(WINDOWS)).cast("int"), "img": F.floor(F.col("img") / (WINDOWS * WINDOWS))})


def window_fractals(px: DataFrame, fiber: Column, skeleton: DataFrame, window: int, fd_boxes: Sequence[int] = (1, 2, 4, 8, 16, 32), lac_boxes: Sequence[int] = (4, 8)) -> DataFrame:
    """img, iy, ix, fractal_dimension (of the skeleton) and lacunarity_k (of the fibers, for each box of side k) of each window.

    Boxes are counted, and slid, inside each window. Boxes larger than the
    window are left out; a dimension needs two sizes at least, and a window
    without a fiber has no lacunarity.
    """
    found = of_windows(as_images(px.select(*AT), window).select("img").distinct())
    boxes = [b for b in fd_boxes if 1 <= b <= window]
    if len(boxes) > 1:
        made = M.box_dimension(as_images(skeleton.select(*AT), window), window, boxes).select("img", F.col("dimension").alias("fractal_dimension"))
        found = found.join(dealt(of_windows(made)), ["img", "iy", "ix"], "left")
    for k in lac_boxes:
        if k <= window:
            made = M.lacunarity(as_images(px.select(*AT, fiber.alias("f")), window), F.col("f"), k).withColumnRenamed("lacunarity", f"lacunarity_{k}")
            found = found.join(dealt(of_windows(made)), ["img", "iy", "ix"], "left")
    return found


def window_morphometrics(px: DataFrame, fiber: Column, window: int, inside: Column | None = None,
                         which: Sequence[str] = ("length", "straightness", "gaps", "curvature")) -> DataFrame:
    """img, iy, ix and the figures asked for of each window of the image's skeleton.

    Branches and ends are those of the whole skeleton and gaps are distances to
    the nearest fiber of the image; curvature is of the fibers traced inside the
    window. A fiber's straightness counts in the window of its centroid.
    """
    cell = lambda y="y", x="x": [F.floor(F.col(y) / window).cast("int").alias("iy"), F.floor(F.col(x) / window).cast("int").alias("ix")]
    inside = F.lit(True) if inside is None else inside
    skeleton = written(T.thinned(px.where(fiber)), "skeleton")
    found = ring_codes(skeleton).groupBy("img", *cell()).agg(
        F.count("*").alias("length_px"), F.count_if("is_junction").alias("branch_points"), F.count_if("is_endpoint").alias("endpoints"))
    if "length" not in which:
        found = found.select("img", "iy", "ix")
    if "straightness" in which:
        shapes = M.path_shapes(R.traced(skeleton), "img")
        found = found.join(dealt(shapes.groupBy("img", *cell("cy", "cx")).agg(F.count("*").alias("n_fibers"), F.percentile("straightness", F.lit(0.5)).alias("straightness_median"))), ["img", "iy", "ix"], "left")
    if "gaps" in which:
        gaps = gap_centers(px, fiber, inside).groupBy("img", *cell()).agg(F.avg("width").alias("gap_mean_px"), F.max("width").alias("gap_max_px"), F.count("*").alias("gap_count"))
        found = found.join(dealt(gaps), ["img", "iy", "ix"], "full")
    if "curvature" in which:
        inner = of_windows(written(R.traced(as_images(skeleton.select(*AT), window)), "inner"))
        bends = M.path_curvature(inner, 4).join(dealt(inner.where("seq = 0").select("fiber", "img", "iy", "ix")), "fiber").groupBy("img", "iy", "ix").agg(F.avg("curvature").alias("mean_curvature_per_px"))
        found = found.join(dealt(bends), ["img", "iy", "ix"], "left")
    return found
