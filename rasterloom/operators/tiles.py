"""Array kernels over images of any size.

No image is one task's. A kernel of a known reach runs tile by tile with a halo
of that reach. What no halo bounds is made of passes: distances go by strips of
columns and then of rows, components by tiles whose labels are joined over the
tiles' borders, and thinning by rounds of a few steps each; tracing is in ``tracing``.
Each gives just what the kernel would on the whole image. A pixel without a row
is neither on nor off, and gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt, written
from . import arrays as A

#: Side of a tile, and the columns or rows of a strip.
TILE, STRIP = 512, 64
#: Places are packed as row * PLACE + column.
PLACE = 1 << 32


def sized(px: DataFrame) -> DataFrame:
    """With _h and _w: an image ends at its own last row and column. Ends, a row an image, are hashed, so that pixels are not sorted for them."""
    ends = px.groupBy("img").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    return px.join(ends.hint("shuffle_hash"), "img")


def _planes(part: pd.DataFrame, columns: Sequence[str], top: int, left: int, shape: tuple[int, int]) -> list[np.ndarray]:
    """A plane of each column, 0 where there is no row, and one of the pixels that have a row."""
    at = part["y"].to_numpy() - top, part["x"].to_numpy() - left
    made = []
    for c in columns:
        values = part[c].to_numpy()
        plane = np.zeros(shape, values.dtype if values.dtype != object else "f8")
        plane[at] = values
        made.append(plane)
    here = np.zeros(shape, bool)
    here[at] = True
    return [*made, here]


def _by_tile(px: DataFrame, columns: Sequence[str], run: Callable[..., pd.DataFrame], schema: str, tile: int, halo: int, to_edge: bool) -> DataFrame:
    """Rows of run(top, left, own, *planes, here) of each tile: ``own`` is the tile's part of the planes, whose first pixel is (top, left).

    Planes end at the image's edge with ``to_edge``, else at the last pixel that
    has a row; a halo never goes beyond an edge.
    """
    if halo:
        over = lambda at: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(at) - halo) / tile).cast("int")), F.floor((F.col(at) + halo) / tile).cast("int")))
        names = ["img", "y", "x", *columns]
        spread = (sized(px.select(*names)) if to_edge else px.select(*names)).withColumn("_ty", over("y")).withColumn("_tx", over("x"))
    else:
        spread = px.select("img", "y", "x", *columns).withColumns({"_ty": F.floor(F.col("y") / tile).cast("int"), "_tx": F.floor(F.col("x") / tile).cast("int")})
        spread = sized(spread) if to_edge else spread

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        img, ty, tx = (int(k) for k in key)
        top, left = max(0, ty * tile - halo), max(0, tx * tile - halo)
        h, w = (int(part["_h"].iloc[0]), int(part["_w"].iloc[0])) if to_edge else (int(part["y"].max()) + 1, int(part["x"].max()) + 1)
        shape = min(h, (ty + 1) * tile + halo) - top, min(w, (tx + 1) * tile + halo) - left
        own = slice(ty * tile - top, (ty + 1) * tile - top), slice(tx * tile - left, (tx + 1) * tile - left)
        made = run(top, left, own, *_planes(part, columns, top, left, shape))
        made.insert(0, "img", img)
        return made

    return spread.groupBy("img", "_ty", "_tx").applyInPandas(one, f"img long, {schema}")


def per_tile(px: DataFrame, columns: Sequence[str], f: Callable[..., dict[str, np.ndarray]], schema: str, *, halo: int = 0, tile: int = TILE, to_edge: bool = True) -> DataFrame:
    """img, y, x and f's planes (``schema`` lists them) at every pixel; f gets a plane for each column and one of the pixels that have a row.

    Right if a pixel's result depends on nothing beyond ``halo`` pixels. Without
    ``to_edge`` everything beyond the rows given counts as 0.
    """
    def run(top: int, left: int, own: tuple[slice, slice], *planes: np.ndarray) -> pd.DataFrame:
        mine = np.zeros(planes[-1].shape, bool)
        mine[own] = planes[-1][own]
        y, x = np.nonzero(mine)
        made = f(*planes) if len(y) else {n: np.zeros(mine.shape) for n in names}
        return pd.DataFrame({"y": (y + top).astype("i4"), "x": (x + left).astype("i4")} | {n: made[n][mine] for n in names})

    names = [part.split()[0] for part in schema.split(",")]
    return _by_tile(px, columns, run, f"y int, x int, {schema}", tile, halo, to_edge)


def distances(px: DataFrame, target: Column, carried: Sequence[str] = ()) -> DataFrame:
    """img, y, x, d and the columns carried (without nulls): the exact distance of each pixel to the nearest one where ``target`` holds; infinite in an image without one.

    Strips of columns give the distances along columns, strips of rows the least
    of (column distance)^2 + (offset)^2. A task holds 64 columns or rows at once.
    """
    rows = px.select("img", "y", "x", F.coalesce(target, F.lit(False)).alias("t"), *carried, *(c for c in ("_h", "_w") if c in px.columns))
    rows = rows if "_h" in rows.columns else sized(rows)
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for c in carried for f in [rows.schema[c]])

    def down(part: pd.DataFrame) -> pd.DataFrame:
        left, h = int(part["x"].min()), int(part["_h"].iloc[0])
        t, *others, here = _planes(part, ["t", *carried], 0, left, (h, int(part["x"].max()) - left + 1))
        column = A.along_columns(t.astype(bool))
        y, x = np.nonzero(here | np.isfinite(column))
        return pd.DataFrame({"img": part["img"].iloc[0], "y": y.astype("i4"), "x": (x + left).astype("i4"), "c": column[y, x], "here": here[y, x]} | {c: o[y, x] for c, o in zip(carried, others)})

    def across(part: pd.DataFrame) -> pd.DataFrame:
        top = int(part["y"].min())
        c = np.full((int(part["y"].max()) - top + 1, int(part["x"].max()) + 1), np.inf)
        c[part["y"] - top, part["x"]] = part["c"]
        d = A.across_rows(c)
        part = part[part["here"]]
        return pd.DataFrame({"img": part["img"], "y": part["y"], "x": part["x"], "d": d[part["y"] - top, part["x"]]} | {c: part[c] for c in carried})

    columns = rows.groupBy("img", F.floor(F.col("x") / STRIP).alias("_s")).applyInPandas(down, f"img long, y int, x int, c double, here boolean{types}")
    return columns.groupBy("img", F.floor(F.col("y") / STRIP).alias("_s")).applyInPandas(across, f"img long, y int, x int, d double{types}")


def joined_labels(edges: DataFrame) -> DataFrame:
    """img, label, root: the smallest label that each label of ``edges`` (img, a, b) is joined to.

    In each round labels move to their neighbor of smallest hash and edges with
    them, until no edge is left; what is joined stays so. By hash, and not by
    place, a long chain loses a share of its labels each round, so that rounds
    grow with the logarithm. They are written to the shared folder.
    """
    named = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("label")).alias(c)
    tidy = lambda e: e.where("a != b").select("img", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(tidy(edges.select("img", named("a"), named("b"))), "edges")
    at = edges.select("img", F.col("a.label").alias("label"), F.col("a").alias("at")).union(edges.select("img", "b.label", "b")).distinct()
    while not edges.isEmpty():
        both = edges.union(edges.select("img", F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy("img", "a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "moves")
        at = written(at.join(dealt(moves.withColumnRenamed("a", "at")), ["img", "at"], "left").select("img", "label", F.coalesce("to", "at").alias("at")), "moved")
        for end in ("a", "b"):
            edges = edges.join(dealt(moves.select("img", F.col("a").alias(end), "to")), ["img", end]).withColumn(end, F.col("to")).drop("to")
        edges = written(tidy(edges), "edges")
    roots = at.groupBy("img", "at").agg(F.min("label").alias("root"))
    return at.join(dealt(roots), ["img", "at"]).select("img", "label", "root")


def components(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """img, y, x, label of the pixels of a sparse mask (img, y, x): the packed place of each component's first pixel in row order.

    Tiles are labelled alone; only pixels at their borders are joined, and only
    labels that meet there are contracted.
    """
    def run(top: int, left: int, own: tuple[slice, slice], here: np.ndarray) -> pd.DataFrame:
        label = A.components(here, diagonal)
        y, x = np.nonzero(here)
        ly, lx = np.divmod(label[y, x] - 1, here.shape[1])
        return pd.DataFrame({"y": (y + top).astype("i4"), "x": (x + left).astype("i4"), "label": (ly + top).astype("i8") * PLACE + lx + left})

    local = written(_by_tile(mask, [], run, "y int, x int, label long", tile, 0, False), "labels")
    at_border = lambda c: (F.col(c) % tile).isin(0, tile - 1)
    border = local.where(at_border("y") | at_border("x"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    told = border.select("img", F.col("label").alias("a"), "y", "x", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))).alias("o"))
    told = told.select("img", "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    roots = joined_labels(told.join(dealt(border.withColumnRenamed("label", "b")), ["img", "y", "x"]).select("img", "a", "b"))
    return local.join(dealt(roots), ["img", "label"], "left").select("img", "y", "x", F.coalesce("root", "label").alias("label"))


def without_small(mask: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """img, y, x of the components of ``least`` pixels at least."""
    label = components(mask, tile=tile)
    large = label.groupBy("img", "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return label.join(dealt(large), ["img", "label"], "left_semi").select("img", "y", "x")


def filled(px: DataFrame, mask: Column, tile: int = TILE) -> DataFrame:
    """img, y, x, region: the mask with its holes, which are what of the rest does not reach the image's edge."""
    rows = written(sized(px.select("img", "y", "x", F.coalesce(mask, F.lit(False)).alias("region"))), "region")
    rest = components(rows.where("NOT region"), tile=tile)
    edge = rows.where("y = 0 OR x = 0 OR y = _h - 1 OR x = _w - 1").select("img", "y", "x")
    outside = rest.join(dealt(edge), ["img", "y", "x"], "left_semi").select("img", "label").distinct()
    holes = rest.join(dealt(outside), ["img", "label"], "left_anti").select("img", "y", "x", F.lit(True).alias("_hole"))
    return rows.join(dealt(holes), ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("_hole", "region").alias("region"))


def zones(px: DataFrame, mask: Column, reach: float, tile: int = TILE) -> DataFrame:
    """img, y, x, whole, outside (0 < distance <= reach), inside and both: which zones of the filled mask each pixel is in."""
    region = written(filled(px, mask, tile), "filled")
    near = lambda target, name: distances(region, target).select("img", "y", "x", ((F.col("d") > 0) & (F.col("d") <= max(1.0, reach))).alias(name))
    found = region.withColumnRenamed("region", "whole").join(dealt(near(F.col("region"), "outside")), ["img", "y", "x"]).join(dealt(near(~F.col("region"), "inside")), ["img", "y", "x"])
    return found.withColumn("both", F.col("outside") | F.col("inside"))


def zone(px: DataFrame, mask: Column, mode: str, reach: float, tile: int = TILE) -> DataFrame:
    """img, y, x of one zone of the filled mask."""
    if mode not in ("whole", "outside", "inside", "both"):
        raise ValueError(f"unknown zone mode {mode}")
    if mode in ("whole", "both"):
        return zones(px, mask, reach, tile).where(mode).select("img", "y", "x")
    region = written(filled(px, mask, tile), "filled")
    found = distances(region, F.col("region") if mode == "outside" else ~F.col("region"))
    return found.where((F.col("d") > 0) & (F.col("d") <= max(1.0, reach))).drop("d")


def thinned(mask: DataFrame, tile: int = TILE, steps: int = 8) -> DataFrame:
    """img, y, x of the skeleton of a sparse mask: rounds of ``steps`` peelings, each of which reaches two pixels, until none peels anything."""
    def peel(here: np.ndarray) -> dict[str, np.ndarray]:
        before = A.thinned(here, steps - 1)
        after = A.thinned(before, 1)
        return {"kept": after, "moved": before != after}

    while True:
        found = written(per_tile(mask, [], peel, "kept boolean, moved boolean", halo=2 * steps, tile=tile, to_edge=False), "thinned")
        mask = found.where("kept").select("img", "y", "x")
        if found.where("moved").isEmpty():
            return mask


def orientation(px: DataFrame, value: str, mask: str, tile: int = TILE) -> DataFrame:
    """img, y, x, theta in degrees of the pixels of the mask."""
    found = per_tile(px, [value, mask], lambda g, m, here: {"theta": A.orientation(g, m.astype(bool))}, "theta double", halo=22, tile=tile)
    # Undefined angles of planes arrive as nulls.
    return found.where("theta IS NOT NULL AND NOT isnan(theta)")


def ridges(px: DataFrame, value: str, sigmas: Sequence[float], kinds: Sequence[str] = ("sato",), dark: bool = False, tile: int = TILE) -> DataFrame:
    """img, y, x and the response of each kind of ridge filter."""
    found = lambda g, here: {k: A.ridges(g.astype("f8"), list(sigmas), k, dark) for k in kinds}
    return per_tile(px, [value], found, ", ".join(f"{k} double" for k in kinds), halo=int(4 * max(sigmas) + 0.5) + 3, tile=tile)


def gradients(px: DataFrame, value: str, sigma: float = 0.0, tile: int = TILE) -> DataFrame:
    """img, y, x, gy, gx by the Scharr kernel, smoothed before if sigma says so; 0 beside a pixel without a row."""
    def run(g: np.ndarray, here: np.ndarray) -> dict[str, np.ndarray]:
        gy, gx = A.scharr(A.gaussian(g, sigma) if sigma else g)
        known = A.whole_rings(here)
        return {"gy": np.where(known, gy, 0.0), "gx": np.where(known, gx, 0.0)}
    return per_tile(px, [value], run, "gy double, gx double", halo=int(4 * sigma + 0.5) + 1, tile=tile)


def rolling_ball(px: DataFrame, value: str, radius: int, tile: int = TILE) -> DataFrame:
    """img, y, x and the value less its background, the opening by the disk of that radius."""
    return per_tile(px, [value], lambda g, here: {value: A.rolling_ball(g, radius, here)}, f"{value} double", halo=2 * radius, tile=tile)
