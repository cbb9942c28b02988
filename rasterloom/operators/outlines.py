"""Outlines of the objects of a mask, as tables of rings and of their corners.

A side of a pixel that has no mask beyond it is an edge, gone along with the
pixel on the right. After an edge comes the one that keeps to the same pixel,
else the one straight ahead, else the one to the left; so pixels that meet at a
corner only are different objects, and holes go round such corners. Each edge
has one successor, which the eight pixels around it tell. Tiles put their edges
together to chains; chains that leave a tile are ranked over tiles by doubling,
so that neither an image nor a ring is one task's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import tiles as T

#: Sides of a pixel in their order (top, right, bottom, left): the step along each, the step out, and the corner it starts at.
ALONG = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])
START = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])
CHAIN_SCHEMA = "id long, nxt long, best long, before int, n int, edges long, area long, points array<long>"
NONE = np.iinfo("i8").max


def _ends(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each edge the last one that it comes to, the edges up to there, and the smallest on the way (in a circle: of the circle)."""
    own = np.arange(len(nxt))
    jump, far, least = np.where(nxt < 0, own, nxt), (nxt >= 0).astype("i8"), own.copy()
    for _ in range(max(1, len(nxt)).bit_length()):
        far += far[jump]
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    return jump, far, least


def _chains(here: np.ndarray, own: tuple[slice, slice], top: int, left: int) -> pd.DataFrame:
    """The chains of a tile's edges: whole rings, and what goes on in another tile (nxt >= 0: with that edge).

    best is the place of the chain's first top side by row and column, before
    the corners of the chain that come before it, area the rows that bottom
    sides lie below top ones, summed up.
    """
    mask = np.pad(here, 1)
    mine = np.zeros(mask.shape, bool)
    mine[1:-1, 1:-1][own] = here[own]
    found = [np.nonzero(mine & ~np.roll(mask, tuple(-OUT[s]), (0, 1))) for s in range(4)]
    y, x = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    side = np.repeat(np.arange(4), [len(f[0]) for f in found])
    if not len(y):
        return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in CHAIN_SCHEMA.split(", ")})
    along, out = ALONG[side].T, OUT[side].T
    ahead, beyond = mask[y + along[0], x + along[1]], mask[y + along[0] + out[0], x + along[1] + out[1]]
    corner = ~mask[y - along[0], x - along[1]] | mask[y - along[0] + out[0], x - along[1] + out[1]]
    turn = np.where(~ahead, 1, np.where(beyond, 3, 0))
    to = (side + turn) % 4, y + np.where(ahead, along[0], 0) + np.where(ahead & beyond, out[0], 0), x + np.where(ahead, along[1], 0) + np.where(ahead & beyond, out[1], 0)
    number = np.full((4, *mask.shape), -1)
    number[side, y, x] = np.arange(len(y))
    nxt = number[to]
    key = lambda s, r, c: ((r + (top - 1)) * T.PLACE + c + (left - 1)) * 4 + s
    last, _, least = _ends(nxt)
    circle = nxt[last] >= 0
    nxt = np.where(circle & (nxt == least), -1, nxt)
    last, far, _ = _ends(nxt)
    order = np.lexsort((-far, last))
    side, y, x, corner, circle, last, (ts, ty, tx) = side[order], y[order], x[order], corner[order], circle[order], last[order], (t[order] for t in to)
    start = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
    end = np.r_[start[1:], len(last)]
    place = np.where(side == 0, (y + (top - 1)) * T.PLACE + x + (left - 1), NONE)
    best = np.minimum.reduceat(place, start)
    corners = np.r_[0, np.cumsum(corner)]
    at = np.flatnonzero(place == np.repeat(best, end - start))
    before = np.zeros(len(start), "i8")
    chain = np.searchsorted(start, at, "right") - 1
    before[chain] = corners[at] - corners[start[chain]]
    points = ((y + (top - 1) + START[side, 0]) * T.PLACE + x + (left - 1) + START[side, 1])[corner]
    rows = np.where(side == 2, y + top, np.where(side == 0, -(y + (top - 1)), 0))
    return pd.DataFrame({
        "id": key(side, y, x)[start], "nxt": np.where(circle[start], -1, key(ts, ty, tx)[end - 1]), "best": best, "before": before.astype("i4"),
        "n": (corners[end] - corners[start]).astype("i4"), "edges": end - start, "area": np.add.reduceat(rows, start),
        "points": pd.Series(np.split(points, corners[start[1:]]), dtype=object)})


def _over_tiles(open_chains: DataFrame) -> DataFrame:
    """img, id, ring, skip (the ring's corners from its first chain up to this one) and total of chains that go on in other tiles."""
    own = open_chains.select("img", "id", "nxt", "best", F.col("n").cast("long").alias("n"))
    then = lambda t, *names: t.select(F.col("img").alias("_img"), F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in names))
    after = lambda t, other: t.join(other, [F.col("img") == F.col("_img"), F.col("jump") == F.col("_id")], "left")
    # The ring's first top side: the least over 1, 2, 4, ... chains, until it changes nowhere.
    t = written(own.select("img", "id", F.col("nxt").alias("jump"), "best", F.lit(True).alias("moved")), "rings")
    while not t.where("moved").isEmpty():
        t = written(after(t, then(t, "jump", "best")).select(
            "img", "id", F.col("_jump").alias("jump"), F.least("best", "_best").alias("best"), (F.col("_best") < F.col("best")).alias("moved")), "rings")
    ring = written(own.join(t.select("img", "id", F.col("best").alias("ring")), ["img", "id"]), "ring-of")
    # Corners from each chain to the ring's end, which is before the chain that has that side.
    first = then(ring.where("best = ring"))
    t = written(after(ring.withColumn("jump", F.col("nxt")), first).select(
        "img", "id", F.when(F.col("_id").isNull(), F.col("jump")).alias("jump"), F.col("n").alias("rest")), "rest")
    while not t.where("jump IS NOT NULL").isEmpty():
        t = written(after(t, then(t, "jump", "rest")).select(
            "img", "id", F.col("_jump").alias("jump"), (F.col("rest") + F.coalesce("_rest", F.lit(0))).alias("rest")), "rest")
    ranked = ring.join(t.select("img", "id", "rest"), ["img", "id"])
    totals = ranked.where("best = ring").select("img", "ring", F.col("rest").alias("total"))
    return ranked.join(totals, ["img", "ring"]).select("img", "id", "ring", (F.col("total") - F.col("rest")).alias("skip"), "total")


def chains(mask: DataFrame, tile: int = T.TILE) -> DataFrame:
    """Chains of edges of a sparse mask (img, y, x) with their ring: the packed place of its first top side's pixel.

    A mask without pixels has none. Rows of the same pixel count once.
    """
    def run(top: int, left: int, own: tuple[slice, slice], here: np.ndarray) -> pd.DataFrame:
        return _chains(here, own, top, left)

    found = written(T._by_tile(mask.select("img", "y", "x"), [], run, CHAIN_SCHEMA, tile, 1, False), "chains")
    whole = found.where("nxt < 0").select("*", F.col("best").alias("ring"), F.lit(0).cast("long").alias("skip"), F.col("n").cast("long").alias("total"))
    going = found.where("nxt >= 0")
    if going.isEmpty():
        return whole
    return whole.unionByName(written(going.join(_over_tiles(going), ["img", "id"]), "whole-chains"))


def ring_points(found: DataFrame) -> DataFrame:
    """img, ring, at (from 0), y, x: the corners of each ring of ``chains``, with the object on the right, from the left end of its first top side."""
    first = found.where("best = ring").select("img", "ring", F.col("before").alias("_before"))
    corners = found.join(first, ["img", "ring"]).select("img", "ring", "skip", "total", "_before", F.posexplode("points").alias("i", "p"))
    return corners.select("img", "ring", F.pmod(F.col("skip") + F.col("i") - F.col("_before"), F.col("total")).alias("at"),
                          F.shiftright("p", 32).alias("y"), (F.col("p") % T.PLACE).alias("x"))


def rings(found: DataFrame, mask: DataFrame, tile: int = T.TILE) -> DataFrame:
    """img, ring, blob (the label of its component), outer, corners, edges and area (in pixels, of a hole: the hole's) of each ring."""
    each = found.groupBy("img", "ring").agg(F.sum("n").alias("corners"), F.sum("edges").alias("edges"), F.sum("area").alias("_area"))
    label = T.components(mask, tile=tile).select("img", (F.col("y") * F.lit(T.PLACE) + F.col("x")).alias("ring"), F.col("label").alias("blob"))
    return each.join(label, ["img", "ring"]).select("img", "ring", "blob", (F.col("_area") > 0).alias("outer"), "corners", "edges", F.abs("_area").alias("area"))


def detections(found_rings: DataFrame, pixel_um: float | None = None, least_um2: float = 0.0, downsample: float = 1.0) -> DataFrame:
    """img, blob, holes, perimeter and area_px (in pixels of the image, ``downsample`` to one of the mask) and area_um2 of each object.

    Without a pixel size the area in um2 is null and nothing is dropped; else
    objects below ``least_um2`` are.
    """
    sign = F.when(F.col("outer"), F.col("area")).otherwise(-F.col("area"))
    each = found_rings.groupBy("img", "blob").agg(
        F.count_if(~F.col("outer")).alias("holes"), (F.sum("edges") * downsample).alias("perimeter"), (F.sum(sign) * downsample ** 2).alias("area_px"))
    known = pixel_um is not None and pixel_um > 0
    each = each.withColumn("area_um2", F.col("area_px") * pixel_um ** 2 if known else F.lit(None).cast("double"))
    return each.where(F.col("area_um2") >= least_um2) if known and least_um2 > 0 else each
