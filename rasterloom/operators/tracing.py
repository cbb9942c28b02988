"""Paths along skeletons, as tables.

A skeleton's nodes are its junctions and its ends. A walk leaves a node by one
step and always takes the step that goes on most nearly straight, up to the
next node: a link. What a walk does next depends only on its last two steps and
on the pixels around, so a table of turns (last step, step before, ring of
neighbors) gives it.

- ``links``: all walks of a tile move on together, a step a round; a walk that
  leaves its tile ends there with the state in which the tile beyond takes it
  up. Such pieces are put together by doubling, in rounds by the logarithm of
  the tiles that a link crosses; where no walk leaves its tile there is none.
- ``partners``: the ends that meet at a junction are paired most nearly opposite
  first, in one row a junction, of which a pixel has at most eight.
- ``fibers``: chains of paired links are put together by the same doubling.

So no image, component or network is one task's or one group's: only a tile is,
and a path is one row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dealt, written
from . import arrays as A
from . import tiles as T

STEP = np.array(A.STEPS)
#: The step back, and no step.
BACK = np.array([A.STEPS.index((-dy, -dx)) for dy, dx in A.STEPS])
NONE = 8


def _turns() -> np.ndarray:
    """The step to take by last step, step from the last pixel to the one before it, and neighbors (a bit a step); NONE where there is none.

    Neither of the two pixels before is gone to again.
    """
    table = np.full((8, 9, 256), NONE, "u1")
    bits = np.arange(256)
    for last in range(8):
        straight = STEP @ STEP[last]
        for before in range(9):
            shut = {int(BACK[last])}
            if before != NONE:
                shut |= {j for j in range(8) if (STEP[last] + STEP[j] == STEP[before]).all()}
            for j in sorted(set(range(8)) - shut, key=lambda j: (straight[j], -j)):  # the straightest is set last
                table[last, before, (bits >> j) & 1 == 1] = j
    return table


TURNS = _turns()


def neighbors(skeleton: np.ndarray) -> np.ndarray:
    """A bit for each step that leads to a pixel of the skeleton."""
    h, w = skeleton.shape
    p = np.pad(skeleton, 1).astype("i4")
    return sum(p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w] << k for k, (dy, dx) in enumerate(A.STEPS))


def junctions(skeleton: np.ndarray) -> np.ndarray:
    """Pixels with three changes around the ring at least."""
    around = A.ring(skeleton)
    return skeleton & (sum((around[k] == 0) & (around[(k + 1) % 8] == 1) for k in range(8)) >= 3)


def _pieces(skeleton: np.ndarray, own: tuple[slice, slice], top: int, left: int) -> pd.DataFrame:
    """The walks that start in a tile or come into it, as far as they stay in it.

    y, x, before, step: the state that names the walk; ny, nx, nbefore, nstep:
    the state in which it leaves; ey, ex, eback: its last pixel and the step
    back from there; head, tail: 2 for a junction, 1 for an end, 0 otherwise;
    points: row * PLACE + column of its pixels; other, oy, ox, oback, otail: what
    comes instead of its last pixel if that is the node that the walk left.
    """
    around = neighbors(skeleton)
    cross = junctions(skeleton)
    count = sum((around >> k) & 1 for k in range(8))
    node = np.where(cross, 2, np.where(skeleton & (count <= 1), 1, 0))
    core = np.zeros(skeleton.shape, bool)
    core[own] = True
    inside = np.pad(core, 1)  # a step may lead out of the plane
    # Starts: each step of each node of the core.
    py, px = np.nonzero(core & (node > 0))
    states = [(py[on], px[on], np.full(on.sum(), NONE), np.full(on.sum(), k)) for k in range(8) for on in [(around[py, px] >> k) & 1 == 1]]
    # Walks that come in: from each pixel outside, by each step into the core, after each step that may have been before.
    for k in range(8):
        oy, ox = np.nonzero(skeleton & ~core & ((around >> k) & 1 == 1))
        into = inside[oy + STEP[k][0] + 1, ox + STEP[k][1] + 1]
        oy, ox = oy[into], ox[into]
        into = node[oy + STEP[k][0], ox + STEP[k][1]] == 0
        oy, ox = oy[into], ox[into]
        for before in range(9):
            may = node[oy, ox] > 0 if before == NONE else (node[oy, ox] == 0) & ((around[oy, ox] >> before) & 1 == 1) & (before != k)
            states.append((oy[may], ox[may], np.full(may.sum(), before), np.full(may.sum(), k)))
    y, x, before, step = (np.concatenate(c).astype("i8") for c in zip(*states))
    n = len(y)
    starts = core[y, x]
    made = pd.DataFrame({"y": y + top, "x": x + left, "before": before, "step": step, "starts": starts, "head": node[y, x]})

    def walk(y: np.ndarray, x: np.ndarray, before: np.ndarray, step: np.ndarray, home: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Points, leaving states, last pixels (row, column, step back, step, and those before) and their kinds, of walks on from these states; none steps on its home (row, column)."""
        who, was = np.arange(len(y)), np.full(len(y), NONE)
        leaves, last, tail = np.full((len(y), 4), -1), np.full((len(y), 6), -1), np.zeros(len(y), "i8")
        walked = [(who[:0], y[:0], x[:0])]
        for _ in range(int(skeleton.sum()) + 2):
            if not len(who):
                break
            cy, cx = y + STEP[step, 0], x + STEP[step, 1]
            out = ~inside[cy + 1, cx + 1] & (node[cy, cx] == 0)  # a node beyond the border is within sight
            leaves[who[out]] = np.stack([y[out], x[out], before[out], step[out]], 1)
            last[who[out], :2] = np.stack([y[out], x[out]], 1)
            who, cy, cx, before, step, was = who[~out], cy[~out], cx[~out], before[~out], step[~out], was[~out]
            walked.append((who, cy, cx))
            ring = around[cy, cx]
            dy, dx = home[who, 0] - cy, home[who, 1] - cx
            for j in range(8):
                ring = np.where((dy == STEP[j][0]) & (dx == STEP[j][1]), ring & ~(1 << j), ring)
            turn = np.where(node[cy, cx] > 0, NONE, TURNS[step, before, ring])
            done = turn == NONE
            last[who[done]] = np.stack([cy[done], cx[done], BACK[step[done]], step[done], before[done], was[done]], 1)
            tail[who[done]] = node[cy[done], cx[done]]
            on = ~done
            who, y, x, was, before, step = who[on], cy[on], cx[on], before[on], BACK[step[on]], turn[on].astype("i8")
        who, y, x = (np.concatenate(c) for c in zip(*walked))
        order = np.argsort(who, kind="stable")
        places = (y + top)[order] * T.PLACE + (x + left)[order]
        cuts = np.searchsorted(who[order], np.arange(len(leaves) + 1))
        points = [places[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        for i, p in enumerate(points):
            if len(set(p)) < len(p):  # a walk ends before the first of its own pixels
                had: set = set()
                points[i] = p[:next(k for k, q in enumerate(p) if q in had or had.add(q))]
                leaves[i], tail[i] = -1, 0
                last[i, :3] = points[i][-1] // T.PLACE - top, points[i][-1] % T.PLACE - left, -1
        return points, leaves, last, tail

    # A walk does not come back to the node that it left.
    points, leaves, last, tail = walk(y, x, before, step, np.where(starts[:, None], np.stack([y, x], 1), -9))
    first = ((y + top) * T.PLACE + x + left).tolist()
    made["points"] = pd.Series([[f, *p] if s else p for f, p, s in zip(first, points, starts)], dtype=object)
    # One that comes in does not know what it left: how it ends if it left the node that it comes to.
    known = np.flatnonzero(~starts & (tail > 0) & np.array([len(p) > 1 for p in points], bool))
    other, other_last, other_tail = [None] * len(points), np.full((len(points), 3), -1), np.zeros(len(points), "i8")
    if len(known):
        ey, ex, back, step, before, was = last[known].T
        py, px = ey + STEP[back, 0], ex + STEP[back, 1]
        turn = TURNS[BACK[before], was, around[py, px] & ~(1 << step)].astype("i8")
        other_last[known] = np.stack([py, px, before], 1)
        on = turn != NONE
        again, _, end, kind = walk(py[on], px[on], before[on], turn[on], np.stack([ey, ex], 1)[on])
        other_last[known[on]], other_tail[known[on]] = end[:, :3], kind
        for i in known:
            other[i] = []
        for i, p in zip(known[on], again):
            other[i] = p
    made["other"] = pd.Series(other, dtype=object)
    made[["oy", "ox", "oback"]] = other_last + np.array([top, left, 0])
    made["otail"] = other_tail
    made[["ny", "nx", "nbefore", "nstep"]] = np.where(leaves >= 0, leaves + np.array([top, left, 0, 0]), -1)
    made[["ey", "ex", "eback"]] = last[:, :3] + np.array([top, left, 0])
    made["tail"] = tail
    return made


STATE = ["y", "x", "before", "step"]
PIECE_SCHEMA = ("y long, x long, before long, step long, starts boolean, head long, points array<long>, ny long, nx long, nbefore long, nstep long, "
                "ey long, ex long, eback long, tail long, other array<long>, oy long, ox long, oback long, otail long")


def _chained(heads: DataFrame, hops: DataFrame, key: list[str], ahead: list[str], joined: str, carried: list[str], name: str) -> DataFrame:
    """heads with the hops that follow each put to its array ``joined``: by doubling, so in rounds by the logarithm of the longest chain.

    A row goes on to the hop whose ``key`` is its ``ahead`` (null: to none) and
    then has that one's ``carried``. A chain that comes to a hop that it has
    had ends there, so that circles end.
    """
    own = F.array(F.struct(*(F.col(k) for k in key)))
    heads, hops = written(heads.withColumn("seen", F.slice(own, 1, 0)), name), written(hops.withColumn("seen", own), name)
    ready = []
    while True:
        going = heads.where(f"{ahead[0]} IS NOT NULL")
        ready.append(heads.where(f"{ahead[0]} IS NULL"))
        if going.isEmpty():
            whole = ready[0]
            for df in ready[1:]:
                whole = whole.union(df)
            return whole.drop("seen")
        then = hops.select(F.col("img").alias("_img"), *(F.col(k).alias(f"_{k}") for k in key), *(F.col(c).alias(f"then_{c}") for c in (*ahead, joined, *carried, "seen")))

        def on(df: DataFrame) -> DataFrame:
            met = df.join(dealt(then), [F.col("img") == F.col("_img"), *(F.col(a) == F.col(f"_{k}") for a, k in zip(ahead, key))], "left").drop("_img", *(f"_{k}" for k in key))
            found = F.col("then_seen").isNotNull()
            again = F.arrays_overlap("seen", "then_seen") | F.coalesce(F.array_contains(F.concat("seen", "then_seen"), F.struct(*(F.col(f"then_{a}").alias(k) for a, k in zip(ahead, key)))), F.lit(False))
            return met.select(*(F.when(found, F.concat(c, f"then_{c}")).otherwise(F.col(c)).alias(c) if c in (joined, "seen")
                                else F.when(found & ~again, F.col(f"then_{c}")).alias(c) if c in ahead
                                else F.when(found, F.col(f"then_{c}")).otherwise(F.col(c)).alias(c) if c in carried else F.col(c) for c in df.columns))

        heads, hops = written(on(going), name), written(on(hops), name)


def links(skeleton: DataFrame, tile: int = T.TILE) -> DataFrame:
    """img, y, x, step (the node and step by which it starts), head, tail (2: a junction, 1: an end, 0: neither), ey, ex and points of each link.

    A link is walked from the end that comes first by row, column and step; a
    link that goes round and comes to its own start ends one pixel before it,
    and is walked either way round. Pixels of a ring without a node are in none.
    """
    def run(top: int, left: int, own: tuple[slice, slice], here: np.ndarray) -> pd.DataFrame:
        return _pieces(here, own, top, left)

    pieces = written(T._by_tile(skeleton.select("img", "y", "x"), [], run, PIECE_SCHEMA, tile, 2, False), "pieces")
    ahead = ["ny", "nx", "nbefore", "nstep"]
    pieces = pieces.withColumns({c: F.when(F.col("ny") >= 0, F.col(c)) for c in ahead})
    whole = pieces.where("starts")
    if not whole.where("ny IS NOT NULL").isEmpty():
        whole = _chained(whole, pieces.where("NOT starts"), STATE, ahead, "points", ["ey", "ex", "eback", "tail", "other", "oy", "ox", "oback", "otail"], "pieces")
        home = (F.col("ey") == F.col("y")) & (F.col("ex") == F.col("x")) & (F.size("points") > 1)
        short = F.slice("points", F.lit(1), F.size("points") - 1)
        whole = whole.withColumns({"points": F.when(home, F.concat(short, F.coalesce("other", F.array().cast("array<long>")))).otherwise(F.col("points")),
                                   **{e: F.when(home, F.when(F.col("other").isNotNull(), F.col(o)).otherwise(-1)).otherwise(F.col(e)) for e, o in (("ey", "oy"), ("ex", "ox"), ("eback", "oback"), ("tail", "otail"))}})
        # Back on its own pixels: up to the one before these.
        again = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("points"))), lambda i: F.array_position("points", F.get("points", i - 1)) < i)
        until = F.when(F.size(F.array_distinct("points")) < F.size("points"), again[0] - 1)
        whole = whole.withColumn("until", until).withColumns({
            "points": F.when(F.col("until").isNull(), F.col("points")).otherwise(F.slice("points", F.lit(1), F.col("until"))), "tail": F.when(F.col("until").isNull(), F.col("tail")).otherwise(0)})
    whole = written(whole.select("img", "y", "x", "step", "head", "tail", "ey", "ex", "eback", "points"), "walks")
    # The same link from its other end goes; what would go on account of a walk that goes itself stays.
    once = _unless_met(whole, whole)
    return _unless_met(whole, once).drop("eback")


def _unless_met(walks: DataFrame, others: DataFrame) -> DataFrame:
    """The walks of which no earlier one of the others comes in by the step by which they go out."""
    order = F.struct("y", "x", "step")
    first = others.where("tail > 0").groupBy("img", F.col("ey").alias("y"), F.col("ex").alias("x"), F.col("eback").alias("step")).agg(F.min(order).alias("earlier"))
    return walks.join(dealt(first), ["img", "y", "x", "step"], "left").where(F.col("earlier").isNull() | (F.col("earlier") >= order)).drop("earlier")


def _row(place: Column) -> Column:
    return F.floor(place / T.PLACE)


def _column(place: Column) -> Column:
    return F.pmod(place, F.lit(T.PLACE))


def partners(found: DataFrame, most_turn: float = 70.0, reach: int = 8) -> DataFrame:
    """img, y, x, step, side, and py, px, pstep, pside: which end of a link (0: its start) goes on as which.

    At each junction the two ends of two links that are most nearly opposite
    are paired, up to ``most_turn`` degrees off straight, then the next two that
    are left. An end's direction is that of its first ``reach`` pixels. Ties go
    by the links' order.
    """
    size = F.size("points")
    near = F.least(F.lit(reach), size)

    def end(side: int, node: Column, kind: str) -> Column:
        at, to = (F.element_at("points", 1), F.element_at("points", near)) if side == 0 else (F.element_at("points", -1), F.element_at("points", -near))
        dy, dx = (_row(to) - _row(at)).cast("double"), (_column(to) - _column(at)).cast("double")
        long = F.sqrt(dy * dy + dx * dx)
        return F.struct(node.alias("node"), (F.col(kind) == 2).alias("meets"), F.lit(side).alias("side"),
                        F.coalesce(F.try_divide(dy, long), F.lit(0.0)).alias("dy"), F.coalesce(F.try_divide(dx, long), F.lit(0.0)).alias("dx"))

    ends = found.select("img", "y", "x", "step", F.explode(F.array(end(0, F.element_at("points", 1), "head"), end(1, F.element_at("points", -1), "tail"))).alias("e"))
    ends = ends.where("e.meets").select("img", "e.node", F.struct("y", "x", "step", "e.side", "e.dy", "e.dx").alias("e"))
    meeting = ends.groupBy("img", "node").agg(F.sort_array(F.collect_list("e")).alias("ends"))
    own = lambda e: F.struct(e["y"].alias("y"), e["x"].alias("x"), e["step"].alias("step"))
    name = lambda e: F.struct(e["y"].alias("y"), e["x"].alias("x"), e["step"].alias("step"), e["side"].alias("side"))
    pairs = F.flatten(F.transform("ends", lambda a: F.transform(F.filter("ends", lambda b: (b > a) & (own(b) != own(a))), lambda b: F.struct(
        F.round(a["dy"] * b["dy"] + a["dx"] * b["dx"], 12).alias("dot"), name(a).alias("a"), name(b).alias("b")))))
    straight = F.sort_array(F.filter(pairs, lambda p: p["dot"] <= -math.cos(math.radians(most_turn))))
    taken = "array<struct<a:struct<y:bigint,x:bigint,step:bigint,side:int>,b:struct<y:bigint,x:bigint,step:bigint,side:int>>>"
    free = lambda done, p: ~F.exists(done, lambda d: d["a"].isin(p["a"], p["b"]) | d["b"].isin(p["a"], p["b"]))
    chosen = F.aggregate(straight, F.array().cast(taken), lambda done, p: F.when(free(done, p), F.concat(done, F.array(F.struct(p["a"].alias("a"), p["b"].alias("b"))))).otherwise(done))
    both = meeting.where(F.size("ends") > 1).select("img", F.explode(chosen).alias("p")).select("img", F.explode(F.array(F.struct("p.a", "p.b"), F.struct(F.col("p.b").alias("a"), F.col("p.a").alias("b")))).alias("p"))
    return both.select("img", "p.a.*", F.col("p.b.y").alias("py"), F.col("p.b.x").alias("px"), F.col("p.b.step").alias("pstep"), F.col("p.b.side").alias("pside"))


def _points(found: DataFrame, order: Column) -> DataFrame:
    """img, n, fiber, seq, y, x of rows with points; n orders the paths of an image, fiber names them."""
    name = F.concat_ws("/", F.col("img"), order.getField("ring"), order.getField("y"), order.getField("x"), order.getField("step"))
    at = found.select("img", order.alias("n"), name.alias("fiber"), F.posexplode("points").alias("seq", "place"))
    return at.select("img", "n", "fiber", "seq", _row(F.col("place")).cast("int").alias("y"), _column(F.col("place")).cast("int").alias("x"))


def traced_links(skeleton: DataFrame, tile: int = T.TILE) -> DataFrame:
    """img, n, fiber, seq, y, x of the links between nodes."""
    return _points(links(skeleton, tile), F.struct(F.lit(0).alias("ring"), "y", "x", "step"))


def fibers(found: DataFrame, joins: DataFrame) -> DataFrame:
    """img, n (ring, y, x, step) and points of each fiber: links joined through junctions as ``joins`` (see partners) pairs their ends.

    A fiber starts at that of its two free ends whose link comes first. Links
    joined to a ring stay apart: ring is 1 for them.
    """
    link = ["y", "x", "step"]
    sides = found.select("img", *link, F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    # A walk that comes in by one side goes out by the other and on to that one's partner.
    beyond = joins.select("img", *link, (1 - F.col("side")).alias("side"), "py", "px", "pstep", "pside")
    hops = sides.join(dealt(beyond), ["img", *link, "side"], "left").withColumn("parts", F.array(F.struct(*link, "side")))
    hops = written(hops, "hops")
    heads = hops.join(dealt(joins.select("img", *link, "side")), ["img", *link, "side"], "left_anti")
    chains = _chained(heads, hops.where("py IS NOT NULL OR side >= 0"), [*link, "side"], ["py", "px", "pstep", "pside"], "parts", [], "hops")
    last = F.element_at("parts", -1)
    here, there = F.struct(*link), F.struct(last["y"].alias("y"), last["x"].alias("x"), last["step"].alias("step"))
    chains = chains.where((here < there) | ((here == there) & (F.col("side") == 0)))
    parts = chains.select("img", F.struct(F.lit(0).alias("ring"), *link).alias("n"), F.posexplode("parts").alias("at", "part"))
    parts = written(parts.select("img", "n", "at", *(F.col(f"part.{c}").alias(c) for c in (*link, "side"))), "parts")
    way = F.when(F.col("side") == 1, F.reverse("points")).otherwise(F.col("points"))
    way = F.when(F.col("at") > 0, F.slice(way, F.lit(2), F.size("points"))).otherwise(way)
    body = parts.join(dealt(found.select("img", *link, "points")), ["img", *link]).select("img", "n", F.struct("at", way.alias("way")).alias("w"))
    whole = body.groupBy("img", "n").agg(F.flatten(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["way"])).alias("points"))
    rings = found.join(dealt(parts.select("img", *link)), ["img", *link], "left_anti").select("img", F.struct(F.lit(1).alias("ring"), *link).alias("n"), "points")
    return whole.union(rings)


def traced(skeleton: DataFrame, most_turn: float = 70.0, reach: int = 8, tile: int = T.TILE) -> DataFrame:
    """img, n, fiber, seq, y, x of the fibers: links, joined through junctions where two are most nearly opposite."""
    found = written(links(skeleton, tile), "links")
    joins = written(partners(found, most_turn, reach), "joins")
    return _points(fibers(found, joins), F.col("n"))


def _pieces_once(skeleton: np.ndarray) -> pd.DataFrame:
    """fiber, seq, y, x: see segments; every pixel is in one path, so the paths are made in order."""
    ring, cross = neighbors(skeleton), junctions(skeleton)
    rows, columns = np.nonzero(skeleton)
    ends = np.array([bin(r).count("1") <= 1 for r in ring[rows, columns]], bool)
    left = skeleton.copy()
    found = []
    for i in np.argsort(~ends, kind="stable"):
        y, x = int(rows[i]), int(columns[i])
        alone, seq = ring[y, x] == 0, 0
        while left[y, x]:
            left[y, x] = False
            found.append((i, seq, y, x))
            seq += 1
            if seq == 1 or not cross[y, x]:
                y, x = next(((y + dy, x + dx) for k, (dy, dx) in enumerate(A.STEPS) if ring[y, x] >> k & 1 and left[y + dy, x + dx]), (y, x))
        if seq == 1 and not alone:
            found.pop()
    return pd.DataFrame(found, columns=["fiber", "seq", "y", "x"]).astype("i8")


def segments(skeleton: DataFrame, tile: int = T.TILE) -> DataFrame:
    """img, fiber, seq, y, x of the pieces between junctions.

    Paths start at ends, then at any pixel left in order, step on pixels that no
    path has (beside before diagonal), and end on a junction; a lone pixel is
    one. That goes by the order of a component's pixels, so components are held
    whole: those not larger than a tile many at once, a larger one by itself.
    """
    found = written(T.components(skeleton, True, tile), "components")
    size = found.groupBy("img", "label").agg(F.min("y").alias("top"), F.min("x").alias("left"), (F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")) >= tile).alias("large"))
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    keyed = found.join(dealt(size), ["img", "label"]).select("img", "y", "x", F.when(F.col("large"), F.col("label")).otherwise(-1).cast("long").alias("own"),
                                                      F.when(F.col("large"), -1).otherwise(at("top")).alias("ty"), F.when(F.col("large"), -1).otherwise(at("left")).alias("tx"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        top, left = int(part["y"].min()), int(part["x"].min())
        (here,) = T._planes(part, [], top, left, (int(part["y"].max()) - top + 1, int(part["x"].max()) - left + 1))
        made = _pieces_once(here)
        name = "/".join(str(int(k)) for k in key)
        return pd.DataFrame({"img": key[0], "fiber": [f"{name}/{k}" for k in made["fiber"]], "seq": made["seq"], "y": made["y"] + top, "x": made["x"] + left})

    return keyed.groupBy("img", "own", "ty", "tx").applyInPandas(run, "img long, fiber string, seq int, y int, x int")
