"""Zones around polygons as geometry: fill, buffer and difference, line by line.

Shapes are rows (img, id, part, hole, ring) with rings as arrays of (x, y)
structs that close themselves. On the line through a row of pixel centers a
filled ring is the spans between its crossings, and what is no farther than d
from an edge is one span, exactly. The zones are what is covered by spans of
either kind, so that a shape is no task's: its lines are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import dealt, written

LINE = ["img", "id", "y"]


def outer_rings(shapes: DataFrame) -> DataFrame:
    """img, id, part and ring of the rings that are no holes and have three points at least; repeated ones once, numbered by their points."""
    rings = shapes.where("NOT coalesce(hole, false) AND size(ring) >= 3").select("img", "id", "ring").distinct()
    return rings.withColumn("part", F.xxhash64("ring"))


def _edges(rings: DataFrame) -> DataFrame:
    """img, id, part, px, py, qx and qy of each edge."""
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    e = rings.select("img", "id", "part", F.explode(F.arrays_zip(F.col("ring").alias("p"), after.alias("q"))).alias("e"))
    return e.select("img", "id", "part", *(F.col(f"e.{n}.{c}").cast("double").alias(n + c) for n in "pq" for c in "xy"))


def _rows(lo: Column, hi: Column) -> Column:
    """Rows whose center line is in [lo, hi]; none if there is none."""
    first, last = F.ceil(lo - 0.5).cast("int"), F.floor(hi - 0.5).cast("int")
    return F.when(first <= last, F.sequence(first, last))


def filled_spans(edges: DataFrame) -> DataFrame:
    """img, id, part, y, a and b: where each ring is crossed into and out of, by the even-odd rule."""
    over = edges.withColumn("y", F.explode(_rows(F.least("py", "qy"), F.greatest("py", "qy")))).withColumn("c", F.col("y") + 0.5)
    over = over.where((F.col("py") > F.col("c")) != (F.col("qy") > F.col("c")))
    at = F.col("px") + (F.col("c") - F.col("py")) * (F.col("qx") - F.col("px")) / (F.col("qy") - F.col("py"))
    w = Window.partitionBy("img", "id", "part", "y").orderBy("a")
    spans = over.select("img", "id", "part", "y", at.alias("a")).withColumns({"b": F.lead("a").over(w), "_n": F.row_number().over(w)})
    return spans.where("_n % 2 = 1").drop("_n")


def near_spans(edges: DataFrame, d: float) -> DataFrame:
    """img, id, y, a and b: where each row's center line is no farther than d from an edge."""
    c = F.col
    dx, dy = c("qx") - c("px"), c("qy") - c("py")
    e = edges.withColumn("y", F.explode(_rows(F.least("py", "qy") - d, F.greatest("py", "qy") + d)))
    e = e.withColumns({"long": F.hypot(dx, dy), "off": c("y") + 0.5 - c("py")})
    ux, uy = F.try_divide(dx, c("long")), F.try_divide(dy, c("long"))
    e = e.withColumns({"ux": ux, "uy": uy})
    # Around each end a disk; between them a strip: along the edge from 0 to its length, across it from -d to d.
    disk = lambda x, off: (F.when(F.abs(off) <= d, x - F.sqrt(d * d - off * off)), F.when(F.abs(off) <= d, x + F.sqrt(d * d - off * off)))
    ends = [disk(c("px"), c("off")), disk(c("qx"), c("y") + 0.5 - c("qy"))]
    along, across = [F.try_divide(t - c("off") * c("uy"), c("ux")) for t in (F.lit(0.0), c("long"))], [F.try_divide(c("off") * c("ux") - s, c("uy")) for s in (-d, d)]
    a, b = F.greatest(F.least(*along), F.least(*across)), F.least(F.greatest(*along), F.greatest(*across))
    # An upright edge says nothing along the line, a level one nothing across it: least and greatest skip these nulls.
    inside = (F.when(c("ux") == 0, (c("off") * c("uy")).between(0.0, c("long"))).when(c("uy") == 0, F.abs("off") <= d).otherwise(F.lit(True))) & (a <= b) & (c("long") > 0)
    strip = F.when(inside, c("px") + a), F.when(inside, c("px") + b)
    return e.select(*LINE, F.least(strip[0], *(x for x, _ in ends)).alias("a"), F.greatest(strip[1], *(x for _, x in ends)).alias("b")).where("a < b")


def _changes(spans: DataFrame, *names: str) -> DataFrame:
    """Two rows (at, +1 and -1 of each name) of each span."""
    return spans.select("*", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("s")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("s")))).alias("e")).select(
        "*", F.col("e.at").alias("at"), *(((F.col("e.s") * F.col(n)).cast("long")).alias(f"_{n}") for n in names))


def own_edges(rings: DataFrame, edges: DataFrame, spans: DataFrame) -> DataFrame:
    """Edges of the rings that no other ring of their shape has inside it, as an island in a filled hole is."""
    starts = _changes(spans.withColumn("f", F.lit(1)), "f")
    line = Window.partitionBy(*LINE).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    open_here = starts.withColumn("open", F.sum("_f").over(line)).where("_f = 1")
    inner = open_here.groupBy("img", "id", "part").agg(F.min_by("open", F.struct("y", "at")).alias("open")).where("open > 1")
    return edges.join(dealt(inner.select("img", "id", "part")), ["img", "id", "part"], "left_anti")


def spans(shapes: DataFrame, d: float) -> DataFrame:
    """img, id, y, a, b, filled and near: pieces of each shape's lines, which pixels' centers are on, that are in it or no farther than d from its edge.

    Holes are filled first. Parts of a shape may touch or lie in each other's
    holes, not cross. Null and short rings are no shapes; a distance of 0 has
    nothing near, a negative one is refused. An island that no line goes through counts as an edge of its own.
    """
    if d < 0:
        raise ValueError("a zone's width is not negative")
    rings = outer_rings(shapes)
    edges = written(_edges(rings), "edges")
    filled = written(filled_spans(edges), "filled")
    near = near_spans(own_edges(rings, edges, filled), d)
    both = filled.select(*LINE, "a", "b", F.lit(1).alias("f"), F.lit(0).alias("n")).unionByName(near.select("*", F.lit(0).alias("f"), F.lit(1).alias("n")))
    steps = _changes(both, "f", "n").groupBy(*LINE, "at").agg(F.sum("_f").alias("f"), F.sum("_n").alias("n"))
    line = Window.partitionBy(*LINE).orderBy("at")
    state = steps.select(*LINE, F.col("at").alias("a"), F.lead("at").over(line).alias("b"), (F.sum("f").over(line) > 0).alias("filled"), (F.sum("n").over(line) > 0).alias("near"))
    return state.where("b IS NOT NULL AND (filled OR near)")


def zone_of(mode: str | None) -> Column:
    """Which pieces of ``spans`` a mode has; any unknown mode is outside."""
    return {"whole": F.col("filled"), "annotation": F.col("filled"), "inside": F.col("filled") & F.col("near"), "both": F.col("near")}.get(mode or "outside", F.col("near") & ~F.col("filled"))


def zone_spans(shapes: DataFrame, mode: str | None, d: float) -> DataFrame:
    """img, id, y, a and b of a zone, its pieces that meet put together."""
    line = Window.partitionBy(*LINE).orderBy("a")
    pieces = spans(shapes, d).where(zone_of(mode)).withColumn("_new", F.coalesce(F.lag("b").over(line) < F.col("a"), F.lit(True)).cast("int"))
    return pieces.withColumn("_run", F.sum("_new").over(line)).groupBy(*LINE, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_run")


def span_pixels(pieces: DataFrame) -> DataFrame:
    """The pieces' other columns and x of the pixels whose centers lie in [a, b); work is the pixels."""
    first, last = F.ceil(F.col("a") - 0.5).cast("int"), (F.ceil(F.col("b") - 0.5) - 1).cast("int")
    return pieces.withColumn("x", F.explode(F.when(first <= last, F.sequence(first, last)))).drop("a", "b")
