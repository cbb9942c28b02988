"""Joins between boxes and pixels, cores and annotations, tiles and zones.

Boxes are half-open rectangles (img, id, x0, y0, x1, y1). Range predicates are
preceded by an equi-join on coarse buckets that both sides are spread over, so
that no join compares everything with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 16


def buckets(lo: Column, hi: Column) -> Column:
    """Bucket numbers that [lo, hi] touches."""
    return F.sequence(F.floor(lo / BUCKET).cast("int"), F.floor(hi / BUCKET).cast("int"))


def bucketed(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    return (df.withColumn("_by", F.explode(buckets(F.col(y0), F.col(y1)))).withColumn("_bx", F.explode(buckets(F.col(x0), F.col(x1)))))


def box_pixels(boxes: DataFrame) -> DataFrame:
    """img, id, y, x: the pixels whose centers lie in each box. The work is the boxes' area."""
    return (boxes.where("x1 > x0 AND y1 > y0").withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
            .withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))))


def polygon_contains(y: Column, x: Column, ring: Column) -> Column:
    """Even-odd test of a point against an array of (x, y) structs; the ring closes itself."""
    def crossing(i: Column) -> Column:
        a, b = F.element_at(ring, (i + 1).cast("int")), F.element_at(ring, F.when(i + 2 > F.size(ring), 1).otherwise(i + 2).cast("int"))
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]), 1).otherwise(0)
    edges = F.sequence(F.lit(0), F.size(ring) - 1)
    return (F.aggregate(edges, F.lit(0), lambda s, i: s + crossing(i)) % 2) == 1


def covered_pixels(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels that lie in any box."""
    return px.join(box_pixels(boxes).select("img", "y", "x"), ["img", "y", "x"], "left_semi")


def touching(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes that intersect, edges included: left's columns with right's id, class and box as r_*."""
    a = bucketed(left, "x0", "y0", "x1", "y1")
    b = bucketed(right, "x0", "y0", "x1", "y1").select("img", "_by", "_bx", *(F.col(c).alias(f"r_{c}") for c in ("id", "class", "x0", "y0", "x1", "y1")))
    met = a.join(b, ["img", "_by", "_bx"]).where("x0 <= r_x1 AND r_x0 <= x1 AND y0 <= r_y1 AND r_y0 <= y1")
    return met.drop("_by", "_bx").dropDuplicates(["img", "id", "r_id"])


def labelled_cores(cores: DataFrame, annotations: DataFrame, purity: float) -> DataFrame:
    """img, id, reason, class and ann of each core.

    Cores that touch two classes are MIXED, whatever the areas. Of one class, the
    annotation that covers most (the smallest id of equals) labels the core if it
    covers at least ``purity`` of it; else it is PARTIAL. Others are NONE.
    """
    overlap = (F.least("x1", "r_x1") - F.greatest("x0", "r_x0")) * (F.least("y1", "r_y1") - F.greatest("y0", "r_y0"))
    met = touching(cores, annotations).withColumn("share", overlap / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))))
    best = met.groupBy("img", "id").agg(F.min("r_class").alias("c0"), F.max("r_class").alias("c1"),
                                        F.max(F.struct("share", (-F.col("r_id")).alias("m"))).alias("top"))
    joined = cores.join(best, ["img", "id"], "left")
    reason = (F.when(F.col("c0").isNull(), "NONE").when(F.col("c0") != F.col("c1"), "MIXED").when(F.col("top.share") < purity, "PARTIAL").otherwise("LABELLED"))
    return joined.withColumn("reason", reason).select(
        "img", "id", "reason", F.when(F.col("reason") == "LABELLED", F.col("c0")).alias("class"), F.when(F.col("reason") == "LABELLED", -F.col("top.m")).alias("ann"))


def overlapping(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """Boxes that share a positive area with a zone; touching edges do not count."""
    met = touching(boxes, zones).where("x0 < r_x1 AND r_x0 < x1 AND y0 < r_y1 AND r_y0 < y1")
    return boxes.join(met.select("img", "id").distinct(), ["img", "id"], "left_semi")


def masked(cells: DataFrame, zones: DataFrame, value: str) -> DataFrame:
    """All cells; the value of those that share no positive area with a zone is null."""
    kept = overlapping(cells, zones).select("img", "id", F.lit(True).alias("_in"))
    return cells.join(kept, ["img", "id"], "left").withColumn(value, F.when(F.col("_in"), F.col(value))).drop("_in")
