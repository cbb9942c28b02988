"""Rasters, rectangles and training tables as views of the star-schema tables.

A raster is a table (img, y, x, g): ``events`` fills images of 50 x 50 pixels
row by row, with 16-bit grays. Each function here has its DuckDB text in
``rasterloom.plans.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of an image, its pixels, the fiber threshold and the full scale of 16-bit grays.
SIDE, AREA, FIBER_GRAY, FULL_SCALE = 50, 2500, 7000, 65535


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: (img, y, x, g)."""
    rest = F.expr("event_id % 2500")
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2500").alias("img"), F.expr("cast((event_id % 2500) div 50 as int)").alias("y"),
        (rest % 50).cast("int").alias("x"), F.round(F.col("value") * 100).cast("int").alias("g"))


def fiber_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 with fiber (a boolean mask), zone (a boolean mask) and theta (degrees, null off the mask)."""
    px = pixels(spark, sf_dir)
    fiber = F.col("g") >= FIBER_GRAY
    return (px.withColumn("fiber", fiber).withColumn("zone", (F.col("y") >= 10) & (F.col("y") < 45))
            .withColumn("theta", F.when(fiber, (F.col("g") % 180).cast("double"))))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: (img, y, x, v, label), 8 x 8 pixels of each vector."""
    return (table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
            .select(F.col("vec_id").alias("img"), F.expr("pos div 8").cast("int").alias("y"), (F.col("pos") % 8).alias("x"),
                    F.col("v").cast("double").alias("v"), "label"))


def tile_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: (tile, key, value), several kinds of figures for each of nine tiles."""
    tile = F.col("l_suppkey") % 9
    wide = table(spark, sf_dir, "lineitem").groupBy(tile.alias("tile")).agg(
        F.count("*").cast("double").alias("fiber_pixels"), (F.count("*") * 3).cast("double").alias("region_pixels"),
        F.sum("l_quantity").alias("morphometrics.total_length_px"), F.avg("l_discount").alias("order_parameter"),
        F.max("l_quantity").alias("morphometrics.gap_max_um"), F.avg("l_quantity").alias("morphometrics.gap_mean_um"),
        F.countDistinct("l_partkey").cast("double").alias("morphometrics.gap_count"), F.avg("l_tax").alias("mean_angle_deg"),
        F.countDistinct("l_returnflag").cast("double").alias("morphometrics.branch_points"), F.countDistinct("l_suppkey").cast("double").alias("windows"))
    return wide.unpivot("tile", [F.col(f"`{c}`") for c in wide.columns if c != "tile"], "key", "value")


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: (img, id, class, x0, y0, x1, y1), half-open."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    base = table(spark, sf_dir, "supplier").select(
        (k % 4).alias("img"), k.alias("id"), (n % 3).cast("long").alias("class"), ((k * 13) % 40).cast("int").alias("x0"),
        ((k * 29) % 40).cast("int").alias("y0"), (5 + n % 6).cast("int").alias("w"), (5 + k % 6).cast("int").alias("h"))
    return base.select("img", "id", "class", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4p: (img, id, part, hole, ring), five-sided shapes in the rectangles; those of class 0 have a hole with an island in it."""
    at = lambda *points: F.array(*(F.struct((F.col(a) + dx).cast("double").alias("x"), (F.col(b) + dy).cast("double").alias("y")) for a, dx, b, dy in points))
    outer = at(("x0", 0, "y0", 0), ("x1", 0, "y0", 2), ("x1", 0, "y1", 0), ("xm", 0, "y1", -1.5), ("x0", 0, "y1", 0))
    hole = at(("x0", 1, "y0", 2), ("x0", 1, "y0", 3.25), ("x0", 4, "y0", 3.25), ("x0", 4, "y0", 2))
    island = at(("x0", 2, "y0", 2.25), ("x0", 3, "y0", 2.25), ("x0", 2.5, "y0", 3))
    part = lambda n, hole, ring: F.struct(F.lit(n).alias("part"), F.lit(hole).alias("hole"), ring.alias("ring"))
    parts = F.when(F.col("class") == 0, F.array(part(0, False, outer), part(1, True, hole), part(2, False, island))).otherwise(F.array(part(0, False, outer)))
    return (rectangles(spark, sf_dir).withColumn("xm", (F.col("x0") + F.col("x1")) / 2)
            .select("img", "id", F.explode(parts).alias("p")).select("img", "id", "p.part", "p.hole", "p.ring"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: (row, f1, f2, f3, y, grp, ann), one row per customer."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("f1"), F.sum("o_totalprice").alias("f2"))
    y = F.ascii(F.substring("c_mktsegment", 1, 1)) % 5
    return (table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").alias("row"), F.coalesce("f1", F.lit(0.0)).alias("f1"), F.coalesce("f2", F.lit(0.0)).alias("f2"),
                    F.col("c_acctbal").alias("f3"), y.cast("long").alias("y"), (F.col("c_nationkey") % 8).cast("long").alias("grp"),
                    ((F.col("c_nationkey") * 5 + y) * 3 + F.col("c_custkey") % 3).cast("long").alias("ann")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5p: training rows with a predicted class, probabilities p0 ... p4 of integer weights, and a novelty p."""
    weight = lambda k: (F.col("row") * (3 + 2 * k) + k * k) % 11 + 1
    total = weight(0) + weight(1) + weight(2) + weight(3) + weight(4)
    return training(spark, sf_dir).select(
        "row", "y", "grp", "ann", ((F.col("row") * 7) % 5).alias("pred"), *((weight(k) / total).alias(f"p{k}") for k in range(5)),
        ((F.col("row") % 997) / 997.0).alias("novelty_p"))
