"""Queries of tiling, lattices, sampling, spatial joins and morphometrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lattice as L
from ..operators import morph as M
from ..operators import spatial as S
from ..sources import bindings as B
from .registry import query
from .views import FPX, PX, RECT, TILE, TRAIN

col = F.col


# --- tiling -----------------------------------------------------------------------------------------------------

#: 320 x 230 pixels in tiles of at most 10,000: five windows of 20 at stride 20 a side, four of which are stepped over.
TILES = """xs AS (SELECT k * 80 AS x, least(100, 320 - k * 80) AS w FROM unnest(range(4)) AS t(k)), ys AS (SELECT k * 80 AS y, least(100, 230 - k * 80) AS h FROM unnest(range(3)) AS t(k)),
tiles AS (SELECT row_number() OVER (ORDER BY y, x) - 1 AS tile, x, y, w, h FROM xs, ys)"""


def _tiles(spark):
    return L.tile_plan(spark, 320, 230, 20, 20, 10_000)


@query("r01_tile_plan", f"WITH {TILES} SELECT tile::BIGINT AS tile, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h FROM tiles")
def tile_plan(spark, d):
    return _tiles(spark).select(*(col(c).cast("long").alias(c) for c in ("tile", "x", "y", "w", "h")))


@query("r02_owned_boxes", f"WITH {TILES} SELECT tile::BIGINT AS tile, (CASE WHEN x = 240 THEN 320 ELSE x + 80 END)::BIGINT AS own_x1, (CASE WHEN y = 160 THEN 230 ELSE y + 80 END)::BIGINT AS own_y1 FROM tiles")
def owned_boxes(spark, d):
    return L.owned_boxes(_tiles(spark)).select(*(col(c).cast("long").alias(c) for c in ("tile", "own_x1", "own_y1")))


@query("r03_density_geometry", "SELECT p_partkey, (CASE WHEN p_size < 5 THEN 0 ELSE (p_size * 10 - 50) // 5 + 1 END)::BIGINT AS cells_window, ceil(p_size * 10 / 5.0::DOUBLE)::BIGINT AS cells_pixel FROM part")
def density_geometry(spark, d):
    side = col("p_size") * 10
    return B.table(spark, d, "part").select("p_partkey", F.when(side < 50, 0).otherwise(F.floor((side - 50) / 5) + 1).cast("long").alias("cells_window"), F.ceil(side / 5).cast("long").alias("cells_pixel"))


@query("r04_feature_tiling", "SELECT p_partkey, greatest(1, ceil(p_size / 8.0::DOUBLE))::BIGINT AS tiles, 8 * 5::BIGINT AS step FROM part")
def feature_tiling(spark, d):
    """Tiles counted in windows; the step between them is a multiple of the stride."""
    return B.table(spark, d, "part").select("p_partkey", F.greatest(F.lit(1), F.ceil(col("p_size") / 8)).cast("long").alias("tiles"), F.lit(40).cast("long").alias("step"))


@query("r05_halo", "SELECT p_partkey, (2 * (p_size % 30) + ceil(4 * (p_size / 7.0::DOUBLE)) + 22)::BIGINT AS halo FROM part")
def halo(spark, d):
    return B.table(spark, d, "part").select("p_partkey", L.halo(col("p_size") % 30, col("p_size") / 7.0).cast("long").alias("halo"))


@query("r06_pyramid", f"WITH {PX} SELECT img, y // 4 AS gy, x // 4 AS gx, round(avg(CASE WHEN g % 7 <> 0 THEN g END), 6) AS g FROM px GROUP BY ALL")
def pyramid(spark, d):
    px = B.pixels(spark, d).withColumn("g", F.when(col("g") % 7 != 0, col("g")))
    return L.pyramid_level(px, "g", 4).select("img", col("gy").cast("int").alias("gy"), col("gx").cast("int").alias("gx"), F.round("g", 6).alias("g"))


@query("r06_pyramid_axial", f"WITH {FPX}, s AS (SELECT img, y // 5 AS gy, x // 5 AS gx, avg(cos(2 * radians(theta))) AS c, avg(sin(2 * radians(theta))) AS s FROM fpx GROUP BY ALL) SELECT img, gy, gx, round(((degrees(atan2(s, c)) / 2) % 180 + 180) % 180, 4) AS theta FROM s")
def pyramid_axial(spark, d):
    return L.pyramid_level(B.fiber_pixels(spark, d), "theta", 5, 180.0).select("img", col("gy").cast("int").alias("gy"), col("gx").cast("int").alias("gx"), F.round("theta", 4).alias("theta"))


@query("k05_map_pyramid", f"""WITH {PX} SELECT 1 AS level, img, y // 2 AS gy, x // 2 AS gx, round(avg(g), 6) AS g FROM px GROUP BY ALL UNION ALL SELECT 2, img, y // 4, x // 4, round(avg(g), 6) FROM px GROUP BY ALL""")
def map_pyramid(spark, d):
    """Levels of a map, each from the pixels (blocks at the edge are smaller, so that means of means would weigh them wrongly)."""
    px = B.pixels(spark, d)
    level = lambda k: L.pyramid_level(px, "g", 2 ** k).select(F.lit(k).alias("level"), "img", col("gy").cast("int").alias("gy"), col("gx").cast("int").alias("gx"), F.round("g", 6).alias("g"))
    return level(1).union(level(2))


CELLS = PX + ", cells AS (SELECT img, y, x, CASE WHEN g % 5 <> 0 THEN g END AS v FROM px)"
POINTS = "pts AS (SELECT event_id AS id, event_id // 2500 AS img, (event_id * 37 % 3999) / 10.3::DOUBLE AS py, (event_id * 91 % 3999) / 10.3::DOUBLE AS px_ FROM events)"


def _points(spark, d):
    e = col("event_id")
    return B.table(spark, d, "events").select(e.alias("id"), F.expr("event_id div 2500").alias("img"), ((e * 37 % 3999) / 10.3).alias("py"), ((e * 91 % 3999) / 10.3).alias("px"))


def _cells(spark, d):
    return B.pixels(spark, d).select("img", "y", "x", F.when(col("g") % 5 != 0, col("g")).alias("v"))


@query("r07_bilinear_sample", f"""WITH {CELLS}, {POINTS}, b AS (SELECT *, floor(py / 8 - 0.5::DOUBLE) AS fy, floor(px_ / 8 - 0.5::DOUBLE) AS fx FROM pts),
k AS (SELECT id, b.img, cells.v, (1 - abs(cells.y - (py / 8 - 0.5::DOUBLE))) * (1 - abs(cells.x - (px_ / 8 - 0.5::DOUBLE))) AS w FROM b LEFT JOIN cells ON cells.img = b.img AND cells.y IN (fy, fy + 1) AND cells.x IN (fx, fx + 1))
SELECT id, img, CASE WHEN sum(w) FILTER (v IS NOT NULL) > 0 THEN round(sum(w * v) / sum(w) FILTER (v IS NOT NULL), 3) END AS v FROM k GROUP BY id, img""")
def bilinear_sample(spark, d):
    return L.sample_bilinear(_points(spark, d), _cells(spark, d), "v", 8).select("id", "img", F.round("v", 3).alias("v"))


@query("r07_nearest_sample", f"WITH {CELLS}, {POINTS} SELECT id, pts.img, v FROM pts LEFT JOIN cells ON cells.img = pts.img AND cells.y = floor(py / 8) AND cells.x = floor(px_ / 8)")
def nearest_sample(spark, d):
    return L.sample_nearest(_points(spark, d), _cells(spark, d), "v", 8)


SAMPLED = """p AS (SELECT id, img, ys.y AS py, xs.x AS px_ FROM rect, LATERAL (SELECT y0 + (k + 0.5::DOUBLE) AS y FROM unnest(range(100)) AS t(k) WHERE y0 + (k + 0.5::DOUBLE) < y1) ys,
 LATERAL (SELECT x0 + (k + 0.5::DOUBLE) AS x FROM unnest(range(100)) AS t(k) WHERE x0 + (k + 0.5::DOUBLE) < x1) xs)"""


@query("j12_point_sampling", f"WITH {RECT}, {SAMPLED} SELECT id, img, count(*) AS n, round(sum(py), 6) AS sy, round(sum(px_), 6) AS sx FROM p GROUP BY id, img")
def point_sampling(spark, d):
    pts = L.object_points(B.rectangles(spark, d), 4)
    return pts.groupBy("id", "img").agg(F.count("*").alias("n"), F.round(F.sum("py"), 6).alias("sy"), F.round(F.sum("px"), 6).alias("sx"))


@query("r08_object_mean", f"WITH {CELLS}, {RECT}, {SAMPLED} SELECT id, p.img, round(avg(v), 5) AS v FROM p LEFT JOIN cells ON cells.img = p.img AND cells.y = floor(py / 4) AND cells.x = floor(px_ / 4) GROUP BY id, p.img")
def object_mean(spark, d):
    return L.object_means(B.rectangles(spark, d), _cells(spark, d), "v", 4).select("id", "img", F.round("v", 5).alias("v"))


@query("r09_aligned_box", f"WITH {RECT} SELECT id, (x0 // 5 * 5)::BIGINT AS x0, (y0 // 5 * 5)::BIGINT AS y0 FROM rect")
def aligned_box(spark, d):
    return B.rectangles(spark, d).select("id", L.aligned(col("x0"), 5).cast("long").alias("x0"), L.aligned(col("y0"), 5).cast("long").alias("y0"))


@query("r10_tile_accumulate", f"WITH {PX} SELECT img, count(*) AS cells, sum(g)::BIGINT AS total FROM px GROUP BY img")
def tile_accumulate(spark, d):
    """Tiles joined to a map; a tile of another shape fails the whole image."""
    return L.accumulated(B.pixels(spark, d), "g", 25)


@query("r11_core_geometry", "SELECT * FROM (VALUES (7, 2, 6, 1, 7)) AS t(core, inset, whole, partial, total)")
def core_geometry(spark, d):
    return spark.createDataFrame([L.core_geometry(50, 11, 7)], "core int, inset int, whole int, partial int, total int")


@query("r12_object_density", f"""WITH {RECT}, {PX}, c AS (SELECT img, y // 10 AS gy, x // 10 AS gx, count(*) AS area FROM px GROUP BY ALL),
h AS (SELECT img, y // 10 AS gy, x // 10 AS gx, class, count(*) AS n FROM (SELECT DISTINCT px.img, px.y, px.x, class FROM px JOIN rect ON px.img = rect.img AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) GROUP BY ALL)
SELECT c.img, c.gy, c.gx, {", ".join(f"round(coalesce(sum(CASE WHEN class = {k} THEN n END), 0) / any_value(area)::DOUBLE, 6) AS class_{k}" for k in range(3))} FROM c LEFT JOIN h USING (img, gy, gx) GROUP BY ALL""")
def object_density(spark, d):
    """The share of each cell that objects of each class cover."""
    px = B.pixels(spark, d)
    cell = ("img", F.floor(col("y") / 10).cast("int").alias("gy"), F.floor(col("x") / 10).cast("int").alias("gx"))
    covered = S.box_pixels(B.rectangles(spark, d)).select("img", "y", "x", "class").distinct().groupBy("img", "y", "x").pivot("class", [0, 1, 2]).count()
    return px.join(covered, ["img", "y", "x"], "left").groupBy(*cell).agg(
        *(F.round(F.coalesce(F.sum(f"`{k}`"), F.lit(0)) / F.count("*"), 6).alias(f"class_{k}") for k in range(3)))


@query("r13_display_range", f"""WITH {PX}, r AS (SELECT g::DOUBLE AS v, row_number() OVER (ORDER BY g) AS k, count(*) OVER () AS n FROM px)
SELECT min(v) FILTER (k >= floor(0.02::DOUBLE * (n - 1)) + 1) AS lo, min(v) FILTER (k >= ceil(0.98::DOUBLE * (n - 1)) + 1) AS hi FROM r""")
def display_range(spark, d):
    return L.display_range(B.pixels(spark, d), col("g"))


# --- merging ----------------------------------------------------------------------------------------------------

@query("a07_tile_merge", f"""WITH {TILE}, m AS (SELECT unnest([('fiber_pixels', sum(fiber)), ('region_pixels', sum(region)), ('morphometrics.total_length_px', sum(len)), ('morphometrics.gap_count', sum(gn)),
 ('morphometrics.gap_max_um', max(gmax)), ('morphometrics.gap_mean_um', sum(gmean * gn) / sum(gn)), ('order_parameter', sum(op * win) / sum(win)),
 ('fiber_coverage_region_percent', 100 * sum(fiber) / sum(region))]) AS r FROM wide) SELECT r[1] AS key, round(r[2], 4) AS value FROM m""")
def tile_merge(spark, d):
    return L.merged_scalars(B.tile_scalars(spark, d)).select("key", F.round("value", 4).alias("value"))


@query("a08_dropped_keys", "SELECT 'mean_angle_deg,morphometrics.branch_points' AS dropped")
def dropped_keys(spark, d):
    return L.dropped_keys(B.tile_scalars(spark, d))


@query("j16_owner_wins", "SELECT l_partkey, l_suppkey, l_quantity FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey % 2 = l_partkey % 2 DESC, l_suppkey DESC, l_quantity DESC) = 1")
def owner_wins(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").distinct()
    one = rows.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("l_quantity"))
    return L.owner_wins(one, ["l_partkey"], col("l_suppkey") % 2 == col("l_partkey") % 2, "l_suppkey")


ANCHOR = """v AS (SELECT {k} AS k, {v} AS v, count(*) AS n, row_number() OVER (PARTITION BY {k} ORDER BY {v}) AS i FROM {t} GROUP BY 1, 2),
c AS (SELECT k, v, n, i, v AS anchor FROM v WHERE i = 1 UNION ALL SELECT v.k, v.v, v.n, v.i, CASE WHEN v.v > c.anchor * 1.02::DOUBLE THEN v.v ELSE c.anchor END FROM c JOIN v ON v.k = c.k AND v.i = c.i + 1)"""


@query("a17_identity_groups", f"WITH RECURSIVE {ANCHOR.format(k='p_brand', v='p_retailprice', t='part')}, g AS (SELECT k, anchor, sum(n) AS n FROM c GROUP BY ALL) SELECT k AS p_brand, anchor, n::BIGINT AS n, row_number() OVER (PARTITION BY k ORDER BY n DESC, anchor)::BIGINT AS rank FROM g")
def identity_groups(spark, d):
    from pyspark.sql import Window
    g = L.anchored_groups(B.table(spark, d, "part"), "p_brand", "p_retailprice").groupBy("p_brand", "anchor").agg(F.sum("n").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "anchor")).cast("long"))


@query("a18_pixel_size_groups", f"WITH RECURSIVE {ANCHOR.format(k='1', v='p_size', t='part')} SELECT anchor::BIGINT AS anchor, sum(n)::BIGINT AS n FROM c GROUP BY anchor")
def pixel_size_groups(spark, d):
    sizes = B.table(spark, d, "part").select(F.lit(1).alias("k"), col("p_size").cast("long").alias("p_size"))
    return L.anchored_groups(sizes, "k", "p_size").groupBy("anchor").agg(F.sum("n").alias("n"))


@query("j18_project_comparability", f"WITH RECURSIVE {ANCHOR.format(k='p_brand', v='p_size::DOUBLE', t='(SELECT * FROM part WHERE p_partkey % 10 <> 0)')}, g AS (SELECT k, count(DISTINCT anchor) AS groups FROM c GROUP BY k) SELECT k AS p_brand, groups, groups = 1 AS comparable FROM g")
def project_comparability(spark, d):
    """Whether the images of a project, derived ones left out, can share one threshold."""
    part = B.table(spark, d, "part")
    own = part.join(part.where("p_partkey % 10 = 0").select("p_partkey"), "p_partkey", "left_anti").withColumn("p_size", col("p_size").cast("double"))
    return L.anchored_groups(own, "p_brand", "p_size").groupBy("p_brand").agg(F.countDistinct("anchor").alias("groups")).withColumn("comparable", col("groups") == 1)


@query("h08_common_pixel_size", "SELECT p_partkey, greatest(2.0::DOUBLE, (SELECT max(p_size) FROM part) / p_size::DOUBLE) AS downsample FROM part")
def common_pixel_size(spark, d):
    part = B.table(spark, d, "part")
    common = part.agg(F.max("p_size").alias("common"))
    return part.join(F.broadcast(common)).select("p_partkey", F.greatest(F.lit(2.0), col("common") / col("p_size")).alias("downsample"))


@query("h04_sample_grid", """WITH g AS (SELECT iy, ix FROM unnest(range(4)) AS a(iy), unnest(range(4)) AS b(ix))
SELECT iy::BIGINT AS iy, ix::BIGINT AS ix, (iy * 2000 + (2000 - 1024) // 2)::BIGINT AS y0, (ix * 3000 + (3000 - 1024) // 2)::BIGINT AS x0, 1024::BIGINT AS side FROM g""")
def sample_grid(spark, d):
    """4 x 4 boxes of up to 1024 pixels, centered in the cells of an 8000 x 12000 image."""
    cell_h, cell_w = 8000 // 4, 12000 // 4
    side = min(1024, cell_h, cell_w)
    g = spark.range(16).select(F.floor(col("id") / 4).alias("iy"), (col("id") % 4).alias("ix"))
    return g.select("iy", "ix", (col("iy") * cell_h + (cell_h - side) // 2).alias("y0"), (col("ix") * cell_w + (cell_w - side) // 2).alias("x0"), F.lit(side).cast("long").alias("side"))


@query("h05_zone_sample_boxes", f"WITH {RECT}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM rect WHERE x0 < 30) SELECT id FROM r WHERE k IN (SELECT floor((i + 0.5::DOUBLE) * n / 8)::BIGINT FROM unnest(range(8)) AS t(i))")
def zone_sample_boxes(spark, d):
    """Boxes that touch the zone, thinned evenly to at most eight."""
    from pyspark.sql import Window
    touch = B.rectangles(spark, d).where("x0 < 30").withColumn("k", (F.row_number().over(Window.orderBy("id")) - 1).cast("long"))
    wanted = touch.agg(F.count("*").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor((i + 0.5) * col("n") / 8))).alias("k")).distinct()
    return touch.join(F.broadcast(wanted), "k").select("id")


@query("h06_calibration_subsample")
def calibration_subsample(spark, d):
    """A repeatable draw of 20 images, by a hash."""
    return B.table(spark, d, "supplier").select("s_suppkey").orderBy(F.xxhash64(F.lit(42), "s_suppkey"), "s_suppkey").limit(20)


@query("h06_seeded_shuffle")
def seeded_shuffle(spark, d):
    """The 20 images that a shuffle with seed 42 puts first, in its order."""
    from ..operators import draws
    return draws.shuffled_first(B.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20, 42).select("rank", "o_orderkey")


@query("h10_batch_status", f"WITH {RECT} SELECT CASE WHEN n IS NULL THEN 'skipped' WHEN img % 3 = 2 THEN 'failed' ELSE 'ran' END AS status, count(*) AS images FROM (SELECT range AS img FROM range(6)) LEFT JOIN (SELECT img, count(*) AS n FROM rect WHERE class = 1 GROUP BY img) USING (img) GROUP BY status")
def batch_status(spark, d):
    """What became of each image of a batch: those without a matching annotation are skipped."""
    images = spark.range(6).withColumnRenamed("id", "img")
    per = B.rectangles(spark, d).where("class = 1").groupBy("img").agg(F.count("*").alias("n"))
    return (images.join(per, "img", "left").select(F.when(col("n").isNull(), "skipped").when(col("img") % 3 == 2, "failed").otherwise("ran").alias("status"))
            .groupBy("status").agg(F.count("*").alias("images")))


# --- spatial joins ----------------------------------------------------------------------------------------------

CORES = "cores AS (SELECT img, iy * 9 + ix AS id, ix * 5 + 2 AS x0, iy * 5 + 2 AS y0, ix * 5 + 7 AS x1, iy * 5 + 7 AS y1 FROM unnest(range(4)) AS c(img), unnest(range(9)) AS a(iy), unnest(range(9)) AS b(ix))"


def _cores(spark):
    grid = spark.range(4 * 81).select(F.floor(col("id") / 81).alias("img"), (col("id") % 81).alias("id"))
    grid = grid.withColumns({"x0": (col("id") % 9 * 5 + 2).cast("int"), "y0": (F.floor(col("id") / 9) * 5 + 2).cast("int")})
    return grid.withColumns({"x1": col("x0") + 5, "y1": col("y0") + 5})


@query("s06_rectangle_raster", f"WITH {RECT}, {PX} SELECT rect.img, rect.id, y, x FROM px JOIN rect ON px.img = rect.img AND x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def rectangle_raster(spark, d):
    return S.box_pixels(B.rectangles(spark, d)).select("img", "id", "y", "x").join(B.pixels(spark, d).select("img", "y", "x"), ["img", "y", "x"])


@query("s06_polygon_raster", f"WITH {PX} SELECT img, y, x FROM px WHERE abs(y - 25) + abs(x - 25) < 10 OR (abs(y - 25) + abs(x - 25) = 10 AND x < 25 AND y <> 25 AND false)")
def polygon_raster(spark, d):
    """Pixel centers inside a diamond, by the even-odd rule."""
    ring = F.array(*(F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((25, 15.5), (34.5, 25), (25, 34.5), (15.5, 25))))
    return B.pixels(spark, d).where(S.polygon_contains(col("y").cast("double"), col("x").cast("double"), ring)).select("img", "y", "x")


@query("s07_union_raster", f"WITH {RECT}, {PX} SELECT img, y, x FROM px WHERE EXISTS (SELECT 1 FROM rect WHERE rect.img = px.img AND x >= x0 AND x < x1 AND y >= y0 AND y < y1)")
def union_raster(spark, d):
    return S.covered_pixels(B.pixels(spark, d), B.rectangles(spark, d)).select("img", "y", "x")


LABEL = """m AS (SELECT c.img, c.id, r.id AS rid, r.class, (least(c.x1, r.x1) - greatest(c.x0, r.x0)) * (least(c.y1, r.y1) - greatest(c.y0, r.y0)) / 25.0::DOUBLE AS share
  FROM cores c JOIN rect r ON c.img = r.img AND c.x0 <= r.x1 AND r.x0 <= c.x1 AND c.y0 <= r.y1 AND r.y0 <= c.y1),
b AS (SELECT img, id, min(class) AS c0, max(class) AS c1, max(share) AS share, arg_max(rid, (share, -rid)) AS ann FROM m GROUP BY ALL),
lab AS (SELECT c.img, c.id, CASE WHEN c0 IS NULL THEN 'NONE' WHEN c0 <> c1 THEN 'MIXED' WHEN share < 0.8::DOUBLE THEN 'PARTIAL' ELSE 'LABELLED' END AS reason, c0, ann FROM cores c LEFT JOIN b USING (img, id))"""


@query("j03_core_labels", f"WITH {RECT}, {CORES}, {LABEL} SELECT img, id, reason FROM lab")
def core_labels(spark, d):
    return S.labelled_cores(_cores(spark), B.rectangles(spark, d), 0.8).select("img", "id", "reason")


@query("j04_coverage_attribution", f"WITH {RECT}, {CORES}, {LABEL} SELECT img, id, c0 AS class, ann FROM lab WHERE reason = 'LABELLED'")
def coverage_attribution(spark, d):
    return S.labelled_cores(_cores(spark), B.rectangles(spark, d), 0.8).where("reason = 'LABELLED'").select("img", "id", "class", "ann")


@query("a15_rejection_counts", f"WITH {RECT}, {CORES}, {LABEL} SELECT reason, count(*) AS n FROM lab GROUP BY reason")
def rejection_counts(spark, d):
    return S.labelled_cores(_cores(spark), B.rectangles(spark, d), 0.8).groupBy("reason").agg(F.count("*").alias("n"))


OVER = "c.img = r.img AND c.x0 < r.x1 AND r.x0 < c.x1 AND c.y0 < r.y1 AND r.y0 < c.y1"


@query("j05_tiles_on_zone", f"WITH {RECT}, {CORES} SELECT img, id FROM cores c WHERE EXISTS (SELECT 1 FROM rect r WHERE class = 0 AND {OVER})")
def tiles_on_zone(spark, d):
    return S.overlapping(_cores(spark), B.rectangles(spark, d).where("class = 0")).select("img", "id")


@query("j06_region_mask", f"WITH {RECT}, {CORES} SELECT img, id, CASE WHEN EXISTS (SELECT 1 FROM rect r WHERE class = 1 AND {OVER}) THEN id * 1.5::DOUBLE END AS v FROM cores c")
def region_mask(spark, d):
    return S.masked(_cores(spark).withColumn("v", col("id") * 1.5), B.rectangles(spark, d).where("class = 1"), "v").select("img", "id", "v")


@query("j07_selected_ids", f"WITH {RECT}, w AS (SELECT unnest([1, 5, 9, 1000001]) AS id) SELECT count(*) FILTER (id IN (SELECT id FROM rect)) AS found, count(*) FILTER (id NOT IN (SELECT id FROM rect)) AS missing FROM w")
def selected_ids(spark, d):
    wanted = spark.createDataFrame([(1,), (5,), (9,), (1000001,)], "id long")
    known = B.rectangles(spark, d).select("id")
    return wanted.join(known, "id", "left_semi").agg(F.count("*").alias("found")).crossJoin(wanted.join(known, "id", "left_anti").agg(F.count("*").alias("missing")))


@query("j13_positional_join", f"WITH {PX}, a AS (SELECT img, y, x, g FROM px), b AS (SELECT img, y // 5 AS gy, x // 5 AS gx, max(g) AS ctx FROM px GROUP BY ALL) SELECT a.img, a.y, a.x, g, ctx FROM a LEFT JOIN b ON a.img = b.img AND a.y // 5 = gy AND a.x // 5 = gx")
def positional_join(spark, d):
    """Base columns and context columns by cell."""
    px = B.pixels(spark, d)
    cell = lambda c: F.floor(col(c) / 5)
    ctx = px.groupBy("img", cell("y").alias("gy"), cell("x").alias("gx")).agg(F.max("g").alias("ctx"))
    return px.withColumns({"gy": cell("y"), "gx": cell("x")}).join(ctx, ["img", "gy", "gx"], "left").select("img", "y", "x", "g", "ctx")


@query("s12_virtual_channels", f"WITH {PX}, m AS (SELECT img, y // 8 AS gy, x // 8 AS gx, round(avg(g), 5) AS density FROM px WHERE g % 2 = 0 GROUP BY ALL) SELECT px.img, y, x, g::DOUBLE AS band, density FROM px LEFT JOIN m ON m.img = px.img AND gy = y // 8 AND gx = x // 8")
def virtual_channels(spark, d):
    """Source bands and map channels sampled at pixel centers, as one view."""
    px = B.pixels(spark, d)
    m = px.where("g % 2 = 0").groupBy("img", F.expr("y div 8").alias("gy"), F.expr("x div 8").alias("gx")).agg(F.round(F.avg("g"), 5).alias("density"))
    return px.withColumns({"gy": F.expr("y div 8"), "gx": F.expr("x div 8")}).join(m, ["img", "gy", "gx"], "left").select("img", "y", "x", col("g").cast("double").alias("band"), "density")


@query("j14_index_aligned_join", "SELECT vec_id, i::INT AS pos, coalesce(CASE WHEN i % 7 <> 0 THEN embedding[i + 1] END, 1)::DOUBLE AS v FROM embeddings, unnest(range(64)) AS t(i)")
def index_aligned_join(spark, d):
    """Two lists joined by place; a missing entry of the second counts as the whole."""
    e = B.table(spark, d, "embeddings")
    second = F.transform("embedding", lambda v, i: F.when(i % 7 != 0, v))
    return e.select("vec_id", F.posexplode(F.arrays_zip("embedding", second.alias("b"))).alias("pos", "z")).select("vec_id", "pos", F.coalesce(col("z.b"), F.lit(1.0)).cast("double").alias("v"))


@query("j15_feature_set_check", "SELECT 'f3' AS missing, 'f4' AS unexpected, false AS same_order")
def feature_set_check(spark, d):
    a, b = (F.array(*map(F.lit, names)) for names in (["f1", "f2", "f3"], ["f2", "f1", "f4"]))
    return spark.range(1).select(F.array_join(F.array_except(a, b), ",").alias("missing"), F.array_join(F.array_except(b, a), ",").alias("unexpected"), (a == b).alias("same_order"))


# --- morphometrics ----------------------------------------------------------------------------------------------

@query("g02_box_counting", f"""WITH {FPX}, s AS (SELECT unnest([1, 2, 4, 8, 16]) AS s), b AS (SELECT DISTINCT img, s, y // s AS by, x // s AS bx FROM fpx, s WHERE fiber AND y // s < 50 // s AND x // s < 50 // s),
c AS (SELECT img, s, count(*) AS n FROM b GROUP BY ALL) SELECT img, round(regr_slope(ln(n), ln(1.0::DOUBLE / s)), 6) AS dimension FROM c GROUP BY img""")
def box_counting(spark, d):
    return M.box_dimension(B.fiber_pixels(spark, d).where("fiber"), 50, [1, 2, 4, 8, 16, 64]).select("img", F.round("dimension", 6).alias("dimension"))


@query("g03_lacunarity", f"""WITH {FPX}, b AS (SELECT a.img, a.y, a.x, sum(q.fiber::INT) AS b FROM fpx a JOIN fpx q ON a.img = q.img AND q.y BETWEEN a.y - 2 AND a.y + 1 AND q.x BETWEEN a.x - 2 AND a.x + 1 WHERE a.y >= 3 AND a.x >= 3 GROUP BY ALL)
SELECT img, round(1 + var_pop(b) / avg(b) ** 2, 6) AS lacunarity FROM b GROUP BY img""")
def lacunarity(spark, d):
    return M.lacunarity(B.fiber_pixels(spark, d), col("fiber"), 4).select("img", F.round("lacunarity", 6).alias("lacunarity"))


PATHS = "pts AS (SELECT event_id // 20 AS fiber, (event_id % 20)::INT AS seq, (round(value) % 50)::INT AS y, (event_id % 20)::INT AS x FROM events)"
SHAPES = PATHS + """, st AS (SELECT *, sqrt((y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2) AS step FROM pts WINDOW w AS (PARTITION BY fiber ORDER BY seq)),
sh AS (SELECT fiber, count(*) AS n, coalesce(sum(step), 0) AS arc, sqrt((arg_max(y, seq) - arg_min(y, seq)) ** 2 + (arg_max(x, seq) - arg_min(x, seq)) ** 2) AS chord, avg(y) AS cy, avg(x) AS cx FROM st GROUP BY fiber),
shape AS (SELECT *, CASE WHEN arc > 0 THEN chord / arc ELSE 1 END AS straightness FROM sh)"""


def _paths(spark, d):
    return B.table(spark, d, "events").select(F.expr("event_id div 20").alias("fiber"), (col("event_id") % 20).cast("int").alias("seq"), (F.round("value") % 50).cast("int").alias("y"), (col("event_id") % 20).cast("int").alias("x"))


@query("g10_straightness", f"WITH {SHAPES} SELECT fiber, n, round(arc, 5) AS arc, round(straightness, 6) AS straightness FROM shape")
def straightness(spark, d):
    return M.path_shapes(_paths(spark, d)).select("fiber", "n", F.round("arc", 5).alias("arc"), F.round("straightness", 6).alias("straightness"))


@query("g04_curvature", f"""WITH {SHAPES}, e AS (SELECT fiber, abs(degrees(atan2(max(y) FILTER (seq = 4) - max(y) FILTER (seq = 0), 4)) - degrees(atan2(max(y) FILTER (seq = 19) - max(y) FILTER (seq = 15), 4))) AS t FROM pts GROUP BY fiber)
SELECT fiber, round(radians(least(t % 180, 180 - t % 180)) / arc, 6) AS curvature FROM e JOIN shape USING (fiber)""")
def curvature(spark, d):
    return M.path_curvature(_paths(spark, d), 4).select("fiber", F.round("curvature", 6).alias("curvature"))


@query("a05_length_summary", f"""WITH {SHAPES} SELECT fiber // 125 AS img, count(*) AS n_fibers, round(avg(straightness), 6) AS mean, round(sum(straightness * arc) / sum(arc), 6) AS weighted_mean, round(quantile_cont(straightness, 0.1), 6) AS p10,
 round(quantile_cont(straightness, 0.5), 6) AS median, round(stddev_pop(straightness), 6) AS sd, round(count_if(straightness < 0.85::DOUBLE) / count(*)::DOUBLE, 6) AS bent, round(quantile_cont(arc, 0.5), 5) AS median_length FROM shape GROUP BY 1""")
def length_summary(spark, d):
    found = M.length_summary(M.path_shapes(_paths(spark, d)).withColumn("img", F.expr("fiber div 125")), "img")
    return found.select("img", "n_fibers", *(F.round(c, 6).alias(c) for c in ("mean", "weighted_mean", "p10", "median", "sd", "bent")), F.round("median_length", 5).alias("median_length"))


@query("a06_fibers_by_centroid", f"WITH {SHAPES} SELECT floor(cy / 5)::BIGINT AS iy, floor(cx / 5)::BIGINT AS ix, count(*) AS n_fibers, round(quantile_cont(straightness, 0.5), 6) AS median FROM shape GROUP BY ALL")
def fibers_by_centroid(spark, d):
    return M.by_centroid(M.path_shapes(_paths(spark, d)), 5).select("iy", "ix", "n_fibers", F.round("median", 6).alias("median"))
