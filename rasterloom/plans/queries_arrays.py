"""Queries of array kernels: E where a small self-join in SQL says the same, rows only where the algorithm depends on order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import features as X
from ..operators import morph as M
from ..operators import outlines as O
from ..operators import tiles as T
from ..operators import tracing as R
from ..operators import zones as Z
from ..sources import bindings as B
from ..sources.shared import dealt, written
from .registry import query
from .views import FPX, PX, RECT

col = F.col
FULL = " WHERE img IN (SELECT img FROM px GROUP BY img HAVING count(*) = 2500)"
EDT = f", dist AS (SELECT a.img, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM (SELECT * FROM fpx{FULL}) a JOIN fpx b ON a.img = b.img AND b.fiber GROUP BY a.img, a.y, a.x)"


def _mask(spark, d):
    """Whole images only, as the SQL of these queries has it; their _any queries take every image."""
    px = B.fiber_pixels(spark, d)
    return px.join(px.groupBy("img").agg(F.count("*").alias("n")).where(f"n = {B.AREA}").select("img"), "img", "left_semi")


@query("j10_nearest_fiber", f"WITH {FPX} {EDT} SELECT img, y, x, round(d, 6) AS d FROM dist")
def nearest_fiber(spark, d):
    return T.distances(_mask(spark, d), col("fiber")).select("img", "y", "x", F.round("d", 6).alias("d"))


@query("m09_fiber_width", f"WITH {FPX}, dist AS (SELECT a.img, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM (SELECT * FROM fpx{FULL}) a JOIN fpx b ON a.img = b.img AND NOT b.fiber WHERE a.fiber GROUP BY ALL) SELECT img, y, x, round(2 * d, 6) AS width FROM dist")
def fiber_width(spark, d):
    return fiber_width_of(_mask(spark, d))


@query("m01_zone_outside", f"""WITH {FPX}, r AS (SELECT img, y, x, zone FROM fpx{FULL})
SELECT a.img, a.y, a.x FROM r a WHERE NOT zone AND EXISTS (SELECT 1 FROM r b WHERE b.img = a.img AND b.zone AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9)""")
def zone_outside(spark, d):
    """Pixels outside a region and at most three pixels away."""
    return T.zone(_mask(spark, d), col("zone"), "outside", 3.0)


@query("m02_zone_modes")
def zone_modes(spark, d):
    """Pixels of each zone mode around each image's mask."""
    modes = ["whole", "outside", "inside", "both"]
    counts = T.zones(B.fiber_pixels(spark, d), col("fiber"), 2.0).groupBy("img").agg(*(F.count_if(m).alias(m) for m in modes))
    return counts.unpivot("img", modes, "mode", "n")


@query("m02_polygon_zones", f"""WITH {PX}, {RECT}, edge AS (SELECT img, id, x0::DOUBLE AS px, y0::DOUBLE AS py, x1::DOUBLE AS qx, y0 + 2::DOUBLE AS qy FROM rect
  UNION ALL SELECT img, id, x1, y0 + 2, x1, y1 FROM rect UNION ALL SELECT img, id, x1, y1, (x0 + x1) / 2::DOUBLE, y1 - 1.5::DOUBLE FROM rect
  UNION ALL SELECT img, id, (x0 + x1) / 2::DOUBLE, y1 - 1.5::DOUBLE, x0, y1 FROM rect UNION ALL SELECT img, id, x0, y1, x0, y0 FROM rect),
met AS (SELECT e.img, e.id, p.y, p.x, (py > p.y + 0.5::DOUBLE) <> (qy > p.y + 0.5::DOUBLE) AND px + (p.y + 0.5::DOUBLE - py) * (qx - px) / (qy - py) <= p.x + 0.5::DOUBLE AS crossed,
  greatest(0, least(1, ((p.x + 0.5::DOUBLE - px) * (qx - px) + (p.y + 0.5::DOUBLE - py) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2))) AS t, px, py, qx, qy FROM edge e JOIN px p USING (img)),
told AS (SELECT img, id, y, x, count_if(crossed) % 2 = 1 AS f, min((x + 0.5::DOUBLE - px - t * (qx - px)) ** 2 + (y + 0.5::DOUBLE - py - t * (qy - py)) ** 2) <= 2.3::DOUBLE ** 2 AS n FROM met GROUP BY ALL)
SELECT img, id, mode, count(*) AS n, sum(y * 50 + x)::BIGINT AS places FROM (SELECT img, id, y, x, unnest(list_filter([CASE WHEN f THEN 'whole' END, CASE WHEN f AND n THEN 'inside' END,
  CASE WHEN n AND NOT f THEN 'outside' END, CASE WHEN n THEN 'both' END], lambda m: m IS NOT NULL)) AS mode FROM told WHERE f OR n) GROUP BY ALL""")
def polygon_zones(spark, d):
    """Pixels of each zone of each polygon, 2.3 wide."""
    modes = ["whole", "inside", "outside", "both"]
    pieces = Z.spans(B.polygons(spark, d), 2.3).withColumn("mode", F.explode(F.array_compact(F.array(*(F.when(Z.zone_of(m), F.lit(m)) for m in modes)))))
    px = Z.span_pixels(pieces).join(dealt(B.pixels(spark, d).select("img", "y", "x")), ["img", "y", "x"])
    return px.groupBy("img", "id", "mode").agg(F.count("*").alias("n"), F.sum(col("y") * 50 + col("x")).alias("places"))


COMP = f""", f AS (SELECT img, y, x, y * 50 + x + 1 AS id FROM fpx WHERE fiber), adj AS (SELECT a.img, a.id AS a, b.id AS b FROM f a JOIN f b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (SELECT img, id AS a, id AS b FROM f UNION SELECT r.img, r.a, adj.b FROM reach r JOIN adj ON adj.img = r.img AND adj.a = r.b),
comp AS (SELECT img, a AS id, min(b) AS c FROM reach GROUP BY ALL), sized AS (SELECT *, count(*) OVER (PARTITION BY img, c) AS n FROM comp)"""


@query("m05_without_small", f"WITH RECURSIVE {FPX} {COMP} SELECT img, ((id - 1) // 50)::INT AS y, ((id - 1) % 50)::INT AS x FROM sized WHERE n >= 4")
def without_small(spark, d):
    return T.without_small(B.fiber_pixels(spark, d).where("fiber"), 4)


@query("k14_blob_detections", f"WITH RECURSIVE {FPX} {COMP} SELECT img, c::BIGINT AS blob, n AS area_px, round(n * 0.25::DOUBLE, 6) AS area_um2 FROM (SELECT DISTINCT img, c, n FROM sized) WHERE n >= 4")
def blob_detections(spark, d):
    """Connected blobs with their areas, small ones dropped."""
    first = col("label")
    label = T.components(B.fiber_pixels(spark, d).where("fiber")).withColumn("blob", F.shiftright(first, 32) * B.SIDE + first % T.PLACE + 1)
    return label.groupBy("img", "blob").agg(F.count("*").alias("area_px")).where("area_px >= 4").withColumn("area_um2", F.round(col("area_px") * 0.25, 6))


EDGES = """, side AS (SELECT * FROM (VALUES (0, 0, 1, -1, 0, 0, 0), (1, 1, 0, 0, 1, 0, 1), (2, 0, -1, 1, 0, 1, 1), (3, -1, 0, 0, -1, 1, 0)) AS t(s, fy, fx, oy, ox, sy, sx)),
m AS (SELECT img, y, x FROM fpx WHERE fiber),
edge AS (SELECT a.*, s.* FROM m a CROSS JOIN side s ANTI JOIN m b ON b.img = a.img AND b.y = a.y + s.oy AND b.x = a.x + s.ox),
nxt AS (SELECT e.img, (e.y * 50 + e.x) * 4 + e.s AS e, e.s, e.y, e.y + e.sy AS vy, e.x + e.sx AS vx, CASE WHEN r.y IS NULL THEN (e.y * 50 + e.x) * 4 + (e.s + 1) % 4
  WHEN d.y IS NULL THEN (r.y * 50 + r.x) * 4 + e.s ELSE (d.y * 50 + d.x) * 4 + (e.s + 3) % 4 END AS n
  FROM edge e LEFT JOIN m r ON r.img = e.img AND r.y = e.y + e.fy AND r.x = e.x + e.fx LEFT JOIN m d ON d.img = e.img AND d.y = e.y + e.fy + e.oy AND d.x = e.x + e.fx + e.ox),
walk AS (SELECT img, e AS first, e, n, s, y, vy, vx, 0 AS at FROM nxt WHERE s = 0
  UNION ALL SELECT w.img, w.first, k.e, k.n, k.s, k.y, k.vy, k.vx, w.at + 1 FROM walk w JOIN nxt k ON k.img = w.img AND k.e = w.n WHERE w.n % 4 <> 0 OR w.n > w.first),
gone AS (SELECT w.*, w.at = 0 OR s <> lag(s) OVER (PARTITION BY w.img, w.first ORDER BY w.at) AS corner FROM walk w SEMI JOIN (SELECT img, first FROM walk WHERE n = first) f ON f.img = w.img AND f.first = w.first)"""


def _place(c):
    """A packed place as row * 50 + column."""
    return F.shiftright(col(c), 32) * B.SIDE + col(c) % T.PLACE


@query("k14_outlines", f"""WITH RECURSIVE {FPX} {COMP} {EDGES}, ring AS (SELECT img, first // 4 AS ring, count_if(corner) AS corners, count(*) AS edges,
  sum(CASE s WHEN 2 THEN y + 1 WHEN 0 THEN -y ELSE 0 END) AS area FROM gone GROUP BY ALL)
SELECT ring.img, ring::BIGINT AS ring, (c - 1)::BIGINT AS blob, area > 0 AS outer, corners, edges, abs(area)::BIGINT AS area FROM ring JOIN comp ON comp.img = ring.img AND comp.id = ring.ring + 1""")
def outlines(spark, d):
    """A row for each outer and inner ring of the mask's objects."""
    mask = B.fiber_pixels(spark, d).where("fiber")
    return O.rings(O.chains(mask), mask).withColumns({"ring": _place("ring"), "blob": _place("blob")})


@query("k14_outline_points", f"WITH RECURSIVE {FPX} {EDGES} SELECT img, (first // 4)::BIGINT AS ring, row_number() OVER (PARTITION BY img, first ORDER BY gone.at) - 1 AS nth, vy::BIGINT AS y, vx::BIGINT AS x FROM gone WHERE corner")
def outline_points(spark, d):
    """The corners of each ring in order."""
    return O.ring_points(O.chains(B.fiber_pixels(spark, d).where("fiber"))).withColumn("ring", _place("ring")).withColumnRenamed("at", "nth")


@query("k14_outline_detections", f"""WITH RECURSIVE {FPX} {COMP} {EDGES}, ring AS (SELECT img, first // 4 AS ring, count(*) AS edges, sum(CASE s WHEN 2 THEN y + 1 WHEN 0 THEN -y ELSE 0 END) AS area FROM gone GROUP BY ALL)
SELECT ring.img, (c - 1)::BIGINT AS blob, count_if(area < 0) AS holes, sum(edges)::DOUBLE AS perimeter, sum(area)::DOUBLE AS area_px, sum(area) * 0.25::DOUBLE AS area_um2
FROM ring JOIN comp ON comp.img = ring.img AND comp.id = ring.ring + 1 GROUP BY ring.img, c HAVING sum(area) >= 4""")
def outline_detections(spark, d):
    """Objects of one square micrometer at least, half a micrometer a pixel."""
    mask = B.fiber_pixels(spark, d).where("fiber")
    return O.detections(O.rings(O.chains(mask), mask), 0.5, 1.0).withColumn("blob", _place("blob"))


GAPS = f"""WITH {FPX} {EDT}, t AS (SELECT a.img, a.y, a.x, a.d, max(b.d) AS m FROM dist a JOIN dist b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
gap AS (SELECT t.img, t.y, t.x, 2 * d AS w FROM t JOIN fpx USING (img, y, x) WHERE d >= m AND d > 1 AND d <= least(least(t.y, 49 - t.y), least(t.x, 49 - t.x)) AND zone)"""


def _gaps(spark, d):
    return gaps_of(_mask(spark, d))


@query("m10_gap_centers", f"{GAPS} SELECT img, y, x, round(w, 6) AS width FROM gap")
def gap_centers(spark, d):
    return _gaps(spark, d).select("img", "y", "x", F.round("w", 6).alias("width"))


@query("g05_gap_stats", f"{GAPS} SELECT img, round(avg(w), 6) AS gap_mean_px, round(max(w), 6) AS gap_max_px, count(*) AS gap_count FROM gap GROUP BY img")
def gap_stats(spark, d):
    return _gaps(spark, d).groupBy("img").agg(F.round(F.avg("w"), 6).alias("gap_mean_px"), F.round(F.max("w"), 6).alias("gap_max_px"), F.count("*").alias("gap_count"))


@query("m06_skeleton")
def skeleton(spark, d):
    return T.thinned(B.fiber_pixels(spark, d).where("fiber"))


@query("m07_orientation")
def orientation(spark, d):
    return T.orientation(B.fiber_pixels(spark, d).withColumn("v", col("g") / B.FULL_SCALE), "v", "fiber")


@query("m11_ridge_filters")
def ridge_filters(spark, d):
    px = B.pixels(spark, d).withColumn("v", F.least(F.greatest(col("g") / 30000.0, F.lit(0.0)), F.lit(1.0)))
    return T.ridges(px, "v", [1.0, 2.0], ["sato", "frangi", "meijering"])


@query("m12_coherence", """WITH p AS (SELECT img, y, x, v FROM (SELECT event_id // 2500 AS img, ((event_id % 2500) // 50)::INT AS y, (event_id % 50)::INT AS x, round(value * 100)::INT AS v FROM events)
 WHERE img IN (SELECT event_id // 2500 FROM events GROUP BY 1 HAVING count(*) = 2500)),
k AS (SELECT * FROM (VALUES (-1, 3.0::DOUBLE), (0, 10.0::DOUBLE), (1, 3.0::DOUBLE)) AS t(o, w)), o AS (SELECT a.o AS dy, b.o AS dx, a.o * b.w / 32 AS wy, b.o * a.w / 32 AS wx FROM k a, k b),
g AS (SELECT p.img, p.y, p.x, sum(wy * q.v) AS gy, sum(wx * q.v) AS gx FROM p, o JOIN p q ON q.img = p.img AND q.y = least(greatest(p.y + dy, 0), 49) AND q.x = least(greatest(p.x + dx, 0), 49) GROUP BY ALL),
s AS (SELECT img, y // 10 AS iy, x // 10 AS ix, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM g GROUP BY ALL)
SELECT img, iy, ix, round(sqrt((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy), 6) AS coherence FROM s""")
def coherence(spark, d):
    return coherence_of(_mask(spark, d))


# The same of every image, whole or not: a pixel without a row is no fiber, no background and no result, and an image ends at its own last row and column.

ANY_EDT = EDT.replace(FULL, "")
ANY_GAPS = f"""WITH {FPX} {ANY_EDT}, t AS (SELECT a.img, a.y, a.x, a.d, max(b.d) AS m FROM dist a JOIN dist b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
ends AS (SELECT img, max(y) AS y1, max(x) AS x1 FROM px GROUP BY img),
gap AS (SELECT t.img, t.y, t.x, 2 * d AS w FROM t JOIN fpx USING (img, y, x) JOIN ends ON ends.img = t.img WHERE d >= m AND d > 1 AND d <= least(least(t.y, y1 - t.y), least(t.x, x1 - t.x)) AND zone)"""


def nearest_fiber_of(px):
    """Distances to the nearest fiber; no rows of an image without one."""
    found = T.distances(px, col("fiber")).where("d < double('infinity')")
    return found.select("img", "y", "x", F.round("d", 6).alias("d"))


def fiber_width_of(px):
    found = T.distances(px, ~col("fiber")).where("d > 0 AND d < double('infinity')")
    return found.select("img", "y", "x", F.round(2 * col("d"), 6).alias("width"))


def zone_outside_of(px):
    return T.zone(px, col("zone"), "outside", 3.0)


def gaps_of(px):
    return X.gap_centers(px, col("fiber"), col("zone")).withColumnRenamed("width", "w")


def coherence_of(px):
    """Of windows of 10 pixels that lie inside their image."""
    found = X.window_coherence(px, "g", 10).where("coherence IS NOT NULL")
    return found.select("img", "iy", "ix", F.round("coherence", 6).alias("coherence"))


@query("j10_nearest_fiber_any", f"WITH {FPX} {ANY_EDT} SELECT img, y, x, round(d, 6) AS d FROM dist")
def nearest_fiber_any(spark, d):
    return nearest_fiber_of(B.fiber_pixels(spark, d))


@query("m09_fiber_width_any", f"WITH {FPX}, dist AS (SELECT a.img, a.y, a.x, sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM fpx a JOIN fpx b ON a.img = b.img AND NOT b.fiber WHERE a.fiber GROUP BY ALL) SELECT img, y, x, round(2 * d, 6) AS width FROM dist")
def fiber_width_any(spark, d):
    return fiber_width_of(B.fiber_pixels(spark, d))


@query("m01_zone_outside_any", f"""WITH {FPX}
SELECT a.img, a.y, a.x FROM fpx a WHERE NOT zone AND EXISTS (SELECT 1 FROM fpx b WHERE b.img = a.img AND b.zone AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9)""")
def zone_outside_any(spark, d):
    return zone_outside_of(B.fiber_pixels(spark, d))


@query("m10_gap_centers_any", f"{ANY_GAPS} SELECT img, y, x, round(w, 6) AS width FROM gap")
def gap_centers_any(spark, d):
    return gaps_of(B.fiber_pixels(spark, d)).select("img", "y", "x", F.round("w", 6).alias("width"))


@query("g05_gap_stats_any", f"{ANY_GAPS} SELECT img, round(avg(w), 6) AS gap_mean_px, round(max(w), 6) AS gap_max_px, count(*) AS gap_count FROM gap GROUP BY img")
def gap_stats_any(spark, d):
    return gaps_of(B.fiber_pixels(spark, d)).groupBy("img").agg(F.round(F.avg("w"), 6).alias("gap_mean_px"), F.round(F.max("w"), 6).alias("gap_max_px"), F.count("*").alias("gap_count"))


@query("m12_coherence_any", f"""WITH {PX}, p AS (SELECT img, y, x, g AS v FROM px), ends AS (SELECT img, max(y) AS y1, max(x) AS x1 FROM px GROUP BY img),
k AS (SELECT * FROM (VALUES (-1, 3.0::DOUBLE), (0, 10.0::DOUBLE), (1, 3.0::DOUBLE)) AS t(o, w)), o AS (SELECT a.o AS dy, b.o AS dx, a.o * b.w / 32 AS wy, b.o * a.w / 32 AS wx FROM k a, k b),
g AS (SELECT p.img, p.y, p.x, sum(wy * q.v) AS gy, sum(wx * q.v) AS gx FROM p JOIN ends USING (img), o JOIN p q ON q.img = p.img AND q.y = least(greatest(p.y + dy, 0), y1) AND q.x = least(greatest(p.x + dx, 0), x1) GROUP BY ALL HAVING count(*) = 9),
s AS (SELECT img, y // 10 AS iy, x // 10 AS ix, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM g JOIN ends USING (img) WHERE y // 10 < (y1 + 1) // 10 AND x // 10 < (x1 + 1) // 10 GROUP BY ALL)
SELECT img, iy, ix, round(sqrt((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy), 6) AS coherence FROM s WHERE xx + yy > 0""")
def coherence_any(spark, d):
    return coherence_of(B.pixels(spark, d))


def _skeleton(spark, d):
    return written(T.thinned(B.fiber_pixels(spark, d).where("fiber")), "skeleton")


@query("g07_segment_walk")
def segment_walk(spark, d):
    """Pieces cut at junctions, with their pixels."""
    return R.segments(_skeleton(spark, d)).groupBy("img", "fiber").agg(F.count("*").alias("n"))


@query("g08_traced_links")
def traced_links(spark, d):
    """The two ends of each link between nodes."""
    ends = R.traced_links(_skeleton(spark, d)).groupBy("img", "fiber").agg(F.min(F.struct("seq", "y", "x")).alias("a"), F.max(F.struct("seq", "y", "x")).alias("b"))
    return ends.select("img", "fiber", "a.y", "a.x", col("b.y").alias("y1"), col("b.x").alias("x1"))


@query("g09_traced_fibers")
def traced_fibers(spark, d):
    return M.path_shapes(R.traced(_skeleton(spark, d)), "img")


@query("j11_greedy_matching")
def greedy_matching(spark, d):
    """Links, pairs of their ends and fibers of each image: a pair makes one path of two, but for those that close a ring."""
    found = written(R.links(_skeleton(spark, d)), "links")
    joins = written(R.partners(found), "joins")
    fibers = R.fibers(found, joins).groupBy("img").agg(F.count("*").alias("fibers"))
    pairs = joins.groupBy("img").agg((F.count("*") / 2).cast("long").alias("pairs"))
    return found.groupBy("img").agg(F.count("*").alias("links")).join(dealt(pairs), "img", "left").join(dealt(fibers), "img", "left").select("img", "fibers", "links", F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("g06_window_morphometrics")
def window_morphometrics(spark, d):
    """Length, branches, ends, straightness, gaps and curvature, window by window."""
    px = B.fiber_pixels(spark, d)
    return X.window_morphometrics(px, col("fiber"), window=10)


WIN = "SELECT *, (y // 10)::INT AS iy, (x // 10)::INT AS ix, y % 10 AS wy, x % 10 AS wx FROM fpx"


@query("g06_window_fractals", f"""WITH {FPX}, w AS ({WIN}), s AS (SELECT unnest([1, 2, 4, 8]) AS s),
b AS (SELECT DISTINCT img, iy, ix, s, wy // s AS by, wx // s AS bx FROM w, s WHERE fiber AND wy // s < 10 // s AND wx // s < 10 // s),
c AS (SELECT img, iy, ix, s, count(*) AS n FROM b GROUP BY ALL), fd AS (SELECT img, iy, ix, regr_slope(ln(n), ln(1.0::DOUBLE / s)) AS fd FROM c GROUP BY ALL),
g AS (SELECT a.img, a.iy, a.ix, a.y, a.x, sum(q.fiber::INT) AS b FROM w a JOIN w q ON a.img = q.img AND a.iy = q.iy AND a.ix = q.ix AND q.y BETWEEN a.y - 2 AND a.y + 1 AND q.x BETWEEN a.x - 2 AND a.x + 1
    WHERE a.wy >= 3 AND a.wx >= 3 GROUP BY ALL),
l AS (SELECT img, iy, ix, CASE WHEN avg(b) > 0 THEN 1 + var_pop(b) / avg(b) ** 2 END AS lac FROM g GROUP BY ALL)
SELECT img, iy, ix, round(fd, 6) AS fractal_dimension, round(lac, 6) AS lacunarity_4 FROM (SELECT DISTINCT img, iy, ix FROM w) LEFT JOIN fd USING (img, iy, ix) LEFT JOIN l USING (img, iy, ix)""")
def window_fractals(spark, d):
    """Fractal dimension and lacunarity of the fibers, window by window."""
    px = B.fiber_pixels(spark, d)
    found = X.window_fractals(px, col("fiber"), px.where("fiber"), 10, (1, 2, 4, 8, 16), (4, 16))
    return found.select("img", "iy", "ix", F.round("fractal_dimension", 6).alias("fractal_dimension"), F.round("lacunarity_4", 6).alias("lacunarity_4"))


@query("g11_radon_alignment")
def radon_alignment(spark, d):
    return X.alignment(B.pixels(spark, d), "g", B.SIDE)


@query("m13_segmentation", f"""WITH RECURSIVE {FPX.replace('g >= 7000 AS fiber', 'g >= 9000 AS fiber')} {COMP} SELECT img, count(*) AS n FROM sized WHERE n >= 3 GROUP BY img""")
def segmentation(spark, d):
    """Channel, threshold, small objects: a composition."""
    mask = X.segmented(B.pixels(spark, d), col("g"), cut=9000, least=3)
    return mask.groupBy("img").agg(F.count("*").alias("n"))


@query("m13_segmentation_ridges")
def segmentation_ridges(spark, d):
    """The whole chain: ridges, background taken off, threshold, closing, small objects."""
    mask = X.segmented(B.pixels(spark, d), F.least(col("g") / 30000.0, F.lit(1.0)), cut=0.02, least=3, ridge="sato", sigmas=[1.0, 2.0], flatten=True, close=True)
    return mask.groupBy("img").agg(F.count("*").alias("n"))


@query("f01_pooled_features_all")
def pooled_features_all(spark, d):
    """All 19 features of the bank, with clamped edge windows."""
    px = B.fiber_pixels(spark, d).withColumn("v", col("g") / B.FULL_SCALE)
    return X.pooled(X.feature_planes(px, col("fiber"), "v"), window=11, stride=7, height=B.SIDE, width=B.SIDE, pixel_um=0.5)


DISK = "b.y BETWEEN a.y - 3 AND a.y + 3 AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 9"


@query("m04_rolling_ball", f"""WITH {PX}, er AS (SELECT a.img, a.y, a.x, min(b.g) AS g FROM px a JOIN px b ON a.img = b.img AND {DISK} GROUP BY ALL),
op AS (SELECT a.img, a.y, a.x, max(b.g) AS g FROM er a JOIN er b ON a.img = b.img AND {DISK} GROUP BY ALL)
SELECT img, y, x, (px.g - op.g)::DOUBLE AS g FROM px JOIN op USING (img, y, x)""")
def rolling_ball(spark, d):
    """Each pixel less the opening by the disk of radius 3."""
    return T.rolling_ball(B.pixels(spark, d), "g", 3)


@query("m13_segmentation_methods")
def segmentation_methods(spark, d):
    """Pixels of the fibers of each image by background off, threshold method, closing and least size."""
    px = B.pixels(spark, d).withColumn("u", col("g") / B.FULL_SCALE)
    parts = [X.segmented(px, col("u"), how, 4, ball=ball, close=True).groupBy("img").agg(F.count("*").alias("n")).select(F.lit(how).alias("method"), F.lit(ball).alias("ball"), "img", "n")
             for how, ball in (("otsu", 0), ("otsu", 10), ("triangle", 10))]
    return parts[0].union(parts[1]).union(parts[2])
