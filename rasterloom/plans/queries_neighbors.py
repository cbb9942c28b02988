"""Queries of neighborhoods, texture and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as N
from ..operators import texture as T
from ..sources import bindings as B
from .registry import query
from .views import FPX, PATCH, PX

col = F.col
GRID = {"window": 10, "stride": 10, "height": 50, "width": 50}
HOLED = PX + ", h AS (SELECT img, y, x, CASE WHEN g % 7 <> 0 THEN g / 100.0::DOUBLE END AS v, (g % 180)::DOUBLE AS theta, CASE WHEN g % 5 = 0 THEN 0 ELSE g / 100.0::DOUBLE END AS w FROM px)"


def holed(spark, d):
    """A plane with holes, an angle and a weight."""
    return B.pixels(spark, d).select("img", "y", "x", F.when(col("g") % 7 != 0, col("g") / 100.0).alias("v"), (col("g") % 180).cast("double").alias("theta"),
                                     F.when(col("g") % 5 == 0, F.lit(0.0)).otherwise(col("g") / 100.0).alias("w"))


def box(r, select, where=""):
    return f"SELECT a.img, a.y, a.x, {select} FROM h a JOIN h b ON a.img = b.img AND b.y BETWEEN a.y - {r} AND a.y + {r} AND b.x BETWEEN a.x - {r} AND a.x + {r} {where} GROUP BY a.img, a.y, a.x, a.v, a.theta"


@query("w01_box_mean_sd_count", f"WITH {HOLED} {box(1, 'round(avg(b.v), 6) AS mean, round(stddev_pop(b.v), 3) AS sd, count(b.v) AS n')}")
def box_mean_sd_count(spark, d):
    return N.box_stats(holed(spark, d), col("v"), 1, "b_").select("img", "y", "x", F.round("b_mean", 6).alias("mean"), F.round("b_sd", 3).alias("sd"), col("b_n").alias("n"))


@query("w02_local_contrast", f"WITH {HOLED} {box(2, 'round(a.v - avg(b.v), 6) AS contrast')}")
def local_contrast(spark, d):
    return N.box_stats(holed(spark, d), col("v"), 2, "b_").select("img", "y", "x", F.round(col("v") - col("b_mean"), 6).alias("contrast"))


@query("w03_orientation_context", f"""WITH {HOLED}, s AS ({box(1, 'a.theta, sum(b.w * cos(2 * radians(b.theta))) AS c, sum(b.w * sin(2 * radians(b.theta))) AS s, sum(b.w) AS w', '')}),
t AS (SELECT *, abs(theta - ((degrees(atan2(s, c)) / 2) % 180 + 180) % 180) AS q FROM s)
SELECT img, y, x, CASE WHEN w > 0 THEN round(1 - sqrt(c * c + s * s) / w, 5) END AS dispersion, CASE WHEN w > 0 THEN round(least(q, 180 - q), 4) END AS deviation FROM t""")
def orientation_context(spark, d):
    return N.orientation_context(holed(spark, d), col("theta"), col("w"), 1).select("img", "y", "x", F.round("dispersion", 5).alias("dispersion"), F.round("deviation", 4).alias("deviation"))


@query("w04_coverage_gradient", f"""WITH {HOLED}, m AS (SELECT img, y, x, coalesce(mean, 0) AS v, n FROM ({box(1, 'avg(b.v) AS mean, count(b.v) AS n')})),
g AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS e, lag(v) OVER c AS u, lead(v) OVER c AS d FROM m WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y))
SELECT img, y, x, CASE WHEN n > 0 THEN round(CASE WHEN l IS NULL THEN e - v WHEN e IS NULL THEN v - l ELSE (e - l) / 2 END, 9) END AS gx,
 CASE WHEN n > 0 THEN round(CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END, 9) END AS gy FROM g""")
def coverage_gradient(spark, d):
    smooth = N.box_stats(holed(spark, d), col("v"), 1, "b_").withColumn("v", F.coalesce("b_mean", F.lit(0.0)))
    g = N.gradient(smooth, col("v"))
    return g.select("img", "y", "x", *(F.when(col("b_n") > 0, F.round(c, 9)).alias(c) for c in ("gx", "gy")))


@query("w05_context_bank", f"""WITH {HOLED}, a AS ({box(1, 'round(avg(b.v), 9) AS v_mean_r1, round(stddev_pop(b.v), 3) AS v_sd_r1, round(a.v - avg(b.v), 9) AS v_dev_r1, round(avg(b.w), 9) AS w_mean_r1')}),
c AS ({box(3, 'round(avg(b.v), 9) AS v_mean_r3, round(avg(b.w), 9) AS w_mean_r3')}) SELECT * FROM a JOIN c USING (img, y, x)""")
def context_bank(spark, d):
    bank = N.context_bank(holed(spark, d), ["v", "w"])
    return bank.select("img", "y", "x", *(F.round(c, 3 if "sd" in c else 9).alias(c) for c in ("v_mean_r1", "v_sd_r1", "v_dev_r1", "w_mean_r1", "v_mean_r3", "w_mean_r3")))


def _turns(r):
    """SQL of the terms of a radius: dispersion and deviation of the angle, and the size of the gradient of the mean of v."""
    axis = "((degrees(atan2(s, c)) / 2) % 180 + 180) % 180"
    return f"""o{r} AS (SELECT img, y, x, CASE WHEN w > 0 THEN round(1 - least(1, sqrt(c * c + s * s) / w), 5) END AS angular_dispersion_r{r},
  CASE WHEN w > 0 THEN round(least(abs(theta - {axis}) % 180, 180 - abs(theta - {axis}) % 180), 4) END AS angle_dev_r{r}
  FROM ({box(r, 'a.theta, sum(b.w * cos(2 * radians(b.theta))) AS c, sum(b.w * sin(2 * radians(b.theta))) AS s, sum(b.w) AS w')})),
g{r} AS (SELECT img, y, x, n, coalesce(mean, 0) AS v, lag(v) OVER r AS l, lead(v) OVER r AS e, lag(v) OVER c AS u, lead(v) OVER c AS d
  FROM (SELECT img, y, x, n, mean, coalesce(mean, 0) AS v FROM ({box(r, 'avg(b.v) AS mean, count(b.v) AS n')})) WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)),
s{r} AS (SELECT img, y, x, CASE WHEN n > 0 THEN round(sqrt(CASE WHEN l IS NULL THEN e - v WHEN e IS NULL THEN v - l ELSE (e - l) / 2 END ** 2
  + CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END ** 2), 6) END AS coverage_grad_r{r} FROM g{r})"""


@query("w05_context_terms", f"WITH {HOLED}, {_turns(1)}, {_turns(3)} SELECT * FROM o1 JOIN o3 USING (img, y, x) JOIN s1 USING (img, y, x) JOIN s3 USING (img, y, x)")
def context_terms(spark, d):
    """The three terms of the bank that are no base's own: dispersion, deviation of the axis, gradient of the coverage."""
    bank = N.context_bank(holed(spark, d), ["v"], angle="theta", weight="w", coverage="v")
    return bank.select("img", "y", "x", *(F.round(f"{n}_r{r}", k).alias(f"{n}_r{r}") for r in (1, 3) for n, k in (("angular_dispersion", 5), ("angle_dev", 4), ("coverage_grad", 6))))


@query("w06_centered_box_mean", f"""WITH {PX}, c AS (SELECT k, least(k * 6 + 3, 49) AS at FROM unnest(range(9)) AS t(k))
SELECT img, cy.k AS gy, cx.k AS gx, round(avg(g), 6) AS mean FROM px JOIN c cy ON y BETWEEN cy.at - 4 AND cy.at + 3 JOIN c cx ON x BETWEEN cx.at - 4 AND cx.at + 3 GROUP BY ALL""")
def centered_box_mean(spark, d):
    return N.centered_mean(B.pixels(spark, d), col("g"), 8, 6, 50, 50).select("img", "gy", "gx", F.round("mean", 6).alias("mean"))


@query("w08_summed_area", f"WITH {PX} SELECT img, y, x, sum(r) OVER (PARTITION BY img, x ORDER BY y)::BIGINT AS area_sum FROM (SELECT *, sum(g) OVER (PARTITION BY img, y ORDER BY x) AS r FROM px)")
def summed_area(spark, d):
    return N.summed_area(B.pixels(spark, d), col("g")).select("img", "y", "x", "area_sum")


NEAR = " + ".join(f"(CASE WHEN max(CASE WHEN b.y = a.y + {dy} AND b.x = a.x + {dx} THEN 1 END) = 1 THEN {1 << k} ELSE 0 END)" for k, (dy, dx) in enumerate(N.RING))
CODES = FPX + f""", f AS (SELECT img, y, x FROM fpx WHERE fiber), codes AS (SELECT a.img, a.y, a.x, {NEAR} AS code
 FROM f a LEFT JOIN f b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
cx AS (SELECT *, bit_count(code)::INT AS nb, bit_count(code & (255 - (((code * 2) & 255) | (code // 128))))::INT AS cr FROM codes)"""


@query("j08_neighbor_codes", f"WITH {CODES} SELECT img, y, x, code, nb AS neighbors FROM cx")
def neighbor_codes(spark, d):
    return N.ring_codes(B.fiber_pixels(spark, d).where("fiber")).select("img", "y", "x", "code", "neighbors")


@query("m08_junctions_endpoints", f"WITH {CODES} SELECT img, count_if(cr >= 3)::BIGINT AS junctions, count_if(nb = 1)::BIGINT AS endpoints, sum(cr)::BIGINT AS crossings FROM cx GROUP BY img")
def junctions_endpoints(spark, d):
    codes = N.ring_codes(B.fiber_pixels(spark, d).where("fiber"))
    return codes.groupBy("img").agg(F.count_if("is_junction").alias("junctions"), F.count_if("is_endpoint").alias("endpoints"), F.sum("crossings").alias("crossings"))


@query("g01_length_branch_endpoint", f"""WITH {CODES} SELECT img, (y // 10)::BIGINT AS iy, (x // 10)::BIGINT AS ix, count(*) AS length_px, count_if(cr >= 3)::BIGINT AS branch_points, count_if(nb = 1)::BIGINT AS endpoints FROM cx GROUP BY ALL""")
def length_branch_endpoint(spark, d):
    codes = N.ring_codes(B.fiber_pixels(spark, d).where("fiber"))
    return codes.groupBy("img", F.floor(col("y") / 10).alias("iy"), F.floor(col("x") / 10).alias("ix")).agg(
        F.count("*").alias("length_px"), F.count_if("is_junction").alias("branch_points"), F.count_if("is_endpoint").alias("endpoints"))


PLUSJ = "abs({a}.y - {b}.y) + abs({a}.x - {b}.x) <= 1"


@query("m03_binary_closing", f"""WITH {FPX}, f AS (SELECT img, y, x FROM fpx WHERE fiber),
dil AS (SELECT DISTINCT p.img, p.y, p.x FROM px p JOIN f ON p.img = f.img AND {PLUSJ.format(a='p', b='f')})
SELECT p.img, p.y, p.x FROM px p JOIN dil USING (img, y, x) WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.img = p.img AND {PLUSJ.format(a='p', b='q')}
 AND NOT EXISTS (SELECT 1 FROM dil e WHERE e.img = q.img AND e.y = q.y AND e.x = q.x))""")
def binary_closing(spark, d):
    return N.closed(B.fiber_pixels(spark, d), "fiber")


@query("m04_top_hat", f"""WITH {PX}, er AS (SELECT a.img, a.y, a.x, min(b.g) AS g FROM px a JOIN px b ON a.img = b.img AND {PLUSJ.format(a='a', b='b')} GROUP BY ALL),
op AS (SELECT a.img, a.y, a.x, max(b.g) AS g FROM er a JOIN er b ON a.img = b.img AND {PLUSJ.format(a='a', b='b')} GROUP BY ALL)
SELECT img, y, x, px.g - op.g AS v FROM px JOIN op USING (img, y, x)""")
def top_hat(spark, d):
    return N.top_hat(B.pixels(spark, d), "g")


@query("t01_quantise", f"WITH {PATCH} SELECT img, y, x, floor(least(greatest((v + 0.4::DOUBLE) / 0.8::DOUBLE, 0), 1) * 15 + 0.5)::INT AS level FROM patch")
def quantise(spark, d):
    return B.patches(spark, d).select("img", "y", "x", T.quantised(col("v") + 0.4, 0.0, 0.8, 16).alias("level"))


GL = FPX + """, lv AS (SELECT img, y, x, floor(least(greatest(g / 65535.0::DOUBLE / 0.5::DOUBLE, 0), 1) * 7 + 0.5)::INT AS l FROM fpx WHERE fiber),
mv AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) AS t(k, dy, dx), unnest([1, 2]) AS u(s)),
pr AS (SELECT a.img, a.y // 10 AS iy, a.x // 10 AS ix, s, k, a.l AS a, b.l AS b FROM lv a, mv JOIN lv b ON a.img = b.img AND b.y = a.y + dy * s AND b.x = a.x + dx * s AND b.y // 10 = a.y // 10 AND b.x // 10 = a.x // 10),
c AS (SELECT img, iy, ix, s, k, a, b, count(*) AS n FROM (SELECT * FROM pr UNION ALL SELECT img, iy, ix, s, k, b, a FROM pr) GROUP BY ALL)"""
HAR = """, p AS (SELECT *, n / sum(n) OVER (PARTITION BY img, iy, ix, s, k)::DOUBLE AS p FROM c),
m AS (SELECT img, iy, ix, s, k, sum(p * (a - b) ** 2) AS contrast, sum(p * abs(a - b)) AS dissimilarity, sum(p / (1 + (a - b) ** 2)) AS homogeneity, sqrt(sum(p * p)) AS energy,
  -sum(p * log2(p)) AS entropy, sum(p * a) AS ma, sum(p * a * a) AS qa, sum(p * a * b) AS ab FROM p GROUP BY ALL)"""
CORR = "round(avg(CASE WHEN qa - ma * ma < 1e-12 THEN 1 ELSE (ab - ma * ma) / (qa - ma * ma) END), 5) AS correlation"
AVGS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("contrast", "dissimilarity", "homogeneity", "energy", "entropy"))


def _pairs(spark, d, distances=(1, 2)):
    lv = B.fiber_pixels(spark, d).where("fiber").select("img", "y", "x", T.quantised(col("g") / B.FULL_SCALE, 0.0, 0.5, 8).alias("level"))
    return T.cooccurrence(lv, distances, **GRID)


@query("j09_cooccurrence_pairs", f"WITH {GL} SELECT img, iy::INT AS iy, ix::INT AS ix, s AS distance, k AS direction, a, b, n FROM c")
def cooccurrence_pairs(spark, d):
    return _pairs(spark, d)


def _rounded(df, *keys):
    return df.select(*keys, *(F.round(n, 5 if n == "correlation" else 6).alias(n) for n in ("contrast", "dissimilarity", "homogeneity", "energy", "entropy", "correlation")))


@query("t02_glcm_texture", f"WITH {GL} {HAR} SELECT img, iy::INT AS iy, ix::INT AS ix, {AVGS}, {CORR} FROM m GROUP BY img, iy, ix")
def glcm_texture(spark, d):
    return _rounded(T.haralick(_pairs(spark, d), "img", "iy", "ix"), "img", "iy", "ix")


@query("t03_texture_by_distance", f"WITH {GL} {HAR} SELECT img, iy::INT AS iy, ix::INT AS ix, s AS distance, {AVGS}, {CORR} FROM m GROUP BY img, iy, ix, s")
def texture_by_distance(spark, d):
    return _rounded(T.haralick(_pairs(spark, d), "img", "iy", "ix", "distance"), "img", "iy", "ix", "distance")


@query("a16_mean_texture", f"WITH {GL} {HAR}, w AS (SELECT img, iy, ix, avg(contrast) AS contrast, avg(energy) AS energy FROM m GROUP BY ALL) SELECT img, round(avg(contrast), 6) AS contrast, round(avg(energy), 6) AS energy FROM w GROUP BY img")
def mean_texture(spark, d):
    """Means over windows before any gate."""
    per = T.haralick(_pairs(spark, d), "img", "iy", "ix")
    return per.groupBy("img").agg(F.round(F.avg("contrast"), 6).alias("contrast"), F.round(F.avg("energy"), 6).alias("energy"))


LV = PX + ", lv AS (SELECT img, floor(least(g / 30000.0::DOUBLE, 1) * 15 + 0.5)::INT AS level FROM px)"


@query("t04_level_use", f"""WITH {LV}, per AS (SELECT img, level, count(*) AS n FROM lv GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY n DESC, level ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY img) AS whole, max(level) OVER (PARTITION BY img) AS hi FROM per),
f AS (SELECT img, (count_if(run < 0.99::DOUBLE * whole) + 1)::BIGINT AS fewest, round(100.0::DOUBLE * sum(CASE WHEN level IN (0, hi) THEN n ELSE 0 END) / max(whole), 6) AS clipped FROM r GROUP BY img)
SELECT img, quantile_cont(level::DOUBLE, 0.01) AS p1, quantile_cont(level::DOUBLE, 0.99) AS p99, any_value(fewest) AS fewest, any_value(clipped) AS clipped FROM lv JOIN f USING (img) GROUP BY img""")
def level_use(spark, d):
    return T.level_use(B.pixels(spark, d).select("img", T.quantised(col("g") / 30000.0, 0.0, 1.0, 16).alias("level")))


@query("a09_level_note", f"""WITH {LV}, u AS (SELECT img, count(DISTINCT level) AS n FROM lv GROUP BY img) SELECT min(n) AS least, max(n) AS most, count_if(n < 8)::BIGINT AS few FROM u""")
def level_note(spark, d):
    """Regions that use fewer than min(8, levels / 2) levels."""
    per = B.pixels(spark, d).groupBy("img").agg(F.countDistinct(T.quantised(col("g") / 30000.0, 0.0, 1.0, 16)).alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(col("n") < min(8, 16 // 2)).alias("few"))


HIST = PX + ", hist AS (SELECT least(floor(g / 65535.0::DOUBLE * 1024), 1023)::INT AS bin, count(*) AS n FROM px GROUP BY 1)"


def _hist(spark, d, bins=1024):
    return T.histogram(B.pixels(spark, d), col("g") / B.FULL_SCALE, bins)


@query("a10_pooled_histogram", f"WITH {PX} SELECT least(floor(g / 65535.0::DOUBLE * 65536), 65535)::INT AS bin, count(*) AS n FROM px GROUP BY 1")
def pooled_histogram(spark, d):
    return _hist(spark, d, T.BINS)


OTSU = """r AS (SELECT bin, sum(n) OVER o AS w0, sum(n * (bin + 0.5::DOUBLE)) OVER o AS m0, sum(n) OVER () AS w, sum(n * (bin + 0.5::DOUBLE)) OVER () AS m FROM hist WINDOW o AS (ORDER BY bin)),
otsu AS (SELECT (bin + 0.5::DOUBLE) / 1024 AS cut FROM r WHERE w > w0 ORDER BY w0::DOUBLE * (w - w0) * (m0 / w0 - (m - m0) / (w - w0)) ** 2 DESC, bin LIMIT 1)"""


@query("h01_otsu", f"WITH {HIST}, {OTSU} SELECT cut FROM otsu")
def otsu(spark, d):
    return T.otsu(_hist(spark, d), 1024)


@query("h02_triangle", f"""WITH {HIST}, e AS (SELECT min(bin) AS lo, max(bin) AS hi, max(n) AS top, arg_max(bin, (n, -bin)) AS peak FROM hist),
t AS (SELECT *, CASE WHEN hi - peak >= peak - lo THEN hi ELSE lo END AS tail FROM e),
b AS (SELECT t.*, unnest(range(least(peak, tail), greatest(peak, tail) + 1)) AS bin FROM t),
q AS (SELECT bin, round(top * abs(tail - bin) / greatest(abs(tail - peak), 1)::DOUBLE - coalesce(n, 0), 6) AS d FROM b LEFT JOIN hist USING (bin))
SELECT bin::INT AS bin, (bin + 0.5::DOUBLE) / 1024 AS cut FROM q ORDER BY d DESC, bin LIMIT 1""")
def triangle(spark, d):
    return T.triangle(_hist(spark, d), 1024)


@query("h03_resolved_threshold", f"WITH {HIST}, {OTSU} SELECT img, count(*) AS n FROM px, otsu WHERE g / 65535.0::DOUBLE >= cut GROUP BY img")
def resolved_threshold(spark, d):
    """The cut that a method gives (an unknown one falls back to Otsu), applied as one broadcast row."""
    cut = {"triangle": T.triangle, "otsu": T.otsu}.get("unknown", T.otsu)(_hist(spark, d), 1024)
    return B.pixels(spark, d).join(F.broadcast(cut)).where(col("g") / B.FULL_SCALE >= col("cut")).groupBy("img").agg(F.count("*").alias("n"))


@query("h07_run_wide_cut", f"""WITH {HIST}, {OTSU} SELECT img, (y // 25)::BIGINT AS iy, count(*) AS n, round((SELECT cut FROM otsu), 8) AS cut FROM px WHERE g / 65535.0::DOUBLE >= (SELECT cut FROM otsu) GROUP BY ALL""")
def run_wide_cut(spark, d):
    """One cut for all images of a run."""
    cut = T.otsu(_hist(spark, d), 1024)
    return (B.pixels(spark, d).join(F.broadcast(cut)).where(col("g") / B.FULL_SCALE >= col("cut"))
            .groupBy("img", F.floor(col("y") / 25).alias("iy")).agg(F.count("*").alias("n"), F.round(F.first("cut"), 8).alias("cut")))


@query("h11_segmentation_preview", f"WITH {HIST}, {OTSU} SELECT round(100.0::DOUBLE * count_if(g / 65535.0::DOUBLE >= cut) / count(*), 6) AS coverage_pct, max(g) AS peak, 65535 AS full_scale FROM px, otsu")
def segmentation_preview(spark, d):
    cut = T.otsu(_hist(spark, d), 1024)
    return B.pixels(spark, d).join(F.broadcast(cut)).agg(F.round(100.0 * F.count_if(col("g") / B.FULL_SCALE >= col("cut")) / F.count("*"), 6).alias("coverage_pct"),
                                                         F.max("g").alias("peak"), F.lit(B.FULL_SCALE).alias("full_scale"))


@query("t05_gray_range", f"""WITH {HIST}, r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS run, sum(n) OVER () AS w FROM hist), c AS (SELECT (bin + 0.5::DOUBLE) / 1024 AS c, n FROM hist),
m AS (SELECT sum(c * n) / sum(n) AS m, sum(c * c * n) / sum(n) AS q FROM c)
SELECT 'percentile_1_99' AS rule, round((min(bin) FILTER (run >= 0.01::DOUBLE * w) + 0.5::DOUBLE) / 1024, 8) AS lo, round((min(bin) FILTER (run >= 0.99::DOUBLE * w) + 0.5::DOUBLE) / 1024, 8) AS hi FROM r
UNION ALL SELECT 'mean_3sd', round(greatest(m - 3 * sqrt(q - m * m), 0), 8), round(least(m + 3 * sqrt(q - m * m), 1), 8) FROM m UNION ALL SELECT 'min_max', round(min(c), 8), round(max(c), 8) FROM c""")
def gray_range(spark, d):
    h = _hist(spark, d)
    parts = [T.gray_range(h, 1024, rule).select(F.lit(rule).alias("rule"), F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi")) for rule in ("percentile_1_99", "mean_3sd", "min_max")]
    return parts[0].union(parts[1]).union(parts[2])


@query("h09_gray_range_of_run", f"""WITH {HIST}, {OTSU}, f AS (SELECT least(floor(g / 65535.0::DOUBLE * 1024), 1023)::INT AS bin FROM px, otsu WHERE g / 65535.0::DOUBLE >= cut AND (y // 25 + x // 25) % 2 = 0)
SELECT round((min(bin) + 0.5::DOUBLE) / 1024, 8) AS lo, round((max(bin) + 0.5::DOUBLE) / 1024, 8) AS hi FROM f""")
def gray_range_of_run(spark, d):
    """The gray range of fiber pixels, by the run's cut, in sampled boxes."""
    cut = T.otsu(_hist(spark, d), 1024)
    fiber = B.pixels(spark, d).join(F.broadcast(cut)).where((col("g") / B.FULL_SCALE >= col("cut")) & ((F.floor(col("y") / 25) + F.floor(col("x") / 25)) % 2 == 0))
    return T.gray_range(T.histogram(fiber, col("g") / B.FULL_SCALE, 1024), 1024, "min_max").select(F.round("lo", 8).alias("lo"), F.round("hi", 8).alias("hi"))
