"""Queries of sinks, readers, models and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import model as Mo
from ..operators import windows as W
from ..sources import bindings as B
from ..sources import readers as Rd
from ..sources.shared import written
from .registry import query
from .run import analyze, density_tile
from .views import FPX, PX, TRAIN

col = F.col
WIN = "win AS (SELECT * FROM unnest(range(5)) AS a(iy), unnest(range(5)) AS b(ix))"
SUMS = f"{FPX}, {WIN}, s AS (SELECT img, iy, ix, count_if(fiber)::BIGINT AS n, round(avg(g), 4) AS m FROM fpx JOIN win ON y // 10 = iy AND x // 10 = ix GROUP BY ALL)"


def _windows(spark, d):
    sums = W.window_sums(B.fiber_pixels(spark, d), {"n": col("fiber").cast("long"), "g": col("g"), "a": F.lit(1)}, window=10, stride=10, height=50, width=50)
    return sums.select("img", (col("ix") * 10).alias("x"), (col("iy") * 10).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"), (col("n") >= 25).alias("included"),
                       col("n").alias("n_fiber_px"), (100.0 * col("n") / 100).alias("fiber_coverage_percent"), F.round(col("g") / col("a"), 4).alias("gray_mean"))


@query("k01_window_records", f"WITH {SUMS} SELECT img, ix * 10 AS x, iy * 10 AS y, CASE WHEN n >= 25 THEN 9 ELSE 7 END::BIGINT - CASE WHEN n >= 25 THEN 1 ELSE 0 END AS n_keys, CASE WHEN n >= 25 THEN m END AS gray_mean, n AS n_fiber_px FROM s")
def window_records(spark, d):
    """windows.json, one record a window, flattened again: the stub has seven keys."""
    record = R.window_record(col("included"), [*R.STUB, "gray_mean"])
    listed = _windows(spark, d).select("img", record.alias("r"))
    one = F.from_json("r", "x int, y int, n_fiber_px long, gray_mean double")
    return listed.select("img", one.alias("v"), F.size(F.json_object_keys("r")).cast("long").alias("n_keys")).select(
        "img", col("v.x").cast("long").alias("x"), col("v.y").cast("long").alias("y"), "n_keys", "v.gray_mean", "v.n_fiber_px")


@query("k02_results_record", f"WITH {TRAIN} SELECT row, CASE WHEN f1 = 0 THEN NULL ELSE f2 / f1 END AS mean_price, f1 AS n FROM train")
def results_record(spark, d):
    t = B.training(spark, d).select("row", F.when(col("f1") == 0, F.lit(float("nan"))).otherwise(F.try_divide("f2", "f1")).alias("mean_price"), col("f1").alias("n"), F.array("f1").alias("plane"))
    listed = R.clean_numbers(t).select(F.to_json(F.struct("row", "mean_price", "n")).alias("r"))
    return listed.select(F.from_json("r", "row long, mean_price double, n double").alias("v")).select("v.*")


@query("k03_wide_metrics", f"WITH {SUMS} SELECT img, ix * 10 AS x, iy * 10 AS y, n AS morph_n, m AS texture_mean FROM s")
def wide_metrics(spark, d):
    return _windows(spark, d).select("img", col("x").cast("long").alias("x"), col("y").cast("long").alias("y"), col("n_fiber_px").alias("morph_n"), col("gray_mean").alias("texture_mean"))


@query("k06_heatmap_values", f"WITH {SUMS} SELECT img, ix * 10 AS x, iy * 10 AS y, round((m - min(m) OVER (PARTITION BY img)) / greatest(max(m) OVER (PARTITION BY img) - min(m) OVER (PARTITION BY img), 1e-12), 6) AS v FROM s")
def heatmap_values(spark, d):
    w = _windows(spark, d)
    ends = w.groupBy("img").agg(F.min("gray_mean").alias("lo"), F.max("gray_mean").alias("hi"))
    return w.join(ends, "img").select("img", col("x").cast("long").alias("x"), col("y").cast("long").alias("y"), F.round(R.normed(col("gray_mean"), col("lo"), col("hi")), 6).alias("v"))


@query("k08_text_summary", "SELECT unnest(['r_regionkey: ' || r_regionkey, 'r_name: ' || r_name]) AS line FROM region")
def text_summary(spark, d):
    return R.summary_lines(B.table(spark, d, "region"))


@query("k09_provenance")
def provenance(spark, d):
    return spark.createDataFrame(R.provenance({"window": 10, "stride": 5, "least_coverage": 5.0}, "1"), "name string, text string")


@query("k10_threshold_record", f"WITH {PX} SELECT img, 'otsu' AS method, 'gray' AS unit, max(g) / 65535.0::DOUBLE AS value FROM px GROUP BY img")
def threshold_record(spark, d):
    per = B.pixels(spark, d).groupBy("img").agg((F.max("g") / B.FULL_SCALE).alias("value"))
    text = per.select("img", F.to_json(F.struct(F.lit("otsu").alias("method"), F.lit("gray").alias("unit"), "value")).alias("r"))
    return text.select("img", F.from_json("r", "method string, unit string, value double").alias("v")).select("img", "v.*")


@query("k10_threshold_identity", f"""WITH {FPX}, {WIN}, h AS (SELECT img, least(floor(g / 65535.0::DOUBLE * 1024), 1023)::INT AS bin, count(*) AS n FROM px GROUP BY ALL),
r AS (SELECT img, bin, sum(n) OVER o AS w0, sum(n * (bin + 0.5::DOUBLE)) OVER o AS m0, sum(n) OVER p AS w, sum(n * (bin + 0.5::DOUBLE)) OVER p AS m FROM h WINDOW o AS (PARTITION BY img ORDER BY bin), p AS (PARTITION BY img)),
cut AS (SELECT img, (arg_max(bin, (w0::DOUBLE * (w - w0) * (m0 / w0 - (m - m0) / (w - w0)) ** 2, -bin)) + 0.5::DOUBLE) / 1024 AS cut FROM r WHERE w > w0 GROUP BY img),
told AS (SELECT img, CASE WHEN img % 3 = 1 THEN 7000.0::DOUBLE ELSE cut END AS value, CASE WHEN img % 3 = 1 THEN 'Manual gray level 7000 | set by hand'
  WHEN img % 3 = 2 THEN 'Calibrated ' || printf('%#.4g', cut) || ' | image ' || img ELSE 'Otsu ' || printf('%#.4g', cut) || ' | image ' || img END AS cut,
  substr(sha256('channel=gray;ridge=none;sigmas=;invert=' || (img % 2 = 1) || ';rb=0.00000;minarea=1.00000'), 1, 8) AS key FROM cut),
s AS (SELECT img, iy, ix, count_if(fiber) AS n FROM fpx JOIN win ON y // 10 = iy AND x // 10 = ix GROUP BY ALL)
SELECT img, cut || ' | settings ' || key || ' at 0.5 um/px' AS threshold, key, value, 'fraction of full scale' <> CASE WHEN img % 3 = 1 THEN 'gray level' ELSE 'fraction of full scale' END AS in_grays, count(s.n) AS objects
FROM told LEFT JOIN s USING (img) GROUP BY ALL""")
def threshold_identity(spark, d):
    """The record of each image's own cut, read back, and the windows that are stamped with it."""
    from ..operators import texture as T
    px = B.pixels(spark, d)
    cuts = T.otsu_each(T.histogram(px, col("g") / B.FULL_SCALE, 1024, "img"), 1024, "img")
    manual = col("img") % 3 == 1
    runs = cuts.select(
        "img", F.when(manual, "Manual").when(col("img") % 3 == 2, "project_otsu").otherwise("Otsu").alias("threshold_method"), F.when(manual, 7000.0).otherwise(col("cut")).alias("value"),
        F.format_string("image %d", "img").alias("source"), F.lit(0.25).alias("pixel_um"), F.lit("gray").alias("channel"), F.lit("None").alias("ridge_filter"),
        *(F.lit(1.0).alias(f"sigma_{n}_um") for n in ("min", "max", "step")), (col("img") % 2 == 1).alias("invert_intensity"), F.lit(0.0).alias("rolling_ball_radius_um"),
        F.lit(1.0).alias("min_fiber_area_um2"), F.lit(2.0).alias("analysis_downsample"))
    records = R.threshold_records(runs)
    read = F.from_json("record", "settings_fingerprint string, value double, unit string")
    windows = R.stamped(_windows(spark, d).select("img", "x", "y"), records).groupBy("img", "threshold").agg(F.count("*").alias("objects"))
    told = records.select("img", read.alias("r")).select("img", col("r.settings_fingerprint").alias("key"), "r.value", (col("r.unit") != R.NO_UNIT).alias("in_grays"))
    return windows.join(told, "img").select("img", "threshold", "key", "value", "in_grays", "objects")


@query("k11_calibration_record")
def calibration_record(spark, d):
    """One JSON row with the pooled histogram; as many entries as bins that occur."""
    from ..operators.texture import histogram
    h = histogram(B.pixels(spark, d), col("g") / B.FULL_SCALE, 256)
    return h.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.sum("n").alias("pixels"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("histogram"))).alias("record"))


@query("k13_window_detections", f"WITH {SUMS} SELECT img, (round(ix * 10 * 2.5::DOUBLE) + 100)::BIGINT AS x, (round(iy * 10 * 2.5::DOUBLE) + 200)::BIGINT AS y, 25::BIGINT AS w, n AS n_fiber_px FROM s WHERE n >= 25")
def window_detections(spark, d):
    """Included windows as detections in whole-image coordinates, at a downsample of 2.5."""
    return _windows(spark, d).where("included").select("img", R.to_full_image(col("x"), 2.5, 100).alias("x"), R.to_full_image(col("y"), 2.5, 200).alias("y"),
                                                       R.to_full_image(col("w"), 2.5, 0).alias("w"), "n_fiber_px")


@query("s02_channel_list", "SELECT unnest(['g']) AS channel, 0::BIGINT AS place")
def channel_list(spark, d):
    px = B.pixels(spark, d)
    return spark.createDataFrame([(c, Rd.channel_index(px, c)) for c in Rd.channels(px)], "channel string, place long")


@query("s04_checked_pixels", f"WITH {PX} SELECT img, count(*) AS n, max(g) AS peak FROM px GROUP BY img")
def checked_pixels(spark, d):
    return Rd.checked_gray(B.pixels(spark, d), "g").groupBy("img").agg(F.count("*").alias("n"), F.max("g").alias("peak"))


@query("m14_density_tile", f"""WITH {FPX}, c AS (SELECT k, least(k * 5 + 2, 49) AS at FROM unnest(range(10)) AS t(k)),
s AS (SELECT img, cy.k AS gy, cx.k AS gx, count_if(fiber) AS n, count(*) AS a, count(theta) AS k, sum(cos(2 * radians(theta))) AS c, sum(sin(2 * radians(theta))) AS s
 FROM fpx JOIN c cy ON y BETWEEN cy.at - 4 AND cy.at + 4 JOIN c cx ON x BETWEEN cx.at - 4 AND cx.at + 4 GROUP BY ALL)
SELECT img, gy, gx, CASE WHEN n > 0 THEN round(n / a::DOUBLE, 6) END AS coverage, CASE WHEN k > 0 THEN round(sqrt(c * c + s * s) / k, 5) END AS order_parameter FROM s""")
def density_tile_query(spark, d):
    found = density_tile(B.fiber_pixels(spark, d), height=50, width=50, window=9, step=5)
    return found.select("img", "gy", "gx", F.round("coverage", 6).alias("coverage"), F.round("order_parameter", 5).alias("order_parameter"))


@query("analyze_windows")
def analyze_windows(spark, d):
    """The library entry: windows of a whole run with a pooled cut."""
    return analyze(B.pixels(spark, d).withColumn("theta", (col("g") % 180).cast("double")), height=50, width=50)["windows"]


@query("p13_model_features", "SELECT unnest(['coverage_fraction', 'intensity_mean', 'order_parameter']) AS feature")
def model_features(spark, d):
    names = Mo.model_features(["order_parameter", "mean_angle_deg", "n_fiber_px", "intensity_mean", "coverage_fraction"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("v14_novelty")
def novelty(spark, d):
    t = B.training(spark, d)
    return Mo.novelty(t, t, ["f1", "f2", "f3"]).select("row", F.round("novelty_p", 6).alias("novelty_p"))


@query("v15_forest")
def forest(spark, d):
    t = B.training(spark, d)
    model = Mo.fit_forest(t, ["f1", "f2", "f3"], trees=5)
    return Mo.apply_forest(model, t, ["f1", "f2", "f3"]).groupBy("y", "predicted").agg(F.count("*").alias("n"))


@query("v15_boosting")
def boosting(spark, d):
    """Written once: each of the many jobs of a fit has as many tasks as its input has parts, and each task reports to the driver."""
    t = written(B.training(spark, d), "training")
    model = Mo.fit_boosting(t, ["f1", "f2", "f3"], rounds=5)
    return Mo.apply_boosting(model, t, ["f1", "f2", "f3"]).groupBy("y", "predicted").agg(F.count("*").alias("n"))


@query("v18_apply_classifier")
def apply_classifier(spark, d):
    t = B.training(spark, d)
    found = Mo.apply_forest(Mo.fit_forest(t.where("grp < 4"), ["f1", "f2", "f3"], trees=5), t.where("grp >= 4"), ["f1", "f2", "f3"])
    found = Mo.novelty(t.where("grp < 4"), found, ["f1", "f2", "f3"])
    return found.select("row", "predicted", "max_proba", "margin", "novelty_p", ((col("max_proba") < 0.3) | (col("margin") < 0.05) | (col("novelty_p") < 0.001)).alias("abstained"))


@query("z_stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    """The streaming aggregate, run as a batch."""
    from ..streaming.windows import window_counts
    found = window_counts(B.table(spark, d, "events"))
    return found.select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))




def _saved_models(spark, d):
    """Folders, one a brand, of which those of even length lack the model file."""
    from ..sources.shared import fresh_path
    top = fresh_path(spark, "models")
    brands = B.table(spark, d, "part").select("p_brand").distinct().withColumn("folder", F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    lines = lambda df, kind: df.select(F.lit("{}").alias("value"), "folder").write.mode("append").partitionBy("folder").text(f"{top}/{kind}")
    lines(brands, "metadata")
    lines(brands.where(F.substring("p_brand", -1, 1) != "1"), "model")
    return top


@query("s11_saved_settings", f"WITH {TRAIN} SELECT 1 AS schema_version, grp, max(f3) AS threshold FROM train GROUP BY grp")
def saved_settings(spark, d):
    """Settings written as JSON and read again with their schema."""
    from ..sources.shared import fresh_path
    path = fresh_path(spark, "settings")
    per = B.training(spark, d).groupBy("grp").agg(F.max("f3").alias("threshold"))
    per.select(F.lit(1).alias("schema_version"), "grp", "threshold").write.json(path)
    return Rd.read_settings(spark, path, "grp long, threshold double")


@query("s13_map_discovery", "SELECT count(DISTINCT p_brand)::BIGINT AS maps FROM part")
def map_discovery(spark, d):
    """Maps by image name under a root: a table partitioned by image."""
    from ..sources.shared import fresh_path
    path = fresh_path(spark, "maps")
    B.table(spark, d, "part").select("p_brand", "p_size").distinct().write.partitionBy("p_brand").parquet(path)
    return spark.read.parquet(path).select("p_brand").distinct().agg(F.count("*").alias("maps"))


@query("s14_model_listing", "SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS model FROM part WHERE substr(p_brand, len(p_brand), 1) <> '1'")
def model_listing(spark, d):
    """Models that have both their metadata and the model itself."""
    top = _saved_models(spark, d)
    both = [spark.read.text(f"{top}/{kind}").select("folder").distinct() for kind in ("metadata", "model")]
    return both[0].join(both[1], "folder", "left_semi").select(col("folder").alias("model"))
