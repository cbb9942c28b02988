"""Queries of scalar functions, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import bindings as B
from .registry import query
from .views import FPX, PRED, PX, RECT, TRAIN


def col(name):
    return F.col(name)


@query("s03_max_over_bands", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity, l_tax * 100, l_discount * 100) AS band_max, l_quantity AS band1 FROM lineitem")
def max_over_bands(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.greatest(col("l_quantity"), col("l_tax") * 100, col("l_discount") * 100).alias("band_max"), col("l_quantity").alias("band1"))


@query("s01_block_downsample", f"WITH {PX} SELECT img, (y // 4)::BIGINT AS y, (x // 4)::BIGINT AS x, round(avg(g), 6) AS g, count(*) AS n FROM px GROUP BY ALL")
def block_downsample(spark, d):
    return (B.pixels(spark, d).groupBy("img", F.expr("cast(y div 4 as bigint)").alias("y"), F.expr("cast(x div 4 as bigint)").alias("x"))
            .agg(F.round(F.avg("g"), 6).alias("g"), F.count("*").alias("n")))


@query("s09_map_block_read", f"WITH {PX} SELECT img, y, x, g FROM px WHERE y BETWEEN 10 AND 19 AND x BETWEEN 20 AND 29")
def map_block_read(spark, d):
    return B.pixels(spark, d).where("y BETWEEN 10 AND 19 AND x BETWEEN 20 AND 29")


@query("s10_project_scan", f"""WITH {RECT} SELECT s_suppkey, s_name, count(*) AS n_ann FROM supplier JOIN rect ON rect.img = s_suppkey % 4
WHERE contains(lower(s_name), '1') AND class IN (0, 2) AND s_suppkey NOT IN (SELECT id FROM rect WHERE img = 3) GROUP BY ALL""")
def project_scan(spark, d):
    """Images by name and their annotations of the wanted classes, without derived entries."""
    r = B.rectangles(spark, d)
    images = B.table(spark, d, "supplier").where(S.name_matches(col("s_name"), F.lit(" 1 ")))
    images = images.join(r.where("img = 3").select(col("id").alias("s_suppkey")), "s_suppkey", "left_anti")
    per = r.where("class IN (0, 2)").groupBy("img").agg(F.count("*").alias("n_ann"))
    return images.join(per, images["s_suppkey"] % 4 == per["img"]).select("s_suppkey", "s_name", "n_ann")


@query("p01_class_list", "SELECT c_custkey, list_distinct(list_filter(list_transform(string_split(c_mktsegment || ' , ,A,' || c_mktsegment, ','), lambda s: trim(s)), lambda s: s <> '')).list_sort() AS classes FROM customer")
def class_list(spark, d):
    text = F.concat(col("c_mktsegment"), F.lit(" , ,A,"), col("c_mktsegment"))
    return B.table(spark, d, "customer").select("c_custkey", F.array_sort(S.class_list(text)).alias("classes"))


@query("p02_class_predicate", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, 'Unclassified') IN ('BUILDING', 'Unclassified') AS wanted FROM customer")
def class_predicate(spark, d):
    name = F.when(col("c_custkey") % 7 != 0, col("c_mktsegment"))
    return B.table(spark, d, "customer").select("c_custkey", S.in_classes(name, S.class_list(F.lit("BUILDING, Unclassified"))).alias("wanted"))


@query("p03_name_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower(trim(' 1 ')))")
def name_filter(spark, d):
    return B.table(spark, d, "part").where(S.name_matches(col("p_name"), F.lit(" 1 "))).select("p_partkey", "p_name")


@query("p04_threshold_filter", f"WITH {PX} SELECT img, y, x, g FROM px WHERE g / 65535.0::DOUBLE >= 0.1::DOUBLE")
def threshold_filter(spark, d):
    return B.pixels(spark, d).where(S.to_unit(col("g"), B.FULL_SCALE) >= 0.1)


@query("p05_pixel_positivity", f"WITH {PX} SELECT img, count_if(g > 7000)::BIGINT AS above, count_if(g < 150)::BIGINT AS below, 'Pixel positive: v > 7000' AS rule FROM px GROUP BY img")
def pixel_positivity(spark, d):
    return B.pixels(spark, d).groupBy("img").agg(F.count_if(S.beyond(col("g").cast("double"), 7000)).alias("above"), F.count_if(S.beyond(col("g").cast("double"), 150, False)).alias("below"),
                                                 F.lit(S.cut_name("v", 7000)).alias("rule"))


@query("p07_scale_to_unit", f"WITH {PX} SELECT img, y, x, round(g / 65535.0::DOUBLE, 8) AS v, round((g - min(g) OVER (PARTITION BY img)) / greatest(max(g) OVER (PARTITION BY img) - min(g) OVER (PARTITION BY img), 1)::DOUBLE, 8) AS stretched FROM px")
def scale_to_unit(spark, d):
    px = B.pixels(spark, d)
    ends = px.groupBy("img").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    return px.join(ends, "img").select("img", "y", "x", F.round(S.to_unit(col("g"), B.FULL_SCALE), 8).alias("v"),
                                                    F.round((col("g") - col("lo")) / F.greatest(col("hi") - col("lo"), F.lit(1)), 8).alias("stretched"))


@query("p08_hsv_channels", """WITH c AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 10 AS b FROM lineitem),
m AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS s FROM c)
SELECT l_orderkey, l_partkey, l_linenumber, round(t, 6) AS value, round(CASE WHEN t = 0 THEN 0 ELSE s / t END, 6) AS saturation,
  round(CASE WHEN s = 0 THEN 0 WHEN t = r THEN (((g - b) / s) % 6 + 6) % 6 WHEN t = g THEN (b - r) / s + 2 ELSE (r - g) / s + 4 END / 6, 6) AS hue FROM m""")
def hsv_channels(spark, d):
    h, s, v = S.hsv(col("l_quantity") / 50, col("l_discount") * 10, col("l_tax") * 10)
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(v, 6).alias("value"), F.round(s, 6).alias("saturation"), F.round(h, 6).alias("hue"))


@query("p09_invert", f"WITH {PX} SELECT img, y, x, round(1 - g / 65535.0::DOUBLE, 8) AS v FROM px")
def invert(spark, d):
    return B.pixels(spark, d).select("img", "y", "x", F.round(1 - S.to_unit(col("g"), B.FULL_SCALE), 8).alias("v"))


@query("p10_window_geometry", """SELECT p_partkey, greatest(2, round_even(p_size / 0.37::DOUBLE, 0))::BIGINT AS window_px,
  greatest(1, round_even(greatest(2, round_even(p_size / 0.37::DOUBLE, 0)) * (1 - least(greatest((p_size % 12) / 10.0::DOUBLE, 0), 0.95::DOUBLE)), 0))::BIGINT AS stride_px FROM part""")
def window_geometry(spark, d):
    window = S.window_px(col("p_size"), F.lit(0.37))
    return B.table(spark, d, "part").select("p_partkey", window.cast("long").alias("window_px"), S.stride_px(window, (col("p_size") % 12) / 10.0).cast("long").alias("stride_px"))


@query("p11_distance_list", """SELECT p_partkey, list_distinct(list_transform(list_filter(list_transform(string_split('1, x,' || p_size || ',0.2,-3,' || p_size, ','),
  lambda s: try_cast(trim(s) AS DOUBLE)), lambda v: v > 0), lambda v: greatest(1, floor(v / 0.5::DOUBLE + 0.5)::INT))).list_sort() AS px FROM part""")
def distance_list(spark, d):
    text = F.concat(F.lit("1, x,"), col("p_size").cast("string"), F.lit(",0.2,-3,"), col("p_size").cast("string"))
    return B.table(spark, d, "part").select("p_partkey", F.array_sort(S.distances_px(text, F.lit(0.5))).alias("px"))


@query("p12_flatten_json", "SELECT event_id, 'props.' || 'k' AS key, json_extract_string(props, '$.k')::DOUBLE AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def flatten_json(spark, d):
    """Numbers of nested JSON under dotted keys, one row each; arrays and strings are left out."""
    listed = B.table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return listed.select("event_id", F.concat(F.lit("props."), col("k")).alias("key"), col("v").try_cast("double").alias("value")).where("value IS NOT NULL")


@query("p14_safe_divide", f"WITH {TRAIN} SELECT row, CASE WHEN f1 > 0 AND f3 > 0 THEN round(f2 / f1, 6) END AS ratio FROM train")
def safe_divide(spark, d):
    from ..operators.windows import ratio
    return B.training(spark, d).select("row", F.round(ratio(col("f2"), col("f1"), col("f3") > 0), 6).alias("ratio"))


@query("p15_axial_difference", f"WITH {PX} SELECT img, y, x, least(abs(g % 180 - x * 7) % 180, 180 - abs(g % 180 - x * 7) % 180)::DOUBLE AS difference FROM px")
def axial_difference(spark, d):
    return B.pixels(spark, d).select("img", "y", "x", S.axial_difference((col("g") % 180).cast("double"), (col("x") * 7).cast("double")).alias("difference"))


@query("p16_axial_angle", f"WITH {PX} SELECT img, y, x, round(((degrees(atan2(y - 20.5::DOUBLE, x - 20.5::DOUBLE)) / 2) % 180 + 180) % 180, 5) AS angle FROM px")
def axial_angle(spark, d):
    return B.pixels(spark, d).select("img", "y", "x", F.round(S.axial_angle(col("x") - 20.5, col("y") - 20.5), 5).alias("angle"))


@query("p17_safe_file_name", r"""SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*\s]+', '_', 'g'), '[. ]+$', '') AS name FROM pages""")
def safe_file_name(spark, d):
    return B.table(spark, d, "pages").select("page_id", S.safe_file_name(col("url")).alias("name"))


@query("p18_settings_fingerprint", "SELECT p_partkey, substr(sha256(p_brand || '|' || p_size), 1, 8) AS key FROM part")
def settings_fingerprint(spark, d):
    return B.table(spark, d, "part").select("p_partkey", S.fingerprint(F.concat_ws("|", "p_brand", "p_size")).alias("key"))


@query("p19_params_hash", """SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","size":' || p_size || ',"type":"' || p_type || '"}'), 1, 12) AS hash FROM part""")
def params_hash(spark, d):
    return B.table(spark, d, "part").select("p_partkey", S.fingerprint(F.to_json(F.struct(col("p_brand").alias("brand"), col("p_size").alias("size"), col("p_type").alias("type"))), 12).alias("hash"))


@query("p20_threshold_label", f"WITH {PX} SELECT img, y, x, 'otsu gray level ' || g || ' | img' || img || ' | settings ab12 at 0.5 um/px' AS label, true AS same, g::DOUBLE AS value FROM px")
def threshold_label(spark, d):
    def label(method, unit, value, source, settings, um):
        return S.threshold_label(method, unit, value, source, settings, um)
    made = label(F.lit("otsu"), F.lit("gray level"), col("g").cast("double"), F.concat(F.lit("img"), col("img").cast("string")), F.lit("ab12"), F.lit(0.5))
    px = B.pixels(spark, d).withColumn("label", made).withColumn("parsed", S.parse_threshold(col("label")))
    again = label(*(col(f"parsed.{c}") for c in ("method", "unit", "value", "source", "settings", "pixel_um")))
    return px.select("img", "y", "x", "label", (again == col("label")).alias("same"), col("parsed.value").alias("value"))


@query("p21_comparable", """SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand = b.p_brand AND greatest(a.p_size, b.p_size) <= least(a.p_size, b.p_size) * 1.02::DOUBLE AS comparable
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def comparable(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    q = p.select((col("p_partkey") - 1).alias("p_partkey"), col("p_partkey").alias("b"), col("p_brand").alias("brand2"), col("p_size").alias("size2"))
    return p.join(q, "p_partkey").select(col("p_partkey").alias("a"), "b", S.comparable(col("p_brand"), col("p_size").cast("double"), col("brand2"), col("size2").cast("double")).alias("comparable"))


@query("p22_placement_line", "SELECT p_partkey, p_size::BIGINT AS w, (p_size * 2)::BIGINT AS h, 8::BIGINT AS cell, 'nearest' AS render FROM part")
def placement_line(spark, d):
    line = S.placement_line(source_width=col("p_size"), source_height=col("p_size") * 2, cell_px=F.lit(8), window_px=F.lit(16), x0=F.lit(0.5), y0=F.lit(0.5), grid=F.lit("5x7"), render=F.lit("nearest"))
    parsed = B.table(spark, d, "part").select("p_partkey", S.parse_placement(F.concat(F.lit("title\r\n"), line, F.lit("\r\nend"))).alias("m"))
    return parsed.select("p_partkey", col("m")["source_width"].cast("long").alias("w"), col("m")["source_height"].cast("long").alias("h"),
                         col("m")["cell_px"].cast("long").alias("cell"), col("m")["render"].alias("render"))


@query("p23_rgb_value", "SELECT l_orderkey, l_partkey, l_linenumber, list_transform(string_split('3,1,2', ','), lambda s: s::INT) AS bands, greatest(l_quantity, l_tax, l_discount) AS value FROM lineitem")
def rgb_value(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.split(F.lit("3,1,2"), ",").cast("array<int>").alias("bands"), F.greatest("l_quantity", "l_tax", "l_discount").alias("value"))


@query("p24_calibration_mismatch", """SELECT a.p_partkey, concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN 'channel' END, CASE WHEN a.p_size <> b.p_size THEN 'sigma' END) AS differ
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def calibration_mismatch(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    q = p.select((col("p_partkey") - 1).alias("p_partkey"), col("p_brand").alias("brand2"), col("p_size").alias("size2"))
    return p.join(q, "p_partkey").select("p_partkey", S.mismatches({"channel": (col("p_brand"), col("brand2")), "sigma": (col("p_size"), col("size2"))}).alias("differ"))


@query("p25_json_scalar", f"WITH {TRAIN} SELECT row, CASE WHEN f1 = 0 THEN NULL ELSE f2 / f1 END AS v FROM train")
def json_scalar(spark, d):
    v = F.when(col("f1") == 0, F.lit(float("nan"))).otherwise(F.try_divide("f2", "f1"))
    return B.training(spark, d).select("row", S.finite(v).alias("v"))


@query("p26_search_area", f"WITH {RECT} SELECT img, id FROM rect WHERE CASE 'selected' WHEN 'class' THEN class = 1 ELSE true END")
def search_area(spark, d):
    """The annotations of a search mode; in a batch nothing is selected, so that selected falls back to all."""
    mode, batch = "selected", True
    ann = B.rectangles(spark, d)
    keep = {"all": F.lit(True), "class": col("class") == 1, "selected": F.lit(batch)}[mode]
    return ann.where(keep).select("img", "id")


@query("p27_preprocessed_signal", f"WITH {PX} SELECT img, y, x, round(greatest(1 - g / 65535.0::DOUBLE - 0.2::DOUBLE, 0), 8) AS v FROM px")
def preprocessed_signal(spark, d):
    """Channel, inverted, less a flat background; never rescaled."""
    return B.pixels(spark, d).select("img", "y", "x", F.round(F.greatest(1 - S.to_unit(col("g"), B.FULL_SCALE) - 0.2, F.lit(0.0)), 8).alias("v"))


@query("p28_coded_levels", f"WITH {FPX} SELECT img, y, x, (CASE WHEN fiber THEN floor(least(greatest(g / 65535.0::DOUBLE, 0), 1) * 7 + 0.5) + 1 ELSE 0 END)::BIGINT AS code FROM fpx")
def coded_levels(spark, d):
    level = F.floor(F.least(F.greatest(S.to_unit(col("g"), B.FULL_SCALE), F.lit(0.0)), F.lit(1.0)) * 7 + 0.5)
    return B.fiber_pixels(spark, d).select("img", "y", "x", F.when(col("fiber"), level + 1).otherwise(0).cast("long").alias("code"))


@query("p29_segmentation_hash", "SELECT p_partkey, substr(sha256('v1;' || p_brand || ';' || printf('%.3f', p_size / 7.0::DOUBLE)), 1, 16) AS hash FROM part")
def segmentation_hash(spark, d):
    return B.table(spark, d, "part").select("p_partkey", S.fingerprint(F.concat_ws(";", F.lit("v1"), "p_brand", F.format_string("%.3f", col("p_size") / 7.0)), 16).alias("hash"))


@query("p30_prerun_validation", f"""WITH {TRAIN}, g AS (SELECT grp, count(*) AS n, count_if(f1 = 0) AS pending, min(f3) AS lo, max(f3) AS hi FROM train GROUP BY grp)
SELECT grp, CASE WHEN n = 0 THEN 'error' WHEN pending > 0 THEN 'error' WHEN hi > lo * 1.02::DOUBLE THEN 'warn' ELSE 'ok' END AS status FROM g""")
def prerun_validation(spark, d):
    g = B.training(spark, d).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(col("f1") == 0).alias("pending"), F.min("f3").alias("lo"), F.max("f3").alias("hi"))
    return g.select("grp", F.when((col("n") == 0) | (col("pending") > 0), "error").when(col("hi") > col("lo") * 1.02, "warn").otherwise("ok").alias("status"))


@query("p31_duration", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s // 60 % 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS shown FROM (SELECT event_id, event_id * 7 AS s FROM events)")
def duration(spark, d):
    return B.table(spark, d, "events").select("event_id", S.duration(col("event_id") * 7).alias("shown"))


@query("z01_union", f"WITH {FPX} SELECT DISTINCT img, y, x FROM fpx WHERE fiber OR zone")
def union(spark, d):
    px = B.fiber_pixels(spark, d)
    return px.where("fiber").select("img", "y", "x").union(px.where("zone").select("img", "y", "x")).distinct()


@query("z02_intersection", f"WITH {FPX} SELECT img, y, x FROM fpx WHERE fiber AND zone")
def intersection(spark, d):
    px = B.fiber_pixels(spark, d)
    return px.where("fiber").select("img", "y", "x").intersect(px.where("zone").select("img", "y", "x"))


@query("z03_difference", f"WITH {FPX} SELECT img, y, x FROM fpx WHERE zone AND NOT fiber")
def difference(spark, d):
    px = B.fiber_pixels(spark, d)
    return px.where("zone").select("img", "y", "x").exceptAll(px.where("fiber").select("img", "y", "x"))


@query("z04_ordered_dedup", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [1, 0, 2] ELSE [2, 0, 1] END AS kept FROM part")
def ordered_dedup(spark, d):
    k = col("p_size") % 3
    listed = F.array(k, F.lit(0), k, F.lit(1), F.lit(0), F.lit(2), k)
    return B.table(spark, d, "part").select("p_partkey", F.array_distinct(listed).alias("kept"))


@query("v13_abstain", f"""WITH {PRED}, s AS (SELECT *, list_reverse_sort([p0, p1, p2, p3, p4]) AS o FROM pred)
SELECT row, round(o[1], 6) AS top, round(o[1] - o[2], 6) AS margin, o[1] < 0.3::DOUBLE OR o[1] - o[2] < 0.05::DOUBLE OR novelty_p < 0.001::DOUBLE AS abstained FROM s""")
def abstain(spark, d):
    from ..operators.validate import abstained
    return abstained(B.predictions(spark, d), [f"p{k}" for k in range(5)], least=0.3, margin=0.05).select("row", F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin"), "abstained")
