"""Threshold records: what each method and setting makes of the line and of threshold.json."""

import hashlib
import json

from pyspark.sql import functions as F

from rasterloom.functions import records as R
from rasterloom.functions import scalars as S
from rasterloom.operators import texture as T

SCHEMA = ("img long, threshold_method string, value double, source string, pixel_um double, channel string, ridge_filter string, sigma_min_um double, sigma_max_um double, "
          "sigma_step_um double, invert_intensity boolean, rolling_ball_radius_um double, min_fiber_area_um2 double, analysis_downsample double")


def test_records(spark):
    none = (None,) * 8
    rows = [(0, "Otsu", 0.0833712, "pooled over 2", 0.1732, " gray ", "None", 1.0, 3.0, 0.5, False, 0.0, 12.5, 1.0),
            (1, "Manual", 0.036, None, 0.25, "gray", " Sato", 1.0, 3.0, 0.5, True, 10.0, 0.0, 2.0),
            (2, "Manual", 7000.4, "ignored", None, *none, None), (3, None, None, "ignored", 0.5, *none, None), (4, "Project Otsu (calibrated)", 0.5, None, 0.5, *none, 0.5)]
    found = {r.img: r for r in R.threshold_records(spark.createDataFrame(rows, SCHEMA)).withColumn("p", S.parse_threshold(F.col("identity"))).collect()}
    key = lambda line: hashlib.sha256(line.encode()).hexdigest()[:8]
    plain = key("channel=;ridge=none;sigmas=;invert=false;rb=0.00000;minarea=0.00000")
    assert found[0].identity == f"Otsu 0.08337 | pooled over 2 | settings {key('channel=gray;ridge=none;sigmas=;invert=false;rb=0.00000;minarea=12.5000')} at 0.1732 um/px"
    assert found[1].identity == f"Manual response 0.03600 | set by hand | settings {key('channel=gray;ridge=sato;sigmas=1.00000,3.00000,0.500000;invert=true;rb=10.0000;minarea=0.00000')} at 0.5 um/px"
    assert found[2].identity == f"Manual gray level 7000 | set by hand | settings {plain}"
    assert found[3].identity == f"Otsu ? | fitted per region | settings {plain} at 0.5 um/px"
    assert found[4].identity == f"Calibrated 0.5000 |  | settings {plain} at 0.5 um/px"
    assert all(r.p.settings == r.settings_key for r in found.values())
    record = json.loads(found[0].record)
    assert record["cut"] == "Otsu 0.08337" and record["unit"] == "fraction of full scale" and record["settings"]["min_fiber_area_um2"] == 12.5 and record["analysed_pixel_um"] == 0.1732
    assert "value" not in json.loads(found[3].record) and "analysed_pixel_um" not in json.loads(found[2].record)
    objects = R.stamped(spark.createDataFrame([(0,), (9,)], "img long"), R.threshold_records(spark.createDataFrame(rows, SCHEMA)))
    assert {r.img: r.threshold for r in objects.collect()} == {0: found[0].identity, 9: None}


def test_a_cut_for_each_image(spark):
    px = spark.range(3000).select((F.col("id") % 3).alias("img"), ((F.hash("id") % 50) / 200 + 0.3 + F.when(F.hash("id") % 7 > 0, 0.1 * (F.col("id") % 3 + 1)).otherwise(0)).alias("v"))
    px = px.union(spark.createDataFrame([(7, 0.5)] * 3, "img long, v double"))
    each = {r.img: r.cut for r in T.otsu_each(T.histogram(px, F.col("v"), 64, "img"), 64, "img").collect()}
    assert set(each) == {0, 1, 2}
    for img, cut in each.items():
        assert T.otsu(T.histogram(px.where(f"img = {img}"), F.col("v"), 64), 64).first().cut == cut
