"""Operators against straight loops, and what must hold whatever the data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import arrays as A
from rasterloom.operators import lattice as L
from rasterloom.operators import model as Mo
from rasterloom.operators import neighbors as N
from rasterloom.operators import validate as V
from rasterloom.operators import windows as W
from rasterloom.sources import bindings as B
from rasterloom.sources import readers as Rd


def stripes(angle, side=64, pitch=12, width=4):
    """A mask of bars along an axis, in degrees from the x axis downwards."""
    y, x = np.mgrid[:side, :side]
    t = np.radians(angle)
    return ((-x * np.sin(t) + y * np.cos(t)) % pitch) < width


def raster(spark, plane, img=0, name="g"):
    y, x = np.mgrid[:plane.shape[0], :plane.shape[1]]
    return spark.createDataFrame(pd.DataFrame({"img": img, "y": y.ravel().astype("i4"), "x": x.ravel().astype("i4"), name: plane.ravel()}))


@pytest.mark.parametrize("window,stride,partial", [(10, 5, False), (11, 7, True), (6, 6, False), (5, 3, True), (60, 5, False)])
def test_window_sums_equal_loops(spark, window, stride, partial):
    g = np.random.default_rng(1).integers(0, 100, (31, 27))
    sums = W.window_sums(raster(spark, g), {"s": F.col("g"), "n": F.lit(1)}, window=window, stride=stride, height=31, width=27, partial=partial)
    found = {(r.iy, r.ix): (r.s, r.n) for r in sums.collect()}
    count = W.all_windows if partial else W.whole_windows
    expected = {}
    for iy in range(count(31, window, stride)):
        for ix in range(count(27, window, stride)):
            part = g[iy * stride:iy * stride + window, ix * stride:ix * stride + window]
            if part.size:
                expected[iy, ix] = (int(part.sum()), part.size)
    assert found == expected


def test_axial_mean_wraps(spark):
    df = spark.createDataFrame([(1.0,), (179.0,)], "theta double")
    angle, order = W.axial_mean(least=1)
    r = df.agg(*(F.sum(e).alias(n) for n, e in W.axial_sums(F.col("theta")).items())).select(angle.alias("a"), order.alias("r")).first()
    assert min(r.a, 180 - r.a) < 1e-9 and r.r > 0.99


def test_distance_equals_brute_force():
    rng = np.random.default_rng(2)
    for density in (0.02, 0.3, 0.97):
        mask = rng.random((17, 23)) > density
        outside = np.argwhere(~mask)
        d = A.distance(mask)
        for y, x in np.ndindex(mask.shape):
            assert d[y, x] == pytest.approx(np.sqrt(((outside - [y, x]) ** 2).sum(axis=1).min()) if mask[y, x] else 0)
    assert np.isinf(A.distance(np.ones((3, 3), bool))).all()


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_equal_flood_fill(diagonal):
    mask = np.random.default_rng(3).random((25, 25)) < 0.5
    label, seen = A.components(mask, diagonal), {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for start in zip(*np.nonzero(mask)):
        if start not in seen:
            stack, first = [start], start[0] * 25 + start[1] + 1
            while stack:
                y, x = stack.pop()
                if 0 <= y < 25 and 0 <= x < 25 and mask[y, x] and (y, x) not in seen:
                    seen[y, x] = first
                    stack += [(y + dy, x + dx) for dy, dx in steps]
    assert {p: int(label[p]) for p in seen} == seen and (label[~mask] == 0).all()


def test_holes_and_zones():
    ring = np.zeros((20, 20), bool)
    ring[5:15, 5:15] = True
    ring[8:12, 8:12] = False
    assert A.filled(ring).sum() == 100
    whole, out, inn, both = (A.zone(ring, m, 2.0) for m in ("whole", "outside", "inside", "both"))
    assert whole.sum() == 100 and not (out & whole).any() and (inn <= whole).all() and (both == (out | inn)).all()
    with pytest.raises(ValueError):
        A.zone(ring, "elsewhere", 2.0)


@pytest.mark.parametrize("angle", [0, 30, 45, 90, 150])
def test_orientation_finds_the_angle(angle):
    mask = stripes(angle)
    theta = A.orientation(mask.astype("f8"), mask)[12:-12, 12:-12]
    t = np.radians(2 * theta[~np.isnan(theta)])
    mean = np.degrees(np.arctan2(np.sin(t).mean(), np.cos(t).mean())) / 2 % 180
    assert min(abs(mean - angle), 180 - abs(mean - angle)) < 1.5


def test_orientation_off_the_mask_is_undefined():
    assert np.isnan(A.orientation(np.zeros((9, 9)), np.zeros((9, 9), bool))).all()


@pytest.mark.parametrize("kind", ["sato", "frangi", "meijering"])
def test_ridge_of_full_contrast_gives_one(kind):
    plane = np.repeat(np.exp(-0.5 * (np.arange(-40, 41) / 2.0) ** 2)[None, :], 81, axis=0)
    found = A.ridges(plane, [2.0], kind)
    assert found[40, 40] == pytest.approx(1.0, abs=0.02) and found[40, 5] < 0.05
    assert A.ridges(plane * 0.5, [2.0], kind)[40, 40] < 0.95


@pytest.mark.parametrize("kind", ["sato", "frangi", "meijering"])
def test_ridges_are_scaled_by_the_first_sigma(kind):
    """More sigmas leave a ridge of the first one's width at 1, and dark ridges answer as bright ones."""
    plane = np.repeat(np.exp(-0.5 * (np.arange(-60, 61) / 2.0) ** 2)[None, :], 121, axis=0)
    for sigmas in ([2.0], [2.0, 4.0]):
        assert A.ridges(plane, sigmas, kind)[60, 60] == pytest.approx(1.0, abs=0.02)
        assert np.allclose(A.ridges(1 - plane, sigmas, kind, dark=True), A.ridges(plane, sigmas, kind), atol=1e-9)


def test_outliers_do_not_stretch_the_novelty(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(a), float(b)) for k, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000 + k, 12.0 + k % 3, -9.0) for k in range(60)]
    df = spark.createDataFrame(rows, "row long, a double, b double")
    found = {r.row: r.novelty_p for r in Mo.novelty(df, df, ["a", "b"]).collect()}
    assert all(found[1000 + k] < 1e-6 for k in range(60)) and 0.3 < np.mean([found[k] for k in range(400)]) < 0.6


def test_boosting_tells_classes_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 3, float(k % 3 + rng.normal() * 0.15), None if k % 7 == 0 else float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "y long, a double, b double")
    found = Mo.apply_boosting(Mo.fit_boosting(df, ["a", "b"], rounds=5), df, ["a", "b"]).collect()
    assert np.mean([r.y == r.predicted for r in found]) > 0.97 and all(abs(sum(r.proba) - 1) < 1e-9 and r.max_proba == max(r.proba) for r in found)


def test_thinning_keeps_components_and_thins():
    mask = stripes(0)
    thin = A.thinned(mask)
    assert (thin <= mask).all() and thin.sum() < mask.sum() / 2
    assert len(np.unique(A.components(thin, True))) == len(np.unique(A.components(mask, True)))
    assert not A.thinned(np.zeros((5, 5), bool)).any()


def test_alignment_of_stripes_is_higher_than_of_noise():
    lines, noise = A.alignment(stripes(30).astype("f8")), A.alignment(np.random.default_rng(4).random((64, 64)))
    assert lines["pmr"] > 3 * noise["pmr"] and lines["entropy"] < noise["entropy"]
    assert math.isnan(A.alignment(np.zeros((9, 9)))["pmr"])


def test_coherence_bounds():
    c = A.coherence(stripes(90, 40).astype("f8"), 20)
    assert (c > 0.9).all() and np.isnan(A.coherence(np.zeros((20, 20)), 10)).all()


def test_box_stats_turned_by_a_right_angle(spark):
    g = np.random.default_rng(5).random((9, 9))
    stats = lambda plane: {(r.y, r.x): r.b_mean for r in N.box_stats(raster(spark, plane), F.col("g"), 1, "b_").collect()}
    plain, turned = stats(g), stats(np.rot90(g))
    assert all(turned[8 - x, y] == pytest.approx(plain[y, x]) for y, x in plain)


def test_tiles_cover_and_owned_boxes_partition(spark):
    for w, h, window, stride, budget in ((320, 230, 20, 10, 9_000), (50, 50, 10, 5, 900), (7, 9, 10, 5, 400)):
        tiles = L.owned_boxes(L.tile_plan(spark, w, h, window, stride, budget)).collect()
        owned = np.zeros((h, w), int)
        for t in tiles:
            owned[t.y:t.own_y1, t.x:t.own_x1] += 1
            assert t.x % stride == 0 and t.own_x1 <= t.x + t.w and t.own_y1 <= t.y + t.h
        assert (owned == 1).all()


def test_tiled_window_sums_equal_whole(spark):
    g = np.random.default_rng(6).integers(0, 9, (40, 40))
    px = raster(spark, g)
    whole = {(r.iy, r.ix): r.s for r in W.window_sums(px, {"s": F.col("g")}, window=10, stride=5, height=40, width=40).collect()}
    joined = {}
    for t in L.owned_boxes(L.tile_plan(spark, 40, 40, 10, 5, 625)).collect():
        part = px.where(f"y >= {t.y} AND y < {t.y + t.h} AND x >= {t.x} AND x < {t.x + t.w}").withColumns({"y": F.col("y") - t.y, "x": F.col("x") - t.x})
        for r in W.window_sums(part, {"s": F.col("g")}, window=10, stride=5, height=t.h, width=t.w).collect():
            joined.setdefault((r.iy + t.y // 5, r.ix + t.x // 5), r.s)
    assert joined == whole


def test_anchored_groups_compare_with_the_first(spark):
    df = spark.createDataFrame([("a", 100.0), ("a", 101.9), ("a", 103.0), ("a", 103.0)], "k string, v double")
    assert sorted((r.v, r.n, r.anchor) for r in L.anchored_groups(df, "k", "v").collect()) == [(100.0, 1, 100.0), (101.9, 1, 100.0), (103.0, 2, 103.0)]


def test_leaky_split_beats_grouped_split(spark, data):
    t = spark.createDataFrame([(i, i % 4, i % 4) for i in range(80)], "row long, y long, grp long")
    grouped = V.accuracy(V.confusion(V.majority_by_group(t))).first().accuracy
    assert grouped == 0.0  # a class per group can't be learnt from the others
    folds = V.grouped_folds(B.training(spark, data), 3).collect()
    assert len({r.grp for r in folds}) == len(folds)


def test_cross_validation_with_a_callable(spark):
    rows = [(i, i % 2, i % 4, float(i % 2) + 0.1 * (i % 3)) for i in range(80)]
    t = spark.createDataFrame(rows, "row long, y long, grp long, f double")

    def nearest_mean(x, y, q):
        means = np.array([x[y == k].mean() for k in (0, 1)])
        return np.abs(q - means).argmin(axis=1)

    found = V.cross_validate(t, ["f"], nearest_mean, V.grouped_folds(t, 2)).collect()
    assert sorted(r.row for r in found) == list(range(80)) and all(r.pred == r.y for r in found)
    with pytest.raises(ValueError):
        V.cross_validate(t, ["f"], nearest_mean, V.grouped_folds(t, 2), most_rows=10)


def test_compatibility_refusals():
    model = {"features": ["a", "b"], "pixel_um": 0.5, "window_um": 15, "stride_um": 5, "segmentation": "x"}
    assert V.compatible(model, dict(model)) == ([], [])
    assert V.compatible(model, model | {"features": ["b", "a"]})[0] == ["features: other order"]
    assert V.compatible(model, model | {"features": ["a", "c"]})[0] == ["features: missing ['b'], unexpected ['c']"]
    assert V.compatible(model, model | {"pixel_um": 0.509})[0] == [] and V.compatible(model, model | {"pixel_um": 0.52})[0] == ["pixel_um"]
    assert V.compatible(model, model | {"stride_um": 6, "segmentation": "y"}) == (["segmentation"], ["stride_um"])


@pytest.mark.parametrize("k,x,p", [(2, 5.991465, 0.05), (3, 7.814728, 0.05), (4, 13.276704, 0.01), (5, 1.145476, 0.95), (1, 3.841459, 0.05)])
def test_chi_square_tail(spark, k, x, p):
    assert spark.range(1).select(Mo.chi_square_tail(F.lit(x), k).alias("p")).first().p == pytest.approx(p, abs=1e-4)


def test_readers_refuse(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.eye(4, dtype="u1"))
    assert Rd.read_masks(spark, str(tmp_path / "a.npy"), 4, 4).count() == 4
    with pytest.raises(Exception, match="not \\(5, 5\\)"):
        Rd.read_masks(spark, str(tmp_path / "a.npy"), 5, 5).count()
    np.save(tmp_path / "m.npy", np.arange(6, dtype="<f4").reshape(3, 2))
    assert Rd.read_matrix(spark, str(tmp_path / "m.npy"), ["p", "q"]).orderBy("row").first().q == 1.0
    (tmp_path / "s.json").write_text('{"schema_version": 9, "v": 1.0}')
    with pytest.raises(Exception, match="newer"):
        Rd.read_settings(spark, str(tmp_path / "s.json"), "v double").collect()
    with pytest.raises(ValueError):
        Rd.checked_gray(spark.createDataFrame([(1.0,)], "g double"), "g")
    (tmp_path / "cat" / "m1").mkdir(parents=True)
    (tmp_path / "cat" / "m2").mkdir()
    for f in ("m1/metadata.json", "m1/model.bin", "m2/metadata.json"):
        (tmp_path / "cat" / f).write_text("x")
    assert [r.folder[-2:] for r in Rd.catalog_entries(spark, str(tmp_path / "cat"), ("metadata.json", "model.bin")).collect()] == ["m1"]


def test_map_reader_pushes_its_box_down(spark, tmp_path):
    spark.range(100).selectExpr("0 AS img", "id div 10 AS gy", "id % 10 AS gx", "id AS v").write.parquet(str(tmp_path / "map"))
    df = Rd.read_map(spark, str(tmp_path / "map"), (2, 3, 4, 6))
    assert df.count() == 6 and "GreaterThanOrEqual(gy,2)" in df._jdf.queryExecution().executedPlan().toString()


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(S.class_list(F.lit(" a, ,b,a"))) == ["a", "b"] and get(S.in_classes(F.lit(None).cast("string"), S.class_list(F.lit("")))) is False
    assert get(S.window_px(F.lit(2.5), F.lit(1.0))) == 2 and get(S.window_px(F.lit(3.5), F.lit(1.0))) == 4
    assert get(S.distances_px(F.lit("1,x,0.2,-1,1.5"), F.lit(1.0))) == [1, 2]
    assert get(S.axial_difference(F.lit(1.0), F.lit(179.0))) == 2.0
    long = get(S.safe_file_name(F.lit("a" * 300)))
    assert len(long) == 200 and get(S.safe_file_name(F.lit('x:/ y..'))) == "x_y" and get(S.safe_file_name(F.lit(" "))) == "image"
    assert get(S.parse_threshold(F.lit("no label"))) is None and S.cut_name("v", 0.123456) == "Pixel positive: v > 0.1235"
    assert get(S.finite(F.lit(float("inf")))) is None and get(S.duration(F.lit(3723))) == "1h 02m 03s"


def test_streamed_windows_equal_batch(spark, data, tmp_path):
    from rasterloom.streaming.windows import window_counts
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = window_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "check")).start()
    assert run.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("sigma", [1.0, 2.0])
def test_ridge_profiles_equal_analytic_ones(sigma):
    x = np.arange(-40, 41)
    plane = np.repeat(np.exp(-0.5 * (x / sigma) ** 2)[None, :], 81, 0)
    v = 2 * sigma * sigma
    analytic = (1 - x * x / v) * np.exp(-x * x / (2 * v))
    for kind in ("sato", "meijering"):
        found = A.ridges(plane, [sigma], kind)[40]
        assert np.abs(found - np.maximum(analytic, 0)).max() < 0.01
    valley = 1 - plane
    for kind in ("frangi", "meijering"):
        assert A.ridges(valley, [sigma], kind)[40, 40] == 0 and A.ridges(valley, [sigma], kind, dark=True)[40, 40] == pytest.approx(1, abs=1e-6)
    assert not A.ridges(np.full((30, 30), 7.0), [sigma], "frangi").any()


def test_deviations_far_from_zero(spark):
    from rasterloom.operators import neighbors as N
    rows = [(i, y, x, 1_000_000.1 if i == 0 else 1e8 + (x * 7 + y * 3) % 5, None) for i in (0, 1) for y in range(12) for x in range(12)]
    df = spark.createDataFrame(rows, "img long, y int, x int, v double, w double")
    found = N.box_stats(df, F.col("v"), 3, "b_").toPandas()
    assert found.loc[found["img"] == 0, "b_sd"].max() < 1e-6 and np.allclose(found.loc[found["img"] == 0, "b_mean"], 1_000_000.1)
    plane = np.array([[(x * 7 + y * 3) % 5 for x in range(12)] for y in range(12)], "f8")
    for y, x in ((0, 0), (5, 6), (11, 3)):
        box = plane[max(0, y - 3):y + 4, max(0, x - 3):x + 4]
        row = found[(found["img"] == 1) & (found["y"] == y) & (found["x"] == x)].iloc[0]
        assert row["b_sd"] == pytest.approx(box.std(), abs=1e-6)
    banked = N.context_bank(df, ["v", "w"], (3,)).toPandas()
    assert banked.loc[banked["img"] == 0, "v_sd_r3"].max() < 1e-6 and banked["w_mean_r3"].isna().all()
    assert np.allclose(banked.sort_values(["img", "y", "x"])["v_sd_r3"], found.sort_values(["img", "y", "x"])["b_sd"])
