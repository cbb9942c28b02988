"""What is done by tiles, strips and passes equals the same on the whole image."""

import numpy as np
import pandas as pd
import plain_paths as P
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import arrays as A
from rasterloom.operators import features as X
from rasterloom.operators import tiles as T
from rasterloom.operators import tracing as R

H, W, TILE = 37, 45, 16


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(7)
    blobs = A.gaussian(rng.random((2, H, W))[0], 1.5), A.gaussian(rng.random((H, W)), 1.0)
    return [p > np.quantile(p, 0.55) for p in blobs] + [np.zeros((H, W), bool)]


@pytest.fixture(scope="module")
def px(spark, planes):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:H, :W]
    parts = [pd.DataFrame({"img": i, "y": y.ravel().astype("i4"), "x": x.ravel().astype("i4"), "m": m.ravel(), "v": A.gaussian(rng.random((H, W)), 0.7).ravel()}) for i, m in enumerate(planes)]
    return spark.createDataFrame(pd.concat(parts))


def back(df, name, missing, img):
    """One image's plane of a column, or of the pixels that are there."""
    rows = df.where(f"img = {img}").toPandas()
    plane = np.full((H, W), missing)
    plane[rows["y"], rows["x"]] = True if name is None else rows[name]
    assert len(rows) == len(rows[["y", "x"]].drop_duplicates())
    return plane


def value(px, img):
    return back(px, "v", np.nan, img)


@pytest.mark.parametrize("diagonal", [False, True])
def test_components(px, planes, diagonal):
    found = T.components(px.where("m"), diagonal, TILE).withColumn("label", F.shiftright("label", 32) * W + F.col("label") % T.PLACE + 1).cache()
    for i, m in enumerate(planes):
        assert (back(found, "label", 0, i) == A.components(m, diagonal)).all()


def test_one_component_over_all_tiles(spark):
    """A winding line through every tile is one component, named by its first pixel."""
    points = [(y, x) for y in range(0, 40, 2) for x in range(40)] + [(y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)]
    mask = spark.createDataFrame([(5, y, x) for y, x in points], "img long, y int, x int")
    assert [tuple(r) for r in T.components(mask, tile=TILE).select("img", "label").distinct().collect()] == [(5, 0)]
    assert T.without_small(mask, len(points) + 1, TILE).isEmpty() and T.without_small(mask, len(points), TILE).count() == len(points)


def test_thinning(px, planes):
    found = T.thinned(px.where("m"), TILE, 2).cache()
    for i, m in enumerate(planes):
        assert (back(found, None, False, i) == A.thinned(m)).all()


def test_thinning_of_a_mask_thicker_than_a_round(spark):
    thick = np.zeros((40, 60), bool)
    thick[4:36, 5:55] = True
    y, x = np.nonzero(thick)
    found = T.thinned(spark.createDataFrame(pd.DataFrame({"img": 0, "y": y.astype("i4"), "x": x.astype("i4")})), TILE, 2)
    assert {(r.y, r.x) for r in found.collect()} == set(zip(*np.nonzero(A.thinned(thick))))


def test_distances(px, planes):
    found = T.distances(px, F.col("m")).cache()
    for i, m in enumerate(planes):
        assert np.allclose(back(found, "d", -1.0, i), A.distance(~m))


def test_distances_over_missing_pixels_and_nulls(spark):
    """A pixel without a row hides no target behind it; a null is no target."""
    rows = [(0, 0, 0, True), (0, 0, 2, None), (0, 2, 1, False), (1, 0, 0, None)]
    found = T.distances(spark.createDataFrame(rows, "img long, y int, x int, t boolean"), F.col("t")).collect()
    assert {(r.img, r.y, r.x): round(r.d, 6) for r in found} == {(0, 0, 0): 0.0, (0, 0, 2): 2.0, (0, 2, 1): round(5 ** 0.5, 6), (1, 0, 0): float("inf")}


def test_holes_and_zones(px, planes):
    region, found = T.filled(px, F.col("m"), TILE).cache(), T.zones(px, F.col("m"), 2.0, TILE).cache()
    for i, m in enumerate(planes):
        assert (back(region, "region", False, i) == A.filled(m)).all()
        for mode in ("whole", "outside", "inside", "both"):
            assert (back(found, mode, False, i) == A.zone(m, mode, 2.0)).all()
    for mode in ("whole", "outside", "inside", "both"):
        assert (back(T.zone(px, F.col("m"), mode, 2.0), None, False, 0) == A.zone(planes[0], mode, 2.0)).all()
    with pytest.raises(ValueError):
        T.zone(px, F.col("m"), "elsewhere", 2.0)


def test_filters_with_a_halo(px, planes):
    theta, ridge, slope = T.orientation(px, "v", "m", TILE).cache(), T.ridges(px, "v", [1.0, 2.0], ["sato", "frangi"], tile=TILE).cache(), T.gradients(px, "v", 1.0, TILE).cache()
    for i, m in enumerate(planes):
        v = value(px, i)
        assert np.allclose(back(theta, "theta", np.nan, i), A.orientation(v, m), equal_nan=True)
        assert all(np.allclose(back(ridge, k, np.nan, i), A.ridges(v, [1.0, 2.0], k)) for k in ("sato", "frangi"))
        gy, gx = A.scharr(A.gaussian(v, 1.0))
        assert np.allclose(back(slope, "gy", np.nan, i), gy) and np.allclose(back(slope, "gx", np.nan, i), gx)


def lists(rows):
    return [list(map(tuple, p.sort_values("seq")[["y", "x"]].to_numpy().tolist())) for _, p in rows.groupby("fiber")]


def table(spark, *masks):
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "img long, y int, x int")


def curves(seed, h=40, w=56):
    """Thinned strokes that cross, touch and turn."""
    rng, m = np.random.default_rng(seed), np.zeros((h, w), bool)
    for _ in range(11):
        y, x, t = rng.random() * h, rng.random() * w, rng.random() * 6.3
        for _ in range(int(rng.integers(10, 70))):
            t += rng.normal() * 0.2
            y, x = y + np.sin(t), x + np.cos(t)
            if 0 <= y < h and 0 <= x < w:
                m[int(y), int(x)] = True
    return A.thinned(m)


@pytest.mark.parametrize("tile", [16, 512])
def test_paths_equal_plain_ones_for_any_tile(spark, planes, tile):
    masks = [A.thinned(m) for m in planes] + [curves(k) for k in range(6)]
    skeleton = table(spark, *masks)
    found, whole = R.traced_links(skeleton, tile).toPandas(), R.traced(skeleton, tile=tile).toPandas()
    walked = R.segments(skeleton, tile).toPandas()
    for i, m in enumerate(masks):
        assert P.either_way(lists(found[found["img"] == i])) == P.either_way(P.links(m))
        assert P.either_way(lists(whole[whole["img"] == i])) == P.either_way(P.fibers(m))
        assert P.either_way(lists(walked[walked["img"] == i])) == P.either_way(P.pieces(m))


def drawn(*rows):
    return np.array([[c == "#" for c in row] for row in rows])


def test_a_network_that_spans_many_tiles(spark):
    """A snake without a node between its ends is one link, and a comb of crossing lines whole fibers, whatever the tiles."""
    snake = np.zeros((58, 60), bool)
    snake[::3] = True
    for r in range(0, 57, 3):
        snake[r:r + 3, 0 if r % 2 else -1] = True
    grid = np.zeros((60, 60), bool)
    grid[5:55:9, :] = grid[:, 4:55:9] = True
    skeleton = table(spark, snake, grid)
    for tile in (8, 512):
        found = R.traced(skeleton, tile=tile).toPandas()
        assert [len(p) for p in lists(found[found["img"] == 0])] == [snake.sum()]
        straight = P.either_way(lists(found[found["img"] == 1]))
        assert straight == P.either_way([[(y, x) for x in range(60)] for y in range(5, 55, 9)] + [[(y, x) for y in range(60)] for x in range(4, 55, 9)])


def test_a_staircase_is_no_junction():
    stairs = drawn("##..", ".##.", "..##")
    assert P.either_way(P.pieces(stairs)) == [((0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3))]
    assert not R.junctions(stairs).any()


def test_walks_end_on_junctions_and_lone_pixels_are_walks():
    plus = drawn("..#....", "..#...#", "#####..", "..#....", "..#....")
    found = P.either_way(P.pieces(plus))
    assert ((1, 6),) in found and P.crossings(plus) == {(2, 2)}
    assert ((0, 2), (1, 2), (2, 2)) in found


def test_a_fiber_goes_on_straight_over_a_junction_and_not_around_a_right_angle(spark):
    plus = drawn("..#..", "..#..", "#####", "..#..", "..#..")
    found = {frozenset(p) for p in lists(R.traced(table(spark, plus)).toPandas())}
    assert found == {frozenset((2, x) for x in range(5)), frozenset((y, 2) for y in range(5))}
    tee = table(spark, drawn("#####", "..#..", "..#..", "..#.."))
    assert len(lists(R.traced(tee).toPandas())) == 2 and len(lists(R.traced_links(tee).toPandas())) >= 3


def test_rings_without_a_node_are_not_traced(spark):
    ring = drawn(".##.", "#..#", "#..#", ".##.")
    assert R.traced(table(spark, ring)).count() == 0 and R.traced_links(table(spark, ring), tile=2).count() == 0 and len(P.pieces(ring)) == 1
    assert R.traced(table(spark, np.zeros((3, 3), bool))).count() == 0 and R.segments(table(spark, np.zeros((3, 3), bool))).count() == 0


def test_a_tail_on_a_ring_does_not_run_in_circles(spark):
    """A walk that gets into a ring without a junction stops before its own pixels, in one tile and over several."""
    for shape in (drawn("#.....", ".#....", "..##..", "..#.#.", "...##."), drawn("......##.", "#####...#", "....#...#", "....#..#.", ".....##..")):
        for tile in (2, 512):
            found = lists(R.traced_links(table(spark, shape), tile).toPandas())
            assert P.either_way(found) == P.either_way(P.links(shape))


def test_segmentation_chain(px, planes):
    v = value(px, 0)
    found = X.segmented(px.where("img = 0"), F.col("v"), 0.5, 4)
    assert (back(found, None, False, 0) == A.without_small(v >= 0.5, 4)).all()
    ridge = X.segmented(px.where("img = 0"), F.col("v"), 0.1, 4, ridge="sato", sigmas=[1.0])
    assert (back(ridge, None, False, 0) == A.without_small(A.ridges(v, [1.0], "sato") >= 0.1, 4)).all()
    dark = X.segmented(px.where("img = 0"), F.col("v"), 0.5, dark=True)
    assert (back(dark, None, False, 0) == (1 - v >= 0.5)).all()


def plain_features(m, v, y, x, window, um):
    """One window's features straight from whole planes."""
    skeleton, box = A.thinned(m), (slice(y, y + window), slice(x, x + window))
    theta, cross = A.orientation(m.astype("f8"), m), P.crossings(skeleton)
    straight, bent, share = (np.zeros(m.shape) for _ in range(3))
    for p in P.fibers(skeleton):
        q = np.array(p, "f8")
        arc = np.hypot(*np.diff(q, axis=0).T).sum()
        at = tuple(np.array(p).T)
        straight[at], share[at] = np.hypot(*(q[-1] - q[0])) / arc, 1 / len(p)
        if len(p) >= 3:
            k = min(4, len(p) - 1)
            a, b = q[k] - q[0], q[-1] - q[-1 - k]
            if a.any() and b.any():
                bent[at] = np.arccos(np.clip(a @ b / np.hypot(*a) / np.hypot(*b), -1, 1)) / arc
    gy, gx = (2 * g for g in A.scharr(A.gaussian(v, 1.0)))
    t, s, f = theta[box][np.isfinite(theta[box])], skeleton[box], m[box]
    area = f.size
    width, n = 2 * A.distance(m)[box][s], max(s.sum(), 1)
    axis = np.exp(2j * np.radians(t)).mean() if len(t) >= max(1, int(0.1 * window * window)) else np.nan
    xx, yy, xy = ((p * q)[box].sum() for p, q in ((gx, gx), (gy, gy), (gx, gy)))
    inner = lambda points: sum(y <= p[0] < y + window and x <= p[1] < x + window for p in points)
    ends = inner([p for p in map(tuple, np.argwhere(skeleton).tolist()) if len(P.near(skeleton, p)) == 1])
    return {"n_fiber_px": f.sum(), "coverage_fraction": f.mean(), "order_parameter": abs(axis), "length_um_per_um2": s.sum() / (area * um),
            "branch_per_um2": inner(cross) / (area * um * um), "endpoint_per_um2": ends / (area * um * um), "segment_equivalents_per_um2": share[box].sum() / (area * um * um),
            "branch_to_endpoint_ratio": inner(cross) / ends if ends else np.nan, "width_mean_um": width.mean() * um if len(width) else np.nan, "width_sd_um": width.std() * um if len(width) else np.nan,
            "straightness_mean_lenweighted": straight[box].sum() / n if s.any() else np.nan, "curvature_mean_per_um": bent[box].sum() / n / um if s.any() else np.nan,
            "intensity_mean": v[box][f].mean() if f.any() else np.nan, "intensity_sd": v[box][f].std() if f.any() else np.nan, "signal_density": v[box].mean(), "signal_sd": v[box].std(),
            "intensity_coherence": np.hypot(xx - yy, 2 * xy) / (xx + yy), "gradient_energy": (xx + yy) / area}


def test_pooled_features(px, planes):
    made = X.feature_planes(px, F.col("m"), "v").cache()
    found = X.pooled(made, window=12, stride=6, height=H, width=W, pixel_um=0.5).toPandas().set_index(["img", "iy", "ix"])
    assert len(found.columns) == 20 and found["partial"].any() and not found["partial"].all()
    for i, m in enumerate(planes):
        v = value(px, i)
        for iy, ix in [(0, 0), (2, 3), (4, 5), (5, 6)]:
            row = found.loc[(i, iy, ix)]
            for name, expected in plain_features(m, v, 6 * iy, 6 * ix, 12, 0.5).items():
                assert np.isclose(float(row[name] if row[name] is not None else np.nan), float(expected), atol=1e-6, equal_nan=True), (i, iy, ix, name)
    core = X.pooled(made, window=12, stride=6, height=H, width=W, pixel_um=0.5, crop=(6, 6, 30, 24)).toPandas().set_index(["img", "iy", "ix"])
    assert np.isclose(core.loc[(0, 0, 0), "width_mean_um"], found.loc[(0, 1, 1), "width_mean_um"])
    with pytest.raises(ValueError):
        X.pooled(made, window=12, stride=6, height=H, width=W, crop=(40, 0, 30, 10))


def test_a_tile_of_another_shape_fails(spark, px):
    from rasterloom.operators.lattice import accumulated
    assert {tuple(r) for r in accumulated(px.withColumn("g", F.lit(1)), "g", 16).collect()} == {(i, H * W, H * W) for i in range(3)}
    with pytest.raises(Exception, match="another shape"):
        accumulated(px.where("NOT (img = 1 AND y = 3 AND x = 3)").withColumn("g", F.lit(1)), "g", 16).collect()
