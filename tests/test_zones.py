"""Zones of polygons against distances and crossings of every pixel center."""

import numpy as np
import pytest

from rasterloom.operators import arrays as A
from rasterloom.operators import zones as Z

SCHEMA = "img long, id long, part int, hole boolean, ring array<struct<x:double,y:double>>"
MODES = ["whole", "inside", "outside", "both"]


def inside(ring, x, y):
    odd = np.zeros(x.shape, bool)
    for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
        if py != qy:
            odd ^= ((py > y) != (qy > y)) & (px + (y - py) * (qx - px) / (qy - py) <= x)
    return odd


def apart(ring, x, y):
    least = np.full(x.shape, np.inf)
    for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
        n = (qx - px) ** 2 + (qy - py) ** 2
        t = np.clip(((x - px) * (qx - px) + (y - py) * (qy - py)) / n, 0, 1) if n else 0.0
        least = np.minimum(least, np.hypot(x - px - t * (qx - px), y - py - t * (qy - py)))
    return least


def expected(rings, d, size=60):
    y, x = np.mgrid[0:size, 0:size] + 0.5
    f = np.any([inside(r, x, y) for r in rings], axis=0)
    near = np.min([apart(r, x, y) for r in rings], axis=0) <= d
    return {"whole": f, "inside": f & near, "outside": near & ~f, "both": near}


def star(seed, n=9):
    rng = np.random.default_rng(seed)
    at, r = np.sort(rng.random(n)) * 2 * np.pi, rng.uniform(5, 22, n)
    return [(float(30 + a * np.cos(t)), float(30 + a * np.sin(t))) for t, a in zip(at, r)]


SQUARE = [(10.0, 10.0), (50.0, 10.0), (50.0, 50.0), (10.0, 50.0), (10.0, 10.0)]
HOLE, ISLAND, OTHER = [(16.0, 16.0), (16.0, 44.0), (44.0, 44.0), (44.0, 16.0)], [(25.0, 25.0), (35.0, 25.0), (30.0, 34.0)], [(52.0, 20.0), (57.0, 20.0), (55.0, 40.0)]


def found(spark, shapes, mode, d, size=60):
    masks = {}
    for r in Z.span_pixels(Z.zone_spans(shapes, mode, d)).collect():
        if 0 <= r.y < size and 0 <= r.x < size:
            m = masks.setdefault(r.id, np.zeros((size, size), bool))
            assert not m[r.y, r.x]
            m[r.y, r.x] = True
    return masks


@pytest.mark.parametrize("d", [0.4, 3.3])
def test_zones(spark, d):
    rings = {k: [star(k)] for k in range(4)} | {10: [SQUARE, OTHER]}
    rows = [(0, k, i, False, r) for k, rs in rings.items() for i, r in enumerate(rs)] + [(0, 10, 7, True, HOLE), (0, 10, 8, False, ISLAND), (0, 10, 9, False, SQUARE), (0, 11, 0, False, None), (0, 12, 0, None, SQUARE[:2])]
    shapes = spark.createDataFrame(rows, SCHEMA).cache()
    for mode in MODES:
        by = found(spark, shapes, mode, d)
        assert set(by) <= set(rings)
        for k, rs in rings.items():
            assert (by.get(k, np.zeros((60, 60), bool)) == expected(rs, d)[mode]).all(), (k, mode)


def test_odd_cases(spark):
    shapes = spark.createDataFrame([(0, 1, 0, False, SQUARE)], SCHEMA)
    assert (found(spark, shapes, "no such mode", 2.0)[1] == expected([SQUARE], 2.0)["outside"]).all()
    assert Z.zone_spans(shapes, "both", 0.0).count() == 0 and Z.zone_spans(shapes.limit(0), "both", 2.0).count() == 0
    with pytest.raises(ValueError):
        Z.spans(shapes, -1.0)
    area = sum(r.b - r.a for r in Z.zone_spans(shapes, "outside", 6.0).collect())
    assert abs(area - (4 * 40 * 6 + np.pi * 36)) < 1.0


def test_agrees_with_the_raster_zone_up_to_a_pixel(spark):
    shapes = spark.createDataFrame([(0, 1, 0, False, star(2))], SCHEMA)
    mask = expected([star(2)], 1.0)["whole"]
    y, x = np.mgrid[0:60, 0:60] + 0.5
    for mode in MODES[1:3]:
        differ = found(spark, shapes, mode, 3.0)[1] ^ A.zone(mask, mode, 3.0)
        d = apart(star(2), x, y)
        assert (np.minimum(d, np.abs(d - 3.0))[differ] <= 1.0).all()
