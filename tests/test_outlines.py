"""Outlines: rings fill back to the mask, in tiles of any size, and holes and corners are told apart."""

import numpy as np
import pytest

from rasterloom.operators import arrays as A
from rasterloom.operators import outlines as O


def drawn(seed, share, h=23, w=19):
    return np.random.default_rng(seed).random((h, w)) < share


def ring_mask(h=17, w=17):
    """A network that spans the image, with one hole, and an island in it with a hole of its own."""
    m = np.zeros((h, w), bool)
    m[1:-1, 1:-1] = True
    m[3:-3, 3:-3] = False
    m[6:11, 6:11] = True
    m[8, 8] = False
    return m


def table(spark, masks):
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "img long, y int, x int")


def filled(rings, shape):
    """Even-odd fill of corner lists."""
    inside = np.zeros(shape, bool)
    for ring in rings:
        for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1]):
            assert (y0 == y1) != (x0 == x1)
            if x0 == x1:
                inside[min(y0, y1):max(y0, y1), x0:] ^= True
    return inside


def ordered(points):
    by = {}
    for p in sorted(points, key=lambda p: (p.img, p.ring, p.at)):
        by.setdefault((p.img, p.ring), []).append((p.at, p.y, p.x))
    assert all([a for a, _, _ in r] == list(range(len(r))) for r in by.values())
    return {k: [(y, x) for _, y, x in r] for k, r in by.items()}


@pytest.mark.parametrize("tile", [3, 8, 512])
def test_rings_fill_back(spark, tile):
    masks = [drawn(1, 0.5), drawn(2, 0.75), ring_mask(), np.array([[1, 0], [0, 1]], bool), np.ones((9, 9), bool)]
    mask = table(spark, masks)
    found = O.chains(mask, tile)
    by = ordered(O.ring_points(found).collect())
    rings = O.rings(found, mask, tile).collect()
    assert len(rings) == len(by)
    for i, m in enumerate(masks):
        assert (filled([r for (img, _), r in by.items() if img == i], m.shape) == m).all()
        label = A.components(m)
        outer = [r for r in rings if r.img == i and r.outer]
        assert len(outer) == len(np.unique(label[m])) and len({r.blob for r in outer}) == len(outer)
        # A hole is what of the rest, corners joined, does not reach the padded image's edge.
        rest = A.components(~np.pad(m, 1), True)
        assert sum(not r.outer for r in rings if r.img == i) == len(np.unique(rest[rest > 0])) - 1
        for r in outer:
            own = label == label[r.blob >> 32, r.blob % (1 << 32)]
            holes = [h.area for h in rings if h.img == i and h.blob == r.blob and not h.outer]
            assert r.area - sum(holes) == own.sum()
    for r in rings:
        ring = by[r.img, r.ring]
        assert r.corners == len(ring) and r.edges == sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(ring, ring[1:] + ring[:1]))
        assert ring[0] == (r.ring >> 32, r.ring % (1 << 32))


def test_detections(spark):
    mask = table(spark, [ring_mask(), np.array([[1, 0], [0, 1]], bool)])
    rings = O.rings(O.chains(mask), mask)
    all_of = {(r.img, r.blob): r for r in O.detections(rings).collect()}
    assert len(all_of) == 4 and sorted(r.holes for r in all_of.values()) == [0, 0, 1, 1] and all(r.area_um2 is None for r in all_of.values())
    large = O.detections(rings, 0.5, 2.0, 2.0).collect()
    assert sorted(r.area_um2 for r in large) == [24.0, 15.0 ** 2 - 11 ** 2] and all(r.area_px == 4 * r.area_um2 for r in large)
    assert O.detections(O.rings(O.chains(mask.limit(0)), mask)).count() == 0
    assert O.chains(mask.union(mask)).count() == O.chains(mask).count()
