"""Seeded shuffles against a plain one, and backgrounds by disks against loops."""

import numpy as np
import pytest

from rasterloom.operators import arrays as A
from rasterloom.operators import draws as D
from rasterloom.operators import tiles as T


class Plain:
    """The generator, a state at a time."""

    def __init__(self, seed):
        self.state = (seed ^ D.MULTIPLIER) & D.MASK

    def under(self, bound):
        while True:
            self.state = (self.state * D.MULTIPLIER + D.INCREMENT) & D.MASK
            u = self.state >> 17
            if bound & (bound - 1) == 0:
                return bound * u >> 31
            if u - u % bound + bound - 1 < 1 << 31:
                return u % bound


def plain_shuffle(values, seed):
    values, draw = list(values), Plain(seed)
    for i in range(len(values), 1, -1):
        j = draw.under(i)
        values[i - 1], values[j] = values[j], values[i - 1]
    return values


def test_first_numbers_of_seed_42():
    """As the public generator's documentation lets one work out: 0, 3, 8 under 10."""
    draw = Plain(42)
    assert [draw.under(10) for _ in range(3)] == [0, 3, 8]


def test_jumps_equal_steps():
    draw = Plain(7)
    one_by_one = []
    for _ in range(300):
        draw.under(2)
        one_by_one.append(draw.state)
    for first, count in ((1, 300), (17, 100), (250, 1)):
        assert D.states(7, first, count).tolist() == one_by_one[first - 1:first - 1 + count]


@pytest.mark.parametrize("n, take, seed", [(1, 1, 42), (2, 1, 42), (30, 30, 1), (257, 20, 42), (4000, 15, 9)])
def test_shuffles_equal_plain_ones(spark, n, take, seed):
    rows = spark.range(n).selectExpr("id * 3 AS k").repartition(3)
    found = [r.k for r in D.shuffled_first(rows, "k", take, seed).orderBy("rank").collect()]
    want = plain_shuffle(range(0, 3 * n, 3), seed)[:take]
    assert sorted(found) == sorted(want) if take >= n else found == want


def test_refused_states_move_what_comes_after(spark, monkeypatch):
    state, bound = D.states(5, 1, 4000), np.full(4000, (1 << 30) + 1)
    value, refused = D.drawn(state, bound)
    assert 0.4 < refused.mean() < 0.6
    draw = Plain(5)
    assert value[~refused][:500].tolist() == [draw.under((1 << 30) + 1) for _ in range(500)]


def plain_ball(plane, radius):
    h, w = plane.shape
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    over = lambda p, f: np.array([[f(p[y + dy, x + dx] for dy, dx in disk if 0 <= y + dy < h and 0 <= x + dx < w) for x in range(w)] for y in range(h)])
    return plane - over(over(plane, min), max)


@pytest.mark.parametrize("radius", [1, 3, 10])
def test_backgrounds_equal_a_loop_for_any_tile(spark, radius):
    rng = np.random.default_rng(radius)
    plane = rng.random((26, 31))
    want = plain_ball(plane, radius)
    assert np.allclose(A.rolling_ball(plane, radius), want)
    rows = spark.createDataFrame([(0, y, x, float(plane[y, x])) for y in range(26) for x in range(31)], "img long, y int, x int, v double")
    found = T.rolling_ball(rows, "v", radius, tile=16).toPandas()
    assert len(found) == plane.size and np.allclose(found["v"], want[found["y"], found["x"]])
