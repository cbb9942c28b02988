"""Plain tracing of a plane, for small ones: walks with a set of their pixels, pairs by search, fibers by merging lists."""

import numpy as np

from rasterloom.operators import arrays as A
from rasterloom.operators import tracing as R


def near(plane, p):
    inside = lambda y, x: 0 <= y < plane.shape[0] and 0 <= x < plane.shape[1] and plane[y, x]
    return [(p[0] + dy, p[1] + dx) for dy, dx in A.STEPS if inside(p[0] + dy, p[1] + dx)]


def crossings(plane):
    return set(map(tuple, np.argwhere(R.junctions(plane)).tolist()))


def links(plane):
    cross, pixels = crossings(plane), list(map(tuple, np.argwhere(plane).tolist()))
    nodes = [p for p in pixels if p in cross or len(near(plane, p)) < 2]
    made, met = [], set()
    for node in nodes:
        for first in near(plane, node):
            if (node, first) not in met:
                path = [node, first]
                while path[-1] not in nodes:
                    (y0, x0), (y, x) = path[-2:]
                    choice = [(-((q[0] - y) * (y - y0) + (q[1] - x) * (x - x0)), i, q) for i, q in enumerate(near(plane, (y, x))) if q not in path]
                    if not choice:
                        break
                    path.append(min(choice)[2])
                met.add((path[-1], path[-2]))
                made.append(path)
    return made


def fibers(plane, most_turn=70.0, reach=8):
    found, cross = links(plane), crossings(plane)
    ends = [(i, s, p[::-1] if s else p) for i, p in enumerate(found) for s in (0, 1)]

    def dot(a, b):
        u, v = (np.subtract(p[min(reach, len(p)) - 1], p[0]) for p in (a[2], b[2]))
        return round(float(u @ v) / ((np.hypot(*u) or 1) * (np.hypot(*v) or 1)), 12)

    pairs = sorted((dot(a, b), a[:2], b[:2]) for k, a in enumerate(ends) for b in ends[k + 1:] if a[0] != b[0] and a[2][0] == b[2][0] and a[2][0] in cross)
    partner = {}
    for d, a, b in pairs:
        if d <= -np.cos(np.radians(most_turn)) and not {a, b} & partner.keys():
            partner[a], partner[b] = b, a
    chains = {i: [(i, 0)] for i in range(len(found))}
    rings = set()
    for a in sorted(partner):
        b = partner[a]
        one, two = (next(c for c in chains.values() if e[0] in [i for i, _ in c]) for e in (a, b))
        if one is two:
            if {one[0][0], one[-1][0]} == {a[0], b[0]} and len(one) > 1 and a < b and not any(one[k][0] in (a[0], b[0]) and one[k + 1][0] in (a[0], b[0]) for k in range(len(one) - 1)):
                rings.add(id(one))
            elif len(one) == 2 and a < b and sum(partner.get((one[0][0], s), (None,))[0] == one[1][0] for s in (0, 1)) == 2:
                rings.add(id(one))
            continue
        turned = lambda c: [(i, 1 - s) for i, s in c[::-1]]
        one = one if one[-1][0] == a[0] and one[-1][1] == 1 - a[1] else turned(one)
        two = two if two[0] == b else turned(two)
        whole = one + two
        for i, _ in whole:
            chains[i] = whole
    made = []
    for c in {id(c): c for c in chains.values()}.values():
        parts = [found[i][::-1] if s else found[i] for i, s in c]
        if id(c) in rings:
            made += [found[i] for i, _ in c]
        else:
            made.append([p for k, part in enumerate(parts) for p in part[k > 0:]])
    return made


def pieces(plane):
    """Pieces between junctions, pixel by pixel."""
    return [p[["y", "x"]].to_numpy().tolist() for _, p in R._pieces_once(plane).groupby("fiber")]


def either_way(paths):
    """Paths whatever their direction."""
    return sorted(min(tuple(map(tuple, p)), tuple(map(tuple, p[::-1]))) for p in paths)
