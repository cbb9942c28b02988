"""Array kernels on planes: distances, components, thinning, tracing, filters.

All are pure numpy on one plane; ``tiles`` runs them over images of any size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd

#: The eight steps in the order in which a walk tries them.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))


def along_columns(target: np.ndarray) -> np.ndarray:
    """The distance of each pixel to the nearest target in its column, infinite without one."""
    d = np.where(target, 0.0, np.inf)
    for i in range(1, len(d)):
        d[i] = np.minimum(d[i], d[i - 1] + 1)
    for i in range(len(d) - 2, -1, -1):
        d[i] = np.minimum(d[i], d[i + 1] + 1)
    return d


def across_rows(column: np.ndarray) -> np.ndarray:
    """Distances from those along columns: each row takes the least of (column distance)^2 + (offset)^2, offset by offset, until none can win."""
    w = column.shape[1]
    if not np.isfinite(column).any():
        return column
    squares = column * column
    best = squares.copy()
    for k in range(1, w):
        if k * k >= best.max():
            break
        best[:, k:] = np.minimum(best[:, k:], squares[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], squares[:, k:] + k * k)
    return np.sqrt(best)


def distance(mask: np.ndarray) -> np.ndarray:
    """The exact distance of each mask pixel to the nearest pixel outside; 0 outside, infinite if there is none."""
    return across_rows(along_columns(~mask))


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """1 + the first pixel's place of each component, 0 outside: least labels spread to neighbors and along chains of labels."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        before = label.copy()
        for dy, dx in steps:
            a = label[:h - dy, max(0, -dx):w - max(0, dx)]
            b = label[dy:, max(0, dx):w - max(0, -dx)]
            both = (a > 0) & (b > 0)
            least = np.minimum(a, b)  # before either side changes, as the sides overlap
            a[both] = np.minimum(a[both], least[both])
            b[both] = np.minimum(b[both], least[both])
        flat = label.ravel()
        on = flat > 0
        flat[on] = np.minimum(flat[on], flat[flat[on] - 1])
        if (label == before).all():
            return label


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    label = components(mask)
    return mask & (np.bincount(label.ravel())[label] >= least)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes: what of the outside does not reach the edge."""
    outside = components(np.pad(~mask, 1, constant_values=True))
    return outside[1:-1, 1:-1] != outside[0, 0]


def zone(mask: np.ndarray, mode: str, reach: float) -> np.ndarray:
    """whole, outside (0 < distance <= reach), inside or both, of a region without holes."""
    region = filled(mask)
    reach = max(1.0, reach)
    if mode == "whole":
        return region
    out, inn = distance(~region), distance(region)
    rings = {"outside": (out > 0) & (out <= reach), "inside": (inn > 0) & (inn <= reach)}
    if mode == "both":
        return rings["outside"] | rings["inside"]
    if mode not in rings:
        raise ValueError(f"unknown zone mode {mode}")
    return rings[mode]


def ring(mask: np.ndarray) -> list[np.ndarray]:
    """The eight neighbors' planes, in ring order from the one above."""
    p = np.pad(mask.astype("u1"), 1)
    h, w = mask.shape
    return [p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def thinned(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """A skeleton one pixel wide: contour pixels whose loss keeps their ring in one run go, from two sides in turn, ``most`` times or until none goes."""
    m = mask.astype(bool).copy()
    for _ in itertools.count() if most is None else range(most):
        changed = False
        for side in (0, 1):
            n = ring(m)
            count = sum(n)
            runs = sum((n[k] == 0) & (n[(k + 1) % 8] == 1) for k in range(8))
            a, b = (n[0] * n[2] * n[4], n[2] * n[4] * n[6]) if side == 0 else (n[0] * n[2] * n[6], n[0] * n[4] * n[6])
            gone = m & (count >= 2) & (count <= 6) & (runs == 1) & (a == 0) & (b == 0)
            changed |= bool(gone.any())
            m &= ~gone
        if not changed:
            break
    return m


def gap_centers(fiber: np.ndarray, inside: np.ndarray, here: np.ndarray | None = None) -> np.ndarray:
    """Widths (twice the distance) at local maxima of the distance to a fiber, above 1, whose circle stays off the array's edge; 0 elsewhere. Pixels not ``here`` are no maxima and hide none."""
    width = np.zeros(fiber.shape)
    if not fiber.any():
        return width
    d = distance(~fiber)
    if here is not None:
        d[~here] = -1.0
    h, w = fiber.shape
    p = np.pad(d, 1, constant_values=-1.0)
    top = np.max([p[1 + dy:1 + dy + h, 1 + dx:1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    y, x = np.mgrid[:h, :w]
    room = np.minimum(np.minimum(y, h - 1 - y), np.minimum(x, w - 1 - x))
    at = (d >= top) & (d > 1) & (d <= room) & inside
    width[at] = 2 * d[at]
    return width


def gaussian(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable smoothing cut at four sigmas, mirrored at the edges."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(plane.astype("f8"), pad, mode="symmetric")
        plane = sum(v * np.take(padded, np.arange(i, i + plane.shape[axis]), axis) for i, v in enumerate(k))
    return plane


def disk_extreme(plane: np.ndarray, radius: int, least: bool) -> np.ndarray:
    """The least (or largest) value in the disk of that radius around each pixel; beyond the plane there is none.

    A disk is a chord a row. Extremes over chords of growing length are made
    from each other, so that the cost goes by the radius and not by its square.
    """
    pick, none = (np.minimum, np.inf) if least else (np.maximum, -np.inf)
    h, w = plane.shape
    wide = np.pad(plane.astype("f8"), radius, constant_values=none)
    best, chord, reach = np.full((h, w), none), wide[:, radius:radius + w], 0
    for dy in range(radius, -1, -1):
        half = int(np.floor(np.sqrt(radius * radius - dy * dy)))
        while reach < half:
            reach += 1
            chord = pick(chord, pick(wide[:, radius - reach:radius - reach + w], wide[:, radius + reach:radius + reach + w]))
        for side in {dy, -dy}:
            best = pick(best, chord[radius + side:radius + side + h])
    return best


def rolling_ball(plane: np.ndarray, radius: int, here: np.ndarray | None = None) -> np.ndarray:
    """The plane less its opening by the disk; pixels that are not ``here`` have no part in it."""
    here = np.ones(plane.shape, bool) if here is None else here
    low = disk_extreme(np.where(here, plane, np.inf), radius, True)
    return np.where(here, plane - disk_extreme(np.where(here, low, -np.inf), radius, False), 0.0)


def smoothed(plane: np.ndarray, sigma: float, ranks: tuple[int, int]) -> np.ndarray:
    """Derivatives down and across, of ranks 0 to 2, of the plane smoothed by sigma: one pass of the Gaussian's own derivative each way.

    Kernels are cut at four sigmas and give just 0 on planes of a lower power, and 1 (or 2 / 2) on their own.
    """
    r = int(4 * sigma + 0.5)
    t = np.arange(-r, r + 1)
    k = np.exp(-0.5 * (t / sigma) ** 2)
    k /= k.sum()
    for axis, rank in enumerate(ranks):
        if rank == 0:
            w = k
        elif rank == 1:
            w = k * t / (k * t * t).sum()
        else:
            w = k * (t * t - (k * t * t).sum())
            w = 2 * w / (w * t * t).sum()
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(plane.astype("f8"), pad, mode="symmetric")
        plane = sum(v * np.take(padded, np.arange(i, i + plane.shape[axis]), axis) for i, v in enumerate(w))
    return plane


def scharr(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives down and across by the 3 x 3 kernel (3, 10, 3) / 16 * (-1, 0, 1) / 2, mirrored at the edges."""
    p = np.pad(plane.astype("f8"), 1, mode="symmetric")
    smooth = lambda q, axis: (3 * np.take(q, range(0, q.shape[axis] - 2), axis) + 10 * np.take(q, range(1, q.shape[axis] - 1), axis) + 3 * np.take(q, range(2, q.shape[axis]), axis)) / 16
    slope = lambda q, axis: (np.take(q, range(2, q.shape[axis]), axis) - np.take(q, range(0, q.shape[axis] - 2), axis)) / 2
    return slope(smooth(p, 1), 0), slope(smooth(p, 0), 1)


def orientation(plane: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Axial angle of the structure tensor in degrees [0, 180), along the fibers: 0 across, growing from there downwards; nan off the mask."""
    gy, gx = scharr(gaussian(plane, 1.0))
    xx, yy, xy = (gaussian(v, 4.0) for v in (gx * gx, gy * gy, gx * gy))
    # Fibers run across the gradient.
    theta = np.degrees(0.5 * np.arctan2(2 * xy, xx - yy)) + 90.0
    return np.where(mask, np.mod(theta, 180.0), np.nan)


def whole_rings(here: np.ndarray) -> np.ndarray:
    """Pixels that are there with all their neighbors."""
    p = np.pad(here, 1, mode="symmetric")
    return np.all([p[i:i + here.shape[0], j:j + here.shape[1]] for i in range(3) for j in range(3)], axis=0)


def coherence(plane: np.ndarray, window: int, here: np.ndarray | None = None) -> np.ndarray:
    """(hypot(sxx - syy, 2 sxy)) / (sxx + syy) of gradient products summed over whole windows; nan without gradient. A pixel beside one not ``here`` has none."""
    gy, gx = scharr(plane)
    if here is not None:
        known = whole_rings(here)
        gy, gx = np.where(known, gy, 0.0), np.where(known, gx, 0.0)
    n = plane.shape[0] // window, plane.shape[1] // window
    total = lambda v: v[:n[0] * window, :n[1] * window].reshape(n[0], window, n[1], window).sum(axis=(1, 3))
    xx, yy, xy = total(gx * gx), total(gy * gy), total(gx * gy)
    trace = xx + yy
    return np.where(trace > 1e-12 * window * window, np.hypot(xx - yy, 2 * xy) / np.where(trace > 0, trace, 1), np.nan)


def ridges(plane: np.ndarray, sigmas: list[float], kind: str = "sato", dark: bool = False) -> np.ndarray:
    """Response to bright (or dark) ridges in [0, 1]: 1 is that of a straight ridge of full contrast of the first sigma's width.

    From the eigenvalues of the Hessian at each sigma (by derivatives of the
    Gaussian), of which the best counts. ``meijering`` and ``frangi`` go by the
    eigenvalue that is larger in size, so that valleys give 0.
    What parts structure from noise in ``frangi`` is half the size of that ridge's
    eigenvalues, and not that of the strongest structure of this image.
    """
    def bends(image: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
        """The larger eigenvalue of the Hessian by size, and the other, at scale s."""
        image = -image if dark else image
        yy, xx, xy = (smoothed(image, s, ranks) * s * s for ranks in ((2, 0), (0, 2), (1, 1)))
        mid, half = (xx + yy) / 2, np.hypot((xx - yy) / 2, xy)
        return np.where(mid < 0, mid - half, mid + half), np.where(mid < 0, mid + half, mid - half)

    reach = int(8 * max(sigmas)) + 8
    offset = np.arange(-reach, reach + 1, dtype="f8")
    reference = np.repeat(np.exp(-0.5 * (offset / sigmas[0]) ** 2)[None, :], 2 * reach + 1, axis=0)
    reference = 1 - reference if dark else reference
    gamma = float(np.hypot(*bends(reference, sigmas[0]))[reach, reach]) / 2

    def response(image: np.ndarray) -> np.ndarray:
        best = np.zeros(image.shape)
        for s in sigmas:
            main, side = bends(image, s)
            if kind == "sato":
                found = np.maximum(-np.minimum(main, side), 0)
            elif kind == "meijering":
                found = np.where(main < 0, np.maximum(-(main + side / 3), 0), 0)
            elif kind == "frangi":
                ratio, size = np.where(main != 0, side / np.where(main != 0, main, 1), 0), np.hypot(main, side)
                found = np.where(main < 0, np.exp(-2 * ratio * ratio) * (1 - np.exp(-(size ** 2) / (2 * gamma ** 2))), 0)
            else:
                raise ValueError(f"unknown ridge filter {kind}")
            best = np.maximum(best, found)
        return best

    return np.clip(response(plane) / response(reference)[reach, reach], 0, 1)


def alignment(plane: np.ndarray) -> dict[str, float]:
    """Radon alignment of a square window: the variance of projections at each degree, inside the inscribed disk.

    pmr is the peak over the mean, ai the share of the best tenth of angles,
    fwhm the degrees above half the peak, entropy in bits, theta the axis.
    """
    n = min(plane.shape)
    r = (n - 1) / 2
    y, x = np.mgrid[:n, :n] - r
    disk = np.hypot(y, x) <= r
    v, y, x = plane[:n, :n][disk].astype("f8"), y[disk], x[disk]
    profile = np.zeros(180)
    for t in range(180):
        rho = np.round(x * np.cos(np.radians(t)) + y * np.sin(np.radians(t))).astype("i8")
        keep = np.abs(rho) <= 0.8 * r
        at = rho[keep] - rho[keep].min()
        chord = np.bincount(at)
        profile[t] = (np.bincount(at, v[keep]) / np.maximum(chord, 1))[chord > 0].var()
    total = profile.sum()
    if total <= 0:
        return {"pmr": np.nan, "ai": np.nan, "fwhm": np.nan, "entropy": np.nan, "theta": np.nan}
    p = profile / total
    return {"pmr": float(profile.max() / profile.mean()), "ai": float(np.sort(p)[-18:].sum()), "fwhm": float((profile >= profile.max() / 2).sum()),
            "entropy": float(-(p[p > 0] * np.log2(p[p > 0])).sum()), "theta": float((90.0 - profile.argmax()) % 180.0)}
