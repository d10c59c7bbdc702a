"""Coverage and statistics from first principles, without the library."""

import math

import numpy as np


def inside_box(ring, x0, y0, x1, y1):
    """Area of a ring within a box: the ring is clipped to four half planes, one after the other."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ina, inb = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cross = [a[k] + t * (b[k] - a[k]) for k in (0, 1)]
                cross[axis] = bound
                out.append(tuple(cross))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def length_in_box(a, b, x0, y0, x1, y1):
    """Length of a segment within a box, by the range of its parameter."""
    low, high = 0.0, 1.0
    for k, (lo, hi) in enumerate(((x0, x1), (y0, y1))):
        d = b[k] - a[k]
        if d == 0:
            if not lo <= a[k] <= hi:
                return 0.0
            continue
        s, t = sorted(((lo - a[k]) / d, (hi - a[k]) / d))
        low, high = max(low, s), min(high, t)
    return max(0.0, high - low) * math.dist(a, b)


def boxes(grid):
    for r in range(grid.rows):
        for c in range(grid.cols):
            x0, y1 = grid.xmin + c * grid.dx, grid.ymax - r * grid.dy
            yield r, c, (x0, y1 - grid.dy, x0 + grid.dx, y1)


def polygon_shares(polygons, grid):
    """Covered share of each cell; a polygon is a list of rings, shell first."""
    out = np.zeros((grid.rows, grid.cols))
    for r, c, box in boxes(grid):
        for shell, *holes in polygons:
            out[r, c] += inside_box(list(shell), *box) - sum(inside_box(list(h), *box) for h in holes)
    return out / (grid.dx * grid.dy)


def line_lengths(line, grid):
    """Length in each cell; right for lines that don't run along cell edges."""
    out = np.zeros((grid.rows, grid.cols))
    for r, c, box in boxes(grid):
        out[r, c] = sum(length_in_box(a, b, *box) for a, b in zip(line, line[1:]))
    return out


def wkt_of(polygons):
    one = lambda rings: "(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"
    return f"POLYGON {one(polygons[0])}" if len(polygons) == 1 else "MULTIPOLYGON (" + ", ".join(map(one, polygons)) + ")"


def quantile(x, c, q):
    """Quantile of values with weights: linear between the values at ``i * own + (n - 1) * before``."""
    values = np.unique(x)
    own = np.array([c[x == v].sum() for v in values])
    at = np.arange(len(values)) * own + (len(values) - 1) * (np.cumsum(own) - own)
    at[0] = 0
    return float(np.interp(q * own.sum() * (len(values) - 1), at, values))


def statistics(x, c, w=None):
    """All statistics of cells given in row-major order: values, coverage, weights."""
    n, mu = c.sum(), (x * c).sum() / c.sum()
    values = np.unique(x)
    share = np.array([c[x == v].sum() for v in values])
    var = (c * (x - mu) ** 2).sum() / n
    out = {
        "count": n, "sum": (x * c).sum(), "mean": mu, "min": x.min(), "max": x.max(), "variety": len(values), "variance": var, "stdev": math.sqrt(var), "coefficient_of_variation": math.sqrt(var) / mu,
        "mode": values[share == share.max()].max(), "minority": values[share == share.min()].min(), "unique": values.tolist(), "frac": (share / n).tolist(), "values": x.tolist(), "coverage": c.tolist(),
    }
    if w is not None:
        cw = c * w
        muw = (x * cw).sum() / cw.sum()
        varw = (cw * (x - muw) ** 2).sum() / cw.sum()
        out |= {"weighted_sum": (x * cw).sum(), "weighted_mean": muw, "weighted_variance": varw, "weighted_stdev": math.sqrt(varw), "weighted_fraction": (x * cw).sum() / (x * c).sum(), "weighted_count": cw.sum(), "weights": w.tolist(), "weighted_frac": [cw[x == v].sum() / cw.sum() for v in values]}
    return out
