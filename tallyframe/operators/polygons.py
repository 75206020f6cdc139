"""Areas and overlaps of polygons of any shape, by a sweep over horizontal slabs.

The heights of all corners and of all crossings of edges cut the plane into slabs in which no two edges cross.  There both
polygons are rows of trapezoids, so their widths half way up, times the slab's height, are their areas.  A point is inside
where a ray meets an odd number of edges, so corners may go either way round, and edges that touch or lie on each
other need no special case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells (pairs of polygons, slabs, edges) that are held at once.
CELLS = 4_000_000


def _crossings(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Heights at which edges of p and q cross: (pairs, edges of p * edges of q), not a number where they do not."""
    a, b = p[:, :, None], q[:, None, :]
    da, db = np.roll(p, -1, 1)[:, :, None] - a, np.roll(q, -1, 1)[:, None, :] - b
    gap = b - a
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    turn = cross(da, db)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(gap, db) / turn, cross(gap, da) / turn
        at = np.where((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), a[..., 1] + t * da[..., 1], np.nan)
    return at.reshape(len(p), p.shape[1] * q.shape[1])


def _at(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the edges of p cross the lines y: (pairs, lines, edges), infinite where they do not."""
    x, top = p[..., 0][:, None], p[..., 1][:, None]
    x2, end = np.roll(p, -1, 1)[..., 0][:, None], np.roll(p, -1, 1)[..., 1][:, None]
    line = y[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        place = x + (line - top) * (x2 - x) / (end - top)
    return np.where((np.minimum(top, end) < line) & (line < np.maximum(top, end)), place, np.inf)


def overlap_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(pairs, 3): area of p, area of q, area of both, of corners (pairs, n, 2) and (pairs, m, 2)."""
    heights = np.concatenate([p[..., 1], q[..., 1], _crossings(p, q), _crossings(p, p), _crossings(q, q)], 1)
    heights = np.sort(heights, 1)  # not-a-numbers last
    heights = heights[:, : int((~np.isnan(heights)).sum(1).max(initial=0))]
    out = np.zeros((len(p), 3))
    edges = p.shape[1] + q.shape[1]
    step = max(1, CELLS // max(1, len(p) * edges))
    for at in range(0, heights.shape[1] - 1, step):
        y = heights[:, at : at + step + 1]
        tall = np.nan_to_num(np.diff(y))
        mid = (y[:, 1:] + y[:, :-1]) / 2
        x = np.concatenate([_at(p, mid), _at(q, mid)], 2)
        order = np.argsort(x, 2)
        x = np.take_along_axis(x, order, 2)
        of_p = order < p.shape[1]
        met = np.isfinite(x)
        in_p, in_q = np.cumsum(of_p & met, 2) % 2 == 1, np.cumsum(~of_p & met, 2) % 2 == 1
        wide = np.where(met[..., 1:], np.diff(np.where(met, x, 0)), 0)
        for k, inside in enumerate((in_p, in_q, in_p & in_q)):
            out[:, k] += (tall * np.where(inside[..., :-1], wide, 0).sum(2)).sum(1)
    return out


def polygon_overlap(a: str, b: str) -> Column:
    """Struct (area_a, area_b, both) of two polygons x0, y0, x1, y1 ...: simple or not, convex or not, either way round.

    Fewer than three corners have no area.  Null where a polygon is null, or has a null, a non-finite or an odd number.
    """

    def areas(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 3), np.nan)
        sizes: dict[tuple[int, int], list[int]] = {}
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            if p is not None and q is not None and len(p) % 2 == len(q) % 2 == 0:
                sizes.setdefault((len(p), len(q)), []).append(i)
        for (n, m), rows in sizes.items():
            if n == 0 or m == 0:  # no corner to stand for a point
                n, m = max(n, 2), max(m, 2)
            step = max(1, CELLS // (n * m))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                corners = lambda s, k: np.stack([np.asarray(s.iloc[i] if len(s.iloc[i]) else [0.0] * k, float) for i in some]).reshape(len(some), -1, 2)  # noqa: E731, B023
                p, q = corners(x, n), corners(y, m)
                good = np.isfinite(p).all((1, 2)) & np.isfinite(q).all((1, 2))
                out[np.array(some)[good]] = overlap_areas(p[good], q[good])
        return pd.DataFrame(out, columns=["area_a", "area_b", "both"]).astype(object).where(~np.isnan(out), None)

    return F.pandas_udf(areas, "area_a double, area_b double, both double")(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"))


def polygon_iou(a: str, b: str) -> Column:
    """Area of both polygons over the area of either; 0 where neither has any, null where ``polygon_overlap`` has none."""
    made = polygon_overlap(a, b)
    either = made["area_a"] + made["area_b"] - made["both"]
    return F.when(either.isNotNull(), F.when(either > 0, made["both"] / either).otherwise(0.0))
