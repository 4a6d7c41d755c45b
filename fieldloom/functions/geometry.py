"""Plane geometry as Column functions: everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def polar(x, y, r, theta) -> Column:
    """Signed distance of a point to the line (r, theta)."""
    return _c(x) * F.cos(_c(theta)) + _c(y) * F.sin(_c(theta)) - _c(r)


def polar_gradient_theta(x, y, theta) -> Column:
    """Derivative of ``polar`` by theta (that by r is -1)."""
    return _c(y) * F.cos(_c(theta)) - _c(x) * F.sin(_c(theta))


def line_distance(x, y, r, theta) -> Column:
    return F.abs(polar(x, y, r, theta))


def along(x, y, x1, y1, x2, y2) -> Column:
    """Position of the nearest point on a segment, from 0 to 1; 0 on a segment without length."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    n = dx * dx + dy * dy
    t = ((_c(x) - _c(x1)) * dx + (_c(y) - _c(y1)) * dy) / F.when(n > 0, n)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)), F.lit(0.0))


def segment_distance2(x, y, x1, y1, x2, y2) -> Column:
    """Squared distance of a point to a segment."""
    t = along(x, y, x1, y1, x2, y2)
    ex = _c(x) - (_c(x1) + t * (_c(x2) - _c(x1)))
    ey = _c(y) - (_c(y1) + t * (_c(y2) - _c(y1)))
    return ex * ex + ey * ey


def overhang_distance(x, y, x1, y1, x2, y2) -> Column:
    """Distance to a segment from its overhang along the direction and its offset across."""
    n = distance(x1, y1, x2, y2)
    ux, uy = (_c(x2) - _c(x1)) / n, (_c(y2) - _c(y1)) / n
    before = (_c(x1) - _c(x)) * ux + (_c(y1) - _c(y)) * uy
    beyond = (_c(x) - _c(x2)) * ux + (_c(y) - _c(y2)) * uy
    across = (_c(x) - _c(x1)) * uy - (_c(y) - _c(y1)) * ux
    return F.hypot(F.greatest(before, beyond, F.lit(0.0)), across)


def cross(ax, ay, bx, by, px, py) -> Column:
    """Twice the signed area of a, b, p: positive if p lies left of a-b."""
    return (_c(bx) - _c(ax)) * (_c(py) - _c(ay)) - (_c(by) - _c(ay)) * (_c(px) - _c(ax))


def intersects(a: tuple, b: tuple) -> Column:
    """Whether two segments (x1, y1, x2, y2) share a point; touching counts."""
    d1, d2 = cross(*a, b[0], b[1]), cross(*a, b[2], b[3])
    d3, d4 = cross(*b, a[0], a[1]), cross(*b, a[2], a[3])
    apart = (
        (F.greatest(_c(a[0]), _c(a[2])) < F.least(_c(b[0]), _c(b[2]))) | (F.greatest(_c(b[0]), _c(b[2])) < F.least(_c(a[0]), _c(a[2])))
        | (F.greatest(_c(a[1]), _c(a[3])) < F.least(_c(b[1]), _c(b[3]))) | (F.greatest(_c(b[1]), _c(b[3])) < F.least(_c(a[1]), _c(a[3])))
    )
    return ~apart & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def segments_distance2(a: tuple, b: tuple) -> Column:
    """Squared distance of two segments: 0 if they meet, else from one of the four ends."""
    ends = F.least(segment_distance2(a[0], a[1], *b), segment_distance2(a[2], a[3], *b), segment_distance2(b[0], b[1], *a), segment_distance2(b[2], b[3], *a))
    return F.when(intersects(a, b), F.lit(0.0)).otherwise(ends)


def signed_distance(x, y, lx, ly, vx, vy) -> Column:
    return (_c(x) - _c(lx)) * _c(vx) + (_c(y) - _c(ly)) * _c(vy)


def lines_meet(r1, t1, r2, t2) -> tuple[Column, Column]:
    """Intersection of two lines in (r, theta) form; null if parallel."""
    s = F.sin(_c(t2) - _c(t1))
    s = F.when(F.abs(s) > 1e-12, s)
    return (_c(r1) * F.sin(_c(t2)) - _c(r2) * F.sin(_c(t1))) / s, (_c(r2) * F.cos(_c(t1)) - _c(r1) * F.cos(_c(t2))) / s


def project(x, y, r, theta) -> tuple[Column, Column]:
    """Foot of the perpendicular on the line."""
    d = polar(x, y, r, theta)
    return _c(x) - d * F.cos(_c(theta)), _c(y) - d * F.sin(_c(theta))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((_c(x2) - _c(x1)) * (_c(x2) - _c(x1)) + (_c(y2) - _c(y1)) * (_c(y2) - _c(y1)))


def direction(x1, y1, x2, y2) -> tuple[Column, Column]:
    n = distance(x1, y1, x2, y2)
    n = F.when(n > 0, n)
    return (_c(x2) - _c(x1)) / n, (_c(y2) - _c(y1)) / n


def normal_toward(px, py, x1, y1, x2, y2) -> tuple[Column, Column]:
    """Unit normal of the segment on the side of the point."""
    dx, dy = direction(x1, y1, x2, y2)
    side = F.when((_c(px) - _c(x1)) * -dy + (_c(py) - _c(y1)) * dx < 0, -1.0).otherwise(1.0)
    return -dy * side, dx * side


def fold_angle(r, theta) -> tuple[Column, Column]:
    """The same line with theta in [0, pi)."""
    r, t = _c(r), _c(theta)
    return F.when((t < 0) | (t >= PI), -r).otherwise(r), F.when(t < 0, t + PI).when(t >= PI, t - PI).otherwise(t)


def line_guess(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Line (r, theta) through two points, theta from pi/2 - atan2, folded."""
    theta = F.lit(PI / 2) - F.atan2(_c(y2) - _c(y1), _c(x2) - _c(x1))
    return fold_angle(_c(x1) * F.cos(theta) + _c(y1) * F.sin(theta), theta)


def normal_form(x1, y1, x2, y2) -> tuple[Column, Column]:
    """(r, theta) of the line through two points."""
    theta = F.atan2(_c(x1) - _c(x2), _c(y2) - _c(y1))
    return fold_angle(_c(x1) * F.cos(theta) + _c(y1) * F.sin(theta), theta)


def angle_class(t1, t2) -> Column:
    d = F.abs(_c(t1) - _c(t2))
    return F.when((d < PI / 5) | (d > 4 * PI / 5), "parallel").when((d > PI / 3) & (d < 2 * PI / 3), "perpendicular").otherwise("oblique")


def is_parallel(t1, t2, part: int = 5) -> Column:
    d = F.abs(_c(t1) - _c(t2))
    return (d < PI / part) | (d > (part - 1) * PI / part)


def is_perpendicular(t1, t2) -> Column:
    d = F.abs(_c(t1) - _c(t2))
    return (d > PI / 3) & (d < 2 * PI / 3)


def edge_weight(l1, l2, max_length, dist2, pose2, gamma_dist: float, gamma_rob: float, use: tuple[bool, bool, bool] = (True, True, True)) -> Column:
    """Length share times distance decay times pose decay, each of which can be left out."""
    w = F.lit(1.0)
    if use[0]:
        w = w * (_c(l1) + _c(l2)) / (2 * _c(max_length))
    if use[1]:
        w = w * F.exp(-gamma_dist * _c(dist2))
    if use[2]:
        w = w * F.exp(-gamma_rob * _c(pose2))
    return w


def matern_half(x1, y1, x2, y2, lamb: float) -> Column:
    return F.exp(-lamb * distance(x1, y1, x2, y2))


def log_distance(mu, lamb: float) -> Column:
    """-ln(mu) / lambda as a logarithm would have it: infinity at 0 and NaN below."""
    m = _c(mu)
    return F.when(m > 0, -F.ln(F.when(m > 0, m)) / lamb).when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def circular_prior(x, y, radius: float, scale: float) -> Column:
    return F.exp(-(_c(x) * _c(x) + _c(y) * _c(y) - radius * radius) * scale)


def contour_band(d, low: float = 0.25, high: float = 2.25, levels: int = 9) -> Column:
    """Index of the iso-level band of a distance: 0 below the first level, ``levels`` beyond the last."""
    step = (high - low) / (levels - 1)
    return F.least(F.lit(levels), F.greatest(F.lit(0), F.floor((_c(d) - low) / step) + 1)).cast("int")
