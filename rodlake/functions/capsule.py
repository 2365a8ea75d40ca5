"""Contacts of capped cylinders: closest approach, contact area, excluded area, van der Waals terms.

A table of pairs has b (bx, by, bz: centre 2 minus centre 1, moved to the nearest
image), unit directions (c1x.., c2x..), lengths l1, l2 and radii a1, a2.

Where the source of these formulas is inconsistent, the consistent reading is taken:
the parallel branch uses the whole dot product, the naive excluded area uses the
neighbour's radius, no direction is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .vec import clamp, copysign, dot, let

EPS = 1e-6
#: Dispersion and repulsion constants, and micrometres to angstroms.
C6, C12, UM_TO_A = 15.2, 24100.0, 1e4
C1, C2, B = ("c1x", "c1y", "c1z"), ("c2x", "c2y", "c2z"), ("bx", "by", "bz")


def closest_approach(pairs: DataFrame) -> DataFrame:
    """Add t1, t2 (places on the axes), d (their distance), and u1, u2, du: the same on the unbounded axes.

    The common perpendicular is kept if it meets both axes within half a length plus a
    radius; else the place farther beyond its end is pinned to the end and the other
    is projected and held within its axis. ``unclamped`` tells which.
    """
    c1, c2, b = vec.cols(*C1), vec.cols(*C2), vec.cols(*B)
    df = let(pairs, cc=dot(c1, c2), p1=dot(c1, b), p2=dot(c2, b))
    cc, p1, p2 = F.col("cc"), F.col("p1"), F.col("p2")
    skew = (1.0 - F.abs(cc)) > EPS
    df = let(df, u1=F.when(skew, (cc * p2 - p1) / (cc * cc - 1.0)).otherwise(copysign(F.col("l1") / 2.0, p1)))
    u1 = F.col("u1")
    df = let(df, u2=F.when(skew, (p2 - cc * p1) / (cc * cc - 1.0)).otherwise(cc * u1 - p2))
    u2, h1, h2 = F.col("u2"), F.col("l1") / 2.0, F.col("l2") / 2.0
    fits = (F.abs(u1) <= h1 + F.col("a1") + EPS) & (F.abs(u2) <= h2 + F.col("a2") + EPS)
    df = let(df, fits=fits, second=(F.abs(u1) - h1) < (F.abs(u2) - h2))
    fits, second = F.col("fits"), F.col("second")
    df = let(df, e1=copysign(h1, u1), e2=copysign(h2, u2))
    t1 = F.when(fits, u1).when(second, clamp(p1 + cc * F.col("e2"), -h1, h1)).otherwise(F.col("e1"))
    t2 = F.when(fits, u2).when(second, F.col("e2")).otherwise(clamp(cc * F.col("e1") - p2, -h2, h2))
    df = let(df, t1=t1, t2=t2)

    def gap(s: str, t: str) -> Column:
        x, y, z = (F.col(i) * F.col(s) - F.col(j) - F.col(k) * F.col(t) for i, j, k in zip(C1, B, C2))
        return F.sqrt(x * x + y * y + z * z)

    df = let(df, d=gap("t1", "t2"), du=gap("u1", "u2"))
    return df.withColumn("unclamped", F.col("fits")).drop("p1", "p2", "fits", "second", "e1", "e2")


def intersects(separation: float = 0.0, soft: float = 1.0) -> Column:
    return F.col("d") < (F.col("a1") + F.col("a2")) * soft + separation + EPS


def at_end(t: Column, length: Column, radius: Column) -> Column:
    return F.abs(F.abs(t) - length / 2.0) < radius + EPS


def in_body(t: Column, length: Column, radius: Column) -> Column:
    return (length / 2.0 - F.abs(t)) > radius + EPS


def contact_area(pairs: DataFrame, reach: float) -> DataFrame:
    """Add s: the area through which two rods with closest approach (t1, t2, d, cc) may exchange charge within ``reach``.

    The largest of a disc, half an ellipse if the approach is between the bodies, and a
    strip if the axes are nearly parallel and lie beside each other: without an overlap there is no strip.
    Takes the bounded approach.
    """
    a1, a2, l1, l2, d, t1, t2 = (F.col(c) for c in ("a1", "a2", "l1", "l2", "d", "t1", "t2"))
    h1, h2 = F.greatest(d - a2 - reach, F.lit(0.0)), F.greatest(d - a1 - reach, F.lit(0.0))
    chord = lambda h, a: F.when(h <= a, a * F.sqrt(F.greatest(F.lit(0.0), 1.0 - (h / a) * (h / a)))).otherwise(0.0)
    df = let(pairs, r2=chord(h2, a2), r=F.least(chord(h1, a1), chord(h2, a2)), g=F.abs(F.col("cc")), sg=F.when(F.col("cc") < 0, -1.0).otherwise(1.0))
    r, g, sg = F.col("r"), F.col("g"), F.col("sg")
    df = let(df, sine=F.sqrt(F.greatest(F.lit(0.0), 1.0 - g * g)), half=F.sqrt(F.greatest(F.lit(0.0), (1.0 - g) / 2.0)), along=F.sqrt((1.0 + g) / 2.0))
    # along: cosine between either axis and the bisector; ends measured from the crossing
    span = F.when(F.col("half") > EPS, F.col("r2") / F.col("half")).otherwise(l1 / 2.0)
    up = F.least(span, F.least((l1 / 2.0 - t1) * F.col("along"), (l2 / 2.0 - sg * t2) * F.col("along")))
    down = F.least(span, F.least(F.abs((l1 / 2.0 + t1) * F.col("along")), F.abs((l2 / 2.0 + sg * t2) * F.col("along"))))
    bodies = (F.abs(t1) < l1 / 2.0 - a1) & (F.abs(t2) < l2 / 2.0 - a2)
    df = let(df, ellipse=F.when(bodies, 0.5 * F.pi() * r * (F.greatest(r, up) + F.greatest(r, down))).otherwise(0.0))
    c1b = dot(vec.cols(*C1), vec.cols(*B))
    # ends on axis 1, measured from centre 1: rod 2 covers [c1b - g l2/2, c1b + g l2/2]
    overlap = F.least(l1 / 2.0, c1b + g * l2 / 2.0) - F.greatest(-l1 / 2.0, c1b - g * l2 / 2.0)
    flat = (F.col("sine") <= F.greatest(a1, a2) / F.least(l1, l2)) & ((F.abs(t1) <= l1 / 2.0 + a1) | (F.abs(t2) <= l2 / 2.0 + a2))
    strip = F.when(flat, F.greatest(overlap, F.lit(0.0)) * 2.0 * r).otherwise(0.0)
    return df.withColumn("s", F.greatest(F.pi() * r * r, F.col("ellipse"), strip)).drop("r2", "r", "g", "sg", "sine", "half", "along", "ellipse")


def _overlap_ends() -> tuple[Column, Column]:
    """Ends of rod 2 on axis 1, nearer end first, for parallel rods."""
    near = F.abs(dot(vec.cols(*B), vec.cols(*C1))) - F.col("l2") / 2.0
    return near, near + F.col("l2")


def excluded_naive(limit: float) -> Column:
    """Excluded area of a touching pair by the crossing of two strips, halved at ends, none beyond; parallel pairs by overlap."""
    s = F.sin(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cc")))))
    a, b = 2.0 * F.col("a1") / s, 2.0 * F.col("a2") / s
    e1, e2 = F.col("l1") / 2.0 - F.abs(F.col("u1")), F.col("l2") / 2.0 - F.abs(F.col("u2"))
    skew = F.when((e1 <= -a) | (e2 <= -b), 0.0).when((F.abs(e1) < a) | (F.abs(e2) < b), a * b * s / 2.0).otherwise(a * b * s)
    n, f = _overlap_ends()
    h = F.col("l1") / 2.0
    par = F.when(n > h - EPS, 0.0).when((n > -h + EPS) & (f < h - EPS), 4.0 * F.col("a1") * (F.least(f, h) - n)).when((n <= -h + EPS) & (f >= h - EPS), 2.0 * F.col("a1") * F.col("l1")).otherwise(0.0)
    return F.when(F.abs(s) > EPS, skew).otherwise(par)


def excluded_parallel() -> Column:
    n, f = _overlap_ends()
    h = F.col("l1") / 2.0
    area = 2.0 * F.least(F.col("a1"), F.col("a2")) * (F.least(f, h) - F.greatest(n, -h))
    return F.when(F.sin(vec.acos_abs(F.col("cc"))) <= EPS, F.greatest(area, F.lit(0.0))).otherwise(0.0)


def excluded_skew() -> Column:
    g = F.least(F.lit(1.0), F.abs(F.col("cc")))
    s = F.sin(vec.acos_abs(F.col("cc")))
    a, b = 2.0 * F.col("a1") / s, 2.0 * F.col("a2") / s
    e1, e2 = F.col("l1") / 2.0 - F.abs(F.col("u1")), F.col("l2") / 2.0 - F.abs(F.col("u2"))
    ra, rb = a / 2.0 * (1.0 + g), b / 2.0 * (1.0 + g)
    area = a * b * s * F.when((e1 >= 0) & (e1 < rb), 0.5).otherwise(1.0) * F.when((e2 >= 0) & (e2 < ra), 0.5).otherwise(1.0)
    return F.when(s <= EPS, 0.0).when(((e1 < 0) & (-e1 > rb)) | ((e2 < 0) & (-e2 > ra)), 0.0).otherwise(area)


def curve_to_surface(d: Column, limit: float, r1: Column, r2: Column, theta: Column) -> Column:
    """Energy a unit length of a curve beside a cylinder, cut off at ``limit`` (all in angstroms)."""
    q = 1.0 - theta * d / limit / limit / (r1 / r2 + 1.0)
    return -C6 * F.pi() * r1 / 2.0 * theta * (1.0 / F.pow(d, 4.0) - 1.0 / limit**4 / q) + C12 * 2.0 * F.pi() * r1 / 5.0 * theta * (1.0 / F.pow(d, 10.0) - 1.0 / limit**10 / F.pow(q, 4.0))


def pair_energy(limit: float) -> Column:
    """Van der Waals energy of a touching pair: excluded area over opening angle and radius, times ``curve_to_surface``."""
    theta = F.atan(F.col("a1") / (F.col("d") - F.col("a2") - limit))
    gap = (F.col("du") - F.col("a1") - F.col("a2")) * UM_TO_A
    return excluded_naive(limit) / theta / F.col("a1") * curve_to_surface(gap, limit * UM_TO_A, F.col("a1") * UM_TO_A, F.col("a2") * UM_TO_A, theta)


# ---- van der Waals of lines and tubes ---------------------------------------------------------------------------


def line_line(d: Column, gamma: Column) -> Column:
    """Two unbounded lines at distance d and angle gamma."""
    s = F.sqrt(F.sin(gamma))
    return -C6 * F.pi() / (2.0 * F.pow(d, 4.0) * s) + C12 * F.pi() / (5.0 * F.pow(d, 10.0) * s)


def line_segment(d: Column, gamma: Column, length: Column) -> Column:
    """An unbounded line and a segment that starts at the common perpendicular.

    With x = length sin(gamma), the attraction integrates (d^2 + u^2)^(-5/2) and the
    repulsion (d^2 + u^2)^(-11/2) over u from 0 to x; both have closed forms.
    """
    x = length * F.sin(gamma)
    q = d * d + x * x
    w = x / F.sqrt(q)  # sine of the opening angle
    attraction = (w - F.pow(w, 3.0) / 3.0) / F.pow(d, 4.0)
    series = w - 4.0 * F.pow(w, 3.0) / 3.0 + 6.0 * F.pow(w, 5.0) / 5.0 - 4.0 * F.pow(w, 7.0) / 7.0 + F.pow(w, 9.0) / 9.0
    return (-C6 * 3.0 * F.pi() / 8.0 * attraction + C12 * 63.0 * F.pi() / 256.0 * series / F.pow(d, 10.0)) / F.sin(gamma)


def line_tube(d: Column, gamma: Column, radius: float, nodes: int = 96) -> Column:
    """An unbounded line and a tube of ``radius`` whose axis is at distance d and angle gamma: ``line_line`` terms summed over the circumference.

    Nodes t and 2 pi - t are equally far, and even powers are products. In Arrow batches: so many terms outgrow a generated method.
    """
    near, far = -C6 * math.pi / 2.0, C12 * math.pi / 5.0

    def around(y: pd.Series) -> pd.Series:
        y, total = y.to_numpy(), 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range((nodes + 1) // 2):
                q = y - radius * math.cos(2 * math.pi * (i + 0.5) / nodes)
                q *= q
                s = q * q
                total = total + (1.0 if 2 * i + 1 == nodes else 2.0) * (near + far / (s * q)) / s
        return pd.Series(total)

    return F.pandas_udf(around, "double")(d) * (2 * math.pi * radius / nodes) / F.sin(gamma)


# ---- ellipses ---------------------------------------------------------------------------------------------------


def quadratic_roots(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    r = F.sqrt(b * b - 4.0 * a * c)
    return (-b + r) / (2.0 * a), (-b - r) / (2.0 * a)


def ellipse_axes(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Half axes, longer first, of a x^2 + b x y + c y^2 = 1 (the inverse roots of its eigenvalues)."""
    r = F.sqrt((a - c) * (a - c) + b * b)
    return 1.0 / F.sqrt(0.5 * (a + c - r)), 1.0 / F.sqrt(0.5 * (a + c + r))


def ellipse_tilt(a: Column, b: Column, c: Column) -> Column:
    """Angle between x and an axis of a x^2 + b x y + c y^2 = 1."""
    return 0.5 * F.atan2(b, a - c)


def ellipse_polar(a: Column, b: Column, t: Column) -> Column:
    return a * b / F.sqrt(F.pow(b * F.cos(t), 2.0) + F.pow(a * F.sin(t), 2.0))


def ellipse_area(a: Column, b: Column) -> Column:
    return F.pi() * a * b


def conic_area(a: Column, b: Column, c: Column) -> Column:
    return 2.0 * F.pi() / F.sqrt(4.0 * a * c - b * b)


def triangle_area(a: Column, b: Column, phi: Column) -> Column:
    return 0.5 * a * b * F.sin(phi)


def circle_segment(r: Column, phi: Column) -> Column:
    """Area cut from a circle by a chord seen from the centre at the angle phi."""
    return 0.5 * r * r * (phi - F.sin(phi))


def ellipse_sector(a: Column, b: Column, phi: Column) -> Column:
    """Area between the long axis and the direction phi, 0 <= phi <= pi."""
    t = F.atan2(a * F.sin(phi), b * F.cos(phi))
    return 0.5 * a * b * t


def ellipse_half_cut(a: Column, b: Column, x: Column) -> Column:
    """Area of the part of the ellipse left of the line at x, -a <= x <= a."""
    return F.pi() * a * b / 2.0 + b / a * (x * F.sqrt(a * a - x * x) + a * a * F.asin(x / a))


def ellipse_through(p: list[tuple[Column, Column]]) -> tuple[Column, Column, Column]:
    """(a, b, c) of the conic a x^2 + b x y + c y^2 = 1 through three points."""
    rows = [(x * x, x * y, y * y) for x, y in p]
    one = F.lit(1.0)
    det = vec.det3(rows)
    put = lambda k: vec.det3([tuple(one if i == k else v for i, v in enumerate(r)) for r in rows]) / det
    return put(0), put(1), put(2)


def exclusion_ellipse(limit: float, widened: bool = True) -> Column:
    """Excluded area of a skew pair from the ellipse through the three extreme points of one tube's shadow on the other, laid flat; none past the ends, cut at them.

    widened: the limit widens both tubes; else the second alone.
    """
    r1, r2, y, s = F.col("a1") + (limit if widened else 0.0), F.col("a2") + limit, F.col("du"), F.sin(vec.acos_abs(F.col("cc")))
    g = F.sqrt(F.greatest(F.lit(0.0), 1.0 - s * s))
    pos = lambda x: F.sqrt(F.greatest(F.lit(0.0), x))
    top = (F.lit(0.0), r1, pos(r2 * r2 - (r1 - y) * (r1 - y)) / s)
    side = pos(r1 * r1 - (r2 - y) * (r2 - y))
    p1 = (side, y - r2, side * g)
    y2 = (y - pos(y * y * g * g + s * s * (r2 * r2 - r1 * r1 * g * g))) / (s * s)
    p2 = (pos(r1 * r1 - y2 * y2), y2, F.lit(0.0))
    flat = [vec.unwrap(p) for p in (top, p1, p2)]
    a, b, c = ellipse_through([(p[0], p[2]) for p in flat])
    long, short = ellipse_axes(a, b, c)
    e = F.least(F.col("l1") / 2.0 - F.abs(F.col("u1")), F.col("l2") / 2.0 - F.abs(F.col("u2")))
    area = F.when(e <= -long, 0.0).when(e < long, ellipse_half_cut(long, short, e)).otherwise(conic_area(a, b, c))
    return F.when(s > EPS, area / F.pow(r1 / F.col("a1"), 2.0)).otherwise(excluded_parallel())
