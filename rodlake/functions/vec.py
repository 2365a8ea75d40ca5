"""Vectors as triples of columns, angles, rotations, 3x3 determinants, and ``let``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def let(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns that later expressions read as values.

    ``withColumn`` chains are collapsed: every use repeats the whole expression, and
    geometry soon outgrows one generated method. A generator is a barrier to that, and
    stays inside code generation.
    """
    row = F.struct(*[c.alias(n) for n, c in named.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return df.select(*kept, F.explode(F.array(row)).alias("_let")).select(*kept, *[F.col(f"_let.{n}").alias(n) for n in named])


def cols(x: str, y: str, z: str) -> Vec:
    return F.col(x), F.col(y), F.col(z)


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, s) -> Vec:
    return a[0] * s, a[1] * s, a[2] * s


def neg(a: Vec) -> Vec:
    return -a[0], -a[1], -a[2]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def mixed(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a: Vec, b: Vec) -> Column:
    """The angle between two directions; exact also where it is near 0, where acos loses half the digits."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def unit(a: Vec) -> Vec:
    n = norm(a)
    return a[0] / n, a[1] / n, a[2] / n


def cos_between(a: Vec, b: Vec) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def min_image(d: Column, length) -> Column:
    """The difference ``d`` moved to the nearest periodic image of a box of this length."""
    return d - length * F.floor(d / length + 0.5)


def min_image_vec(d: Vec, box: tuple[float, float, float], periodic: tuple[bool, bool, bool] = (True, True, True)) -> Vec:
    return tuple(min_image(c, F.lit(float(n))) if p else c for c, n, p in zip(d, box, periodic))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(b, a))


def periodic_distance(a: Vec, b: Vec, box: tuple[float, float, float]) -> Column:
    return norm(min_image_vec(sub(b, a), box))


def point_line_distance(p: Vec, origin: Vec, direction: Vec) -> Column:
    """Distance of a point from the line through ``origin`` along a unit ``direction``."""
    return norm(cross(sub(p, origin), direction))


def rotate_x(a: Vec, t) -> Vec:
    return a[0], F.cos(t) * a[1] - F.sin(t) * a[2], F.sin(t) * a[1] + F.cos(t) * a[2]


def rotate_y(a: Vec, t) -> Vec:
    return F.cos(t) * a[0] + F.sin(t) * a[2], a[1], -F.sin(t) * a[0] + F.cos(t) * a[2]


def rotate_z(a: Vec, t) -> Vec:
    return F.cos(t) * a[0] - F.sin(t) * a[1], F.sin(t) * a[0] + F.cos(t) * a[1], a[2]


def to_frame(a: Vec, mu, xi) -> Vec:
    """Turn a vector sampled about +z to the direction given by the angles mu and xi: about y by -xi, then about z by -mu."""
    return rotate_z(rotate_y(a, -xi), -mu)


def angles(a: Vec) -> tuple[Column, Column]:
    """(theta, phi) of a unit vector: theta folds to [0, pi/2], phi to [0, pi]; phi is 0 on the axis, that is within 1e-9 of it."""
    flat = F.sqrt(a[0] * a[0] + a[1] * a[1])
    return F.asin(F.least(flat, F.lit(1.0))), F.when(flat > 1e-9, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a[0] / flat)))).otherwise(F.lit(0.0))


def unwrap(a: Vec) -> Vec:
    """A point on a cylinder about z, laid flat: x is the arc length, y the radius."""
    r = F.sqrt(a[0] * a[0] + a[1] * a[1])
    return r * F.atan2(a[0], a[1]), r, a[2]


def det2(m) -> Column:
    return m[0][0] * m[1][1] - m[0][1] * m[1][0]


def det3(m) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def trace(m) -> Column:
    return m[0][0] + m[1][1] + m[2][2]


def mat_vec(m, v: Vec) -> Vec:
    return dot(m[0], v), dot(m[1], v), dot(m[2], v)


def mat_mat(m, n) -> tuple[Vec, Vec, Vec]:
    t = tuple(zip(*n))
    return tuple(tuple(dot(r, c) for c in t) for r in m)


def copysign(size, sign: Column) -> Column:
    return F.when(sign < 0, -size).otherwise(size)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(low, F.least(high, x))


def acos_abs(x: Column) -> Column:
    """Angle in [0, pi/2] between undirected axes whose cosine is x."""
    return F.acos(F.least(F.lit(1.0), F.abs(x)))


def rank3(m, eps: float = 1e-9) -> Column:
    """Rank of a 3x3 matrix, by its minors."""
    minors = [m[i][k] * m[j][n] - m[i][n] * m[j][k] for i in range(3) for j in range(i + 1, 3) for k in range(3) for n in range(k + 1, 3)]
    return F.when(F.abs(det3(m)) > eps, 3).when(F.greatest(*[F.abs(x) for x in minors]) > eps, 2).when(F.greatest(*[F.abs(x) for r in m for x in r]) > eps, 1).otherwise(0)


def _led(rs: Column, k: int) -> Column:
    """Rows, the one with the largest entry in column k first."""
    at = lambda r: F.abs(F.element_at(r, k + 1))
    spot = F.array_position(F.transform(rs, at), F.array_max(F.transform(rs, at))).cast("int")
    return F.concat(F.slice(rs, spot, F.lit(1)), F.slice(rs, F.lit(1), spot - 1), F.slice(rs, spot + 1, F.size(rs) - spot))


def _cleared(rs: Column, k: int) -> Column:
    """What is left of the rows behind the first without column k."""
    top, at = F.element_at(rs, 1), lambda r, j: F.element_at(r, j + 1)
    f = lambda r: F.when(at(top, k) == 0, F.lit(0.0)).otherwise(at(r, k) / at(top, k))
    return F.transform(F.slice(rs, F.lit(2), F.size(rs) - 1), lambda r: F.array(*[F.lit(0.0) if j == k else at(r, j) - f(r) * at(top, j) for j in range(3)]))


def eliminated(df: DataFrame, m: tuple[Vec, Vec, Vec], name: str = "triangle") -> DataFrame:
    """Add ``name``: the upper triangle, as three arrays, of a 3x3 matrix by forward elimination; the row with the largest entry leads. A column of zeros is passed over."""
    kept = df.columns
    df = let(df, _one=_led(F.array(*[F.array(*r) for r in m]), 0))
    df = let(df, _two=_led(_cleared(F.col("_one"), 0), 1))
    df = let(df, _last=_cleared(F.col("_two"), 1))
    return df.select(*[f"`{c}`" for c in kept], F.array(F.col("_one")[0], F.col("_two")[0], F.col("_last")[0]).alias(name))


def symmetric_axes(df: DataFrame, entries: tuple[str, str, str, str, str, str], name: str = "axes") -> DataFrame:
    """Add ``name``: three structs (k, w, x, y, z) of a symmetric 3x3 matrix with columns (xx, yy, zz, xy, xz, yz), largest k first.

    w is the eigenvalue, k its size, (x, y, z) the unit eigenvector, of either sign. The root that is
    farthest from the others has a closed form that is exact to rounding; the other two, which may be
    nearly equal, come from the 2x2 problem across its axis. Of equal roots any axes are given
    that are orthogonal; a null entry gives nulls.
    """
    xx, yy, zz, xy, xz, yz = (F.col(c) for c in entries)
    kept = df.columns
    zero = F.lit(0.0)
    df = let(df, _q=(xx + yy + zz) / 3.0)
    q = F.col("_q")
    df = let(df, _p=F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0))
    p = F.col("_p")
    per = lambda v: F.when(p > 0, v / p).otherwise(zero)
    df = let(df, **{f"_b{k}": per(v) for k, v in (("xx", xx - q), ("yy", yy - q), ("zz", zz - q), ("xy", xy), ("xz", xz), ("yz", yz))})
    b = {k: F.col(f"_b{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    df = let(df, _r=clamp(det / 2.0, F.lit(-1.0), F.lit(1.0)))
    turn = F.acos(F.abs(F.col("_r"))) / 3.0
    df = let(df, _e=F.when(F.col("_r") < 0, -2.0).otherwise(2.0) * F.cos(turn))
    e = F.col("_e")
    rows = [(b["xx"] - e, b["xy"], b["xz"]), (b["xy"], b["yy"] - e, b["yz"]), (b["xz"], b["yz"], b["zz"] - e)]
    df = let(df, _c=F.sort_array(F.array(*[F.struct(dot(c, c).alias("s"), *[v.alias(n) for v, n in zip(c, "xyz")]) for c in (cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))]), asc=False)[0])
    size = F.sqrt(F.col("_c.s"))
    df = let(df, **{f"_w{v}": F.when(size > 0, F.col(f"_c.{v}") / size).otherwise(F.lit(1.0 if v == "x" else 0.0)) for v in "xyz"})
    w = tuple(F.col(f"_w{v}") for v in "xyz")
    wide = F.abs(w[0]) > F.abs(w[1])
    df = let(df, _l=F.when(wide, F.sqrt(w[0] * w[0] + w[2] * w[2])).otherwise(F.sqrt(w[1] * w[1] + w[2] * w[2])))
    df = let(df, _ux=F.when(wide, -w[2]).otherwise(zero) / F.col("_l"), _uy=F.when(wide, zero).otherwise(w[2]) / F.col("_l"), _uz=F.when(wide, w[0]).otherwise(-w[1]) / F.col("_l"))
    u = tuple(F.col(f"_u{v}") for v in "xyz")
    df = let(df, **{f"_v{n}": c for n, c in zip("xyz", cross(w, u))})
    v = tuple(F.col(f"_v{n}") for n in "xyz")
    times = lambda a: (xx * a[0] + xy * a[1] + xz * a[2], xy * a[0] + yy * a[1] + yz * a[2], xz * a[0] + yz * a[1] + zz * a[2])
    df = let(df, _ww=dot(w, times(w)), _uu=dot(u, times(u)), _uv=dot(u, times(v)), _vv=dot(v, times(v)))
    df = let(df, _h=F.hypot((F.col("_uu") - F.col("_vv")) / 2.0, F.col("_uv")), _t=F.atan2(F.col("_uv"), (F.col("_uu") - F.col("_vv")) / 2.0) / 2.0)
    df = let(df, _cos=F.cos("_t"), _sin=F.sin("_t"), _mid=(F.col("_uu") + F.col("_vv")) / 2.0)
    c, s = F.col("_cos"), F.col("_sin")
    three = ((F.col("_ww"), w), (F.col("_mid") + F.col("_h"), add(scale(u, c), scale(v, s))), (F.col("_mid") - F.col("_h"), sub(scale(v, c), scale(u, s))))
    axes = F.sort_array(F.array(*[F.struct(F.abs(value).alias("k"), value.alias("w"), *[x.alias(n) for x, n in zip(axis, "xyz")]) for value, axis in three]), asc=False)
    return let(df, **{name: axes}).select(*[f"`{k}`" for k in kept], name)
