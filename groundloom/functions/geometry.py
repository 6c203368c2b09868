"""Rotations and camera geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

Vec = tuple[Column, Column, Column]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    n = length(a)
    return tuple(F.when(n > 1e-12, x / n) for x in a)


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def with_rotation(df: DataFrame, q: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz"), prefix: str = "m") -> DataFrame:
    """Adds the nine entries m00..m22 of the rotation of a quaternion that need not be normalised."""
    w, x, y, z = (F.col(c) for c in q)
    n = F.sqrt(w * w + x * x + y * y + z * z)
    n = F.when(n > 0, n).otherwise(F.lit(1.0))
    df = df.withColumn("_n", n)
    w, x, y, z = (c / F.col("_n") for c in (w, x, y, z))
    rows = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    return df.withColumns({f"{prefix}{r}{c}": rows[r][c] for r in range(3) for c in range(3)}).drop("_n")


def camera_centre(t: tuple[str, str, str], prefix: str = "m") -> Vec:
    """-R^T t."""
    return tuple(-(F.col(f"{prefix}0{k}") * F.col(t[0]) + F.col(f"{prefix}1{k}") * F.col(t[1]) + F.col(f"{prefix}2{k}") * F.col(t[2])) for k in range(3))


def quaternion(m: list[list[Column]]) -> list[Column]:
    """(w, x, y, z) of a rotation matrix: by the trace when positive, else by the largest diagonal entry."""
    trace = m[0][0] + m[1][1] + m[2][2]

    def by_trace() -> list[Column]:
        s = 2 * F.sqrt(trace + 1)
        return [0.25 * s, (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s]

    def by_axis(i: int) -> list[Column]:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2 * F.sqrt(1 + m[i][i] - m[j][j] - m[k][k])
        out: list[Column] = [(m[k][j] - m[j][k]) / s, F.lit(0.0), F.lit(0.0), F.lit(0.0)]
        out[i + 1], out[j + 1], out[k + 1] = 0.25 * s, (m[j][i] + m[i][j]) / s, (m[k][i] + m[i][k]) / s
        return out

    x_first = (m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2])
    y_first = m[1][1] >= m[2][2]
    parts = zip(by_trace(), by_axis(0), by_axis(1), by_axis(2))
    return [F.when(trace > 0, t).when(x_first, a).when(y_first, b).otherwise(c) for t, a, b, c in parts]


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    aw, av, bw, bv = a[0], tuple(a[1:]), b[0], tuple(b[1:])
    c = cross(av, bv)
    return [aw * bw - dot(av, bv), *[aw * bv[k] + bw * av[k] + c[k] for k in range(3)]]


def quaternion_to(n: Vec) -> list[Column]:
    """Rotation taking +Z onto the unit vector n."""
    ax, ay = -n[1], n[0]
    ln = F.sqrt(ax * ax + ay * ay)
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), n[2]))
    half = F.acos(cosine) / 2
    flat = ln < 1e-9
    same = cosine > 0
    return [
        F.when(flat, F.when(same, 1.0).otherwise(0.0)).otherwise(F.cos(half)),
        F.when(flat, F.when(same, 0.0).otherwise(1.0)).otherwise(ax / ln * F.sin(half)),
        F.when(flat, 0.0).otherwise(ay / ln * F.sin(half)),
        F.lit(0.0),
    ]


def turn_about(v: Vec, k: Vec, deg: Column) -> Vec:
    """v turned by deg about the unit axis k, right-handed."""
    c, s, kv, d = F.cos(F.radians(deg)), F.sin(F.radians(deg)), cross(k, v), dot(k, v)
    return tuple(v[i] * c + kv[i] * s + k[i] * d * (1 - c) for i in range(3))


def level_part(v: Vec, up: Vec) -> Vec:
    """Unit horizontal part of v."""
    k = dot(v, up)
    return unit(tuple(v[i] - k * up[i] for i in range(3)))


def rotation_to_z(up: Vec) -> list[list[Column]]:
    """Rotation taking the unit vector up onto +Z; straight down turns about x."""
    ux, uy, uz = up
    bend = ux * ux + uy * uy
    straight = F.sqrt(bend) < 1e-12
    k = 1.0 / (1.0 + uz)
    free = [[1 - ux * ux * k, -ux * uy * k, -ux], [-ux * uy * k, 1 - uy * uy * k, -uy], [ux, uy, 1 - bend * k]]
    flip = F.when(uz > 0, 1.0).otherwise(-1.0)
    fixed = [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), flip, F.lit(0.0)], [F.lit(0.0), F.lit(0.0), flip]]
    return [[F.when(straight, fixed[r][c]).otherwise(free[r][c]) for c in range(3)] for r in range(3)]
