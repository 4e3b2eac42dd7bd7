"""Rotations, transforms, facet algebra, antenna layouts and per-case limits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import col

Vec = tuple[Column, Column, Column]

# Nominal antenna positions (mm) by layout, and the placement table of the same layouts.
SPACING_MM = 20.0
LAYOUT_MM = {
    1: ((0.0, 0.0),),
    2: ((-10.0, 0.0), (10.0, 0.0)),
    3: ((0.0, SPACING_MM / math.sqrt(3)), (10.0, -SPACING_MM / math.sqrt(3) / 2), (-10.0, -SPACING_MM / math.sqrt(3) / 2)),
    4: ((-10.0, -10.0), (10.0, -10.0), (-10.0, 10.0), (10.0, 10.0)),
}
PLACEMENT_LAYOUT_MM = {
    "1ant": ((0.0, 0.0, 0.0),),
    "2ant": ((-10.0, 0.0, 0.0), (10.0, 0.0, 0.0)),
    "3ant": ((0.0, 11.55, 0.0), (10.0, -5.77, 0.0), (-10.0, -5.77, 0.0)),
    "4ant": ((-10.0, -10.0, 0.0), (10.0, -10.0, 0.0), (-10.0, 10.0, 0.0), (10.0, 10.0, 0.0)),
}
BASE_DEPTH_MM = 26.4

# Carbonisation limit by case, surface limit, total power limit.
CARBON_LIMIT_CASE0, CARBON_LIMIT_OTHER = 500.0, 120.0
POWER_TOTAL_1_TO_3, POWER_TOTAL_4 = 100.0, 120.0


def antenna_layout(spark: SparkSession) -> DataFrame:
    """The ten nominal antenna positions."""
    rows = [(n, i, x, y) for n, pts in LAYOUT_MM.items() for i, (x, y) in enumerate(pts, start=1)]
    return spark.createDataFrame(rows, "num_antenas int, antenna int, x double, y double")


def placement_layout(spark: SparkSession) -> DataFrame:
    """Positions by layout name, as the placement search uses them."""
    rows = [(k, i, *p) for k, pts in PLACEMENT_LAYOUT_MM.items() for i, p in enumerate(pts, start=1)]
    return spark.createDataFrame(rows, "antena string, antenna int, x double, y double, z double")


def carbon_limit(case: Column) -> Column:
    """P20: 500 for case 0, 120 for cases 1 to 8, NULL for an unknown case."""
    return F.when(case == 0, F.lit(CARBON_LIMIT_CASE0)).when(case.between(1, 8), F.lit(CARBON_LIMIT_OTHER))


def surface_limit(case: Column, corrected: Column) -> Column:
    """P20: upper temperature of an exported surface."""
    return F.when((case == 0) & ~corrected, F.lit(CARBON_LIMIT_CASE0)).otherwise(F.lit(CARBON_LIMIT_OTHER))


def total_power_limit(antennas: Column) -> Column:
    """P20: total power by number of antennas."""
    return F.when(antennas == 4, F.lit(POWER_TOTAL_4)).otherwise(F.lit(POWER_TOTAL_1_TO_3))


def shift_single_antenna(path: Column, xyz: Vec, x: float = 1.0, y: float = 1.0, enabled: bool = True,
                         only_z: float | None = None) -> tuple[Vec, Column]:
    """Force X and Y of the probes of one-antenna models; also tells whether a row moved."""
    hit = F.lower(path).contains("1ant") & F.lit(enabled)
    if only_z is not None:
        hit = hit & (F.abs(xyz[2] - only_z) <= 1e-9)
    return (F.when(hit, F.lit(x)).otherwise(xyz[0]), F.when(hit, F.lit(y)).otherwise(xyz[1]), xyz[2]), hit


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def point(c: Column | str) -> Vec:
    """The x, y, z columns of a struct column."""
    c = col(c)
    return c["x"], c["y"], c["z"]


def xyz_struct(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def axis_angles(a1: Column, a2: Column, axis1: Column, axis2: Column) -> Vec:
    """Two angles placed on two of the three axes (1, 2, 3)."""
    pick = lambda n: F.when(axis2 == n, a2).when(axis1 == n, a1).otherwise(F.lit(0.0))
    return pick(1), pick(2), pick(3)


def rotation(angles: Vec) -> list[list[Column]]:
    """The 3x3 matrix of a turn about x, then y, then z."""
    return rotation_of([F.cos(a) for a in angles], [F.sin(a) for a in angles])


def rotation_of(cosines: Sequence[Column], sines: Sequence[Column]) -> list[list[Column]]:
    """The same matrix from cosines and sines that are already columns."""
    (cx, cy, cz), (sx, sy, sz) = cosines, sines
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def to_world(p: Vec, m: list[list[Column]], shift: Vec) -> Vec:
    """Turn, then translate."""
    return tuple(dot(tuple(row), p) + t for row, t in zip(m, shift))


def to_local(p: Vec, m: list[list[Column]], shift: Vec) -> Vec:
    """Inverse of ``to_world``."""
    d = sub(p, shift)
    return tuple(m[0][k] * d[0] + m[1][k] * d[1] + m[2][k] * d[2] for k in range(3))


def align(a: Vec, b: Vec, eps: float = 1e-8, flip: str = "axis") -> list[list[Column]]:
    """Matrix that turns direction ``a`` onto direction ``b``.

    With unit vectors, axis w = a x b, s = |w| and c = a.b, the turn is I + [w] + [w]^2 (1-c)/s^2.
    Parallel vectors give the identity. Opposite ones turn by pi about an axis normal to ``a``:
    the one built from the smallest component of ``a`` (``flip="axis"``) or the x axis
    (``flip="x"``, used when the target is the z axis).
    """
    a, b = scale(a, 1 / norm(a)), scale(b, 1 / norm(b))
    w, c = cross(a, b), dot(a, b)
    s2 = dot(w, w)
    k = (1 - c) / s2
    one, zero = F.lit(1.0), F.lit(0.0)
    skew = [[zero, -w[2], w[1]], [w[2], zero, -w[0]], [-w[1], w[0], zero]]
    if flip == "x":
        half = [[one, zero, zero], [zero, -one, zero], [zero, zero, -one]]
    else:
        ax, ay, az = (F.abs(v) for v in a)
        first, second = (ax <= ay) & (ax <= az), ay <= az
        unit = (F.when(first, one).otherwise(zero), F.when(~first & second, one).otherwise(zero),
                F.when(~first & ~second, one).otherwise(zero))
        n = cross(a, unit)
        n = scale(n, 1 / norm(n))
        half = [[2 * n[i] * n[j] - (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    out = []
    for i in range(3):
        row = []
        for j in range(3):
            same = one if i == j else zero
            square = w[i] * w[j] - (s2 if i == j else zero)
            row.append(F.when(F.sqrt(s2) >= eps, same + skew[i][j] + square * k)
                       .when(c > 0, same).otherwise(half[i][j]))
        out.append(row)
    return out


def facet_normal(v1: Vec, v2: Vec, v3: Vec) -> Vec:
    """Unit normal, (0, 0, 1) for a degenerate facet."""
    n = cross(sub(v2, v1), sub(v3, v1))
    length = norm(n)
    flat = length < 2.220446049250313e-16
    return (F.when(flat, F.lit(0.0)).otherwise(n[0] / length), F.when(flat, F.lit(0.0)).otherwise(n[1] / length),
            F.when(flat, F.lit(1.0)).otherwise(n[2] / length))


def facet_centroid(v1: Vec, v2: Vec, v3: Vec) -> Vec:
    """P24."""
    return tuple((p + q + r) / 3 for p, q, r in zip(v1, v2, v3))


def outward(normal: Vec, centroid: Vec, center: Vec) -> Vec:
    """The normal flipped away from the mesh centre."""
    sign = F.when(dot(normal, sub(centroid, center)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return scale(normal, sign)


XYZ = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x", "y", "z")])
