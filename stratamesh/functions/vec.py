"""Vector and box arithmetic as column expressions; all stay inside generated code.

A vector is a triple of columns, a box six: the least corner, then the greatest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import options as O

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """Columns ``<prefix>x``, ``<prefix>y`` and ``<prefix>z``."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def box(prefix: str = "") -> tuple[Vec, Vec]:
    """Least and greatest corner, columns ``<prefix>min_x`` to ``<prefix>max_z``."""
    return vec(f"{prefix}min_"), vec(f"{prefix}max_")


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vec) -> Vec:
    """Unit vector; one of length up to 1e-12 stays as it is."""
    n = length(a)
    return tuple(F.when(n > O.EPSILON, p / n).otherwise(p) for p in a)


def distance(a: Vec, b: Vec) -> Column:
    return length(minus(a, b))


def angle_between(a: Vec, b: Vec) -> Column:
    """Degrees from 0 to 90: opposite normals count as parallel."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def transform_point(m: Column, p: Vec) -> Vec:
    """``p`` under a column-major affine 4 x 4 matrix."""
    return tuple(m[k] * p[0] + m[k + 4] * p[1] + m[k + 8] * p[2] + m[k + 12] for k in range(3))


def multiply(a: Column, b: Column) -> Column:
    """Product a b of column-major 4 x 4 matrices: b acts first."""
    return F.array(*(reduce(lambda x, y: x + y, (a[4 * k + r] * b[4 * c + k] for k in range(4))) for c in range(4) for r in range(4)))


def bbox_diagonal(low: Vec, high: Vec) -> Column:
    return distance(high, low)


def centre(low: Vec, high: Vec) -> Vec:
    return tuple((a + b) / F.lit(2.0) for a, b in zip(low, high))


def intersects(a: tuple[Vec, Vec], b: tuple[Vec, Vec], pad: float = 0.0) -> Column:
    """Closed boxes overlap, each up to ``pad`` beyond its faces."""
    near = [(p <= q + F.lit(pad)) & (r >= s - F.lit(pad)) for p, q, r, s in zip(a[0], b[1], a[1], b[0])]
    return near[0] & near[1] & near[2]


def contains(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """Closed box ``a`` holds ``b``."""
    inside = [(p <= q) & (r >= s) for p, q, r, s in zip(a[0], b[0], a[1], b[1])]
    return inside[0] & inside[1] & inside[2]


def gap(a: tuple[Vec, Vec], b: tuple[Vec, Vec], axis: int) -> Column:
    """Distance of the boxes along an axis, negative where they overlap."""
    return F.greatest(a[0][axis] - b[1][axis], b[0][axis] - a[1][axis])


def is_adjacent(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """Overlap in z, and side by side in x or in y within the fixed gap while the other axis overlaps."""
    x, y, low, high = gap(a, b, 0), gap(a, b, 1), *map(F.lit, O.ADJACENT_GAP)
    return (gap(a, b, 2) <= 0) & ((x.between(low, high) & (y <= 0)) | (y.between(low, high) & (x <= 0)))


def rests_on(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> Column:
    """``a`` rests on ``b``: its bottom lies about b's top, and they overlap in x and y."""
    low, high = map(F.lit, O.SUPPORT_GAP)
    return (a[0][2] - b[1][2]).between(low, high) & (gap(a, b, 0) <= 0) & (gap(a, b, 1) <= 0)


def is_up_facing(nz: Column) -> Column:
    return nz > O.UP_FACING


def label_of(mean_nz: Column, area: Column) -> Column:
    """Label from the unweighted mean of normal z and the area; null means no region."""
    return (
        F.when(mean_nz.isNull(), "unknown")
        .when(mean_nz > O.UP_FACING, F.when(area > O.GROUND_AREA, "ground").otherwise("roof"))
        .when(mean_nz < -O.UP_FACING, "ceiling")
        .when(F.abs(mean_nz) < O.WALL_FACING, "wall")
        .otherwise("surface")
    )


def label_color(label: Column) -> Column:
    """Red, green, blue and alpha of a label."""
    named = [(k, F.array(*map(F.lit, v))) for k, v in O.COLORS.items()]
    start = F.when(label == named[0][0], named[0][1])
    return reduce(lambda c, kv: c.when(label == kv[0], kv[1]), named[1:], start).otherwise(F.array(*map(F.lit, O.DEFAULT_COLOR)))


def obb_volume(half: Column) -> Column:
    return F.lit(8.0) * half[0] * half[1] * half[2]


def obb_to_aabb(center: Column, axes: Column, half: Column) -> tuple[list[Column], list[Column]]:
    """Envelope of an oriented box: centre plus and minus the sum over axes of |axis| times its half extent."""
    reach = [F.abs(axes[0][k]) * half[0] + F.abs(axes[1][k]) * half[1] + F.abs(axes[2][k]) * half[2] for k in range(3)]
    return [center[k] - reach[k] for k in range(3)], [center[k] + reach[k] for k in range(3)]


def matches_text(entity_id: Column, label: Column, query: str) -> Column:
    """Case-insensitive substring of ``#id label``."""
    return F.lower(F.concat(F.lit("#"), entity_id.cast("string"), F.lit(" "), label)).contains(query.lower())
