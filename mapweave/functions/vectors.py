"""Column expressions on vectors, poses and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once; an expression that is named several times may be computed as often."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def safe_unit(a: Column, least: float = 1e-8) -> Column:
    return let(F.greatest(norm(a), F.lit(least)), lambda n: F.transform(a, lambda x: x / n))


def finite(*cols: Column) -> Column:
    """Neither null nor NaN nor infinite. Spark orders NaN above every number, so a comparison alone would let it pass."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    return ok


def angle_deg(trace: Column) -> Column:
    """Angle of a rotation with this trace; null and NaN as they are."""
    return F.degrees(F.acos(clipped((trace - 1) / 2)))


def clipped(x: Column) -> Column:
    """x within -1 and 1. The functions least and greatest alone would pass over null, and put NaN above every number."""
    return F.when(x < -1, -1.0).when((x > 1) & ~F.isnan(x), 1.0).otherwise(x)


def direction_angle_deg(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Angle between two directions; null if either has no length."""
    lengths = F.array(norm(a), norm(b))
    both = lambda n: F.when((n[0] > least) & (n[1] > least), F.degrees(F.acos(clipped(dot(a, b) / (n[0] * n[1])))))
    return let(lengths, both)


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major rotation of a quaternion of any length; an error for length 0."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("quaternion of length 0")).cast("double"))
    w, x, y, z = w / n, x / n, y / n, z / n
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def rotate(r: Column, v: Column) -> Column:
    row = lambda i: sum((F.get(r, F.lit(3 * i + k)) * F.get(v, F.lit(k)) for k in range(1, 3)), F.get(r, F.lit(3 * i)) * F.get(v, F.lit(0)))
    return F.array(row(0), row(1), row(2))


def transpose(r: Column) -> Column:
    return F.array(*(F.get(r, F.lit(3 * k + i)) for i in range(3) for k in range(3)))


def compose(a: Column, b: Column) -> Column:
    g = lambda m, i, k: F.get(m, F.lit(3 * i + k))
    return F.array(*(g(a, i, 0) * g(b, 0, k) + g(a, i, 1) * g(b, 1, k) + g(a, i, 2) * g(b, 2, k) for i in range(3) for k in range(3)))


def trace(r: Column) -> Column:
    return F.get(r, F.lit(0)) + F.get(r, F.lit(4)) + F.get(r, F.lit(8))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot does not begin one."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
