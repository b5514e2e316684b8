"""Column expressions on similarity transforms, rotations, cameras and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mapweave.functions.vectors import clipped, compose, finite, let, minus, norm, rotate, trace, transpose


@F.pandas_udf(ArrayType(DoubleType()))
def nearest_rotation(matrices: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The rotation nearest to a row-major 3 x 3 matrix; null for null or not finite matrices."""
    for s in matrices:
        ok = np.array([m is not None and len(m) == 9 and bool(np.isfinite(np.asarray(m, float)).all()) for m in s], bool)
        out = pd.Series([None] * len(s), dtype=object)
        if ok.any():
            u, _, vt = np.linalg.svd(np.stack([np.asarray(m, float) for m in s[ok]]).reshape(-1, 3, 3))
            u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
            out[np.flatnonzero(ok)] = pd.Series(list((u @ vt).reshape(-1, 9)), index=np.flatnonzero(ok))
        yield out


def column_scale(linear: Column) -> Column:
    """Mean length of a matrix' columns; 1 if that vanishes or is not finite."""
    g = lambda i: F.get(linear, F.lit(i))
    s = sum((F.sqrt(g(k) * g(k) + g(3 + k) * g(3 + k) + g(6 + k) * g(6 + k)) for k in range(3)), F.lit(0.0)) / 3
    return F.when(finite(s) & (s > 1e-12), s).otherwise(1.0)


def transform_point(linear: Column, shift: Column, p: Column) -> Column:
    """linear p + shift; three NaN where a coordinate is not finite."""
    ok = finite(*(F.get(p, F.lit(i)) for i in range(3)))
    return F.when(ok, F.zip_with(rotate(linear, p), shift, lambda a, b: a + b)).otherwise(F.array(*[F.lit(float("nan"))] * 3))


def relative(rot_a: Column, centre_a: Column, rot_b: Column, centre_b: Column) -> tuple[Column, Column]:
    """(rotation, translation) of the pose b as seen from a."""
    back = transpose(rot_a)
    return compose(back, rot_b), rotate(back, minus(centre_b, centre_a))


def rotation_log(r: Column) -> Column:
    """Rotation vector. For half turns, the axis is the longest column of (r + 1) / 2, of either sign."""
    g = lambda i: F.get(r, F.lit(i))
    skew = F.array(g(7) - g(5), g(2) - g(6), g(3) - g(1))
    columns = [F.array(*((g(3 * i + k) + (1 if i == k else 0)) / 2 for i in range(3))) for k in range(3)]
    most = F.greatest(g(0), g(4), g(8))
    axis = F.when(g(0) >= most, columns[0]).when(g(4) >= most, columns[1]).otherwise(columns[2])

    def of(angle: Column) -> Column:
        factor = F.when(angle < 1e-8, 0.5).otherwise(0.5 * angle / F.sin(angle))
        half_turn = let(axis, lambda v: let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: angle * x / n)))
        return F.when((angle < 1e-8) | (F.abs(F.sin(angle)) > 1e-6), let(factor, lambda f: F.transform(skew, lambda x: x * f))).otherwise(half_turn)

    return let(F.acos(clipped((trace(r) - 1) / 2)), of)


def turn_deg(r: Column) -> Column:
    """Angle of a rotation, exact also where it is very small."""
    g = lambda i: F.get(r, F.lit(i))
    return F.degrees(F.atan2(norm(F.array(g(7) - g(5), g(2) - g(6), g(3) - g(1))) / 2, (trace(r) - 1) / 2))


def near_identity(rotation_deg: Column, shift: Column) -> Column:
    return F.coalesce((norm(shift) <= 1e-8) & (rotation_deg <= 1e-6), F.lit(False))


def unproject(row: Column, col: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Camera coordinates of a pixel at a depth."""
    return F.array((col - cx) / fx * depth, (row - cy) / fy * depth, depth)


def view_plane(i: Column, n: Column, span: Column) -> Column:
    """Coordinate of pixel ``i`` of ``n`` on an axis of the normalised view plane of half-width ``span``."""
    edge = span * (n - 1) / n
    return F.when(n > 1, -edge + 2 * edge * i / (n - 1)).otherwise(-edge)


def field_of_view(height: Column, fy: Column) -> Column:
    f = F.when(F.coalesce(fy, F.lit(0.0)) > 1e-6, fy).otherwise(1.1 * height)
    return 2 * F.atan2(height / 2, f)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)
