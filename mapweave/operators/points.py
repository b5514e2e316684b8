"""Operators on points: filters, grid-stratified selection, voxels, robust residuals, spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.vectors import finite


def usable(points: DataFrame, least: float = 0.5) -> DataFrame:
    """Finite points of at least this confidence."""
    return points.where(finite(*(F.col(c) for c in ("x", "y", "z", "conf"))) & (F.col("conf") >= least))


def grid_top_k(points: DataFrame, k: int = 12, cell: int = 32, cap: int | None = None) -> DataFrame:
    """The ``k`` most confident points of each image cell, then at most ``cap`` a frame; ties by point number."""
    w = W.partitionBy("frame_no", "cell_row", "cell_col").orderBy(F.desc("conf"), "pt")
    d = points.withColumn("cell_row", F.floor(F.col("px_row") / cell)).withColumn("cell_col", F.floor(F.col("px_col") / cell))
    d = d.withColumn("rank_in_cell", F.row_number().over(w)).where(F.col("rank_in_cell") <= k)
    if cap is not None:
        d = d.withColumn("rank_in_frame", F.row_number().over(W.partitionBy("frame_no").orderBy(F.desc("conf"), "pt"))).where(F.col("rank_in_frame") <= cap)
    return d


def voxel(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def voxel_first(points: DataFrame, size: float, order: tuple[str, ...] = ("frame_no", "pt")) -> DataFrame:
    """The first point, in ``order``, of each voxel: a minimum with map-side combining, no sort of all points."""
    first = F.min(F.struct(*order, *(c for c in points.columns if c not in order))).alias("p")
    d = points.groupBy(voxel("x", size).alias("kx"), voxel("y", size).alias("ky"), voxel("z", size).alias("kz")).agg(first)
    return d.select("kx", "ky", "kz", "p.*")


def voxel_bounds(points: DataFrame, size: float) -> DataFrame:
    """Key range of each axis, raw count, and the bits a packed key would need."""
    axes = ("x", "y", "z")
    d = points.agg(F.count("*").alias("n"), *(f(voxel(a, size)).alias(f"{name}_{a}") for a in axes for name, f in (("min", F.min), ("max", F.max))))
    bits = sum((F.ceil(F.log2((F.col(f"max_{a}") - F.col(f"min_{a}") + 1).cast("double"))) for a in axes), F.lit(0))
    return d.withColumn("bits", bits.cast("long"))


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def inliers(d: DataFrame, by: str, value: str, factor: float = 2.5, least: float = 1e-4) -> DataFrame:
    """``d`` with the group's median, its limit median + factor * max(1.4826 MAD, least), and whether the value is within."""
    m = d.groupBy(by).agg(median(F.col(value)).alias("median"))
    d = d.join(m, by)
    mad = d.groupBy(by).agg(median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    d = d.join(mad, by).withColumn("limit", F.col("median") + factor * F.greatest(1.4826 * F.col("mad"), F.lit(least)))
    return d.withColumn("inlier", F.col(value) <= F.col("limit"))


def robust_z(d: DataFrame, by: str, value: str) -> DataFrame:
    """0.6745 (x - median) / MAD, zero where the MAD vanishes."""
    d = inliers(d, by, value)
    return d.withColumn("robust_z", F.when(F.col("mad") < 1e-8, 0.0).otherwise(0.6745 * (F.col(value) - F.col("median")) / F.col("mad")))


def positive_outlier(d: DataFrame, by: str, value: str) -> DataFrame:
    """Positive part of the robust z; not finite: infinite; all about zero: the distance from the median in population
    deviations; fewer than two finite values: zero."""
    ok = finite(F.col(value))
    z = robust_z(d.where(ok), by, value)
    s = z.groupBy(by).agg(F.stddev_pop(value).alias("sd"), F.max(F.abs("robust_z")).alias("most"), F.count("*").alias("n"))
    z = z.join(s, by)
    plain = F.when(F.col("sd") > 1e-8, (F.col(value) - F.col("median")) / F.col("sd")).otherwise(F.col("robust_z"))
    score = F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.when(F.col("most") < 1e-8, plain).otherwise(F.col("robust_z"))))
    z = z.select(*d.columns, score.alias("outlier"))
    return z.unionByName(d.where(~ok).withColumn("outlier", F.lit(float("inf"))))


def packed_keys(points: DataFrame, size: float) -> DataFrame:
    """``points`` with key: the voxel's place within the bounds of all, packed into 64 bits; an error if they do not suffice."""
    d = voxel_bounds(points, size)
    need = lambda a: F.length(F.regexp_replace(F.bin(F.col(f"max_{a}") - F.col(f"min_{a}")), "^0(?=.)", "")).cast("int")
    d = d.select(*(F.col(f"min_{a}").alias(f"_{a}") for a in "xyz"), need("x").alias("_bx"), need("y").alias("_by"), need("z").alias("_bz"))
    total = F.col("_bx") + F.col("_by") + F.col("_bz")
    d = d.withColumn("_ok", F.when(total > 64, F.raise_error(F.concat(F.lit("voxel keys need bits: "), total.cast("string"))).cast("boolean")).otherwise(True))
    at = lambda a: voxel(a, size) - F.col(f"_{a}")
    key = F.expr("1L") * 0
    for a, shift in (("x", "_by + _bz"), ("y", "_bz"), ("z", "0")):
        key = key.bitwiseOR(F.call_function("shiftleft", at(a), F.expr(shift)))
    return points.join(F.broadcast(d)).where("_ok").withColumn("key", key).drop("_x", "_y", "_z", "_bx", "_by", "_bz", "_ok")


def finite_count(points: DataFrame) -> DataFrame:
    return points.where(finite(*(F.col(c) for c in "xyz"))).agg(F.count("*").alias("n"))


def even_sample(points: DataFrame, most: int, order: tuple[str, ...] = ("frame_no", "pt"), block: str = "frame_no") -> DataFrame:
    """At most ``most`` points, evenly over their order: those at the places floor(i (n - 1) / (most - 1)). Places are counted
    in blocks with the counts of earlier blocks, so no task orders all points."""
    sizes = points.groupBy(F.col(block).alias("_b")).agg(F.count("*").alias("_c"))
    w = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    sizes = sizes.select("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(F.lit(0))).alias("_n"))
    d = points.join(sizes, points[block] == sizes["_b"]).withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy(block).orderBy(*order)) - 1)
    first = F.expr(f"(_at * {most - 1} + _n - 2) div (_n - 1)")  # the first sample at or after this place
    taken = (F.col("_n") <= most) | (F.expr(f"({most - 1} > 0)") & (F.floor(first * (F.col("_n") - 1) / (most - 1)) == F.col("_at")))
    return d.where(taken).select(*points.columns)


def spacing(points: DataFrame) -> DataFrame:
    """Positive distances of points at adjacent pixels of a frame (right and below): frame_no, distance."""
    found = []
    for along, across in (("px_col", "px_row"), ("px_row", "px_col")):
        w = W.partitionBy("frame_no", across).orderBy(along)
        step = lambda c, w=w: F.lead(c).over(w)
        dist = F.sqrt(sum(((step(c) - F.col(c)) ** 2 for c in ("x", "y", "z")), F.lit(0.0)))
        found.append(points.select("frame_no", F.when(step(along) == F.col(along) + 1, dist).alias("distance")))
    return found[0].union(found[1]).where(finite(F.col("distance")) & (F.col("distance") > 0))


def scene_extent(points: DataFrame) -> DataFrame:
    """One row: the centre of the finite points and their extent on each axis; nulls without any."""
    d = points.where(finite(*(F.col(c) for c in "xyz")))
    return d.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(f"centre_{c}") for c in "xyz"), *(F.round(F.max(c) - F.min(c), 6).alias(f"extent_{c}") for c in "xyz"))
