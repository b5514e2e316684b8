"""Trajectory evaluation: matching by name, alignment, absolute and relative errors, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.vectors import angle_deg, base_name, compose, direction_angle_deg, minus, norm, rotate, stem, trace, transpose
from mapweave.operators.medians import exact_median


def match(true: DataFrame, pred: DataFrame, by: str = "auto") -> DataFrame:
    """True poses with the prediction of the same base name, else of the same stem; frame ids of predictions (column frame_id,
    if there is one) count as stems. ``by`` name or stem looks at one of them alone. A name or stem that several predictions
    have is an error where it is used. No match: pred_index is null."""
    if by not in ("auto", "name", "stem"):
        raise ValueError(f"unknown way to match: {by}")
    keys = {"base": pred.select(base_name(F.col("image_path")).alias("base"), "pred_index")}
    stems = pred.select(stem(F.col("image_path")).alias("stem"), "pred_index")
    if "frame_id" in pred.columns:
        stems = stems.union(pred.select("frame_id", "pred_index")).distinct()
    keys["stem"] = stems
    t = true.withColumn("base", base_name(F.col("image_name"))).withColumn("stem", stem(F.col("image_name")))
    for name, found in keys.items():
        found = found.where(F.col(name) != "").groupBy(name).agg(F.min("pred_index").alias(f"{name}_at"), F.count("*").alias(f"{name}_n"))
        t = t.join(found, name, "left")
    used = {"auto": ("base", "stem"), "name": ("base",), "stem": ("stem",)}[by]
    n, at = (F.coalesce(*(F.col(f"{name}_{c}") for name in used)) for c in ("n", "at"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("ambiguous name "), F.col("image_name"))).cast("long")).otherwise(at)
    t = t.select("gt_index", "image_name", "centre", "rot", checked.alias("pred_index"))
    p = pred.select(F.col("pred_index").alias("p"), F.col("centre").alias("p_centre"), F.col("rot").alias("p_rot"), "valid")
    return t.join(p, t["pred_index"] == p["p"], "left").drop("p")


def align(matched: DataFrame) -> DataFrame:
    """One row: the similarity that takes predicted to true centres, from moments summed by Spark and one 3 x 3 SVD."""
    c = lambda side, i: F.get(side, F.lit(i))
    d = matched.where("valid")
    sums = [F.count("*").alias("n"), *(F.sum(c(s, i)).alias(f"{s}_{i}") for s in ("centre", "p_centre") for i in range(3))]
    sums += [F.sum(c("p_centre", i) ** 2).alias(f"q_{i}") for i in range(3)] + [F.sum(c("centre", i) * c("p_centre", k)).alias(f"c_{i}{k}") for i in range(3) for k in range(3)]

    def solve(batches):
        for g in batches:
            for _, r in g.iterrows():
                n = max(r.n, 1)
                mt, ms = np.array([r[f"centre_{i}"] for i in range(3)]) / n, np.array([r[f"p_centre_{i}"] for i in range(3)]) / n
                if r.n < 3:
                    raise ValueError("an alignment needs three matches")
                cov = np.array([[r[f"c_{i}{k}"] for k in range(3)] for i in range(3)]) / n - np.outer(mt, ms)
                u, s, vt = np.linalg.svd(cov)
                sign = np.array([1, 1, np.sign(np.linalg.det(u @ vt)) or 1])
                rot = u @ np.diag(sign) @ vt
                scale = float((s * sign).sum() / max(sum(r[f"q_{i}"] for i in range(3)) / n - ms @ ms, 1e-24))
                yield pd.DataFrame([(scale, rot.ravel(), mt - scale * rot @ ms)], columns=["scale", "rotation", "translation"])

    return d.agg(*sums).mapInPandas(solve, "scale double, rotation array<double>, translation array<double>")


def absolute_errors(matched: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """gt_index, image_name, translation_error, rotation_error_deg of valid matches, after ``fit`` if given (one row)."""
    d = matched.where("valid")
    if fit is not None:
        d = d.join(F.broadcast(fit))
        moved = F.zip_with(rotate(F.col("rotation"), F.col("p_centre")), "translation", lambda a, b: F.col("scale") * a + b)
        d = d.withColumn("p_centre", moved).withColumn("p_rot", compose(F.col("rotation"), F.col("p_rot")))
    d = d.select("gt_index", "image_name", minus(F.col("p_centre"), F.col("centre")).alias("off"), compose(transpose(F.col("rot")), F.col("p_rot")).alias("turn"))
    return d.select("gt_index", "image_name", norm(F.col("off")).alias("translation_error"), angle_deg(trace(F.col("turn"))).alias("rotation_error_deg"))


def relative_errors(matched: DataFrame, delta: int = 1, pairs: DataFrame | None = None) -> DataFrame:
    """Errors of motions over ``delta`` indices, or of the given ``pairs`` of indices (src_pos, dst_pos); ``reason`` is set where
    a side has no valid prediction."""
    cols = ("gt_index", "image_name", "centre", "rot", "p_centre", "p_rot", "valid")
    a, b = (matched.select(*(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in ("a", "b"))
    if pairs is None:
        d = a.join(b, F.col("b_gt_index") == F.col("a_gt_index") + delta)
    else:
        d = pairs.join(a, F.col("src_pos") == F.col("a_gt_index")).join(b, F.col("dst_pos") == F.col("b_gt_index"))
    ok = F.coalesce(F.col("a_valid") & F.col("b_valid"), F.lit(False))
    # Step by step: an array expression that is named several times in another would be computed as often.
    back = lambda p: transpose(F.col(f"a_{p}rot")).alias(f"{p}back")
    go = lambda p: minus(F.col(f"b_{p}centre"), F.col(f"a_{p}centre")).alias(f"{p}go")
    d = d.select("a_gt_index", "b_gt_index", ok.alias("ok"), "b_rot", "b_p_rot", back(""), back("p_"), go(""), go("p_"))
    d = d.select(
        "a_gt_index", "b_gt_index", "ok", rotate(F.col("back"), F.col("go")).alias("move"), rotate(F.col("p_back"), F.col("p_go")).alias("p_move"),
        compose(F.col("back"), F.col("b_rot")).alias("turn"), compose(F.col("p_back"), F.col("b_p_rot")).alias("p_turn"),
    )
    d = d.withColumn("off", minus(F.col("p_move"), F.col("move"))).withColumn("diff", compose(transpose(F.col("turn")), F.col("p_turn")))
    when_ok = lambda c, name: F.when(F.col("ok"), c).alias(name)
    return d.select(
        F.col("a_gt_index").alias("src_index"), F.col("b_gt_index").alias("dst_index"), F.when(~F.col("ok"), F.lit("no_valid_prediction")).alias("reason"),
        when_ok(norm(F.col("move")), "gt_baseline"), when_ok(norm(F.col("p_move")), "pred_baseline"),
        when_ok(direction_angle_deg(F.col("move"), F.col("p_move")), "translation_angle_error_deg"), when_ok(norm(F.col("off")), "translation_norm_error"),
        when_ok(angle_deg(trace(F.col("diff"))), "rotation_error_deg"),
    )


def summary(d: DataFrame, value: str) -> DataFrame:
    """Count, root mean square, mean, median and maximum of a column, in one row."""
    c, r6 = F.col(value), lambda x, name: F.round(x, 6).alias(name)
    one = d.agg(F.count(c).alias("n"), r6(F.sqrt(F.avg(c * c)), "rmse"), r6(F.avg(c), "mean"), r6(F.max(c), "max"))
    return one.join(F.broadcast(exact_median(d, value).select(r6(F.col("median"), "median")))).select("n", "rmse", "mean", "median", "max")  # one row beside one


def accuracy(d: DataFrame, value: str, limits: list[float]) -> DataFrame:
    """The share of values within each limit; one pass."""
    one = d.agg(*(F.round(F.avg((F.col(value) <= x).cast("double")), 6).alias(f"a{i}") for i, x in enumerate(limits)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(x)).alias("threshold"), F.col(f"a{i}").alias("accuracy")) for i, x in enumerate(limits)))).alias("r")).select("r.*")


def coverage(matched: DataFrame) -> DataFrame:
    n, found, ok = F.count("*"), F.count("pred_index"), F.count_if("valid")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return matched.agg(n.alias("n_gt"), found.alias("n_matched"), ok.alias("n_valid"), ratio(found, n).alias("matched_ratio"), ratio(ok, n).alias("valid_ratio"))


def subset(true: DataFrame, frames: DataFrame) -> DataFrame:
    """True poses whose base name or stem is that of a valid frame (frame_id, image_path, valid); frame ids count as stems."""
    f = frames.where("valid")
    names = f.select(base_name(F.col("image_path")).alias("name")).distinct()
    stems = f.select(stem(F.col("image_path")).alias("name")).union(f.select("frame_id")).distinct()
    t = true.withColumn("_base", base_name(F.col("image_name"))).withColumn("_stem", stem(F.col("image_name")))
    t = t.join(names.select(F.col("name").alias("_base"), F.lit(True).alias("_named")), "_base", "left").join(stems.select(F.col("name").alias("_stem"), F.lit(True).alias("_stemmed")), "_stem", "left")
    return t.where(F.coalesce("_named", F.lit(False)) | F.coalesce("_stemmed", F.lit(False))).select(*true.columns)


def sampled_pairs(spark, items: int, most: int, seed: int = 0) -> DataFrame:
    """(src_pos, dst_pos) of at most ``most`` different pairs of ``items`` positions. Pairs are numbered row by row; the sample
    is the first ``most`` different numbers of a sequence of hashes of the seed, so it costs what it returns, not all pairs."""
    total = items * (items - 1) // 2
    if most <= 0 or most >= total:
        drawn = spark.range(total).select(F.col("id").alias("k"))
    else:
        tries = spark.range(4 * most + 64)
        h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
        drawn = tries.select("id", F.pmod(h, F.lit(total)).alias("k")).groupBy("k").agg(F.min("id").alias("id")).orderBy("id").limit(most)
    n = 2 * items - 1
    row = F.floor((n - F.sqrt(F.lit(float(n * n)) - 8 * F.col("k"))) * 0.5).cast("long")
    start = lambda r: F.floor(r * (2 * items - r - 1) / 2).cast("long")
    d = drawn.select("k", row.alias("r"))  # the root may be off by one where numbers are large
    d = d.select("k", F.when(F.col("k") < start(F.col("r")), F.col("r") - 1).when(F.col("k") >= start(F.col("r") + 1), F.col("r") + 1).otherwise(F.col("r")).alias("src_pos"))
    return d.select("src_pos", (F.col("src_pos") + 1 + F.col("k") - start(F.col("src_pos"))).alias("dst_pos"))
