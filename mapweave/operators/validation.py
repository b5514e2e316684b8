"""Validation of aligned batches, and which references to leave out when a batch fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.vectors import angle_deg, compose, finite, minus, norm, trace, transpose
from mapweave.operators.points import median, positive_outlier

METRICS = ("translation_dispersion", "rotation_dispersion", "scale_dispersion", "point_residual", "pose_translation", "pose_rotation")


def validate(refs: DataFrame, shift: float, median_deg: float, max_deg: float, scale_min: float, scale_max: float) -> DataFrame:
    """One row a batch of reference poses (batch, p_centre, p_rot, centre, rot, estimated_scale): residuals of predicted
    against stored poses and five checks in order. reason is the first that fails, or "ok". A batch without a reference
    (a row with null poses) is not accepted."""
    d = refs.select(
        "batch", "estimated_scale", norm(minus(F.col("p_centre"), F.col("centre"))).alias("t"), angle_deg(trace(compose(F.col("p_rot"), transpose(F.col("rot"))))).alias("r")
    )
    s = F.first("estimated_scale", ignorenulls=True)
    d = d.groupBy("batch").agg(
        F.count("t").alias("n"), median(F.col("t")).alias("median_translation"), F.max("t").alias("max_translation"), F.avg("t").alias("mean_translation"),
        median(F.col("r")).alias("median_rotation_deg"), F.max("r").alias("max_rotation_deg"), F.avg("r").alias("mean_rotation_deg"), s.alias("estimated_scale"),
    )
    over = lambda c, limit: F.when(~finite(F.col(c)) | (F.col(c) > limit), F.lit(c))
    scale = F.when((F.col("estimated_scale") < scale_min) | (F.col("estimated_scale") > scale_max), F.lit("estimated_scale"))
    checks = F.array_compact(F.array(over("median_translation", shift), over("max_translation", shift), over("median_rotation_deg", median_deg), over("max_rotation_deg", max_deg), scale))
    d = d.withColumn("failed_checks", F.when(F.col("n") == 0, F.array(F.lit("no_reference_frames"))).otherwise(checks))
    return d.withColumn("accepted", F.size("failed_checks") == 0).withColumn("reason", F.coalesce(F.get("failed_checks", F.lit(0)), F.lit("ok")))


def consistency(transforms: DataFrame) -> DataFrame:
    """Median difference of each reference's own transform (batch, ref, scale, rot, shift; null where it failed) to those of
    the others of its batch, by translation, rotation and log scale: infinite where it failed, 0 without others. A batch
    has a bounded number of references, so its pairs are too."""
    ok = F.col("scale").isNotNull()
    cols = ("ref", "scale", "rot", "shift")
    a, b = (transforms.where(ok).select("batch", *(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in "ab")
    p = a.join(b, "batch").where("a_ref <> b_ref")
    floor = lambda c: F.greatest(F.col(c), F.lit(1e-12))
    p = p.groupBy("batch", F.col("a_ref").alias("ref")).agg(
        median(norm(minus(F.col("a_shift"), F.col("b_shift")))).alias("t"), median(angle_deg(trace(compose(F.col("a_rot"), transpose(F.col("b_rot")))))).alias("r"),
        median(F.abs(F.log(floor("a_scale") / floor("b_scale")))).alias("s"),
    )
    d = transforms.select("batch", "ref", ok.alias("ok")).join(p, ["batch", "ref"], "left")
    value = lambda c: F.when(~F.col("ok"), float("inf")).otherwise(F.coalesce(c, F.lit(0.0)))
    return d.select("batch", "ref", "ok", *(value(c).alias(name) for c, name in zip("trs", METRICS, strict=False)))


def outlier_scores(scores: DataFrame) -> DataFrame:
    """(batch, ref, ok, outlier): the sum over METRICS of each reference's positive outlier score in its batch."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))).alias("p")
    d = scores.select("batch", "ref", "ok", pairs).select("batch", "ref", "ok", F.concat_ws("|", "batch", "p.metric").alias("of"), F.col("p.value").alias("value"))
    return positive_outlier(d, "of", "value").groupBy("batch", "ref", "ok").agg(F.sum("outlier").alias("outlier"))


def drop_plan(scores: DataFrame, candidate: Column, badness: Column, failed: Column, max_drop: int = 2, min_refs: int = 3, worst_first: bool = False) -> DataFrame:
    """References (batch, ref, ...) with dropped and mode: failed ones first, then candidates, in order of ref or, with
    ``worst_first``, of falling badness, up to ``max_drop`` and so that ``min_refs`` stay; without any, the worst one, a badness
    that is not finite before all others. Ties: smaller ref."""
    by = W.partitionBy("batch")
    d = scores.withColumn("_failed", failed).withColumn("_some", failed | F.coalesce(candidate, F.lit(False)))
    d = d.withColumn("_most", F.greatest(F.lit(0), F.least(F.lit(max_drop), F.count("*").over(by) - min_refs)))
    fall = (F.asc(F.when(~finite(badness), 0).otherwise(1)), F.desc(badness), "ref")
    first = F.row_number().over(by.orderBy(F.desc("_failed"), F.desc("_some"), *(fall if worst_first else ["ref"])))
    worst = F.row_number().over(by.orderBy(F.desc("_failed"), *fall))
    some = F.max("_some").over(by)
    d = d.withColumn("dropped", F.when(some, F.col("_some") & (first <= F.col("_most"))).otherwise((worst == 1) & (F.col("_most") > 0)))
    mode = F.when(F.col("_most") == 0, "not_enough_refs_to_drop").when(some, "threshold").otherwise("worst_ref_fallback")
    return d.withColumn("mode", mode).drop("_failed", "_some", "_most")


def geometry_plan(scores: DataFrame, threshold: float = 2.0, **kw) -> DataFrame:
    """The drop plan of the first retry, by geometric outlier scores."""
    d = outlier_scores(scores)
    return drop_plan(d, F.col("ok") & finite(F.col("outlier")) & (F.col("outlier") >= threshold), F.col("outlier"), ~F.col("ok"), **kw)


def similarity_plan(refs: DataFrame, threshold: float = 2.0, least: float = 0.0, **kw) -> DataFrame:
    """The drop plan of the second retry, by similarity of each reference to the batch's mean feature (batch, ref,
    similarity): candidates are far (robust z of the distance) or not alike at all."""
    from mapweave.operators.points import robust_z

    d = robust_z(refs.withColumn("distance", 1 - F.col("similarity")), "batch", "distance").select("batch", "ref", "similarity", "distance", "robust_z")
    return drop_plan(d, (F.col("robust_z") >= threshold) | (F.col("similarity") <= least), F.col("distance"), F.lit(False), worst_first=True, **kw)
