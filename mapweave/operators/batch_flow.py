"""What becomes of batches: five statuses, with two retries that leave bad references out and fit anew.

All batches are decided together, each step a job over those that are still open: frames that are new, enough neighbours,
the robust fit, the validation of the references' poses under it. Batches that fail are fitted once for each of their
references, which are scored against each other; a plan drops the worst and the batch is fitted and validated on the kept
ones. Those that still fail get a second plan, by similarity of their references to the new frames, and whatever ``reinfer``
makes of the kept ones. The decisions depend on the tables alone, so a run that is repeated decides the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.vectors import angle_deg, compose, minus, norm, rotate, trace, transpose
from mapweave.operators.alignment import robust_fit
from mapweave.operators.validation import consistency, geometry_plan, similarity_plan, validate
from mapweave.sources.tables import Tables

STATUSES = ("added", "skipped_existing", "skipped_not_enough_neighbors", "skipped_alignment_failed", "skipped_failed_validation")
LIMITS = {"shift": 1.0, "median_deg": 5.0, "max_deg": 15.0, "scale_min": 0.2, "scale_max": 5.0}


def under_fit(poses: DataFrame, fits: DataFrame) -> DataFrame:
    """Reference poses (batch, ref, p_centre, p_rot, centre, rot) with the predicted ones taken through the batch's fit."""
    d = poses.join(fits.select("batch", "scale", "rotation", "translation"), "batch")
    moved = F.zip_with(rotate(F.col("rotation"), F.col("p_centre")), "translation", lambda a, b: F.col("scale") * a + b)
    return d.select("batch", "ref", moved.alias("p_centre"), compose(F.col("rotation"), F.col("p_rot")).alias("p_rot"), "centre", "rot", F.col("scale").alias("estimated_scale"))


def attempt(tables: Tables, points: DataFrame, poses: DataFrame, least: int, limits: dict, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(fits, checked) of batches with at least ``least`` correspondences: the robust fit, and the validation under it."""
    enough = points.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("batch")
    fits = tables.write(robust_fit(points.join(enough, "batch", "left_semi"), rounds), "attempt")
    return fits, validate(under_fit(poses, fits), **limits)


def reference_scores(tables: Tables, points: DataFrame, poses: DataFrame, least: int, rounds: int = 20) -> DataFrame:
    """A table of the METRICS of each reference (batch, ref, ok), from a fit to its own correspondences; infinite where that fails."""
    key = F.struct("batch", "ref")
    own = points.withColumn("batch", F.to_json(key))
    few = own.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("batch")
    fits = robust_fit(own.join(few, "batch", "left_semi"), rounds)
    d = poses.withColumn("own", F.to_json(key)).join(fits.withColumnRenamed("batch", "own"), "own", "left")
    moved = F.zip_with(rotate(F.col("rotation"), F.col("p_centre")), "translation", lambda a, b: F.col("scale") * a + b)
    worst = lambda c, name: F.coalesce(c, F.lit(float("inf"))).alias(name)
    turn = compose(compose(F.col("rotation"), F.col("p_rot")), transpose(F.col("rot")))
    d = d.select(
        "batch", "ref", "scale", F.col("rotation").alias("fit_rot"), F.col("translation").alias("shift"), worst(F.col("median_residual"), "point_residual"),
        worst(norm(minus(moved, F.col("centre"))), "pose_translation"), worst(angle_deg(trace(turn)), "pose_rotation"),
    )
    d = tables.write(d.withColumnRenamed("fit_rot", "rot"), "alone")
    scores = consistency(d.select("batch", "ref", "scale", "rot", "shift")).join(d.select("batch", "ref", "point_residual", "pose_translation", "pose_rotation"), ["batch", "ref"])
    return tables.write(scores, "scores")  # the plan reads it many times


def decide(
    requested: DataFrame, known: DataFrame, points: DataFrame, poses: DataFrame, similarity: DataFrame,
    reinfer: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, least_refs: int = 3, least_points: int = 3, limits: dict | None = None, rounds: int = 20, **plan,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, fits) of batches. ``requested``: (batch, frame_id); ``known``: frames of the map (frame_id); ``poses``: the
    references of each batch (batch, ref, p_centre, p_rot, centre, rot); ``points``: correspondences (batch, ref, sx to tz, w);
    ``similarity``: (batch, ref, similarity). ``reinfer`` takes (batch, ref) that a second plan keeps and returns new points
    and poses for them. decisions: batch, status, fresh (number of new frames), reason, stage (none, geometry or similarity)
    and dropped references. fits: of the batches that are added."""
    tables, limits = Tables(requested.sparkSession), limits or LIMITS
    kept_of = lambda p: p.where("not dropped").select("batch", "ref")
    here = lambda d, keys, on="batch": d.join(keys, on, "left_semi")

    fresh = requested.join(known.select("frame_id").distinct(), "frame_id", "left_anti").groupBy("batch").agg(F.count("*").alias("fresh"))
    d = requested.select("batch").distinct().join(fresh, "batch", "left").join(poses.groupBy("batch").agg(F.count("*").alias("refs")), "batch", "left")
    d = tables.write(d.select("batch", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.coalesce("refs", F.lit(0)).alias("refs")), "begun")
    open_ = d.where((F.col("fresh") > 0) & (F.col("refs") >= least_refs)).select("batch")
    p, q = tables.write(here(points, open_), "points"), tables.write(here(poses, open_), "poses")
    fits, checked = attempt(tables, p, q, least_points, limits, rounds)
    checked = tables.write(checked.select("batch", "accepted", "reason"), "checked")
    good = [tables.write(fits.join(checked.where("accepted").select("batch"), "batch", "left_semi"), "fits")]
    stages = [checked.where("accepted").select("batch", F.lit("none").alias("stage"), F.array().cast("array<long>").alias("dropped"))]

    failed = checked.where("not accepted").select("batch")
    for stage in ("geometry", "similarity"):
        if failed.isEmpty() or (stage == "similarity" and reinfer is None):
            break
        if stage == "geometry":
            plans = geometry_plan(reference_scores(tables, here(p, failed), here(q, failed), least_points, rounds), min_refs=least_refs, **plan)
        else:
            plans = similarity_plan(here(similarity, failed), min_refs=least_refs, **plan)
        plans = tables.write(plans.select("batch", "ref", "dropped"), f"plans-{stage}")
        some = plans.where("dropped").select("batch").distinct()
        kept = kept_of(here(plans, some))
        new_p, new_q = (here(p, kept, ["batch", "ref"]), here(q, kept, ["batch", "ref"])) if stage == "geometry" else reinfer(kept)
        fits, again = attempt(tables, new_p, new_q, least_points, limits, rounds)
        again = tables.write(again.where("accepted").select("batch"), f"again-{stage}")
        good.append(tables.write(fits.join(again, "batch", "left_semi"), f"fits-{stage}"))
        gone = here(plans.where("dropped"), again).groupBy("batch").agg(F.array_sort(F.collect_list(F.col("ref").cast("long"))).alias("dropped"))
        stages.append(again.join(gone, "batch").select("batch", F.lit(stage).alias("stage"), "dropped"))
        failed = tables.write(failed.join(again, "batch", "left_anti"), f"failed-{stage}")

    done, accepted = stages[0], good[0]
    for s, g in zip(stages[1:], good[1:], strict=True):
        done, accepted = done.unionByName(s), accepted.unionByName(g)
    d = d.join(checked, "batch", "left").join(done, "batch", "left")
    status = (
        F.when(F.col("fresh") == 0, STATUSES[1]).when(F.col("refs") < least_refs, STATUSES[2]).when(F.col("accepted").isNull(), STATUSES[3])
        .when(F.col("stage").isNotNull(), STATUSES[0]).otherwise(STATUSES[4])
    )
    return d.select("batch", status.alias("status"), "fresh", "reason", "stage", "dropped"), accepted
