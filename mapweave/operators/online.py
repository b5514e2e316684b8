"""The map while it grows: continuity gate, optimisation triggers, merging of results, pose export."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from mapweave.functions.transforms import near_identity, turn_deg
from mapweave.functions.vectors import angle_deg, compose, finite, minus, norm, rotate, trace, transpose
from mapweave.operators.medians import exact_median
from mapweave.operators.reporting import cumulative
from mapweave.sources.tables import Tables


def steps(frames: DataFrame, block: int = 4096) -> DataFrame:
    """Each frame (order_index, centre, rot, and other columns) beside the one before it (prev_*). Frames are in blocks of
    their order; only the last frame of each block meets the next block, so no task sees the whole stream."""
    cols = frames.columns
    d = frames.withColumn("block", F.floor(F.col("order_index") / block))
    w = W.partitionBy("block").orderBy("order_index")
    d = d.withColumn("prev", F.lag(F.struct(*cols)).over(w))
    last = d.groupBy("block").agg(F.max_by(F.struct(*cols), "order_index").alias("last"))
    ids = last.select("block", F.lag("block").over(W.orderBy("block")).alias("before"))  # one number a block
    last = ids.join(last.select(F.col("block").alias("before"), "last"), "before").select("block", "last")
    d = d.join(last, "block", "left").withColumn("prev", F.coalesce("prev", "last")).where("prev is not null")
    return d.select(*cols, *(F.col(f"prev.{c}").alias(f"prev_{c}") for c in cols))


def _gate(multiplier: float, trail: int):
    """``accepted_steps`` of one chunk of a stream, from the steps accepted last before it, with those after it in _seen of its
    last row."""

    def of(d: pa.Table, before: pa.Table) -> pa.Table:
        d = d.sort_by("order_index")
        seen = deque(before.column("_seen").to_pylist()[0] if before.num_rows else [], trail)
        known = sorted(x for x in seen if x is not None)
        accepted = []
        for able, x in zip(d.column("able").to_pylist(), d.column("step").to_pylist(), strict=True):
            x = math.inf if x is not None and math.isnan(x) else x  # as Spark orders it
            usual = (known[(len(known) - 1) // 2] * 0.5 + known[len(known) // 2] * 0.5) if known else None
            ok = bool(able) and (usual is None or (x is not None and x <= max(1e-6, usual * multiplier)))
            accepted.append(ok)
            if ok:
                if len(seen) == trail and (old := seen[0]) is not None:
                    del known[bisect_left(known, old)]
                seen.append(x)
                if x is not None:
                    insort(known, x)
        ends = pa.array([None] * (d.num_rows - 1) + [list(seen)], pa.list_(pa.float64()))
        return d.append_column("accepted", pa.array(accepted, pa.bool_())).append_column("_seen", ends)

    return of


def accepted_steps(d: DataFrame, multiplier: float = 4.0, trail: int = 200, chunk: int = 65_536, block: int = 4096) -> DataFrame:
    """``d`` (stream, order_index, able, step) with accepted: able, and at most ``multiplier`` times the median of the last
    ``trail`` accepted steps of the stream before it (any step while there is none).

    The gate feeds on itself, so a stream's frames follow one another: all streams take one chunk of about ``chunk`` frames at
    a time, each from the ``trail`` steps that its chunk before left, and no task holds a stream. Each chunk is a written table."""
    tables = Tables(d.sparkSession)
    d = d.withColumn("_b", F.floor(F.col("order_index") / block))
    sizes = d.groupBy("stream", "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy("stream").orderBy("_b")  # one row a block
    sizes = sizes.select("stream", "_b", F.floor((F.sum("_n").over(w) - F.col("_n")) / chunk).alias("_chunk"))
    d = tables.write(d.join(sizes, ["stream", "_b"]).drop("_b"), "steps")
    last = d.agg(F.max("_chunk")).first()[0]
    schema = StructType([*d.schema.fields, StructField("accepted", BooleanType()), StructField("_seen", ArrayType(DoubleType()))])
    done = [d.withColumn("accepted", F.lit(False)).limit(0)]
    state = d.sparkSession.createDataFrame([], StructType([d.schema["stream"], schema["_seen"]]))
    for i in range((-1 if last is None else last) + 1):
        part = d.where(F.col("_chunk") == i).groupBy("stream").cogroup(state.groupBy("stream")).applyInArrow(_gate(multiplier, trail), schema)
        part = tables.write(part, f"gate-{i}")
        state = part.where("_seen is not null").select("stream", "_seen")
        done.append(part.drop("_seen"))
    return reduce(DataFrame.unionByName, done).drop("_chunk")


def continuity_gate(pairs: DataFrame, similarity: float = 0.65, overlap: int = 2, max_deg: float = 45.0, multiplier: float = 4.0) -> DataFrame:
    """Edges between consecutive frames (stream, order_index, similarity, shared, and both poses): alike or with shared
    neighbours, turned by at most ``max_deg``, and of no unusual step."""
    d = pairs.select(
        "stream", "order_index", F.col("prev_order_index").alias("source"), "similarity", "shared", norm(minus(F.col("centre"), F.col("prev_centre"))).alias("step"),
        angle_deg(trace(compose(transpose(F.col("prev_rot")), F.col("rot")))).alias("rotation_deg"),
    )
    seen = (F.coalesce(F.col("similarity") >= similarity, F.lit(False))) | (F.coalesce("shared", F.lit(0)) >= overlap)
    return accepted_steps(d.withColumn("able", seen & (F.col("rotation_deg") <= max_deg)), multiplier)


def trigger_events(batches: DataFrame, interval: int = 100, min_loops: int = 1, min_edges: int = 1) -> DataFrame:
    """Checks of the online optimisation over accepted batches (batch_id, batch_size, loops, edges): one each time the frames
    pass a multiple of ``interval`` (batches are smaller than that). The loop edges since the last check, also a skipped
    one, decide: scheduled, or skipped for want of new loop edges or of edges at all."""
    sums = cumulative(batches)
    running = lambda c: cumulative(batches.select("batch_id", F.col(c).alias("batch_size"))).select("batch_id", F.col("frames_so_far").alias(f"{c}_so_far"))
    d = sums.join(running("loops"), "batch_id").join(running("edges"), "batch_id").join(batches.select("batch_id", "batch_size"), "batch_id")
    step = lambda c: F.floor(c / interval)
    d = d.withColumn("check_index", step(F.col("frames_so_far"))).where(F.col("check_index") > step(F.col("frames_so_far") - F.col("batch_size")))
    before = d.select((F.col("check_index") + 1).alias("check_index"), F.col("loops_so_far").alias("loops_before"))
    d = d.join(before, "check_index", "left").withColumn("new_loops", F.col("loops_so_far") - F.coalesce("loops_before", F.lit(0)))
    reason = F.when(F.col("new_loops") < min_loops, "no_new_loop_edges").when(F.col("edges_so_far") < min_edges, "not_enough_edges")
    return d.select("check_index", "batch_id", "new_loops", F.col("edges_so_far").alias("num_edges"), reason.alias("reason"), F.when(reason.isNull(), "scheduled").otherwise("skipped").alias("event"))


def overlay(snapshot: DataFrame, previous: DataFrame) -> DataFrame:
    """A snapshot's poses (node, centre, rot), replaced by those of the previous result where it has the node: chained runs
    start from what the run before them found."""
    p = previous.select("node", F.col("centre").alias("c"), F.col("rot").alias("r"))
    return snapshot.join(p, "node", "left").select("node", F.coalesce("c", "centre").alias("centre"), F.coalesce("r", "rot").alias("rot"))


def merge(state: DataFrame, initial: DataFrame, refined: DataFrame) -> DataFrame:
    """State (node, centre, rot, and others) with opt_centre and opt_rot: the refined pose where it differs from the initial
    one by more than rounding, else the pose it had. Map poses are untouched. delta_t and delta_deg are null for nodes
    that were not optimised."""
    i, r = (d.select("node", F.col("centre").alias(f"{s}_centre"), F.col("rot").alias(f"{s}_rot")) for d, s in ((initial, "i"), (refined, "r")))
    return replaced(state.join(i.join(r, "node"), "node", "left"), state.columns)


def replaced(d: DataFrame, columns: list[str]) -> DataFrame:
    """``merge`` of a state of these columns that stands beside the initial (i_centre, i_rot) and the refined (r_) poses."""
    d = d.withColumn("turn", compose(F.col("r_rot"), transpose(F.col("i_rot"))))
    d = d.withColumn("move", minus(F.col("r_centre"), rotate(F.col("turn"), F.col("i_centre")))).withColumn("delta_deg", turn_deg(F.col("turn")))
    d = d.withColumn("delta_t", norm(F.col("move"))).withColumn("updated", F.col("r_rot").isNotNull() & ~near_identity(F.col("delta_deg"), F.col("move")))
    had = lambda c: F.col(f"opt_{c}") if f"opt_{c}" in columns else F.col(c)
    opt = [F.when(F.col("updated"), F.col(f"r_{c}")).otherwise(had(c)).alias(f"opt_{c}") for c in ("centre", "rot")]
    return d.select(*(c for c in columns if c not in ("opt_centre", "opt_rot")), *opt, "updated", "delta_t", "delta_deg")


def accept(success: Column, before: Column, after: Column) -> Column:
    """Why an optimisation result is discarded; null if it is accepted."""
    return F.when(~F.coalesce(success, F.lit(False)), "optimizer_unsuccessful").when(~finite(before, after), "non_finite_cost").when(after > before + 1e-9, "cost_increased")


def value_stats(d: DataFrame, *values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median and maximum of the finite values of each column, 0 without any."""
    f = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    aggs = [f(agg(F.when(finite(F.col(c)), F.col(c)))).alias(f"{c}_{name}") for c in values for name, agg in (("mean", F.avg), ("max", F.max))]
    out = d.groupBy(*by).agg(*aggs)
    for c in values:
        m = exact_median(d, c, by).withColumnRenamed("median", f"{c}_median").drop("n")
        out = (out.join(m, list(by), "left") if by else out.join(F.broadcast(m))).withColumn(f"{c}_median", f(F.col(f"{c}_median")))
    return out.select(*by, *(f"{c}_{name}" for c in values for name in ("mean", "median", "max")))


def export_poses(requested: DataFrame, state: DataFrame) -> DataFrame:
    """A row for each requested frame (order_index, frame_id): the optimised pose, the map pose, and valid; NaN where the
    map has no such frame."""
    d = requested.join(state.select("frame_id", "centre", "rot", "opt_centre", "opt_rot", F.lit(True).alias("known")), "frame_id", "left")
    none = lambda n: F.array_repeat(F.lit(float("nan")), n)
    pose = lambda c, n: F.coalesce(*c, none(n))
    return d.select(
        "order_index", "frame_id", pose([F.col("opt_centre"), F.col("centre")], 3).alias("centre"), pose([F.col("opt_rot"), F.col("rot")], 9).alias("rot"),
        pose([F.col("centre")], 3).alias("map_centre"), pose([F.col("rot")], 9).alias("map_rot"), F.coalesce("known", F.lit(False)).alias("valid"),
    )


def export_summary(poses: DataFrame) -> DataFrame:
    return poses.agg(F.count("*").alias("requested"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("missing"))
