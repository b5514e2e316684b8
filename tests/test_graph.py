"""Known values of transforms, validation and the growing map."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.functions import transforms as T
from mapweave.functions import vectors as V
from mapweave.operators import online, points, validation

EYE = np.eye(3).ravel().tolist()
POSE = "node long, centre array<double>, rot array<double>"


def test_rotations(spark):
    half = np.diag([1.0, -1.0, -1.0]).ravel().tolist()
    tiny = np.array([[1, -1e-9, 0], [1e-9, 1, 0], [0, 0, 1.0]]).ravel().tolist()
    flipped = np.diag([2.0, 2.0, -0.1]).ravel().tolist()
    rows = [(1, EYE), (2, half), (3, tiny), (4, flipped), (5, None), (6, [math.nan] * 9)]
    d = spark.createDataFrame(rows, "i int, r array<double>")
    got = {r.i: r for r in d.select("i", T.rotation_log(F.col("r")).alias("log"), T.nearest_rotation("r").alias("near"), V.angle_deg(V.trace(F.col("r"))).alias("deg")).collect()}
    assert got[1].log == [0, 0, 0] and np.allclose(np.abs(got[2].log), [math.pi, 0, 0]) and np.allclose(got[3].log, [0, 0, 1e-9])
    assert np.allclose(got[4].near, np.diag([1, 1, 1]).ravel()) and got[5].near is None and got[6].near is None
    assert got[5].deg is None and math.isnan(got[6].deg) and got[2].deg == pytest.approx(180)


def test_packed_keys_need_room(spark):
    far = spark.createDataFrame([(float(s * 2**40),) * 3 for s in (-1, 1)], "x double, y double, z double")
    with pytest.raises(Exception, match="voxel keys need bits: 126"):
        points.packed_keys(far, 1.0).collect()


def test_validation_and_drop_plan(spark):
    o = [0.0] * 3
    rows = [(1, o, EYE, o, EYE, 1.0), (2, [9.0, 0.0, 0.0], EYE, o, EYE, 3.0), (3, None, None, None, None, None), (4, [math.nan, 0.0, 0.0], EYE, o, EYE, 1.0)]
    d = spark.createDataFrame(rows, "batch long, p_centre array<double>, p_rot array<double>, centre array<double>, rot array<double>, estimated_scale double")
    got = {r.batch: (r.failed_checks, r.reason, r.accepted) for r in validation.validate(d, 1.0, 5.0, 10.0, 0.5, 2.0).collect()}
    assert got[1] == ([], "ok", True) and got[3] == (["no_reference_frames"], "no_reference_frames", False)
    assert got[2][0] == ["median_translation", "max_translation", "estimated_scale"] and got[4][1] == "median_translation"
    scores = spark.createDataFrame([(b, i, float(v), False) for b, vs in ((1, [0, 9, 8, 7, 0]), (2, [1, 3, 2, 0]), (3, [9, 9, 9])) for i, v in enumerate(vs)], "batch long, ref long, bad double, failed boolean")
    plan = validation.drop_plan(scores, F.col("bad") >= 5, F.col("bad"), F.col("failed")).where("dropped").collect()
    assert sorted((r.batch, r.ref, r["mode"]) for r in plan) == [(1, 1, "threshold"), (1, 2, "threshold"), (2, 1, "worst_ref_fallback")]


def test_steps_cross_blocks_and_gate_feeds_on_itself(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = spark.createDataFrame([(i, float(i)) for i in (0, 1, 5, 12, 13, 40)], "order_index long, v double")
    assert sorted((r.prev_order_index, r.order_index) for r in online.steps(d, block=4).collect()) == [(0, 1), (1, 5), (5, 12), (12, 13), (13, 40)]
    step = [1.0, 5.0, 1.0, 3.9, 4.1, 2.0]
    s = spark.createDataFrame([(0, i, True, x) for i, x in enumerate(step)], "stream int, order_index long, able boolean, step double")
    seen, want = [], []
    for x in step:
        want.append(not seen or x <= 4 * float(np.median(seen)))
        seen += [x] * want[-1]
    assert [r.accepted for r in online.accepted_steps(s).orderBy("order_index").collect()] == want and False in want


def test_merge_moves_only_what_changed(spark):
    at = lambda *xs: spark.createDataFrame([(i, [x, 0.0, 0.0], EYE) for i, x in enumerate(xs)], POSE)
    got = online.merge(at(0.0, 1.0, 7.0), at(0.0, 1.0), at(0.0, 1.5)).orderBy("node").collect()
    assert [(r.opt_centre[0], r.centre[0], r.updated) for r in got] == [(0, 0, False), (1.5, 1, True), (7, 7, False)]
    assert [r.centre[0] for r in online.overlay(at(0.0, 1.0), at(0.0, 1.25)).orderBy("node").collect()] == [0, 1.25]


def planned(spark, values, plan, **kw):
    d = spark.createDataFrame([(1, i, *v) for i, v in enumerate(values)], "batch long, ref long, value double, failed boolean")
    return sorted((r.ref, r["mode"]) for r in plan(d, **kw).where("dropped").collect())


def test_which_references_a_retry_drops(spark):
    bad = lambda d, limit, **kw: validation.drop_plan(d, (F.col("value") >= limit) & V.finite(F.col("value")), F.col("value"), F.col("failed"), **kw)
    geometry = [(1.0, False), (float("inf"), False), (1.5, False), (0.5, False)]
    assert planned(spark, geometry, bad, limit=9.0) == [(1, "worst_ref_fallback")]  # not finite before all others
    assert planned(spark, [(1.0, False), (3.0, False), (9.0, False), (0.5, False)], bad, limit=2.0, max_drop=1) == [(1, "threshold")]  # in order of ref
    assert planned(spark, [(1.0, False), (0.0, False), (9.0, False), (0.5, True)], bad, limit=2.0, max_drop=1) == [(3, "threshold")]
    alike = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.0, -0.9, -0.95, 0.5))], "batch long, ref long, similarity double")
    got = validation.similarity_plan(alike, max_drop=1).where("dropped").collect()
    assert [(r.ref, r["mode"]) for r in got] == [(2, "threshold")]  # the farthest candidate, not the first


def test_continuity_gate_over_chunks(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r, seen, want = np.random.default_rng(0), [], []
    steps = [(0, i, bool(r.random() < 0.9), float(x)) for i, x in enumerate(r.lognormal(size=40))]
    for _, _, able, x in steps:
        want.append(able and (not seen or x <= 1.2 * float(np.median(seen[-7:]))))
        seen += [x] * want[-1]
    got = online.accepted_steps(spark.createDataFrame(steps, "stream long, order_index long, able boolean, step double"), 1.2, trail=7, chunk=16, block=4)
    assert [x.accepted for x in got.orderBy("order_index").collect()] == want and got.columns == ["stream", "order_index", "able", "step", "accepted"]


def chain(spark, tmp_path, refine, batches=((0, 1), (1, 1), (2, 1), (3, 1)), loops=(1,), **kw):
    """Frames a to d, one a batch, with an edge between neighbours; ``refine`` gives the x of a run's nodes from its number and
    start, or an exception."""
    from mapweave.operators.pose_runs import chained_runs

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    frames = spark.createDataFrame([(i, i, i, [float(i), 0.0, 0.0], EYE) for i, _ in batches], f"node long, order_index long, batch_id long, {POSE.split(', ', 1)[1]}")
    edges = [(i - 1, i, "loop" if i in loops else "intra_batch", i) for i, _ in batches if i]
    starts = []

    def run(nodes, edges):
        x = {r.node: r.centre[0] for r in nodes.collect()}
        starts.append((x, edges.count()))
        new, cost = refine(len(starts), x)
        rows = [(i, [new[i], 0.0, 0.0], EYE) for i in x]
        return spark.createDataFrame(rows, POSE), {"success": True, "initial_cost": 2.0, "final_cost": cost}

    d = spark.createDataFrame(list(batches), "batch_id long, batch_size long")
    events, map_ = chained_runs(frames, d, spark.createDataFrame(edges, "source long, target long, edge_type string, batch_id long"), run, **kw)
    return [(r.phase, r.event, r.reason) for r in events.collect()], {r.node: (r.opt_centre[0], r.centre[0]) for r in map_.collect()}, starts


def test_triggers_schedule_and_skip(spark, tmp_path):
    events, poses, starts = chain(spark, tmp_path, lambda n, x: (x | {1: 1.5}, 1.0), interval=2, mode="online")
    assert events == [("online", "pose_graph_online_scheduled", None), ("online", "pose_graph_online_skipped", "no_new_loop_edges"), ("online", "pose_graph_merged", None)]
    assert starts == [({0: 0.0, 1: 1.0}, 1)] and poses == {0: (0, 0), 1: (1.5, 1), 2: (2, 2), 3: (3, 3)}


def test_runs_are_chained_and_merged_at_the_end(spark, tmp_path):
    events, poses, starts = chain(spark, tmp_path, lambda n, x: (x | {1: 1.25} if n == 1 else x | {3: 3.5}, 1.0), loops=(1, 3), interval=2)
    assert starts[1] == ({0: 0.0, 1: 1.25, 2: 2.0, 3: 3.0}, 3)  # the second starts where the first ended
    assert [e[1] for e in events] == ["pose_graph_online_scheduled"] * 2 + ["pose_graph_merged"] * 3 and events[-1][0] == "final"
    assert starts[2][0] == {0: 0.0, 1: 1.25, 2: 2.0, 3: 3.5} and poses == {0: (0, 0), 1: (1.25, 1), 2: (2, 2), 3: (3.5, 3)}


def test_a_run_writes_one_table(spark, tmp_path, monkeypatch):
    from mapweave.sources.tables import Tables

    names, write = [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, d, name: names.append(name) or write(self, d, name))
    events, *_ = chain(spark, tmp_path, lambda n, x: (x | {1: 1.25}, 1.0), loops=(1, 3), interval=2)
    runs = sum(e[1] == "pose_graph_merged" for e in events)
    assert runs == 3 and len(names) <= runs + 4, names  # the usable and the last edges, the frames, the map


def per_frame(spark, tmp_path, one_by_one, **kw):
    """Twelve frames in runs of two more each, which move to 100 times their number and turn; frame 3 has no row beside it."""
    from mapweave.operators.pose_runs import PerFrame, chained_runs

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    frames = spark.createDataFrame([(i, i, i, [float(i), 1.0, 0.5 * i], EYE) for i in range(12)], f"node long, order_index long, batch_id long, {POSE.split(', ', 1)[1]}")
    edges = spark.createDataFrame([(i - 1, i, "loop", i) for i in range(1, 12)], "source long, target long, edge_type string, batch_id long")
    batches = spark.createDataFrame([(i, 1) for i in range(12)], "batch_id long, batch_size long")
    there = spark.createDataFrame([(i, [100.0 * i, 0.0, 0.0]) for i in range(12) if i != 3], "node long, there array<double>")
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    run = PerFrame(lambda centre, rot, beside: ((centre + beside["there"]) / 2, turn @ rot), there, {"success": True, "initial_cost": 2.0, "final_cost": 1.0})
    events, map_ = chained_runs(frames, batches, edges, (lambda nodes, edges: run(nodes, edges)) if one_by_one else run, interval=2, **kw)
    return [tuple(r) for r in events.collect()], {r.node: tuple(map(tuple, r[1:])) for r in map_.select("node", "opt_centre", "opt_rot", "centre", "rot").collect()}


def test_per_frame_runs_cost_no_job_each(spark, tmp_path, monkeypatch):
    from mapweave.sources.tables import Tables

    names, write = [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, d, name: names.append(name) or write(self, d, name))
    got = per_frame(spark, tmp_path, False)
    assert len(got[0]) == 13 and len(names) <= 8, names  # six runs, and the last
    assert got == per_frame(spark, tmp_path, True) and len(names) > 14
    assert got[1][3][0] == got[1][3][2] and got[1][0][0] == (0.0, 2.0**-7, 0.0)


def test_events_of_per_frame_runs(spark, tmp_path):
    events = per_frame(spark, tmp_path, False)[0]
    assert [e[2] for e in events] == ["pose_graph_online_scheduled"] * 6 + ["pose_graph_merged"] * 7
    assert [e[8:10] for e in events[6:]] == [(2, 2), (3, 3), (5, 5), (7, 7), (9, 9), (11, 11), (11, 11)]
    counted = per_frame(spark, tmp_path, False, few=5)[0]
    assert all(a[:12] == b[:12] and np.allclose(a[12:], b[12:], atol=2e-6) for a, b in zip(events[6:], counted[6:], strict=True))
    current = spark.createDataFrame([(i, i) for i in range(12) if i != 4], "node long, order_index long")
    together, each = (per_frame(spark, tmp_path, one, mode="online", current=current) for one in (False, True))
    assert together == each and [e[3] for e in each[0][6:]] == [None, None] + ["snapshot_frame_id_mismatch"] * 3 + ["frame_order_mismatch"]


def test_stand_in_optimiser_changes_every_frame(spark, tmp_path, monkeypatch):
    from mapweave.jobs import graph_catalog
    from mapweave.operators import pose_runs
    from mapweave.sources import fixtures

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(pose_runs, "chained_runs", lambda frames, batches, edges, optimise, **kw: optimise)
    there = fixtures.poses(spark, "/root/testdata/sf0.001")[0].where("gt_index < 20").select(F.col("gt_index").alias("node"), "centre", "rot")
    refined, _ = graph_catalog.runs(spark, "/root/testdata/sf0.001")(there, None)
    assert online.merge(there, there, refined).where("updated").count() == 20  # also frames that have arrived


def test_runs_that_do_not_count(spark, tmp_path):
    def refine(n, x):
        if n == 1:
            raise RuntimeError("no solution")
        return x | {1: 9.0}, 3.0 if n == 2 else 1.0

    events, poses, starts = chain(spark, tmp_path, refine, batches=[(i, 1) for i in range(6)], loops=(1, 3, 5), interval=2, mode="online")
    assert events[3:] == [("online", "pose_graph_failed", "no solution"), ("online", "pose_graph_discarded", "cost_increased"), ("online", "pose_graph_merged", None)]
    assert [s[0][1] for s in starts] == [1.0, 1.0, 1.0] and poses[1] == (9.0, 1.0)
    gone = spark.createDataFrame([(0, 0)], "node long, order_index long")
    assert chain(spark, tmp_path, lambda n, x: (x, 1.0), interval=2, mode="online", current=gone)[0][-1][2] == "frame_order_mismatch"
    moved = spark.createDataFrame([(0, 0), (2, 2), (3, 3)], "node long, order_index long")
    assert chain(spark, tmp_path, lambda n, x: (x, 1.0), interval=2, mode="online", current=moved)[0][-1][2] == "snapshot_frame_id_mismatch"
    assert chain(spark, tmp_path, lambda n, x: (x, 1.0), interval=9, min_edges=9)[0] == [("final", "pose_graph_final_skipped", "not_enough_edges")]


def test_when_results_count(spark):
    rows = [(1, True, 2.0, 1.0), (2, True, 1.0, 2.0), (3, False, 2.0, 1.0), (4, None, 2.0, 1.0), (5, True, math.nan, 1.0), (6, True, 1.0, math.inf), (7, True, 1.0, 1.0 + 1e-12)]
    d = spark.createDataFrame(rows, "i int, success boolean, before double, after double")
    got = {r.i: r.why for r in d.select("i", online.accept(F.col("success"), F.col("before"), F.col("after")).alias("why")).collect()}
    assert got == {1: None, 2: "cost_increased", 3: "optimizer_unsuccessful", 4: "optimizer_unsuccessful", 5: "non_finite_cost", 6: "non_finite_cost", 7: None}
    from mapweave.operators.pose_runs import discarded

    summaries = {i: discarded({"success": bool(s), "initial_cost": b, "final_cost": a}) for i, s, b, a in rows}
    assert summaries == got
