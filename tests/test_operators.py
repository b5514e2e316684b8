"""Known values of small inputs, invariants, and awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapweave.functions import vectors as V
from mapweave.jobs import catalog
from mapweave.operators import alignment, evaluate, points, posegraph, retrieval
from mapweave.sources import ply, poses
from mapweave.streaming import loop

POINT = "frame_no long, pt int, px_row int, px_col int, x double, y double, z double, conf double"


def test_nearest_of_two(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0])], "order_index long, descriptor array<double>")
    for block in (1, 2, 1024):
        got = [(r.query_id, r.ref_id, r["rank"]) for r in retrieval.causal_knn(d, 2, block=block).orderBy("query_id", "rank").collect()]
        assert got == [(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 2)]


def test_nearest_of_frames_far_apart_in_small_matrices(spark):
    r = np.random.default_rng(0)
    v = np.round(r.normal(size=(60, 3)), 1)  # with ties
    ids = np.arange(60) * 10**13
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(int(ids[q]), int(ids[f])) for q in range(60) for f in sorted(range(q), key=lambda f: (-np.round(unit[q] @ unit[f], 6), f))[:4]}
    for rows, cols in ((7, 9), (1024, 4096)):
        got = retrieval._nearest(ids, unit, ids, unit, 4, 6, rows, cols)
        assert set(zip(got.query_id.tolist(), got.ref_id.tolist(), strict=True)) == want
    d = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "order_index long, descriptor array<double>")
    assert {(x.query_id, x.ref_id) for x in retrieval.causal_knn(d, 4, block=20).collect()} == want  # as many spans as frames ask for, not as ids


def test_nearest_without_usable_descriptors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [math.nan, 1.0]), (3, [1.0, None]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 2.0]), (None, [1.0, 0.0]), (6, [])]
    d = spark.createDataFrame(rows, "order_index long, descriptor array<double>")
    for block in (2, 1024):
        assert [(r.query_id, r.ref_id) for r in retrieval.causal_knn(d, 2, block=block).collect()] == [(5, 0)]
    assert retrieval.causal_knn(d.limit(0), 2).count() == 0


def test_nearest_among_known_frames(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60").select(F.col("vec_id").alias("order_index"), F.col("embedding").alias("descriptor"))
    asked, known = d.where("order_index >= 40"), d.where("order_index < 50")
    got = {(r.query_id, r.ref_id) for r in retrieval.earlier_knn(asked, known, 3, block=16).collect()}
    v = {r.order_index: np.array(r.descriptor) / np.linalg.norm(r.descriptor) for r in d.collect()}
    want = {(q, r) for q in range(40, 60) for r in sorted((r for r in range(50) if r < q), key=lambda r: (-round(float(v[q] @ v[r]), 6), r))[:3]}
    assert got == want


def test_batches_close_for_three_reasons(spark):
    got = catalog.QUERIES["st2_dynamic_batches"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 470 and {r.closed_by for r in got} == {"", "reached_max_batch_size", "next_frame_incompatible", "end_of_sequence"}
    sizes = [0] * 6
    for b in {r.batch_id for r in got}:
        sizes[sum(r.batch_id == b for r in got)] += 1
    assert sizes[1:] == [119, 50, 25, 14, 24]


def test_grid_spacing_and_not_finite(spark):
    rows = [(1, i, i // 2, i % 2, float(i % 2), float(i // 2), 0.0, 1.0) for i in range(4)]
    d = spark.createDataFrame(rows, POINT)
    assert [r.distance for r in points.spacing(d).collect()] == [1.0] * 4
    bad = spark.createDataFrame([(1, i, 0, 0, x, 0.0, 0.0, c) for i, (x, c) in enumerate([(math.nan, 1.0), (math.inf, 1.0), (None, 1.0), (1.0, math.nan), (1.0, 0.5), (1.0, None)])], POINT)
    assert [r.pt for r in points.usable(bad).collect()] == [4]


def test_voxels(spark, tmp_path):
    rows = [(0, i, 0, 0, v, v, v, 1.0) for i, v in enumerate((0.01, 0.02, 1.0, 2.0))]
    d = spark.createDataFrame(rows, POINT)
    assert [r.pt for r in points.voxel_first(d, 0.5).orderBy("pt").collect()] == [0, 2, 3]
    cloud = d.select("x", "y", "z", *(F.lit(i).alias(c) for i, c in enumerate(("red", "green", "blue"))))
    cloud = cloud.union(cloud.limit(1).withColumn("x", F.lit(float("nan"))))
    assert ply.write(cloud, str(tmp_path / "a.ply")) == 4
    data = (tmp_path / "a.ply").read_bytes()
    body = np.frombuffer(data.split(b"end_header\n")[1], ply.VERTEX)
    assert b"element vertex 4" in data and sorted(body["x"].round(2)) == [np.float32(v) for v in (0.01, 0.02, 1, 2)] and set(body["blue"]) == {2}


def test_ply_data_source(spark, tmp_path):
    ply.register(spark)
    d = spark.createDataFrame([(0, i, 0, 0, v, v, v, 1.0) for i, v in enumerate((0.01, 0.02, 1.0, 2.0))], POINT).repartition(3)
    cloud = d.withColumns({c: (F.col("pt") * 3 + i).cast("int") for i, c in enumerate(("red", "green", "blue"))})
    raw, dedup = str(tmp_path / "raw"), str(tmp_path / "dedup")
    cloud.unionByName(cloud.limit(1).withColumn("x", F.lit(float("nan")))).write.format("ply").mode("append").save(raw)
    points.voxel_first(cloud, 0.5).write.format("ply").mode("append").save(dedup)
    assert len(ply.read_folder(raw)) == 4 and sorted(ply.read_folder(dedup)["blue"]) == [2, 8, 11]
    with pytest.raises(Exception, match="boom"):
        bad = cloud.withColumn("x", F.when(F.col("pt") == 3, F.raise_error(F.lit("boom")).cast("double")).otherwise(F.col("x")))
        bad.write.format("ply").mode("overwrite").save(raw)
    import os

    assert len(ply.read_folder(raw)) == 4 and not [x for x in os.listdir(raw) if x.startswith(".")]
    cloud.where("pt < 2").write.format("ply").mode("overwrite").save(raw)
    assert sorted(ply.read_folder(raw)["x"].round(2)) == [np.float32(0.01), np.float32(0.02)]


def test_a_ply_task_that_outlives_its_job_leaves_no_file(tmp_path):
    import os

    batch = pa.RecordBatch.from_pydict({c: [1.0, 2.0] for c in "xyz"})
    w = ply.PlyWriter(str(tmp_path / "cloud"), False)

    def slow():
        yield batch
        w.abort([])  # the job fails while this task runs
        yield batch

    w.write(slow())
    with pytest.raises(FileNotFoundError):
        w.write(iter([batch]))  # one that starts later
    assert os.listdir(tmp_path / "cloud") == []


def test_robust_scores(spark):
    d = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (2, 1.0), (2, 2.0), (2, 9.0), (3, 4.0), (4, math.nan), (4, 1.0), (4, 1.0)], "g int, v double")
    got = {(r.g, str(r.v)): r.outlier for r in points.positive_outlier(d, "g", "v").collect()}
    assert got[1, "5.0"] == 0 and got[3, "4.0"] == 0 and got[4, "nan"] == math.inf and got[2, "9.0"] == pytest.approx(0.6745 * 7) and got[2, "1.0"] == 0
    low = points.inliers(d.where("g = 2"), "g", "v").where("inlier").collect()
    assert sorted(r.v for r in low) == [1.0, 2.0]  # limit 2 + 2.5 * 1.4826


def test_similarity_is_recovered(spark):
    r = np.random.default_rng(7)
    s = r.normal(size=(128, 3))
    a = math.radians(20)
    rot = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    t = 1.25 * s @ rot.T + [0.4, -0.2, 0.7]
    d = spark.createDataFrame([(1, i, *map(float, s[i]), *map(float, t[i]), 1.0) for i in range(128)], "batch long, pt int, sx double, sy double, sz double, tx double, ty double, tz double, w double")
    f = alignment.robust_fit(d).first()
    assert f.scale == pytest.approx(1.25, abs=1e-6) and np.allclose(np.reshape(f.rotation, (3, 3)), rot, atol=1e-6) and np.allclose(f.translation, [0.4, -0.2, 0.7], atol=1e-6)
    with_outliers = catalog.QUERIES["a17_a3_robust_fit"](spark, "/root/testdata/sf0.01").collect()
    assert max(abs(x.scale - 1.25) for x in with_outliers) < 0.01 and np.median([abs(x.scale - 1.25) for x in with_outliers]) < 1e-3


def test_gate_order_and_nan(spark):
    d = spark.createDataFrame([(1, 9.0, 9.0), (2, 0.0, 9.0), (3, 0.0, 0.0), (4, math.nan, 0.0), (5, None, 0.0)], "i int, a double, b double")
    got = {r.i: (r.failed_checks, r.reason, r.passed) for r in alignment.gate(d, [("a", "a", 1.0), ("b", "b", 1.0)]).collect()}
    assert got == {1: (["a", "b"], "a", False), 2: (["b"], "b", False), 3: ([], None, True), 4: (["a"], "a", False), 5: (["a"], "a", False)}


def test_names_and_matching(spark):
    d = spark.createDataFrame([("a\\b/c.d.jpg",), (".hidden",), ("x",), ("p/y.PNG",)], "p string")
    assert [tuple(r) for r in d.select(V.base_name(F.col("p")), V.stem(F.col("p"))).collect()] == [("c.d.jpg", "c.d"), (".hidden", ".hidden"), ("x", "x"), ("y.PNG", "y")]
    pose = "centre array<double>, rot array<double>"
    eye, o = np.eye(3).ravel().tolist(), [0.0] * 3
    t = spark.createDataFrame([(0, "a.jpg", o, eye), (1, "b.jpg", o, eye), (2, "c.jpg", o, eye)], f"gt_index long, image_name string, {pose}")
    p = spark.createDataFrame([(7, "q/a.jpg", o, eye, True), (8, "b.png", o, eye, True), (9, "r/z.jpg", o, eye, True)], f"pred_index long, image_path string, {pose}, valid boolean")
    assert {r.gt_index: r.pred_index for r in evaluate.match(t, p).collect()} == {0: 7, 1: 8, 2: None}
    with pytest.raises(Exception, match="ambiguous name"):
        evaluate.match(t, p.union(p.limit(1))).collect()
    known = p.withColumn("frame_id", F.when(F.col("pred_index") == 9, "c").when(F.col("pred_index") == 8, "b").otherwise("x"))
    assert {r.gt_index: r.pred_index for r in evaluate.match(t, known).collect()} == {0: 7, 1: 8, 2: 9}  # by id; one that equals its stem is one
    assert {r.gt_index: r.pred_index for r in evaluate.match(t, known, "name").collect()} == {0: 7, 1: None, 2: None}
    assert {r.gt_index: r.pred_index for r in evaluate.match(t, known, "stem").collect()} == {0: 7, 1: 8, 2: 9}


def test_norm_is_taken_once(spark):
    rows = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: (i * F.col("id") % 7).cast("double")).alias("v"))
    assert rows.select(V.unit(F.col("v")).alias("u")).agg(F.sum(V.norm(F.col("u")))).first()[0] == pytest.approx(1714)  # every seventh row is zero


def test_aligned_errors(spark):
    got = catalog.QUERIES["a18_aligned_errors"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 419 and math.sqrt(sum(r.translation_error**2 for r in got) / 419) < 0.01
    one = spark.createDataFrame([([0.0] * 3, [1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert one.select(V.direction_angle_deg(F.col("a"), F.col("b"))).first()[0] is None


def test_pose_files(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# c\n\n1 1 0 0 0 1 2 3 4 my name.jpg\n0.5 0.5 -1 7.5 8 9 1 2 3 4\n2 0 0 0 2 1 0 0 4 b.jpg\n")
    got = {r.image_name: [round(x, 6) + 0 for x in r.centre] for r in poses.text_poses(spark, str(tmp_path / "images.txt")).collect()}
    assert got == {"my name.jpg": [-1, -2, -3], "b.jpg": [1, 0, 0]}
    (tmp_path / "none.txt").write_text("# only\n")
    with pytest.raises(Exception, match="no pose"):
        poses.text_poses(spark, str(tmp_path / "none.txt")).collect()
    m = np.tile(np.eye(4), (3, 1, 1))
    m[1, 0, 3] = np.nan
    np.savez(tmp_path / "p.npz", frame_ids=np.array(["a", "b", "c"]), image_paths=np.array(["a.jpg", "b.jpg", "c.jpg"]), cam2world=m, valid=np.array([True, True, False]))
    assert [r.valid for r in poses.array_poses(spark, str(tmp_path / "p.npz")).orderBy("pred_index").collect()] == [True, False, False]


def test_image_listing(spark, tmp_path):
    for name in ("b.png", "a.JPG", "c.txt", "d.jpeg"):
        (tmp_path / name).write_bytes(b"x")
    got = [(r.order_index, r.path.rsplit("/", 1)[1]) for r in poses.image_paths(spark, str(tmp_path)).orderBy("order_index").collect()]
    assert got == [(0, "a.JPG"), (1, "b.png"), (2, "d.jpeg")]
    assert [r.path.rsplit("/", 1)[1] for r in poses.image_paths(spark, str(tmp_path), 2).orderBy("order_index").collect()] == ["a.JPG", "b.png"]


def test_streaming_loop(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "rdd"))
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60")
    frames = d.select(F.col("vec_id").cast("string").alias("frame_id"), F.col("vec_id").alias("order_index"), F.col("embedding").cast("array<double>").alias("descriptor"))
    for i in range(3):
        frames.where(F.floor(F.col("order_index") / 20) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = loop.start(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "state/logs")).orderBy("micro_batch").collect()
    assert [r.status for r in log] == ["added"] * 3 and sum(r.added_frames for r in log) == 60
    loop.step(frames.limit(5), 3, str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "state/logs")).where("micro_batch = 3").first().status == "skipped_existing"
    loop.step(frames.limit(5), 2, str(tmp_path / "state"))  # a batch that runs again sees only earlier ones
    assert spark.read.parquet(str(tmp_path / "state/frames")).where("micro_batch < 2").count() == 40
