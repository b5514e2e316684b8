"""The queries of the map operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.vectors import dot, norm, safe_unit, unit
from mapweave.operators import alignment, evaluate, points, posegraph, reporting, retrieval
from mapweave.sources import fixtures as fx
from mapweave.streaming import batching

R6 = lambda c: F.round(F.col(c), 6).alias(c)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

POINTS = f"p AS ({fx.POINTS_SQL})"
KEPT = """g AS (SELECT *, row_number() OVER (PARTITION BY frame_no, px_row // 32, px_col // 32 ORDER BY conf DESC, pt) AS rank_in_cell FROM p WHERE conf >= 0.5)"""
KNN = """f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.id AS query_id, r.id AS ref_id, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM f q JOIN f r ON r.id < q.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s QUALIFY rank <= 5)"""
CORR = f"""{POINTS}, c AS (SELECT frame_no AS batch, x AS sx, y AS sy, z AS sz, 1.25 * (0.9396926207859084 * x - 0.3420201433256687 * y) + 0.4 + CASE WHEN conf < 0.4 THEN 5.0 ELSE 0.0 END AS tx,
    1.25 * (0.3420201433256687 * x + 0.9396926207859084 * y) - 0.2 AS ty, 1.25 * z + 0.7 AS tz, conf AS w FROM p)"""
EDGES = """e AS (SELECT vec_id AS source, vec_id + 1 AS target, 'local_continuity' AS edge_type, 1.0 AS weight FROM embeddings WHERE vec_id % 7 <> 6 AND vec_id + 1 IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT vec_id, vec_id + 70, 'loop', 3.0 FROM embeddings WHERE vec_id % 35 = 0 AND vec_id + 70 IN (SELECT vec_id FROM embeddings))"""
LOGS = """l AS (SELECT event_id AS batch_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'added' WHEN event_type = 'click' THEN 'skipped_failed_validation'
    WHEN event_type = 'error' THEN 'skipped_alignment_failed' ELSE 'skipped_not_enough_neighbors' END AS status, value AS total_time_sec, 1 + user_id % 5 AS batch_size FROM events)"""
MEMBERS = """m AS (SELECT vec_id // 8 AS batch, vec_id AS frame, vec_id % 8 AS pos, FALSE AS is_ref FROM embeddings
    UNION ALL SELECT vec_id // 8, vec_id // 8 * 8 - 20 * (vec_id % 8 + 1), vec_id % 8, TRUE FROM embeddings WHERE vec_id % 8 < 3 AND vec_id // 8 * 8 - 20 * (vec_id % 8 + 1) >= 0)"""
POSES = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + e[7] * e[7]) AS n FROM e),
    t AS (SELECT vec_id AS i, 100 * e[1] AS x, 100 * e[2] AS y, 100 * e[3] AS z, (100 * e[1] - 1) / 2 + 0.01 * e[8] AS px, (100 * e[2] - 2) / 2 + 0.01 * e[9] AS py, (100 * e[3] - 3) / 2 + 0.01 * e[10] AS pz,
        vec_id % 11 <> 0 AS matched, vec_id % 11 <> 0 AND vec_id % 13 <> 0 AS valid, e[4] / n AS qw, e[5] / n AS qx, e[6] / n AS qy, e[7] / n AS qz FROM n),
    a AS (SELECT *, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS translation_error FROM t WHERE valid)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return points.grid_top_k(points.usable(fx.points(spark, sf)))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of eight consecutive frames with up to three references 20, 40 and 60 places back."""
    v, own = F.col("vec_id"), F.floor(F.col("vec_id") / 8)
    d = fx.read(spark, sf, "embeddings").select("vec_id")
    back = own * 8 - 20 * (v % 8 + 1)
    new = d.select(own.alias("batch"), v.alias("frame"), (v % 8).alias("pos"), F.lit(False).alias("is_ref"))
    return new.union(d.where((v % 8 < 3) & (back >= 0)).select(own, back, v % 8, F.lit(True)))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.match(*fx.poses(spark, sf))


@query("p1_unit_vectors", "WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id AS order_index, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, CAST(1.0 AS DOUBLE) AS length FROM f")
def p1(spark, sf):
    d = fx.frames(spark, sf).select("order_index", unit(F.col("descriptor")).alias("u"))
    return d.select("order_index", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(norm(F.col("u")), 6).alias("length"))


@query("p2_p3_similarity_to_previous", "WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT b.vec_id AS order_index, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM f a JOIN f b ON b.vec_id = a.vec_id + 1")
def p2_p3(spark, sf):
    d = fx.frames(spark, sf).select("order_index", safe_unit(F.col("descriptor")).alias("u"))
    before = d.select((F.col("order_index") + 1).alias("order_index"), F.col("u").alias("w"))
    return d.join(before, "order_index").select("order_index", F.round(dot(F.col("w"), F.col("u")), 6).alias("similarity"))


@query("j1_causal_knn", f"WITH {KNN} SELECT query_id, ref_id, score, CAST(rank AS INT) AS rank FROM k")
def j1(spark, sf):
    return retrieval.causal_knn(fx.frames(spark, sf))


@query(
    "a1_neighbor_evidence",
    f"""WITH {KNN}, a AS (SELECT query_id // 5 AS batch, ref_id, count(*) AS hits, round(sum(score), 6) AS score_sum, max(score) AS score_max, round(sum(1.0 / rank), 6) AS rank_sum FROM k GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY hits DESC, score_sum DESC, score_max DESC, rank_sum DESC, ref_id) AS INT) AS pos,
    round(hits + 0.01 * score_sum + 0.001 * score_max + 0.0001 * rank_sum, 6) AS evidence FROM a QUALIFY pos <= 5""",
)
def a1(spark, sf):
    f = fx.frames(spark, sf)
    return retrieval.neighbor_evidence(retrieval.causal_knn(f), f.select(F.col("order_index").alias("query_id"), F.floor(F.col("order_index") / 5).alias("batch")))


@query("st2_dynamic_batches")
def st2(spark, sf):
    f = fx.frames(spark, sf)
    return batching.batches_of(f.where("order_index >= 30"), retrieval.causal_knn(f, 24), k=20, dominant=20, ratio_min=0.1, similarity_min=0.25)


@query("st1_bootstrap", "SELECT vec_id AS order_index, label FROM embeddings WHERE vec_id < 30")
def st1(spark, sf):
    return retrieval.bootstrap(fx.frames(spark, sf)).select("order_index", "label")


@query("f1_usable_points", f"WITH {POINTS} SELECT frame_no, count(*) AS n, sum(x) AS x FROM p WHERE conf >= 0.5 GROUP BY frame_no")
def f1(spark, sf):
    return points.usable(fx.points(spark, sf)).groupBy("frame_no").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@query("w1_grid_top_k", f"WITH {POINTS}, {KEPT} SELECT frame_no, CAST(pt AS INT) AS pt, CAST(rank_in_cell AS INT) AS rank_in_cell FROM g WHERE rank_in_cell <= 12")
def w1(spark, sf):
    return kept(spark, sf).select("frame_no", "pt", "rank_in_cell")


@query("t2_frame_cap", f"WITH {POINTS}, {KEPT} SELECT frame_no, CAST(pt AS INT) AS pt, CAST(row_number() OVER (PARTITION BY frame_no ORDER BY conf DESC, pt) AS INT) AS rank_in_frame FROM g WHERE rank_in_cell <= 12 QUALIFY rank_in_frame <= 50")
def t2(spark, sf):
    return points.grid_top_k(points.usable(fx.points(spark, sf)), cap=50).select("frame_no", "pt", "rank_in_frame")


@query("w5_voxel_first", f"WITH {POINTS} SELECT CAST(floor(x / 5) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 5) AS BIGINT) AS kz, frame_no, CAST(pt AS INT) AS pt, x, y, z FROM p QUALIFY row_number() OVER (PARTITION BY floor(x / 5), floor(y / 5), floor(z / 5) ORDER BY frame_no, pt) = 1")
def w5(spark, sf):
    return points.voxel_first(fx.points(spark, sf), 5.0).select("kx", "ky", "kz", "frame_no", "pt", "x", "y", "z")


@query("a19_voxel_bounds", f"WITH {POINTS}, k AS (SELECT CAST(floor(x / 5) AS BIGINT) AS x, CAST(floor(y / 5) AS BIGINT) AS y, CAST(floor(z / 5) AS BIGINT) AS z FROM p), b AS (SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM k) SELECT *, CAST(ceil(log2(max_x - min_x + 1)) + ceil(log2(max_y - min_y + 1)) + ceil(log2(max_z - min_z + 1)) AS BIGINT) AS bits FROM b")
def a19(spark, sf):
    return points.voxel_bounds(fx.points(spark, sf), 5.0)


INLIERS = f"""{POINTS}, m AS (SELECT frame_no, median(y) AS median FROM p GROUP BY frame_no), d AS (SELECT p.*, median FROM p JOIN m USING (frame_no)),
    q AS (SELECT frame_no, median(abs(y - median)) AS mad FROM d GROUP BY frame_no), i AS (SELECT d.*, mad, median + 2.5 * greatest(1.4826 * mad, 0.0001) AS lim FROM d JOIN q USING (frame_no))"""


@query("a4_f4_inliers", f"WITH {INLIERS} SELECT frame_no, round(any_value(median), 6) AS median, round(any_value(lim), 6) AS lim, count(*) FILTER (y <= lim) AS inliers FROM i GROUP BY frame_no")
def a4(spark, sf):
    d = points.inliers(fx.points(spark, sf), "frame_no", "y")
    return d.groupBy("frame_no").agg(F.round(F.first("median"), 6).alias("median"), F.round(F.first("limit"), 6).alias("lim"), F.count_if("inlier").alias("inliers"))


@query("a5_robust_z", f"WITH {INLIERS} SELECT frame_no, CAST(pt AS INT) AS pt, round(CASE WHEN mad < 1e-8 THEN 0.0 ELSE 0.6745 * (y - median) / mad END, 6) AS robust_z FROM i")
def a5(spark, sf):
    return points.robust_z(fx.points(spark, sf), "frame_no", "y").select("frame_no", "pt", R6("robust_z"))


@query("a6_positive_outlier", f"WITH {INLIERS} SELECT frame_no, CAST(pt AS INT) AS pt, round(CASE WHEN count(*) OVER (PARTITION BY frame_no) < 2 THEN 0.0 ELSE greatest(0.0, CASE WHEN max(CASE WHEN mad < 1e-8 THEN 0.0 ELSE abs(0.6745 * (y - median) / mad) END) OVER (PARTITION BY frame_no) < 1e-8 THEN CASE WHEN stddev_pop(y) OVER (PARTITION BY frame_no) > 1e-8 THEN (y - median) / stddev_pop(y) OVER (PARTITION BY frame_no) ELSE 0.0 END ELSE 0.6745 * (y - median) / mad END) END, 6) AS outlier FROM i")
def a6(spark, sf):
    return points.positive_outlier(fx.points(spark, sf), "frame_no", "y").select("frame_no", "pt", R6("outlier"))


@query("w6_a7_spacing", f"WITH {POINTS}, u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY frame_no, px_row, px_col ORDER BY pt) = 1), s AS (SELECT a.frame_no, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM u a JOIN u b ON a.frame_no = b.frame_no AND ((a.px_row = b.px_row AND b.px_col = a.px_col + 1) OR (a.px_col = b.px_col AND b.px_row = a.px_row + 1))) SELECT frame_no, count(*) AS n, round(median(d), 6) AS spacing FROM s WHERE d > 0 GROUP BY frame_no")
def w6(spark, sf):
    p = fx.points(spark, sf)
    one = p.groupBy("frame_no", "px_row", "px_col").agg(F.min_by(F.struct("x", "y", "z"), "pt").alias("v")).select("frame_no", "px_row", "px_col", "v.*")
    return points.spacing(one).groupBy("frame_no").agg(F.count("*").alias("n"), F.round(points.median(F.col("distance")), 6).alias("spacing"))


MATCHED = f"""{POINTS}, c AS (SELECT a.frame_no % 10 AS batch, a.frame_no, a.pt, sqrt(a.conf * b.conf) AS raw FROM p a JOIN p b ON a.frame_no = b.frame_no AND a.pt = b.pt WHERE a.conf >= 0.5 AND b.conf >= 0.5)"""


@query("j2_u2_correspondences", f"WITH {MATCHED} SELECT batch, frame_no, CAST(pt AS INT) AS pt, round(raw / sum(raw) OVER (PARTITION BY batch), 9) AS w FROM c")
def j2(spark, sf):
    p = fx.points(spark, sf)
    d = alignment.match_points(p.withColumn("batch", F.col("frame_no") % 10), p)
    return d.select("batch", "frame_no", "pt", F.round("w", 9).alias("w"))


@query("a16_moments", f"WITH {CORR} SELECT batch, round(sum(w), 6) AS m_w, round(sum(w * sx), 6) AS m_sx, round(sum(w * ty), 6) AS m_ty, round(sum(w * (sx ** 2 + sy ** 2 + sz ** 2)), 6) AS m_ss, round(sum(w * tx * sy), 6) AS m_txsy, round(sum(w * tz * sz), 6) AS m_tzsz FROM c GROUP BY batch")
def a16(spark, sf):
    d = alignment.moments(fx.correspondences(spark, sf))
    r = lambda c, n: F.round(c, n).alias(c)
    return d.select("batch", r("m_w", 6), r("m_sx", 6), r("m_ty", 6), r("m_ss", 6), r("m_txsy", 6), r("m_tzsz", 6))


@query("a17_a3_robust_fit")
def a17(spark, sf):
    return alignment.robust_fit(fx.correspondences(spark, sf))


@query("f8_validation_gate", f"WITH {LOGS}, b AS (SELECT batch_id % 50 AS batch, max(total_time_sec) AS top, median(total_time_sec) AS med FROM l GROUP BY ALL), g AS (SELECT batch, list_filter([CASE WHEN top > 200 THEN 'max' END, CASE WHEN med > 30 THEN 'median' END], lambda x: x IS NOT NULL) AS f FROM b) SELECT batch, array_to_string(f, ',') AS failed, f[1] AS reason, len(f) = 0 AS passed FROM g")
def f8(spark, sf):
    b = fx.logs(spark, sf).groupBy((F.col("batch_id") % 50).alias("batch")).agg(F.max("total_time_sec").alias("top"), points.median(F.col("total_time_sec")).alias("med"))
    d = alignment.gate(b, [("max", "top", 200.0), ("median", "med", 30.0)])
    return d.select("batch", F.array_join("failed_checks", ",").alias("failed"), "reason", "passed")


@query("j7_j8_batch_edges", f"WITH {MEMBERS} SELECT r.batch, r.frame AS source, n.frame AS target, CASE WHEN abs(r.frame - n.frame) >= 50 THEN 'loop' ELSE 'registration' END AS edge_type FROM m r JOIN m n ON r.batch = n.batch AND r.is_ref AND NOT n.is_ref UNION ALL SELECT a.batch, a.frame, b.frame, 'intra_batch' FROM m a JOIN m b ON a.batch = b.batch AND NOT a.is_ref AND NOT b.is_ref AND a.pos < b.pos")
def j7(spark, sf):
    return posegraph.batch_edges(members(spark, sf))


@query("w2_continuity", "WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT lag(vec_id) OVER (ORDER BY vec_id) AS source, vec_id AS target, round(list_cosine_similarity(lag(v) OVER (ORDER BY vec_id), v), 6) AS similarity FROM f) SELECT *, similarity >= 0.2 AS linked FROM s WHERE source IS NOT NULL")
def w2(spark, sf):
    return posegraph.continuity(fx.frames(spark, sf), 0.2)


@query("p21_edge_weight", f"WITH {LOGS} SELECT batch_id, round(greatest(0.1, least(5.0, least(3.0, greatest(0.5, sqrt(greatest(batch_size * 500, 1) / 1000.0))) * greatest(batch_size / 5.0, 0.1) / (1 + total_time_sec / 100))), 6) AS weight FROM l WHERE total_time_sec >= 0")
def p21(spark, sf):
    d = fx.logs(spark, sf).where("total_time_sec >= 0")
    return d.select("batch_id", F.round(posegraph.edge_weight(F.col("batch_size") / 5.0, F.col("total_time_sec") / 100, F.col("batch_size") * 500), 6).alias("weight"))


@query("f5_usable_edges", f"WITH {EDGES}, n AS (SELECT vec_id FROM embeddings WHERE vec_id % 9 <> 0) SELECT source, target, edge_type, CAST(weight AS DOUBLE) AS weight FROM e WHERE source IN (FROM n) AND target IN (FROM n) AND source <> target")
def f5(spark, sf):
    return posegraph.usable_edges(fx.edges(spark, sf), fx.read(spark, sf, "embeddings").where("vec_id % 9 <> 0").select(F.col("vec_id").alias("node")))


@query("a8_a9_edge_stats", f"WITH {EDGES} SELECT edge_type, count(*) AS n, round(avg(abs(target - source)), 6) AS mean_gap, CAST(max(abs(target - source)) AS DOUBLE) AS max_gap, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM e GROUP BY edge_type")
def a8(spark, sf):
    return posegraph.edge_stats(fx.edges(spark, sf))


@query("a11_translation_scale", f"WITH {POSES} SELECT round(coalesce(greatest(median(sqrt(x * x + y * y + z * z)), 0.001), 1.0), 6) AS scale FROM t WHERE sqrt(x * x + y * y + z * z) > 1e-8")
def a11(spark, sf):
    return posegraph.translation_scale(fx.poses(spark, sf)[0].select(norm(F.col("centre")).alias("length")))


@query("a25_components", f"WITH RECURSIVE {EDGES}, b AS (SELECT source AS s, target AS t FROM e UNION SELECT target, source FROM e), r AS (SELECT s AS node, s AS reach FROM b UNION SELECT r.node, b.t FROM r JOIN b ON r.reach = b.s) SELECT node, min(reach) AS anchor FROM r GROUP BY node")
def a25(spark, sf):
    return posegraph.anchors(fx.edges(spark, sf))


@query("st12_optimise")
def st12(spark, sf):
    d = posegraph.optimise(fx.map_poses(spark, sf), fx.measured_edges(spark, sf), iterations=30)
    return d.select("anchor", "node", *(F.get("centre", F.lit(i)).alias(c) for i, c in enumerate("xyz")), "rot", "cost_before", "cost_after")


#: The predictions' names and the lookup by name, then by stem or id, written from the rule and not from the operator.
J3 = """g AS (SELECT vec_id AS gt_index, 'frame_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS stem FROM embeddings),
    p AS (SELECT vec_id AS pred_index, vec_id % 13 <> 0 AS valid, 'frame_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS own, CASE WHEN vec_id % 3 = 0 THEN '.png' ELSE '.jpg' END AS suffix FROM embeddings WHERE vec_id % 11 <> 0),
    q AS (SELECT pred_index, valid, suffix, CASE WHEN pred_index % 7 = 0 THEN CAST(pred_index AS VARCHAR) ELSE own END AS stem,
        CASE WHEN pred_index % 7 = 0 OR pred_index % 5 = 0 THEN own ELSE 'id' || pred_index END AS id FROM p),
    n AS (SELECT stem || suffix AS name, pred_index FROM q), s AS (SELECT stem, pred_index FROM q UNION SELECT id, pred_index FROM q),
    r AS (SELECT gt_index, coalesce((SELECT min(pred_index) FROM n WHERE name = stem || '.jpg'), (SELECT min(pred_index) FROM s WHERE s.stem = g.stem)) AS pred_index FROM g)"""


@query("j3_match", f"WITH {J3} SELECT gt_index, r.pred_index, valid FROM r LEFT JOIN q ON q.pred_index = r.pred_index")
def j3(spark, sf):
    return matched(spark, sf).select("gt_index", "pred_index", "valid")


@query("a12_absolute_summary", f"WITH {POSES} SELECT count(*) AS n, round(sqrt(avg(translation_error ** 2)), 6) AS rmse, round(avg(translation_error), 6) AS mean, round(median(translation_error), 6) AS median, round(max(translation_error), 6) AS max FROM a")
def a12(spark, sf):
    return evaluate.summary(evaluate.absolute_errors(matched(spark, sf)), "translation_error")


@query("a13_accuracy", f"WITH {POSES}, x AS (SELECT unnest([5.0, 10.0, 20.0]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(CASE WHEN translation_error <= threshold THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a, x GROUP BY threshold")
def a13(spark, sf):
    return evaluate.accuracy(evaluate.absolute_errors(matched(spark, sf)), "translation_error", [5.0, 10.0, 20.0])


@query("a18_aligned_errors")
def a18(spark, sf):
    m = matched(spark, sf)
    return evaluate.absolute_errors(m, evaluate.align(m))


@query("j6_relative_errors", f"WITH {POSES} SELECT a.i AS src_index, b.i AS dst_index, CASE WHEN a.valid AND b.valid THEN NULL ELSE 'no_valid_prediction' END AS reason, CASE WHEN a.valid AND b.valid THEN round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 6) END AS gt_baseline, CASE WHEN a.valid AND b.valid THEN round(sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2 + (b.pz - a.pz) ** 2), 6) END AS pred_baseline, CASE WHEN a.valid AND b.valid THEN round(degrees(acos(((b.x - a.x) * (b.px - a.px) + (b.y - a.y) * (b.py - a.py) + (b.z - a.z) * (b.pz - a.pz)) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) / sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2 + (b.pz - a.pz) ** 2))), 4) END AS angle FROM t a JOIN t b ON b.i = a.i + 1")
def j6(spark, sf):
    d = evaluate.relative_errors(matched(spark, sf))
    return d.select("src_index", "dst_index", "reason", R6("gt_baseline"), R6("pred_baseline"), F.round("translation_angle_error_deg", 4).alias("angle"))


@query("a21_coverage", f"WITH {POSES} SELECT count(*) AS n_gt, count(*) FILTER (matched) AS n_matched, count(*) FILTER (valid) AS n_valid, round(count(*) FILTER (matched) / count(*), 6) AS matched_ratio, round(count(*) FILTER (valid) / count(*), 6) AS valid_ratio FROM t")
def a21(spark, sf):
    return evaluate.coverage(matched(spark, sf))


@query("a14_profile", f"WITH {LOGS}, u AS (SELECT status, 'total_time_sec' AS key, total_time_sec AS value FROM l UNION ALL SELECT status, 'batch_size', batch_size FROM l) SELECT status, key, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max, round(sum(value), 4) AS total FROM u GROUP BY status, key")
def a14(spark, sf):
    return reporting.profile(fx.logs(spark, sf), ["total_time_sec", "batch_size"])


@query("a15_run_summary", f"WITH {LOGS} SELECT count(*) AS batches, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status <> 'added') AS skipped, CAST(coalesce(sum(batch_size) FILTER (status = 'added'), 0) AS BIGINT) AS added_frames, round(avg(total_time_sec), 6) AS mean_sec, round(avg(total_time_sec) FILTER (status = 'added'), 6) AS mean_added_sec, round(avg(batch_size) FILTER (status = 'added'), 6) AS mean_added_size, round(max(total_time_sec), 6) AS max_sec FROM l")
def a15(spark, sf):
    return reporting.run_summary(fx.logs(spark, sf))


@query("a22_status_totals", f"WITH {LOGS} SELECT status, count(*) AS batches, CAST(sum(batch_size) AS BIGINT) AS frames, round(sum(total_time_sec), 4) AS seconds FROM l GROUP BY status")
def a22(spark, sf):
    return reporting.status_totals(fx.logs(spark, sf))


@query("a23_cumulative", f"WITH {LOGS} SELECT batch_id, CAST(sum(batch_size) OVER (ORDER BY batch_id) AS BIGINT) AS frames_so_far, count(*) OVER (ORDER BY batch_id) AS batches_so_far FROM l")
def a23(spark, sf):
    return reporting.cumulative(fx.logs(spark, sf))


@query("w7_triggers", f"WITH {LOGS}, c AS (SELECT batch_id, batch_size, CAST(sum(batch_size) OVER (ORDER BY batch_id) AS BIGINT) AS s FROM l) SELECT batch_id, s // 100 AS trigger FROM c WHERE s // 100 > (s - batch_size) // 100")
def w7(spark, sf):
    return reporting.triggers(fx.logs(spark, sf))


@query("t5_slowest", f"WITH {LOGS} SELECT batch_id, status, total_time_sec FROM l ORDER BY total_time_sec DESC, batch_id LIMIT 10")
def t5(spark, sf):
    return reporting.slowest(fx.logs(spark, sf))


@query("j9_neighbour_overlap", f"WITH {KNN}, o AS (SELECT query_id, list(ref_id) AS refs FROM k GROUP BY query_id) SELECT b.query_id, CAST(len(list_intersect(a.refs, b.refs)) AS BIGINT) AS shared FROM o a JOIN o b ON b.query_id = a.query_id + 1")
def j9(spark, sf):
    return retrieval.neighbour_overlap(retrieval.causal_knn(fx.frames(spark, sf)))


@query("a26_scene_extent", f"WITH {POINTS} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS centre_{c}' for c in 'xyz')}, {', '.join(f'round(max({c}) - min({c}), 6) AS extent_{c}' for c in 'xyz')} FROM p")
def a26(spark, sf):
    return points.scene_extent(fx.points(spark, sf))
