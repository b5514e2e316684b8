"""Map-shaped views over the driver's tables: frames, points, correspondences, poses, edges and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """select cast(floor(l_orderkey / 64) as bigint) as frame_no,
    row_number() over (partition by cast(floor(l_orderkey / 64) as bigint) order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as pt,
    l_partkey % 128 as px_row, l_suppkey % 96 as px_col, l_quantity as x, l_extendedprice / 1000.0 as y, l_discount * 100.0 as z, 1.0 - l_tax * 10.0 as conf
    from lineitem"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("frame_id"), F.col("vec_id").alias("order_index"), F.col("embedding").cast("array<double>").alias("descriptor"), "label"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POINTS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


def correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source points and the same under a known similarity (scale 1.25, 20 degrees about z); low confidence means +5 on x."""
    c, s = 0.9396926207859084, 0.3420201433256687
    p = points(spark, sf_dir)
    x = 1.25 * (c * F.col("x") - s * F.col("y")) + 0.4 + F.when(F.col("conf") < 0.4, 5.0).otherwise(0.0)
    return p.select(
        F.col("frame_no").alias("batch"), "pt", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), x.alias("tx"),
        (1.25 * (s * F.col("x") + c * F.col("y")) - 0.2).alias("ty"), (1.25 * F.col("z") + 0.7).alias("tz"), F.col("conf").alias("w"),
    )


def poses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(true, predicted): image name, centre and rotation (row-major) of every frame. Every seventh prediction is known by its
    frame id alone; some others have an id that equals their stem."""
    from mapweave.functions.vectors import quaternion_rotation

    e = lambda i: F.element_at("embedding", i).cast("double")
    d = read(spark, sf_dir, "embeddings")
    rot = quaternion_rotation(e(4), e(5), e(6), e(7)).alias("rot")
    name = F.concat(F.lit("strip/frame_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    true = d.select(F.col("vec_id").alias("gt_index"), F.concat(name, F.lit(".jpg")).alias("image_name"), F.array(*(100 * e(i) for i in (1, 2, 3))).alias("centre"), rot)
    at = F.array(*((100 * e(i) - i) / 2 + 0.01 * e(i + 7) for i in (1, 2, 3)))
    v = F.col("vec_id")
    suffix = F.when(v % 3 == 0, ".png").otherwise(".jpg")
    pred = d.where("vec_id % 11 <> 0").select(
        v.alias("pred_index"), F.when(v % 7 == 0, F.concat(F.lit("other/"), v.cast("string"), suffix)).otherwise(F.concat(name, suffix)).alias("image_path"),
        F.when((v % 7 == 0) | (v % 5 == 0), F.element_at(F.split(name, "/"), 2)).otherwise(F.concat(F.lit("id"), v.cast("string"))).alias("frame_id"),
        at.alias("centre"), rot, (v % 13 != 0).alias("valid"),
    )
    return true, pred


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "embeddings").select("vec_id")
    v = F.col("vec_id")
    near = d.where("vec_id % 7 <> 6").select(v.alias("source"), (v + 1).alias("target"), F.lit("local_continuity").alias("edge_type"), F.lit(1.0).alias("weight"))
    loop = d.where("vec_id % 35 = 0").select("vec_id", v + 70, F.lit("loop"), F.lit(3.0))
    return near.union(loop).join(d.select(v.alias("target")), "target", "left_semi").select("source", "target", "edge_type", "weight")


def map_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of the map (node, centre, rot): the true ones, moved a little and turned about z."""
    from mapweave.functions.vectors import compose, quaternion_rotation

    e = lambda i: F.element_at("embedding", i).cast("double")
    a = 0.2 * e(11)
    turn = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)))
    d = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.array(*(100 * e(i) + 0.5 * e(i + 7) for i in (1, 2, 3))).alias("centre"), quaternion_rotation(e(4), e(5), e(6), e(7)).alias("true"), turn.alias("turn"))
    return d.select("node", "centre", compose(F.col("turn"), F.col("true")).alias("rot"))


def measured_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the relative poses (rel_rot, rel_centre) of the true ones."""
    from mapweave.functions.transforms import relative

    true = poses(spark, sf_dir)[0]
    end = lambda name, s: true.select(F.col("gt_index").alias(name), F.col("rot").alias(f"{s}_rot"), F.col("centre").alias(f"{s}_centre"))
    d = edges(spark, sf_dir).join(end("source", "s"), "source").join(end("target", "t"), "target")
    rot, move = relative(F.col("s_rot"), F.col("s_centre"), F.col("t_rot"), F.col("t_centre"))
    return d.select("source", "target", "edge_type", "weight", rot.alias("rel_rot"), move.alias("rel_centre"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr(
        "case when event_type in ('purchase', 'view') then 'added' when event_type = 'click' then 'skipped_failed_validation' "
        "when event_type = 'error' then 'skipped_alignment_failed' else 'skipped_not_enough_neighbors' end"
    )
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), status.alias("status"), F.col("value").alias("total_time_sec"), (1 + F.col("user_id") % 5).alias("batch_size"))
