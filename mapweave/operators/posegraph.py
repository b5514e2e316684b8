"""Pose graph: edges of batches, weights, filters, statistics, components, optimisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.transforms import relative, rotation_log
from mapweave.functions.vectors import compose, dot, finite, minus, norm, rotate, transpose
from mapweave.operators.medians import exact_median
from mapweave.operators.online import steps
from mapweave.sources.tables import Tables


def batch_edges(members: DataFrame, loop_gap: int = 50) -> DataFrame:
    """Edges of batches (batch, frame, pos, is_ref): every reference to every new frame (a loop from ``loop_gap`` places
    apart, else a registration), and every pair of new frames. A batch has a bounded number of members."""
    ref, new = members.where("is_ref"), members.where("not is_ref")
    a = ref.select("batch", F.col("frame").alias("source"))
    b = new.select("batch", F.col("frame").alias("target"), F.col("pos").alias("pos_b"))
    cross = a.join(b, "batch").withColumn("edge_type", F.when(F.abs(F.col("source") - F.col("target")) >= loop_gap, "loop").otherwise("registration"))
    c = new.select("batch", F.col("frame").alias("source"), F.col("pos").alias("pos_a"))
    inner = c.join(b, "batch").where("pos_a < pos_b").withColumn("edge_type", F.lit("intra_batch"))
    return cross.select("batch", "source", "target", "edge_type").unionByName(inner.select("batch", "source", "target", "edge_type"))


def continuity(frames: DataFrame, least: float = 0.65, block: int = 4096) -> DataFrame:
    """Each frame with its predecessor and their similarity; linked if alike enough."""
    d = steps(frames.select("order_index", "descriptor"), block)
    s = F.round(dot(F.col("prev_descriptor"), F.col("descriptor")) / (norm(F.col("prev_descriptor")) * norm(F.col("descriptor"))), 6)
    return d.select(F.col("prev_order_index").alias("source"), F.col("order_index").alias("target"), s.alias("similarity")).withColumn("linked", F.col("similarity") >= least)


def edge_weight(ratio: Column, med: Column, n: Column, full: float = 1000.0) -> Column:
    """Weight of an alignment with ``n`` correspondences, this share of inliers and this median residual."""
    amount = F.least(F.lit(3.0), F.greatest(F.lit(0.5), F.sqrt(F.greatest(n, F.lit(1)) / full)))
    return F.greatest(F.lit(0.1), F.least(F.lit(5.0), amount * F.greatest(ratio, F.lit(0.1)) / (1 + F.greatest(med, F.lit(0.0)))))


def edge_residuals(nodes: DataFrame, edges: DataFrame, scale: DataFrame) -> DataFrame:
    """Edges (source, target, edge_type, weight, rel_rot, rel_centre) with residual: rotation vector and scaled translation of
    the difference between measured and present relative pose, times the root of the weight. ``scale`` is one row."""
    end = lambda name, s: nodes.select(F.col("node").alias(name), F.col("rot").alias(f"{s}_rot"), F.col("centre").alias(f"{s}_centre"))
    d = edges.join(end("source", "s"), "source").join(end("target", "t"), "target").join(F.broadcast(scale))
    # Step by step: an array expression that is named several times in another would be computed as often.
    rot, move = relative(F.col("s_rot"), F.col("s_centre"), F.col("t_rot"), F.col("t_centre"))
    d = d.select("source", "target", "edge_type", "weight", "scale", "rel_rot", "rel_centre", rot.alias("p_rot"), move.alias("p_centre"))
    back = transpose(F.col("rel_rot"))
    d = d.select("source", "target", "edge_type", "weight", "scale", compose(back, F.col("p_rot")).alias("turn"), rotate(back, minus(F.col("p_centre"), F.col("rel_centre"))).alias("off"))
    w = F.sqrt(F.greatest(F.col("weight"), F.lit(1e-6)))
    r = F.concat(rotation_log(F.col("turn")), F.transform("off", lambda x: x / F.greatest(F.col("scale"), F.lit(1e-8))))
    return d.select("source", "target", "edge_type", "weight", F.transform(r, lambda x: x * w).alias("residual"))


def residual_stats(residuals: DataFrame) -> DataFrame:
    """Mean, median and maximum of the sizes of all residual components, by edge type and over all (type "all")."""
    d = residuals.select("edge_type", F.explode("residual").alias("r")).select(F.explode(F.array("edge_type", F.lit("all"))).alias("edge_type"), F.abs("r").alias("r"))
    r5 = lambda c, name: F.round(c, 5).alias(name)
    sums = d.groupBy("edge_type").agg(F.count("*").alias("n"), r5(F.avg("r"), "mean"), r5(F.max("r"), "max"))
    return sums.join(exact_median(d, "r", ("edge_type",)).select("edge_type", r5(F.col("median"), "median")), "edge_type")


def debug_tables(edges: DataFrame, order: DataFrame, loop_gap: int = 50) -> DataFrame:
    """Edges with frame_distance (null where an end has no place in the order: node, order_index) and is_loop."""
    place = lambda end: order.select(F.col("node").alias(end), F.col("order_index").alias(f"{end}_at"))
    d = edges.join(place("source"), "source", "left").join(place("target"), "target", "left").withColumn("frame_distance", F.abs(F.col("target_at") - F.col("source_at")))
    loop = (F.col("edge_type") == "loop") | F.coalesce(F.col("frame_distance") >= loop_gap, F.lit(False))
    return d.select("source", "target", "edge_type", "weight", "frame_distance", loop.alias("is_loop"))


def plot_edges(edges: DataFrame, most: int = 1500, block: int = 4096) -> DataFrame:
    """All loops, and of the other edges, in order of source and target, every n-th, so that at most ``most`` are left. Places
    are counted in blocks of sources and added up over the blocks."""
    other = edges.where("edge_type <> 'loop'").withColumn("_b", F.floor(F.col("source") / block))
    sizes = other.groupBy("_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.orderBy("_b")) - F.col("_c")  # one row a block
    sizes = sizes.select("_b", before.alias("_before"), F.sum("_c").over(W.partitionBy(F.lit(0))).alias("_n"))
    other = other.join(sizes, "_b").withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("source", "target")) - 1)
    return other.where(F.col("_at") % F.ceil(F.col("_n") / most) == 0).select(*edges.columns).unionByName(edges.where("edge_type = 'loop'"))


def usable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different known nodes, and with finite relative poses where they have rel_rot and rel_centre."""
    for c in {"rel_rot", "rel_centre"} & set(edges.columns):
        edges = edges.where(F.coalesce(F.forall(c, lambda x: finite(x)), F.lit(False)))
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges.where("source <> target").select("source", "target", "edge_type", "weight")


def edge_stats(edges: DataFrame) -> DataFrame:
    """Count, distance of ids and weight by edge type (residuals: ``residual_stats``)."""
    gap = F.abs(F.col("target") - F.col("source")).cast("double")
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("mean_gap"), F.max(gap).alias("max_gap"), F.round(F.sum("weight"), 6).alias("weight"))


def translation_scale(t: DataFrame, digits: int | None = 6) -> DataFrame:
    """Median length above 1e-8 of finite translations (length), at least 1e-3; 1 without any."""
    d = exact_median(t.where(finite(F.col("length")) & (F.col("length") > 1e-8)), "length")
    scale = F.coalesce(F.greatest("median", F.lit(1e-3)), F.lit(1.0))
    return d.select((scale if digits is None else F.round(scale, digits)).alias("scale"))


def anchors(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, anchor): the smallest node of each component, by minimum labels with pointer jumping; each round is a
    written table."""
    tables = Tables(edges.sparkSession)
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source")).distinct()
    both = tables.write(both, "both")
    labels = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        low = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        new = labels.join(low, labels["node"] == low["a"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = tables.write(new.join(of, new["label"] == of["at"]).select("node", "old", F.col("next").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            tables.keep_only("labels")
            return labels.select("node", F.col("label").alias("anchor"))
    raise RuntimeError("components did not settle")


def optimise(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """Optimised poses (anchor, node, centre, rot) of the nodes that have usable edges, with cost_before and cost_after of all:
    see ``pose_optimizer``, which also says how the run went. Edges are those of ``edge_residuals``."""
    from mapweave.operators.pose_optimizer import optimise as run

    poses, summary = run(nodes, edges, **options)
    costs = (F.lit(float(summary[f"{c}_cost"])).alias(name) for c, name in (("initial", "cost_before"), ("final", "cost_after")))
    return poses.join(anchors(edges), "node").select("anchor", "node", "centre", "rot", *costs)
