"""Run reports over batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status_totals(logs: DataFrame) -> DataFrame:
    return logs.groupBy("status").agg(F.count("*").alias("batches"), F.sum("batch_size").alias("frames"), F.round(F.sum("total_time_sec"), 4).alias("seconds"))


def run_summary(logs: DataFrame) -> DataFrame:
    """One row of conditional counts and means, zero where nothing counts."""
    added, t = F.col("status") == "added", F.col("total_time_sec")
    mean = lambda c, when: F.round(F.coalesce(F.avg(F.when(when, c)), F.lit(0.0)), 6)
    return logs.agg(
        F.count("*").alias("batches"), F.count_if(added).alias("added"), F.count_if(~added).alias("skipped"), F.coalesce(F.sum(F.when(added, F.col("batch_size"))), F.lit(0)).alias("added_frames"),
        mean(t, F.lit(True)).alias("mean_sec"), mean(t, added).alias("mean_added_sec"), mean(F.col("batch_size").cast("double"), added).alias("mean_added_size"), F.round(F.max(t), 6).alias("max_sec"),
    )


def profile(logs: DataFrame, values: list[str], by: str = "status") -> DataFrame:
    """Numeric columns unpivoted to keys, rolled up by group: count, mean, min, max, total of finite values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("key"), F.col(v).cast("double").alias("value")) for v in values))).alias("p")
    d = logs.select(by, pairs).select(by, "p.*").where(F.abs("value") < float("inf"))
    r = lambda c: F.round(c, 4)
    return d.groupBy(by, "key").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.sum("value")).alias("total"))


def slowest(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.select("batch_id", "status", "total_time_sec").orderBy(F.desc("total_time_sec"), "batch_id").limit(n)


def cumulative(logs: DataFrame, block: int = 4096) -> DataFrame:
    """Frames and batches up to and with each batch: sums inside blocks of ids plus the sums of earlier blocks, so no task
    sorts the whole log (the second window is over one row a block)."""
    d = logs.withColumn("block", F.floor(F.col("batch_id") / block))
    sums = d.groupBy("block").agg(F.sum("batch_size").alias("s"), F.count("*").alias("c"))
    w = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("block", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s0"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"))
    own = W.partitionBy("block").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("s", F.sum("batch_size").over(own)).withColumn("c", F.count("*").over(own)).join(before, "block")
    return d.select("batch_id", (F.col("s0") + F.col("s")).alias("frames_so_far"), (F.col("c0") + F.col("c")).alias("batches_so_far"))


def triggers(logs: DataFrame, interval: int = 100) -> DataFrame:
    """Batches at which the running number of frames passes a multiple of ``interval``."""
    d = cumulative(logs).join(logs.select("batch_id", "batch_size"), "batch_id")
    step = lambda c: F.floor(c / interval)
    return d.where(step(F.col("frames_so_far")) > step(F.col("frames_so_far") - F.col("batch_size"))).select("batch_id", step(F.col("frames_so_far")).alias("trigger"))


def nested_profile(logs: DataFrame, column: str, by: str = "status") -> DataFrame:
    """Numbers of a JSON object, with keys "column.key", rolled up by group; values that are no finite numbers are left out."""
    d = logs.select(by, F.explode(F.from_json(column, "map<string,string>")).alias("key", "text")).select(by, F.concat(F.lit(f"{column}."), "key").alias("key"), F.col("text").try_cast("double").alias("value"))
    d = d.where(F.abs("value") < float("inf"))
    r = lambda c: F.round(c, 4)
    return d.groupBy(by, "key").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.sum("value")).alias("total"))


def compute_time(logs: DataFrame, start: float = 0.0, block: int = 4096) -> DataFrame:
    """Seconds from ``start`` up to and with each batch; negative and missing times count as none. Blocks as in ``cumulative``."""
    t = F.greatest(F.lit(0.0), F.coalesce("total_time_sec", F.lit(0.0)))
    d = logs.select("batch_id", t.alias("t"), F.floor(F.col("batch_id") / block).alias("block"))
    w = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy("block").agg(F.sum("t").alias("s")).select("block", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s0"))
    own = F.sum("t").over(W.partitionBy("block").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("s", own).join(before, "block").select("batch_id", F.round(start + F.col("s0") + F.col("s"), 4).alias("seconds_so_far"))
