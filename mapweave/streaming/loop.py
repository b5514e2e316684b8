"""The incremental loop: micro-batches of frames against growing state tables, restart-safe by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapweave.functions.vectors import unit
from mapweave.operators.retrieval import earlier_knn, neighbor_evidence

STATE = "frame_id string, order_index long, descriptor array<double>, micro_batch long"
LOG = "micro_batch long, status string, batch_size long, added_frames long"


def read_state(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A state table; empty before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)


def step(frames: DataFrame, micro_batch: int, folder: str, k: int = 5, least_neighbors: int = 3, start: int = 30) -> None:
    """One micro-batch: drop frames already in the map, find neighbours among accepted ones, accept or skip, append.

    Each batch writes its own folder of each state table in overwrite mode, and reads only earlier batches, so a batch that
    runs again after a failure gives the same state."""
    spark = frames.sparkSession
    state = read_state(spark, folder, "frames", STATE).where(F.col("micro_batch") < micro_batch)
    fresh = frames.join(state.select("frame_id"), "frame_id", "left_anti").select("frame_id", "order_index", unit(F.col("descriptor").cast("array<double>")).alias("descriptor")).checkpoint()
    known, n = state.count(), fresh.count()
    if n == 0:
        status = "skipped_existing"
    elif known < start:
        status = "added"
    else:
        near = earlier_knn(fresh, state, k)
        evidence = neighbor_evidence(near, fresh.select(F.col("order_index").alias("query_id"), F.lit(micro_batch).alias("batch")), k).checkpoint()
        evidence.write.mode("overwrite").parquet(f"{folder}/evidence/micro_batch={micro_batch}")
        status = "added" if evidence.count() >= least_neighbors else "skipped_not_enough_neighbors"
    added = n if status == "added" else 0
    if added:
        fresh.write.mode("overwrite").parquet(f"{folder}/frames/micro_batch={micro_batch}")
    log = spark.range(1).select(F.lit(status).alias("status"), F.lit(n).cast("long").alias("batch_size"), F.lit(added).cast("long").alias("added_frames"))
    log.write.mode("overwrite").parquet(f"{folder}/logs/micro_batch={micro_batch}")


def start(frames: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs ``step`` on every micro-batch of a streaming DataFrame of frames until the available input is consumed."""
    writer = frames.writeStream.foreachBatch(lambda d, i: step(d, i, folder, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
