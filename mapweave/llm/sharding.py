"""Contiguous, byte-balanced shards from global prefix sums.

Rows (id and size, not texts) are range-partitioned by id. Per-partition totals, one row a partition, give each
partition's offset; a running sum inside the partition gives each row's place in the whole. A row goes to the shard that
holds the middle of its bytes, so shard sizes differ from the equal target by no more than about one document.

Defined results: null texts have one byte (the terminator); rows with equal ids stay in a fixed order by size and
checksum; rows without an id come first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, size (UTF-8 bytes + 1), text_crc32, shard, slot (place in its shard, from 0)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "id", "size", "text_crc32", "tie")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "ranged")

    in_order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row a partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select(
        F.col("part").alias("of"), F.coalesce(F.sum("bytes").over(in_order), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("rows").over(in_order), F.lit(0)).alias("rows0"), F.sum("bytes").over(W.partitionBy(F.lit(0))).alias("total"),
    )
    w = W.partitionBy("part").orderBy("id", "size", "text_crc32", "tie")
    placed = ranged.select(
        "id", "size", "text_crc32", "part",
        F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.row_number().over(w) - 1).alias("nth"),
    ).join(F.broadcast(totals), F.col("part") == F.col("of"))  # one row a partition
    shard = F.expr(f"least(((bytes0 + before) * 2 + size) * {int(shards)} div (total * 2), {int(shards) - 1})").cast("int")
    placed = written(placed.select("id", "size", "text_crc32", shard.alias("shard"), (F.col("rows0") + F.col("nth")).alias("place")), "placed")
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(first), F.col("shard") == F.col("s"))  # one row a shard
    return out.select("id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))
