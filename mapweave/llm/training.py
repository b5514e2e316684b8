"""What both classifiers share: the labelled sample, and who is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents that are not held out, those with the smallest hash of the id,
    whole texts of any length. One row an id: of texts that share one, that with the smallest hash; of labels, the largest. So
    the bound on rows holds whatever repeats, and the sample's ids are broadcast."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = docs.select(F.col("doc_id").alias("of"), "text").where("text is not null")
    found = d.join(F.broadcast(some), F.col("of") == F.col("doc_id")).groupBy("doc_id", "y")
    return found.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")
