"""A corpus pipeline: toxicity filter, line dedup, near dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. A document that line dedup leaves without any text is dropped; one without text from the start stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontaminate, lines, near, packing, toxicity
from mapweave.llm.common import discard, fingerprint, temporary_tables, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.remove(docs, toxicity.train(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.remove(docs, numbers="__dropped")
    changed = F.size("__dropped") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near.near_groups(docs).where("not kept").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(found, (docs["doc_id"] == F.col("__id")) & (fingerprint(docs["text"]) == F.col("__hash")), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), what="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontamination", drop_benchmark), ("packing", pack)]

#: Toxicity is a trained model and packing needs a tokeniser, which SQL cannot express; tests hold the chain against a plain version on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread, and deleted when the next is there."""
    out, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary_tables():
            out = written(stage(spark, out, sf_dir), f"stage-{name}", keep=True)
        if before is not None:
            discard(before)
        before = out
    return STAGES[-1][1](spark, out, sf_dir)
