"""Batching as a stream, against the plain loop over one stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mapweave.operators import retrieval
from mapweave.sources import fixtures
from mapweave.streaming import batching

RULES = {"k": 20, "dominant": 20, "ratio_min": 0.1, "similarity_min": 0.25}


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("batching")))
    f = fixtures.frames(spark, "/root/testdata/sf0.001").where("order_index < 160").withColumn("half", F.floor(F.col("order_index") / 90))
    near = retrieval.causal_knn(f, 24).persist()
    want = {h: rows(retrieval.dynamic_batches(f.where(F.col("half") == h), near, **RULES)) for h in (0, 1)}
    return f, near, want


def rows(d):
    return sorted((r.batch_id, r.pos, r.frame, r.closed_by) for r in d.collect())


def test_whole_tables(given):
    f, near, want = given
    for chunk in (4096, 33):
        got = batching.batches_of(f, near, "half", chunk, **RULES).persist()
        assert {h: rows(got.where(F.col("stream") == h)) for h in (0, 1)} == want


def test_any_order_and_a_restart(spark, given, tmp_path):
    f, near, want = given
    d = batching.placed(f, near, "half").persist()

    def run():
        source = spark.readStream.schema(batching.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        w = batching.batch_stream(source, **RULES).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check"))
        assert w.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)

    d.where("place >= 60").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # what comes too early waits
    d.where("place between 20 and 25").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.schema(batching.OUTPUT).parquet(str(tmp_path / "out")).count() == 0
    d.where("place < 60").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # some of it again
    run()  # goes on from the checkpoint
    got = spark.read.schema(batching.OUTPUT).parquet(str(tmp_path / "out"))
    assert {h: rows(got.where(F.col("stream") == h)) for h in (0, 1)} == want
