"""Readers of pose files and image listings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.vectors import minus, quaternion_rotation, rotate, transpose


def image_paths(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """(order_index, path) of the images in a folder, by path; suffixes in any case. ``limit`` <= 0: all."""
    d = spark.read.format("binaryFile").load(folder).select("path").where(F.col("path").rlike(r"(?i)\.(jpg|jpeg|png)$"))
    d = d.orderBy("path").limit(limit) if limit > 0 else d
    names = d.withColumn("folder", F.regexp_replace("path", "[^/]*$", ""))
    return names.select((F.row_number().over(W.partitionBy("folder").orderBy("path")) - 1).alias("order_index"), "path")


def text_poses(spark: SparkSession, path: str) -> DataFrame:
    """Poses of a text file: id, quaternion wxyz, translation, camera id, name (may hold spaces) a line. Lines that are
    blank, comments or do not parse are skipped; no pose at all is an error. Centre and rotation are camera to world."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "t"))
    d = d.where((F.trim("t") != "") & ~F.startswith(F.trim("t"), F.lit("#"))).select("line", F.split(F.trim("t"), r"\s+").alias("p")).where(F.size("p") >= 10)
    num = [F.get("p", F.lit(i)).try_cast("double") for i in range(1, 8)]
    d = d.select("line", F.get("p", F.lit(0)).try_cast("long").alias("image_id"), F.get("p", F.lit(8)).try_cast("long").alias("camera_id"), F.array(*num).alias("n"), F.array_join(F.slice("p", 10, 100000), " ").alias("image_name"))
    d = d.where(F.col("image_id").isNotNull() & F.col("camera_id").isNotNull() & F.forall("n", lambda x: x.isNotNull()))
    g = lambda i: F.get("n", F.lit(i))
    d = d.select("line", "image_id", "camera_id", "image_name", transpose(quaternion_rotation(g(0), g(1), g(2), g(3))).alias("rot"), F.slice("n", 5, 3).alias("t"))
    d = d.select("line", "image_id", "camera_id", "image_name", minus(F.array(*[F.lit(0.0)] * 3), rotate(F.col("rot"), F.col("t"))).alias("centre"), "rot")
    none = d.groupBy().agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit("no pose in the file"))).cast("string").alias("e"))
    return F.broadcast(none).join(d, F.col("e").isNull(), "left").where("line is not null").drop("e")


def array_poses(spark: SparkSession, path: str) -> DataFrame:
    """Poses of NPZ files (frame_ids, image_paths, cam2world, optional valid); no pickled objects are read. Poses that are
    not finite are invalid."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for content in g.content:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                m = z["cam2world"].astype(float)
                if m.ndim != 3 or m.shape[1:] != (4, 4) or len(m) != len(z["frame_ids"]):
                    raise ValueError(f"poses of shape {m.shape}")
                ok = np.isfinite(m).all((1, 2)) & (z["valid"].astype(bool) if "valid" in z else True)
                yield pd.DataFrame({
                    "pred_index": np.arange(len(m)), "frame_id": z["frame_ids"].astype(str), "image_path": z["image_paths"].astype(str),
                    "centre": list(m[:, :3, 3]), "rot": list(m[:, :3, :3].reshape(-1, 9)), "valid": ok,
                })

    schema = "pred_index long, frame_id string, image_path string, centre array<double>, rot array<double>, valid boolean"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)
