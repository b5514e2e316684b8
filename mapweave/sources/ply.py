"""Point clouds as binary PLY: as one file from the driver, or by the data source "ply" as a folder of files, one a task.

``points.write.format("ply").mode("append").save(folder)``, after ``register(spark)``, writes x, y, z and, where they are there,
red, green, blue. Each task writes a file of its own in a hidden folder of the job; they move when all have succeeded, and
go with that folder when the job fails. A task that outlives its job finds it gone, so a failed write leaves no file. The folder
must be one that all machines share. Overwriting replaces the PLY files that the folder had."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from mapweave.functions.vectors import finite

#: Fixed values of the vertex format.
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
NAMES = {"f4": "float", "u1": "uchar"}


def header(n: int) -> bytes:
    fields = "".join(f"property {NAMES[VERTEX[c].str[1:]]} {c}\n" for c in VERTEX.names)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{fields}end_header\n".encode()


def parts(points: DataFrame) -> DataFrame:
    """(part, nth, vertices, payload): encoded finite points, a row for each Arrow batch."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(batches):
            out = np.zeros(b.num_rows, VERTEX)
            for c in VERTEX.names:
                out[c] = b.column(c).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([b.column("part")[0].as_py()], pa.int32()), pa.array([i]), pa.array([len(out)]), pa.array([out.tobytes()])], names=["part", "nth", "vertices", "payload"])

    colours = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in VERTEX.names[3:]]
    d = points.where(finite(*(F.col(c) for c in "xyz"))).select(F.spark_partition_id().alias("part"), "x", "y", "z", *colours)
    return d.mapInArrow(encode, "part int, nth long, vertices long, payload binary")


def write(points: DataFrame, path: str) -> int:
    """One PLY file on the driver's file system, streamed part by part; returns the number of vertices."""
    d = parts(points).persist()
    n = d.agg(F.sum("vertices")).first()[0] or 0
    with open(path, "wb") as f:
        f.write(header(n))
        for row in d.orderBy("part", "nth").toLocalIterator():
            f.write(row.payload)
    d.unpersist()
    return n


def write_distributed(points: DataFrame, folder: str) -> None:
    """The encoded parts and their vertex counts as Parquet, for clouds that no single machine should write."""
    parts(points).write.mode("overwrite").parquet(folder)


@dataclass
class Written(WriterCommitMessage):
    name: str
    vertices: int


class PlyWriter(DataSourceArrowWriter):
    """Writes the files of one job."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        self.hidden = os.path.join(folder, f".{self.job}")
        os.makedirs(self.hidden)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, n = f"{self.job}-{uuid.uuid4().hex}.ply", 0
        path = os.path.join(self.hidden, name)
        room = len(header(2**62)) + len("comment \n")
        with open(path, "wb") as f:
            f.write(b" " * room)
            for batch in iterator:
                columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
                out = np.zeros(batch.num_rows, VERTEX)
                ok = np.ones(batch.num_rows, bool)
                for c in VERTEX.names:
                    values = np.nan_to_num(columns[c].astype(float)) if c in columns and c not in "xyz" else columns.get(c)
                    if values is not None:
                        ok &= np.isfinite(values.astype(float)) if c in "xyz" else True
                        with np.errstate(invalid="ignore"):
                            out[c] = values
                f.write(out[ok].tobytes())
                n += int(ok.sum())
            f.seek(0)
            f.write(self._padded(n, room))
        return Written(name, n)

    @staticmethod
    def _padded(n: int, room: int) -> bytes:
        """The header for n vertices at a fixed length: a comment fills it up."""
        plain = header(n)
        fill = b"comment " + b"-" * (room - len(plain) - len(b"comment \n")) + b"\n"
        return plain.replace(b"element vertex", fill + b"element vertex")

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for x in os.listdir(self.folder):
                if x.endswith(".ply") and not x.startswith("."):
                    os.remove(os.path.join(self.folder, x))
        for m in messages:
            if m is not None and m.vertices:
                os.rename(os.path.join(self.hidden, m.name), os.path.join(self.folder, m.name))
        self.abort(messages)  # a task that ran twice has left a second file

    def abort(self, messages: list[Written | None]) -> None:
        """Renames the hidden folder before it empties it, so that a task still running puts nothing new there."""
        if os.path.isdir(self.hidden):
            gone = f"{self.hidden}-gone"
            os.rename(self.hidden, gone)
            shutil.rmtree(gone)


class Ply(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        if not {"x", "y", "z"} <= set(schema.names):
            raise ValueError("a cloud needs x, y and z")
        return PlyWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ply)


def read_folder(folder: str) -> np.ndarray:
    """The vertices of all files of a folder that the data source has written (for small clouds)."""
    out = [np.zeros(0, VERTEX)]
    for x in sorted(os.listdir(folder)):
        if x.endswith(".ply") and not x.startswith("."):
            with open(os.path.join(folder, x), "rb") as f:
                head, body = f.read().split(b"end_header\n", 1)
            n = int(head.split(b"element vertex ")[1].split(b"\n")[0])
            out.append(np.frombuffer(body, VERTEX, n))
            if len(body) != n * VERTEX.itemsize:
                raise ValueError(f"{x} holds other than {n} vertices")
    return np.concatenate(out)
