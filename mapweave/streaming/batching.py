"""Content-defined batches of frames as a stateful stream.

The state of an image stream is small whatever its length: the members of the open batch (their descriptors), how often and
how well each reference was named by them, where the batch began, and the place of the next frame. Frames that arrive before
their turn wait in the state, so the result does not depend on how the input is cut into micro-batches; with a checkpoint a
run that is stopped goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mapweave.functions.vectors import unit
from mapweave.sources.tables import Tables

INPUT = "stream long, place long, frame long, v array<double>, refs array<long>, scores array<double>, last boolean"
OUTPUT = "stream long, batch_id long, frame long, closed_by string, pos int"


class OpenBatch:
    """The batch that is being formed, and what decides who joins it."""

    def __init__(self, k: int, max_size: int, dominant: int, overlap_min: int, ratio_min: float, similarity_min: float, saved: str | None = None):
        self.k, self.max_size, self.dominant = k, max_size, dominant
        self.overlap_min, self.ratio_min, self.similarity_min = overlap_min, ratio_min, similarity_min
        self.next, self.batch, self.seed = 0, 0, None
        self.frames, self.members = [], []
        self.counts: dict[int, tuple[int, float, float]] = {}
        self.waiting: dict[int, tuple] = {}
        if saved:
            s = json.loads(saved)
            self.next, self.batch, self.seed, self.frames, self.members = (s[c] for c in ("next", "batch", "seed", "frames", "members"))
            self.counts = {i: tuple(c) for i, c in s["counts"]}
            self.waiting = {i: tuple(x) for i, x in s["waiting"]}

    def saved(self) -> str:
        return json.dumps({
            "next": self.next, "batch": self.batch, "seed": self.seed, "frames": self.frames, "members": self.members,
            "counts": list(self.counts.items()), "waiting": list(self.waiting.items()),
        })

    def _fits(self, v: list[float], refs: dict[int, float]) -> bool:
        top = sorted(self.counts, key=lambda i: (-self.counts[i][0], -self.counts[i][1], -self.counts[i][2], i))[: max(1, self.dominant)]
        overlap = len(set(top) & set(refs))
        alike = max(float(np.dot(v, m)) for m in self.members)
        return overlap >= self.overlap_min and (alike >= self.similarity_min or overlap / max(1, len(top)) >= self.ratio_min)

    def _close(self, why: str) -> list[tuple]:
        rows = [(self.batch, f, why if n == len(self.frames) else "", n) for n, f in enumerate(self.frames, 1)]
        self.batch, self.frames, self.members, self.counts, self.seed = self.batch + 1, [], [], {}, None
        return rows

    def take(self, place: int, frame: int, v: list[float], refs: list[int], scores: list[float], last: bool) -> list[tuple]:
        """Rows (batch, frame, closed_by, pos) of the batches that this frame and those that waited for it close."""
        self.waiting[place] = (frame, v, refs, scores, last)
        rows = []
        while self.next in self.waiting:
            frame, v, refs, scores, last = self.waiting.pop(self.next)
            self.next += 1
            near = list(zip(refs, scores, strict=True))
            mine = dict([x for x in near if self.seed is None or x[0] < self.seed][: self.k])
            if self.frames:
                full = len(self.frames) >= self.max_size
                if full or not self._fits(v, mine):
                    rows += self._close("reached_max_batch_size" if full else "next_frame_incompatible")
                    mine = dict(near[: self.k])
            self.seed = frame if self.seed is None else self.seed
            self.frames.append(frame)
            self.members.append(v)
            for i, s in mine.items():
                n, total, most = self.counts.get(i, (0, 0.0, -1.0))
                self.counts[i] = (n + 1, total + s, max(most, s))
            if last:
                rows += self._close("end_of_sequence")
        return rows


def batch_stream(
    frames: DataFrame, k: int = 5, max_size: int = 5, dominant: int = 5, overlap_min: int = 2, ratio_min: float = 0.4, similarity_min: float = 0.75
) -> DataFrame:
    """``retrieval.dynamic_batches`` over a streaming DataFrame of INPUT: place counts a stream's frames from 0 without gaps, last
    marks its end, refs are its k + max_size - 1 nearest earlier frames, best first. A batch's rows come when it is closed."""
    rules = (k, max_size, dominant, overlap_min, ratio_min, similarity_min)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = OpenBatch(*rules, saved=state.get[0] if state.exists else None)
        rows = []
        for g in batches:
            for r in g.sort_values("place").itertuples():
                if r.place >= open_.next:  # a frame that was taken already comes again
                    some = [[] if x is None else list(x) for x in (r.v, r.refs, r.scores)]
                    rows += open_.take(int(r.place), int(r.frame), [float(x) for x in some[0]], [int(x) for x in some[1]], [float(x) for x in some[2]], bool(r.last))
        state.update((open_.saved(),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["stream", "batch_id", "frame", "closed_by", "pos"])

    return frames.groupBy("stream").applyInPandasWithState(step, OUTPUT, "saved string", "append", GroupStateTimeout.NoTimeout)


def placed(frames: DataFrame, neighbors: DataFrame, sequence: str | None = None, block: int = 4096) -> DataFrame:
    """INPUT from frames (order_index, descriptor) and a search's neighbors (query_id, ref_id, score, rank). Places are counted in
    blocks of the order and added up over the blocks, so no task orders a stream."""
    near = neighbors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "score"))).alias("near"))
    part = F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")
    d = frames.select(part.alias("stream"), F.col("order_index").cast("long").alias("frame"), unit(F.col("descriptor").cast("array<double>")).alias("v"))
    d = d.withColumn("block", F.floor(F.col("frame") / block))
    sizes = d.groupBy("stream", "block").agg(F.count("*").alias("n"))
    w = W.partitionBy("stream").orderBy("block")  # one row a block
    sizes = sizes.select("stream", "block", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy("stream")).alias("all"))
    d = d.join(sizes, ["stream", "block"]).withColumn("place", F.col("before") + F.row_number().over(W.partitionBy("stream", "block").orderBy("frame")) - 1)
    d = d.join(near, d["frame"] == near["query_id"], "left")
    return d.select("stream", "place", "frame", "v", F.col("near.ref_id").alias("refs"), F.col("near.score").alias("scores"), (F.col("place") == F.col("all") - 1).alias("last"))


def batches_of(frames: DataFrame, neighbors: DataFrame, sequence: str | None = None, chunk: int = 4096, **rules) -> DataFrame:
    """The batches of whole tables, by the same stream: its input is written in files of about ``chunk`` frames in order, each
    micro-batch takes one, and the result is a table. So a task holds a chunk, not a stream."""
    spark, tables = frames.sparkSession, Tables(frames.sparkSession)
    ready = tables.write(placed(frames, neighbors, sequence), "placed")
    files = max(1, -(-ready.count() // chunk))
    ready.repartitionByRange(files, "place", "stream").write.parquet(f"{tables.folder}/chunks")
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(f"{tables.folder}/chunks")
    out = batch_stream(stream, **rules).writeStream.format("parquet").outputMode("append")
    out = out.option("checkpointLocation", f"{tables.folder}/progress").trigger(availableNow=True).start(f"{tables.folder}/batches")
    out.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{tables.folder}/batches")
