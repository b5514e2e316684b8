"""Similarity search over earlier frames, neighbour evidence of batches, and content-defined batching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.vectors import finite, unit


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def causal_knn(frames: DataFrame, k: int = 5, block: int = 1024, digits: int = 6) -> DataFrame:
    """For each frame the ``k`` most similar earlier ones by cosine: query_id, ref_id, score, rank. Ties: smaller ref.

    Frames are cut into at most ``TILES`` spans of consecutive order, of at least ``block`` and at most ``WIDE`` frames (of
    longer tables there are more spans); a task compares one span of queries with one of references, in small matrices, and
    keeps the best ``k`` of each query. So a frame reaches the shuffle a bounded number of times, with at most k rows a query
    and span, and no side is broadcast. The comparisons grow with the square of the frames, as every pair is asked for.
    Frames without a descriptor, or with one that is not finite, are neither found nor asked for; descriptors of different
    lengths are not compared."""
    return earlier_knn(frames, frames, k, block, digits)


TILES, WIDE = 16, 65_536


def _nearest(queries: np.ndarray, x: np.ndarray, refs: np.ndarray, y: np.ndarray, k: int, digits: int, rows: int = 1024, cols: int = 4096) -> pd.DataFrame:
    """The best ``k`` earlier references of each query. Both are in order, so a later reference must beat the k-th best so far;
    most do not, and only those that may are rounded and sorted."""
    out = []
    for i in range(0, len(queries), rows):
        q, a = queries[i : i + rows], x[i : i + rows]
        low = np.full(len(q), -np.inf)
        at, score, ref = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for j in range(0, len(refs), cols):
            r = refs[j : j + cols]
            if r[0] >= q[-1]:
                break
            s = a @ y[j : j + cols].T
            if r[-1] >= q[0]:
                s[r[None, :] >= q[:, None]] = -np.inf
            least, some = low.copy(), np.isneginf(low)
            if some.any() and len(r) > k:  # what rounds to a tie with the k-th stays in
                least[some] = np.maximum(-np.inf, np.partition(s[some], -k, axis=1)[:, -k] - 10.0**-digits)
            n, c = np.nonzero(s > least[:, None])
            at, score, ref = np.concatenate([at, n]), np.concatenate([score, np.round(s[n, c], digits)]), np.concatenate([ref, r[c]])
            order = np.lexsort((ref, -score, at))
            at, score, ref = at[order], score[order], ref[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            at, score, ref, place = at[place < k], score[place < k], ref[place < k], place[place < k]
            last = place == k - 1
            low[at[last]] = score[last]
        out.append(pd.DataFrame({"query_id": q[at], "ref_id": ref, "score": score}))
    return pd.concat(out)


def earlier_knn(asked: DataFrame, known: DataFrame, k: int = 5, block: int = 1024, digits: int = 6) -> DataFrame:
    """``causal_knn`` of the frames ``asked`` among ``known``; of those, a span goes only to the spans asked for."""
    ids = known.where("order_index is not null").select(F.col("order_index").cast("long").alias("id"))
    tiles = max(1, min(-(-ids.count() // block), max(TILES, -(-ids.count() // WIDE))))
    cuts = ids.approxQuantile("id", [i / tiles for i in range(1, tiles)], 0.01 / tiles) if tiles > 1 else []
    cuts = sorted({int(c) for c in cuts})
    tiles = len(cuts) + 1
    ends = asked.agg(F.min("order_index").alias("low"), F.max("order_index").alias("top")).first()
    if ends.low is None:
        ends = Row(low=0, top=0)
    low, top = (int(np.searchsorted(cuts, e, "right")) for e in (ends.low, ends.top))

    def spans(frames: DataFrame) -> DataFrame:
        ok = F.col("order_index").isNotNull() & F.coalesce(F.forall("descriptor", lambda x: finite(x)), F.lit(False))
        d = frames.where(ok).select(F.col("order_index").cast("long").alias("id"), unit(F.col("descriptor").cast("array<double>")).alias("v"))
        own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
        return d.withColumn("own", own).withColumn("n", F.size("v"))

    parts = min(1000, 3 * tiles * (tiles + 1) // 2) if tiles > 1 else 1
    queries = spans(asked).select(F.col("own").alias("q"), F.explode(F.sequence(F.lit(0), "own")).alias("r"), "n", "id", "v").repartition(parts, "q", "r", "n")
    refs = spans(known).where(F.col("own") <= top).select(F.explode(F.sequence(F.greatest("own", F.lit(low)), F.lit(top))).alias("q2"), F.col("own").alias("r2"), F.col("n").alias("n2"), "id", "v").repartition(parts, "q2", "r2", "n2")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "ref_id": [], "score": []})
        a, b = a.sort_values("id"), b.sort_values("id")
        return _nearest(a.id.to_numpy(), np.stack(a.v.to_list()), b.id.to_numpy(), np.stack(b.v.to_list()), k, digits)

    found = queries.groupBy("q", "r", "n").cogroup(refs.groupBy("q2", "r2", "n2")).applyInPandas(best, "query_id long, ref_id long, score double")
    return _best(found, k)


def neighbor_evidence(neighbors: DataFrame, batch_of: DataFrame, k: int = 5) -> DataFrame:
    """References of a batch by how many of its frames name them, then by sum, maximum and reciprocal ranks, then id."""
    d = neighbors.join(batch_of, "query_id")
    d = d.groupBy("batch", "ref_id").agg(
        F.count("*").alias("hits"), F.round(F.sum("score"), 6).alias("score_sum"), F.max("score").alias("score_max"), F.round(F.sum(1 / F.col("rank")), 6).alias("rank_sum")
    )
    w = W.partitionBy("batch").orderBy(F.desc("hits"), F.desc("score_sum"), F.desc("score_max"), F.desc("rank_sum"), "ref_id")
    d = d.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    blended = F.col("hits") + 0.01 * F.col("score_sum") + 0.001 * F.col("score_max") + 0.0001 * F.col("rank_sum")
    return d.withColumn("evidence", F.round(blended, 6))


def dynamic_batches(
    frames: DataFrame, neighbors: DataFrame, k: int = 5, max_size: int = 5, dominant: int = 5, overlap_min: int = 2, ratio_min: float = 0.4, similarity_min: float = 0.75, sequence: str | None = None
) -> DataFrame:
    """Greedy batches of consecutive frames: a frame joins while it shares ``overlap_min`` neighbours with the batch's
    dominant references and either their ratio or its similarity to a member is high enough; else it seeds the next batch.
    A frame's neighbours are its ``k`` best among the frames before the batch; ``neighbors`` has k + max_size - 1 a frame.

    Sequential within one image stream by definition; ``sequence`` names the column that separates streams, each a group."""
    part = F.col(sequence) if sequence else F.lit(0)
    near = neighbors.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "score"))).alias("near"))
    d = frames.select(part.cast("long").alias("stream"), F.col("order_index").alias("id"), unit(F.col("descriptor")).alias("v"))
    d = d.join(near, d["id"] == near["query_id"], "left").select("stream", "id", "v", "near.ref_id", "near.score")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        rows, batch, members, counts, seed = [], 0, [], {}, 0
        none = lambda x: [] if x is None else list(x)
        for r in g.sort_values("id").itertuples():
            near = list(zip(none(r.ref_id), none(r.score), strict=True))
            refs = dict([x for x in near if not members or x[0] < seed][:k])
            if members:
                top = sorted(counts, key=lambda i: (-counts[i][0], -counts[i][1], -counts[i][2], i))[: max(1, dominant)]
                overlap = len(set(top) & set(refs))
                alike = max(float(np.dot(r.v, m)) for m in members)
                fits = overlap >= overlap_min and (alike >= similarity_min or overlap / max(1, len(top)) >= ratio_min)
                if len(members) >= max_size or not fits:
                    rows[-1][3] = "reached_max_batch_size" if len(members) >= max_size else "next_frame_incompatible"
                    batch, members, counts, refs = batch + 1, [], {}, dict(near[:k])
            seed = seed if members else r.id
            members.append(r.v)
            for i, s in refs.items():
                n, total, most = counts.get(i, (0, 0.0, -1.0))
                counts[i] = (n + 1, total + s, max(most, s))
            rows.append([r.stream, batch, r.id, "", len(members)])
        if rows:
            rows[-1][3] = "end_of_sequence"
        return pd.DataFrame(rows, columns=["stream", "batch_id", "frame", "closed_by", "pos"])

    return d.groupBy("stream").applyInPandas(walk, "stream long, batch_id long, frame long, closed_by string, pos int")


def bootstrap(frames: DataFrame, size: int = 30) -> DataFrame:
    """The first frames, which define the map's coordinates; an error if there are fewer."""
    first = frames.where(F.col("order_index") < size)
    short = first.groupBy().agg(F.count("*").alias("n")).select(F.when(F.col("n") < size, F.raise_error(F.lit("too few frames to begin"))).cast("string").alias("e"))
    return first.join(F.broadcast(short), F.col("e").isNull()).drop("e")


def neighbour_overlap(found: DataFrame) -> DataFrame:
    """Shared references of each query of a search (query_id, ref_id; at most k a query) and the query before it."""
    sets = found.groupBy("query_id").agg(F.collect_set("ref_id").alias("refs"))
    before = sets.select((F.col("query_id") + 1).alias("query_id"), F.col("refs").alias("before"))
    return sets.join(before, "query_id").select("query_id", F.size(F.array_intersect("refs", "before")).cast("long").alias("shared"))
