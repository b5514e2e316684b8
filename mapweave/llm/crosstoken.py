"""Alignment of two tokenizers over the same texts, and how firmly the corpus links their ids.

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). The byte offsets at which tokens end are two
rising lists that are intersected by galloping: each offset of the shorter list looks ahead in the longer one in doubled
steps, then halves the span; every sixteenth offset does so first, then all others from where that one ended, at once. Common
offsets cut the text into groups; the ranks found give, for each token, the run of tokens of the other side that overlap it.

How many documents link a pair of ids is counted in two steps. Each document's distinct pairs are written beside its
figures. Tasks add up pairs before the shuffle. The most frequent pairs, at most TABLE_PAIRS of them (whole powers of two of
the count, so that a histogram of 64 rows finds the bound), are broadcast and looked up beside the documents; all others are
joined by a shuffle, where no pair has more rows than that bound: so no common pair lands in one task.

Defined results: texts that are null, empty, or that either vocabulary does not give back byte for byte have no tokens:
zeros and an empty digest; repeated rows are documents each; extra columns are ignored; an empty table gives an empty
result; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as piece_model
from .common import discard, written
from .packing import plain_ids, token_bytes, vocabulary_path

#: Pairs that are broadcast at most (17 bytes each), and that a task adds up before it passes them on.
TABLE_PAIRS, TASK_PAIRS = 1 << 20, 1 << 20
STRIDE = 16
FIGURES = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Pairs as columns of ids (which Parquet packs into bits), with how many links of the document they are.
SCHEMA = f"{FIGURES}, a array<int>, b array<int>, times array<int>"
_sides: dict[tuple[str, str], Sides] = {}


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in ``long`` with no smaller value. Both rise; no value of ``short`` is above
    the last of ``long``. Every STRIDE-th value is placed first, and the others start from there, all at once."""
    start = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)] if len(short) > STRIDE else np.zeros(len(short), np.int64)
    low, high, step, top = start, start, 1, len(long) - 1
    while (short_of := long[high] < short).any():
        low = np.where(short_of, high + 1, low)
        high = np.where(short_of, np.minimum(high + step, top), high)
        step *= 2
    while (low < high).any():
        mid = (low + high) >> 1
        less = long[mid] < short
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    return low


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in A and in B of common ends; for each driving token, the first and the number of tokens of the other side that
    overlap it), with the shorter list driving; if B drives, the last two are for its tokens."""
    swap = len(ends_b) < len(ends_a)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    at = gallop(short, long)
    same = long[at] == short
    first = np.concatenate([[0], (at + same)[:-1]])
    common_s, common_l = np.flatnonzero(same), at[same]
    return (common_l, common_s, first, at - first + 1) if swap else (common_s, common_l, first, at - first + 1)


class Sides:
    """Both vocabularies, as one worker holds them."""

    def __init__(self, path_a: str, path_b: str):
        self.path, self.model = path_a, piece_model.loaded(path_b)
        self.bytes_a, self.bytes_b = token_bytes(path_a), self.model.shown
        self.length_a, self.length_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        name = lambda n, mark: np.array([b"%d%s" % (i, mark) for i in range(n)], dtype=object)
        self.names = [[name(len(side), mark) for mark in marks] for side, marks in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";")))]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if a side does not give the text back. Both cover a text without gaps and show each of its
        characters by itself, but for a space mark, which B shows as a space, two bytes shorter: so lengths tell."""
        if not text:
            return None
        whole = " " + text
        size = len(whole.encode())
        a, b = plain_ids(whole, self.path), self.model.encode(text)
        return (a, b) if self.length_a[a].sum() == size == self.length_b[b].sum() else None

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, digest, distinct pairs (a << 32 | b) and how often each is linked."""
        none = np.zeros(0, np.int64)
        ids = self.encode(text)
        if ids is None:
            return 0, 0, 0, 0, "", none, none
        a, b = ids
        cut_a, cut_b, first, count = overlaps(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        n = int(count.sum())
        driver = np.repeat(np.arange(len(count)), count)
        other = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        left, right = (other, driver) if len(b) < len(a) else (driver, other)
        pairs, times = np.unique(a[left].astype(np.int64) << 32 | b[right], return_counts=True)
        return len(a), len(b), len(cut_a), n, self.digest(a, b, cut_a, cut_b), pairs, times

    def digest(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """SHA-256 of the groups as text: each token's name with the mark that follows it, put in order."""
        out = np.empty(len(a) + len(b), dtype=object)
        for ids, cut, shift, names in ((a, cut_a, np.concatenate([[0], cut_b[:-1] + 1]), self.names[0]), (b, cut_b, cut_a + 1, self.names[1])):
            size = np.diff(cut, prepend=-1)
            shown = names[0][ids]
            shown[cut] = names[1][ids[cut]]
            out[np.arange(len(ids)) + np.repeat(shift, size)] = shown
        return hashlib.sha256(b"".join(out.tolist())[:-1]).hexdigest()


def sides(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Sides(path_a, path_b)
    return _sides[path_a, path_b]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays).astype(np.int32)))


def aligned(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its figures, and its distinct pairs of linked ids (SCHEMA)."""
    paths = vocabulary or vocabulary_path(), model or vocabulary_path("piece_bpe_32k.model")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*paths)
        for batch in batches:
            for p in range(0, batch.num_rows, 256):
                part = batch.slice(p, 256)
                found = list(zip(*(both.align(text.as_py()) for text in part.column(1)), strict=True))
                numbers = [pa.array(x, pa.int64()) for x in found[:4]]
                lists = [_lists([x >> 32 for x in found[5]]), _lists([x & 0xFFFFFFFF for x in found[5]]), _lists(found[6])]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array(found[4], pa.string()), *lists], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, SCHEMA)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().astype(np.int64) for c in "ab")
    return a << 32 | b


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs, best): how many documents link a pair of ids, and whether no pair with the same A id has more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def add() -> tuple[np.ndarray, np.ndarray]:
            new, count = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (pairs, docs)
            if not waiting or not len(pairs):
                return new, count
            both, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            return both, np.bincount(at, weights=np.concatenate([docs, count]), minlength=len(both)).astype(np.int64)

        for batch in batches:
            waiting.append(_keys(batch))
            n += len(waiting[-1])
            if n > TASK_PAIRS:
                pairs, docs = add()
                waiting, n = [], 0
                if len(pairs) > TASK_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])
                    pairs, docs = pairs[:0], docs[:0]
        pairs, docs = add()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], names=["pair", "docs"])

    counts = found.select("a", "b").mapInArrow(partial, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    a = F.shiftrightunsigned("pair", 32)
    most = counts.groupBy(a.alias("of")).agg(F.max("docs").alias("most"))  # at most a row for each id of A
    return counts.join(F.broadcast(most), a == F.col("of")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs are in as many documents or more."""
    by = {r.b: r.n for r in counts.groupBy(F.floor(F.log2(F.col("docs").cast("double"))).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    bits, total = max(by, default=0) + 1, 0
    while bits > 0 and total + by.get(bits - 1, 0) <= most:
        bits -= 1
        total += by.get(bits, 0)
    return 1 << bits


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """A row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    found = aligned(docs, vocabulary, model, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "linked-pairs")
    counts = written(pair_counts(found), "pair-counts")
    least = _frequent(counts, table_pairs)
    table = counts.where(F.col("docs") >= least).toArrow()  # at most table_pairs rows
    order = np.argsort(table.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "docs", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = shared.value
        for batch in batches:
            for p in range(0, batch.num_rows, 1024):
                part = batch.slice(p, 1024)
                lists = part.column(part.schema.get_field_index("times"))
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                keys, times = _keys(part), lists.flatten().to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
                there = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
                add = lambda x, b=bounds: np.diff(np.concatenate([[0], np.cumsum(x)])[b])
                known = np.where(there, times, 0)
                sums = [add(known * best[at]), add(known * docs[at])] if len(pairs) else [np.zeros(len(part), np.int64)] * 2
                missing = [np.flatnonzero(~there[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                rest = [_lists([x[s:e][m] for s, e, m in zip(bounds[:-1], bounds[1:], missing, strict=True)]) for x in (keys >> 32, keys & 0xFFFFFFFF, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in sums), *rest], names=["row", "n_best", "count_sum", "a", "b", "times"])

    known = found.select("row", "a", "b", "times").mapInArrow(look_up, "row long, n_best long, count_sum long, a array<int>, b array<int>, times array<int>")
    figures = found.select("row", *(c.split()[0] for c in FIGURES.split(", ")))
    if least == 1:
        discard(counts)
        sums = known.select("row", "n_best", "count_sum")
    else:
        known = written(known, "known-pairs")
        one = known.select("row", "n_best", "count_sum", F.explode_outer(F.arrays_zip("a", "b", "times")).alias("p"))
        known = one.groupBy("row").agg(F.first("n_best").alias("n_best"), F.first("count_sum").alias("count_sum"))
        rare = one.where("p is not null").select("row", F.shiftleft(F.col("p.a").cast("long"), 32).bitwiseOR(F.col("p.b").cast("long")).alias("pair"), "p.times")
        rare = rare.join(counts.where(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("int")).alias("rare_best"), F.sum(F.col("times") * F.col("docs")).alias("rare_sum"))
        sums = known.join(rare, "row", "left").select("row", *((F.col(c) + F.coalesce(r, F.lit(0))).alias(c) for c, r in (("n_best", "rare_best"), ("count_sum", "rare_sum"))))
    return figures.join(sums, "row").select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
