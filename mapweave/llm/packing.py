"""Best-fit packing of token sequences, planned on a histogram of lengths.

Documents are tokenised in Arrow batches and cut into pieces; only ids, lengths and checksums leave the tasks. Which
lengths share a sequence depends on the number of pieces of each length alone, so the plan is made from one row for each
length (at most ``capacity`` rows, whatever the corpus): pieces above a third of the capacity are matched greedily, the
longest with the longest that still fits, at most two in a sequence; shorter ones go, longest first, into the smallest
gap that holds them. The plan speaks of runs ("the next 40,000 pieces of length 300 go to sequences 7,000 and on, at
place 700"). Spark then ranks the pieces of each length, per partition with offsets, and joins them to the runs.

Defined results: a null text is an empty one and has only the end token; repeated rows are separate pieces; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fingerprint, written

#: Fixed values of the byte-level vocabulary: how it splits texts, and its special token.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
END_ID = 2
AT_ONCE = 1 << 20
PIECES = "id long, text_hash long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[str, tuple] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_shown() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: Latin-1 characters that show stand for themselves, the
    others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> tuple:
    """(encode to ids, id of the special token) for a byte-level BPE file; kept for the life of the worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        vocabulary = read["model"]["vocab"]
        special = next((x["id"] for x in read["added_tokens"] if x["content"] == SPECIAL), None)
        of = _bytes_of_shown()
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token != SPECIAL}
        _loaded[path] = (tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, special)
    return _loaded[path]


def _parts(text: str) -> Iterator[str]:
    """Long texts in parts that end before a space after a visible character, where no token can span."""
    while len(text) > AT_ONCE:
        at = AT_ONCE
        while at < len(text) and not (text[at] == " " and not text[at - 1].isspace()):
            at += 1
        yield text[:at]
        text = text[at:]
    yield text


def plain_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text; the special token's string is text like any other."""
    encode, _ = encoder(path)
    return np.concatenate([np.array(encode(x), "<u4") for x in _parts(text)])


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token, by id; none for a special one."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    of, special = _bytes_of_shown(), {x["id"] for x in read["added_tokens"]}
    out = [b""] * (1 + max([*read["model"]["vocab"].values(), *special]))
    for token, i in read["model"]["vocab"].items():
        if i not in special:
            out[i] = bytes(of[c] for c in token)
    return out


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text, then the end id."""
    encode, special = encoder(path)
    found = []
    for i, between in enumerate(text.split(SPECIAL) if special is not None else [text]):
        if i:
            found.append(np.array([special], "<u4"))
        found += [np.array(encode(x), "<u4") for x in _parts(between)]
    return np.concatenate([*found, np.array([END_ID], "<u4")])


def _pieces(path: str, capacity: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(a, 256)
                for i, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    ids = token_ids(text.as_py() or "", path)
                    start, end = 0, len(ids) % capacity or min(capacity, len(ids))
                    while start < len(ids):
                        rows.append((i, h, -(-start // capacity), start, end - start, zlib.crc32(ids[start:end].tobytes())))
                        start, end = end, end + capacity
                names = ["id", "text_hash", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return of


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset): the pieces of that length and those ranks go, one each,
    to consecutive sequences at that offset."""
    left, used, runs, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def put(length: int, n: int, first: int, gap: int) -> None:
        """n pieces into the n sequences from ``first`` on, which have ``gap`` left."""
        runs.append((length, used[length], used[length] + n, first, capacity - gap))
        used[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(k for k in counts if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            fits = (b for b in reversed(large[: bisect_left(large, capacity - a + 1)]) if b <= a and left[b] > (b == a))
            b = next(fits, None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, sequences, capacity)
            if b is not None:
                put(b, n, sequences, capacity - a)
            keep(capacity - a - (b or 0), sequences, n)
            sequences += n
    for s in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at < len(sizes):
                gap = sizes[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                n = min(bins, left[s])
                put(s, n, first, gap)
                keep(gap - s, first, n)
                keep(gap, first + n, bins - n)
            else:
                each = min(capacity // s, left[s])
                n = left[s] // each
                for i in range(each):
                    put(s, n, sequences, capacity - i * s)
                keep(capacity - each * s, sequences, n)
                sequences += n
    return runs


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), fingerprint(text).alias("text_hash"), text.cast("string").alias("t"))
    pieces = rows.mapInArrow(_pieces(vocabulary or vocabulary_path(), capacity), PIECES)
    pieces = written(pieces.withColumn("part", F.spark_partition_id()), "pieces")

    tally = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "tally")
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    schema = "length_ long, lo long, hi long, first long, offset long"
    runs = docs.sparkSession.createDataFrame(plan(counts, capacity), schema)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tally = tally.select(F.col("part").alias("part_"), F.col("length").alias("len_"), before.alias("before"))
    nth = F.row_number().over(W.partitionBy("part", "length").orderBy("id", "text_hash", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("nth", nth).join(tally, (F.col("part") == F.col("part_")) & (F.col("length") == F.col("len_")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    out = ranked.join(F.broadcast(runs), (F.col("length") == F.col("length_")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
