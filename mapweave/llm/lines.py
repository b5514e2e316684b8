"""Line deduplication with a deletion-neighbourhood join (edit bound 1).

A line goes if an earlier line (by document id, text hash, line number) is the same or within one inserted, deleted or
substituted character. Lines are compared without white space at their ends. All lines that are not blank are compared;
``fuzzy_chars`` can ask for equality of lines shorter than that, and ``min_chars`` can keep the shortest, if one edit says
too little about them.

1. Equal lines: grouped by a 128-bit hash with a map-side minimum of places.
2. Which lines can have a neighbour at all: of two lines within one edit, either the first half or the rest is equal, so
   each line emits four half keys and only lines that share one with a different line go on. None is lost.
3. Deletion variants of those lines: every one-character deletion, and the line itself, as hashed keys. A key is made
   from the hash of a block of 64 characters with the deletion and the hashes of what stands before and after the block,
   so long lines cost little more than their length. Lines that share a key are one character away from one string; their
   number is bounded by the alphabet, not by the data. Within a key, lines that lack a character at the same place are
   within one edit of each other, and all are within one edit of the line that is the key: each finds its earliest
   neighbour by minima, without pairs.
4. The distance to that neighbour is verified.

Defined results: null and empty texts have no lines and stay; blank lines stay; rows repeated with id and text keep the
same lines; a null id counts as earliest; extra columns are kept by ``remove``; lines and texts of any length are compared
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, fingerprint, spare, written

BLOCK = 64
BLANK = " \t\r\x0b\x0c"
AT = ("id", "text_hash", "nth")


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    t = F.col(text_col)
    d = docs.where(t.isNotNull()).select(F.col(id_col).alias("id"), fingerprint(t).alias("text_hash"), F.posexplode(F.split(t, "\n", -1)).alias("nth", "raw"))
    d = d.select(*AT, F.btrim("raw", F.lit(BLANK)).alias("line")).where(F.char_length("line") >= max(1, min_chars))
    return d.select(*AT, "line", F.char_length("line").alias("n"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("2"), "line").alias("k2"))


def _half_keys() -> Column:
    """Keys of the halves for partners as long or longer (m = n) and for shorter ones (m = n - 1)."""
    keys = []
    for m in (F.col("n"), F.col("n") - 1):
        h = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit("a"), m, F.substr("line", F.lit(1), h)), F.xxhash64(F.lit("b"), m, F.substr("line", F.col("n") - m + h + 1))]
    return F.array(*keys)


def _variants(t: DataFrame) -> DataFrame:
    """(key, p, k1, k2, at, line): p is the place of the deleted character, -1 for the whole line."""
    held = ("k1", "k2", "at")
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.floor(m / BLOCK).cast("int"))).alias("j")
    a = F.col("j") * BLOCK
    whole = t.select(*held, "line", "n", blocks(F.col("n"))).select(
        *held, F.lit(-1).alias("p"),
        F.xxhash64("n", "j", F.xxhash64(F.substr("line", F.lit(1), a)), F.xxhash64(F.substr("line", a + BLOCK + 1)), F.substr("line", a + 1, F.lit(BLOCK))).alias("key"),
    )
    cut = t.select(*held, "line", "n", blocks(F.col("n") - 1)).select(
        *held, "n", "j", F.xxhash64(F.substr("line", F.lit(1), a)).alias("pre"), F.xxhash64(F.substr("line", a + BLOCK + 2)).alias("post"),
        F.substr("line", a + 1, F.lit(BLOCK + 1)).alias("mid"),
    )
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK - 1), F.col("n") - 1 - a))).alias("i"))
    i = F.col("i")
    cut = cut.select(
        *held, (a + i).alias("p"), F.xxhash64(F.col("n") - 1, "j", "pre", "post", F.concat(F.substr("mid", F.lit(1), i), F.substr("mid", i + 2))).alias("key")
    )
    return whole.unionByName(cut)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, fuzzy_chars: int = 1) -> DataFrame:
    """(id, text_hash, nth): the lines to drop."""
    lines = _lines(docs, id_col, text_col, min_chars)
    at = F.struct(F.col("id").isNotNull().alias("z"), *AT)
    same = written(lines.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min(at).alias("first")).where("c > 1").drop("c"), "lines-same")

    long = lines.where(F.col("n") >= fuzzy_chars)
    keyed = lambda *c: long.select(*c, F.explode(_half_keys()).alias("half"))
    shared = keyed("k1").groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    shared = written(shared, "lines-halves")
    able = keyed("k1", "k2", "line", "n", at.alias("at")).join(broadcast_if_small(shared), "half")
    able = written(able.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.min("line").alias("line"), F.min("n").alias("n")), "lines-able")

    v = _variants(able)
    met = written(v.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("key"), "lines-met")
    v = v.join(broadcast_if_small(met), "key")
    by_key, by_place = W.partitionBy("key"), W.partitionBy("key", "p")
    deleted = F.col("p") >= 0
    v = v.repartition("key").select(
        "k1", "k2", "at", "p", F.min("at").over(by_place).alias("place"), F.min(F.when(~deleted, F.col("at"))).over(by_key).alias("whole"),
        F.min(F.when(deleted, F.col("at"))).over(by_key).alias("others"),
    )
    pairs = v.select("k1", "k2", "at", F.explode(F.when(deleted, F.array("place", "whole")).otherwise(F.array("others"))).alias("to")).where("to < at").distinct()
    left = able.select("k1", "k2", F.col("line").alias("x"))
    right = able.select(F.col("at").alias("to"), F.col("line").alias("y"))
    near = pairs.join(left, ["k1", "k2"]).join(right, "to").where(F.levenshtein("x", "y", 1).between(0, 1)).select("k1", "k2").distinct()

    near = near.select("k1", "k2", F.lit(True).alias("near"))
    bad = written(same.join(near, ["k1", "k2"], "full").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-bad")
    drop = lines.select("k1", "k2", *AT, at.alias("at")).join(broadcast_if_small(bad), ["k1", "k2"]).where(F.col("near") | (F.col("at") != F.col("first")))
    drop = written(drop.select(*AT), "lines-dropped")
    discard(same, shared, able, met, bad)
    return drop


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numbers: str | None = None, **kw) -> DataFrame:
    """``docs`` without the dropped lines; ``numbers``: a column to add with the dropped line numbers (sorted)."""
    at, of, gone = spare(docs, "at_id", "at_hash", "gone")
    drop = dropped_lines(docs, id_col, text_col, **kw).groupBy(F.col("id").alias(at), F.col("text_hash").alias(of)).agg(F.array_sort(F.collect_set("nth")).alias(gone))
    t = F.col(text_col)
    out = docs.join(drop, docs[id_col].eqNullSafe(F.col(at)) & (fingerprint(docs[text_col]) == F.col(of)), "left")
    left = F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    new = F.when(F.col(gone).isNotNull(), F.array_join(left, "\n")).otherwise(t).alias(text_col)
    found = [F.coalesce(gone, F.array().cast("array<int>")).alias(numbers)] if numbers else []
    return out.select(*(new if c == text_col else F.col(c) for c in docs.columns), *found)
