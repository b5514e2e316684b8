"""Benchmark decontamination by a hash set of normalised test n-grams.

The windows of the benchmark (``n`` consecutive words; an item of fewer words is one window) form a small table. It is
broadcast when a count shows that it is small. Training texts emit one 64-bit probe a position, made from four of the
window's words; a match is verified on all words of the window at once, and only hits are shuffled. A larger table of
windows is joined by probe with keys alone, and its matches are verified where they meet their document again.

Defined results: null or wordless texts have no windows and no hits; items without words match nothing; an item without
an id contaminates but is not listed; rows repeated or sharing an id are told apart by a hash of the text; extra columns
are ignored by ``scan`` and kept by ``remove``; texts of any length are scanned whole; empty tables give empty or clean
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, RAW_WORD, broadcast_if_small, fingerprint, spare, words, written


#: Tasks among which a probe of the shuffled join is dealt.
SALTS = 8


def _probe(w: Column, at: Column, n: Column) -> Column:
    """Hash of four of the ``n`` words from ``at`` on (and of n)."""
    pick = lambda k: F.get(w, at + k)
    return F.xxhash64(n, pick(F.lit(0)), pick((n / 3).cast("int")), pick((n * 2 / 3).cast("int")), pick(n - 1))


def benchmark_windows(bench: DataFrame, n: int = 10, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows: wid, n, probe, window) and (wid, item), written tables. A window that several items share has one wid."""
    items = bench.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(n)))
    cut = items.select("item", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    cut = cut.select(
        "item", "n", _probe(F.col("w"), F.col("at"), F.col("n")).alias("probe"), F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("window")
    ).distinct()
    windows = written(cut.select("n", "probe", "window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    of = written(cut.join(windows.select("window", "wid"), "window").select("wid", "item").distinct(), "window-items")
    return windows, of


def scan(
    docs: DataFrame, bench: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row a document: id, text_hash, n_words, n_hit (words inside any hit window), n_items, items (sorted ids), spans
    (merged [from, to) word ranges)."""
    windows, of = benchmark_windows(bench, n, item_id, item_text)  # a few words for each position of the benchmark
    lengths = sorted(r.n for r in windows.select("n").distinct().collect()) or [n]  # at most n numbers
    small = windows.count() <= broadcast_rows
    windows, of = F.broadcast(windows) if small else windows, broadcast_if_small(of, broadcast_rows)
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), fingerprint(text).alias("text_hash"), F.size(words(text)).cast("long").alias("n_words"))

    k = len(lengths)
    texts = docs.select(F.col(id_col).alias("id"), fingerprint(text).alias("text_hash"), words(text).alias("w")).where(F.size("w") > 0)
    d = texts.select("id", "text_hash", "w", F.explode(F.sequence(F.lit(0), F.size("w") * k - 1)).alias("i"))
    at = F.col("i") if k == 1 else F.floor(F.col("i") / k).cast("int")
    size = F.lit(lengths[0]) if k == 1 else F.element_at(F.lit(lengths), (F.col("i") % k + 1).cast("int"))
    d = d.select("id", "text_hash", "w", at.alias("at"), size.alias("size")).where(F.col("at") + F.col("size") <= F.size("w"))
    d = d.withColumn("p", _probe(F.col("w"), F.col("at"), F.col("size")))
    here = F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ")
    # As a range, so that the joined text stays a check of matches and does not become a join key made for every position.
    same = (F.col("window") >= here) & (F.col("window") <= here)
    if small:
        hits = d.join(windows, (F.col("p") == F.col("probe")) & same)
    else:
        # Only keys are shuffled for every position; the words of a document meet its candidates once. A probe that is very
        # common in the texts is dealt over several tasks.
        keys = d.select("id", "text_hash", "at", "size", "p", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).alias("salt"))
        salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = keys.join(salted, (keys["p"] == salted["probe"]) & (keys["salt"] == salted["salt"])).select("id", "text_hash", "at", "size", "wid", "window")
        texts = texts.select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), "w").dropDuplicates(["id_", "hash_"])
        hits = met.join(texts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")) & same)
    hits = hits.select("id", "text_hash", "wid", "at", "size")

    by_doc = hits.groupBy("id", "text_hash").agg(F.collect_set(F.struct("at", "size")).alias("s"), F.collect_set("wid").alias("wids"))
    last = lambda out: F.get(out, F.size(out) - 1)
    span = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    merged = F.aggregate(
        F.array_sort("s"),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (last(out).b >= x["at"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), span(last(out).a, F.greatest(last(out).b, x["at"] + x["size"]))),
        ).otherwise(F.concat(out, span(x["at"], x["at"] + x["size"]))),
    )
    by_doc = by_doc.select("id", "text_hash", merged.alias("spans"), "wids")
    by_doc = by_doc.select("id", "text_hash", "spans", F.explode("wids").alias("wid")).join(of, "wid")
    by_doc = by_doc.groupBy("id", "text_hash").agg(F.first("spans").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = by_doc.select(F.col("id").alias("id_"), F.col("text_hash").alias("hash_"), "spans", "items")
    out = base.join(by_doc, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x.b - x.a)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "id", "text_hash", "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        items.alias("items"), F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
    )


def remove(docs: DataFrame, bench: DataFrame, what: str = "documents", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with its own columns, without contaminated documents (what="documents") or without the words of hit spans
    and the separators before them (what="spans")."""
    found = scan(docs, bench, id_col=id_col, text_col=text_col, **kw).where("n_hit > 0")
    key, of, inside = spare(docs, "at_id", "at_hash", "inside")
    found = found.select(F.col("id").alias(key), F.col("text_hash").alias(of), F.col("spans").alias(inside)).dropDuplicates([key, of])
    on = docs[id_col].eqNullSafe(F.col(key)) & (fingerprint(docs[text_col]) == F.col(of))
    if what == "documents":
        return docs.join(found, on, "left_anti")
    t = F.col(text_col)
    held = F.transform(F.regexp_extract_all(t, F.lit(RAW_WORD), 0), lambda w, i: F.when(F.exists(inside, lambda s: (i >= s.a) & (i < s.b)), F.lit(None)).otherwise(w))
    parts = F.zip_with(F.split(t, RAW_WORD, -1), held, lambda gap, w: F.when(w.isNotNull(), F.concat(gap, w)))
    cut = F.concat(F.array_join(parts, ""), F.element_at(F.split(t, RAW_WORD, -1), -1))
    return docs.join(found, on, "left").withColumn(text_col, F.when(F.col(inside).isNotNull(), cut).otherwise(t)).select(docs.columns)
