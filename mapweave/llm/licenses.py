"""License scan: ordered signature rules, gated by keywords, with containment suppression.

A text is searched by a rule only if it has one of a few anchors and then the rule's keyword. Matches become intervals
of characters. A match inside the interval of a match of the same or a better level is suppressed (equal intervals: the
earlier rule wins). Only matches are shuffled, never texts.

Defined results: null counts as empty; a text without a match has empty labels and score 0; rows that share an id are
told apart by a hash of the text; overlaps that are not containments keep both matches; extra columns are ignored; whole
texts are searched, whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import RAW_WORD_GAP, ascii_lower, fingerprint, words
from .license_rules import GAP, WORTH, anchors, rules

TABLE = "array<struct<k string, rs array<struct<rule int, label string, level int, keyword string, pattern string, base_words int>>>>"


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match: id, text_hash, rule, label, level, start, stop (characters), kept; base phrases have also n_base of the
    rule in the text, first_word and last_word of it."""
    by_key: dict[str, list] = {}
    for r in rules():
        by_key.setdefault(r.keyword, []).append(r._asdict())
    # One literal, which the optimiser parses once; hundreds of small literals would take seconds to build.
    table = F.from_json(F.lit(json.dumps([{"k": k, "rs": rs} for k, rs in by_key.items()])), TABLE)
    # The gate reads texts as written: one pass, and only texts that pass are lower-cased (once: exploding keeps t a column).
    gate = "(?i)" + "|".join(f"cc{GAP}by" if a == "cc" else re.escape(a) for a in anchors())
    t, text = F.col("t"), F.coalesce(F.col(text_col), F.lit(""))
    d = docs.where(F.rlike(text, F.lit(gate))).select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("text_hash"), F.explode(F.array(ascii_lower(text))).alias("t"))
    d = d.select("id", "text_hash", "t", F.explode(F.flatten(F.transform(F.filter(table, lambda x: F.contains(t, x["k"])), lambda x: x["rs"]))).alias("r"))
    d = d.select("*", F.regexp_extract_all(t, F.col("r.pattern"), 0).alias("hits")).where(F.size("hits") > 0)
    d = d.withColumn("gaps", F.split(t, F.col("r.pattern"), -1))
    base = lambda x: F.when(F.col("r.base_words") > 0, x.cast("long"))
    d = d.select(
        "id", "text_hash", "r.rule", "r.label", "r.level", base(F.size("hits")).alias("n_base"), base(F.size(words(F.get("gaps", F.lit(0))))).alias("first_word"),
        base(F.size(words(t)) - F.size(words(F.element_at("gaps", -1))) - F.col("r.base_words")).alias("last_word"),
        F.posexplode(F.transform("hits", lambda h, i: F.struct(F.char_length(F.get("gaps", i)).alias("gap"), F.char_length(h).alias("len")))).alias("nth", "m"),
    )
    d = d.repartition("id", "text_hash")
    so_far = W.partitionBy("id", "text_hash", "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("stop", F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)).withColumn("start", F.col("stop") - F.col("m.len"))
    before = W.partitionBy("id", "text_hash").orderBy("start", F.desc("stop"), "level", "rule").rowsBetween(W.unboundedPreceding, -1)
    hidden = F.lit(False)
    for level in sorted(WORTH):
        hidden = hidden | ((F.col("level") >= level) & (F.coalesce(F.max(F.when(F.col("level") == level, F.col("stop"))).over(before), F.lit(-1)) >= F.col("stop")))
    d = d.withColumn("kept", ~hidden)
    return d.select("id", "text_hash", "rule", "label", "level", "start", "stop", "kept", "n_base", "first_word", "last_word", "nth")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), fingerprint(text).alias("text_hash"), F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), RAW_WORD_GAP, -1), "")).cast("long").alias("n_words"))
    found = detections(docs, id_col, text_col).distinct()  # repeated rows find the same
    one = F.col("nth") == 0
    score = 1 - F.exp(sum((F.count_if(F.col("kept") & (F.col("level") == k)) * math.log(1 - v) for k, v in WORTH.items()), F.lit(0.0)))
    found = found.groupBy(F.col("id").alias("id_"), F.col("text_hash").alias("hash_")).agg(
        F.sum(F.when(one, F.col("n_base"))).alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("n_base") > 0, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when((F.col("n_base") > 0) | F.col("kept"), F.col("label")))).alias("labels"), F.round(score, 6).alias("score"),
    )
    out = base.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
