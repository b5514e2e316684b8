"""Exact deduplication: rows grouped by a 128-bit hash of the normalised text, byte comparison inside groups.

Texts are equal when identical without white space ``[\\x20\\x09-\\x0D]``. The bytes are compared by grouping on the
text beside its MD5: copies collapse before the shuffle, and two texts with one hash stay two groups. Rows then find
their group by MD5 and SHA-256, without moving their texts again.

Defined results: null counts as empty; the row with the most code points in the original stays, then the smallest id, a
null id last; repeated rows count each and share the flag of their id; extra columns are ignored by ``exact_groups``;
texts of any length are compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("points"), F.regexp_replace(text, SPACES, "").alias("norm"))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("i")))
    groups = rows.groupBy(F.md5("norm").alias("md5"), "norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = written(groups.select("md5", F.sha2("norm", 256).alias("sha"), F.col("best.i").alias("keep_id"), "group_size"), "exact")
    rows = rows.select("id", F.md5("norm").alias("md5"), F.sha2("norm", 256).alias("text_sha256"))
    out = rows.join(groups, (rows["md5"] == groups["md5"]) & (rows["text_sha256"] == groups["sha"]))
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
