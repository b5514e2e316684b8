"""Exact medians of groups of any size, and of whole tables.

A group of up to ``direct`` values goes into one percentile. In a larger one, rounds of counting narrow down where its middle
values are: each round cuts the span that holds them into ``bins`` of equal width, counts the values in each (before the
shuffle, so a task receives a row a bin and task), and keeps the bin that holds the middle. What is left when it is small
enough, or all equal, gives the values themselves. The two middle values of an even count part at most once, between two
bins, and then they are the largest value of the one and the smallest of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapweave.functions.vectors import finite
from mapweave.sources.tables import Tables


def exact_median(d: DataFrame, value: str, by: tuple[str, ...] = (), direct: int = 100_000, bins: int = 4096, rounds: int = 40) -> DataFrame:
    """(by..., n, median) of the finite values; groups without any are absent (without ``by``: one row, n 0 and null)."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    v = d.select(*keys, F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    tables = Tables(d.sparkSession)
    groups = v.groupBy(*names).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    groups = tables.write(groups, "groups")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    large = groups.where((F.col("n") > direct) & (F.col("lo") < F.col("hi")))
    state = large.select(*names, "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"))
    found = groups.where((F.col("n") > direct) & (F.col("lo") == F.col("hi"))).select(*names, "n", F.col("lo").alias("median"))
    small = v.alias("v").join(groups.where(F.col("n") <= direct).select(*names, "n").alias("s"), same("v", "s"), "inner").groupBy(*(F.col(f"s.{c}").alias(c) for c in names))
    parts = [small.agg(F.first("n").alias("n"), F.percentile("_v", F.lit(0.5)).alias("median")), found]
    for _ in range(rounds):
        state = tables.write(state, "state")
        if state.isEmpty():
            break
        # Places of the middle values among those inside: the lower at (n - 1) div 2, the upper at n div 2.
        inside = v.alias("v").join(F.broadcast(state).alias("s") if state.count() <= direct else state.alias("s"), same("v", "s"), "inner").where("_v between lo and hi")
        at = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        counts = inside.select(*(F.col(f"s.{c}").alias(c) for c in names), "n", "before", "_v", at.alias("bin")).groupBy(*names, "n", "before", "bin")
        counts = counts.agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        w = W.partitionBy(*names).orderBy("bin")  # at most ``bins`` rows
        counts = counts.withColumn("start", F.col("before") + F.sum("inside").over(w) - F.col("inside")).withColumn("next", F.lead("lo").over(w))
        low, up = F.expr("(n - 1) div 2"), F.expr("n div 2")
        held = counts.where((F.col("start") <= low) & (low < F.col("start") + F.col("inside")))
        held = tables.write(held.select(*names, "n", "lo", "hi", F.col("start").alias("before"), "inside", (up >= F.col("start") + F.col("inside")).alias("parted"), "next"), "held")
        parted = held.where("parted").select(*names, "n", (F.col("hi") / 2 + F.col("next") / 2).alias("median"))
        equal = held.where("not parted and lo = hi").select(*names, "n", F.col("lo").alias("median"))
        few = held.where("not parted and lo < hi").where(F.col("inside") <= direct)
        rest = v.alias("v").join(few.alias("s"), same("v", "s"), "inner").where("_v between lo and hi").groupBy(*(F.col(f"s.{c}").alias(c) for c in names))
        rest = rest.agg(F.first("n").alias("n"), F.first("before").alias("before"), F.array_sort(F.collect_list("_v")).alias("_all"))
        place = lambda k: F.element_at("_all", (F.expr(k) - F.col("before") + 1).cast("int")) / 2
        rest = rest.select(*names, "n", (place("(n - 1) div 2") + place("n div 2")).alias("median"))
        parts.append(tables.write(parted.unionByName(equal).unionByName(rest), f"known-{len(parts)}"))
        state = held.where("not parted and lo < hi").where(F.col("inside") > direct).select(*names, "n", "lo", "hi", "before", "inside")
    else:
        raise RuntimeError("medians did not settle")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not by:
        return d.sparkSession.range(1).select(F.lit(0).alias("_k0")).join(out, "_k0", "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "median")
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(by)), "n", "median")
