"""Near-duplicate detection: min-max hashing, banding, exact verification, connected components.

Each document is the set of its distinct shingles. Under each of 64 random permutations both the minimum and the maximum
are kept: 128 signature values for 64 hash evaluations a shingle. They form 32 bands of four values of different
permutations; a pair of similarity 0.8 shares no band with probability 5e-8.

Equal sets collapse first. In each bucket of a band every member is compared, on full sets, with one leader: the member
with the most bucket mates, as a rule the original of a group of edited copies. Members within the threshold are linked
to it. That leaves pairs with a member z beyond the threshold, in groups of one leader L. Let E be a member's symmetric
difference with L. The difference of z and y is that of E(z) and E(y), so a link bounds it by
(100 - p) / (100 + p) * (|z| + |y|), while E(z) exceeds the same share of |z| + |L|. Hence E(z) and E(y) overlap in more
than half of E(y), up to a term in |L| - |y|, and a prefix filter applies: in one order of elements (those foreign to L
first, those that many members share last) a prefix of each E must meet, and what remains after the first meeting must
still hold the overlap. Members made from one template, all beyond the threshold of one another, share the template's
elements only at places where too little remains, so they do not meet; a group of them is not compared in pairs.
Each set also carries an odd sketch of 512 bits: every element flips the bit it hashes to. The bits in which two sketches
differ are at most the elements in which the sets differ, so a pair whose sketches differ by more than a link allows goes
without loss; short texts, whose edits meet by chance in the few elements of their leader, mostly fall here.
Only pairs that pass, and are not joined already, are compared on full sets. Independent edits of one original rarely
meet, so the pairs stay few where a bucket's pairs would grow with the square of a group. No link within a bucket is lost.

Defined results: texts without words have no shingles and link to nothing; texts shorter than a shingle are one shingle;
rows without an id are never linked and stay; rows sharing an id are one node with several texts; extra columns are ignored;
texts of any length are compared as whole sets; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, fingerprint, written
from .components import components
from .hashing import U, mix, slices, space_separated, word_hashes

PERMUTATIONS, BAND = 64, 4
_random = np.random.default_rng(20240817)
FACTOR = _random.integers(0, 2**64, PERMUTATIONS, dtype=U) | U(1)
SHIFT = _random.integers(0, 2**64, PERMUTATIONS, dtype=U)
SIGNATURE = "id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"
#: Words of 64 bits of a set's odd sketch: every element flips one bit.
ODD = [f"odd{i}" for i in range(8)]
#: Pairs of one leader that go to one task, and members that share an element before it counts as common.
SPLIT, COMMON = 256, 16
SETS = "id long, shingles array<long>, " + ", ".join(f"{c} long" for c in ODD)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) for runs of rows."""
    ok = space_separated()
    for a, b, data, bounds in slices(column):
        h, at = word_hashes(data, bounds, ok)
        with np.errstate(over="ignore"):
            s = np.zeros(max(0, len(h) - k + 1), U)
            for i in range(k):
                s = s * U(0xFF51AFD7ED558CCD) + h[i : i + len(s)]
            s = mix(s)
            sets = []
            for x, y in zip(at[:-1], at[1:], strict=True):
                if y - x >= k:
                    sets.append(np.unique(s[x : y - k + 1]))
                else:
                    one = U(0)
                    for w in h[x:y]:
                        one = one * U(0xFF51AFD7ED558CCD) + w
                    sets.append(mix(np.array([one + U(int(y - x))], U)) if y > x else np.zeros(0, U))
        yield a, sets


def _signature(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(2), k):
                n = np.array([len(x) for x in sets])
                out = np.zeros((len(sets), 2 * PERMUTATIONS), U)
                s1, s2 = np.zeros(len(sets), U), np.zeros(len(sets), U)
                if full := np.flatnonzero(n).tolist():
                    x = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    with np.errstate(over="ignore"):
                        s1[full], s2[full] = np.add.reduceat(mix(x + U(1)), starts), np.add.reduceat(mix(x ^ U(0xA5A5A5A5A5A5A5A5)), starts)
                        for i in range(PERMUTATIONS):
                            y = x * FACTOR[i] + SHIFT[i]
                            out[full, i], out[full, PERMUTATIONS + i] = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
                with np.errstate(over="ignore"):
                    bands = out.reshape(len(sets), -1, BAND)
                    key = np.zeros(bands.shape[:2], U) + mix(np.arange(1, bands.shape[1] + 1, dtype=U))
                    for i in range(BAND):
                        key = mix(key * U(0xFF51AFD7ED558CCD) + bands[:, :, i])
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, key.shape[1], 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[n > 0].reshape(-1).view(np.int64)))
                rows = batch.slice(a, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists],
                    names=["id", "text_hash", "n_shingles", "s1", "s2", "bands"],
                )

    return of


def _sets(k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in shingle_sets(batch.column(1), k):
                n, x = np.array([len(s) for s in sets]), np.concatenate(sets)
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.view(np.int64)))
                odd = np.zeros((len(ODD), len(sets)), U)
                if full := np.flatnonzero(n).tolist():
                    h = mix(x ^ U(0x94D049BB133111EB))
                    word, bit = h % U(len(ODD)), U(1) << (h >> U(58))
                    for i in range(len(ODD)):
                        odd[i, full] = np.bitwise_xor.reduceat(np.where(word == U(i), bit, U(0)), ends[full])
                yield pa.RecordBatch.from_arrays([batch.slice(a, len(sets)).column(0), lists, *(pa.array(o.view(np.int64)) for o in odd)], names=["id", "shingles", *ODD])

    return of


def _beside(d: DataFrame, right: DataFrame, heavy: DataFrame) -> DataFrame:
    """``d`` (a, b, ...) joined to ``right`` on b. Rows of a b in ``heavy`` (b, parts) are dealt over so many tasks, each
    with a copy of b's row, so that the leader of a large group is no task of its own."""
    d = d.join(heavy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    right = right.join(heavy, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return d.join(right, ["b", "salt"]).drop("salt")


def _heavy(pairs: DataFrame) -> DataFrame:
    n = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
    return broadcast_if_small(written(n.select("b", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "heavy"))


def _compared(pairs: DataFrame, sets: DataFrame, heavy: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the size of the intersection and of the union of their sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    d = _beside(pairs.join(left, "a"), right, heavy)
    d = d.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
    return d.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


def _order(d: DataFrame) -> DataFrame:
    """(row, order, rare) of the members ``d`` (row, b, members, foreign, d) of groups of more than ``COMMON``: their differences d,
    of which so many are foreign to the leader b, in the order of the prefix filter, the first ``rare`` of them not common.

    Elements that many members share come last, the most common at the end: members made from one template have those in
    common, and at places so late that little of their difference is left to share. Each element is counted beside its
    equals, where its row already is, so there are as many rows as elements of differences; no element meets a table of
    common ones, and a task gets elements of a group, not the group. Smaller groups have no common element."""
    each = d.where(F.col("members") > COMMON).select("row", "b", "foreign", F.posexplode("d").alias("i", "element"))
    df = F.count("*").over(Window.partitionBy("b", "element"))
    each = each.select("row", (F.col("i") >= F.col("foreign")).alias("missing"), "element", df.alias("df"))
    place = F.struct(F.when(F.col("df") > COMMON, F.col("df")).otherwise(0).alias("df"), "missing", "element")
    each = each.groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("order"), F.count_if(F.col("df") <= COMMON).alias("rare"))
    return each.select("row", F.col("order.element").alias("order"), "rare")


def _ring(star: DataFrame, sets: DataFrame, joined: DataFrame, heavy: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of members of one leader's group with an open member, by the prefix filter on differences.

    All bounds are in whole numbers. With p = percent, up = 100 + p and down = 100 - p, a link of z and y has
    2 up |E(z) & E(y)| >= up (e(z) + e(y)) - down (|z| + |y|). If the first element they share is at place i of E(z), at
    most e(z) - i are shared, so reach(z) = up e(z) + down |z| - 2 up i is at least need(y) = up e(y) - down |y|, and
    likewise for y. Over all sizes y may have, that bounds the places of z worth a look: the prefix."""
    up, down = 100 + percent, 100 - percent
    some = star.groupBy("b").agg(F.count("*").alias("members"), F.count_if("open").alias("o")).where("members > 1 and o > 0").select("b", "members")
    label = joined.select(F.col("node").alias("a"), "component")
    d = star.join(some, "b").join(label, "a", "left").select("a", "b", "open", "members", F.coalesce("component", "a").alias("component"))
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"), *ODD), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    d = _beside(d.join(left, "a"), right, heavy)
    foreign, missing = F.array_sort(F.array_except("x", "y")), F.array_sort(F.array_except("y", "x"))
    d = d.select("a", "b", "open", "members", "component", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("nl"), F.size(foreign).alias("foreign"), F.concat(foreign, missing).alias("d"), *ODD)
    d = written(d.withColumn("e", F.size("d").cast("long")).withColumn("row", F.monotonically_increasing_id()), "differences")
    d = d.join(_order(d), "row", "left").withColumn("order", F.coalesce("order", "d")).withColumn("from", F.coalesce("rare", "e"))

    most = F.expr(f"{down} * n div {percent}")  # elements in which a link's two sets may differ
    as_z = F.when(F.col("open"), F.least(F.col("e"), most + 1)).otherwise(0)
    as_y = F.greatest(F.lit(0), F.least(F.col("e"), most + 1, F.expr(f"(e * {up} + {down} * (n - nl) + {2 * up - 1}) div {2 * up}")))
    d = d.withColumn("pz", as_z.cast("int")).withColumn("py", as_y.cast("int"))
    prefix = F.slice("order", 1, F.greatest("pz", "py"))
    d = d.select("a", "b", "open", "component", "n", "nl", "e", "pz", "py", "from", *ODD, F.posexplode(prefix).alias("i", "element"))
    reach, need = F.expr(f"{up} * e + {down} * n - {2 * up} * i"), F.expr(f"{up} * e - {down} * n")
    least = F.expr(f"{up} * (e - ({down} * n div {percent})) - {down} * (n * 100 div {percent}) - {up + down}")  # of any y's need
    # Common elements meet only where need(y) can be within reach(z): by steps of need, so that a group's pairs are not all made.
    step = lambda c: F.floor(c / (F.greatest(F.lit(1), F.col("nl")) * up / 16)).cast("int")
    is_common = F.col("i") >= F.col("from")
    d = written(d.withColumn("own", F.when(is_common, step(need)).otherwise(0)).withColumn("low", F.when(is_common, step(least)).otherwise(0)).withColumn("high", F.when(is_common, step(reach)).otherwise(0)), "prefixes")
    z = d.where("i < pz and low <= high").withColumn("step", F.explode(F.sequence("low", "high")))
    z = z.select("element", F.col("b").alias("l"), "step", *(F.col(c).alias(f"z_{c}") for c in ("a", "component", "n", "e", "i", *ODD)))
    y = d.where("i < py").select("element", F.col("b").alias("l"), F.col("own").alias("step"), *(F.col(c).alias(f"y_{c}") for c in ("a", "open", "component", "n", "e", "i", *ODD)))
    rest = F.least(F.col("z_e") - F.col("z_i"), F.col("y_e") - F.col("y_i"))
    fits = 2 * up * rest >= up * (F.col("z_e") + F.col("y_e")) - down * (F.col("z_n") + F.col("y_n"))
    sizes = F.least("z_n", "y_n") * 100 >= F.greatest("z_n", "y_n") * percent
    once = (F.col("z_a") != F.col("y_a")) & (~F.col("y_open") | (F.col("y_a") < F.col("z_a"))) & (F.col("z_component") != F.col("y_component"))
    apart = sum((F.bit_count(F.col(f"z_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in ODD), F.lit(0))
    close = up * apart <= down * (F.col("z_n") + F.col("y_n"))
    met = z.join(y, (z["element"] == y["element"]) & (z["l"] == y["l"]) & (z["step"] == y["step"]) & once & sizes & fits & close)
    return written(met.select(F.col("z_a").alias("a"), F.col("y_a").alias("b")).distinct(), "ring")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, text_hash, n_shingles, component_id (smallest id reachable over links of ``percent`` or more
    Jaccard similarity; null without an id), kept."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), fingerprint(text).alias("text_hash"), text.cast("string").alias("t"))
    sig = written(rows.mapInArrow(_signature(shingle), SIGNATURE), "signatures")
    some = sig.where("n_shingles > 0 and id is not null")
    classes = written(some.groupBy("s1", "s2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    member = some.join(classes, ["s1", "s2", "n_shingles"])

    bands = member.where("id = rep").select("rep", "text_hash", F.explode("bands").alias("k"))
    many = written(bands.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    mates = written(bands.join(many, "k"), "mates")  # k, rep, text_hash, c
    score = mates.groupBy("rep").agg(F.sum("c").alias("score"))
    lead = mates.join(score, "rep").groupBy("k").agg(F.max(F.struct("score", (-F.col("rep")).alias("m"))).alias("best"))
    lead = written(lead.select("k", (-F.col("best.m")).alias("leader")), "leaders")

    able = written(mates.select(F.col("rep").alias("id"), "text_hash").distinct(), "able")
    sets = written(rows.join(broadcast_if_small(able), ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]).select("id", "t").mapInArrow(_sets(shingle), SETS), "sets")

    star = mates.join(lead, "k").where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    star = written(star, "star-pairs")
    heavy = _heavy(star)
    star_pairs, star = star, written(_compared(star, sets, heavy), "star")
    near = F.col("both") * 100 >= F.col("either") * percent

    joined = components(star.where(near).select("a", "b"))
    candidates = _ring(star.withColumn("open", ~near), sets, joined, heavy, percent)
    ring_heavy = _heavy(candidates)
    ring = _compared(candidates, sets, ring_heavy)

    links = star.where(near).select("a", "b").union(ring.where(near).select("a", "b")).union(member.where("id <> rep").select("id", "rep"))
    found = components(links)
    discard(many, mates, lead, able, sets, classes, star_pairs, star, heavy, joined, candidates, ring_heavy)
    out = sig.join(found, sig["id"] == found["node"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
