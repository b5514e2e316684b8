"""The queries of the thirteen operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstoken, decontaminate, exact, licenses, lines, near, packing, pieces, pii, quality, sharding, toxicity, whitening
from .training import held_out

SHARDS, CAPACITY, COMPONENTS = 16, 1024, 32
#: The session setting that holds the key of the pseudonyms; without it, a key that only development may use.
KEY_SETTING, DEVELOPMENT_KEY = "spark.mapweave.pseudonym.key", "development"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", join("base_labels"), join("labels"), "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = lines.remove(docs, numbers="dropped")
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), "text")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.near_groups(table(spark, sf_dir, "documents"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, spark.conf.get(KEY_SETTING, DEVELOPMENT_KEY), kinds="kinds")
    return out.select("doc_id", F.size("kinds").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"), "text")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), CAPACITY).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), COMPONENTS)
    return out.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))  # null where it is no long


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository: ship it with the package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_licenses, op3_line_dedup, op4_near_dedup, op5_shards, op6_pii, op7_packing, op8_exact_dedup, op9_toxicity, op10_quality,
        op11_crosstoken, op12_pieces, op13_whitening, pipeline,
    )
}

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

#: Lines with their places, each distinct line's first place and the first place of another line within one edit of it.
#: The edit distance of DuckDB counts bytes, so it only narrows the pairs; the comparison around one place counts characters.
_LINES = r"""l AS (SELECT doc_id, i - 1 AS nth, string_split(text, chr(10))[i] AS raw FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
        t AS (SELECT *, {'d': doc_id, 'n': nth} AS place, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
        f AS (SELECT line, length(line) AS n, min(place) AS first FROM t WHERE line <> '' GROUP BY line),
        near AS (SELECT a.line, min(b.first) AS other FROM (SELECT *, unnest([n - 1, n, n + 1]) AS m FROM f) a JOIN f b ON b.n = a.m
                 WHERE a.line <> b.line AND b.first < a.first AND levenshtein(a.line, b.line) <= 4
                 AND len(list_filter(range(0, a.n + 1), lambda i: left(a.line, i) = left(b.line, i) AND (substr(a.line, i + 2) = substr(b.line, i + 2) OR substr(a.line, i + 2) = substr(b.line, i + 1) OR substr(a.line, i + 1) = substr(b.line, i + 2)))) > 0
                 GROUP BY a.line),
        gone AS (SELECT t.*, coalesce(line <> '' AND (place <> first OR other IS NOT NULL), FALSE) AS gone FROM t LEFT JOIN f USING (line) LEFT JOIN near USING (line))"""

#: The checksum's table of 256 values by its rule, and the checksum of a text by folding its bytes over it.
_CRC = """c AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
        x AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM documents)"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
               FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
        ns AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
        hit AS (SELECT DISTINCT doc_id, p, dw.n AS n FROM dw SEMI JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH r AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept, sha256(norm) AS text_sha256 FROM r""",
    "op3_line_dedup": f"""
        WITH {_LINES},
        g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(CAST(nth AS VARCHAR), ',' ORDER BY nth) FILTER (gone) AS dropped,
              string_agg(raw, chr(10) ORDER BY nth) FILTER (NOT gone) AS left_ FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 1) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(dropped, '') AS dropped,
               CASE WHEN text IS NOT NULL THEN coalesce(left_, '') END AS text
        FROM documents d LEFT JOIN g USING (doc_id)""",
    "op4_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.shared >= 80 * (x.n + y.n - p.shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
        c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(component, d.doc_id)) AS component_id, least(d.doc_id, coalesce(component, d.doc_id)) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id""",
    "op5_shards": f"""
        WITH {_CRC},
        h AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) AS text_crc32 FROM x, c),
        o AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM h),
        p AS (SELECT doc_id, size, text_crc32, least((before * 2 + size) * 16 // (total * 2), 15) AS shard FROM o)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p""",
}
