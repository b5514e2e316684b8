"""Alignment, piece encoding and whitening against the libraries and brute force; the sample that classifiers learn from."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapweave.llm import crosstoken, pieces, queries, training, whitening
from mapweave.llm.packing import vocabulary_path

SF = "/root/testdata/sf0.001"
A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, row int, a int, v string, w string"
AWKWARD = [None, "", " ", "   a  ", "a▁b", "▁", "<|endoftext|> x", "<s>a</s><0x41>", "😀é\n\n  x\t\x00", "ﬁ 漢字 ĺ", "ab" * 3000, " " * 5000, "thethe" * 500, "the same", "the same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, "clash", i, 1, "v", "w") for i, t in enumerate(AWKWARD)]
    real = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text")
    return spark.createDataFrame(rows, SCHEMA).unionByName(real, allowMissingColumns=True)


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def key(d, *cols):
    return sorted((repr(tuple(r)) for r in d.select(*cols).collect()))


def test_pieces_on_random_texts(library):
    model, sp, r = pieces.loaded(B), library[1], random.Random(1)
    letters = "ab  ▁\t\n\x00é漢😀ﬁ<>0x41s/ZzthetheingInternationaĺ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(r.choice(list(model.ids)[:2000]) for _ in range(6)) for _ in range(5000)]
    assert all(model.encode(t).tolist() == ids for t, ids in zip(texts, sp.encode(texts), strict=True))
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3), 28705]) for _ in range(r.randint(0, 8))]
        assert model.decode(np.array(ids, np.int64)) == sp.decode(ids)


def test_pieces_query(docs, library):
    sp, want = library[1], []
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want.append(repr((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())))
    assert key(pieces.digests(docs), "id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)
    some = pieces.encode(docs.where("doc_id < 14")).collect()
    assert len(some) == 13 and all(sp.decode(r.ids) == r.decoded for r in some)
    assert pieces.digests(docs.limit(0)).count() == 0


def plain_alignment(text, library):
    """(n_a, n_b, groups as text, counted pairs) by walking over all pairs of tokens that touch."""
    if not text:
        return None
    a, b = library[0].encode(" " + text, add_special_tokens=False).ids, library[1].encode(text)
    table = crosstoken.token_bytes(A)
    ta = [table[i] for i in a]
    tb = [bytes([int(library[1].id_to_piece(i)[1:-1], 16)]) if library[1].is_byte(i) else library[1].id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(ta) != (" " + text).encode() or b"".join(tb) != (" " + text).encode():
        return None
    ends = [np.cumsum([len(x) for x in t]).tolist() for t in (ta, tb)]
    groups, i, j, pairs = [], 0, 0, Counter()
    for end in sorted(set(ends[0]) & set(ends[1])):
        i0, j0 = i, j
        while i < len(a) and ends[0][i] <= end:
            i += 1
        while j < len(b) and ends[1][j] <= end:
            j += 1
        groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        for x in range(i0, i):
            for y in range(j0, j):
                if ends[1][y] > ends[0][x] - len(ta[x]) and ends[1][y] - len(tb[y]) < ends[0][x]:
                    pairs[a[x], b[y]] += 1
    return len(a), len(b), groups, pairs


def test_alignment(docs, library):
    found = [(r.doc_id, plain_alignment(r.text, library)) for r in docs.collect()]
    held = Counter(p for _, f in found if f for p in f[3])
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    want = []
    for i, f in found:
        if not f:
            want.append(repr((i, 0, 0, 0, 0, 0, 0, "")))
            continue
        n_a, n_b, groups, pairs = f
        best, total = sum(n for p, n in pairs.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in pairs.items())
        want.append(repr((i, n_a, n_b, len(groups), sum(pairs.values()), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    cols = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for most_pairs in (crosstoken.TABLE_PAIRS, 300, 0):  # all looked up, some joined, all joined
        assert key(crosstoken.align(docs, table_pairs=most_pairs), *cols) == sorted(want)
    assert crosstoken.align(docs.limit(0)).count() == 0


def test_galloping():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 900), (40, 50), (700, 5000)):
        long = np.unique(r.integers(1, 10 * m, m))
        short = np.unique(np.append(r.integers(1, long[-1] + 1, n), long[-1]))
        assert (crosstoken.gallop(short, long) == np.searchsorted(long, short)).all()


def turned(values, r):
    q = np.linalg.qr(r.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(len(q), dtype=q.dtype) - q.T @ q / 2)
    a = (q * np.asarray(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("gap,close", [(1e-2, 1e-15), (1e-5, 1e-12), (1e-8, 1e-9)])
def test_refinement_of_clusters(gap, close):
    r = np.random.default_rng(0)
    values = np.array([3, 3 - gap, 3 - 2 * gap, *np.linspace(2, 1, 29)], np.longdouble)
    a, q = turned(values, r)
    _, start = np.linalg.eigh(a.astype(np.float32))
    found, x = whitening.refine(a, start[:, ::-1])
    assert np.abs(found - values).max() < 1e-16 and np.abs(x.T @ x - np.eye(32)).max() < 1e-15
    assert np.abs(x - q * np.sign((x * q).sum(0))).max() < close


def test_refinement_of_equal_values():
    a, _ = turned([2.0] * 5 + [1.0] * 5 + [0.0] * 3, np.random.default_rng(1))
    _, start = np.linalg.eigh(a.astype(np.float32))
    found, x = whitening.refine(a, start[:, ::-1])
    assert np.abs(a @ x - x * found).max() < 1e-16 and np.abs(x.T @ x - np.eye(13)).max() < 1e-13


def test_whitening(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    nan = float("nan")
    bad = [(1000, None), (1001, [nan] * 64), (1002, [None] * 64), (1003, [float("inf")] * 64), (1004, [1.0, 2.0]), (1005, []), (None, [0.25] * 64), (7, [0.25] * 64)]
    both = d.union(spark.createDataFrame(bad, "vec_id long, embedding array<double>")).withColumn("id", F.lit("clash")).withColumn("w", F.lit(1)).withColumn("v", F.lit(2))
    rows = [(r.vec_id, r.embedding) for r in d.collect()] + bad[-2:]
    x = np.floor(64 * np.array([v for _, v in rows])).astype(object).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = y @ vectors / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(1)
    got = whitening.whiten(both).collect()
    assert len(got) == 32 * n and {(r.n, type(r.n)) for r in got} == {(n, int)} and max(r.identity_error for r in got) < 1e-12
    assert sorted((str(r.id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in range(1, 33))
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(map(int, deviation))
    trace = np.trace(y.T @ y / n)
    assert all(abs(r.explained - values[r.component - 1] / trace) < 1e-12 for r in got)
    at = {i: k for k, (i, _) in enumerate(rows) if i not in (None, 7)}
    mine = np.zeros((n, 32))
    for r in got:
        if r.id in at:
            mine[at[r.id], r.component - 1] = r.whitened
    keep = sorted(at.values())
    sign = np.sign((mine[keep] * want[keep]).sum(0))
    assert np.abs(mine[keep] - want[keep] * sign).max() < 1e-8
    again = {(str(r.id), r.component): r.whitened for r in whitening.whiten(both.repartition(7)).collect()}
    assert max(abs(again[str(r.id), r.component] - r.whitened) for r in got if r.id not in (None, 7)) < 1e-12  # exact sums: the partitions do not matter


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(make([(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in one] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    big = whitening.whiten(make([(i, [float(i) * 2**40, 1.0]) for i in range(4)])).collect()
    assert {int(r.deviation) for r in big} == {(64 * 2**40 * (4 * i - 6)) ** 2 for i in range(4)}  # beyond a long, exact
    assert {r.whitened for r in big if r.component == 2} == {0.0} and sum(r.whitened**2 for r in big if r.component == 1) == pytest.approx(4)


def test_sample_is_bounded_by_rows_alone(spark):
    ids = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, t) for i in ids for t in ("x" * 200_000, "y", "y", None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, one) for i in ids for one in (0, 1, None)], "doc_id long, toxic int")
    got = training.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == 10 and len({r.doc_id for r in got}) == 10 and {r.y for r in got} == {1} and len({r.text for r in got}) == 1
    assert len(training.labelled_sample(docs, labels, "toxic", 1000).collect()) == len(ids)


def test_queries_of_the_three(spark):
    for name, cols in (("op11_crosstoken", 8), ("op12_pieces", 4), ("op13_whitening", 7)):
        d = queries.QUERIES[name](spark, SF)
        assert len(d.columns) == cols and d.count() > 0
