"""Toxicity: a factorization machine over hashed terms.

A text is the set of its words and of their first five bytes, hashed to 2^18 terms. The machine has a weight for each term and, by the inner product of
factors, one for each pair of terms of the text (an insult beside a group's name). It is fitted by AdaGrad in numpy on a
bounded sample of labelled rows (``rows``), and applied to whole texts in Arrow batches; the model is a broadcast of fixed
size. Terms of fewer than ``least`` sample texts have neither; of the others all have factors, but only those that differ
between the classes by themselves have a weight: a group's name, as common in clean as in toxic texts, counts in pairs.

Defined results: null and empty texts have no terms and get the score of the bias; without any labelled row every score is
0.0001; repeated rows get equal scores and an empty table an empty result; extra columns are kept, but for one named as ``into``,
which is replaced by the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spare
from .hashing import U, alphanumeric, slices, word_hashes
from .training import labelled_sample

BITS = 18
PREFIX = 5


class Machine(NamedTuple):
    place: np.ndarray  # of each term: its row in w and v, the last row (zeros) if it has none
    w: np.ndarray
    v: np.ndarray
    bias: float


def term_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct terms of the rows one after another, bounds of the rows in them) for runs of rows."""
    ok = alphanumeric()
    for a, b, data, bounds in slices(column):
        h, at = word_hashes(data, bounds, ok, PREFIX)
        row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(at))
        key = np.unique((row << BITS) | (h >> U(64 - BITS)).astype(np.int64))
        yield a, key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(b - a + 1))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between the bounds, zero for empty ranges."""
    total = np.concatenate([np.zeros((1, *x.shape[1:]), np.float64), np.cumsum(x, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def logits(m: Machine, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    at = m.place[terms]
    v = m.v[at]
    s = _sums(v, bounds)
    return m.bias + _sums(m.w[at], bounds) + 0.5 * ((s * s).sum(1) - _sums((v * v).sum(1), bounds))


def fit(sets: list[np.ndarray], y: np.ndarray, factors: int = 8, epochs: int = 12, least: int = 4, apart: float = 10.8, rate: float = 0.1, decay: float = 1e-5, shrink: float = 1e-3, patience: int = 3) -> Machine:
    """AdaGrad on the logistic loss, in mini-batches, twice: weights and factors of the terms that differ between the classes
    (chi-square above ``apart``), then, with weights and bias held, the factors of every term on what is left. The second
    pass shrinks the factors of the other terms as groups by ``shrink`` a step, so that those without a pair end at zero;
    it ends early after ``patience`` epochs in which the loss fell by less than a hundredth."""
    count = lambda some: np.bincount(np.concatenate([*some, np.zeros(0, np.int64)]), minlength=1 << BITS).astype(float)
    seen, toxic = count(sets), count([x for x, one in zip(sets, y, strict=True) if one])
    all_, ones = len(y), float(np.sum(y))
    differ = np.maximum(np.abs(toxic * all_ - seen * ones) - all_ / 2, 0) ** 2 * all_
    known = np.flatnonzero(seen >= least)
    alone = np.append((differ > apart * seen * (all_ - seen) * ones * (all_ - ones))[known], False)
    place = np.full(1 << BITS, len(known), np.int32)
    place[known] = np.arange(len(known))
    random = np.random.default_rng(7)
    w, v = np.zeros(len(known) + 1), random.normal(0, 0.02, (len(known) + 1, factors))
    rate_y = min(max(float(np.mean(y)) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    start = np.where(alone, 1e-2, 1.0)
    bias, gw, gv, gb = float(np.log(rate_y / (1 - rate_y))), start.copy(), np.repeat(start[:, None], factors, 1), 1e-2
    sets = [place[x] for x in sets]
    sets = [x[x < len(known)] for x in sets]
    strong = [x[alone[x]] for x in sets]
    best, stale = np.inf, 0
    for epoch in range(2 * epochs if len(y) else 0):
        pairs, loss = epoch >= epochs, 0.0
        if stale == patience:
            break
        some, order = sets if pairs else strong, random.permutation(len(y))
        for k in range(0, len(order), 64):
            pick = order[k : k + 64]
            at = np.concatenate([some[i] for i in pick])
            n = np.array([len(some[i]) for i in pick])
            bounds = np.concatenate([[0], np.cumsum(n)])
            here, at = np.unique(at, return_inverse=True)  # only these rows have a gradient
            wh, vh = w[here], v[here]
            va = vh[at]
            s = _sums(va, bounds)
            z = bias + _sums(wh[at], bounds) + 0.5 * ((s * s).sum(1) - _sums((va * va).sum(1), bounds))
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            loss -= np.log(np.maximum(1 - np.abs(d), 1e-12)).sum()
            each = np.repeat(d, n)
            pull = each[:, None] * (np.repeat(s, n, axis=0) - va)
            dv = np.stack([np.bincount(at, pull[:, j], len(here)) for j in range(factors)], 1) + decay * len(pick) * vh * 10
            gv[here] += dv**2
            vh = vh - rate * 0.3 * dv / np.sqrt(gv[here])
            if pairs:
                left = np.maximum(1 - shrink / np.maximum(np.linalg.norm(vh, axis=1), 1e-12), 0)
                v[here] = vh * np.where(alone[here], 1.0, left)[:, None]
                continue
            v[here] = vh
            dw = np.bincount(at, each, len(here)) + decay * len(pick) * wh
            gw[here] += dw**2
            gb += d.sum() ** 2
            w[here] -= rate * dw / np.sqrt(gw[here])
            bias -= rate * d.sum() / np.sqrt(gb)
        if pairs:
            stale = 0 if loss < 0.99 * best else stale + 1
            best = min(best, loss)
    w[-1], v[-1] = 0, 0
    return Machine(place, w.astype(np.float32), v.astype(np.float32), bias)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, terms, bounds in term_sets(batch.column(0)):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(terms.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, len(lists)), lists, batch.column(2).slice(a, len(lists))], names=["y", "terms", "of"])


def train(docs: DataFrame, labels: DataFrame, rows: int = 10_000) -> Machine:
    """Fitted on at most ``rows`` labelled documents; their term ids, not their texts, come to the driver."""
    sample = labelled_sample(docs, labels, "toxic", rows).select("text", "y", "doc_id")
    got = sample.mapInArrow(_terms, "y int, terms array<int>, of long").toArrow().sort_by([("of", "ascending"), ("y", "ascending")])
    flat, ends = got.column("terms").combine_chunks(), None
    ends = flat.offsets.to_numpy() if len(got) else np.zeros(1, np.int64)
    values = flat.values.to_numpy(zero_copy_only=False).astype(np.int64) if len(got) else np.zeros(0, np.int64)
    sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit(sets, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text in ``into``; only the text goes through Python."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        out = [logits(sent.value, terms, bounds) for _, terms, bounds in term_sets(texts)]
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate([*out, np.zeros(0)]), -30, 30))))

    return docs.withColumn(into, of(F.col(text_col).cast("string")))


def remove(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold."""
    (of,) = spare(docs, "toxicity")
    return score(docs, machine, text_col=text_col, into=of).where(F.col(of) < threshold).select(docs.columns)
