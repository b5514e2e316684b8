"""Whitening of embeddings by eigenvectors in mixed precision.

Entries become whole numbers, so sums and the covariance are exact whatever the partitions: a first pass counts and sums,
a second multiplies the entries less the whole number nearest to their mean, and the driver gets D (D + 1) / 2 sums, which
depend on the dimension alone. The eigenvectors start as those of the covariance in 32 bits. Ogita and Aishima's iteration
corrects them with matrix products in extended precision: the defect from orthonormality and from diagonality gives, for
each pair of vectors, the share of one to add to the other. Where eigenvalues are too close for that (within the error
that the products show), the vectors of the cluster are made orthonormal and turned by the eigenvectors of the small
matrix that the shifted covariance has among them; then the iteration goes on.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out; so are vectors of another
length than the most frequent one (of equally frequent ones the longest); a null id is an id; repeated rows count each;
extra columns are ignored; an empty table, or one without any vector that counts, gives an empty result. A component
whose eigenvalue vanishes has whitened 0 throughout (and so an identity_error of 1); entries beyond 2^52 are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How entries become whole numbers: floor(STEP c) + OFFSET.
STEP, OFFSET = 64, 1_000_000
EXTENDED = np.longdouble
AT_ONCE = 4096
BIG = pa.decimal128(38, 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _steps(column: pa.Array) -> np.ndarray:
    """floor(64 c) of each entry; OFFSET is added where results are reported, and drops out of every difference."""
    scaled = np.floor(_matrix(column).astype(float) * STEP)
    if scaled.size and np.abs(scaled).max() >= 2.0**52:
        raise ValueError("an entry is too large")
    return scaled


def _exact(x: np.ndarray, sizes: float) -> np.ndarray:
    """``x`` as numbers whose sums and products cannot overflow: doubles that hold whole numbers below 2^53, else Python's."""
    return x if sizes < 2.0**53 else np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)


def _big(values: np.ndarray) -> pa.Array:
    if values.dtype == object:
        return pa.array([int(v) for v in values], BIG)
    return pa.array(values.astype(np.int64)).cast(BIG)


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the vectors that count, all of one length; and that length, 0 if there are none."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))
    d = embeddings.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(ok)
    lengths = d.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    found = lengths.orderBy(F.desc("rows"), F.desc("n")).first()  # one row a length
    length = found.n if found else 0
    return d.where((F.size("v") == length) & (F.size("v") > 0)), length


def _summed(found: DataFrame) -> dict:
    """{(i, k): exact sum}, from (i, k, value) of the partitions: as many rows as the dimension says."""
    return {(r.i, r.k): r.value for r in found.groupBy("i", "k").agg(F.sum("value").alias("value")).collect()}


def _collect(d: DataFrame, of, size: int) -> np.ndarray:
    """The sum over blocks of rows of ``of(block)``, an exact vector of ``size`` whole numbers; one such vector leaves a partition."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=object)
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                total += of(_steps(batch.column(0).slice(a, AT_ONCE))).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([int(v) for v in total], BIG)], names=["i", "value"])

    rows = d.select("v").mapInArrow(partial, "i int, value decimal(38,0)").groupBy("i").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, dtype=object)
    for r in rows:
        out[r.i] = int(r.value or 0)
    return out


def moments(d: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]], list[int]]:
    """(n, whole numbers nearest to the means, n^2 times the covariance, sums of what is over the nearest numbers), of the
    entries in steps; all exact."""

    def counts(x: np.ndarray) -> np.ndarray:
        y = _exact(x, np.abs(x).max(initial=0) * len(x))
        return np.concatenate([[len(x)], y.sum(0).astype(object)])

    first = _collect(d, counts, 1 + dimension)
    n, sums = int(first[0]), [int(s) for s in first[1:]]
    if not n:
        return 0, [], [], []
    centre = [(2 * s + n) // (2 * n) for s in sums]
    at, upper = np.array(centre, float), np.triu_indices(dimension)

    def products(x: np.ndarray) -> np.ndarray:
        x = x - at
        y = _exact(x, np.abs(x).max(initial=0) ** 2 * len(x))
        return (y.T @ y)[upper].astype(object)

    over = [s - n * c for s, c in zip(sums, centre, strict=True)]
    flat = _collect(d, products, len(upper[0]))
    full = [[0] * dimension for _ in range(dimension)]
    for i, k, value in zip(*upper, flat, strict=True):
        full[i][k] = full[k][i] = n * int(value) - over[i] * over[k]
    return n, centre, full, over


def _extended(x: Fraction) -> np.longdouble:
    high = float(x)
    return EXTENDED(high) + EXTENDED(float(x - Fraction(high)))


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the symmetric matrix ``a``, by falling eigenvalue, from approximate
    eigenvectors ``x``; products are in the precision of ``a``. Clusters are solved by themselves."""
    eps, eye = np.finfo(a.dtype).eps, np.eye(len(a), dtype=a.dtype)
    x, size, before = x.astype(a.dtype), np.abs(a).sum(1).max(initial=0), np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding, divided by a small gap, would spoil the right angles
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[order][:, order], s[order][:, order]
        off = s - np.diag(values)
        close = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > close
        change = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ change
        turned = 0.0
        for one in _clusters(values, close):
            x[:, one], turn = _within(a, x[:, one], values[one].mean())
            turned = max(turned, turn)
        now = max(float(np.abs(change).max(initial=0)), turned)
        if now <= 4 * len(a) * eps or before / 4 <= now < 1e-6:  # squared in each round until rounding is met
            break
        before = now
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Places of runs of more than one falling value whose neighbours differ by at most ``close``."""
    starts = np.flatnonzero(np.concatenate([[True], values[:-1] - values[1:] > close]))
    return [np.arange(p, q) for p, q in zip(starts, [*starts[1:], len(values)], strict=True) if q - p > 1]


def _within(a: np.ndarray, x: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
    """The vectors of a cluster, made orthonormal and turned to the eigenvectors of the matrix shifted to the cluster; and
    how far they turned."""
    for _ in range(3):
        x = x @ (1.5 * np.eye(x.shape[1], dtype=x.dtype) - (x.T @ x) / 2)
    small = x.T @ (a @ x - shift * x)
    small = (small + small.T) / 2
    top = np.abs(small).max()
    if not top:
        return x, 0.0
    values, turn = np.linalg.eigh((small / top).astype(float))
    turn = turn[:, ::-1]
    # What the rounding of the small matrix hides is no turn to wait for.
    size = np.abs(turn - np.eye(len(turn)) * np.sign(np.diag(turn))).max()
    real = np.abs(small - np.diag(np.diag(small))).max() > 64 * np.finfo(a.dtype).eps * np.abs(a).sum(1).max()
    return x @ turn.astype(x.dtype), float(size) if real else 0.0


def components(n: int, scaled: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.longdouble]:
    """(eigenvalues, eigenvectors, trace) of the covariance scaled / n^2; the longest entry of a vector is positive."""
    a = np.array([[_extended(Fraction(v, n * n)) for v in row] for row in scaled], dtype=EXTENDED)
    trace = _extended(Fraction(sum(scaled[i][i] for i in range(len(scaled))), n * n))
    unit = max(float(np.abs(a).max(initial=0)), 1e-300)
    _, start = np.linalg.eigh((a / unit).astype(np.float32))
    values, x = refine(a / unit, start[:, ::-1])
    x = x / np.sqrt((x * x).sum(0))
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
    return values * unit, x, trace


def whiten(embeddings: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each of its first ``most`` components: id, component (from 1), n, deviation (exact,
    decimal), whitened, explained, identity_error (measured on the whitened values themselves)."""
    d, dimension = vectors(embeddings, id_col, vector_col)
    n, centre, scaled, over = moments(d, dimension)
    k = min(most, dimension)
    if n:
        values, x, trace = components(n, scaled)
        alive = values[:k] > 64 * dimension * np.finfo(float).eps * values[0]
        turn = np.where(alive, x[:, :k] / np.sqrt(np.where(alive, values[:k], 1)), 0).astype(float)
        shares = [float(v / trace) if trace else 0.0 for v in values[:k]]
        mean = np.array([_extended(Fraction(o, n)) for o in over]).astype(float)
    else:
        turn, shares, mean = np.zeros((0, 0)), [], np.zeros(0)
    at, rest = np.array(centre, float), np.array(over, dtype=object)

    def turned(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        y = _steps(column) - at
        return y, (y - mean) @ turn

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                y, w = turned(part.column(1))
                off = n * np.abs(y).max(initial=0) + max(map(abs, over), default=0)
                z = y.astype(np.int64) * n - rest.astype(np.int64) if off**2 * dimension < 2.0**62 else np.array([[int(v) for v in r] for r in y], dtype=object).reshape(y.shape) * n - rest
                bounds = pa.array(np.arange(0, len(w) * k + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), _big((z * z).sum(1)), pa.ListArray.from_arrays(bounds, pa.array(w.ravel()))], names=["id", "deviation", "w"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and products of whitened values."""
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                _, w = turned(batch.column(0).slice(a, AT_ONCE))
                w = np.hstack([np.ones((len(w), 1)), w])
                total += w.T @ w
        rows, cols = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], names=["i", "k", "value"])

    error = 0.0
    if n:
        got = _summed(d.select("v").mapInArrow(spread, "i int, k int, value double"))
        error = max(abs(got[i + 1, j + 1] / n - got[0, i + 1] / n * got[0, j + 1] / n - (i == j)) for i in range(k) for j in range(i, k))
    rows = d.mapInArrow(project, "id long, deviation decimal(38,0), w array<double>")
    share = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    out = rows.select("id", "deviation", F.posexplode("w").alias("p", "whitened"))
    return out.select(
        "id", (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("p")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )
