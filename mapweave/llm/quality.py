"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded in 8 numbers; 24 filters of 8 bytes at every fourth byte slide over chunks of 512 bytes, each chunk
overlapping the next by 64, so that the chunks cover the whole text. Each filter is max-pooled over a chunk; the mean of
the chunks' pooled vectors gives, through one layer, the probability. Fitted by Adam on a bounded sample of labelled rows
(``rows``; texts up to 100,000 bytes) and applied to whole texts in Arrow batches; the model has a fixed size of 30 KB.

Defined results: null and empty texts are one chunk of padding and get its score; without labelled rows the score is 0.5;
repeated rows get equal probabilities, whatever ties there are, and an empty table an empty result; extra columns are
kept, but for one named as ``into``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import labelled_sample

DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 24, 16
CHUNK, STEP = 128, 112  # in strides: 512 bytes, 64 of them shared with the next chunk
AT_ONCE = 1 << 20

Net = dict[str, np.ndarray]


def start_net(seed: int = 11) -> Net:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.normal(0, scale, s)).astype(np.float32)
    return {
        "E": f(256, DIM, scale=0.5), "W": f(WIDTH * DIM, FILTERS, scale=0.2), "b": np.zeros(FILTERS, np.float32), "H": f(FILTERS, HIDDEN, scale=0.3),
        "h": np.zeros(HIDDEN, np.float32), "u": f(HIDDEN, 1, scale=0.3), "c": np.zeros(1, np.float32),
    }


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes (each text from a multiple of STRIDE on, WIDTH bytes of padding at its end), chunks' first and end
    positions, and the first chunk of each text."""
    sizes = [-(-len(t) // STRIDE) * STRIDE + WIDTH for t in texts]
    data = np.zeros(sum(sizes) + STRIDE, np.uint8)
    starts, ends, first, at = [], [], [], 0
    for t, size in zip(texts, sizes, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        first.append(len(starts))
        n = max(1, -(-len(t) // STRIDE))
        for s in range(0, max(1, n - (CHUNK - STEP)), STEP):
            starts.append(at // STRIDE + s)
            ends.append(at // STRIDE + min(n, s + CHUNK))
        at += size
    return data, np.array(starts), np.array(ends), np.array(first)


def convolve(net: Net, data: np.ndarray) -> np.ndarray:
    """Filter responses at every position but the last, which is padding."""
    blocks = net["E"][data].reshape(-1, STRIDE * DIM)
    half = STRIDE * DIM
    out = blocks[:-1] @ net["W"][:half]
    out += blocks[1:] @ net["W"][half:]
    return out


def head(net: Net, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(mean @ net["H"] + net["h"], 0)
    return hidden, (hidden @ net["u"])[:, 0] + net["c"][0]


def runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    found = [np.zeros(0)]
    for run in runs(texts):
        data, starts, ends, first = layout(run)
        out = convolve(net, data)
        pooled = np.maximum.reduceat(out, np.stack([starts, ends], 1).ravel(), axis=0)[::2]
        pooled = np.maximum(pooled + net["b"], 0)
        n = np.diff([*first, len(starts)])[:, None]
        _, z = head(net, np.add.reduceat(pooled, first, axis=0) / n)
        found.append(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))))
    return np.concatenate(found)


def gradients(net: Net, texts: list[bytes], y: np.ndarray) -> Net:
    data, starts, ends, first = layout(texts)
    out = convolve(net, data)
    at = np.stack([s + out[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])  # chunk, filter: position
    raw = out[at, np.arange(FILTERS)] + net["b"]
    n = np.diff([*first, len(starts)])
    mean = np.add.reduceat(np.maximum(raw, 0), first, axis=0) / n[:, None]
    hidden, z = head(net, mean)
    d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)[:, None]
    g: Net = {"u": hidden.T @ d, "c": d.sum(0)}
    dh = (d @ net["u"].T) * (hidden > 0)
    g["H"], g["h"] = mean.T @ dh, dh.sum(0)
    dp = np.repeat(dh @ net["H"].T / n[:, None], n, axis=0) * (raw > 0)
    g["b"] = dp.sum(0)
    seen = data[(at * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
    g["W"] = np.einsum("cf,cfk->kf", dp, net["E"][seen].reshape(*seen.shape[:2], -1), optimize=True)
    g["E"] = np.zeros_like(net["E"])
    back = dp[:, :, None, None] * net["W"].T.reshape(FILTERS, WIDTH, DIM)
    np.add.at(g["E"], seen.ravel(), back.reshape(-1, DIM))
    return g


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 4e-3) -> Net:
    net, r = start_net(), np.random.default_rng(5)
    m, v, t = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    if not len(y):
        return net | {"u": np.zeros_like(net["u"])}
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            g, t = gradients(net, [texts[i] for i in pick], y[pick]), t + 1
            step = rate * (1 - epoch / epochs) + 1e-4
            for name in net:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                net[name] = (net[name] - step * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = 2000) -> Net:
    got = labelled_sample(docs, labels, "quality", rows).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return fit([t.encode() for t in got.column("text").to_pylist()], got.column("y").to_numpy().astype(np.float32))


def score(docs: DataFrame, net: Net, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text in ``into``; only the text goes through Python."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(net, [(t or "").encode() if isinstance(t, str) else b"" for t in texts]))

    return docs.withColumn(into, of(F.col(text_col).cast("string")))
