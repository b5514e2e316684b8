"""Vectorised hashing of the words of Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(PRIME, -1, 1 << 64)
SLICE_BYTES = 1 << 18  # the temporaries of a slice, some dozens of bytes for each of its own, stay near the caches
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            made = np.full(max(n, SLICE_BYTES), base, U)
            made[0] = 1
            np.multiply.accumulate(made, out=made)
        if n > 4 * SLICE_BYTES:
            return made
        _powers[base] = made
    return _powers[base][:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds in them) of runs of rows of about SLICE_BYTES; null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of is_word within a row, A-Z lower-cased), and the rows' bounds among them. With
    ``prefix``, each word is followed by the hash of its first so many bytes (another hash than that of a word)."""
    n = len(data)
    lowered = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    word = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], word[:-1]]) if n else word
    after = np.concatenate([word[1:], [False]]) if n else word
    first = np.flatnonzero(word & (~before | edge[:n]))
    last = np.flatnonzero(word & (~after | edge[1:]))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum((lowered.astype(U) + U(1)) * powers(PRIME, n), out=total[1:])
        start = powers(INVERSE, n)[first] if n else np.zeros(0, U)
        h = mix((total[last + 1] - total[first]) * start ^ ((last - first + 1).astype(U) * U(0xD6E8FEB86659FD93)))
        if prefix:
            short = mix((total[np.minimum(last + 1, first + prefix)] - total[first]) * start ^ U(0xA0761D6478BD642F))
            h = np.stack([h, short], 1).ravel()
    return h, np.searchsorted(first, bounds) * (2 if prefix else 1)


def space_separated() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    ok = np.ones(256, bool)
    ok[[32, 9, 10, 11, 12, 13]] = False
    return ok


def alphanumeric() -> np.ndarray:
    """Bytes of words of digits, letters and non-ASCII characters."""
    ok = np.zeros(256, bool)
    ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    return ok
