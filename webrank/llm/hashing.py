"""Vectorised 64-bit hashing of whole Arrow batches of text: no loop over characters, words or shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; grows by doubling and is kept."""
    have = _powers.get(int(base))
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * (have[-1:] * base)])
    _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """``H`` with ``len + 1`` entries, such that ``(H[e] - H[s]) * INVERSE**s`` depends on ``values[s:e]`` alone."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its ``len + 1`` offsets into them; a null has length 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word; a word is a run of characters other than space, tab, CR and LF."""
    data, offsets = string_buffers(arr)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = np.zeros(n + 1, bool)
    gap[:n] = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    gap[n] = True
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:]
    stop = gap | edge
    stop[1:] &= ~gap[:-1]
    stop[0] = False
    s, e = np.flatnonzero(start), np.flatnonzero(stop)
    H = prefix_hash(data)
    words = mix((H[e] - H[s]) * powers(INVERSE, n + 1)[s])
    return words, np.searchsorted(offsets, s, side="right") - 1


def word_shingles(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` consecutive words inside a row, repeats included."""
    words, rows = word_hashes(arr)
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(size):
        h = h * BASE + words[i : i + m]
    inside = rows[:m] == rows[size - 1 :]
    return mix(h[inside]), rows[:m][inside]


def char_codes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the ``len + 1`` offsets (in characters) of the rows."""
    texts = [x or "" for x in arr.to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, offsets


def char_shingles(arr: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` consecutive characters inside a row, repeats included."""
    codes, offsets = char_codes(arr)
    m = len(codes) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(size):
        h = h * BASE + codes[i : i + m].astype(np.uint64)
    rows = np.searchsorted(offsets, np.arange(m), side="right") - 1
    last = np.searchsorted(offsets, np.arange(size - 1, size - 1 + m), side="right") - 1
    inside = rows == last
    return mix(h[inside]), rows[inside]


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs without repeats, sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]


def row_slices(arr: pa.Array, limit: int) -> list[tuple[int, int]]:
    """``(start, length)`` of runs of rows with at most ``limit`` bytes of text each, one row at least."""
    _, offsets = string_buffers(arr)
    out, at = [], 0
    while at < len(arr):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = max(end, at + 1)
        out.append((at, end - at))
        at = end
    return out


def window_hashes(H: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` values from their :func:`prefix_hash`."""
    m = len(H) - size
    if m <= 0:
        return np.zeros(0, np.uint64)
    return mix((H[size:] - H[:-size]) * powers(INVERSE, m))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, ``len - width + 1`` of them, by doubling."""
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = width - size
    return np.minimum(cur[:-rest], cur[rest:]) if rest else cur
