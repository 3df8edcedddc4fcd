"""Vectorised word handling on the raw UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``.  Nothing here
loops over words in Python: a column's text buffer is cut into slices of bounded
size and each slice is worked on with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 14

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply, twice)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        up, down = np.full(max(n, SLICE_BYTES + 1), _BASE), np.full(max(n, SLICE_BYTES + 1), _BASE_INV)
        up[0] = down[0] = U64(1)
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every data[start:end]; the same bytes give the same hash anywhere.

    Starts and ends ascend; the spans are worked on in stretches of SLICE_BYTES.
    """
    out = np.zeros(len(start), dtype=U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix(((total[e] - total[s]) * down[s]) ^ ((e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))
        i = j
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) or pa.types.is_string(column.type) else b"")
    _, at, raw = column.buffers()
    off = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, off


def slices(column: pa.Array, size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive slices that cover all rows."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words end at row borders and at the bytes of ``outside``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~outside[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    before[off[:-1][off[:-1] < len(data)]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


_POSITION = mix(np.arange(1, 65, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def shingles(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every window of ``width`` words in a row, repeats included.

    A row with fewer words than that, but at least one, has the one window of all its words.
    """
    start, end, row = words(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = span_hash(data, start, end)
        n = np.bincount(row, minlength=len(off) - 1)
        rows, hashes = [], []
        if len(h) >= width:
            full = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
            s = np.zeros(len(full), dtype=U64)
            for k in range(width):
                s += h[full + k] * _POSITION[k]
            rows.append(row[full])
            hashes.append(s)
        if len(short := np.flatnonzero(n[row] < width)):
            first = np.searchsorted(row, row[short], side="left")
            part = np.zeros(len(off) - 1, dtype=U64)
            np.add.at(part, row[short], h[short] * _POSITION[short - first])
            few = np.unique(row[short])
            rows.append(few)
            hashes.append(part[few] + n[few].astype(U64))
        return np.concatenate(rows), mix(np.concatenate(hashes))


def row_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags over the bytes of each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
