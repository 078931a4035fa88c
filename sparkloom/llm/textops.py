"""Vectorised word splitting and hashing over Arrow string buffers.

Words are found and hashed without creating Python strings: the text buffer is read as
bytes, a table marks separators, and one cumulative sum gives every word's polynomial hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int, base: int, cache: dict) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        cache[base] = have
    return have[:n]


def word_table() -> np.ndarray:
    """Bytes of words as they are; ASCII white space (and NUL) separates."""
    t = np.arange(256, dtype=np.uint8)
    t[[0, 9, 10, 11, 12, 13, 32]] = 0
    return t


def folded_table() -> np.ndarray:
    """ASCII letters in lower case, digits and non-ASCII bytes; all other bytes separate."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            t[b] = ord(chr(b).lower()) if b < 128 else b
    return t


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = (column.cast(pa.large_string()) if column.nbytes >= 1 << 31 else column).combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(at: np.ndarray, size: int = SLICE_BYTES):
    """Ranges of rows of about size bytes, one row at least; a longer row stays whole."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(at: np.ndarray, data: np.ndarray, lo: int, hi: int, table: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of rows lo..hi-1: row (from lo), hash, first byte and end byte (within data)."""
    base = at[lo]
    code = table[data[base : at[hi]]]
    n = len(code)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return empty, np.zeros(0, U), empty, empty
    own = code != 0
    first = own.copy()
    first[1:] &= ~own[:-1]
    last = own.copy()
    last[:-1] &= ~own[1:]
    edge = at[lo:hi] - base
    edge = edge[edge < n]
    first[edge] |= own[edge]
    edge = edge[edge > 0] - 1
    last[edge] |= own[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts) == 0:
        return empty, np.zeros(0, U), empty, empty
    value = cache.get("bytes")
    if value is None:
        value = cache["bytes"] = mix(np.arange(1, 257, dtype=U) * U(BASE))
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(value[code] * powers(n, BASE, cache), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(n, INVERSE, cache)[starts])
    row = np.searchsorted(at[lo + 1 : hi + 1] - base, starts, "right")
    return row, h, starts + base, ends + base


def rolling(h: np.ndarray, row: np.ndarray, width: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every window of width words that lies in one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    total = np.empty(len(h) + 1, U)
    total[0] = 0
    np.cumsum(h * powers(len(h), BASE, cache), out=total[1:])
    w = (total[width:] - total[:n]) * powers(len(h), INVERSE, cache)[:n]
    ok = np.flatnonzero(row[:n] == row[width - 1 :])
    return ok, mix(w[ok])


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, the high ones left out where they are zero: random low bytes stay, the rest compresses."""
    x = np.ascontiguousarray(x, U)
    k = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unplanes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    k = b[0]
    if n and k:
        out[:, :k] = np.frombuffer(b, np.uint8, n * k, 1).reshape(k, n).T
    return out.reshape(-1).view(U)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned integers as planes of their differences."""
    return planes(np.diff(x, prepend=U(0)))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(b, n), dtype=U)
