"""Numpy helpers over the byte buffers of Arrow batches. Texts in a buffer end in a line feed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20


def u64(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * u64(2) + u64(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between blanks: every byte but space, tab, line feed, VT, FF and CR.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Words of digits, lower-case letters and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_CODES = byte_codes(11)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> u64(32))
    h = h * u64(0xD6E8FEB86659FD93)
    h ^= h >> u64(29)
    h *= u64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> u64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 2**64)
        table = []
        for base in (_BASE, inverse):
            p = np.full(size, u64(base))
            p[0] = 1
            table.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = table[0], table[1]
    return _POWERS[size]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, end row, their bytes, offsets within."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(off, off[first] + size, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words: 64-bit hashes, first and end byte of each, and each text's first word (one more at the end)."""
    low = LOWER[raw]
    inside = kind[low]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    if len(end) < len(begin):
        end = np.append(end, len(inside))
    power, inverse = _powers(len(low))
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[low] * power[: len(low)], out=total[1:])
    h = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return h, begin, end, np.searchsorted(begin, off)


def row_of(ptr: np.ndarray) -> np.ndarray:
    """Which text each item belongs to."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def shingles(h: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` items within a text (the whole text if it has fewer), and each text's first run."""
    n = np.diff(ptr)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    row = row_of(out)
    at = np.arange(out[-1]) - out[row] + ptr[row]
    s = np.zeros(len(at), np.uint64)
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    last = ptr[row + 1]
    for j in range(k):
        here = at + j
        s = s * u64(0x165667B19E3779F9) + np.where(here < last, padded[here], u64(j + 1))
        s ^= s >> u64(31)
    return mix(s), out


def gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first[i], first[i] + 1, ...``, ``count[i]`` of each."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - count - first, count)
