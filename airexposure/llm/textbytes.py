"""Vectorised helpers on UTF-8 bytes for Arrow batches inside tasks.

All contracts of this package split words on ASCII classes only, and every byte of a multi-byte
UTF-8 character is >= 0x80, so words can be found byte by byte without decoding.
"""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa

#: Bytes of text that are held in numpy form at once (one longer text is handled alone).
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, everything beyond ASCII).
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = CHUNK_BYTES) -> np.ndarray:
    """64-bit hash of each slice data[starts[i]:ends[i]]; starts and ends must not decrease."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + span, side="right")))
        part = data[base : int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[part] * _power(_BASE, len(part)), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        h = (sums[e] - sums[s]) * _power(_INVERSE, len(part) + 1)[s]
        out[i:j] = mix(h + (e - s).astype(np.uint64))
        i = j
    return out


def chunks(column: pa.Array, budget: int = CHUNK_BYTES):
    """(first row, offsets, bytes) for runs of rows of about ``budget`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_binary(), pa.large_string()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, side="right")) - 1)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """(starts, ends, first): byte ranges of the words; first[d] is the index of text d's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] |= inside[1:-1][cuts]
    end[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def texts(column: pa.Array) -> list[bytes]:
    """The rows as bytes; a null is empty."""
    return [b"" if x is None else (x.encode() if isinstance(x, str) else x) for x in column.to_pylist()]


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with all fields nullable, as results of grouped functions are checked against."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(nullable(kind.value_type))
    return kind


def give_back() -> None:
    """Unused memory back to the system: idle workers share the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """An Arrow function on batches that gives its memory back at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run):
    """An Arrow function on one group that gives its memory back after each."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return wrapped


def tidy_groups(run):
    """An Arrow function on two groups that gives its memory back after each pair."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return wrapped
