"""Texts of an Arrow batch as flat numpy arrays: bytes, word spans, word and window hashes.

Everything here works on one chunk of a few megabytes; Spark deals the chunks out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20

#: 1 for the bytes that belong to words, 0 for 0x20 and 0x09-0x0D
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9,
                                        0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiplications, three xor-shifts)."""
    x = x + _M1
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


#: one random 64-bit value per byte value
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[begin[0]:begin[-1]], begin - begin[0]


def chunks(begin: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    first, n = 0, len(begin) - 1
    while first < n:
        last = int(np.searchsorted(begin, begin[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, begin: np.ndarray):
    """Starts and ends of the words, and for each text the number of its first word.

    Words never cross texts.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[begin] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, begin)


#: words up to so many bytes are hashed side by side, longer ones one by one
_LONG_WORD = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time are mixed into the length."""
    if not len(starts):
        return np.empty(0, np.uint64)
    if lower:
        data = _LOWER[data]
    length = ends - starts
    out = mix(length.astype(np.uint64))
    eight = np.lib.stride_tricks.sliding_window_view(
        np.concatenate((data, np.zeros(8, np.uint8))), 8)
    at = np.flatnonzero(length <= _LONG_WORD)
    begin, left = starts[at], length[at]
    while len(at):
        block = eight[begin].view("<u8")[:, 0] & _FIRST[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ block)
        more = left > 8
        at, begin, left = at[more], begin[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` symbols; one entry per start, 0 past the end.

    Runs are doubled: the hash of 2k symbols comes from two neighbouring ones of k.
    """
    n = len(symbols)
    out, at, power, bit = None, 0, symbols, 1
    while True:
        if width & bit:
            out = power if out is None else _join(out, power, at, n)
            at += bit
        if bit * 2 > width:
            break
        power, bit = _join(power, power, bit, n), bit * 2
    if n >= width:
        out = out.copy()
        out[n - width + 1:] = 0
        return out
    return np.zeros(n, np.uint64)


def _join(left: np.ndarray, right: np.ndarray, shift: int, n: int) -> np.ndarray:
    out = left * _M2
    if shift < n:
        out[:n - shift] += right[shift:]
    out ^= out >> _S31
    out *= _M3
    out ^= out >> _S27
    return out


def inside_texts(begin: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of ``width`` symbols fits into its text, for each start."""
    n = int(begin[-1])
    step = np.zeros(n + 1, np.int32)
    fits = np.maximum(begin[1:] - width + 1, begin[:-1])
    np.add.at(step, begin[:-1], 1)
    np.add.at(step, fits, -1)
    return np.cumsum(step[:n]) > 0


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)


def binaries(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """One binary value per run of a flat array; ``begin`` counts array elements."""
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begin) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(begin * data.itemsize, dtype=np.int64)),
         pa.py_buffer(data)]).cast(pa.binary())
