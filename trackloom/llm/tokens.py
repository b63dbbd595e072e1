"""Vectorised words and word hashes over whole Arrow columns of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer text is one piece of its own.
PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words are hashed one by one.
_LONG_WORD = 64
_MASK = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)
#: Sequences of words are polynomials modulo this prime at a random point.
PRIME = 2**61 - 1
_P, _P_BITS = np.uint64(PRIME), np.uint64(61)
_POINT = 0x0F3B7A91C64D5E27 % PRIME
_POINT_BACK = pow(_POINT, -1, PRIME)
_POWERS: dict[int, np.ndarray] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it, from 31-bit halves."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    a_hi, a_lo, b_hi, b_lo = a >> half, a & low, b >> half, b & low
    middle = a_hi * b_lo + a_lo * b_hi
    upper, lower = middle >> np.uint64(30), middle & np.uint64(2**30 - 1)
    return _reduced(((a_hi * b_hi) << np.uint64(1)) + upper + (lower << half) + a_lo * b_lo)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _P_BITS)
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate((have, _times(have, np.full(1, pow(base, len(have), PRIME), np.uint64))))
        if n <= PIECE:
            _POWERS[base] = have
    return have[:n]


def run_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``size`` word hashes from ``start`` on: equal runs have equal ones anywhere.

    Two different runs of n words are equal with a probability of n / 2^61, whatever their words.
    """
    terms = _times(_reduced(mix(h + np.uint64(0x632BE59BD9B4E019))), _powers(_POINT, len(h)))
    low = np.uint64(2**31 - 1)  # two running sums, so that neither overflows
    parts = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (terms & low, terms >> np.uint64(31)))
    lo, hi = (x[start + size] - x[start] for x in parts)
    total = _reduced(_times(_reduced(hi), np.full(1, 2**31, np.uint64)) + _reduced(lo))
    return mix(_times(total, _powers(_POINT_BACK, len(h))[start]) + mix(size.astype(np.uint64)))


def release() -> None:
    """Give memory that is no longer used back to the system: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a partition, and ``release`` after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null reads as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split rows into runs of about ``PIECE`` bytes: first row, end row, bytes, offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the first word of each row."""
    n = len(data)
    solid = np.ones(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    inner = off[(off > 0) & (off < n)]
    start = solid[1:-1] & ~solid[:-2]
    start[inner] = solid[1:-1][inner]
    end = solid[1:-1] & ~solid[2:]
    end[inner - 1] = solid[1:-1][inner - 1]
    ws = np.flatnonzero(start)
    return ws, np.flatnonzero(end) + 1, np.searchsorted(ws, off)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes, eight bytes a step.

    Every step is a bijection of eight bytes, so words of one length up to eight bytes never share a
    hash; others do with a probability of 2^-64, whatever their structure.
    """
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))  # eight bytes from any place on
    size = we - ws
    out = mix(mix(size.astype(np.uint64) + _M2) ^ (eight[ws] & _MASK[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    at = 8
    while len(more):
        part = eight[ws[more] + at] & _MASK[np.minimum(size[more] - at, 8)]
        out[more] = mix(out[more] * _M1 + np.uint64(at) ^ part)
        at += 8
        more = more[size[more] > at]
    long = np.flatnonzero(size > _LONG_WORD)
    if len(long):
        raw = data.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(ws[long].tolist(), we[long].tolist(), strict=True)]
    return out


#: What a word of no bytes hashes to.
EMPTY = word_hashes(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0]


_GRAM = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 2**64)) for i in range(64)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _GRAM[i % 64] + _GRAM[(i * 7 + 3) % 64]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
