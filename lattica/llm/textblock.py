"""Word and shingle hashing over whole blocks of texts with numpy.

A block is the UTF-8 bytes of many texts laid end to end plus their offsets, as Arrow
holds them; no Python string is made for a word. Words are runs of bytes other than
space and 0x09-0x0D, with A-Z lowered.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back, where the default pool keeps it
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # no glibc
    _TRIM = None

BLOCK = 1_000_000  # bytes of text per block; a longer text is a block of its own
U = np.uint64


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of uint64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
VALUE = np.array([_mix_int(b + 1) for b in LOWER.tolist()], dtype=np.uint64)
BASE = _mix_int(77) | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        size = max(n, BLOCK + 1)
        inverse = pow(BASE, -1, 2**64)
        for k, b in (("p", BASE), ("q", inverse)):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = U(b)
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["q"]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, off = flat(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    if _TRIM:
        _TRIM(0)  # workers are kept between tasks: what this batch took goes back


#: separators where only letters and digits count (bytes of other alphabets count as letters)
APART = np.ones(256, dtype=bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word, and how many words lie before each text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~space[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, case of A-Z ignored."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * p[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))


def run_hashes(words: np.ndarray, before: np.ndarray, size: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` consecutive words of a text and the counts before each text.

    With ``whole``, a text with fewer words (one at least) gives its whole sequence as one.
    """
    n = len(words)
    count = np.diff(before)
    out = np.maximum(count - size + 1, 0)
    h = words.copy()
    if n >= size:
        for k in range(1, size):
            h[: n - k] = mix(h[: n - k] * U(0xD6E8FEB86659FD93) + words[k:])
    take = np.zeros(n + 1, np.int32)
    np.add.at(take, before[:-1][out > 0], 1)
    np.add.at(take, (before[:-1] + out)[out > 0], -1)
    ok = np.cumsum(take[:n]) > 0
    if not whole:
        return h[ok], np.concatenate([[0], np.cumsum(out)])
    short = np.flatnonzero((count > 0) & (count < size))
    hashes, at = h[ok], np.concatenate([[0], np.cumsum(out)])
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            x = U(0)
            with np.errstate(over="ignore"):
                for w in words[before[d] : before[d + 1]]:
                    x = mix(np.array([x * U(0xD6E8FEB86659FD93) + w + U(1)], np.uint64))[0]
            extra[k] = x
        hashes = np.insert(hashes, at[short], extra)
        out[short] = 1
        at = np.concatenate([[0], np.cumsum(out)])
    return hashes, at


def distinct_per_text(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and the counts before each."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.searchsorted(d, np.arange(len(at)))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of shingles (its whole words where it has fewer than ``size``)."""
    s, e, before = word_bounds(data, off)
    return distinct_per_text(*run_hashes(word_hashes(data, s, e), before, size, whole=True))
