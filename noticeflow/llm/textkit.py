"""Array views of text batches: bytes, words and rolling hashes, a slice of documents at a time.

Every operator that needs Python reads Arrow batches through here, so that memory is bounded by
one slice (SLICE_BYTES, or one document where a document is longer) and not by the Arrow batch.
Words are maximal runs of bytes outside space, tab, newline, vertical tab, form feed and return;
these are single bytes in UTF-8, so words can be found without decoding.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64)
#: Odd multipliers of the polynomial hashes and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown where a document needs more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any range of a sequence of 64-bit values from one prefix sum."""

    def __init__(self, values: np.ndarray, kind: int = 0):
        n = len(values)
        self.inverse = powers(INVERSES[kind], n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASES[kind], n), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, k: int) -> np.ndarray:
        """Of every window of k values, in order; empty if there are fewer."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inverse[: n - k + 1])


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f):
    """f, on the driver, with a trim() when it has ended."""

    @functools.wraps(f)
    def wrapped(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        finally:
            trim()

    return wrapped


def tidy(run):
    """run, a function from batches to batches, giving its memory back to the system after each partition: workers are
    kept between tasks, and with them what their allocators hold."""

    def wrapped(batches):
        yield from run(batches)
        for base in [b for b, x in _powers.items() if len(x) > SLICE_BYTES + 1]:
            del _powers[base]
        trim()

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ids(col: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(pc.cast(col, pa.int64()), null).to_numpy(zero_copy_only=False)


class Slice:
    """Some consecutive documents of a batch: rows i..j, their bytes and their bounds in these."""

    def __init__(self, i: int, j: int, data: np.ndarray, offsets: np.ndarray):
        self.i, self.j = i, j
        self.buf = data[offsets[i] : offsets[j]]
        self.bounds = offsets[i : j + 1] - offsets[i]
        self.lengths = np.diff(self.bounds)
        self.n = j - i

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each document the index of its first word (n + 1 values)."""
        if not hasattr(self, "_words"):
            inside = ~SPACE[self.buf]
            n = len(inside)
            cut = np.zeros(n + 1, bool)
            cut[self.bounds] = True
            before = np.empty(n, bool)
            after = np.empty(n, bool)
            if n:
                before[0] = after[-1] = False
                before[1:] = inside[:-1]
                after[:-1] = inside[1:]
            starts = np.flatnonzero(inside & (~before | cut[:n]))
            ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
            self._words = starts, ends, np.searchsorted(starts, self.bounds)
        return self._words

    def byte_codes(self, lower: bool = False, kind: int = 0) -> np.ndarray:
        return BYTE_CODE[kind % 2][LOWER[self.buf] if lower else self.buf]

    def word_hashes(self, lower: bool = False, kind: int = 0) -> np.ndarray:
        starts, ends, _ = self.words()
        return Rolling(self.byte_codes(lower, kind), kind).ranges(starts, ends)

    def doc_of_word(self) -> np.ndarray:
        first = self.words()[2]
        return np.repeat(np.arange(self.n), np.diff(first))


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES):
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Slice(i, j, data, offsets)
        i = j


def valid_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the windows of k words that lie in one document; first: index of each document's first word."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, np.int64)
    ok = np.ones(total - k + 1, bool)
    for back in range(1, k):  # a window that begins up to k-1 words before a later document's start crosses it
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of consecutive integers in a sorted array."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]] + 1


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal runs; ranges that touch become one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    at = np.flatnonzero(new)
    return begin[at], end[np.r_[at[1:] - 1, len(end) - 1]]
