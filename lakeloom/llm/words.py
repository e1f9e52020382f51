"""Vectorised work on words of UTF-8 text, shared by the text operators.

A word is a run of bytes other than space and 0x09 to 0x0D, taken unchanged.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once. Longer texts are cut between words.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _tables.get(base)
    if got is None or len(got) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        got = np.full(size, U64(base))
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 4 * BLOCK:
            _tables[base] = got
    return got[:n]


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Cut a text between words into blocks of about ``size`` bytes."""
    start, end = 0, len(data)
    while end - start > size:
        at = start + size
        window = np.frombuffer(data, np.uint8, count=min(end - at, size), offset=at)
        gap = np.flatnonzero(_SPACE[window])
        while not len(gap) and at + len(window) < end:  # a word longer than a block
            at += len(window)
            window = np.frombuffer(data, np.uint8, count=min(end - at, size), offset=at)
            gap = np.flatnonzero(_SPACE[window])
        if not len(gap):
            break
        at += int(gap[0])
        yield data[start:at]
        start = at
    yield data[start:]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of ``data`` and the byte at which it starts."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U64), start
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers(_BASE, len(raw)), out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start]
    return mix(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93)), start


def hash_texts(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in a row, and where each text's words start (one more at the end)."""
    texts = list(texts)
    parts, counts = [], []
    small: list[bytes] = []

    def flush() -> None:
        if small:
            value, at = hash_words(b"\n".join(small))
            ends = np.cumsum([len(x) + 1 for x in small])
            counts.extend(np.diff(np.searchsorted(at, ends), prepend=0).tolist())
            parts.append(value)
            small.clear()

    room = BLOCK
    for x in texts:
        if len(x) > room:
            flush()
            room = BLOCK
        if len(x) > BLOCK:
            own = [hash_words(b)[0] for b in blocks(x)]
            parts.extend(own)
            counts.append(sum(map(len, own)))
        else:
            small.append(x)
            room -= len(x) + 1
    flush()
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:]) if counts else None
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), bounds


def fold(values: np.ndarray, length: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of ``length`` values, by doubling; shorter than ``values`` by length - 1."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have = None, 0
    step, width = values, 1
    rest = length
    while True:
        if rest & 1:
            piece = step
            if out is None:
                out, have = piece, width
            else:
                m = len(values) - (have + width) + 1
                out = out[:m] * U64(pow(base, width, 1 << 64)) + piece[have : have + m]
                have += width
        rest >>= 1
        if not rest:
            return out[:n]
        m = len(values) - 2 * width + 1
        step = step[:m] * U64(pow(base, width, 1 << 64)) + step[width : width + m]
        width *= 2


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each run of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return values[:0]
    width, step = 1, values
    while width * 2 <= length:
        step = np.minimum(step[: len(step) - width], step[width:])
        width *= 2
    return np.minimum(step[:n], step[length - width : length - width + n])


def batches(rows: Iterator, size: int = 2 << 20) -> Iterator[list]:
    """Group (..., text) tuples, whose last item is bytes, into lists of about ``size`` bytes."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += len(r[-1]) + 64
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of a text or binary column each, a row at least."""
    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    part = (np.cumsum(length) - length) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(s, e - s)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the memory that a task freed given back at its end: workers live on between stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
