"""Words and hashes of whole texts, computed over the bytes of an Arrow column at once.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit polynomials over bytes (or over word hashes), read from
prefix sums, so that a window of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_ROOT = 0xD1342543DE82EF95
_INVERSE = pow(_ROOT, -1, 1 << 64)
_powers = {_ROOT: np.ones(1, U), _INVERSE: np.ones(1, U)}


def powers(root: int, n: int) -> np.ndarray:
    if len(_powers[root]) < n:
        steps = np.full(max(n, 1 << 16), root, U)
        steps[0] = 1
        _powers[root] = np.multiply.accumulate(steps)
    return _powers[root][:n]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(_ROOT, len(values)), out=out[1:])
    return out


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    prefix = _prefix(BYTE[data])
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U))


def windows_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive word hashes; runs across texts are for the caller to leave out."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    prefix = _prefix(words)
    return mix((prefix[length:] - prefix[:n]) * powers(_INVERSE, n))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and where each begins (one more for the end); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the number of words before each text (one more for the end)."""
    inside = ~BLANK[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text: what is held at once follows the slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element of consecutive groups the number of its group."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, one after the other, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        fresh = np.zeros(batch.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        fresh[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
        at = [*np.flatnonzero(fresh).tolist(), batch.num_rows]
        if at[0]:
            held.append(batch.slice(0, at[0]))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut anew so that none of its groups is divided."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None:
        yield held
