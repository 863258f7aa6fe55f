"""Vectorised text helpers that run inside Spark tasks.

Words are the contracts' ``[^\\x20\\x09-\\x0D]+``. All functions work on one
flat UTF-8 byte buffer holding many documents, so a task never loops over
bytes or words in Python. Hashes are 64-bit and position independent: a
rolling polynomial over a fixed random byte table, then a final mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a helper handles at once; bounds a task's memory.
CHUNK_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and digits and all bytes of other characters belong to tokens.
IS_APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int, kind: str) -> np.ndarray:
    """base**i (or its inverse) mod 2**64 for i in 0..n."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        base = np.uint64(_BASE if kind == "up" else _BASE_INV)
        out = np.full(max(n + 1, 1024), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.multiply.accumulate(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Spans:
    """Hashes of arbitrary ranges of one buffer of bytes, or of word hashes, after one prefix pass."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * _power(n, "up")[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.sums) - 1
        h = (self.sums[end] - self.sums[start]) * _power(n, "down")[start]
        return mix(h + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """A hash of each word; memory is bounded by the bytes of ``at_once`` words."""
    h = np.zeros(len(start), np.uint64)
    for at in range(0, len(h), at_once):
        a, b = start[at : at + at_once], end[at : at + at_once]
        h[at : at + at_once] = Spans(data[a[0] : b[-1]]).hash(a - a[0], b - a[0])
    return h


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the index of its document; ``between`` marks the bytes between words."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def per_doc(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a per-byte count within each document."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes (documents are not respected)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + m]
    return mix(out)


def count_bits(h: np.ndarray, of: np.ndarray, ones: np.ndarray) -> None:
    """Add to row ``of`` of ``ones`` (64 columns) the set bits of each hash; equal rows stand together. Works in blocks."""
    for at in range(0, len(h), 1 << 16):
        some, rows = h[at : at + (1 << 16)], of[at : at + (1 << 16)]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)


def over_half(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is set if it is in over half of a row's hashes."""
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of n words; a shorter document is one run."""
    at = np.flatnonzero(doc[: max(len(h) - n + 1, 0)] == doc[n - 1 :])
    out, of = [grams(h, n)[at]], [doc[at]]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else at
    size = np.diff(np.r_[first, len(doc)])
    for m in range(1, n):
        short = first[size == m]
        out.append(grams(h, m)[short] if len(short) else h[:0])
        of.append(doc[short])
    out, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return out[order], of[order]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its document offsets; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    low, high = int(offsets[0]), int(offsets[-1])
    flat = np.frombuffer(data, np.uint8, high - low, low) if data is not None and high > low else np.zeros(0, np.uint8)
    return flat, offsets - low


def lowered(column: pa.Array) -> np.ndarray:
    """The bytes of :func:`utf8` in lower case, each character in its place.

    The few characters whose lower case has another length stay as they are.
    """
    column = column.fill_null("") if column.null_count else column
    data, offsets = utf8(column)
    low, after = utf8(pc.utf8_lower(column))
    if np.array_equal(offsets, after):
        return low
    keep = lambda c: x if len((x := c.lower()).encode()) == len(c.encode()) else c
    return np.frombuffer("".join(map(keep, data.tobytes().decode())).encode(), np.uint8)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        size = utf8(batch.column(text))[1]
        while at < n:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mapper(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", limit: int = CHUNK_BYTES):
    """A ``mapInArrow`` function that applies ``fn`` to each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text, limit):
            out = fn(part)
            if out is not None:
                yield out

    return run
