"""Vectorised byte kernels over Arrow string columns.

A batch of texts is one byte buffer with document offsets, as Arrow lays it out, so
nothing here makes a Python string per document or per word.  Null texts have no
bytes and behave as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the temporaries take some thirty times as much.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C13 | 3
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


@lru_cache(None)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@lru_cache(None)
def other_values() -> np.ndarray:
    """Bytes' values of a second hash: texts that are equal by the first are as likely as any to differ by it."""
    return mix(byte_values() ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if not _powers or _powers["up"].size < n:
        size = max(n, 1 << 16) * 5 // 4
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class Hashes:
    """Prefix sums of a buffer, from which any span's 64-bit hash follows in O(1)."""

    def __init__(self, buf: np.ndarray, values: np.ndarray | None = None) -> None:
        up, self.down = powers(buf.size + 1)
        self.sums = np.zeros(buf.size + 1, np.uint64)
        np.cumsum((byte_values() if values is None else values)[buf] * up[: buf.size], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = column.type == pa.large_string()
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64) if n else np.zeros(1, np.int64)
    first, last = int(off[0]), int(off[-1])
    buf = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return buf, off - first


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; no row is split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = texts_of(batch.column(batch.schema.get_field_index(column)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@lru_cache(None)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@lru_cache(None)
def word_table() -> np.ndarray:
    """True for bytes of words `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


@lru_cache(None)
def letter_table() -> np.ndarray:
    """True for ASCII letters and every byte of a character beyond ASCII."""
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = t[128:] = True
    return t


def letters(buf: np.ndarray, digits: bool = False) -> np.ndarray:
    """True for the bytes of letters, and of digits if asked for: signs of U+0080-U+00BF and of U+2000-U+207F, as typographic quotes, dashes and no-break spaces, separate words like ASCII signs."""
    table = letter_table()
    if digits:
        table = table.copy()
        table[48:58] = True
    mask = table[buf]
    for lead, seconds, size in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3)):
        at = np.flatnonzero(buf == lead)
        if seconds is not None:
            at = at[at + 1 < buf.size]
            at = at[np.isin(buf[at + 1], seconds)]
        for k in range(size):
            mask[at[at + k < buf.size] + k] = False
    return mask


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of True that stay in a document."""
    n = mask.size
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    first = off[:-1]
    first = first[(first > 0) & (first < n)]
    start[first] = mask[first]
    end[first - 1] = mask[first - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each window of `width` words; a document with fewer words has one, of all its words."""
    counts = np.bincount(doc, minlength=n_docs)
    h = np.zeros(words.size, np.uint64)
    for k in range(min(width, words.size)):
        part = words[k:] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        h[: words.size - k] += part if k == 0 else mix(part)
    first = np.cumsum(counts) - counts
    place = np.arange(words.size) - first[doc]
    full = place + width <= counts[doc]
    short = np.flatnonzero((counts < width) & (counts > 0))
    hs, ds = mix(h[full]), doc[full]
    if short.size:
        few = []
        for d in short:
            x = 0
            for w in words[first[d] : first[d] + counts[d]]:
                x = (x * 0x100000001B3 + int(w) + 1) & (1 << 64) - 1
            few.append(x ^ int(counts[d]) << 56)
        hs, ds = np.concatenate([hs, np.array(few, np.uint64)]), np.concatenate([ds, short])
        order = np.argsort(ds, kind="stable")
        hs, ds = hs[order], ds[order]
    return hs, ds


def distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document and the n+1 offsets of the documents; doc ascends."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    off = np.zeros(n_docs + 1, np.int64)
    np.cumsum([p.size for p in parts], out=off[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), off


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
