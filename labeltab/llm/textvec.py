"""Vectorised text helpers for Arrow-batched tasks.

A task receives Arrow record batches (``mapInArrow``). The helpers view the UTF-8 buffer of the
text column as one numpy array, cut it into row slices of bounded size, find word spans with
byte tables and hash any span in constant time from one prefix sum. No per-word Python objects
are made. Null texts read as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 19


def byte_table(*allowed: int | range) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    t = np.zeros(256, bool)
    for a in allowed:
        t[list(a) if isinstance(a, range) else a] = True
    return t


#: contract words: everything but space and 0x09-0x0D
NON_SPACE = ~byte_table(0x20, range(0x09, 0x0E))
#: letters (ASCII, and every byte of a non-ASCII character)
LETTERS = byte_table(range(65, 91), range(97, 123), range(128, 256))
DIGITS = byte_table(range(48, 58))
ALNUM = LETTERS | DIGITS
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur3 constants)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", BASE), ("q", BASE_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POW[key] = np.cumprod(a, dtype=U64)
    return _POW["p"], _POW["q"]


class Spans:
    """Prefix sums of a byte buffer: hashes of any [start, end) spans in O(1) each."""

    def __init__(self, buf: np.ndarray):
        p, self.q = _powers(len(buf) + 1)
        self.c = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * p[: len(buf)], out=self.c[1:])

    def hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((self.c[e] - self.c[s]) * self.q[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def as_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column; nulls become empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64)[col.offset: col.offset + len(col) + 1]
    return (np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)), off


def row_slices(batch: pa.RecordBatch, text: str, max_bytes: int = CHUNK_BYTES
               ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``max_bytes`` of text: (rows, bytes, offsets from 0).

    A single row longer than that is a slice of its own, so every text is seen whole.
    """
    if batch.num_rows == 0:
        return
    data, off = as_buffers(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of ``table`` bytes; runs never cross rows."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[buf]
    edge = np.empty(n, bool)
    edge[0] = False
    edge[1:] = w[:-1]
    r = off[:-1]
    edge[r[r < n]] = False
    s = np.flatnonzero(w & ~edge)
    edge[-1] = False
    edge[:-1] = w[1:]
    r = off[1:] - 1
    edge[r[r >= 0]] = False
    e = np.flatnonzero(w & ~edge) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """First index of every row in a sorted row-number array (n_rows + 1 entries)."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def window_hash(h: np.ndarray, row: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-item windows inside rows: (hash, index of the first item)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = np.full(m, U64(seed), U64)
    for k in range(n):
        acc = acc * BASE + h[k: k + m]
    ok = np.flatnonzero(row[:m] == row[n - 1:])
    return mix64(acc[ok]), ok


def shingle_sets(words: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row, sorted: (hashes, bounds of n_rows + 1 entries).

    A row with 1..n-1 words has its whole sequence as its only shingle; one without words none.
    """
    b = row_bounds(row, n_rows)
    h, at = window_hash(words, row, n)
    hr = row[at]
    count = np.diff(b)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        own = np.empty(len(few), U64)
        for k, r in enumerate(few):
            acc = U64(0x5851F42D4C957F2D)
            with np.errstate(over="ignore"):
                for x in words[b[r]: b[r + 1]]:
                    acc = acc * BASE + x
            own[k] = acc
        h, hr = np.concatenate([h, mix64(own)]), np.concatenate([hr, few])
    order = np.lexsort((h, hr))
    h, hr = h[order], hr[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (hr[1:] != hr[:-1])
    h, hr = h[keep], hr[keep]
    return h, row_bounds(hr, n_rows)


def fold_word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes after lower-casing A-Z, words being runs of non-space bytes: (hash, row)."""
    low = ASCII_LOWER[buf]
    s, e, row = word_spans(low, off, NON_SPACE)
    return Spans(low).hash(s, e), row


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
