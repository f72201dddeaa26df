"""Operator 12: vector code compression (product quantisation) with memoised grid cells.

A vector's components become integers floor(scale * x); the vector is cut into ``parts`` equal parts
and each part is replaced by the index of its nearest codebook entry (squared Euclidean distance,
ties to the lower index). Codebooks start as the parts of the vectors with the smallest ids and are
moved by Lloyd rounds; all arithmetic is on integers, so results do not depend on the partitions.

The nearest entry is found through a grid. A part's coarse cell is its components divided by the
cell width. An entry is dominated in a cell if its smallest distance to the cell's box is larger than the
largest distance of some other entry; a dominated entry is nearest for no point of the box, nor
tied. The entries that remain are kept in a memo under the cell, each task's workers filling their
own, and only those are evaluated exactly. A memo holds at most ``memo_cells`` cells a part; a full
one starts anew, which changes no result.

Every pass is one scan of the vectors. A round returns parts x entries rows of sums to the driver,
so what is collected is bounded by the codebook's size, whatever the number of rows.

Defined results: rows whose vector is null, empty or holds a null or non-finite component take no part,
nor do rows whose vector has not the length of the kept vector with the smallest id (ties of the id: the
smallest vector). Null ids count as larger than all others. Rows are answered one by one, so
repeated rows and ids appear as often as they come, and each counts in the sums. With fewer rows
than entries the codebooks are smaller; equal entries are allowed, the lower index wins and the other
stays as it is. Without any row the result is empty. A length that ``parts`` does not divide, or a component
of 2^28 or more after scaling (the sums need exact longs), raises ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_join import join_hot
from .shared import stage

LARGEST = 1 << 28
SUMS = "part int, entry int, n long, sums array<long>"


@dataclass(frozen=True)
class Params:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    #: cells along the mean extent of a part's codebook
    cells: int = 6
    memo_cells: int = 1 << 16
    chunk: int = 4096


class Grid:
    """Nearest entries of one part position, through memoised cells."""

    def __init__(self, book: np.ndarray, p: Params):
        self.book, self.p = book, p
        extent = (book.max(0) - book.min(0)).mean()
        self.width = max(1, int(np.ceil(extent / p.cells)))
        self.memo: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated in the boxes of the cells, ascending."""
        lo = cells * self.width
        hi = lo + self.width - 1
        below, above = lo[:, None, :] - self.book, self.book - hi[:, None, :]
        nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
        keep = nearest <= farthest.min(1, keepdims=True)
        return [np.flatnonzero(k) for k in keep]

    def _entries_of(self, cells: np.ndarray) -> list[int]:
        """Number of the candidate list of each distinct cell, computed at its first use."""
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        if len(self.memo) + len(new) > self.p.memo_cells:
            self.memo.clear()
            self.lists.clear()
            new = list(range(len(keys)))
        for at in range(0, len(new), 256):
            some = new[at: at + 256]
            for i, found in zip(some, self.candidates(cells[some])):
                self.memo[keys[i]] = len(self.lists)
                self.lists.append(found)
        return [self.memo[k] for k in keys]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        cell = x // self.width
        order = np.lexsort(cell.T)
        ranked = cell[order]
        first = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])
        which = np.empty(len(x), np.int64)
        which[order] = np.cumsum(first) - 1
        number = self._entries_of(np.ascontiguousarray(ranked[first]))
        found = [self.lists[k] for k in number]
        size = np.array([len(f) for f in found])
        flat, at = np.concatenate(found), np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size[which]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        entry = flat[np.repeat(at[which] - start, n) + np.arange(n.sum())]
        d = ((np.repeat(x, n, axis=0) - self.book[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(d, start)
        tied = np.where(d == np.repeat(best, n), entry, len(self.book))
        return np.minimum.reduceat(tied, start), best


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows with a full finite vector, as double arrays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def integers(v: pa.Array, dim: int, p: Params) -> np.ndarray:
    """(rows, parts, width) scaled integers of a column of double lists of one length."""
    x = np.floor(np.asarray(v.flatten()) * p.scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError("a scaled component needs 2^28 or more: sums of squares would not be exact")
    return x.astype(np.int64).reshape(-1, p.parts, dim // p.parts)


def _pieces(batches: Iterator[pa.RecordBatch], books: np.ndarray, p: Params
            ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, indices, distances) of slices of the batches."""
    grids = [Grid(b, p) for b in books]
    dim = books.shape[0] * books.shape[2]
    for batch in batches:
        for at in range(0, batch.num_rows, p.chunk):
            part = batch.slice(at, p.chunk)
            x = integers(part.column(part.schema.get_field_index("v")), dim, p)
            got = [g.assign(x[:, i]) for i, g in enumerate(grids)]
            yield part, x, np.stack([a for a, _ in got], 1), np.stack([d for _, d in got], 1)


def _sum_batches(books: np.ndarray, p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, x, index, _ in _pieces(batches, books, p):
            for i in range(p.parts):
                n[i] += np.bincount(index[:, i], minlength=books.shape[1])
                np.add.at(sums[i], index[:, i], x[:, i])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _code_batches(books: np.ndarray, p: Params) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, index, d in _pieces(batches, books, p):
            codes = pa.array([bytes(r) for r in index.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, pa.array(d.sum(1))],
                                             names=["vec_id", "label", "code", "error"])

    return run


def first_books(vectors: DataFrame, p: Params) -> np.ndarray:
    """(parts, entries, width) parts of the vectors with the smallest ids; empty without vectors.

    Reads ``p.entries`` rows to the driver."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    head = vectors.orderBy(*order).limit(1).collect()
    if not head:
        return np.zeros((p.parts, 0, 0), np.int64)
    dim = len(head[0].v)
    if dim % p.parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {p.parts} equal parts")
    rows = vectors.where(F.size("v") == dim).orderBy(*order).limit(p.entries).select("v").collect()
    return integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), dim, p).transpose(1, 0, 2).copy()


def train(vectors: DataFrame, p: Params) -> np.ndarray:
    """Codebooks after the Lloyd rounds; entries without parts stay."""
    books = first_books(vectors, p)
    if not books.size:
        return books
    rows = vectors.where(F.size("v") == books.shape[0] * books.shape[2])
    width = books.shape[2]
    for _ in range(p.rounds):
        sums = (rows.select("v").mapInArrow(_sum_batches(books, p), SUMS).groupBy("part", "entry")
                .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")))
        books = books.copy()
        for r in sums.collect():  # at most parts x entries rows
            books[r.part, r.entry] = np.array(r.sums) // r.n
    return books


def compress(rows: DataFrame, p: Params = Params()) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every usable row (code: one byte a part), and the codebooks."""
    if not 0 < p.entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    vectors = usable(rows)
    books = train(vectors, p)
    dim = books.shape[0] * books.shape[2]
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code binary, error long"
    if not dim:
        return rows.sparkSession.createDataFrame([], schema), books
    return vectors.where(F.size("v") == dim).mapInArrow(_code_batches(books, p), schema), books


def decode(codes: np.ndarray, books: np.ndarray, scale: int = 256) -> np.ndarray:
    """Vectors that the codes (rows, parts) stand for."""
    parts = [books[i][codes[:, i]] for i in range(len(books))]
    return np.concatenate(parts, axis=1) / scale


def codebook_text(books: np.ndarray) -> str:
    """All components as decimals by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def digests(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract's columns: codes as hex, errors, their sums over equal labels (nulls together), and the
    digest of the codebooks."""
    coded, books = compress(rows, p)
    done = stage(coded, "vector-codes")
    totals = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    sha = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return (join_hot(done, totals, "label")
            .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256")))
