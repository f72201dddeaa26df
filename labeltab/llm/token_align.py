"""Operator 11: cross-tokenizer alignment with corpus counts of linked id pairs.

Every text is encoded by two tokenizers; byte offsets where both end a token cut the tokens into groups,
and the two tokens that end a group are linked. Counts of the linked id pairs over the whole corpus
come from dense vectors indexed by a minimal perfect hash:

1. documents are dealt to slices of about ``slice_bytes`` of text, and each slice is aligned; its
   distinct pairs with their counts are kept by bucket (``BUCKETS`` ranges of the pair's hash);
2. the distinct pairs of each bucket are merged in a tree over the slices, and a minimal perfect hash is
   built for each bucket, with its keys in hash order;
3. each block of slices makes one dense count vector a bucket, indexed by that hash, every key verified
   against the stored one; the vectors are summed in a tree;
4. slices ask the buckets for the counts of their pairs (verified again), and a second pass aligns the documents
   of each slice once more and looks the counts up.

Nothing is broadcast but the highest count of each id of tokenizer B (one long an id, so bounded by the
vocabulary). A bucket's keys are bounded by the product of the vocabularies over ``BUCKETS``; a tree
node reads at most ``fan`` blocks. No key is a hot one: all are slices or hash ranges.

Defined results: texts that are null, empty, or whose tokens of either tokenizer do not spell
space + text have no tokens: all numbers are 0 and ``groups`` is empty. Strings of special tokens inside texts
are ordinary text. Rows are answered one by one; repeated rows and ids (null ones included) appear as often as they
come, and each counts. If several pairs of an id of B have its highest count, all of them are best.
A very long text is a slice of its own and is aligned whole, so a task needs memory in proportion to the longest text.
Other columns are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .perfect_hash import PerfectHash
from .shared import stage
from .token_pairs import align, piece_model

TOKENIZERS = "/opt/tokenizers"
BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
SLICES = "slice long, doc_id long, text string"
REQUESTS = "slice long, bucket int, keys binary, counts binary"
HASHES = "bucket int, sizes binary, bits binary, keys binary"
VECTORS = "bucket int, block long, counts binary"
ANSWERS = "slice long, bucket int, keys binary, counts binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


@dataclass(frozen=True)
class Params:
    path_a: str = f"{TOKENIZERS}/byte_bpe_50k.json"
    path_b: str = f"{TOKENIZERS}/piece_bpe_32k.model"
    slice_bytes: int = 4 << 20
    #: slices or blocks that one node of a tree merges
    fan: int = 256


def _longs(x: bytes | pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py() if isinstance(x, pa.Scalar) else x, np.int64)


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (tv.mix64(keys.view(np.uint64) + tv.U64(0x51ED27)) >> tv.U64(64 - BUCKET_BITS)).astype(np.int32)


# ---- slices ------------------------------------------------------------------------------------

def _slice_batches(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    number, used = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for part, buf, _ in tv.row_slices(batch, "text", max(1, p.slice_bytes // 8)):
            if used and used + len(buf) > p.slice_bytes:
                number, used = number + 1, 0
            used += len(buf) + part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number)), part.column(0), part.column(1)],
                                             names=["slice", "doc_id", "text"])


def _texts(col: pa.Array | pa.ChunkedArray) -> list[str]:
    return [t or "" for t in col.to_pylist()]


def _request_batches(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each run of rows of one slice, by bucket."""
    held, at = np.zeros(0, np.int64), None
    times = np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        order = np.argsort(bucket_of(held), kind="stable")
        k, n, b = held[order], times[order], bucket_of(held)[order]
        cut = np.flatnonzero(np.diff(b)) + 1
        groups = list(zip(np.split(k, cut), np.split(n, cut))) if len(k) else []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(groups), at)), pa.array(b[np.concatenate([[0], cut])] if len(k) else b),
             pa.array([g.tobytes() for g, _ in groups], pa.binary()), pa.array([c.tobytes() for _, c in groups], pa.binary())],
            names=["slice", "bucket", "keys", "counts"])

    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]]) if len(numbers) else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if at is not None and numbers[s] != at:
                yield out()
                held, times = held[:0], times[:0]
            at = int(numbers[s])
            for part, _, _ in tv.row_slices(batch.slice(s, e - s), "text"):
                found, n = np.unique(align(_texts(part.column(2)), p.path_a, p.path_b).keys, return_counts=True)
                held, where = np.unique(np.concatenate([held, found]), return_inverse=True)
                both, times = np.concatenate([times, n]), np.zeros(len(held), np.int64)
                np.add.at(times, where, both)
    if at is not None:
        yield out()


# ---- buckets -----------------------------------------------------------------------------------

def _merge_keys(t: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([_longs(x) for x in t.column("keys")]))


def _union_group(key: tuple, t: pa.Table) -> pa.Table:
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()),
                     "keys": pa.array([_merge_keys(t).tobytes()], pa.binary())})


def _hash_group(key: tuple, t: pa.Table) -> pa.Table:
    keys = _merge_keys(t)
    h = PerfectHash.build(keys.view(np.uint64))
    placed = np.empty_like(keys)
    placed[h.numbers(keys.view(np.uint64))] = keys
    sizes, bits = h.pack()
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.binary()),
                     "bits": pa.array([bits], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary())})


def _verified(t: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    """Lookup of key numbers in the one hash of a group; a foreign key raises."""
    h = PerfectHash.unpack(t.column("sizes")[0].as_py(), t.column("bits")[0].as_py())
    stored = _longs(t.column("keys")[0])

    def numbers(keys: np.ndarray) -> np.ndarray:
        at = h.numbers(keys.view(np.uint64))
        if len(at) and (at.min() < 0 or (stored[at] != keys).any()):
            raise RuntimeError("a pair is not among the keys of its bucket")
        return at

    return numbers


def _count_group(key: tuple, asked: pa.Table, hashes: pa.Table) -> pa.Table:
    numbers = _verified(hashes)
    vector = np.zeros(len(_longs(hashes.column("keys")[0])), np.int64)
    for k, n in zip(asked.column("keys"), asked.column("counts")):
        vector[numbers(_longs(k))] += _longs(n)  # the keys of one row are distinct
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()),
                     "counts": pa.array([vector.tobytes()], pa.binary())})


def _sum_group(key: tuple, t: pa.Table) -> pa.Table:
    total = np.sum([_longs(x) for x in t.column("counts")], axis=0, dtype=np.int64)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()),
                     "counts": pa.array([total.tobytes()], pa.binary())})


def _answer_group(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
    if not asked.num_rows:
        return pa.table({"slice": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()),
                         "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
    numbers, counts = _verified(table), _longs(table.column("counts")[0])
    return pa.table({"slice": asked.column("slice").cast(pa.int64()), "bucket": asked.column("bucket").cast(pa.int32()), "keys": asked.column("keys"),
                     "counts": pa.array([counts[numbers(_longs(k))].tobytes() for k in asked.column("keys")], pa.binary())})


def _top_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    best = np.zeros(size, np.int64)
    for batch in batches:
        for k, n in zip(batch.column(0), batch.column(1)):
            np.maximum.at(best, _longs(k) % size, _longs(n))
    b = np.flatnonzero(best)
    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(best[b])], names=["b", "best"])


# ---- second pass -------------------------------------------------------------------------------

def _aligned_slice(best: np.ndarray, p: Params) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.concatenate([_longs(x) for x in answers.column("keys")] or [np.zeros(0, np.int64)])
        counts = np.concatenate([_longs(x) for x in answers.column("counts")] or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        out = []
        for batch in docs.combine_chunks().to_batches():
            for part, _, _ in tv.row_slices(batch, "text"):
                al = align(_texts(part.column(2)), p.path_a, p.path_b)
                n = counts[np.searchsorted(keys, al.keys)] if len(al.keys) else np.zeros(0, np.int64)
                links = al.n_groups
                at = np.concatenate([[0], np.cumsum(links)])
                total = np.concatenate([[0], np.cumsum(n)])
                top = np.concatenate([[0], np.cumsum(n == best[al.keys % al.size_b])])
                out.append(pa.table({
                    "doc_id": part.column(1), "n_a": al.n_a, "n_b": al.n_b, "n_groups": links, "n_links": links,
                    "n_best": top[at[1:]] - top[at[:-1]], "count_sum": total[at[1:]] - total[at[:-1]],
                    "groups": pa.array(al.texts(), pa.string())}))
        return pa.concat_tables(out)

    return run


@dataclass
class Corpus:
    """Slices of the documents, the pairs each slice asks for, and the counted pairs by bucket."""

    slices: DataFrame  # slice, doc_id, text
    requests: DataFrame  # slice, bucket, keys, counts, block
    table: DataFrame  # bucket, sizes, bits, keys, counts
    blocks: int
    size_b: int


def _blocks(df: DataFrame, fan: int) -> DataFrame:
    return df.withColumn("block", F.expr(f"block DIV {fan}"))


def count_pairs(docs: DataFrame, p: Params = Params()) -> Corpus:
    """Align all documents once and count every linked id pair of the corpus."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = stage(base.mapInArrow(lambda it: _slice_batches(it, p), SLICES), "align-slices")
    asked = stage(slices.mapInArrow(lambda it: _request_batches(it, p), REQUESTS), "align-requests")
    n = asked.select("slice").distinct().count()
    blocks = max(1, -(-n // p.fan))
    requests = asked.withColumn("block", F.pmod(F.xxhash64("slice"), F.lit(blocks)))

    found, left = requests.select("bucket", "block", "keys"), blocks
    while left > 1:
        found = found.groupBy("bucket", "block").applyInArrow(_union_group, "bucket int, block long, keys binary")
        found, left = _blocks(found, p.fan), -(-left // p.fan)
    hashes = stage(found.groupBy("bucket").applyInArrow(_hash_group, HASHES), "align-hashes")

    vectors = (requests.groupBy("bucket", "block")
               .cogroup(spread(hashes, blocks).groupBy("bucket", "block")).applyInArrow(_count_group, VECTORS))
    left = blocks
    while left > 1:
        vectors, left = _blocks(vectors, p.fan).groupBy("bucket", "block").applyInArrow(_sum_group, VECTORS), -(-left // p.fan)
    table = stage(hashes.join(vectors.drop("block"), "bucket"), "align-counts")
    return Corpus(slices, requests, table, blocks, len(piece_model(p.path_b).pieces.length))


def spread(table: DataFrame, blocks: int) -> DataFrame:
    """A copy of each bucket for every block of slices."""
    return table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))


def pair_counts(c: Corpus) -> DataFrame:
    """``a, b, n``: how many links of the corpus each id pair has."""
    size = c.size_b

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0), batch.column(1)):
                keys = _longs(k)
                yield pa.RecordBatch.from_arrays([pa.array(keys // size), pa.array(keys % size), pa.array(_longs(n))], names=["a", "b", "n"])

    return c.table.select("keys", "counts").mapInArrow(rows, "a long, b long, n long")


def align_documents(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``."""
    c = count_pairs(docs, p)
    size = c.size_b
    tops = (c.table.select("keys", "counts").mapInArrow(lambda it: _top_batches(it, size), "b long, best long")
            .groupBy("b").agg(F.max("best").alias("best")))
    best = np.zeros(size, np.int64)
    for r in tops.collect():  # at most one row an id of B
        best[r.b] = r.best
    answers = (c.requests.groupBy("bucket", "block")
               .cogroup(spread(c.table, c.blocks).groupBy("bucket", "block")).applyInArrow(_answer_group, ANSWERS))
    return c.slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_aligned_slice(best, p), ALIGNED)


def digests(aligned: DataFrame) -> DataFrame:
    """The contract's columns: groups as a digest, empty without tokens."""
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha.alias("groups_sha256"))
