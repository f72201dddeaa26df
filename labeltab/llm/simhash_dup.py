"""Operator 13: SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where over half of the hashes of its word shingles (repeats
included) have it. Fingerprints link if at most two bits differ.

* **Keys.** The 64 bits are cut into three segments (22, 21, 21 bits, padded to 23). The binary
  Golay code of length 23 is perfect: its 4,096 words cover all 2^23 values at distance 3. The keys of a
  segment are the indices of all code words within distance 4, at most six. Two segments at most two bits
  apart have a value within one bit of both; the code word it decodes to is within 4 of both, so they
  share a key.
* **Pigeonhole.** Two errors leave one of the three segments untouched, and the next segment (cyclically)
  has at most two. A key is therefore (segment number, its value, a code word of the next segment):
  about 16 keys a fingerprint, and every linked pair meets under one of them.
* **Join and verify.** Equal fingerprints are one class. Classes that share a key are gathered, equal
  member lists of several keys once, and their differing bits counted; a list gives a spanning forest of
  its links, never all pairs. Keys with more than ``BUCKET`` classes are not gathered: their classes
  are dealt to the 65 values within one bit of each, where a group has at most 65 members, all linked.

Defined results: null and empty texts and texts of white space have the fingerprint zero and link like
any other; a text of fewer than ``ngram`` words is one shingle. Rows are answered one by one, so
repeated rows appear as often as they come; one id with two texts is two rows, each with its own
component. A null doc_id takes part, but is never a component's name (null if a component has no
other). Other columns are ignored, whatever their names. An empty table gives an empty one. Very long
texts are read whole; their hashes are counted in blocks of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .hot_join import join_hot
from .shared import stage

SEED = 42
BITS = 2
#: (first bit, width) of the segments
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: generator polynomial of the binary Golay code of length 23
GENERATOR = 0b101011100011
CODE_LENGTH, CHECK_BITS = 23, 11
#: classes that a key may gather in one task; larger keys take the way by single-bit neighbours
BUCKET = 2048
HASH_BLOCK = 1 << 16

ROW = "doc_id long, fp long"
ONE_BIT = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes, ngram: int) -> int:
    """SimHash of one UTF-8 text (ASCII white space cuts words, A-Z are lower-cased)."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - ngram + 1)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(start[:n].tolist(), end[min(ngram, len(words)) - 1:].tolist())
    ones = np.zeros(64, np.int64)
    while True:
        h = np.fromiter((digest(line[s:e], SEED) for (s, e), _ in zip(spans, range(HASH_BLOCK))), np.uint64)
        if not len(h):
            break
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], ngram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in tv.row_slices(batch, "text"):
            fps = np.fromiter((fingerprint(buf[s:e].tobytes(), ngram) for s, e in zip(off[:-1], off[1:])),
                              np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit values by the generator polynomial."""
    x = x.copy()
    for bit in range(CODE_LENGTH - 1, CHECK_BITS - 1, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return x


def error_patterns() -> np.ndarray:
    """For each syndrome all error patterns of weight 4 or less, as (2048, 6), filled up with -1."""
    out = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        e = np.array([sum(1 << b for b in bits) for bits in combinations(range(CODE_LENGTH), weight)], np.int64)
        for s, x in zip(syndrome(e), e):
            out[s, used[s]] = x
            used[s] += 1
    return out


def near_codewords(x: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """(len(x), 6) indices of the code words within distance 4 of 23-bit values, -1 for none."""
    e = patterns[syndrome(x)]
    return np.where(e >= 0, (x[:, None] ^ e) >> CHECK_BITS, -1)


def fuzzy_keys(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of the fingerprints."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(len(SEGMENTS)):
        code = near_codewords(parts[(i + 1) % len(SEGMENTS)], patterns)
        row, col = np.nonzero(code >= 0)
        rows.append(row)
        keys.append((np.int64(i) << 40) | (parts[i][row] << 12) | code[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = error_patterns()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = fuzzy_keys(fps.view(np.uint64), patterns)
        for i in range(0, len(row), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(key[i: i + (1 << 17)]), pa.array(fps[row[i: i + (1 << 17)]])], names=["key", "fp"])


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the links of distinct fingerprints."""
    if len(fps) <= 64:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= BITS, 1))
    else:  # two fingerprints link if they have a value within one bit in common: a star for each value
        mid = (fps[:, None] ^ ONE_BIT).ravel()
        order = np.argsort(mid, kind="stable")
        who, mid = order // 65, mid[order]
        first = np.concatenate([[True], mid[1:] != mid[:-1]])
        a, b = who[np.flatnonzero(first)][np.cumsum(first) - 1], who
        ok = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= BITS)
        a, b = a[ok], b[ok]
    up = list(range(len(fps)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[rx] = ry
            out.append((x, y))
    return out


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column(0):
            fps = np.asarray(members.values)
            for x, y in forest(fps.view(np.uint64)):
                a.append(fps[x])
                b.append(fps[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 2048):
            part = fps[i: i + 2048]
            mid = (part.view(np.uint64)[:, None] ^ ONE_BIT).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(part, 65))], names=["mid", "fp"])


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(lambda it: _fingerprint_batches(it, ngram), ROW)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links of distinct fingerprints (column ``fp``) that connect all that lie within two bits."""
    keys = stage(fps.select("fp").mapInArrow(_key_batches, "key long, fp long"), "simhash-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(keys.join(shared, "key"), "simhash-met")
    lists = (met.where(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("members"))
             .select("members").distinct())
    out = lists.mapInArrow(_forest_batches, "a long, b long")
    crowd = met.where(F.col("n") > bucket).select("fp").distinct()
    near = (crowd.mapInArrow(_neighbour_batches, "mid long, fp long")
            .groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("m")).where("size(m) > 1"))
    stars = near.select(F.col("m")[0].alias("a"), F.explode("m").alias("b")).where("a <> b AND bit_count(a ^ b) <= 2")
    return out.unionByName(stars).distinct()


def link_documents(docs: DataFrame, ngram: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id`` (the smallest doc_id that links reach)."""
    rows = stage(fingerprints(docs, ngram), "simhash-rows")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    labels = components(links(classes, bucket))
    linked = stage(labels.join(classes.withColumnRenamed("fp", "v"), "v"), "simhash-linked")
    names = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    joined = stage(join_hot(linked, names, "label").select(F.col("v").alias("fp"), "component_id"), "simhash-joined")
    table = stage(classes.join(joined, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("rep"))
                                                          .otherwise(F.col("component_id")).alias("component_id")), "simhash-names")
    return join_hot(rows, table, "fp").select("doc_id", "fp", "component_id")


def digests(linked: DataFrame) -> DataFrame:
    """The contract's columns: the fingerprint as 16 lower-case hex digits."""
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
