"""Operator 5: near-duplicate documents by circulant MinHash.

Two permutations give the whole signature. The first scatters the shingles of a document over
a ring of 2^32 places; the second orders the places, and coordinate k reads it shifted
by k places around the ring: ``sig[k] = min over shingles of pi((sigma(x) + k) mod 2^32)``.
Bands of the signature name candidate buckets; every link is confirmed on the full sets.

* Equal shingle sets form one class and are never compared with each other.
* A bucket is resolved without listing its pairs. Each class has a parity bitmap (each shingle
  flips one bit, four to eight bits per shingle). Bits that differ are a lower bound of the
  number of shingles in one set only, so a pair above the bound cannot be linked. Among the
  pairs that remain, Prim's algorithm gives a spanning forest over the components known so far;
  only its edges, fewer than members, leave the task and are confirmed on the full sets.
* An edge that fails is excluded and its bucket is resolved again, until no bucket has an open
  pair. In later rounds a member outside the largest component names its nearest open partners, four times
  as many in each round, so a member with many near misses needs few rounds. Of buckets with the same members one is kept.
* The first round takes the first ``lead`` bands. From then on a bucket is sent only while it holds more than one component
  and its group had an open pair in the last round; the buckets of the later bands come in the second round. A bucket that is
  mostly of one component sends only its other members, to each other and as guests to that component, whose classes are
  sent once for all its buckets: a large group of near copies is not sent again for each band.
* A large group is cut into blocks: first each by itself, then the members outside its largest component against the rest,
  block by block. So links are complete for all pairs that share a bucket, at every bucket size.

Rows that repeat a doc_id are taken to be the same document. A null doc_id or a text without
words links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .shared import only_ids, stage

SIGNATURE = ("doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits binary")
ROWS_PER_BAND = 4
MISS = 1e-5
BLOCK = 4096
LEAD = 4  # bands of the first round
#: share of (permuted) multipliers of the ring order, odd 32-bit constants
PI_A, PI_B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def bands_for(similarity: float, miss: float = MISS, rows: int = ROWS_PER_BAND) -> int:
    """Bands needed so that a pair at the threshold is missed with probability below ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity ** rows))


def ring_order(place: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit places."""
    v = place ^ (place >> np.uint32(16))
    v *= PI_A
    v ^= v >> np.uint32(13)
    v *= PI_B
    v ^= v >> np.uint32(16)
    return v


def signatures(h: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k circulant MinHash coordinates of each non-empty set, as (sets, k) uint32."""
    full = np.diff(bounds) > 0
    at = bounds[:-1][full]
    out = np.empty((len(at), k), np.uint32)
    sigma = (tv.mix64(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
    for i in range(k if len(at) else 0):
        out[:, i] = np.minimum.reduceat(ring_order(sigma + np.uint32(i)), at)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            acc = acc * tv.BASE + sig[:, b * rows + r]
        keys[:, b] = tv.mix64(acc)
    return keys


def parity_bits(h: np.ndarray) -> bytes:
    """Parity bitmap of one set; its size is the power of two from four bits per shingle on."""
    size = max(512, 1 << (4 * len(h) - 1).bit_length())
    flips = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _signature_batches(batches: Iterator[pa.RecordBatch], ngram: int, bands: int, rows: int
                       ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in tv.row_slices(batch, "text"):
            words, row = tv.fold_word_hashes(buf, off)
            h, b = tv.shingle_sets(words, row, part.num_rows, ngram)
            n = np.diff(b)
            full = np.flatnonzero(n > 0)
            keys = band_keys(signatures(h, b, bands * rows), bands, rows).view(np.int64)
            lists = np.zeros(part.num_rows + 1, np.int32)
            lists[1:] = np.cumsum(np.where(n > 0, bands, 0))
            d = []
            for seed in (0x1234567, 0x89ABCDE):
                c = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(tv.mix64(h + np.uint64(seed)), out=c[1:])
                d.append((c[b[1:]] - c[b[:-1]]).view(np.int64))
            bits: list[bytes | None] = [None] * part.num_rows
            for r in full:
                bits[r] = parity_bits(h[b[r]: b[r + 1]])
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(n.astype(np.int64)),
                 pa.array(d[0]), pa.array(d[1]),
                 pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.ravel())), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "bits"])


class _Forest:
    """Spanning forest of one group of classes, over the pairs that their bitmaps leave open."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def edges(self, ids: np.ndarray, labels: np.ndarray, n: np.ndarray, bits: list[bytes],
              failed: dict[int, set[int]], fan: int) -> list[tuple[int, int]]:
        m = len(ids)
        if m < 2 or (labels == labels[0]).all():
            return []
        order = np.argsort(n, kind="stable")
        ids, labels, n = ids[order], labels[order], n[order]
        raw = [np.frombuffer(bits[i], np.uint64) for i in order]
        width = np.array([len(x) for x in raw])
        folded: dict[int, np.ndarray] = {}

        def at_width(w: int) -> np.ndarray:
            if w not in folded:
                out = np.zeros((m, w), np.uint64)
                for i in range(m):
                    if width[i] >= w:  # folding a parity bitmap keeps it one
                        out[i] = np.bitwise_xor.reduce(raw[i].reshape(-1, w), axis=0)
                folded[w] = out
            return folded[w]

        where = {int(x): i for i, x in enumerate(ids)}
        far = np.iinfo(np.int64).max

        def distances(v: int) -> tuple[int, int, np.ndarray]:
            """Lower bounds of the set differences of v and members lo..hi; ``far``: cannot link."""
            lo = int(np.searchsorted(n, n[v] * self.num / self.den, "left"))
            hi = int(np.searchsorted(n, n[v] * self.den / self.num, "right"))
            d = np.empty(hi - lo, np.int64)
            shared = np.minimum(width[lo:hi], width[v])
            for w in np.unique(shared):
                f = at_width(int(w))
                part = np.flatnonzero(shared == w)
                d[part] = np.bitwise_count(f[lo + part] ^ f[v]).sum(1)
            d[d * (self.den + self.num) > (self.den - self.num) * (n[lo:hi] + n[v])] = far
            for x in failed.get(int(ids[v]), ()):
                if x in where and lo <= where[x] < hi:
                    d[where[x] - lo] = far
            return lo, hi, d

        out: list[tuple[int, int]] = []
        if fan:
            names, size = np.unique(labels, return_counts=True)
            for v in np.flatnonzero(labels != names[size.argmax()]):
                lo, hi, d = distances(v)
                d[labels[lo:hi] == labels[v]] = far
                near = np.flatnonzero(d < far)
                if len(near) > fan:
                    near = near[np.argpartition(d[near], fan)[:fan]]
                out.extend((int(ids[v]), int(ids[lo + x])) for x in near)
            return out
        best, via, done = np.full(m, far), np.full(m, -1), np.zeros(m, bool)
        todo: list[int] = []
        seen: set[int] = set()
        while not done.all():
            if todo:
                v = todo.pop()
            else:
                open_ = np.where(done, far, best)
                v = int(open_.argmin())
                if open_[v] == far:
                    v = int(np.flatnonzero(~done)[0])
                else:
                    out.append((int(ids[via[v]]), int(ids[v])))
            if done[v]:
                continue
            done[v] = True
            if labels[v] not in seen:  # its whole component comes along
                seen.add(labels[v])
                todo.extend(int(x) for x in np.flatnonzero((labels == labels[v]) & ~done))
            lo, hi, d = distances(v)
            nearer = (d < best[lo:hi]) & ~done[lo:hi]
            best[lo:hi][nearer] = d[nearer]
            via[lo:hi][nearer] = v
        return out


def _resolve_batches(batches: Iterator[pa.RecordBatch], num: int, den: int, fan: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (key, u, v): members, then failed pairs (b not null). Gives edges."""
    forest = _Forest(num, den)
    held: list[tuple] = []
    current = None
    ready: list[tuple[int, int, int]] = []

    def finish() -> None:
        members = [r for r in held if r[1] is None]
        failed: dict[int, set[int]] = {}
        for a, b, *_ in (r for r in held if r[1] is not None):
            failed.setdefault(a, set()).add(b)
            failed.setdefault(b, set()).add(a)
        unique = {r[0]: r for r in members}
        rows = [unique[k] for k in sorted(unique)]
        if len(rows) > 1:
            got = forest.edges(np.array([r[0] for r in rows]), np.array([r[2] for r in rows]),
                               np.array([r[3] for r in rows]), [r[4] for r in rows], failed, fan)
            ready.extend((current[0], min(a, b), max(a, b)) for a, b in got)

    def emit() -> pa.RecordBatch:
        cols = list(zip(*ready)) or [[], [], []]
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, u, v, a, b, label, n, bits in zip(*cols):
            if (key, u, v) != current:
                if held:
                    finish()
                held, current = [], (key, u, v)
            held.append((a, b, label, n, bits))
        if ready:
            yield emit()
    if held:
        finish()
    if ready:
        yield emit()


def _verify_batches(batches: Iterator[pa.RecordBatch], ngram: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for col in ("text_a", "text_b"):
            own: list[np.ndarray] = []
            for part, buf, off in tv.row_slices(batch, col):
                words, row = tv.fold_word_hashes(buf, off)
                h, b = tv.shingle_sets(words, row, part.num_rows, ngram)
                own.extend(h[b[i]: b[i + 1]] for i in range(part.num_rows))
            sets.append(own)
        ok = []
        for x, y in zip(*sets):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())],
                                         names=["a", "b", "linked"])


def _verify(pairs: DataFrame, docs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """``pairs(a, b)`` -> ``(a, b, linked)`` decided on the full shingle sets."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = only_ids(docs.select("doc_id", "text"), ids, "doc_id").dropDuplicates(["doc_id"])
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(lambda it: _verify_batches(it, ngram, num, den), "a long, b long, linked boolean")


def _resolve(rows: DataFrame, num: int, den: int, fan: int) -> DataFrame:
    """``rows(key, u, v, a, b, label, n, bits)`` grouped by (key, u, v) -> open edges (key, a, b)."""
    group = ["key", "u", "v"]
    return (rows.select(*group, "a", "b", "label", "n", "bits").repartition(*group)
            .sortWithinPartitions(*group)
            .mapInArrow(lambda it: _resolve_batches(it, num, den, fan), "key long, a long, b long"))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows of the second and later rounds: members outside the largest component of a bucket
    against all others, in groups of at most about two blocks."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = (sizes.groupBy("key").agg(F.max(F.struct("c", F.col("label").alias("l"))).alias("top"),
                                     F.count("*").alias("labels"), F.sum("c").alias("total"))
            .where("labels > 1")
            .select("key", F.col("top.l").alias("main"), "total",
                    F.ceil(F.col("top.c") / block).alias("nm"),
                    F.ceil((F.col("total") - F.col("top.c")) / block).alias("nr")))
    x = members.join(main, "key").withColumn("is_main", F.col("label") == F.col("main"))
    home = F.when(F.col("is_main"), F.col("nr") + F.pmod(F.xxhash64("a"), "nm")).otherwise(F.pmod(F.xxhash64("a"), "nr"))
    x = x.withColumn("home", home)
    x = x.withColumn("other", F.explode(
        F.when(F.col("total") <= block, F.array(F.lit(0).cast("long")))
        .when(F.col("is_main"), F.expr("sequence(0L, nr - 1)"))
        .otherwise(F.expr("sequence(0L, nr + nm - 1)"))))
    small = F.col("total") <= block
    return x.select("key", F.when(small, 0).otherwise(F.least("home", "other")).cast("long").alias("u"),
                    F.when(small, 0).otherwise(F.greatest("home", "other")).cast("long").alias("v"),
                    "a", F.lit(None).cast("long").alias("b"), "label", "n", "bits")


def _groups(named: DataFrame, classes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(key, a, label)`` of the groups to resolve for the buckets ``named(key, a, label)``, and the group of each bucket
    ``(key, group)``. A bucket of one component has none. One that is mostly of one component, its host, sends only its other
    members: as a group of their own, and as guests to the host's group, which holds the host's classes once for all buckets."""
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    shape = (sizes.groupBy("key").agg(F.max(F.struct("c", F.col("label").alias("l"))).alias("top"), F.count("*").alias("parts"),
                                      F.sum("c").alias("total")).where("parts > 1")
             .select("key", "parts", F.when(2 * F.col("top.c") > F.col("total"), F.col("top.l")).alias("host")))
    rows = stage(named.join(shape, "key").where("host IS NULL OR label <> host"), "near-apart")
    own = rows.where("host IS NULL OR parts > 2")
    guests = rows.where("host IS NOT NULL").select("a", "label", "host").distinct()
    group = F.xxhash64("host", F.lit(11))
    hosts = (classes.join(labels.withColumnRenamed("v", "a"), "a", "left").select("a", F.coalesce("label", "a").alias("label"))
             .join(guests.select(F.col("host").alias("label")).distinct(), "label", "left_semi")
             .select(F.xxhash64("label", F.lit(11)).alias("key"), "a", "label"))
    members = own.select("key", "a", "label").union(guests.select(group.alias("key"), "a", "label")).union(hosts.select("key", "a", "label"))
    routes = own.select("key", F.col("key").alias("group")).union(rows.where("host IS NOT NULL").select("key", group.alias("group")))
    return members, stage(routes.distinct(), "near-routes")


def link_documents(docs: DataFrame, ngram: int = 5, num: int = 80, den: int = 100,
                   rows: int = ROWS_PER_BAND, block: int = BLOCK, lead: int = LEAD) -> DataFrame:
    """Near-duplicate components: one row per row of ``docs`` with
    ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``den * intersection >= num * union`` over their distinct
    ``ngram``-word shingles. ``component_id`` is the smallest doc_id that links reach.
    """
    bands = bands_for(num / den, rows=rows)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stage(base.mapInArrow(lambda it: _signature_batches(it, ngram, bands, rows), SIGNATURE), "near-signatures")
    cls = (sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles")
           .agg(F.min("doc_id").alias("rep")))
    member = stage(sig.drop("bits", "bands").join(cls, ["d1", "d2", "n_shingles"], "left"), "near-members")
    reps = stage(sig.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
                 .dropDuplicates(["doc_id"])
                 .select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), "bits", "bands"), "near-classes")

    pairs = reps.select("a", F.posexplode("bands").alias("band", "key"))
    wide = (pairs.groupBy("key").agg(F.count("*").alias("size"), F.min("band").alias("band"),
                                     F.sum(F.xxhash64("a").cast("decimal(20,0)")).alias("m1"),
                                     F.bit_xor(F.xxhash64("a", F.lit(7))).alias("m2")).where("size > 1"))
    once = (wide.groupBy("size", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("x"))  # one bucket of several with the same members
            .select("size", F.col("x.key").alias("key"), (F.col("x.band") >= lead).alias("later")))
    bucket = stage(pairs.select("a", "key").join(once, "key"), "near-buckets")
    info = reps.select("a", "n", "bits")
    null = F.lit(None).cast("long")
    first = (bucket.where("NOT later").join(info, "a")
             .select("key", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / block)).alias("u"),
                     F.lit(0).cast("long").alias("v"), "a", null.alias("b"), F.col("a").alias("label"), "n", "bits"))
    found = stage(_resolve(first, num, den, 0), "near-open")
    checked = routes = None
    labels = reps.sparkSession.createDataFrame([], "v long, label long")
    fan = 1
    while routes is None or found.limit(1).count():
        open_ = found.select("a", "b").distinct()
        if checked is not None:
            open_ = open_.join(checked, ["a", "b"], "left_anti")
        new = stage(_verify(open_, base, ngram, num, den), "near-checked")
        checked = new if checked is None else checked.union(new)
        if new.where("linked").limit(1).count():
            labels = components(checked.where("linked"))
        failed = checked.where("NOT linked").select("a", "b")
        # a bucket whose group had no open pair in this round has none later: components only grow. In the first round a
        # forest without a failed edge is complete, but for buckets cut into blocks; the buckets of later bands come now
        if routes is None:
            again = (found.join(failed, ["a", "b"]).select("key")
                     .union(bucket.where((F.col("size") > block) | F.col("later")).select("key")).distinct())
        else:
            again = routes.join(found.select(F.col("key").alias("group")).distinct(), "group", "left_semi").select("key").distinct()
        named = stage(bucket.join(again, "key", "left_semi").select("key", "a").join(labels.withColumnRenamed("v", "a"), "a", "left")
                      .select("key", "a", F.coalesce("label", "a").alias("label")), "near-named")
        groups, routes = _groups(named, reps.select("a"), labels)
        grouped = stage(_blocks(groups.join(info, "a").select("key", "a", "label", "n", "bits"), block), "near-blocks")
        barred = (grouped.select("key", "u", "v", "a").join(failed, "a")
                  .join(grouped.select("key", "u", "v", F.col("a").alias("b")), ["key", "u", "v", "b"], "left_semi")
                  .select("key", "u", "v", "a", "b", null.alias("label"), null.alias("n"), F.lit(None).cast("binary").alias("bits")))
        found = stage(_resolve(grouped.unionByName(barred), num, den, fan), "near-open")
        fan *= 4

    own = F.coalesce("rep", "doc_id")
    out = (member.join(labels.withColumnRenamed("v", "rep"), "rep", "left")
           .withColumn("component_id", F.coalesce("label", own)))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
