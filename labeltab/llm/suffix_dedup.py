"""Operator 8: repeated strings by interval expansion on a Burrows-Wheeler transform.

Every byte covered by a ``length``-byte string that also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed. Each window (string of ``length`` bytes) belongs to the
smallest of its k-gram hashes, a function of its content alone, so equal windows meet:

1. Consecutive windows of a document with one minimum form a segment. Equal segments of a batch are
   reduced to their first before anything is shuffled; the rest is repeated as a whole.
2. Segments meet by minimum. Of equal ones the first stays. A minimum with one segment is done; the
   segments of all others are open, and their bytes are fetched from the texts.
3. The open segments of a task are concatenated. From their Burrows-Wheeler transform, backward
   extension finds interval bounds breadth-first, by increasing common prefix, and stops
   at ``length``: what no bound separates shares a window, and all but its first start is repeated.

A minimum with very many segments (a frequent short line in ever other surroundings) would be a hot group. A
batch that has over ``hot_batch`` of them sends their window hashes instead, spread by window, and
tells the others; so does a group above ``hot_group``. These windows are compared by hash,
one row for each batch and window. No row is dropped on either way.

Null texts read as empty. Rows without doc_id keep all their bytes and are compared with nothing. Rows that
repeat a doc_id are taken to be the same document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import only_ids, stage

SEGMENTS, HOT, WINDOWS, MARKS, OPEN = range(5)
PACKED = "kind int, bucket long, a binary, b binary, doc binary, pos binary, size binary"
RESOLVED = PACKED + ", doc_id long, start long, length long, low long, hot boolean"


@dataclass(frozen=True)
class Params:
    length: int = 100
    gram: int = 24
    longest_run: int = 4096
    hot_batch: int = 32
    hot_group: int = 4096
    slice_bytes: int = 1 << 18
    chunk_bytes: int = 1 << 21


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w consecutive items."""
    have, out = 1, x
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - w + 1], out[w - have: w - have + len(x) - w + 1]) if have < w else out


def segments(buf: np.ndarray, off: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """(minimum, digest, row, start in the slice, windows, repeats itself) of the segments of a slice."""
    n, w = len(buf) - p.length + 1, p.length - p.gram + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool)
    sp = tv.Spans(buf)
    k = len(buf) - p.gram + 1
    g = tv.mix64((sp.c[p.gram:] - sp.c[:k]) * sp.q[:k]) | np.uint64(1)
    m = _slide(g, w, np.minimum)
    count = np.maximum(np.diff(off) - p.length + 1, 0)
    at = off[:-1]
    step = np.zeros(len(buf) + 1, np.int32)
    np.add.at(step, at, (count > 0).astype(np.int32))
    np.add.at(step, at + count, -(count > 0).astype(np.int32))
    valid = np.cumsum(step)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = m[1:] != m[:-1]
    new[at[count > 0]] = True
    s = np.flatnonzero(valid & new)
    row = np.searchsorted(off, s, "right") - 1
    e = np.minimum(np.append(s[1:], n), (at + count)[row])
    while len(long := np.flatnonzero(e - s > p.longest_run)):
        more = s[long] + p.longest_run
        s, e, row = np.concatenate([s, more]), np.concatenate([e, e[long]]), np.concatenate([row, row[long]])
        e[long] = more
    order = np.argsort(s, kind="stable")
    s, e, row = s[order], e[order], row[order]
    low = m[s]
    # k-grams that are the minimum of a window; two equal neighbours: windows may repeat inside a segment
    masked = np.zeros(k + w - 1, np.uint64)
    masked[w - 1: w - 1 + n] = np.where(valid, m, np.uint64(0))
    chosen = np.flatnonzero(g == _slide(masked, w, np.maximum)[:k])
    twice = chosen[:-1][g[chosen[:-1]] == g[chosen[1:]]]
    own = np.zeros(len(s), bool)
    if len(twice):
        key = g[twice] + (np.searchsorted(off, twice, "right") - 1).astype(np.uint64) * tv.BASE
        own = np.isin(low + row.astype(np.uint64) * tv.BASE, key)
    return low, sp.hash(s, e - 1 + p.length), row, s, e - s, own


def joined_bytes(buf: np.ndarray, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated spans and their first places in the result (one more entry)."""
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return buf[np.arange(int(at[-1])) + np.repeat(s - at[:-1], size)], at


def windows_of(buf: np.ndarray, s: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, segment) of all windows of the segments, in order."""
    text, at = joined_bytes(buf, s, count + length - 1)
    seg = np.repeat(np.arange(len(s)), count)
    first = np.zeros(len(s) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    i = np.arange(len(seg)) - first[seg] + at[seg]
    return tv.Spans(text).hash(i, i + length), seg


def split_firsts(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first (doc, pos) of every key, and of those that come later."""
    order = np.lexsort((pos, doc, key))
    k, d, q = key[order], doc[order], pos[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.zeros(0, np.int64)
    later = (d != d[head]) | (q != q[head])
    return order[new], order[later]


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each document."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((e, s, doc))
    doc, s, e = doc[order], s[order], e[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(fresh)
    lift = group * (int(e.max()) + 1)  # keeps the running end inside a document
    reach = np.maximum.accumulate(e + lift) - lift
    fresh[1:] |= s[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    return doc[head], s[head], np.append(reach[head[1:] - 1], reach[-1])


def _packed(kind: int, bucket: np.ndarray, cols: list[np.ndarray | None], types: list[type]) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    for i, j in zip(cut, np.append(cut[1:], len(b))):
        own = order[i:j]
        yield (kind, int(b[i]), *(None if c is None else np.ascontiguousarray(c[own].astype(t)).tobytes()
                                  for c, t in zip(cols, types)))


TYPES = [np.uint64, np.uint64, np.int64, np.uint32, np.uint32]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()),
                                       *(pa.array(x, pa.binary()) for x in c[2:])],
                                      names=["kind", "bucket", "a", "b", "doc", "pos", "size"])


def _segment_batches(batches: Iterator[pa.RecordBatch], p: Params, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        data, places = tv.as_buffers(batch.column("text"))
        parts, base = [], 0
        for part, buf, off in tv.row_slices(batch, "text", p.slice_bytes):
            low, dig, row, s, count, own = segments(buf, off, p)
            parts.append((low, dig, ids[base + row], s - off[row], count, own, places[base] + s))
            base += part.num_rows
        if not parts:
            continue
        low, dig, doc, pos, count, own, place = (np.concatenate(x) for x in zip(*parts))
        first, later = split_firsts(dig, doc, pos)
        out: list[tuple] = []
        d, s, e = merged(doc[later], pos[later], pos[later] + count[later] + p.length - 1)
        out += _packed(MARKS, d % buckets, [None, None, d, s, e - s], TYPES)
        low, dig, doc, pos, count, own, place = (x[first] for x in (low, dig, doc, pos, count, own, place))
        lows, back, times = np.unique(low, return_inverse=True, return_counts=True)
        many = times[back] > p.hot_batch
        if many.any():
            hot = np.unique(low[many])
            out += _packed(HOT, (hot % np.uint64(buckets)).astype(np.int64), [hot, None, None, None, None], TYPES)
            wh, seg = windows_of(data, place[many], count[many], p.length)
            wdoc = doc[many][seg]
            inner = np.arange(len(seg)) - np.searchsorted(seg, seg)
            wpos = pos[many][seg] + inner
            f, later = split_firsts(wh, wdoc, wpos)
            d, s, e = merged(wdoc[later], wpos[later], wpos[later] + p.length)
            out += _packed(MARKS, d % buckets, [None, None, d, s, e - s], TYPES)
            out += _packed(WINDOWS, (wh[f] % np.uint64(buckets)).astype(np.int64), [wh[f], None, wdoc[f], wpos[f], None], TYPES)
        cold = ~many
        size = count.astype(np.int64) * 2 + own
        out += _packed(SEGMENTS, (low[cold] % np.uint64(buckets)).astype(np.int64),
                       [low[cold], dig[cold], doc[cold], pos[cold], size[cold]], TYPES)
        if out:
            yield _record(out)


def _unpack(rows: list[tuple], i: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[i], TYPES[i]) for r in rows] or [np.zeros(0, TYPES[i])])


def _resolve_batches(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple]] = {SEGMENTS: [], HOT: [], WINDOWS: [], MARKS: []}
    for batch in batches:
        for kind, bucket, *rest in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if kind == WINDOWS:
                held[kind].append((bucket, *rest))
            else:
                held[kind].append(tuple(rest))
    names = ["kind", "bucket", "a", "b", "doc", "pos", "size", "doc_id", "start", "length", "low", "hot"]
    none = [pa.int64()] * 1 + [pa.binary()] * 5

    def rows(kind: int, doc: np.ndarray, start: np.ndarray, length: np.ndarray, low: np.ndarray | None,
             hot: np.ndarray | None) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, t) for t in none), pa.array(doc.astype(np.int64)),
             pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)),
             pa.nulls(n, pa.int64()) if low is None else pa.array(low.view(np.int64)),
             pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot)], names=names)

    if held[WINDOWS]:
        own = held[WINDOWS]
        n = len(own)
        c = list(zip(*own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, WINDOWS, np.int32)), pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:]),
             *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=names)
    if held[MARKS]:
        yield rows(MARKS, *(_unpack(held[MARKS], i) for i in (2, 3, 4)), None, None)
    if not held[SEGMENTS]:
        return
    low, dig, doc, pos, size = (_unpack(held[SEGMENTS], i) for i in range(5))
    held[SEGMENTS].clear()
    count, own = (size >> np.uint32(1)).astype(np.int64), (size & np.uint32(1)).astype(bool)
    pos = pos.astype(np.int64)
    first, later = split_firsts(dig, doc, pos)
    d, s, e = merged(doc[later], pos[later], pos[later] + count[later] + p.length - 1)
    if len(d):
        yield rows(MARKS, d, s, e - s, None, None)
    low, doc, pos, count, own = low[first], doc[first], pos[first], count[first], own[first]
    _, back, times = np.unique(low, return_inverse=True, return_counts=True)
    hot = np.isin(low, _unpack(held[HOT], 0)) | (times[back] > p.hot_group)
    live = np.flatnonzero((times[back] > 1) | own | hot)
    if len(live):
        yield rows(OPEN, doc[live], pos[live], count[live], low[live], hot[live])


def suffix_order(x: np.ndarray, least: int) -> np.ndarray:
    """Suffixes of the symbols ``x`` (below 512), sorted by at least their first ``least`` symbols."""
    n = len(x)
    pad = np.concatenate([x.astype(np.uint64), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | pad[k: k + n]
    h = 7
    while True:
        order = np.argsort(key, kind="stable")
        if h >= least:
            return order
        sortd = key[order]
        rank = np.empty(n + 1, np.uint64)
        new = np.ones(n, np.uint64)
        new[1:] = sortd[1:] != sortd[:-1]
        rank[order] = np.cumsum(new)
        rank[n] = 0
        nxt = np.zeros(n, np.uint64)
        nxt[: max(n - h, 0)] = rank[h:n]
        key = (rank[:n] << np.uint64(32)) | nxt
        h *= 2


def interval_bounds(x: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether a bound lies before each sorted suffix: its common prefix with the one before it is
    shorter than ``least``. Bounds are found by increasing value from the Burrows-Wheeler transform."""
    n = len(x)
    last = x[order - 1]  # the transform; the text is taken as circular, its last symbol is a separator
    by = np.argsort(last, kind="stable")
    forward = np.empty(n, np.int64)  # place of the suffix that is one symbol longer
    forward[by] = np.arange(n)
    before = np.full(n, -1, np.int64)  # previous place with the same symbol
    same = last[by[1:]] == last[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    bound = np.zeros(n + 1, bool)
    bound[n] = True
    start = np.searchsorted(last[by], np.unique(last))
    bound[start] = True
    front = start
    for _ in range(1, least):
        every = np.flatnonzero(bound)
        size = every[np.searchsorted(every, front) + 1] - front
        at = np.zeros(len(front) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        j = np.arange(int(at[-1])) + np.repeat(front - at[:-1], size)
        j = forward[j[before[j] < np.repeat(front, size)]]
        front = np.unique(j[~bound[j]])
        if not len(front):
            break
        bound[front] = True
    return bound[:n]


def repeated_windows(segs: list[bytes], doc: np.ndarray, pos: np.ndarray, length: int
                     ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans (doc, start, end) of the windows of ``segs`` that start earlier, too."""
    size = np.array([len(x) for x in segs], np.int64)
    at = np.zeros(len(segs) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    x = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8).astype(np.uint16) + 1
    x[at[1:] - 1] = 0
    order = suffix_order(x, length)
    group = np.cumsum(interval_bounds(x, order, length))
    seg = np.searchsorted(at, order, "right") - 1
    inner = order - at[seg]
    ok = inner + length <= size[seg]
    group, seg, inner = group[ok], seg[ok], inner[ok]
    d, q = doc[seg], pos[seg] + inner
    _, later = split_firsts(group, d, q)
    return merged(d[later], q[later], q[later] + length)


def _fetch_batches(batches: Iterator[pa.RecordBatch], p: Params, buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts with their open segments -> bytes of cold segments, window hashes of hot ones."""
    for batch in batches:
        low, doc, pos, seg = [], [], [], []
        out: list[tuple] = []
        for d, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "open"))):
            raw = text.encode()
            for x in own:
                if not x["hot"]:
                    low.append(x["low"])
                    doc.append(d)
                    pos.append(x["start"])
                    seg.append(raw[x["start"]: x["start"] + x["length"] + p.length - 1])
            if any(x["hot"] for x in own):
                s = np.array([x["start"] for x in own if x["hot"]], np.int64)
                c = np.array([x["length"] for x in own if x["hot"]], np.int64)
                wh, of = windows_of(np.frombuffer(raw, np.uint8), s, c, p.length)
                wpos = s[of] + np.arange(len(of)) - np.searchsorted(of, of)
                out += _packed(WINDOWS, (wh % np.uint64(buckets)).astype(np.int64),
                               [wh, None, np.full(len(wh), d), wpos, None], TYPES)
        names = ["kind", "bucket", "a", "b", "doc", "pos", "size", "low", "doc_id", "start", "bytes"]
        if seg:
            n = len(seg)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, SEGMENTS, np.int32)), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.binary()) for _ in range(5)),
                 pa.array(low, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(seg, pa.binary())],
                names=names)
        if out:
            own = _record(out)
            n = own.num_rows
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.nulls(n, pa.int64()) for _ in range(3)),
                                              pa.nulls(n, pa.binary())], names=names)


def _spans(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array(s.astype(np.int64)), pa.array(e.astype(np.int64))],
                                      names=["doc_id", "s", "e"])


def _transform_batches(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Segments sorted by minimum; whole groups are put together up to ``chunk_bytes``."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def work() -> pa.RecordBatch:
        low, doc, pos, seg = zip(*held)
        return _spans(*repeated_windows(list(seg), np.array(doc, np.int64), np.array(pos, np.int64), p.length))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("low", "doc_id", "start", "bytes"))):
            if size >= p.chunk_bytes and row[0] != held[-1][0]:
                yield work()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield work()


def _window_batches(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("a", "b", "doc", "pos")))
    if held:
        wh, doc, pos = _unpack(held, 0), _unpack(held, 2), _unpack(held, 3).astype(np.int64)
        _, later = split_firsts(wh, doc, pos)
        yield _spans(*merged(doc[later], pos[later], pos[later] + p.length))


def repeated_spans(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, s, e``: byte spans (possibly overlapping) that cover what has to go."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= p.length)))
    packed = texts.mapInArrow(lambda it: _segment_batches(it, p, buckets), PACKED)
    got = stage(packed.repartition(buckets, "bucket").mapInArrow(lambda it: _resolve_batches(it, p), RESOLVED), "repeat-resolved")
    whole = got.where(f"kind = {MARKS}").select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("length")).alias("e"))
    open_ = got.where(f"kind = {OPEN}").select("doc_id", F.struct("start", "length", "low", "hot").alias("x"))
    todo = open_.groupBy("doc_id").agg(F.collect_list("x").alias("open"))
    rows = only_ids(texts, open_, "doc_id").dropDuplicates(["doc_id"]).join(todo, "doc_id").select("doc_id", "text", "open")
    fetched = stage(rows.mapInArrow(lambda it: _fetch_batches(it, p, buckets),
                                    PACKED + ", low long, doc_id long, start long, bytes binary"), "repeat-open")
    cold = (fetched.where(f"kind = {SEGMENTS}").select("low", "doc_id", "start", "bytes")
            .repartition(buckets, "low").sortWithinPartitions("low")
            .mapInArrow(lambda it: _transform_batches(it, p), "doc_id long, s long, e long"))
    blobs = [x.where(f"kind = {WINDOWS}").select("bucket", "a", "b", "doc", "pos") for x in (got, fetched)]
    hot = (blobs[0].unionByName(blobs[1]).repartition(buckets, "bucket")
           .mapInArrow(lambda it: _window_batches(it, p), "doc_id long, s long, e long"))
    return stage(whole.unionByName(cold).unionByName(hot), "repeat-spans")


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, digest, kept = [], [], [], [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist()):
            raw = (text or "").encode()
            s = np.array([x["s"] for x in own], np.int64)
            e = np.array([x["e"] for x in own], np.int64)
            _, s, e = merged(np.zeros(len(s), np.int64), s, e)
            rest, at = [], 0
            for a, b in zip(s.tolist(), e.tolist()):
                rest.append(raw[at:a])
                at = b
            rest.append(raw[at:])
            left = b"".join(rest)
            size.append(len(raw))
            removed.append(int((e - s).sum()))
            runs.append(len(s))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: sizes, digest and bytes of what stays (``kept``)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(docs, p)
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("own"))
    hit = (only_ids(texts, spans, "doc_id").join(own, "doc_id").select("doc_id", "text", "own")
           .mapInArrow(_cut_batches, CUT))
    raw = F.col("text").cast("binary")
    whole = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                         F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return hit.unionByName(whole.join(spans.select("doc_id").distinct(), "doc_id", "left_anti"))
