"""Operator 3: SentencePiece encoding by Gumbel top-k sampling, and decoding.

The lattice of a text holds every way to cut it into vocabulary pieces; characters without a piece
are one edge of byte pieces. A piece's probability follows its rank in the vocabulary
(Zipf's law), and backward sums over the lattice give the exact probability of each edge given what
precedes it. Top-k without replacement is a best-first search of perturbed log-probabilities:

* the root gets a Gumbel value from the row's key; the first segmentation follows the lattice down and
  keeps that value;
* the siblings passed at each piece form one node. Its value is a Gumbel at the node's mass, truncated
  at the value of its parent, so it is an upper bound of everything below;
* the node with the largest value is opened next: one of its edges not yet taken is drawn, the rest of the
  text follows down, and the remaining siblings and the new ones get truncated values in turn.

Segmentations come out distinct and in the order of their perturbed values. The value of the best
node left over is the threshold of the inclusion scores: log(1 - exp(-exp(log_prob - threshold))).

Pieces never span a space that follows another character, nor a character that no longer piece
holds, so the lattice falls into units; a task builds equal units once and keeps them for its later slices, up to
``held_bytes`` of unit text. Every random number is a hash of (seed, row key, sample, unit, step): results do not
depend on partitions, slices or what is kept. Decoding joins the
pieces' bytes and is exact for every text. Null and empty texts have the empty segmentation. A null
key counts as its own key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = ("doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, "
           "ids_sha256 string, decoded_ok boolean")


@dataclass(frozen=True)
class Params:
    k: int = 2
    seed: int = 1
    slice_bytes: int = 1 << 20
    held_bytes: int = 4 << 20


@dataclass
class Vocabulary:
    """Pieces as bytes, by id (None: control pieces), ids of the byte pieces and log-probabilities."""

    pieces: list[bytes | None]
    byte_ids: np.ndarray
    log_p: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces: list[bytes | None] = [None] * n
        byte_ids = np.zeros(256, np.int32)
        score = np.full(n, -np.inf)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                byte_ids[value], pieces[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[i], score[i] = sp.id_to_piece(i).replace("▁", " ").encode(), sp.get_score(i)
        order = np.argsort(-score, kind="stable")
        rank = np.empty(n)
        rank[order] = np.arange(1, n + 1)
        return cls(pieces, byte_ids, -np.log(rank) - np.log((1.0 / np.arange(1, n + 1)).sum()))


def decode(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    """UTF-8 text of a list of ids, without the blank that encoding puts first."""
    return b"".join([vocabulary.pieces[i] for i in ids])[1:]


class Pieces:
    """Lookup of vocabulary pieces by span hash."""

    def __init__(self, v: Vocabulary):
        single = set(v.byte_ids.tolist())
        normal = [(i, x) for i, x in enumerate(v.pieces) if x is not None and i not in single]
        text = np.frombuffer(b"".join(x for _, x in normal), np.uint8)
        at = np.zeros(len(normal) + 1, np.int64)
        np.cumsum([len(x) for _, x in normal], out=at[1:])
        h = tv.Spans(text).hash(at[:-1], at[1:])
        self.sizes = sorted({len(x) for _, x in normal})
        slot = (h & np.uint64((1 << 19) - 1)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.hash, self.id = h[order], np.array([i for i, _ in normal], np.int32)[order]
        self.slot = np.append(slot[order], -1)
        self.maybe = np.zeros(1 << 19, bool)
        self.maybe[slot] = True
        self.at = np.zeros(1 << 19, np.int32)  # first piece of a slot
        self.at[slot[order][::-1]] = np.arange(len(slot) - 1, -1, -1)
        self.log_p = v.log_p
        self.byte_log_p = float(v.log_p[v.byte_ids].min())
        self.byte_ids = v.byte_ids
        held = np.zeros(256, bool)  # ASCII characters inside longer pieces
        for _, x in normal:
            if len(x) > 1:
                held[list(x)] = True
        self.alone = ~held
        self.alone[128:] = False

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, piece ids) of the hashes that are pieces."""
        slot = (h & np.uint64((1 << 19) - 1)).astype(np.int64)
        hit = np.flatnonzero(self.maybe[slot])
        h, slot = h[hit], slot[hit]
        at = self.at[slot].astype(np.int64)
        ok = self.hash[at] == h
        left = np.flatnonzero(~ok)
        while len(left):  # the next piece of the same slot
            at[left] += 1
            left = left[self.slot[at[left]] == slot[left]]
            same = self.hash[at[left]] == h[left]
            ok[left[same]] = True
            left = left[~same]
        return hit[ok], self.id[at[ok]]


class Lattice:
    """Edges and conditional probabilities of units laid out one after the other, a blank slot after each."""

    def __init__(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, p: Pieces):
        n = len(text)
        until = np.zeros(n, np.int64)
        size = end - start
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        until[inner] = np.repeat(end, size)
        at = inner[(text[inner] & 0xC0) != 0x80]
        sp = tv.Spans(text)
        ep, en, eid = [], [], []
        a = at
        for k in p.sizes:
            a = a[a + k <= until[a]]
            hit, ids = p.find(sp.hash(a, a + k))
            ep.append(a[hit])
            en.append(a[hit] + k)
            eid.append(ids)
        lead = text[at]
        width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        ends = np.zeros(n + 1, bool)
        from_, to, ids = np.concatenate(ep), np.concatenate(en), np.concatenate(eid)
        char = np.zeros(n, np.int64)
        char[at] = width
        ends[from_[to - from_ == char[from_]]] = True
        lone = at[~ends[at]]
        self.pos = np.concatenate([from_, lone])
        self.next = np.concatenate([to, lone + char[lone]])
        self.id = np.concatenate([ids, np.full(len(lone), -1, np.int32)])
        weight = np.concatenate([p.log_p[ids], char[lone] * p.byte_log_p])
        order = np.argsort(self.pos, kind="stable")
        self.pos, self.next, self.id, weight = self.pos[order], self.next[order], self.id[order], weight[order]
        self.first = np.zeros(n + 1, np.int64)  # edges of a position
        np.cumsum(np.bincount(self.pos, minlength=n), out=self.first[1:])
        back = np.zeros(n)
        left = (until - np.arange(n))[self.pos]
        if left.max(initial=0) < 1 << 16:
            left = left.astype(np.uint16)  # sorted by radix
        by = np.argsort(left, kind="stable")
        ranked = left[by]
        cuts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(by) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(by))):  # from the ends of the units to their starts
            e = by[i:j]
            x = weight[e] + back[self.next[e]]
            pos = self.pos[e]
            head = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
            top = np.maximum.reduceat(x, head)
            count = np.diff(np.append(head, len(e)))
            back[pos[head]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count)), head))
        self.log_q = np.minimum(weight + back[self.next] - back[self.pos], 0.0)
        if len(self.pos):  # the likeliest edge of a position first
            head = np.flatnonzero(np.append(True, self.pos[1:] != self.pos[:-1]))
            top = np.repeat(np.maximum.reduceat(self.log_q, head), np.diff(np.append(head, len(self.pos))))
            best = np.flatnonzero(self.log_q == top)
            best = best[np.append(True, self.pos[best[1:]] != self.pos[best[:-1]])]
            for x in (self.next, self.id, self.log_q):
                x[head], x[best] = x[best], x[head]
        head = np.flatnonzero(np.append(True, self.pos[1:] != self.pos[:-1])) if len(self.pos) else self.pos
        count = np.diff(np.append(head, len(self.pos)))
        self.upto = np.exp(self.log_q)  # probability of an edge or one before it; summed position by position,
        for k in range(1, int(count.max(initial=1))):  # so that it does not depend on what else is in the slice
            at = head[count > k] + k
            self.upto[at] += self.upto[at - 1]
        self.upto[head + count - 1] = 1.0

    def extend(self, other: Lattice, offset: int) -> None:
        """The edges of ``other``, whose positions start at ``offset``, after the own ones."""
        small = np.int32 if max(offset + len(other.first), len(self.pos) + len(other.pos)) < 1 << 31 else np.int64
        self.first = np.concatenate([self.first[:-1], (other.first + len(self.pos)).astype(small)])
        for name in ("pos", "next"):
            setattr(self, name, np.concatenate([getattr(self, name), (getattr(other, name) + offset).astype(small)]))
        for name in ("id", "log_q", "upto"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))

    def draw(self, pos: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each position, by probability."""
        e = self.first[pos]
        left = np.flatnonzero(u >= self.upto[e])
        while len(left):
            e[left] += 1
            left = left[u[left] >= self.upto[e[left]]]
        return e


class Units:
    """Lattices of the units a task has met; all are dropped before a slice once they hold over ``limit`` bytes."""

    def __init__(self, p: Pieces, limit: int):
        self.p, self.limit = p, limit
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint8)
        self.lattice = Lattice(self.flat, none, none, self.p)
        for name in ("pos", "next", "first"):
            setattr(self.lattice, name, getattr(self.lattice, name).astype(np.int32))
        self.hash, self.place = np.zeros(0, np.uint64), none

    def places(self, text: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) in ``flat`` of the units text[s:e]; those not held are built and held from now on."""
        if len(self.flat) > self.limit:
            self.forget()
        keys, first, inverse = np.unique(tv.Spans(text).hash(s, e), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, keys)
        held = at < len(self.hash)
        held[held] = self.hash[at[held]] == keys[held]
        new = first[~held]
        size = e[new] - s[new]
        place = np.zeros(len(new) + 1, np.int64)
        np.cumsum(size + 1, out=place[1:])
        flat = np.zeros(int(place[-1]), np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(place[:-1], size) + inner] = text[np.repeat(s[new], size) + inner]
        offset = len(self.flat)
        self.lattice.extend(Lattice(flat, place[:-1], place[:-1] + size, self.p), offset)
        self.flat = np.concatenate([self.flat, flat])
        start = np.zeros(len(keys), np.int64)
        start[held] = self.place[at[held]]
        start[~held] = place[:-1] + offset
        self.hash = np.insert(self.hash, at[~held], keys[~held])
        self.place = np.insert(self.place, at[~held], start[~held])
        start = start[inverse]
        return start, start + (e - s)


def uniform(key: np.ndarray, *parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the key and the parts."""
    x = key
    for i, part in enumerate(parts):
        x = x ^ tv.mix64(np.atleast_1d(np.asarray(part, np.uint64)) + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
        x = tv.mix64(x + np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def truncated(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at log-mass ``mass``, given that they are below ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - mass)


class Sampler:
    """Top-k segmentations of the rows of one slice."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, keys: np.ndarray, units: Units, k: int):
        self.rows, self.k = len(off) - 1, k
        full = np.flatnonzero(np.diff(off) > 0)
        text = np.insert(buf, off[full], 32)  # one blank before each text
        begin = off[full] + np.arange(len(full))
        n = len(text)
        blank, alone = text == 32, units.p.alone[text] & (text != 32)
        cut = np.zeros(n, bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        cut[begin] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], n)[: len(s)]
        self.row = full[np.searchsorted(begin, s, "right") - 1] if len(s) else s
        self.start, self.end = units.places(text, s, e)
        self.flat, self.lattice, self.p = units.flat, units.lattice, units.p
        self.of_row = tv.row_bounds(self.row, self.rows)
        self.key = keys
        self.unit_key = keys[self.row] if len(s) else np.zeros(0, np.uint64)
        self.inside = np.arange(len(s)) - self.of_row[self.row] if len(s) else s

    def descend(self, units: np.ndarray, cur: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Follow the lattice from the given places to the unit ends: (unit, edge), step by step."""
        us, es, step = [units[:0]], [units[:0]], 0
        ends = self.end[units]
        while len(units):
            e = self.lattice.draw(cur, uniform(self.unit_key[units], sample, self.inside[units], step))
            us.append(units)
            es.append(e)
            cur = self.lattice.next[e]
            live = cur < ends
            units, cur, ends = units[live], cur[live], ends[live]
            step += 1
        return np.concatenate(us), np.concatenate(es)

    def finish(self, unit: np.ndarray, edge: np.ndarray, fresh: np.ndarray, top: np.ndarray, sample: int) -> dict:
        """Order the pieces of a sample and value the sibling node of each fresh piece."""
        order = np.argsort(unit, kind="stable")
        unit, edge, fresh = unit[order], edge[order], fresh[order]
        row = self.row[unit]
        bounds = tv.row_bounds(row, self.rows)
        lq = self.lattice.log_q[edge]
        before, total = np.zeros(len(lq)), np.zeros(self.rows)
        for r in np.flatnonzero(np.diff(bounds) > 0).tolist():
            c = np.cumsum(lq[bounds[r]: bounds[r + 1]])
            before[bounds[r] + 1: bounds[r + 1]] = c[:-1]
            total[r] = c[-1]
        value = np.full(len(lq), -np.inf)
        i = np.flatnonzero(fresh & (lq < -1e-15))
        mass = before[i] + np.log(-np.expm1(lq[i]))
        value[i] = truncated(mass, top[row[i]], uniform(self.key[row[i]], sample, i - bounds[row[i]], 1 << 40))
        return {"unit": unit, "edge": edge, "row": row, "bounds": bounds, "before": before, "value": value,
                "total": total}

    def run(self) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
        """(sample number, its pieces, rows that have it, perturbed values), then the thresholds as number 0."""
        rows = np.arange(self.rows)
        top = -np.log(-np.log(uniform(self.key, 0, 0, 1 << 41)))
        units = np.arange(len(self.row))
        u, e = self.descend(units, self.start.copy(), 1)
        path = self.finish(u, e, np.ones(len(u), bool), top, 1)
        paths = [path]
        taken: dict[tuple[int, int], list[int]] = {}
        yield 1, path, rows, top
        has = np.ones(self.rows, bool)
        for number in range(2, self.k + 2):
            best, source, place = np.full(self.rows, -np.inf), np.full(self.rows, -1), np.full(self.rows, -1)
            for s, x in enumerate(paths):
                some = np.flatnonzero(np.diff(x["bounds"]) > 0)
                if not len(some):
                    continue
                m = np.maximum.reduceat(x["value"], x["bounds"][:-1][some])
                new = some[m > best[some]]
                if len(new):
                    best[new] = m[m > best[some]]
                    source[new] = s
                    hit = np.flatnonzero(x["value"] == best[x["row"]])
                    hit = hit[source[x["row"][hit]] == s]
                    place[x["row"][hit]] = hit
            if number > self.k:
                yield 0, {}, rows, best
                return
            has = source >= 0
            units, cur, news = [], [], []
            keep: list[np.ndarray] = []
            for s, x in enumerate(paths):
                limit = np.where(source == s, place, -1)
                keep.append(np.flatnonzero(np.arange(len(x["row"])) < limit[x["row"]]))
            some = np.flatnonzero(has)
            inner = np.array([place[r] - paths[source[r]]["bounds"][r] for r in some], np.int64)
            draws = uniform(self.key[some], number, inner, 1 << 42).tolist()
            again = uniform(self.key[some], number, inner, 1 << 43).tolist()
            for r, u, u2 in zip(some.tolist(), draws, again):
                x, t = paths[source[r]], int(place[r])
                old, unit = int(x["edge"][t]), int(x["unit"][t])
                at = int(self.lattice.pos[old])
                first = int(self.lattice.first[at])
                q = np.exp(self.lattice.log_q[first: int(self.lattice.first[at + 1])]).tolist()
                gone = taken.setdefault((int(source[r]), t), [old])
                for g in gone:
                    q[g - first] = 0.0
                left = u * sum(q)
                e = max(range(len(q)), key=q.__getitem__)  # rounding at the upper end leaves this one
                for i, y in enumerate(q):
                    if y > 0 and left < y:
                        e = i
                        break
                    left -= y
                q[e] = 0.0
                e += first
                gone.append(e)
                rest, top_here = sum(q), float(best[r])
                x["value"][t] = -np.inf if rest <= 0 else float(
                    -np.logaddexp(-top_here, math.log(-math.log(u2)) - float(x["before"][t]) - math.log(rest)))
                news.append((unit, e))
                nxt = int(self.lattice.next[e])
                if nxt < self.end[unit]:
                    units.append(np.array([unit]))
                    cur.append(np.array([nxt]))
                more = np.arange(unit + 1, self.of_row[r + 1])
                units.append(more)
                cur.append(self.start[more])
            if not news:
                continue
            u, e = self.descend(np.concatenate(units), np.concatenate(cur), number)
            kept_u = np.concatenate([x["unit"][i] for x, i in zip(paths, keep)])
            kept_e = np.concatenate([x["edge"][i] for x, i in zip(paths, keep)])
            own = np.array(news)
            fresh = np.zeros(len(kept_u) + len(own) + len(u), bool)
            fresh[len(kept_u) + len(own):] = True
            path = self.finish(np.concatenate([kept_u, own[:, 0], u]), np.concatenate([kept_e, own[:, 1], e]), fresh, best, number)
            paths.append(path)
            yield number, path, np.flatnonzero(has), best

    def ids(self, path: dict) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a sample's rows and the bounds of each row; an edge without a piece becomes its bytes."""
        edges, bounds = path["edge"], path["bounds"]
        ids = self.lattice.id[edges]
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, bounds
        size = np.ones(len(edges), np.int64)
        size[lone] = self.lattice.next[edges[lone]] - self.lattice.pos[edges[lone]]
        last = np.cumsum(size)
        out = np.repeat(ids, size)
        n = size[lone]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(last[lone] - n, n) + inner] = self.p.byte_ids[self.flat[np.repeat(self.lattice.pos[edges[lone]], n) + inner]]
        return out, np.append(0, last)[bounds]


class Decoder:
    """Bytes of many pieces at once."""

    def __init__(self, v: Vocabulary):
        parts = [x or b"" for x in v.pieces]
        self.text = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes of all ids, and where those of each row of ids start and end."""
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        step = np.repeat(self.at[ids] - ends[:-1], size)
        return self.text[step + np.arange(len(step))], ends[bounds]


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    own = ids.cast(pa.int64()).fill_null(-0x7FFFFFFFFFFFFFFF).to_numpy(zero_copy_only=False).astype(np.int64)
    return tv.mix64(own.view(np.uint64) + tv.mix64(np.array([seed], np.uint64)))


def _sample_batches(batches: Iterator[pa.RecordBatch], v: Vocabulary, p: Params, with_ids: bool) -> Iterator[pa.RecordBatch]:
    units, decoder = Units(Pieces(v), p.held_bytes), Decoder(v)
    for batch in batches:
        for part, buf, off in tv.row_slices(batch, "text", p.slice_bytes):
            sampler = Sampler(buf, off, row_keys(part.column("doc_id"), p.seed), units, p.k)
            threshold = np.full(part.num_rows, -np.inf)
            cols: list[list] = [[] for _ in range(6)]
            lists: list[np.ndarray] = []
            keys = part.column("doc_id").to_pylist()
            raw = buf.tobytes()
            place: list[np.ndarray] = []
            for number, path, rows, value in sampler.run():
                if number == 0:
                    threshold = value
                    continue
                place.append(rows)
                all_ids, bounds = sampler.ids(path)
                joined, ends = decoder.join(all_ids, bounds)
                text = joined.tobytes()
                for r in rows.tolist():
                    ids = all_ids[bounds[r]: bounds[r + 1]]
                    same = text[ends[r] + 1: ends[r + 1]] == raw[off[r]: off[r + 1]]  # without the blank put first
                    for c, x in zip(cols, (keys[r], number, len(ids), float(path["total"][r]), float(value[r]), same)):
                        c.append(x)
                    lists.append(ids.astype(np.int32))
            at = np.concatenate(place)
            d = np.array(cols[3]) - threshold[at]
            with np.errstate(divide="ignore", over="ignore"):
                inclusion = np.where(d < -30, d, np.log(-np.expm1(-np.exp(np.minimum(d, 700)))))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()),
                      pa.array(cols[4], pa.float64()), pa.array(inclusion, pa.float64()),
                      pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists], pa.string()), pa.array(cols[5], pa.bool_())]
            names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_sha256", "decoded_ok"]
            if with_ids:
                ends = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def sample(docs: DataFrame, p: Params = Params(), model_file: str = MODEL_FILE, with_ids: bool = False) -> DataFrame:
    """Up to k rows per row of ``docs``: see ``SAMPLES``; ``ids array<int>`` too if asked for.

    ``decoded_ok``: decoding the ids gave the text back, byte for byte.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))  # fixed size: the vocabulary
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(lambda it: _sample_batches(it, shared.value, p, with_ids), SAMPLES + (", ids array<int>" if with_ids else "")))


def decode_ids(rows: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """``rows(ids array<int>, ...)`` with a ``text`` column decoded from the ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    i = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else decode(shared.value, x).decode() for x in batch.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, rows.select("*", F.lit("").cast("string").alias("text")).schema)
