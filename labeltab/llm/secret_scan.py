"""Operator 2: secrets by fixed patterns and by character Markov models.

The fixed patterns (assignments, access keys, hex runs) give the base spans. In addition, two
order-1 character Markov models, one of random strings and one of ordinary tokens and
identifiers, are compared by log-likelihood ratio on every long token: tokens with a mean ratio above
``min_ratio`` per character are spans of kind ``random``. Those never touch a base span.

The models are trained from labelled samples: values matched by the fixed patterns and seeded random
strings of the usual alphabets are random; all other tokens of the sampled documents are ordinary.
``sample_rows`` bounds the documents used for training; every document is scanned whole.
Offsets are code points. Null texts read as empty. Rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import bounded_sample, only_ids

# The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

HEX = tv.byte_table(range(48, 58), range(97, 103))
UPPER = tv.byte_table(range(48, 58), range(65, 91))
TOKEN = tv.byte_table(range(48, 58), range(65, 91), range(97, 123), ord("+"), ord("/"), ord("_"), ord("="), ord("-"))


@dataclass(frozen=True)
class Markov:
    """Model parameters. ``sample_rows`` bounds the documents of the training sample."""

    sample_rows: int = 4_000
    min_length: int = 20
    min_ratio: float = 0.5
    random_strings: int = 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base spans of one text."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return out


def long_runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray, least: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e, row = tv.word_spans(buf, off, table)
    k = e - s >= least
    return s[k], e[k], row[k]


def transitions(strings: list[bytes]) -> np.ndarray:
    """Counts of adjacent characters; 0 marks the start."""
    c = np.zeros((128, 128))
    for x in strings:
        a = np.frombuffer(b"\0" + x, np.uint8)
        np.add.at(c, (a[:-1], a[1:]), 1)
    return c


def ratio_table(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition, add-half smoothed over the token alphabet."""
    k = int(TOKEN.sum())
    p = [(c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * k) for c in (random, ordinary)]
    return np.log(p[0]) - np.log(p[1])


def generated(count: int) -> list[bytes]:
    """Seeded random strings over hex, base-62, base-64 and upper-case alphabets."""
    rng = np.random.default_rng(11)
    hexa, up = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    b62 = up + b"abcdefghijklmnopqrstuvwxyz"
    return [bytes(rng.choice(np.frombuffer(a, np.uint8), 40)) for a in (hexa, b62, b62 + b"+/", up) for _ in range(count)]


class Scanner:
    """All spans of row slices; ``ratio`` is None for the base spans alone."""

    def __init__(self, ratio: np.ndarray | None, p: Markov):
        self.ratio, self.p = ratio, p

    def __call__(self, part: pa.RecordBatch, buf: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, int]]]:
        n = part.num_rows
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        if not len(buf):
            return out
        marks = np.zeros(n, bool)
        marks[np.searchsorted(off, np.flatnonzero((buf == 61) | (buf == 58)), "right") - 1] = True
        s, e, row = long_runs(buf, off, UPPER, MIN_ACCESS)
        marks[row] = True
        texts = part.column("text")
        runs = [[] for _ in range(n)]
        for kind, table, least in ((2, HEX, MIN_HEX), (3, TOKEN, self.p.min_length)):
            if kind == 2 or self.ratio is not None:
                for a, b, r in zip(*(x.tolist() for x in long_runs(buf, off, table, least))):
                    runs[r].append((a, b, kind))
        for r in range(n):
            if marks[r]:
                out[r] = base_spans(texts[r].as_py() or "")
            if runs[r]:
                o = int(off[r])
                lead = np.cumsum((buf[o: int(off[r + 1])] & 0xC0) != 0x80)
                points = [(int(lead[a - o]) - 1, int(lead[a - o]) - 1 + b - a, kind, a, b) for a, b, kind in runs[r]]
                out[r] += [x[:3] for x in points if x[2] == 2]
                for x in (x for x in points if x[2] == 3):
                    if not any(a < x[1] and x[0] < b for a, b, _ in out[r]) and self.llr(buf[x[3]: x[4]]) > self.p.min_ratio:
                        out[r].append(x[:3])
            out[r].sort(key=lambda x: (x[0], x[2], x[1]))
        return out

    def llr(self, token: np.ndarray) -> float:
        """Mean log-likelihood ratio per character of an ASCII token."""
        return float(self.ratio[np.append(0, token[:-1]), token].mean())


def _train_batches(batches: Iterator[pa.RecordBatch], p: Markov) -> Iterator[pa.RecordBatch]:
    scan = Scanner(None, p)
    random, ordinary = np.zeros((128, 128)), np.zeros((128, 128))
    for batch in batches:
        for part, buf, off in tv.row_slices(batch, "text"):
            spans = scan(part, buf, off)
            covered = np.zeros(len(buf), bool)
            texts = part.column("text")
            for r, own in enumerate(spans):
                text = (texts[r].as_py() or "") if own else ""
                for a, b, kind in own:
                    at = int(off[r]) + len(text[:a].encode())
                    size = len(text[a:b].encode())
                    covered[at: at + size] = True
                    value = ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]
                    random += transitions([value.encode()])
            s, e, _ = tv.word_spans(buf, off, TOKEN)
            whole = ~covered[s] & (e - s > 1)
            s, e = s[whole], e[whole]
            inner = np.zeros(len(buf) + 1, bool)
            inner[s] = True
            live = np.cumsum(np.bincount(s, minlength=len(buf) + 1) - np.bincount(e, minlength=len(buf) + 1))[:-1] > 0
            at = np.flatnonzero(live)
            prev = np.where(inner[at], 0, buf[at - 1])
            np.add.at(ordinary, (prev, buf[at]), 1)
    for name, c in (("random", random), ("ordinary", ordinary)):
        i, j = np.nonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array((i * 128 + j).astype(np.int64)),
                                          pa.array(c[i, j])], names=["model", "cell", "times"])


def train(docs: DataFrame, p: Markov = Markov()) -> np.ndarray:
    """Ratio table (128 x 128, of fixed size) from at most ``sample_rows`` documents."""
    chosen = bounded_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), p.sample_rows, "doc_id")
    texts = only_ids(docs.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id", "left_semi")
    cells = (texts.select("text").mapInArrow(lambda it: _train_batches(it, p), "model string, cell long, times double")
             .groupBy("model", "cell").agg(F.sum("times").alias("times")).toPandas())
    counts = {"random": transitions(generated(p.random_strings)), "ordinary": np.zeros((128, 128))}
    for name, c in counts.items():
        own = cells[cells["model"] == name]
        np.add.at(c.reshape(-1), own["cell"].to_numpy(dtype=np.int64), own["times"].to_numpy())
    return ratio_table(counts["random"], counts["ordinary"])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, p: Markov = Markov()) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, digest of the base spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(shared.value, p)
        for batch in batches:
            for part, buf, off in tv.row_slices(batch, "text"):
                spans = scan(part, buf, off)
                base = [[x for x in own if x[2] < 3] for own in spans]
                count = [pa.array([sum(x[2] == k for x in own) for own in base], pa.int64()) for k in range(3)]
                digest = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *count, pa.array(digest, pa.string()),
                     pa.array([joined(own) for own in spans], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def mask(text: str, spans: list[tuple[int, int, int]], put: str = "<SECRET>") -> str:
    """The text with each maximal run of spans replaced."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at and (a > at or not out):
            out += [text[at:a], put]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, p: Markov = Markov()) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` (if there) renewed; nulls stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, p))
    i = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(shared.value, p)
        for batch in batches:
            for part, buf, off in tv.row_slices(batch, "text"):
                spans, old = scan(part, buf, off), part.column(i)
                if any(spans):
                    new = [mask(x.as_py(), own) if own else x.as_py() for x, own in zip(old, spans)]
                    old = pa.array(new, old.type)
                yield part.set_column(i, "text", old)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
