"""Operator 1: toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text: its lower-cased words (runs of letters), word pairs, and skip-grams that leave
out one or two words, each hashed to 32 bits. Every word also counts by its stems (first 4 to 7
bytes), so that inflected forms and compounds share a weight. A feature's value is its rarity among
the rows of the fit, however often the text has it. Per-coordinate learning rates and the L1 term of
FTRL-proximal leave few non-zero weights; those are broadcast (hash and weight, sorted) and every
text is scored whole in vectorised tasks.

The model is fitted on at most ``max_rows`` labelled documents (those with the smallest hash of
their id), so the fit, its feature table and the weights are bounded whatever the corpus size.
Null and empty texts have no features: their score is the prior. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import bounded_sample, only_ids


@dataclass(frozen=True)
class Ftrl:
    """Fit parameters. ``max_rows`` bounds the labelled rows of the fit, ``positive`` weighs label 1."""

    max_rows: int = 10_000
    alpha: float = 10.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    epochs: int = 5
    min_docs: int = 5
    positive: float = 2.0
    skips: tuple[int, ...] = (1, 2, 3)
    stems: tuple[int, ...] = (4, 5, 6, 7)
    threshold: float = 0.7


def features(buf: np.ndarray, off: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit feature hash, row) of all words, their stems and all word pairs at the given distances."""
    s, e, row = tv.word_spans(buf, off, tv.LETTERS)
    spans = tv.Spans(buf)
    h = spans.hash(s, e)
    hs, rows = [h], [row]
    for k in p.stems:
        longer = np.flatnonzero(e - s > k)
        hs.append(tv.mix64(spans.hash(s[longer], s[longer] + k) + np.uint64(1)))
        rows.append(row[longer])
    for d in p.skips:
        if len(h) > d:
            same = np.flatnonzero(row[:-d] == row[d:])
            hs.append(tv.mix64(h[same] * tv.BASE + h[same + d] + np.uint64(d)))
            rows.append(row[same])
    return (np.concatenate(hs) >> np.uint64(32)).astype(np.uint32), np.concatenate(rows)


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    i = batch.schema.get_field_index("text")
    return batch.set_column(i, "text", pc.utf8_lower(batch.column(i)))


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, in order."""
    key = np.unique((row.astype(np.uint64) << np.uint64(32)) | h)
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)


def fit(examples: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (distinct features, label) examples -> (hashes, weights, bias)."""
    none = np.zeros(0, np.uint32), np.zeros(0), 0.0
    if not examples:
        return none
    ids, docs = np.unique(np.concatenate([x[0] for x in examples]), return_counts=True)
    ids, docs = ids[docs >= p.min_docs], docs[docs >= p.min_docs]
    rarity = np.log(len(examples) / docs) / np.log(len(examples) + 1)
    rows = []
    for h, y in examples:
        at = np.searchsorted(ids, h)
        at[at == len(ids)] = 0
        ok = ids[at] == h if len(ids) else np.zeros(len(h), bool)
        rows.append((np.append(at[ok], len(ids)).astype(np.int32), np.append(rarity[at[ok]], 1.0).astype(np.float32), y))
    z, n = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    l1 = np.full(len(ids) + 1, p.l1)
    l1[-1] = 0.0

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            i, v, y = rows[k]
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v * (p.positive if y else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None))
    keep = np.flatnonzero(w[:-1])
    return ids[keep], w[keep] * rarity[keep], float(w[-1])


def _fit_batches(batches: Iterator[pa.RecordBatch], p: Ftrl) -> Iterator[pa.RecordBatch]:
    found: list[tuple[int, np.ndarray, int]] = []
    for batch in batches:
        for part, buf, off in tv.row_slices(lowered(batch), "text"):
            row, h = distinct(*features(buf, off, p))
            b = tv.row_bounds(row, part.num_rows)
            for r, (key, y) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist())):
                found.append((key, h[b[r]: b[r + 1]].copy(), y))
    found.sort(key=lambda x: x[0])
    h, w, bias = fit([x[1:] for x in found], p)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(h.astype(np.int64), -1)), pa.array(np.append(w, bias))],
                                     names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from ``labels(doc_id, label)`` and the texts of ``docs``; see the module text."""
    known = (labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.col("label").cast("int")).alias("label")))
    chosen = bounded_sample(known, p.max_rows, "doc_id")
    texts = only_ids(docs.select("doc_id", "text"), chosen, "doc_id").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    got = (texts.select("doc_id", "text", "label").coalesce(1)  # at most max_rows rows
           .mapInArrow(lambda it: _fit_batches(it, p), "feature long, weight double").toPandas())
    own = got["feature"].to_numpy()
    w = got["weight"].to_numpy()
    return own[own >= 0].astype(np.uint32), w[own >= 0], float(w[own < 0].sum())


class Scorer:
    """Scores of row slices from sparse weights: a bit table drops almost all features first."""

    BITS = 20

    def __init__(self, h: np.ndarray, w: np.ndarray, bias: float, p: Ftrl):
        self.h, self.w, self.bias, self.p = h, w, bias, p
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[h & np.uint32((1 << self.BITS) - 1)] = True

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.full(len(off) - 1, self.bias)
        if len(buf) and len(self.h):
            h, row = features(buf, off, self.p)
            hit = np.flatnonzero(self.maybe[h & np.uint32((1 << self.BITS) - 1)])
            h, row = h[hit], row[hit]
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            ok = self.h[at] == h
            row, f = distinct(h[ok], row[ok])
            np.add.at(total, row, self.w[np.searchsorted(self.h, f)])
        return 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], p: Ftrl = Ftrl()) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, p)
        for batch in batches:
            for part, buf, off in tv.row_slices(lowered(batch), "text"):
                x = scorer(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(x), pa.array((x >= p.threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))


def clean(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], p: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, each by its own text, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value, p)
        for batch in batches:
            at = 0
            for part, buf, off in tv.row_slices(lowered(batch), "text"):
                yield batch.slice(at, part.num_rows).filter(pa.array(scorer(buf, off) < p.threshold))
                at += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id", mod: int = 3, fold: int = 1) -> F.Column:
    """Whether crc32 of the id's text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % mod == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, score every row of ``docs``."""
    known = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, train(docs, known, p), p).select("doc_id", held_out().alias("held_out"), "score", "predicted")
