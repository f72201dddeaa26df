"""Operator 10: language of a text, with spans of mixed-language texts.

Each word (a run of letters) has a script, from Unicode ranges; only languages that use this
script are candidates. A word's score for a language is the mean log-probability of its byte 2-, 3- and
4-grams, times its length. Viterbi over the words of a text with a fixed penalty for switching
labels every word, so a text splits into spans. The language of the text is the one
with the most labelled bytes; its share of them is the score.

The gram tables are fitted on at most ``sample_rows`` documents that have a language (a bounded
sample); every text is labelled whole. A text that is null or has no letter is ``und`` with score 0, as is
everything if nothing can be learned.
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

# First code points of script ranges and the script that starts there.
SCRIPT_STARTS = np.array([0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0B80, 0x0C00, 0x0E00, 0x0E80,
                          0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
SCRIPTS = ("Latin Greek Cyrillic Armenian Hebrew Arabic Other Devanagari Bengali Tamil Telugu Thai Lao "
           "Georgian Hangul Ethiopic Latin Greek Other Kana Other Han Other Hangul Other").split()
SCRIPT_NAMES = sorted(set(SCRIPTS))
SCRIPT_CODE = np.array([SCRIPT_NAMES.index(x) for x in SCRIPTS], np.int8)
NO_LANGUAGE = "und"


@dataclass(frozen=True)
class Params:
    """``sample_rows`` bounds the documents of the fit."""

    sample_rows: int = 6_000
    grams: tuple[int, ...] = (2, 3, 4)
    slots: int = 1 << 15
    switch: float = 12.0
    min_script_share: float = 0.001


def word_scripts(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Script of each word: that of its last non-ASCII character, Latin without one."""
    code = np.full(len(s), SCRIPT_NAMES.index("Latin"), np.int8)
    lead = np.flatnonzero(buf >= 0xC0)
    if not len(lead) or not len(s):
        return code
    pad = np.append(buf, np.zeros(3, np.uint8)).astype(np.int64)
    b0, b1, b2, b3 = (pad[lead + k] for k in range(4))
    cp = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63,
                  np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63,
                           (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
    word = np.searchsorted(s, lead, "right") - 1
    ok = (word >= 0) & (lead < e[word])
    code[word[ok]] = SCRIPT_CODE[np.searchsorted(SCRIPT_STARTS, cp[ok], "right") - 1]
    return code


def gram_slots(buf: np.ndarray, s: np.ndarray, e: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of all byte grams of the words, with one blank before and after each."""
    size = e - s + 2
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    text = np.full(int(at[-1]), 32, np.uint64)
    word = np.repeat(np.arange(len(s)), size)
    inner = np.arange(int(at[-1])) - at[word]
    mid = (inner > 0) & (inner < size[word] - 1)
    text[mid] = buf[(s[word] + inner - 1)[mid]]
    slots, words = [], []
    for n in p.grams:
        m = len(text) - n + 1
        if m <= 0:
            continue
        acc = np.full(m, n, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(257) + text[k: k + m]
        ok = np.flatnonzero(word[:m] == word[n - 1:])
        slots.append(((acc[ok] * tv.BASE) >> np.uint64(40)).astype(np.int64) % p.slots)
        words.append(word[ok])
    return np.concatenate(slots or [np.zeros(0, np.int64)]), np.concatenate(words or [np.zeros(0, np.int64)])


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    i = batch.schema.get_field_index("text")
    return batch.set_column(i, "text", pc.utf8_lower(batch.column(i)))


def _count_batches(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    langs: dict[str, int] = {}
    counts: list[np.ndarray] = []
    scripts: list[np.ndarray] = []
    for batch in batches:
        for part, buf, off in tv.row_slices(lowered(batch), "text"):
            names = part.column("lang").to_pylist()
            for x in names:
                if x not in langs:
                    langs[x] = len(langs)
                    counts.append(np.zeros(p.slots))
                    scripts.append(np.zeros(len(SCRIPT_NAMES)))
            of = np.array([langs[x] for x in names])
            s, e, row = tv.word_spans(buf, off, tv.LETTERS)
            slot, word = gram_slots(buf, s, e, p)
            code = word_scripts(buf, s, e)
            for k in np.unique(of):
                mine = of[row] == k
                counts[k] += np.bincount(slot[mine[word]], minlength=p.slots)
                scripts[k] += np.bincount(code[mine], minlength=len(SCRIPT_NAMES))
    for x, k in langs.items():
        both = np.concatenate([counts[k], scripts[k]])
        i = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(i), pa.string()), pa.array(i), pa.array(both[i])],
                                         names=["lang", "cell", "times"])


@dataclass
class Model:
    langs: list[str]
    gram: np.ndarray  # slots x languages, log-probability
    uses: np.ndarray  # scripts x languages, whether the language uses the script


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Gram and script tables from ``docs(doc_id, text, lang)``, at most ``sample_rows`` of them."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    chosen = bounded_sample(known.select("doc_id").distinct(), p.sample_rows, "doc_id")
    rows = only_ids(known.select("doc_id", "lang", "text"), chosen, "doc_id").join(chosen, "doc_id", "left_semi")
    cells = (rows.select("lang", "text").mapInArrow(lambda it: _count_batches(it, p), "lang string, cell long, times double")
             .groupBy("lang", "cell").agg(F.sum("times").alias("times")).toPandas())
    langs = sorted(set(cells["lang"]))
    table = np.zeros((p.slots + len(SCRIPT_NAMES), len(langs)))
    for k, x in enumerate(langs):
        own = cells[cells["lang"] == x]
        table[own["cell"].to_numpy(dtype=np.int64), k] = own["times"].to_numpy()
    gram, script = table[: p.slots], table[p.slots:]
    gram = np.log((gram + 0.1) / (gram.sum(0) + 0.1 * p.slots)) if langs else gram
    uses = script / np.maximum(script.sum(0), 1) >= p.min_script_share
    return Model(langs, gram.astype(np.float32), uses)


def word_scores(model: Model, buf: np.ndarray, off: np.ndarray, p: Params
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores words x languages, word bytes, row) of a slice; distinct words are scored once."""
    s, e, row = tv.word_spans(buf, off, tv.LETTERS)
    _, first, back = np.unique(tv.Spans(buf).hash(s, e), return_index=True, return_inverse=True)
    fs, fe = s[first], e[first]
    slot, word = gram_slots(buf, fs, fe, p)
    order = np.argsort(word, kind="stable")
    slot, word = slot[order], word[order]
    starts = np.searchsorted(word, np.arange(len(fs)))
    x = np.empty((len(fs), len(model.langs)), np.float32)
    for k in range(len(model.langs)):
        x[:, k] = np.add.reduceat(model.gram[slot, k], starts) if len(fs) else 0
    x *= ((fe - fs) / np.maximum(np.bincount(word, minlength=len(fs)), 1))[:, None]
    # first[] points to an arbitrary place of the same letters, so script and score are the word's own
    sort = np.argsort(fs, kind="stable")
    code = np.empty(len(fs), np.int8)
    code[sort] = word_scripts(buf, fs[sort], fe[sort])
    allowed = model.uses[code]
    x[~allowed & allowed.any(1)[:, None]] = -1e6
    return x[back], (e - s), row


def viterbi(x: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word, all texts at once: step t handles the t-th word of each text."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    at, size = bounds[:-1][order], size[order]
    label = np.zeros(len(x), np.int64)
    if not len(x):
        return label
    stay = np.empty(x.shape, bool)
    top = np.empty(len(x), np.int8 if x.shape[1] < 128 else np.int64)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # texts with more than t words
    v = x[at[: alive[0]]].copy()
    for t in range(1, int(size[0])):
        k = alive[t]
        v = v[:k]
        i = at[:k] + t
        best = v.argmax(1)
        jump = v[np.arange(k), best] - switch
        stay[i] = v >= jump[:, None]
        top[i] = best
        v = x[i] + np.maximum(v, jump[:, None])
        v -= v.max(1, keepdims=True)
        if k > alive[t + 1]:
            label[i[alive[t + 1]:]] = v[alive[t + 1]:].argmax(1)
    one = np.flatnonzero(size == 1)
    label[at[one]] = x[at[one]].argmax(1)
    for t in range(int(size[0]) - 1, 0, -1):
        i = at[: alive[t]] + t
        own = label[i]
        label[i - 1] = np.where(stay[i, own], own, top[i])
    return label


def _label_batches(batches: Iterator[pa.RecordBatch], model: Model, p: Params) -> Iterator[tuple]:
    """(rows, labels, word bytes, row of word, whether a row has a letter) of whole batches."""
    for batch in batches:
        xs, sizes, rows, done = [np.zeros((0, len(model.langs)), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        ascii_letter = np.zeros(batch.num_rows, bool)
        low = lowered(batch)
        for part, buf, off in tv.row_slices(low, "text"):
            x, size, row = word_scores(model, buf, off, p)
            has = np.flatnonzero((buf >= 97) & (buf < 123))
            ascii_letter[done + np.searchsorted(off, has, "right") - 1] = True
            xs.append(x)
            sizes.append(size)
            rows.append(row + done)
            done += part.num_rows
        row, size = np.concatenate(rows), np.concatenate(sizes)
        label = viterbi(np.concatenate(xs), tv.row_bounds(row, batch.num_rows), p.switch)
        words = np.bincount(row, minlength=batch.num_rows)
        letter = ascii_letter & (words > 0)
        text = low.column("text")
        for r in np.flatnonzero((words > 0) & ~ascii_letter):  # only here a byte may be no letter
            letter[r] = any(c.isalpha() for c in text[int(r)].as_py())
        yield batch, label, size, row, letter


def predict(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans`` (runs of words of one language) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, NO_LANGUAGE], object)
        if not m.langs:
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([NO_LANGUAGE] * n, pa.string()),
                                                  pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))],
                                                 names=["doc_id", "lang_pred", "score", "n_spans"])
            return
        for batch, label, size, row, letter in _label_batches(batches, m, p):
            n, k = batch.num_rows, len(m.langs)
            mass = np.bincount(row * k + label, weights=size, minlength=n * k).reshape(n, k)
            best = np.where(letter, mass.argmax(1), k)
            share = np.where(letter, mass.max(1) / np.maximum(mass.sum(1), 1), 0.0)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
            spans = np.where(letter, np.bincount(row[new], minlength=n), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(share),
                                              pa.array(spans.astype(np.int64))],
                                             names=["doc_id", "lang_pred", "score", "n_spans"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long"))


def classify(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Learn from the documents outside the held-out fold, label all."""
    from .toxicity import held_out

    out = held_out(mod=5, fold=0)
    model = train(docs.where(~out).select("doc_id", "text", "lang"), p)
    return predict(docs, model, p).select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_spans")
