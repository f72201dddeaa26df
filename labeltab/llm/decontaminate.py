"""Operator 9: benchmark decontamination by template windows.

Tokens are runs of letters and digits; a number with its sign, separators and decimals (-3, 1,250,
2.5, 3/4) is one token. A token with a digit becomes a number placeholder, a unit after a number a
unit placeholder and a capitalised word inside a sentence a name placeholder; all other tokens count
in lower case. Windows of ``window`` tokens are hashed as templates, once with names kept and once
with names replaced, if they have ``min_words`` plain words, and all windows once more by their exact
tokens, so that verbatim copies are found whatever they consist of. Documents and benchmark items are
joined on the hash. In a run of windows at one distance between document and item, the values behind
the placeholders must map one to one; then a question with other numbers or names is the same
question. A place whose pair of values does not have the strict majority among the run's pairs with
the same value on either side is in conflict, and the windows with a placeholder there do not count; the
others do, windows of exact tokens always, so that no conflict hides a verbatim copy.
An item is leaked into a document if the windows that count cover ``min_run`` of its tokens, or all
of a shorter item; of an item with few template windows, all of these are enough.

A Bloom filter of the item windows with a fixed number of bits drops nearly all document windows
before they leave the task; the join decides. An item with fewer tokens than a window is one window
of its own length. Null texts read as empty and have no window; empty tables have no leak. ``leaks`` leaves out
rows without an id and takes the rows of one doc_id (or item_id) as parts of one document (item), so repeated
rows change nothing; ``clean`` judges every row by itself, whatever its id. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import ROW_KEY, stage, with_row_keys, without_ids

# Unit words that count as units after a number.
UNITS = ("mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
         "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
         "ml cl l liter liters litre litres gallon gallons cup cups ms s sec second seconds min minute minutes h hour hours "
         "day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents "
         "kmh mph km2 m2 degrees celsius fahrenheit watt watts volt volts").split()

PLAIN, NUMBER, UNIT, NAME = range(4)
KEPT, REPLACED, EXACT = range(3)  # names kept, names replaced, no placeholder at all
WINDOW_ROWS = "id long, wh long, at int, total int, template boolean, offs array<int>, slots array<long>"
RUN_ROWS = "doc_id long, item_id long, places array<int>, template_places array<int>, n_slots int, reparameterised boolean"
RUN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("places", pa.list_(pa.int32())),
                        ("template_places", pa.list_(pa.int32())), ("n_slots", pa.int32()), ("reparameterised", pa.bool_())])
BLOOM_BITS = 1 << 24


@dataclass(frozen=True)
class Params:
    window: int = 8
    min_words: int = 4
    min_run: int = 13


def _word_hash(words: tuple[str, ...]) -> np.ndarray:
    raw = [x.encode() for x in words]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=at[1:])
    return np.sort(tv.Spans(np.frombuffer(b"".join(raw), np.uint8)).hash(at[:-1], at[1:]))


UNIT_HASHES = _word_hash(tuple(UNITS))
PLACEHOLDER = tv.mix64(np.arange(1, 5, dtype=np.uint64))
UPPER = tv.byte_table(range(65, 91))
SMALL = tv.byte_table(range(97, 123), range(128, 256))
STOP = tv.byte_table(*(ord(c) for c in ".!?:\n\r"))
SEPARATOR = tv.byte_table(*(ord(c) for c in ",./"))
SIGN = tv.byte_table(*(ord(c) for c in "+-"))
OPERAND_END = tv.ALNUM | tv.byte_table(ord(")"), ord("]"))
EXACT_SEED = np.uint64(0x2545F4914F6CDD1D)


def _running(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=out[1:])
    return out


def _whole_numbers(low: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The bytes with a digit in place of every sign of a number and separator between its digits."""
    out = low.copy()
    if not len(low):
        return out
    digit = tv.DIGITS[low]
    first, last = np.zeros(len(low), bool), np.zeros(len(low), bool)
    filled = off[1:] > off[:-1]
    first[off[:-1][filled]] = True
    last[off[1:][filled] - 1] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = digit[:-1], digit[1:]
    operand = np.zeros(len(low), bool)
    operand[1:] = OPERAND_END[low[:-1]]
    after &= ~last
    out[(SEPARATOR[low] & before & after & ~first) | (SIGN[low] & after & (first | ~operand))] = ord("0")
    return out


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the lower-cased token, kind, row)."""
    low = tv.ASCII_LOWER[buf]
    s, e, row = tv.word_spans(_whole_numbers(low, off), off, tv.ALNUM)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), row
    h = tv.Spans(low).hash(s, e)
    digits = _running(tv.DIGITS[buf])
    kind = np.where(digits[e] > digits[s], NUMBER, PLAIN).astype(np.int8)
    first = np.ones(len(s), bool)
    first[1:] = row[1:] != row[:-1]
    title = np.flatnonzero(UPPER[buf[s]] & (kind == PLAIN) & ~first & SMALL[buf[np.minimum(s + 1, len(buf) - 1)]] & (e - s > 1))
    stops = _running(STOP[buf])
    kind[title[stops[s[title]] == stops[e[title - 1]]]] = NAME
    after = np.flatnonzero((kind[1:] == PLAIN) & (kind[:-1] == NUMBER) & ~first[1:]) + 1
    kind[after[np.isin(h[after], UNIT_HASHES)]] = UNIT
    return h, kind, row


def windows(h: np.ndarray, kind: np.ndarray, row: np.ndarray, n: int, min_words: int, variant: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of the n-token windows: all of them by exact tokens, or those with enough
    plain words as templates; with names replaced only windows that have one."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    item = np.where(_swapped(kind, variant), PLACEHOLDER[kind], h)
    acc = np.full(m, EXACT_SEED if variant == EXACT else np.uint64(n), np.uint64)
    for k in range(n):
        acc = acc * tv.BASE + item[k: k + m]
    ok = row[:m] == row[n - 1:]
    if variant != EXACT:
        ok &= _rich(kind, np.arange(m), n, min_words)
    if variant == REPLACED:
        named = _running(kind == NAME)
        ok &= named[n:] > named[:m]
    at = np.flatnonzero(ok)
    return tv.mix64(acc[at]), at


def _swapped(kind: np.ndarray, variant: int) -> np.ndarray:
    return (kind > PLAIN) & (kind < (NAME, NAME + 1, NUMBER)[variant])


def _rich(kind: np.ndarray, at: np.ndarray, n: int, min_words: int) -> np.ndarray:
    plain = _running(kind == PLAIN)
    return plain[at + n] - plain[at] >= min_words


def _window_batches(batches: Iterator[pa.RecordBatch], p: Params, sizes: tuple[int, ...] | None,
                    maybe) -> Iterator[pa.RecordBatch]:
    """Windows of each text; ``sizes`` None: the item's own size if it is shorter than a window."""
    for batch in batches:
        for part, buf, off in tv.row_slices(batch, "text", 1 << 19):
            h, kind, row = tokens(buf, off)
            start = tv.row_bounds(row, part.num_rows)
            total = np.diff(start)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            hs, ats, rich, offs, slots = [], [], [], [], []
            for n in sizes or sorted({min(int(x), p.window) for x in total if x}):
                for variant in (KEPT, REPLACED, EXACT):
                    wh, at = windows(h, kind, row, n, p.min_words, variant)
                    if sizes is None:
                        k = np.minimum(total, p.window)[row[at]] == n
                        wh, at = wh[k], at[k]
                    if maybe is not None:
                        k = maybe(wh)
                        wh, at = wh[k], at[k]
                    hs.append(wh)
                    ats.append(at)
                    rich.append(_rich(kind, at, n, p.min_words))
                    swapped = _swapped(kind, variant)
                    for a in at.tolist():
                        o = np.flatnonzero(swapped[a: a + n])
                        offs.append(o.tolist())
                        slots.append(h[a + o].view(np.int64).tolist())
            if not slots:
                continue
            wh, at, rich = (np.concatenate(x) for x in (hs, ats, rich))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[at]]), pa.array(wh.view(np.int64)), pa.array((at - start[row[at]]).astype(np.int32)),
                 pa.array(total[row[at]].astype(np.int32)), pa.array(rich), pa.array(offs, pa.list_(pa.int32())),
                 pa.array(slots, pa.list_(pa.int64()))],
                names=["id", "wh", "at", "total", "template", "offs", "slots"])


def conflicts(pairs: set[tuple[int, int, int]]) -> set[int]:
    """Places of the (place, item value, document value) triples whose pair of values is not the most
    frequent one, alone, both for its item value and for its document value."""
    count: Counter = Counter((i, d) for _, i, d in pairs)
    best: tuple[dict, dict] = ({}, {})
    for pair, c in count.items():
        for side in (0, 1):
            best[side].setdefault(pair[side], []).append(c)
    good = {pair for pair, c in count.items()
            if all(c == max(best[k][pair[k]]) and best[k][pair[k]].count(c) == 1 for k in (0, 1))}
    return {place for place, i, d in pairs if (i, d) not in good}


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each run that count."""
    for batch in batches:
        out = []
        for run in batch.to_pylist():
            found = [(w["at"], w["template"], [(w["at"] + o, i, d) for o, i, d in zip(w["offs"], w["i"], w["d"])])
                     for w in run["windows"]]
            bad = conflicts({x for w in found for x in w[2]})
            if bad:
                found = [w for w in found if bad.isdisjoint(x[0] for x in w[2])]
            if found:
                pairs = {x[1:] for w in found for x in w[2]}
                out.append({"doc_id": run["doc_id"], "item_id": run["item_id"], "places": sorted({w[0] for w in found}),
                            "template_places": sorted({w[0] for w in found if w[1]}), "n_slots": len({i for i, _ in pairs}),
                            "reparameterised": any(i != d for i, d in pairs)})
        yield pa.RecordBatch.from_pylist(out, RUN_SCHEMA)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return (df.where(F.col(key).isNotNull())
            .select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text")))


def _bloom(items: DataFrame) -> np.ndarray:
    """Bit table of fixed size (2^24 bits, 2 MB) over two probes of each window hash."""
    slots = items.select(F.explode(F.array(F.expr(f"pmod(wh, {BLOOM_BITS}L)"),
                                           F.expr(f"pmod(shiftright(wh, 24), {BLOOM_BITS}L)"))).alias("s"))
    words = (slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("b"))
             .toPandas())
    table = np.zeros(BLOOM_BITS // 64, np.int64)
    table[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return table.view(np.uint64)


def leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document and leaked item: ``doc_id, item_id, n_windows, n_matched, coverage,
    n_slots, reparameterised``. Documents without a leak have no row."""
    spark: SparkSession = docs.sparkSession
    items = stage(_keyed(benchmark, "item_id")
                  .mapInArrow(lambda it: _window_batches(it, p, None, None), WINDOW_ROWS), "bench-windows")
    short = [r[0] for r in items.where(f"total < {p.window}").select("total").distinct().collect()]  # at most window - 1 values
    sizes = tuple(sorted({p.window, *short}))
    shared = spark.sparkContext.broadcast(_bloom(items))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def maybe(wh: np.ndarray) -> np.ndarray:
            hit = np.arange(len(wh))
            for shift in (0, 24):
                s = (wh[hit] >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)
                hit = hit[(table[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1]
            return hit

        yield from _window_batches(batches, p, sizes, maybe)

    found = _keyed(docs, "doc_id").mapInArrow(scan, WINDOW_ROWS)
    item = items.select("wh", F.col("id").alias("item_id"), F.col("at").alias("item_at"), "template",
                        F.least("total", F.lit(p.window)).alias("n"), "offs", F.col("slots").alias("item_slots"))
    hits = found.select(F.col("id").alias("doc_id"), "wh", "at", "slots").distinct().join(item.distinct(), "wh")
    window = F.struct(F.col("item_at").alias("at"), "n", "template", "offs", F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    runs = (hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("distance"))
            .agg(F.collect_set(window).alias("windows")).mapInArrow(_judge, RUN_ROWS))
    size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    matched = (runs.groupBy("doc_id", "item_id")
               .agg(size("places").alias("n_matched"), size("template_places").alias("n_templates"),
                    F.max("n_slots").cast("long").alias("n_slots"), F.max("reparameterised").alias("reparameterised")))
    all_windows = (items.groupBy(F.col("id").alias("item_id"))
                   .agg(F.countDistinct("at").alias("n_windows"), F.countDistinct(F.when(F.col("template"), F.col("at"))).alias("templates")))
    need = F.lit(p.min_run - p.window + 1)
    leaked = ((F.col("n_matched") >= F.least(need, F.col("n_windows")))
              | ((F.col("templates") > 0) & (F.col("n_templates") >= F.least(need, F.col("templates")))))
    return (matched.join(all_windows, "item_id").where(leaked)
            .select("doc_id", "item_id", "n_windows", "n_matched",
                    (F.col("n_matched") / F.col("n_windows")).alias("coverage"), "n_slots", "reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the rows into which an item leaked. Rows of both tables count one by one, whatever their id."""
    rows = with_row_keys(docs, "leak-rows")
    items = benchmark.select(F.monotonically_increasing_id().alias("item_id"), "text")  # used once, in a written table
    found = leaks(rows.select(F.col(ROW_KEY).alias("doc_id"), "text"), items, p).select(F.col("doc_id").alias(ROW_KEY))
    return without_ids(rows, found, ROW_KEY).select(*[F.col(f"`{c}`") for c in docs.columns])
