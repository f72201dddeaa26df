"""Near duplicates and repeated strings against brute force; awkward rows; empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from labeltab.llm import near_dup, suffix_dedup, textvec
from labeltab.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_match_brute_force(make_docs, odd_rows):
    rng = random.Random(3)
    rows = list(odd_rows)
    for k in range(3):
        base = " ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(20, 120)))
        rows += [(100 + 50 * k + j, family(rng, base, rng.randrange(0, 6))) for j in range(12)]
    want = brute_links(rows, 3, 85, 100)
    for block in (near_dup.BLOCK, 4):  # the small block takes every bucket through the block rounds
        got = near_dup.link_documents(make_docs(rows), ngram=3, num=85, den=100, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("lead, block", [(1, 16), (4, near_dup.BLOCK), (99, near_dup.BLOCK)])
def test_a_large_group_with_stragglers_matches_brute_force(make_docs, lead, block):
    rng = random.Random(5)
    base = " ".join(f"v{rng.randrange(900)}" for _ in range(150))
    rows = [(j, family(rng, base, rng.choice((0, 1, 2, 3, 4, 7, 9)))) for j in range(200)]  # some link with few or none of the others
    want = brute_links(rows, 3, 85, 100)
    assert len({c for _, c in want.values()}) > 20
    got = near_dup.link_documents(make_docs(rows), ngram=3, num=85, den=100, block=block, lead=lead).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_bands_miss_less_than_asked():
    for s in (0.8, 0.85, 0.9):
        assert (1 - s ** near_dup.ROWS_PER_BAND) ** near_dup.bands_for(s) < near_dup.MISS


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sig = near_dup.signatures(np.concatenate([a, b]), np.array([0, 400, 800]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 90).astype(np.uint64)
    b = np.concatenate([a[:80], rng.integers(0, 2**63, 12).astype(np.uint64)])
    x, y = (np.frombuffer(near_dup.parity_bits(v), np.uint64) for v in (a, b))
    assert int(np.bitwise_count(x ^ y).sum()) <= 22


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (500, 501), (500, 501), (None, 3)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(60))
    assert got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, length):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: x[0]):
        raw = (t or "").encode()
        spans = []
        for k in range(len(raw) - length + 1):
            w = raw[k: k + length]
            if w in seen:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
            seen.add(w)
        left, at = b"", 0
        for a, b in spans:
            left, at = left + raw[at:a], b
        left += raw[at:]
        out[i] = (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("p", [suffix_dedup.Params(), suffix_dedup.Params(hot_batch=2, hot_group=3, longest_run=16, chunk_bytes=500)])
def test_repeated_strings_match_brute_force(make_docs, odd_rows, p):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    line = "".join(rng.choice("xyz ") for _ in range(90))
    rows = [x for x in odd_rows if x[0] != 5 and x[0] != 8] + [(20, "ab" * 400), (21, "é" * 180), (22, "é" * 90)]
    for i in range(40):
        a, b = sorted(rng.sample(range(300), 2))
        rows.append((30 + i, f"{rng.random()} {line} {rng.random()} " + shared[a:b] + f" {rng.random()} " + shared[:a]))
    rows.append((90, rows[-1][1]))
    want = brute_cut(rows, 100)
    got = suffix_dedup.cut_repeats(make_docs(rows), p).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_interval_bounds_are_common_prefixes():
    rng = np.random.default_rng(4)
    x = np.append(rng.integers(1, 4, 400), 0).astype(np.uint16)
    for least in (1, 2, 5, 9):
        order = suffix_dedup.suffix_order(x, least)
        bound = suffix_dedup.interval_bounds(x, order, least)
        text = x.tolist()
        for k in range(1, len(order)):
            a, b = (text[i: i + least] for i in order[k - 1: k + 1])
            if len(a) == least and len(b) == least:
                assert bound[k] == (a != b)


def test_empty_tables(make_docs, spark):
    none = make_docs([(1, "x")]).where("doc_id = 0")
    assert near_dup.link_documents(none).count() == 0
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_word_spans_do_not_cross_rows():
    buf = np.frombuffer(b"abcde f", np.uint8)
    s, e, row = textvec.word_spans(buf, np.array([0, 3, 3, 7]), textvec.NON_SPACE)
    assert list(zip(s, e, row)) == [(0, 3, 0), (3, 5, 2), (6, 7, 2)]
