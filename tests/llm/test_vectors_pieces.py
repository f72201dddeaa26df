"""Nearest neighbours and piece sampling against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltab.llm import nearest, piece_sampling, queries
from labeltab.llm.shared import table
from tests.conftest import SF_SMALL


def brute(rows, k, every):
    v = {i: np.array(x, float) for i, x in rows if i is not None and x is not None and len(x)
         and all(y is not None and math.isfinite(y) for y in x) and any(x)}
    out = {}
    for q in (i for i in v if i % every == 0):
        best = sorted((-float(v[q] @ v[c] / (np.sqrt(v[q] @ v[q]) * np.sqrt(v[c] @ v[c]))), c) for c in v if c != q and len(v[c]) == len(v[q]))
        out[q] = [(c, -s) for s, c in best[:k]]
    return out


def test_nearest_matches_brute_force(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in emb.collect()], 5, 50)
    for p in (nearest.Params(), nearest.Params(query_block=3, candidate_block=40)):
        got = {}
        for r in nearest.search(emb, F.col("vec_id") % 50 == 0, p).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got.keys() == want.keys()
        for q in want:
            assert [c for c, _ in got[q]] == [c for c, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_nearest_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (None, [1.0, 1.0]),
            (7, [1.0, 1.0]), (8, [1e-30, 1e-30]), (9, [1.0, 2.0, 3.0]), (50, [1.0, 0.0, 0.0])] + [(10 + i, [2.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert got[0] == [(i + 1, 10 + i) for i in range(5)] and got[50] == [(1, 9)]
    assert nearest.search(df.where("vec_id = 999"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_of_large_and_small_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 1e-201]), (3, [1e308, 1e308]), (4, [5e-324, 0.0]), (5, [0.0, 1e300]),
            (50, [1e200, 1e200]), (6, [9.0, 9.0]), (6, [0.5, -1.0]), (6, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df.repartition(4), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    c = 1 / math.sqrt(1.01)
    assert got[0][0][0] == 4 and {x for x, _ in got[0][1:3]} == {1, 2} and [x for x, _ in got[0][3:]] == [3, 50] and np.allclose([s for _, s in got[0]], [1, c, c, math.sqrt(.5), math.sqrt(.5)], atol=1e-15)
    assert got[50][0][0] == 3 and len({x for x, _ in got[50]}) == 5
    assert all(x != 6 for x, _ in got[0])  # the smallest vector under id 6 points away


def test_quantisation_error_bound():
    rng = np.random.default_rng(0)
    q, _ = nearest.unit(rng.normal(size=(20, 48)))
    c, _ = nearest.unit(rng.normal(size=(30, 48)))
    (qc, qs, qr), (cc, cs, cr) = nearest.quantise(q), nearest.quantise(c)
    near = (qc.astype(float) @ cc.astype(float).T) * qs[:, None] * cs[None, :]
    assert (np.abs(near - q @ c.T) <= qr[:, None] + (1 + qr)[:, None] * cr[None, :] + 1e-12).all()


# ---- pieces -----------------------------------------------------------------------------------

def segmentations(text, vocabulary):
    """All segmentations of a short ASCII text, with their weights."""
    ids = {x: i for i, x in enumerate(vocabulary.pieces) if x is not None and i not in set(vocabulary.byte_ids.tolist())}
    raw = (" " + text).encode()
    out = []

    def walk(at, path, w):
        if at == len(raw):
            out.append((tuple(path), w))
            return
        for end in range(at + 1, min(len(raw), at + 26) + 1):
            if raw[at:end] in ids:
                walk(end, [*path, ids[raw[at:end]]], w + vocabulary.log_p[ids[raw[at:end]]])

    walk(0, [], 0.0)
    return out


def test_samples_follow_the_lattice(spark):
    v = piece_sampling.Vocabulary.load()
    text = "the cats"
    every = segmentations(text, v)
    z = np.logaddexp.reduce([w for _, w in every])
    p = {path: math.exp(w - z) for path, w in every}
    docs = spark.createDataFrame([(i, text) for i in range(3000)], "doc_id long, text string")
    rows = piece_sampling.sample(docs, piece_sampling.Params(k=3), with_ids=True).collect()
    firsts = Counter(tuple(r.ids) for r in rows if r.sample == 1)
    for path, prob in p.items():
        assert abs(firsts[path] / 3000 - prob) < 0.04
    by = {}
    for r in rows:
        assert r.decoded_ok and abs(r.log_prob - math.log(p[tuple(r.ids)])) < 1e-9
        by.setdefault(r.doc_id, []).append(r)
    seconds = Counter()
    for own in by.values():
        own.sort(key=lambda r: r.sample)
        assert len({tuple(r.ids) for r in own}) == 3  # distinct
        assert own[0].perturbed > own[1].perturbed > own[2].perturbed
        assert all(r.log_inclusion <= 0 for r in own)
        seconds[tuple(own[1].ids)] += 1
    top = max(p, key=p.get)
    want = sum(q * p[top] / (1 - q) for path, q in p.items() if path != top)  # second draw without replacement
    assert abs(seconds[top] / 3000 - want) < 0.04
    # sum of 1 / inclusion over the sample estimates the number of segmentations' mass: weights average to one
    est = np.mean([sum(math.exp(r.log_prob - r.log_inclusion) for r in own) for own in by.values()])
    assert abs(est - 1) < 0.1


def test_samples_do_not_depend_on_partitions_and_round_trip(spark, make_docs, odd_rows):
    rows = list(odd_rows) + [(20, "a  b\n\n\tc ▁x  "), (21, "z" * 3000), (22, "x")]
    a, b = (sorted(map(str, piece_sampling.sample(make_docs(rows).repartition(n)).collect())) for n in (1, 5))
    assert a == b
    got = piece_sampling.sample(make_docs(rows), with_ids=True)
    assert got.where("not decoded_ok").count() == 0
    assert {(r.doc_id, r.n_pieces) for r in got.collect() if r.doc_id in (1, 2)} == {(1, 0), (2, 0)}
    text = {i: t or "" for i, t in rows}
    back = piece_sampling.decode_ids(got.select("doc_id", "ids")).collect()
    assert all(r.text == text[r.doc_id] for r in back)
    assert piece_sampling.sample(make_docs(rows).where("doc_id = 999")).count() == 0


def test_samples_do_not_depend_on_slices_and_held_units(spark, make_docs, odd_rows):
    rows = odd_rows + [(i, f"shared words and own{i} ones, {'ab' * (i % 40)} \u20ac{i}") for i in range(100, 160)]
    docs = make_docs(rows)
    forms = [piece_sampling.Params(), piece_sampling.Params(slice_bytes=64), piece_sampling.Params(slice_bytes=64, held_bytes=0)]
    first, *others = [sorted(map(str, piece_sampling.sample(docs, p, with_ids=True).collect())) for p in forms]
    assert all(x == first for x in others)


def test_model_of_the_library_decodes_the_same(spark, make_docs):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_sampling.MODEL_FILE)
    texts = ["plain words here", "né à Zürich", "漢字 and 😀"]
    for r in piece_sampling.sample(make_docs(list(enumerate(texts))), with_ids=True).collect():
        assert sp.decode(list(r.ids)) == texts[r.doc_id]


def test_every_operator_is_registered_once():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
