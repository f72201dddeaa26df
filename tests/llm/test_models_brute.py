"""The fit of operator 1 and the labelling of operator 10 against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest

from labeltab.llm import language_id, toxicity
from labeltab.llm import textvec as tv


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


def plain_features(text, p):
    words, now = [], b""
    for b in text.encode() + b" ":
        if 65 <= b < 91 or 97 <= b < 123 or b >= 128:
            now += bytes([b])
        elif now:
            words.append(now)
            now = b""
    out = {("word", w) for w in words} | {("stem", k, w[:k]) for w in words for k in p.stems if len(w) > k}
    return out | {("pair", d, words[i], words[i + d]) for d in p.skips for i in range(len(words) - d)}


def plain_ftrl(examples, p):
    docs = {}
    for names, _ in examples:
        for f in names:
            docs[f] = docs.get(f, 0) + 1
    total = len(examples)
    rarity = {f: math.log(total / n) / math.log(total + 1) for f, n in docs.items() if n >= p.min_docs}
    z, n = dict.fromkeys([*rarity, "bias"], 0.0), dict.fromkeys([*rarity, "bias"], 0.0)

    def weight(f):
        l1 = 0.0 if f == "bias" else p.l1
        if abs(z[f]) <= l1:
            return 0.0
        return (math.copysign(l1, z[f]) - z[f]) / ((p.beta + math.sqrt(n[f])) / p.alpha + p.l2)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(total):
            names, y = examples[k]
            x = {f: float(np.float32(rarity[f])) for f in names if f in rarity} | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            share = 1 / (1 + math.exp(-sum(w[f] * x[f] for f in x)))
            for f in x:
                g = (share - y) * x[f] * (p.positive if y else 1.0)
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / p.alpha * w[f]
                n[f] += g * g
    return {f: weight(f) * rarity[f] for f in rarity if weight(f)}, weight("bias")


def texts_of(seed, n):
    rng = random.Random(seed)
    bad, good = ["vileness", "idiotic", "trash", "hateful"], ["garden", "friendly", "letters", "river", "the", "and", "größe"]
    out = []
    for i in range(n):
        words = rng.choices(good, k=rng.randint(0, 12)) + rng.choices(bad, k=i % 3 == 0 and rng.randint(1, 3))
        rng.shuffle(words)
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


@pytest.mark.parametrize("p", [toxicity.Ftrl(), toxicity.Ftrl(l1=0.5, alpha=1.0, epochs=2, min_docs=1, positive=1.0)])
def test_ftrl_equals_plain_loops(p):
    data = texts_of(3, 90) + [("", 0), ("...", 1)]
    buf, off = buffers([t for t, _ in data])
    row, h = toxicity.distinct(*toxicity.features(buf, off, p))
    bounds = tv.row_bounds(row, len(data))
    names = [plain_features(t, p) for t, _ in data]
    assert [len(x) for x in names] == np.diff(bounds).tolist()
    hashes, weights, bias = toxicity.fit([(h[bounds[i]: bounds[i + 1]], y) for i, (_, y) in enumerate(data)], p)
    plain, plain_bias = plain_ftrl([(x, y) for x, (_, y) in zip(names, data)], p)
    assert 0 < len(plain) == len(hashes) and bias == pytest.approx(plain_bias, rel=1e-6)
    assert sorted(weights) == pytest.approx(sorted(plain.values()), rel=1e-6)
    unseen = texts_of(4, 40) + [("", 0), ("new words only", 0)]
    got = toxicity.Scorer(hashes, weights, bias, p)(*buffers([t for t, _ in unseen]))
    want = [1 / (1 + math.exp(-(plain_bias + sum(plain.get(f, 0.0) for f in plain_features(t, p))))) for t, _ in unseen]
    assert got == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("switch", [0.0, 0.7, 4.0, 100.0])
def test_viterbi_equals_all_labellings(switch):
    rng = np.random.default_rng(11)
    sizes = [0, 1, 6, 3, 6, 0, 2, 5, 1]
    bounds = np.append(0, np.cumsum(sizes))
    x = rng.normal(0, 2, (int(bounds[-1]), 3)).astype(np.float32)
    label = language_id.viterbi(x, bounds, switch)
    assert len(label) == len(x)

    def value(scores, path):
        return sum(float(s[k]) for s, k in zip(scores, path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

    for a, b in zip(bounds[:-1], bounds[1:]):
        best = max((value(x[a:b], path) for path in itertools.product(range(3), repeat=int(b - a))), default=0.0)
        assert value(x[a:b], label[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_viterbi_does_not_depend_on_other_texts():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 40, 30)
    bounds = np.append(0, np.cumsum(sizes))
    x = rng.normal(0, 3, (int(bounds[-1]), 4)).astype(np.float32)
    together = language_id.viterbi(x, bounds, 2.0)
    for a, b in zip(bounds[:-1], bounds[1:]):
        alone = language_id.viterbi(x[a:b], np.array([0, b - a]), 2.0)
        assert alone.tolist() == together[a:b].tolist()
