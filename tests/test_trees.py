"""Tree ensembles: brute-force trees, growth rules, exchanges between tasks, attribution by coalitions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltab.operators import ensembles as E
from labeltab.operators import explain as EX
from labeltab.operators import trees as T
from labeltab.plans import catalog as C
from labeltab.plans import fixtures as X
from tests.conftest import SF_SMALL


def cells(seed=0, n=300, k=3):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, [9, 5, 4], (n, 3))
    label = (bins[:, 0] // 3 + (rng.random(n) < 0.2)) % k
    both = np.unique(np.concatenate([bins, label[:, None]], 1), axis=0)
    return both[:, :3], both[:, 3], rng.integers(1, 9, len(both)).astype(float)


def ensemble(steps, k, base):
    rows = [(s, t, v) for s, _, made in steps for t, v in made]
    feature, at, left, right, cover, value, root = [], [], [], [], [], [], []
    for _, t, v in rows:
        o = len(feature)
        root.append(o)
        feature += t.feature
        at += t.bin
        left += [x + o for x in t.left]
        right += [x + o for x in t.right]
        cover += t.cover
        value += list(v)
    return T.Trees(np.array(feature), np.array(at, float), np.array(left), np.array(right), np.array(cover), np.array(value).reshape(-1, k),
                   np.array(root), base, True)


def brute_split(bins, g, h, w, rows, n_bins, l2, min_rows):
    """Best (gain, feature, bin) of a node by trying every split with plain sums."""
    def score(r):
        return sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + l2)

    best = (0.0, None, None)
    for f in range(bins.shape[1]):
        for b in range(n_bins[f] - 1):
            lo, hi = [i for i in rows if bins[i, f] <= b], [i for i in rows if bins[i, f] > b]
            if sum(w[i] for i in lo) < max(min_rows, 1e-9) or sum(w[i] for i in hi) < max(min_rows, 1e-9):
                continue
            gain = score(lo) + score(hi) - score(rows)
            if gain > best[0] + 1e-9:
                best = (gain, f, b)
    return best


def brute_tree(bins, g, h, w, n_bins, p):
    """Nodes of one tree as {path: (feature, bin)} by best-leaf-first or level-wise growth."""
    best = {"": brute_split(bins, g, h, w, list(range(len(bins))), n_bins, p.l2, p.min_rows)}
    rows, out, leaves = {"": list(range(len(bins)))}, {}, [""]
    while leaves and (p.growth == "level" or len(leaves) < p.leaves):
        open_ = [x for x in leaves if best[x][1] is not None and (p.growth == "leaf" or len(x) < p.depth)]
        if not open_:
            break
        x = max(open_, key=lambda y: best[y][0])
        _, f, b = best[x]
        out[x] = (f, b)
        leaves.remove(x)
        for side, part in (("L", [i for i in rows[x] if bins[i, f] <= b]), ("R", [i for i in rows[x] if bins[i, f] > b])):
            rows[x + side] = part
            best[x + side] = brute_split(bins, g, h, w, part, n_bins, p.l2, p.min_rows)
            leaves.append(x + side)
    return out


def shape(t):
    out = {}

    def walk(node, path):
        if t.feature[node] >= 0:
            out[path] = (t.feature[node], t.bin[node])
            walk(t.left[node], path + "L")
            walk(t.right[node], path + "R")

    walk(0, "")
    return out


@pytest.mark.parametrize("p", [E.Boosting(1, "leaf", leaves=7, min_rows=3), E.Boosting(1, "level", depth=3, l2=1.0, min_rows=2),
                               E.Boosting(1, "leaf", leaves=31)])
def test_first_trees_match_brute_force(p):
    bins, label, w = cells()
    n_bins, k = [9, 5, 4], 3
    base = np.zeros(k)
    (_, loss, made), = E.boost(bins, label, w, k, n_bins, p, 0, np.tile(base, (len(bins), 1)), lambda x: x)
    assert abs(loss - math.log(k)) < 1e-12
    for t, value in made:
        g = (1 / k - (label == t.cls)) * w
        h = np.full(len(w), (1 / k) * (1 - 1 / k)) * w
        assert shape(t) == brute_tree(bins, g, h, w, n_bins, p)
        for node in range(len(t.feature)):
            rows = t.at == node
            if t.feature[node] < 0 and rows.any():
                assert abs(value[node, t.cls] + p.rate * g[rows].sum() / (h[rows].sum() + p.l2)) < 1e-12
                assert t.cover[node] == w[rows].sum()


def test_symmetric_split_is_best_for_all_nodes():
    bins, label, w = cells(3)
    p = E.Boosting(1, "symmetric", depth=2, l2=3.0, min_hessian=0.0)
    (_, _, ((t, _),)), = E.boost(bins, label, w, 3, [9, 5, 4], p, 0, np.zeros((len(bins), 3)), lambda x: x)
    g = (1 / 3 - np.eye(3)[label]) * w[:, None]
    h = np.full((len(w), 3), 2 / 9) * w[:, None]

    def gain(rows, f, b):
        lo = rows & (bins[:, f] <= b)
        parts = [(g[r].sum(0) ** 2 / (h[r].sum(0) + 3)).sum() for r in (lo, rows & ~lo, rows)]
        return parts[0] + parts[1] - parts[2] if lo.any() and (rows & ~lo).any() else 0.0

    every = [(f, b) for f, n in enumerate([9, 5, 4]) for b in range(n - 1)]
    nodes = [np.ones(len(w), bool)]
    for path in ("", "L"):
        want = max(every, key=lambda s: sum(gain(r, *s) for r in nodes))
        assert shape(t)[path] == want
        f, b = want
        nodes = [part for r in nodes for part in (r & (bins[:, f] <= b), r & (bins[:, f] > b))]
    assert shape(t)["L"] == shape(t)["R"]


@pytest.mark.parametrize("growth", ["leaf", "level", "symmetric"])
def test_loss_falls_and_jobs_continue(growth):
    bins, label, w = cells(1)
    base = np.log(np.array([w[label == c].sum() for c in range(3)]) / w.sum())
    p = E.Boosting(40, growth, depth=3, leaves=9, l2=1.0, rate=0.1, steps_per_job=40)
    start = np.tile(base, (len(bins), 1))
    whole = list(E.boost(bins, label, w, 3, [9, 5, 4], p, 0, start, lambda x: x))
    losses = [s[1] for s in whole]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    first = list(E.boost(bins, label, w, 3, [9, 5, 4], E.replace(p, steps_per_job=15), 0, start, lambda x: x))
    before = ensemble(first, 3, base)
    more = list(E.boost(bins, label, w, 3, [9, 5, 4], p, 15, before.scores(bins.astype(float)), lambda x: x))
    assert [s[0] for s in more] == list(range(15, 40)) and np.allclose([s[1] for s in more], losses[15:], atol=1e-12)


@pytest.mark.parametrize("p", [E.Boosting(6, "leaf", leaves=8), E.Boosting(6, "symmetric", depth=3, l2=1.0, min_hessian=0.0), E.Forest(4, depth=4)])
def test_tasks_agree_with_one_task(spark, p):
    """Cells dealt to four barrier tasks give the ensemble of one task."""
    df = C.d2_written(spark, SF_SMALL, "train")
    one = E.fit(df, X.D2_FEATURES, "cls", 5, p)
    four = E.fit(df, X.D2_FEATURES, "cls", 5, p, cells_per_task=300)
    x = np.array([[q, d / 100, t / 100] for q in range(1, 51) for d in (0, 5, 10) for t in (0, 4, 8)], float)
    assert np.allclose(one.trees.scores(x), four.trees.scores(x), atol=1e-9)
    assert len(one.trees.root) == len(four.trees.root)


def test_forest_trees_are_pure_and_vote():
    bins, label, w = cells(2)
    steps = list(E.grow_forest(bins, label, w, 3, [9, 5, 4], E.Forest(30, trees_per_round=7), 0, lambda x: x))
    assert len(steps) == 30
    for _, _, ((t, value),) in steps:
        drawn = {x: t.cover[x] for x in range(len(t.feature)) if t.feature[x] < 0}
        assert abs(sum(drawn.values()) - t.cover[0]) < 1e-9 and abs(t.cover[0] - w.sum()) < 6 * math.sqrt(w.sum())
        for x in drawn:
            rows = t.at == x
            if len(np.unique(bins[rows], axis=0)) > 1 and drawn[x]:
                assert (t.sums[x] > 0).sum() == 1 or rows.sum() > 0
        assert np.allclose(value[[x for x in drawn if drawn[x]]].sum(1), 1 / 30)
    draws = np.array([E.poisson_rows(np.arange(4000).reshape(-1, 4), np.full(1000, m), 1, 0) for m in (0.5, 9.0, 500.0)])
    assert np.allclose(draws.mean(1), [0.5, 9, 500], rtol=0.06) and np.allclose(draws.var(1), [0.5, 9, 500], rtol=0.15)


def coalition_value(t, x, known, cls):
    """Score with only the features in ``known``: cover-weighted over both branches where unknown."""
    def walk(node):
        f = t.feature[node]
        if f < 0:
            return t.value[node, cls]
        if f in known:
            return walk(t.left[node] if x[f] <= t.threshold[node] else t.right[node])
        parts = [(t.cover[c] / t.cover[node] if t.cover[node] else 0.0) * walk(c) for c in (t.left[node], t.right[node])]
        return sum(parts)

    return t.base[cls] + sum(walk(r) for r in t.root)


@pytest.mark.parametrize("growth", ["leaf", "symmetric"])
@pytest.mark.parametrize("table", [8, 0])
def test_attribution_equals_coalitions(monkeypatch, growth, table):
    monkeypatch.setattr(T, "TABLE", table)
    bins, label, w = cells(4)
    p = E.Boosting(5, growth, depth=4, leaves=12, rate=0.5, l2=1.0)
    base = np.array([0.3, -0.2, 0.1])
    t = ensemble(E.boost(bins, label, w, 3, [9, 5, 4], p, 0, np.tile(base, (len(bins), 1)), lambda x: x), 3, base)
    x = bins[::17].astype(float)
    for cls in range(3):
        phi = t.attributions(x, cls)
        assert np.allclose(phi.sum(1) + t.expected[cls], t.scores(x)[:, cls], atol=1e-9)
        for r in range(0, len(x), 5):
            for i in range(3):
                rest = [j for j in range(3) if j != i]
                want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6
                           * (coalition_value(t, x[r], {*s, i}, cls) - coalition_value(t, x[r], set(s), cls))
                           for n in range(3) for s in combinations(rest, n))
                assert abs(phi[r, i] - want) < 1e-9


def test_spark_forest_scores_and_attribution(spark):
    m = C.fitted(spark, SF_SMALL, "Spark forest")
    test = C.d2_test(spark, SF_SMALL)
    sh = EX.tree_shap(m, test, X.D2_FEATURES, "rid")
    total = F.aggregate("contributions", F.col("base"), lambda a, x: a + x)
    spark_scores = C.ML.predict(m, test, X.D2_SPEC, "f").select("rid", F.array_max("probability").alias("p"))
    r = sh.join(spark_scores, "rid").agg(F.count("*").alias("n"), F.max(F.abs(total - F.col("score"))).alias("a"),
                                         F.max(F.abs(F.col("score") - F.col("p"))).alias("b")).first()
    assert r.n == test.count() and r.a < 1e-9 and r.b < 1e-9


def test_unknown_class_and_bad_features_raise(spark):
    sh = EX.tree_shap(C.fitted(spark, SF_SMALL, "Spark forest"), C.d2_test(spark, SF_SMALL), X.D2_FEATURES, "rid")
    with pytest.raises(ValueError, match="not found"):
        EX.class_attributions(sh, ["0", "1", "2", "3", "4"], "rice")
    assert EX.class_attributions(sh, ["0", "1", "2", "3", "4"], "3").where("predicted <> 3").count() == 0
    bad = spark.createDataFrame([("a", 1.0, float("nan"), 0.0, 0)], "rid string, l_quantity double, l_discount double, l_tax double, cls int")
    with pytest.raises(Exception, match="finite"):
        E.fit(bad, X.D2_FEATURES, "cls", 5, E.Boosting(1, "level"))
    with pytest.raises(ValueError, match="no training rows"):
        E.fit(bad.where("rid = 'b'"), X.D2_FEATURES, "cls", 5, E.Boosting(1, "level"))
