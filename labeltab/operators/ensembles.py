"""Tree ensembles from histograms: multiclass gradient boosting with softmax loss (M02), random forests.

Rows are cut to bins (at most ``bins`` per feature, by quantiles) and reduced to distinct cells (bin of
each feature, class) with their number of rows, one aggregate with partial sums: a table with few distinct
values shrinks to a bounded number of cells, whatever its length. The cells are dealt to the tasks of one barrier
stage. In each step every task sums gradients and hessians by (class, node, feature, bin) over its cells, the tasks
add up their histograms (``allGather``) and all grow the same trees:

* ``leaf``: the leaf with the largest gain is split first, up to a number of leaves;
* ``level``: all nodes of a level are split, down to a depth, with row and column sampling;
* ``symmetric``: one split for all nodes of a level and all classes; one tree a step, whose leaves hold a value per class.

Under ``leaf`` the children of all open leaves are evaluated together, so a tree needs about as many
exchanges as it has levels; the order of the splits is that of one at a time.

A forest grows ``trees_per_round`` trees side by side, level by level to pure leaves, by the Gini index over
class counts. The bootstrap draws each cell's rows at once: n rows drawn with replacement hold a cell of w rows about
Poisson(w) times, the sum of the Poisson(1) weights of its rows. A node looks at a random choice of features, and
at more of them only if none of these splits it.

A stage trains ``steps_per_job`` steps and its trees go to the shared folder before the next one starts, so a
lost executor costs the steps of one stage (a barrier stage is run again as a whole). What an exchange carries is
bounded by classes x nodes of a level x bins, whatever the number of rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltab.operators import trees as T
from labeltab.session import scratch_path

CELLS_PER_TASK = 1 << 16
#: numbers in one message of an exchange
MESSAGE = 1 << 20
OUT = "step int, cls int, node int, feature int, bin int, left int, right int, cover double, gain double, value array<double>, loss double"


@dataclass(frozen=True)
class Boosting:
    steps: int
    growth: str  # "leaf", "level" or "symmetric"
    rate: float = 0.05
    leaves: int = 31
    depth: int = 6
    l2: float = 0.0
    min_rows: float = 0.0
    min_hessian: float = 1e-3
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 254
    seed: int = 42
    steps_per_job: int = 100


@dataclass(frozen=True)
class Forest:
    trees: int
    depth: int = 40
    min_rows: float = 1.0
    bins: int = 254
    seed: int = 42
    trees_per_round: int = 10
    steps_per_job: int = 100

    @property
    def steps(self) -> int:
        return self.trees


@dataclass
class Tree:
    """One growing tree over the cells: node arrays, and the deepest evaluated node of each cell."""

    at: np.ndarray
    cls: int  # class it scores, -1 for all
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)  # (2, classes): gradient, hessian
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    best: dict[int, tuple[float, int, int]] = field(default_factory=dict)

    def add(self) -> int:
        for x, v in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.cover, 0.0), (self.gain, 0.0)):
            x.append(v)
        self.sums.append(np.zeros(0))
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, gain: float) -> None:
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = self.add(), self.add()

    def descend(self, bins: np.ndarray, nodes: Sequence[int]) -> None:
        """Move the cells of freshly split nodes to the children."""
        n = len(self.feature)
        f, b, moved = np.array(self.feature), np.array(self.bin), np.zeros(n, bool)
        moved[list(nodes)] = True
        rows = np.flatnonzero(moved[self.at])
        here = self.at[rows]
        small = bins[rows, f[here]] <= b[here]
        self.at[rows] = np.where(small, np.array(self.left)[here], np.array(self.right)[here])


class Grower:
    """Histogram sums over all tasks, split search and the three growth rules."""

    def __init__(self, bins: np.ndarray, n_bins: Sequence[int], p: Boosting, reduce: Callable[[np.ndarray], np.ndarray]):
        self.bins, self.p, self.reduce = bins, p, reduce
        self.offset = np.concatenate([[0], np.cumsum(n_bins)])
        self.flat = bins + self.offset[:-1]
        total = int(self.offset[-1])
        self.feature_of = np.repeat(np.arange(len(n_bins)), n_bins)
        self.open = np.ones(total, bool)
        self.open[self.offset[1:] - 1] = False  # nothing lies right of a feature's last bin

    def histograms(self, jobs: list[tuple[Tree, list[int]]], g: np.ndarray, h: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """For each (tree, nodes): (nodes, 2 classes + 1, bins) sums of gradients, hessians and rows."""
        total, out = int(self.offset[-1]), []
        for tree, nodes in jobs:
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            rows = np.flatnonzero(slot[tree.at] >= 0)
            index = (slot[tree.at[rows]][:, None] * total + self.flat[rows]).ravel()
            cls = slice(None) if tree.cls < 0 else slice(tree.cls, tree.cls + 1)
            channels = np.concatenate([g[rows, cls], h[rows, cls], w[rows, None]], 1)
            hist = np.empty((len(nodes), channels.shape[1], total))
            for c in range(channels.shape[1]):
                each = np.repeat(channels[:, c], self.bins.shape[1])
                hist[:, c] = np.bincount(index, each, len(nodes) * total).reshape(len(nodes), total)
            out.append(hist)
        summed = self.reduce(np.concatenate([x.ravel() for x in out]))
        cut = np.cumsum([x.size for x in out])[:-1]
        return [s.reshape(x.shape) for s, x in zip(np.split(summed, cut), out)]

    def gains(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, bins) gain of a split after each bin (0 where not allowed), node sums, node rows."""
        k = (hist.shape[1] - 1) // 2
        run = np.cumsum(hist, 2)
        start = np.concatenate([np.zeros((*run.shape[:2], 1)), run[:, :, self.offset[1:-1] - 1]], 2)
        below = run - start[:, :, self.feature_of]
        whole = hist[:, :, : self.offset[1]].sum(2)  # every row has one bin of the first feature
        above = whole[:, :, None] - below

        def score(x: np.ndarray) -> np.ndarray:
            return (x[:, :k] ** 2 / np.maximum(x[:, k: 2 * k] + self.p.l2, 1e-16)).sum(1)

        gain = score(below) + score(above) - score(whole[:, :, None])
        ok = self.open & (below[:, -1] >= max(self.p.min_rows, 1e-9)) & (above[:, -1] >= max(self.p.min_rows, 1e-9))
        ok &= (below[:, k: 2 * k].sum(1) >= self.p.min_hessian) & (above[:, k: 2 * k].sum(1) >= self.p.min_hessian)
        return np.where(ok, gain, 0.0), whole[:, : 2 * k].reshape(len(whole), 2, k), whole[:, -1]

    def evaluate(self, jobs: list[tuple[Tree, list[int]]], columns: dict[int, np.ndarray], g, h, w) -> None:
        """Sums and best split of the nodes."""
        jobs = [(t, nodes) for t, nodes in jobs if nodes]
        for (tree, nodes), hist in zip(jobs, self.histograms(jobs, g, h, w) if jobs else []):
            gain, sums, rows = self.gains(hist)
            gain = np.where(columns[tree.cls][self.feature_of], gain, 0.0)
            top = gain.argmax(1)
            for i, node in enumerate(nodes):
                tree.sums[node], tree.cover[node] = sums[i], float(rows[i])
                f = int(self.feature_of[top[i]])
                tree.best[node] = (float(gain[i, top[i]]), f, int(top[i] - self.offset[f]))

    def grow(self, g: np.ndarray, h: np.ndarray, w: np.ndarray, step: int) -> list[Tree]:
        n, k = g.shape
        classes = [-1] if self.p.growth == "symmetric" else list(range(k))
        made = [Tree(np.zeros(n, np.int64), c) for c in classes]
        columns = {c: self.columns(step, c) for c in classes}
        for t in made:
            t.add()
        if self.p.growth == "symmetric":
            self.symmetric(made[0], columns[-1], g, h, w)
            return made
        self.evaluate([(t, [0]) for t in made], columns, g, h, w)
        if self.p.growth == "level":
            fringe = {t.cls: [0] for t in made}
            for _ in range(self.p.depth):
                for t in made:
                    split = [x for x in fringe[t.cls] if t.best[x][0] > 1e-12]
                    for x in split:
                        t.split(x, t.best[x][1], t.best[x][2], t.best[x][0])
                    t.descend(self.bins, split)
                    fringe[t.cls] = [y for x in split for y in (t.left[x], t.right[x])]
                self.evaluate([(t, fringe[t.cls]) for t in made], columns, g, h, w)
            return made
        return [self.best_first(t) for t in self.speculate(made, columns, g, h, w)]

    def speculate(self, made: list[Tree], columns: dict[int, np.ndarray], g, h, w) -> list[Tree]:
        """Evaluate the children of all leaves until the order of the splits is known for every tree."""
        while True:
            jobs = []
            for t in made:
                fringe = self.chosen(t)[1]
                for x in fringe:
                    t.split(x, t.best[x][1], t.best[x][2], t.best[x][0])
                t.descend(self.bins, fringe)
                jobs.append((t, [y for x in fringe for y in (t.left[x], t.right[x])]))
            if not any(nodes for _, nodes in jobs):
                return made
            self.evaluate(jobs, columns, g, h, w)

    def chosen(self, t: Tree) -> tuple[list[int], list[int]]:
        """Splits in order of gain as far as the evaluated nodes tell, and the leaves whose children are missing."""
        leaves, order = [0], []
        while len(leaves) < self.p.leaves:
            x = max(leaves, key=lambda y: (t.best[y][0], -y))
            if t.best[x][0] <= 1e-12:
                return order, []
            if t.feature[x] < 0:
                return order, [y for y in leaves if t.feature[y] < 0 and t.best[y][0] > 1e-12]
            leaves.remove(x)
            leaves += [t.left[x], t.right[x]]
            order.append(x)
        return order, []

    def best_first(self, t: Tree) -> Tree:
        """The tree with its chosen splits only."""
        keep = set(self.chosen(t)[0])
        out = Tree(np.zeros(len(t.at), np.int64), t.cls)
        number = {}

        def copy(node: int) -> None:
            new = out.add()
            number[node] = new
            out.sums[new], out.cover[new] = t.sums[node], t.cover[node]
            if node in keep:
                out.feature[new], out.bin[new], out.gain[new] = t.feature[node], t.bin[node], t.gain[node]
                copy(t.left[node])
                out.left[new] = number[t.left[node]]
                copy(t.right[node])
                out.right[new] = number[t.right[node]]

        copy(0)
        up = np.full(len(t.feature), -1)
        for x in range(len(t.feature)):  # parents come before their children
            if x in number:
                up[x] = number[x]
            if t.feature[x] >= 0:
                for y in (t.left[x], t.right[x]):
                    up[y] = up[x]
        for old, new in number.items():
            up[old] = new
        below = {x: up[x] for x in range(len(up))}
        for x in range(len(t.feature)):
            if t.feature[x] >= 0 and x not in keep:
                for y in (t.left[x], t.right[x]):
                    below[y] = below[x]
        out.at = np.array([below[x] for x in range(len(up))])[t.at]
        return out

    def symmetric(self, t: Tree, columns: np.ndarray, g, h, w) -> None:
        nodes = [0]
        for depth in range(self.p.depth + 1):
            gain, sums, rows = self.gains(self.histograms([(t, nodes)], g, h, w)[0])
            for i, x in enumerate(nodes):
                t.sums[x], t.cover[x] = sums[i], float(rows[i])
            total = np.where(columns[self.feature_of], gain.sum(0), 0.0)
            top = int(total.argmax())
            if depth == self.p.depth or total[top] <= 1e-12:
                return
            f = int(self.feature_of[top])
            for i, x in enumerate(nodes):
                t.split(x, f, int(top - self.offset[f]), float(gain[i, top]))
            t.descend(self.bins, nodes)
            nodes = [y for x in nodes for y in (t.left[x], t.right[x])]

    def columns(self, step: int, cls: int) -> np.ndarray:
        """Which features a tree may use."""
        f = self.bins.shape[1]
        keep = np.ones(f, bool)
        if self.p.column_share < 1:
            keep[:] = False
            order = np.random.default_rng([self.p.seed, step, cls + 1]).permutation(f)
            keep[order[: max(1, int(self.p.column_share * f))]] = True
        return keep

    def values(self, t: Tree, k: int) -> np.ndarray:
        """(nodes, classes) step of the margins at each leaf, 0 elsewhere."""
        out = np.zeros((len(t.feature), k))
        for x in range(len(t.feature)):
            if t.feature[x] < 0:
                grad, hess = t.sums[x]
                v = -self.p.rate * grad / np.maximum(hess + self.p.l2, 1e-16)
                out[x, slice(None) if t.cls < 0 else slice(t.cls, t.cls + 1)] = np.where(hess + self.p.l2 > 1e-12, v, 0.0)
        return out


class ForestGrower(Grower):
    """Trees over class counts: channels are the rows of each class, one tree a bootstrap sample."""

    def counts(self, jobs: list[tuple[Tree, list[int], np.ndarray]]) -> list[np.ndarray]:
        """For each (tree, nodes, weights by class): (nodes, classes, bins) summed rows."""
        total, out = int(self.offset[-1]), []
        for tree, nodes, w in jobs:
            slot = np.full(len(tree.feature), -1)
            slot[nodes] = np.arange(len(nodes))
            rows = np.flatnonzero((slot[tree.at] >= 0) & (w[1] > 0))
            k, f = int(w[2]), self.bins.shape[1]
            index = ((slot[tree.at[rows]] * k + w[0][rows])[:, None] * total + self.flat[rows]).ravel()
            out.append(np.bincount(index, np.repeat(w[1][rows], f), len(nodes) * k * total).reshape(len(nodes), k, total))
        summed = self.reduce(np.concatenate([x.ravel() for x in out]))
        cut = np.cumsum([x.size for x in out])[:-1]
        return [s.reshape(x.shape) for s, x in zip(np.split(summed, cut), out)]

    def splits(self, hist: np.ndarray, rng: np.random.Generator) -> list[tuple[float, int, int]]:
        """Best split of each node among its random features: (decrease of the Gini index times rows, feature, bin)."""
        run = np.cumsum(hist, 2)
        start = np.concatenate([np.zeros((*run.shape[:2], 1)), run[:, :, self.offset[1:-1] - 1]], 2)
        below = run - start[:, :, self.feature_of]
        whole = hist[:, :, : self.offset[1]].sum(2)[:, :, None]
        above = whole - below
        n = [x.sum(1) for x in (below, above, whole)]
        score = [(x ** 2).sum(1) / np.maximum(m, 1e-16) for x, m in zip((below, above, whole), n)]
        gain = np.where(self.open & (n[0] >= self.p.min_rows) & (n[1] >= self.p.min_rows), score[0] + score[1] - score[2], 0.0)
        f = len(self.offset) - 1
        tops = np.stack([gain[:, s:e].argmax(1) for s, e in zip(self.offset[:-1], self.offset[1:])], 1)
        best = np.take_along_axis(gain, tops + self.offset[:-1], 1)
        rank = rng.random(best.shape).argsort(1).argsort(1)
        usable = best > 1e-9
        first = np.where(rank < max(1, int(np.sqrt(f))), best, 0.0)
        reserve = np.where(usable, rank, f)
        pick = np.where(first.max(1) > 1e-9, first.argmax(1), reserve.argmin(1))
        return [(float(best[i, j]) if usable[i, j] else 0.0, int(j), int(tops[i, j])) for i, j in enumerate(pick)]

    def grow_many(self, label: np.ndarray, weights: list[np.ndarray], k: int, first: int) -> list[Tree]:
        made = [Tree(np.zeros(len(label), np.int64), -1) for _ in weights]
        rngs = [np.random.default_rng([self.p.seed, first + i, 1]) for i in range(len(made))]
        fringe = [[t.add()] for t in made]
        for depth in range(self.p.depth + 1):
            live = [i for i in range(len(made)) if fringe[i]]
            if not live:
                break
            hists = self.counts([(made[i], fringe[i], (label, weights[i], k)) for i in live])
            for i, hist in zip(live, hists):
                t, split = made[i], []
                found = self.splits(hist, rngs[i])
                rows = hist[:, :, : self.offset[1]].sum(2)
                for node, best, n in zip(fringe[i], found, rows):
                    t.sums[node], t.cover[node] = n, float(n.sum())
                    if depth < self.p.depth and best[0] > 1e-9:
                        t.split(node, best[1], best[2], best[0])
                        split.append(node)
                t.descend(self.bins, split)
                fringe[i] = [y for x in split for y in (t.left[x], t.right[x])]
        return made


def grow_forest(bins: np.ndarray, label: np.ndarray, w: np.ndarray, k: int, n_bins: Sequence[int], p: Forest, first: int,
                reduce: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, float, list[tuple[Tree, np.ndarray]]]]:
    """Trees from number ``first`` on: (number, 0, [tree with class shares at the leaves])."""
    grower = ForestGrower(bins, n_bins, p, reduce)
    cells = np.concatenate([bins, label[:, None]], 1)
    last = min(p.trees, first + p.steps_per_job)
    for at in range(first, last, p.trees_per_round):
        numbers = range(at, min(last, at + p.trees_per_round))
        for i, t in zip(numbers, grower.grow_many(label, [poisson_rows(cells, w, p.seed, i) for i in numbers], k, at)):
            value = np.zeros((len(t.feature), k))
            for x in range(len(t.feature)):
                if t.feature[x] < 0 and t.cover[x] > 0:
                    value[x] = t.sums[x] / t.cover[x] / p.trees
            yield i, 0.0, [(t, value)]


def _cell_hash(cells: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit number of each cell and seed, whatever the task that holds the cell."""
    key = np.full(len(cells), seed & 0xFFFFFFFFFFFF, np.uint64)
    for c in range(cells.shape[1]):
        key = (key ^ cells[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return key


def poisson_rows(cells: np.ndarray, w: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A Poisson(w) draw for each cell from its hash: by inversion up to 64 rows, beyond them by the normal
    quantile with the skewness term."""
    key = _cell_hash(cells, seed * 1_000_003 + tree)
    u = ((key >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    out = np.zeros(len(w))
    few = w <= 64
    term, total, n = np.exp(-w[few]), np.exp(-w[few]), np.zeros(int(few.sum()))
    for i in range(1, 200):
        more = u[few] > total
        if not more.any():
            break
        n += more
        term = term * w[few] / i
        total = total + term
    out[few] = n
    z = np.array([NormalDist().inv_cdf(x) for x in u[~few].tolist()])
    out[~few] = np.maximum(np.floor(w[~few] + np.sqrt(w[~few]) * z + (z * z - 1) / 6 + 0.5), 0)
    return out


def row_sample(cells: np.ndarray, w: np.ndarray, p: Boosting, step: int) -> np.ndarray:
    """Rows kept of each cell: its share, rounded up or down by a hash of cell and step."""
    if p.row_share >= 1:
        return w
    key = _cell_hash(cells, p.seed * 1_000_003 + step)
    return np.floor(p.row_share * w + (key >> np.uint64(11)).astype(float) / (1 << 53))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def boost(bins: np.ndarray, label: np.ndarray, w: np.ndarray, k: int, n_bins: Sequence[int], p: Boosting, first: int,
          scores: np.ndarray, reduce: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, float, list[tuple[Tree, np.ndarray]]]]:
    """Steps from ``first`` on, over the cells of one task: (step, loss before it, trees with values)."""
    grower = Grower(bins, n_bins, p, reduce)
    cells = np.concatenate([bins, label[:, None]], 1)
    hit = np.eye(k)[label]
    row = np.arange(len(label))
    for step in range(first, min(p.steps, first + p.steps_per_job)):
        prob = softmax(scores)
        loss, rows = reduce(np.array([-(w * np.log(np.maximum(prob[row, label], 1e-300))).sum(), w.sum()]))
        kept = row_sample(cells, w, p, step)
        made = [(t, grower.values(t, k)) for t in
                grower.grow((prob - hit) * kept[:, None], prob * (1 - prob) * kept[:, None], kept, step)]
        for t, value in made:
            scores = scores + value[t.at]
        yield step, loss / rows, made


def _job(k: int, n_bins: Sequence[int], p: Boosting | Forest, first: int, base: np.ndarray, before: T.Trees | None
         ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = BarrierTaskContext.get()
        alone = len(ctx.getTaskInfos()) == 1

        def reduce(x: np.ndarray) -> np.ndarray:
            if alone:
                return x
            out = []
            for at in range(0, len(x), MESSAGE):
                parts = ctx.allGather(base64.b64encode(x[at: at + MESSAGE].tobytes()).decode())
                out.append(np.sum([np.frombuffer(base64.b64decode(s), float) for s in parts], axis=0))
            return np.concatenate(out)

        data = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)], 1) for b in batches if b.num_rows]
        cells = np.concatenate(data).astype(np.int64) if data else np.zeros((0, len(n_bins) + 2), np.int64)
        bins, label, w = cells[:, :-2], cells[:, -2], cells[:, -1].astype(float)
        if isinstance(p, Forest):
            steps = grow_forest(bins, label, w, k, n_bins, p, first, reduce)
        else:
            scores = np.tile(base, (len(bins), 1)) if before is None else before.scores(bins.astype(float))
            steps = boost(bins, label, w, k, n_bins, p, first, scores, reduce)
        for step, loss, made in steps:
            if ctx.partitionId():
                continue
            for t, value in made:
                n = len(t.feature)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, step, np.int32)), pa.array(np.full(n, t.cls, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(t.feature, pa.int32()), pa.array(t.bin, pa.int32()), pa.array(t.left, pa.int32()), pa.array(t.right, pa.int32()),
                     pa.array(t.cover, pa.float64()), pa.array(t.gain, pa.float64()), pa.array(list(value), pa.list_(pa.float64())),
                     pa.array(np.full(n, loss))], names=[x.split()[0] for x in OUT.split(", ")])

    return run


@dataclass(frozen=True)
class TreeModel:
    """A fitted ensemble; ``losses`` of the training rows before each boosting step, and the total gain of each
    feature."""

    features: tuple[str, ...]
    trees: T.Trees
    losses: tuple[float, ...]
    gains: tuple[float, ...]
    params: Boosting | Forest


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the bins but the last one: quantile values of each feature, one scan."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    got = df.agg(*[F.percentile_approx(F.col(f).cast("double"), probs, F.lit(20 * bins)).alias(f"q{i}")
                   for i, f in enumerate(features)],
                 *[F.max(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        e = np.unique(np.array(got[f"q{i}"] or [], float))
        out.append(e[e < got[f"m{i}"]] if len(e) else e)
    return out


def cells_of(df: DataFrame, features: Sequence[str], label: str, edges: list[np.ndarray]) -> DataFrame:
    """``b0, b1, ..., label, w``: distinct bin combinations with class and number of rows."""
    names = [f"b{i}" for i in range(len(features))]

    coded = math.prod(len(e) + 1 for e in edges) < 1 << 31  # a cell and its class in one number

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        cell = np.concatenate(held)
        if coded and cell.dtype == np.int64 and len(cell) and 0 <= cell[:, -1].min() and cell[:, -1].max() < 1 << 31:
            code = cell[:, -1]
            for i, e in enumerate(edges):
                code = code * (len(e) + 1) + cell[:, i]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            cell = cell[first]
        else:
            cell, n = np.unique(cell, axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*[pa.array(cell[:, i].astype(np.int32)) for i in range(len(names) + 1)], pa.array(n)],
                                          names=[*names, "label", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            x = T.matrix(batch, features)
            if not np.isfinite(x).all():
                raise ValueError("boosting needs finite features")
            cols = [np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]
            y = batch.column(len(features)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            held.append(np.stack([*cols, y], 1))
            if sum(map(len, held)) >= CELLS_PER_TASK:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    schema = ", ".join([*[f"{n} int" for n in names], "label int", "w long"])
    return (df.select(*features, F.col(label).cast("long").alias("label")).mapInArrow(run, schema)
            .groupBy(*names, "label").agg(F.sum("w").alias("w")))


@dataclass(frozen=True)
class Binned:
    """A training table cut to bins: upper edges of the bins of each feature, and the written cells. Fits of several presets
    or feature subsets of the same rows share it."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    cells: DataFrame

    def only(self, features: Sequence[str]) -> "Binned":
        """The same rows by some of the features."""
        if tuple(features) == self.features:
            return self
        at = [self.features.index(f) for f in features]
        cells = (self.cells.groupBy(*[F.col(f"b{i}").alias(f"b{j}") for j, i in enumerate(at)], "label").agg(F.sum("w").alias("w")))
        return Binned(tuple(features), [self.edges[i] for i in at], _written(cells))


def _written(cells: DataFrame) -> DataFrame:
    path = scratch_path(cells.sparkSession, "boost-cells")
    cells.write.parquet(path)
    return cells.sparkSession.read.parquet(path)


def binned(train: DataFrame, features: Sequence[str], label: str, bins: int) -> Binned:
    """Two scans of the rows: bin edges, cells."""
    edges = bin_edges(train, features, bins)
    return Binned(tuple(features), edges, _written(cells_of(train, list(features), label, edges)))


def _trees(nodes: pa.Table, edges: list[np.ndarray] | None, base: np.ndarray, softmax: bool) -> T.Trees:
    """One ensemble of the nodes of all stages, by step, class and node; thresholds are bin numbers without ``edges``."""
    t = nodes.sort_by([("step", "ascending"), ("cls", "ascending"), ("node", "ascending")]).combine_chunks()
    node, feature, at, left, right, cover = (t.column(c).to_numpy() for c in ("node", "feature", "bin", "left", "right", "cover"))
    first = np.flatnonzero(node == 0)
    start = np.repeat(first, np.diff(np.concatenate([first, [len(node)]])))
    inner = feature >= 0
    threshold = np.where(inner, at, 0).astype(float)
    for f, e in enumerate(edges or []):
        threshold[feature == f] = e[at[feature == f]]
    value = np.asarray(t.column("value").combine_chunks().flatten()).reshape(len(node), len(base))
    return T.Trees(feature.astype(np.int64), threshold, np.where(inner, left + start, -1), np.where(inner, right + start, -1), cover, value, first,
                   base, softmax)


def fit(train: DataFrame, features: Sequence[str], label: str, k: int, p: Boosting | Forest,
        cells_per_task: int = CELLS_PER_TASK) -> TreeModel:
    """Fit on all rows of ``train``; ``label`` holds class codes 0 to k - 1. Null, NaN or infinite features and an
    empty table raise."""
    return fit_binned(binned(train, features, label, p.bins), k, p, cells_per_task)


def fit_binned(rows: Binned, k: int, p: Boosting | Forest, cells_per_task: int = CELLS_PER_TASK) -> TreeModel:
    """``fit`` on rows that are cut to bins already."""
    features, edges, cells = rows.features, rows.edges, rows.cells
    spark = cells.sparkSession
    weight = {r.label: r.w for r in cells.groupBy("label").agg(F.sum("w").alias("w")).collect()}  # one row a class
    if not weight:
        raise ValueError("no training rows")
    total = sum(weight.values())
    margins = isinstance(p, Boosting)
    base = np.log(np.array([max(weight.get(c, 0), 1e-3) / total for c in range(k)])) if margins else np.zeros(k)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-cells.count() // cells_per_task)))
    names = [f"b{i}" for i in range(len(features))]
    n_bins = [len(e) + 1 for e in edges]
    dealt = cells.select(*names, "label", "w").repartition(tasks, *names, "label").sortWithinPartitions(*names, "label")
    nodes: pa.Table | None = None
    for first in range(0, p.steps, p.steps_per_job):
        before = _trees(nodes, None, base, True) if nodes is not None and margins else None
        out = scratch_path(spark, "boost-trees")
        dealt.mapInArrow(_job(k, n_bins, p, first, base, before), OUT, barrier=True).write.parquet(out)
        new = spark.read.parquet(out).toArrow()  # the nodes of the new trees
        nodes = new if nodes is None else pa.concat_tables([nodes, new])
    step, which, gain = (nodes.column(c).to_numpy() for c in ("step", "feature", "gain"))
    loss = dict(zip(step.tolist(), nodes.column("loss").to_pylist()))
    gains = np.bincount(which[which >= 0], gain[which >= 0], len(features))
    return TreeModel(tuple(features), _trees(nodes, edges, base, margins), tuple(loss[s] for s in sorted(loss)) if margins else (),
                        tuple(gains.tolist()), replace(p))
