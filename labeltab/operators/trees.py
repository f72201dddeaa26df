"""Flattened tree ensembles: arrays of nodes, scoring and per-row attribution for Arrow batches.

All trees of an ensemble lie in one set of arrays, children given by their position. ``cover`` is
the weight of the training rows in a node, ``value`` one number per class at a leaf. A row goes left
if its feature is at most the threshold.

Attribution (M27) is the path-dependent Shapley value of the ensemble itself, with no background rows. A leaf
counts fully for a feature if the row satisfies the leaf's interval of that feature, else (feature unknown) by the share
of cover that follows its branches. For a leaf whose path holds m features with hits o and shares z,

    phi_i = value (o_i - z_i) Int_0^1 prod_{j != i} (o_j u + z_j (1 - u)) du,

the integral collecting the weights of all subsets of the other features. The integrand is the
path's polynomial without factor i, of degree m - 1, so Gauss-Legendre nodes give it exactly; factors
are left out by products from both ends, never by division. Up to ``TABLE`` features a leaf's values are tabulated
for all hit patterns, so a row costs one look-up a leaf.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = 8
#: rows x leaves looked at together
TILE = 1 << 21
#: largest ensemble that is shipped to the tasks
MODEL_BYTES = 256 << 20

NODES = "tree int, node int, feature int, threshold double, left int, right int, cover double, value array<double>"


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # (nodes, classes)
    root: np.ndarray
    base: np.ndarray  # score of each class before the first tree
    softmax: bool  # scores are margins; False: they are probabilities

    def __post_init__(self):
        size = sum(x.nbytes for x in (self.feature, self.threshold, self.left, self.right, self.cover, self.value))
        if size > MODEL_BYTES:
            raise ValueError(f"the ensemble needs {size} bytes, over the {MODEL_BYTES} that are shipped to tasks")

    def leaves_of(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row in each tree."""
        row = np.arange(len(x))
        for r in self.root:
            at = np.full(len(x), r)
            while True:
                f = self.feature[at]
                if (f < 0).all():
                    break
                down = np.where(x[row, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            yield at

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes) margins or probabilities."""
        out = np.tile(self.base, (len(x), 1))
        for at in self.leaves_of(x):
            out += self.value[at]
        return out

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        if not self.softmax:
            return scores / scores.sum(1, keepdims=True)
        e = np.exp(scores - scores.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @cached_property
    def paths(self) -> list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Leaves grouped by the features on their path: (features, lower, upper, share, leaf)."""
        groups: dict[tuple[int, ...], list] = defaultdict(list)
        for r in self.root.tolist():
            todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(r, {})]
            while todo:
                at, held = todo.pop()
                f = int(self.feature[at])
                if f < 0:
                    groups[tuple(sorted(held))].append((at, held))
                    continue
                lo, hi, z = held.get(f, (-np.inf, np.inf, 1.0))
                t, c = float(self.threshold[at]), self.cover[at]
                for child, span in ((int(self.left[at]), (lo, min(hi, t))), (int(self.right[at]), (max(lo, t), hi))):
                    todo.append((child, {**held, f: (*span, z * (self.cover[child] / c if c > 0 else 0.0))}))
        out = []
        for feats, found in sorted(groups.items()):
            part = np.array([[h[f] for f in feats] for _, h in found], float).reshape(len(found), len(feats), 3)
            out.append((feats, part[:, :, 0], part[:, :, 1], part[:, :, 2], np.array([a for a, _ in found])))
        return out

    @cached_property
    def expected(self) -> np.ndarray:
        """Score of each class with all features unknown."""
        out = self.base.astype(float).copy()
        for _, _, _, z, leaf in self.paths:
            out += z.prod(1) @ self.value[leaf]
        return out

    def attributions(self, x: np.ndarray, cls: int) -> np.ndarray:
        """(rows, features) contributions to the score of one class."""
        phi = np.zeros(x.shape)
        for feats, lo, hi, z, leaf in self.paths:
            m, v = len(feats), self.value[leaf, cls]
            some = np.flatnonzero(v)
            if not m or not len(some):
                continue
            cols = list(feats)
            for a in range(0, len(some), 4096):
                s = some[a: a + 4096]
                table = path_weights(patterns(m)[None], z[s][:, None]) * v[s, None, None] if m <= TABLE else None
                step = max(1, TILE // (len(s) * m))
                for i in range(0, len(x), step):
                    rows = x[i: i + step][:, None, cols]
                    hit = (rows > lo[s]) & (rows <= hi[s])
                    if table is None:
                        phi[i: i + step, cols] += (path_weights(hit.astype(float), z[s][None]) * v[s, None]).sum(1)
                    else:
                        code = hit @ (1 << np.arange(m))
                        phi[i: i + step, cols] += table[np.arange(len(s)), code].sum(1)
        return phi


def patterns(m: int) -> np.ndarray:
    return (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)


def path_weights(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(o_i - z_i) times the integral of the path polynomial without factor i, along the last axis."""
    m = o.shape[-1]
    at, weight = np.polynomial.legendre.leggauss(m // 2 + 1)
    out = 0.0
    for u, w in zip((at + 1) / 2, weight / 2):
        factor = o * u + z * (1 - u)
        one = np.ones((*factor.shape[:-1], 1))
        before = np.cumprod(np.concatenate([one, factor[..., :-1]], -1), -1)
        after = np.cumprod(np.concatenate([one, factor[..., :0:-1]], -1), -1)[..., ::-1]
        out = out + w * before * after
    return (o - z) * out


# ---- ensembles as tables -----------------------------------------------------------------------

def node_table(t: Trees) -> pa.Table:
    """The nodes as an Arrow table of the columns ``NODES``."""
    n, k = t.value.shape
    return pa.table({"tree": pa.array(np.searchsorted(t.root, np.arange(n), "right") - 1, pa.int32()), "node": pa.array(np.arange(n), pa.int32()),
                     "feature": pa.array(t.feature, pa.int32()), "threshold": t.threshold, "left": pa.array(t.left, pa.int32()),
                     "right": pa.array(t.right, pa.int32()), "cover": t.cover,
                     "value": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(t.value.ravel()))})


def from_table(t: pa.Table, base: np.ndarray, softmax: bool) -> Trees:
    """Ensemble from a table of the columns ``NODES``, in any order."""
    t = t.sort_by("node").combine_chunks()
    tree, feature, threshold, left, right, cover = (t.column(c).to_numpy() for c in ("tree", "feature", "threshold", "left", "right", "cover"))
    root = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else np.zeros(0, np.int64)
    value = np.asarray(t.column("value").combine_chunks().flatten()).reshape(len(tree), len(base))
    return Trees(feature.astype(np.int64), threshold, left.astype(np.int64), right.astype(np.int64), cover, value, root, np.asarray(base, float), softmax)


def has_categories(spark: SparkSession, saved: str) -> bool:
    """Whether a saved Spark ML forest splits by sets of categories, which have no threshold."""
    return not spark.read.parquet(f"{saved}/data").where("nodeData.split.numCategories >= 0").isEmpty()


def from_forest(spark: SparkSession, saved: str, votes: bool = False) -> Trees:
    """Ensemble of a saved Spark ML random forest classifier (its node table). ``votes``: the scores are the raw
    predictions of Spark, bit by bit (``probabilities`` divides them by their sum); an empty leaf has none."""
    n = F.col("nodeData")
    rows = (spark.read.parquet(f"{saved}/data").select("treeID", n["id"].alias("id"), n["leftChild"].alias("left"),
                                                        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
                                                        n["split"]["leftCategoriesOrThreshold"].alias("at"), n["impurityStats"].alias("stats"))
            .orderBy("treeID", "id").collect())  # the nodes of one model
    start: dict[int, int] = {}
    for i, r in enumerate(rows):
        start.setdefault(r.treeID, i)
    k, n_trees = len(rows[0].stats), len(start)
    stats = np.array([r.stats for r in rows], float)
    cover = stats.sum(1)
    leaf = np.array([r.left < 0 for r in rows])
    share = stats / (np.where(cover > 0, cover, 1.0) if votes else cover)[:, None]
    value = np.where(leaf[:, None], share if votes else share / n_trees, 0.0)
    at = np.array([start[r.treeID] for r in rows])
    left, right = np.array([r.left for r in rows]), np.array([r.right for r in rows])
    return Trees(np.where(leaf, -1, [r.feature for r in rows]), np.array([r.at[0] if r.at else 0.0 for r in rows]),
                 np.where(leaf, -1, left + at), np.where(leaf, -1, right + at), cover, value,
                 np.array(sorted(start.values())), np.zeros(k), False)


# ---- batches -----------------------------------------------------------------------------------

#: cells whose results a task keeps
KEPT_CELLS = 1 << 16
#: bytes of interventional results that a task keeps, and as many of the coalitions' probabilities
KEPT_BYTES = 32 << 20
#: largest number of cells of an ensemble whose interventional values are worked out by cell
CELLS = 1 << 20


class ByCell:
    """``work`` on rows of finite features, once for each cell of an ensemble's thresholds: a tree compares features with
    thresholds only, so all rows between the same thresholds take the same way in every tree. Up to ``most`` results are kept for
    the next batches of a task; rows of other cells are worked out each time. ``columns``: the features that the rows hold, if not all."""

    def __init__(self, t: Trees, n_features: int, work: Callable[[np.ndarray], np.ndarray], columns: Sequence[int] | None = None,
                 most: int = KEPT_CELLS):
        self.work, self.most = work, most
        self.edges = [np.unique(t.threshold[t.feature == f]) for f in (range(n_features) if columns is None else columns)]
        self.coded = math.prod(len(e) + 1 for e in self.edges) < 1 << 63
        self.codes = np.zeros(0, np.int64)
        self.kept: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.coded:
            found, back = np.unique(x, axis=0, return_inverse=True)
            return self.work(found)[back.ravel()]
        code = np.zeros(len(x), np.int64)
        for f, e in enumerate(self.edges):
            code = code * (len(e) + 1) + np.searchsorted(e, x[:, f], "left")
        cells, first, back = np.unique(code, return_index=True, return_inverse=True)
        at = np.searchsorted(self.codes, cells)
        known = np.zeros(len(cells), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == cells[inside]
        made = self.work(x[first[~known]])
        got = np.empty((len(cells), made.shape[1]))
        got[~known] = made
        if known.any():
            got[known] = self.kept[at[known]]
        if len(made) and len(self.codes) + len(made) <= self.most:
            codes = np.concatenate([self.codes, cells[~known]])
            kept = made if self.kept is None else np.concatenate([self.kept, made])
            order = codes.argsort()
            self.codes, self.kept = codes[order], kept[order]
        return got[back]


def matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    return np.stack(cols, 1) if cols else np.zeros((batch.num_rows, 0))


def score_rows(t: Trees, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """``df`` with an array of one number per class for every row: its margins (``score``) or probabilities
    (``probability``). A null or non-finite feature raises (the finite gate Q10 comes first)."""
    feats = list(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = ByCell(t, len(feats), lambda x: t.scores(x) if out == "score" else t.probabilities(t.scores(x)))
        for batch in batches:
            x = matrix(batch, feats)
            if not np.isfinite(x).all():
                raise ValueError("scoring needs finite features")
            got = scored(x)
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, col], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, {out} array<double>")


def attribute_rows(t: Trees, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """``key, predicted, score, base, contributions`` of every row of ``df`` for its predicted class.

    Features must be finite (the finite gate Q10); a null or NaN raises. Ties of the score go to the lower class."""
    feats = list(features)

    def attributed(x: np.ndarray) -> np.ndarray:
        """(rows, 3 + features): class, score, base, contributions."""
        got = t.scores(x)
        cls = got.argmax(1) if len(x) else np.zeros(0, np.int64)
        phi = np.zeros(x.shape)
        for c in np.unique(cls):
            phi[cls == c] = t.attributions(x[cls == c], int(c))
        return np.column_stack([cls, got[np.arange(len(x)), cls], t.expected[cls], phi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell = ByCell(t, len(feats), attributed)
        for batch in batches:
            x = matrix(batch, feats)
            if not np.isfinite(x).all():
                raise ValueError("attribution needs finite features")
            got = by_cell(x)
            phi = got[:, 3:]
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1, dtype=np.int32) * len(feats)), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got[:, 0].astype(np.int32)), pa.array(got[:, 1]), pa.array(got[:, 2]), col], names=[key, "predicted", "score", "base", "contributions"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *feats).mapInArrow(run, f"`{key}` {kind}, predicted int, score double, base double, contributions array<double>")


def n_cells(t: Trees, n_features: int) -> int:
    return math.prod(len(np.unique(t.threshold[t.feature == f])) + 1 for f in range(n_features))


class Coalitions:
    """Interventional sums of a forest's rows, worked out by cell: ``sums(x)`` gives for each row its class, and the sums over the
    background rows of the class's probability with all features of the row, with none, and over all coalitions with the
    coefficients of each feature.

    The probabilities of a coalition depend on the row's features in it alone, so they are worked out once for each cell of those
    features. Terms are added in the order of coalitions and background rows."""

    def __init__(self, t: Trees, n_features: int, background: np.ndarray, coef: dict[int, list[float]]):
        self.t, self.f, self.background, self.coef = t, n_features, background, coef
        self.k, self.full = t.value.shape[1], (1 << n_features) - 1
        self.cols = {m: [i for i in range(n_features) if m >> i & 1] for m in sorted(coef)}
        most = KEPT_BYTES // (8 * len(coef) * len(background) * self.k)
        self.parts = {m: ByCell(t, n_features, lambda x, c=c: self.mixed(x, c), c, most) for m, c in self.cols.items() if m != self.full}
        self.sums = ByCell(t, n_features, self.worked, most=KEPT_BYTES // (8 * (3 + n_features)))

    def probabilities(self, votes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(votes))
        for j in range(self.k):
            total += votes[:, j]
        return votes / np.where(total != 0, total, 1.0)[:, None]

    def mixed(self, x: np.ndarray, cols: list[int]) -> np.ndarray:
        """(rows, background rows x classes) probabilities of the background rows with the features ``cols`` of each row."""
        b = len(self.background)
        out = np.empty((len(x), b * self.k))
        step = max(1, TILE // (b * max(self.f, self.k)))
        for i in range(0, len(x), step):
            part = x[i: i + step]
            rows = np.tile(self.background, (len(part), 1))
            rows[:, cols] = np.repeat(part, b, axis=0)
            out[i: i + step] = self.probabilities(self.t.scores(rows)).reshape(len(part), -1)
        return out

    def worked(self, x: np.ndarray) -> np.ndarray:
        b = len(self.background)
        out = np.zeros((len(x), 3 + self.f))
        step = max(1, TILE // (b * self.k))
        for i in range(0, len(x), step):
            part, to = x[i: i + step], out[i: i + step]
            votes, row = self.t.scores(part), np.arange(len(part))
            cls = votes.argmax(1)
            to[:, 0] = cls
            for m, cols in self.cols.items():
                if m == self.full:
                    p = np.broadcast_to(self.probabilities(votes)[row, cls], (b, len(part)))
                else:
                    p = np.ascontiguousarray(self.parts[m](part[:, cols]).reshape(len(part), b, self.k)[row, :, cls].T)
                used = [(3 + j, w) for j, w in enumerate(self.coef[m]) if w]
                for q in p:
                    if m == self.full:
                        to[:, 1] += q
                    if m == 0:
                        to[:, 2] += q
                    for j, w in used:
                        to[:, j] += w * q
        return out


def coalition_rows(t: Trees, df: DataFrame, features: Sequence[str], key: str, background: list[list[float]],
                   coef: dict[int, list[float]]) -> DataFrame:
    """``key, __c, s_full, s_empty, phi0, phi1, ...`` of every row of ``df``: its class and sums by ``Coalitions``. ``coef`` holds all
    coalitions, the full and the empty one among them. A null or NaN feature raises."""
    feats, names = list(features), [key, "__c", "s_full", "s_empty", *[f"phi{i}" for i in range(len(features))]]
    known = np.array(background, float).reshape(len(background), len(feats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell = Coalitions(t, len(feats), known, coef)
        for batch in batches:
            x = matrix(batch, feats)
            if np.isnan(x).any() or len(x) and np.isnan(known).any():
                raise ValueError("attribution needs features without nulls and NaN")
            got = by_cell.sums(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[:, 0].astype(np.int32)), *[pa.array(c) for c in got[:, 1:].T]], names=names)

    kind = df.schema[key].dataType.simpleString()
    doubles = ", ".join(f"{n} double" for n in names[2:])
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in feats]).mapInArrow(run, f"`{key}` {kind}, __c int, {doubles}")
