"""Operator 4: nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into blocks, and every query block meets every candidate block once.
In a tile, unit vectors are quantised to int8 with one scale per vector. The integer product gives each
cosine up to an error bound from the quantisation residuals; for each query the pairs whose upper bound
reaches the k-th best lower bound survive, are computed again in double precision from the
original vectors, and go into a heap of k. Heaps of the tiles are merged by query.

Equal candidate vectors have equal scores, so only the k + 1 smallest ids of each vector can be
needed (one may be the query itself); they are found by a partial aggregate before the join. The
search is exact. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
without an id. Vectors of different sizes are never compared. Repeated rows count once; of several vectors under one
vec_id the smallest, component by component, stands for it. Equal scores go by the smaller vec_id. An empty table, or
one without a query, gives no rows; further columns are not read. ``is_query`` may name ``vec_id`` only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Params:
    k: int = 5
    query_block: int = 1024
    candidate_block: int = 4096


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, as double arrays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    return (rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(finite & nonzero))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and residual norm of unit rows."""
    scale = np.abs(x).max(1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and rows times the power of two that brings their largest component into [0.5, 1):
    exact, so that products neither overflow nor vanish."""
    y = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return y / np.linalg.norm(y, axis=1, keepdims=True), y


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision of rows scaled by ``unit``."""
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def tile(qid: np.ndarray, q: np.ndarray, cids: list[np.ndarray], c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best (score, smaller id first) of each query among the candidates of one tile."""
    qu, qy = unit(q)
    cu, cy = unit(c)
    (qc, qs, qr), (cc, cs, cr) = quantise(qu), quantise(cu)
    dot = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds the integer products exactly
    near = (qc.astype(dot) @ cc.astype(dot).T).astype(np.float64) * qs[:, None] * cs[None, :]
    # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, with |c| = 1 and |q'| <= 1 + |q - q'|
    error = qr[:, None] + (1 + qr)[:, None] * cr[None, :] + 1e-12
    out: list[tuple[int, int, float]] = []
    for i in range(len(qid)):
        low = near[i] - error[i]
        few = min(k + 1, len(low))  # the query itself may be among them
        bar = np.partition(low, len(low) - few)[len(low) - few]
        alive = np.flatnonzero(near[i] + error[i] >= bar)
        score = cosines(np.broadcast_to(qy[i], (len(alive), q.shape[1])), cy[alive])
        best: list[tuple[float, int]] = []
        for j in np.lexsort((alive, -score)):
            x = float(score[j])
            if len(best) == k and x < best[0][0]:
                break
            for other in cids[alive[j]]:
                if other != qid[i]:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (x, -int(other)))
        out += [(int(qid[i]), -other, x) for x, other in best]
    return out


def search(rows: DataFrame, is_query, p: Params = Params()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest others of each row for which ``is_query`` holds."""
    all_rows = stage(usable(rows).groupBy("vec_id").agg(F.min("v").alias("v")), "nearest-rows")
    distinct = stage(_smallest_ids(all_rows, p.k + 1), "nearest-candidates")
    queries = all_rows.where(is_query)
    n_q, n_c = queries.count(), distinct.count()
    q_blocks, c_blocks = max(1, -(-n_q // p.query_block)), max(1, -(-n_c // p.candidate_block))
    q = (queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
         .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))
    c = (distinct.withColumn("cb", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(c_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))
    k = p.k

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            sizes = right["v"].map(len).to_numpy()
            for d in np.unique(left["v"].map(len).to_numpy()):
                a, b = left[left["v"].map(len) == d], right[sizes == d]
                if len(b):
                    out += tile(a["vec_id"].to_numpy(), np.stack(a["v"].to_list()), [np.asarray(x) for x in b["ids"]],
                                np.stack(b["v"].to_list()), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(join, FOUND)

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by query: one heap of k per query."""
        current, best = None, []

        def rows_of() -> pd.DataFrame:
            top = sorted(best, key=lambda x: (-x[0], -x[1]))
            return pd.DataFrame({"query_id": current, "rank": range(1, len(top) + 1), "vec_id": [-x[1] for x in top],
                                 "score": [x[0] for x in top]})

        done: list[pd.DataFrame] = []
        for pdf in parts:
            for qid, vid, x in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                if qid != current:
                    if current is not None:
                        done.append(rows_of())
                    current, best = qid, []
                (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (x, -vid))
            if done:
                yield pd.concat(done)
                done = []
        if current is not None:
            yield rows_of()

    return (found.repartition("query_id").sortWithinPartitions("query_id")
            .mapInPandas(merge, "query_id long, rank int, vec_id long, score double"))


def _smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """``v, ids``: the n smallest ids of each distinct vector, by a partial aggregate."""
    part = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, n)
    some = part.groupBy("v", "salt").agg(ids.alias("some"))
    return some.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, n).alias("ids"))
