"""Best rows per key in two stages, and the task-local selection used by the scorers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# Queries and rows of one product, and candidates whose scores are computed at once.
TILE_QUERIES, TILE_ROWS, TILE_HITS = 512, 4096, 1 << 16


def rank_topk(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """``row_number() <= k`` per key. Spark cuts each map task's rows to k per key before the exchange."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col(name) <= k)


class LocalBest:
    """The k best (score, id) of every query seen by one task: at most k * queries entries."""

    def __init__(self, n_queries: int, k: int, merge: bool = False) -> None:
        """``merge``: an id may come again, its highest score counts."""
        self.k, self.merge = k, merge
        self.best: list[list[tuple[float, object]]] = [[] for _ in range(n_queries)]

    def add(self, ids: np.ndarray, scores: np.ndarray, positive_only: bool = True) -> None:
        """``scores`` is (rows, queries)."""
        k = self.k
        for q in range(scores.shape[1]):
            col = scores[:, q]
            held = self.best[q]
            floor = held[-1][0] if len(held) == k else -np.inf
            keep = np.flatnonzero((col > 0) & (col >= floor)) if positive_only else np.flatnonzero(col >= floor)
            if len(keep) > k:
                # Every row that reaches the k-th best score stays, so ties are settled by id.
                cut = np.partition(col[keep], len(keep) - k)[len(keep) - k]
                keep = keep[col[keep] >= cut]
            if len(keep):
                both = held + [(float(col[i]), ids[i]) for i in keep]
                if self.merge:
                    top: dict = {}
                    for score, i in both:
                        top[i] = max(score, top.get(i, score))
                    both = [(score, i) for i, score in top.items()]
                self.best[q] = heapq.nsmallest(k, both, key=lambda e: (-e[0], e[1]))

    def batch(self, query_ids: list, names: tuple[str, str, str], types: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
        qs, ids, sc = [], [], []
        for q, held in enumerate(self.best):
            for s, i in held:
                qs.append(query_ids[q])
                ids.append(i)
                sc.append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(qs, types[0]), pa.array(ids, types[1]), pa.array(sc, types[2])], names=list(names)
        )


class NearestVectors:
    """The k best (score, id) of every query seen by one task, by cosine of unit vectors: (queries x k) arrays.

    A product in single precision leaves out what lies below a query's k-th score by more than its error; the scores
    of the rest are computed in double precision."""

    def __init__(self, queries: np.ndarray, k: int, digits: int, merge: bool = False) -> None:
        """``merge``: an id may come again, its highest score counts."""
        self.q, self.q32, self.k, self.digits, self.merge = queries, queries.astype(np.float32), k, digits, merge
        self.margin = 2 * (queries.shape[1] + 4) * float(np.finfo(np.float32).eps) + 2 * 10.0 ** -digits
        self.score = np.full((len(queries), k), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """``x`` has a unit vector a row, at most ``TILE_ROWS``; one that isn't finite is near to none."""
        ok = np.isfinite(x).all(axis=1)
        ids, x = self._unlike(ids[ok], np.ascontiguousarray(x[ok]))
        if not len(ids):
            return
        if self.ids is None:
            self.ids = np.empty(self.score.shape, ids.dtype)
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if self.merge else np.arange(len(ids))
        x32 = x.astype(np.float32).T
        for a in range(0, len(self.q), TILE_QUERIES):
            s = self.q32[a:a + TILE_QUERIES] @ x32
            least = self.score[a:a + TILE_QUERIES, -1] - self.margin
            few = np.flatnonzero(np.isneginf(least))
            if len(few):  # without k rows yet: no id but the k best of these, none but with its best row
                top = s[few]
                if self.merge:
                    top = np.maximum.reduceat(top, first, axis=1)
                    below = s[few] < np.repeat(top, np.diff(np.r_[first, len(ids)]), axis=1) - self.margin
                    s[few] = np.where(below, np.nan, s[few])
                if top.shape[1] > self.k:
                    least[few] = np.partition(top, -self.k, axis=1)[:, -self.k] - self.margin
            i, j = np.divmod(np.flatnonzero(s >= least[:, None]), len(ids))
            for b in range(0, len(i), TILE_HITS):
                who, row = i[b:b + TILE_HITS], j[b:b + TILE_HITS]
                self._put(a, who, ids[row], np.round(np.einsum("ij,ij->i", self.q[a + who], x[row]), self.digits))

    def _unlike(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows by id. Of equal vectors only the k smallest ids can be among the best."""
        same = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1] if len(x) else np.empty(0, np.int64)
        o = np.lexsort((ids, same))
        if self.merge and len(o):
            o = o[np.r_[True, (ids[o][1:] != ids[o][:-1]) | (same[o][1:] != same[o][:-1])]]
        o = o[_place(same[o]) < self.k]
        o = o[np.argsort(ids[o], kind="stable")]
        return ids[o], x[o]

    def _put(self, a: int, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(who)
        held = self.score[a + touched].ravel()
        on = held > -np.inf
        who = np.r_[np.repeat(touched, self.k)[on], who]
        ids, score = np.r_[self.ids[a + touched].ravel()[on], ids], np.r_[held[on], score]
        if self.merge:
            o = np.lexsort((-score, ids, who))
            o = o[np.r_[True, (who[o][1:] != who[o][:-1]) | (ids[o][1:] != ids[o][:-1])]]
            who, ids, score = who[o], ids[o], score[o]
        o = np.lexsort((ids, -score, who))
        place = _place(who[o])
        o, place = o[place < self.k], place[place < self.k]
        self.score[a + touched] = -np.inf
        self.score[a + who[o], place], self.ids[a + who[o], place] = score[o], ids[o]

    def batch(self, query_ids: list, names: tuple[str, str, str], types: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
        who, place = np.nonzero(self.score > -np.inf)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids, types[0]).take(pa.array(who)), pa.array(self.ids[who, place], types[1]),
                                              pa.array(self.score[who, place], types[2])], names=list(names))


def _place(group: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal entries, from 0."""
    if not len(group):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
