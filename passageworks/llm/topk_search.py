"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... segments, each known by its mean and deviation. With segments
of m values, q.c <= sum m * mean_q * mean_c + m * dev_q * dev_c, so a candidate's score is bounded
from above (its distance from below) by a few products. A block of candidates is bounded coarse to
fine; only what may still enter a query's best k is scored exactly, in integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SAFE = float(1 << 52)


def _statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    m = -(-x.shape[1] // segments)
    x = np.pad(x, ((0, 0), (0, m * segments - x.shape[1]))).reshape(len(x), segments, m)
    mean = x.mean(axis=2)
    dev = np.sqrt(np.maximum((x * x).mean(axis=2) - mean * mean, 0))
    return mean, dev, m


def _levels(width: int) -> list[int]:
    out, s = [], 1
    while s < width:
        out.append(s)
        s *= 4
    return out


def best_of_block(q: np.ndarray, c: np.ndarray, c_id: np.ndarray, c_row: np.ndarray, q_row: np.ndarray, k: int, step: int = 2048):
    """For each query row the best k of ``c``: arrays of query index, candidate index, score.

    Candidates are taken ``step`` at a time, those of the largest coarse bound first, so that the
    k-th best score so far rises early; ties are kept, for the smaller id may come later."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    exact = np.float32 if big < 1 << 24 else np.float64 if big < SAFE else np.int64
    kind = np.float32 if exact is np.float32 else np.float64
    stats = [(_statistics(q.astype(kind), s), _statistics(c.astype(kind), s)) for s in _levels(q.shape[1])]
    order = np.argsort(-(stats[0][1][1][:, 0] + np.abs(stats[0][1][0][:, 0])), kind="stable") if stats else np.arange(len(c))
    slack = big * 1e-5 + 1e-3  # above any rounding of the bounds
    qe, ce = q.astype(exact), c.astype(exact)
    floor = np.full(len(q), -np.inf)
    kept_q, kept_c, kept_s = (np.empty(0, np.int64) for _ in range(3))
    for at in range(0, len(order), step):
        own = order[at:at + step]
        alive = np.ones((len(q), len(own)), bool)
        for (mq, dq, m), (mc, dc, _) in stats:
            rows = np.flatnonzero(alive.any(axis=1))
            if not len(rows):
                break
            alive[rows] &= m * (mq[rows] @ mc[own].T + dq[rows] @ dc[own].T) + slack >= floor[rows, None]
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            continue
        score = qe[rows] @ ce[own[cols]].T
        use = alive[np.ix_(rows, cols)] & (q_row[rows, None] != c_row[own[cols]][None, :])
        least = floor[rows]
        if score.shape[1] > k:  # no score below this block's own k-th can matter
            lowest = np.iinfo(np.int64).min if exact is np.int64 else -np.inf
            least = np.maximum(least, np.partition(np.where(use, score, lowest), -k, axis=1)[:, -k])
        a, b = np.nonzero(use & (score >= least[:, None]))
        kept_q = np.concatenate([kept_q, rows[a]])
        kept_c = np.concatenate([kept_c, own[cols[b]]])
        kept_s = np.concatenate([kept_s, score[a, b].astype(np.int64)])
        o = np.lexsort((c_row[kept_c], c_id[kept_c], -kept_s, kept_q))
        kept_q, kept_c, kept_s = kept_q[o], kept_c[o], kept_s[o]
        place = np.arange(len(kept_q)) - np.searchsorted(kept_q, kept_q)
        keep = place < k
        floor[kept_q[place == k - 1]] = kept_s[place == k - 1]
        kept_q, kept_c, kept_s = kept_q[keep], kept_c[keep], kept_s[keep]
    return kept_q, kept_c, kept_s


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``(vec_id, row, v)`` with v = floor(scale * x) in exact integers. Vectors that are null or hold a
    null, NaN or infinite component are left out, as are rows without an id."""
    x = F.transform(vector, lambda e: e.cast("double"))
    # Null-safe: a null element makes forall null, and coalesce false
    ok = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return vectors.where(ok & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"),
        F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def top_k(vectors: DataFrame, k: int, query_every: int, id_col: str = "vec_id", vector: str = "embedding",
          query_block: int = 1024, candidate_block: int = 16384) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products of every query
    (rows whose id is divisible by ``query_every``) over all other rows, ties to the smaller id.

    Queries and candidates are dealt into blocks of about the given sizes, and each pair of blocks
    is one task's work, from which k rows per query leave; block counts follow from one count.
    Vectors of unlike length are compared over zeros. Rows with the same id are rows of their own:
    each is a query, and each may meet the others. No rows: no rows."""
    v = integer_vectors(vectors, id_col, vector)
    n, nq = v.agg(F.count("*"), F.count_if(F.col("vec_id") % query_every == 0)).first()
    spread = v.sparkSession.sparkContext.defaultParallelism
    cb, qb = max(-(-n // candidate_block), min(spread, -(-n // 512)), 1), max(-(-nq // query_block), 1)
    deal = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", "row", F.lit(seed)), F.lit(blocks)).cast("int")
    q = v.where(F.col("vec_id") % query_every == 0).withColumn("qb", deal(qb, 1)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    c = v.withColumn("cb", deal(cb, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))

    def pair(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "row": [], "score": []}).astype("int64")
        width = max(max(map(len, qs["v"])), max(map(len, cs["v"])), 1)
        pad = lambda col: np.array([np.pad(np.asarray(x, np.int64), (0, width - len(x))) for x in col], np.int64).reshape(-1, width)
        a, b, s = best_of_block(pad(qs["v"]), pad(cs["v"]), cs["vec_id"].to_numpy(), cs["row"].to_numpy(), qs["row"].to_numpy(), k)
        return pd.DataFrame({"query_id": qs["vec_id"].to_numpy()[a], "query_row": qs["row"].to_numpy()[a],
                             "vec_id": cs["vec_id"].to_numpy()[b], "row": cs["row"].to_numpy()[b], "score": s})

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(pair, "query_id long, query_row long, vec_id long, row long, score long")
    w = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
