"""Exact k-means rounds over space-filling-curve zone maps.

Vectors are put in the order of a Hilbert curve and cut into small blocks; each block keeps the box of least and
greatest coordinates of its vectors. Between two centroids only their difference matters, so the coordinates are taken
along an orthonormal basis of the starting centroids' differences (a handful of directions, whatever the width);
what lies outside it is kept as the block's greatest distance from that plane. Every round bounds, for
each block, by how much each centroid can be nearer than the one nearest to the block's middle: over a box the difference of two
squared distances is linear and greatest in a corner. Centroids that can't be nearest to any vector of the
block are out; the others are compared exactly, in integers. Blocks get finer boxes as vectors get more.

Only the k centroids and their sums (k rows) pass through the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.base import stored

BLOCK, CURVE_BITS, RANGE = 64, 4, 1 << 26
SAFE = 1 << 52


def kept_vectors(vectors: DataFrame, width: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x), held within plus and minus 2**26, of the vectors of ``width`` finite components."""
    x = F.transform(vector, lambda e: e.cast("double"))
    ok = F.coalesce((F.size(vector) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda e: F.greatest(F.least(F.floor(e * scale), F.lit(RANGE)), F.lit(-RANGE)).cast("int"))
    return vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def starts(v: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash of their id; of equal ids the smallest vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in v.orderBy(h, "v").limit(k).collect()], np.int64)


def plane(c: np.ndarray) -> np.ndarray:
    """An orthonormal basis (rows) of the differences of the centroids."""
    d = (c[1:] - c[0]).astype(float)
    _, s, basis = np.linalg.svd(d, full_matrices=False) if len(d) else (0, np.empty(0), np.empty((0, c.shape[1])))
    return basis[s > 1e-9 * max(s.max(initial=0), 1)]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits in every coordinate, as rows of bytes that sort like it."""
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    if not n:
        return np.zeros((len(cells), 1), np.uint8)
    for b in range(bits - 1, 0, -1):  # undo the turns and reflections of each finer cube
        low = np.uint32((1 << b) - 1)
        for i in range(n):
            on = (x[i] >> np.uint32(b) & np.uint32(1)).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(on, low, swap).astype(np.uint32)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(b) & np.uint32(1), np.uint32((1 << b) - 1), np.uint32(0)).astype(np.uint32)
    x ^= turn
    planes = np.stack([(x[i] >> np.uint32(b) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1) for i in range(n)], axis=1)
    return np.packbits(planes, axis=1)


def _matrix(column, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def zone_maps(v: DataFrame, width: int, basis: np.ndarray, middle: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``(n, ids, v, low, high, off)``: blocks of vectors next to each other on the curve, with the box of their
    coordinates along ``basis`` around ``middle`` and their greatest distance from its plane."""
    own = v.agg(*[F.stddev_pop(F.col("v")[i]) for i in range(width)], F.count("*")).first()
    spread = max(float(np.sqrt(np.mean([float(x or 0) ** 2 for x in own[:width]]))), 1e-9)
    schema = "place binary, vec_id long, v binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = np.asarray(b.column("v").flatten(), np.int32).reshape(-1, width)
            y = (x - middle) @ basis.T / spread
            # cells of equal chance for a bell curve of about this spread, by a logistic curve
            cells = np.clip((1 << CURVE_BITS) / (1 + np.exp(np.clip(-1.7 * y, -50, 50))), 0, (1 << CURVE_BITS) - 1).astype(np.uint32)
            place = hilbert(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in place], pa.binary()), b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["place", "vec_id", "v"])

    # the second column parts the many rows that one place may have
    ordered = v.mapInArrow(placed, schema).withColumn("deal", F.xxhash64("vec_id", "v"))
    ordered = ordered.repartitionByRange("place", "deal").sortWithinPartitions("place", "deal").drop("deal")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("v"), width, np.int32)
            at = np.arange(0, len(x), block)
            n = np.diff(np.append(at, len(x)))
            y = (x - middle) @ basis.T
            off = np.sqrt(np.maximum(((x - middle) ** 2.0).sum(axis=1) - (y * y).sum(axis=1), 0))
            low, high = (f.reduceat(y, at, axis=0) for f in (np.minimum, np.maximum))
            ids = b.column("vec_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int32()), pa.array([ids.slice(a, k).to_pylist() for a, k in zip(at.tolist(), n.tolist())], pa.list_(pa.int64())),
                 pa.array([x[a:a + k].tobytes() for a, k in zip(at, n)], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary()),
                 pa.array([r.tobytes() for r in high], pa.binary()), pa.array(np.maximum.reduceat(off, at))], ["n", "ids", "v", "low", "high", "off"])

    return ordered.mapInArrow(cut, "n int, ids array<long>, v binary, low binary, high binary, off double")


def candidates(low: np.ndarray, high: np.ndarray, off: np.ndarray, c: np.ndarray, basis: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """For each box the centroids that may be nearest to one of its vectors, as a boolean matrix."""
    e = c - middle
    p = e @ basis.T
    best = ((((low + high) / 2)[:, None, :] - p[None]) ** 2).sum(axis=2).argmin(axis=1)
    square = (e.astype(float) ** 2).sum(axis=1)
    out = np.ones((len(low), len(c)), bool)
    scale = np.maximum(np.abs(low), np.abs(high)).sum(axis=1) + off + np.sqrt(square.max(initial=0))
    for k in range(len(c)):
        w = p[k] - p[best]
        rest = np.sqrt(np.maximum(((e[k] - e[best]) ** 2.0).sum(axis=1) - (w * w).sum(axis=1), 0))
        # |x - best|**2 - |x - k|**2 at most: below zero means that no vector of the box is nearer to k
        gain = square[best] - square[k] + 2 * (np.maximum(low * w, high * w).sum(axis=1) + off * rest)
        out[:, k] = (best == k) | (gain >= -(1e-9 * scale * scale + 1e-3))
    return out


def nearest(x: np.ndarray, n: np.ndarray, may: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of every vector, ties to the smaller number; ``n`` vectors a block, of which
    only the block's candidates are compared."""
    big = 4 * x.shape[1] * (int(np.abs(x).max(initial=0)) + 1) * (int(np.abs(c).max(initial=0)) + 1)
    kind = np.float64 if big < SAFE else np.int64  # both exact
    half, ck = (c.astype(np.int64) ** 2).sum(axis=1).astype(kind), c.astype(kind)
    kinds, of = np.unique(may, axis=0, return_inverse=True)
    of = np.repeat(of.reshape(-1), n)
    out = np.empty(len(x), np.int64)
    for g, row in enumerate(kinds):
        own, ks = np.flatnonzero(of == g), np.flatnonzero(row)
        out[own] = ks[0] if len(ks) == 1 else ks[(half[ks] - 2 * (x[own].astype(kind) @ ck[ks].T)).argmin(axis=1)]
    return out


def assigned(blocks: DataFrame, c: np.ndarray, basis: np.ndarray, middle: np.ndarray, sums: bool) -> DataFrame:
    """With ``sums`` one row a batch and cluster: ``(cluster, n, total, scored, pairs)``, the last two counting the (vector, centroid)
    pairs compared and all; otherwise ``(vec_id, cluster, distance)`` of every vector."""
    width, axes = c.shape[1], len(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n, x = b.column("n").to_numpy(), _matrix(b.column("v"), width, np.int32).astype(np.int64)
            low, high = (_matrix(b.column(f), axes, np.float64) if axes else np.zeros((len(n), 0)) for f in ("low", "high"))
            may = candidates(low, high, b.column("off").to_numpy(), c, basis, middle)
            to = nearest(x, n, may, c)
            if sums:
                o = np.argsort(to, kind="stable")
                ks, at = np.unique(to[o], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ks, pa.int32()), pa.array(np.diff(np.append(at, len(to)))), pa.array(np.add.reduceat(x[o], at, axis=0).tolist(), pa.list_(pa.int64())),
                     pa.array([int((may.sum(axis=1) * n).sum())] + [0] * (len(ks) - 1), pa.int64()), pa.array([len(x) * len(c)] + [0] * (len(ks) - 1), pa.int64())],
                    ["cluster", "n", "total", "scored", "pairs"])
            else:
                d = ((x - c[to]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("ids").flatten(), pa.array(to, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "cluster int, n long, total array<long>, scored long, pairs long" if sums else "vec_id long, cluster int, distance long")


def moved(blocks: DataFrame, c: np.ndarray, basis: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The centroids after one round: floor(sum / count) of each component; empty ones stay. And pairs compared, of all."""
    width = c.shape[1]
    own = assigned(blocks, c, basis, middle, True).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("pairs").alias("pairs"), *[F.sum(F.col("total")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(width)])
    c, scored, pairs = c.copy(), 0, 0
    for r in own.collect():  # at most one row a centroid
        c[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        scored, pairs = scored + r["scored"], pairs + r["pairs"]
    return c, scored, pairs


def cluster(vectors: DataFrame, k: int, rounds: int, width: int, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding",
            block: int = BLOCK, notes: list | None = None) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector that has ``width`` finite
    components, after ``rounds`` rounds and one more assignment.

    Fewer vectors than k make fewer centroids; equal starting vectors stay two centroids, of which the smaller number gets
    the vectors. Repeated rows and rows without an id are vectors of their own. Components beyond 2**26 in size (after
    scaling) count as 2**26, so that distances fit 64 bits; sums of distances beyond that are held at the greatest value.
    Only the id and the vector are read. ``notes`` gets (pairs compared, all pairs) of each round. No vectors: no rows."""
    v = stored(kept_vectors(vectors, width, scale, vec_id, vector), "vectors")
    c = starts(v, k, seed)
    spark = vectors.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], schema)
    basis, middle = plane(c), c.mean(axis=0).round().astype(np.int64)
    blocks = stored(zone_maps(v, width, basis, middle, block), "blocks")
    for _ in range(rounds):
        c, *seen = moved(blocks, c, basis, middle)
        if notes is not None:
            notes.append(tuple(seen))
    out = stored(assigned(blocks, c, basis, middle, False), "assigned")
    held = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    of = lambda f, kind: F.create_map(*[F.lit(x) for j in range(len(c)) for x in (j, f(j))])[F.col("cluster")].cast(kind)
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()
    return out.select("vec_id", "cluster", "distance", of(lambda j: min(held.get(j, 0), most), "long").alias("cluster_inertia"),
                      F.lit(min(sum(held.values()), most)).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))
