"""R3, approximate: vectors in the cells of a coarse quantiser, of which a query probes the nearest few.

The quantiser (spherical k-means) is fitted on a bounded sample; every vector is stored with its cell, in the order of the
cells. Queries meet the vectors of their probed cells by an equality join: both sides are dealt by cell, a large cell in
slices and many queries of one cell in groups, and each pair is a matrix product in a task from which k rows a query leave.
How many cells must be probed for a wanted recall is measured on a bounded sample against the exact search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.scale import shared_folder
from passageworks.operators.retrieval import SCORE_DIGITS, dense_topk
from passageworks.operators.topk import rank_topk

SAMPLE = 50_000        # vectors that the quantiser is fitted on, at most
TRIALS = 200           # vectors whose exact neighbours set the number of probes
SLICE, GROUP = 16_384, 1024  # vectors of a cell, and queries of a cell, that one group holds, about


@dataclass
class VectorIndex:
    """``vectors(<by>, embedding, cell)``, stored in the order of ``cell``; ``centroids`` is a (cells x dims) matrix of unit rows."""

    vectors: DataFrame
    centroids: np.ndarray
    by: str


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def _matrix(column, dims: int) -> np.ndarray:
    return _unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims))


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors of ``dims`` finite components; the others can't be compared and take no part."""
    ok = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce((F.size("embedding") == dims) & ok, F.lit(False)))


def fit_cells(vectors: DataFrame, cells: int, dims: int = 64, by: str = "vec_id", sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, from the ``sample`` vectors of smallest hash of their id."""
    rows = usable(vectors, dims).select(F.xxhash64(by, F.lit(7)).alias("h"), "embedding").orderBy("h", "embedding").limit(sample).collect()  # a sample of fixed size
    x = _unit(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dims))
    c = x[:cells].copy()
    for _ in range(rounds):
        to = np.concatenate([(x[a:a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(c) else np.empty(0, int)
        total = np.zeros_like(c)
        np.add.at(total, to, x)
        c = np.where(np.bincount(to, minlength=len(c))[:, None] > 0, _unit(total), c)
    return c


def build(vectors: DataFrame, cells: int, dims: int = 64, by: str = "vec_id", sample: int = SAMPLE) -> VectorIndex:
    """Fit the cells and store every usable vector with its cell. The centroids (cells x dims numbers) go to all tasks."""
    spark = vectors.sparkSession
    c = fit_cells(vectors, cells, dims, by, sample)
    shared = spark.sparkContext.broadcast(c)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = (_matrix(b.column(1), dims) @ shared.value.T).argmax(axis=1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], [by, "embedding", "cell"])

    own = usable(vectors, dims).select(by, "embedding")
    placed = own.mapInArrow(place, T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())]))
    path = f"{shared_folder(spark)}/vector-index-{uuid4().hex}"
    placed.repartitionByRange("cell", F.xxhash64(by)).sortWithinPartitions("cell").write.parquet(path)
    return VectorIndex(spark.read.schema(placed.schema).parquet(path), c, by)


def probed(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """``(query_id, embedding, place, cell)``: the ``probes`` cells nearest to each query, nearest first."""
    dims = index.centroids.shape[1]
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    own = usable(queries, dims).select("query_id", "embedding")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b.column(1), dims) @ shared.value.T
            m = min(probes, s.shape[1])
            cell = np.argsort(-s, axis=1, kind="stable")[:, :m]
            at = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.tile(np.arange(m), b.num_rows), pa.int32()), pa.array(cell.reshape(-1), pa.int32())],
                                             ["query_id", "embedding", "place", "cell"])

    return own.mapInArrow(near, T.StructType([*own.schema.fields, T.StructField("place", T.IntegerType()), T.StructField("cell", T.IntegerType())]))


def search(queries: DataFrame, index: VectorIndex, probes: int, k: int = 20) -> DataFrame:
    """``query_id, <by>, score, rank``: the k best by cosine among the vectors of the probed cells, ties by id. With as many probes as
    cells the result is the exact one. Queries that are no usable vectors have no rows."""
    by, dims = index.by, index.centroids.shape[1]
    cells = max(1, len(index.centroids))
    q = probed(queries, index, probes)
    # one row a cell on both sides, as maps of at most as many entries as there are cells
    counts = lambda df, size: {r["cell"]: -(-r["n"] // size) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    slices, groups = counts(index.vectors, SLICE), counts(q, GROUP)
    number = lambda m: F.coalesce(F.element_at(F.array(*[F.lit(m.get(i, 1)) for i in range(cells)]), F.col("cell") + 1), F.lit(1))
    deal = lambda c, m: F.pmod(F.xxhash64(c), number(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), number(m) - 1))
    left = q.withColumn("g", deal("query_id", groups)).withColumn("s", every(slices))
    right = index.vectors.withColumn("s", deal(by, slices)).withColumn("g", every(groups))
    schema = T.StructType([queries.schema["query_id"], index.vectors.schema[by], T.StructField("score", T.DoubleType())])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": a["query_id"].iloc[:0], by: b[by].iloc[:0], "score": np.empty(0)})
        if not len(a) or not len(b):
            return none
        x, y = (_unit(np.stack(t["embedding"].to_numpy()).astype(np.float64)) for t in (a, b))
        s = np.round(x @ y.T, SCORE_DIGITS)
        least = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else -np.inf
        i, j = np.nonzero(s >= least)
        out = pd.DataFrame({"query_id": a["query_id"].to_numpy()[i], by: b[by].to_numpy()[j], "score": s[i, j]})
        out = out.sort_values(["query_id", "score", by], ascending=[True, False, True])
        return out[out.groupby("query_id").cumcount() < k]  # ties are settled by id here already

    found = left.groupBy("cell", "g", "s").cogroup(right.groupBy("cell", "g", "s")).applyInPandas(meet, schema)
    return rank_topk(found, ["query_id"], [F.desc("score"), F.asc(by)], k)


def probes_for(index: VectorIndex, recall: float, k: int = 20, trials: int = TRIALS) -> int:
    """The least number of probes that finds the wanted share of the exact k neighbours of ``trials`` stored
    vectors (those of smallest hash), each against all vectors."""
    by = index.by
    sample = index.vectors.orderBy(F.xxhash64(by, F.lit(11)), by).limit(trials).select(F.col(by).alias("query_id"), "embedding")
    spark = sample.sparkSession
    sample = spark.createDataFrame(sample.collect(), sample.schema)  # of fixed size
    truth = dense_topk(sample, index.vectors.select(by, "embedding"), k, by=by, dims=index.centroids.shape[1])
    at = truth.join(index.vectors.select(by, "cell"), by).join(probed(sample, index, len(index.centroids)).select("query_id", "cell", "place"), ["query_id", "cell"])
    rows = at.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # one row a cell
    total, seen = sum(r["n"] for r in rows), 0
    for r in rows:
        seen += r["n"]
        if seen >= recall * total:
            return r["place"] + 1
    return max(1, len(index.centroids))


def recall(found: DataFrame, truth: DataFrame, by: str = "vec_id") -> DataFrame:
    """``queries, wanted, found``: how many of the true rows of all queries were found."""
    t = truth.select("query_id", by)
    hit = t.join(found.select("query_id", by, F.lit(1).alias("hit")), ["query_id", by], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
