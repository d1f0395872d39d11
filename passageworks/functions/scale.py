"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``. A temporary folder is
    made only for a local master that names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, which a lost executor does not take with it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def parts_for(spark: SparkSession, rows: int, each: int = 1 << 20) -> int:
    """Parts of a shuffle of so many rows of a few numbers, so that what a task holds doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def global_rank(df: DataFrame, by: list[str], digest: str, name: str = "rank", total: str = "n") -> DataFrame:
    """Rank in the order of a hex digest, per ``by`` group or over everything, plus group size.

    Rows are ranked inside the first four hex digits of the digest, which are spread evenly
    whatever the group sizes are; the counts of the at most 65,536 prefixes per group give the
    rank of each prefix's first row. No task ever holds a whole group."""
    d = df.withColumn("_p", F.substring(digest, 1, 4)).withColumn("_one", F.lit(1))
    keys = by or ["_one"]
    w = W.partitionBy(*keys)
    counts = d.groupBy(*keys, "_p").agg(F.count("*").alias("_c")).select(
        *keys, "_p",
        F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(w).alias(total))
    local = d.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(digest)))
    return local.join(counts, [*keys, "_p"]).withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_one", "_before", "_r")


#: Bits of a value that each of the three histograms of ``exact_quantiles`` looks at, from the top.
DIGITS = (22, 21, 21)


def _ordered_bits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, ``_v`` and ``_u``: the value's 64 bits as an integer in the order of the values, from -2**63."""
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(len(keys)).to_numpy(zero_copy_only=False) + 0.0  # one zero
            v = np.where(np.isnan(v), np.nan, v)
            u = v.view(np.int64)
            u = np.where(u < 0, u ^ np.int64(0x7FFFFFFFFFFFFFFF), u)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(u)], [*b.schema.names, "_u"])

    return d.mapInArrow(bits, T.StructType([*d.schema.fields, T.StructField("_u", T.LongType())]))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]],
) -> DataFrame:
    """Exact order statistics: ``ranks`` maps a name to (fraction, 1-based rank as a function of n).

    Radix selection: a histogram over the upper bits of all values tells in which of its buckets each wanted rank lies, a
    second one over the next bits of that bucket's values, a third over the last bits. Three aggregations, each combined in the
    tasks that read; what is put in order are the buckets of a histogram (at most 2**22 a group), never the values."""
    keys = by or ["_one"]
    d = _ordered_bits(df if by else df.withColumn("_one", F.lit(1)), keys, value)
    top = F.shiftrightunsigned(F.col("_u").bitwiseXOR(F.lit(-(1 << 63))), DIGITS[1] + DIGITS[2])
    part = lambda shift, n: F.shiftrightunsigned("_u", shift).bitwiseAND(F.lit((1 << n) - 1))
    d = d.select(*keys, "_v", top.alias("_d0"), part(DIGITS[2], DIGITS[1]).alias("_d1"), part(0, DIGITS[2]).alias("_d2"))
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    h = d.groupBy(*keys, "_d0").agg(F.count("*").alias("_c"))
    own = W.partitionBy(*keys)
    h = h.select(*keys, "_d0", "_c", before(own.orderBy("_d0")).alias("_b"), F.sum("_c").over(own).alias("n"))
    want = F.array(*[F.struct(F.lit(name).alias("name"), fn(F.col("n")).cast("bigint").alias("rank")) for name, (_, fn) in ranks.items()])
    at = h.select("*", F.explode(want).alias("w")).where((F.col("w.rank") > F.col("_b")) & (F.col("w.rank") <= F.col("_b") + F.col("_c")))
    at = at.select(*keys, "_d0", F.col("w.name").alias("name"), (F.col("w.rank") - F.col("_b")).alias("rank"))
    found = ["_d0"]
    for digit in ("_d1", "_d2"):
        few = at if by else F.broadcast(at)  # without groups these are len(ranks) rows
        values = F.min("_v").alias("_x") if digit == "_d2" else F.lit(None).alias("_x")
        h = d.join(few, [*keys, *found]).groupBy(*keys, *found, "name", "rank", digit).agg(F.count("*").alias("_c"), values)
        at = h.withColumn("_b", before(W.partitionBy(*keys, "name").orderBy(digit))).where(
            (F.col("rank") > F.col("_b")) & (F.col("rank") <= F.col("_b") + F.col("_c")))
        found.append(digit)
        at = at.select(*keys, *found, "name", (F.col("rank") - F.col("_b")).alias("rank"), "_x") if digit == "_d2" else at.select(*keys, *found, "name", (F.col("rank") - F.col("_b")).alias("rank"))
    return at.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == n, F.col("_x"))).alias(n) for n in ranks]).drop("_one")


def neighbours(df: DataFrame, keys: list[str], order: str, before: str, after: str) -> DataFrame:
    """``keys``, ``order`` and, from the same key, the value of ``order`` before and after it (null at the ends).

    The rows are put in order over the whole cluster and stored by part; inside a part the neighbours are next to
    each other, and the first and last rows of the parts, one row a part, carry over the borders. A key of any size is spread
    over parts like any other rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ordered-{uuid4().hex}"
    cols = [*keys, order]
    df.select(*cols).repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    d = spark.read.parquet(path)
    own = W.partitionBy("_part").orderBy(*cols)
    row = F.struct(*[F.col(c).alias(c) for c in cols])
    d = d.withColumn("_p", F.lag(row).over(own)).withColumn("_n", F.lead(row).over(own))
    ends = spark.read.parquet(path).groupBy("_part").agg(F.min(row).alias("_first"), F.max(row).alias("_last"))
    parts = W.orderBy("_part")  # one row a part
    ends = ends.select("_part", F.lag("_last").over(parts).alias("_pl"), F.lead("_first").over(parts).alias("_nf"))
    j = d.join(F.broadcast(ends), "_part")
    same = lambda x: F.lit(True) if not keys else F.struct(*[x[c].alias(c) for c in keys]).eqNullSafe(F.struct(*[F.col(c).alias(c) for c in keys]))
    p, n = F.coalesce("_p", "_pl"), F.coalesce("_n", "_nf")
    return j.select(*cols, F.when(same(p), p[order]).alias(before), F.when(same(n), n[order]).alias(after))


def running(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], before: dict[str, tuple[str, str]],
) -> DataFrame:
    """Per row, aggregates over the rows of its key that come strictly before it.

    ``before`` maps an output name to (kind, column), kind in count, sum, max, last. ``chunk`` must
    not decrease along ``order`` (a day of a timestamp, say). Rows are windowed per (key, chunk), so
    a hot key is spread over its chunks; one row per (key, chunk) carries the totals forward."""
    agg = {
        "count": lambda c: F.count("*"), "sum": lambda c: F.sum(c), "max": lambda c: F.max(c),
        "last": lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.struct(*order)),
    }
    local = W.partitionBy(*keys, chunk).orderBy(*order)
    prior = local.rowsBetween(W.unboundedPreceding, -1)
    win = {
        "count": lambda c: (F.row_number().over(local) - 1).cast("bigint"), "sum": lambda c: F.sum(c).over(prior),
        "max": lambda c: F.max(c).over(prior), "last": lambda c: F.lag(F.struct(F.col(c).alias("v"))).over(local),
    }
    totals = df.groupBy(*keys, chunk).agg(*[agg[k](c).alias(f"_t_{n}") for n, (k, c) in before.items()])
    cw = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carry = {"count": F.sum, "sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    carried = totals.select(*keys, chunk, *[carry[k](f"_t_{n}").over(cw).alias(f"_c_{n}") for n, (k, _) in before.items()])
    rows = df.select("*", *[win[k](c).alias(f"_l_{n}") for n, (k, c) in before.items()])
    j = rows.join(carried, [*keys, chunk])
    both = {
        "count": lambda l, c: l + F.coalesce(c, F.lit(0)), "sum": lambda l, c: F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0)),
        "max": lambda l, c: F.greatest(l, c), "last": lambda l, c: F.coalesce(l, c)["v"],
    }
    for n, (k, _) in before.items():
        j = j.withColumn(n, both[k](F.col(f"_l_{n}"), F.col(f"_c_{n}"))).drop(f"_l_{n}", f"_c_{n}")
    return j


