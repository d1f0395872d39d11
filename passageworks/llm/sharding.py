"""Sharding by extendible hashing.

A row's bucket is a prefix of its key's 60-bit hash. The directory starts with the empty prefix;
only a bucket over the byte limit splits, on the next bit, until every shard fits. Splits depend on
byte sums alone, so the whole directory follows from one aggregation: bytes per prefix of ``step``
bits, summed again for every shorter prefix. A row's depth is the shortest prefix that fits. Cells
that are still too large are aggregated again with ``step`` more bits, those cells only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.llm.base import own_names, stored

BITS = 60


def hash60(key: Column) -> Column:
    """The first 15 hex digits of the key's MD5 as an integer; a null key as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column) -> Column:
    """A shard's name: the first ``depth`` bits of the hash as text."""
    return F.substr(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth)


def directory(docs: DataFrame, limit: int, key: str = "doc_id", size: str = "n_bytes", step: int = 12) -> DataFrame:
    """``(prefix, depth, shard_bytes, n_rows)``, one row per shard.

    Depth 60 that still exceeds the limit (rows of one key, or one row over the limit alone) stays
    one shard, marked ``oversize``: hashing can't part equal keys and rows are never cut."""
    rows = docs.select(hash60(F.col(key)).alias("h"), F.col(size).cast("bigint").alias("b"))
    done, base, open_cells = None, 0, None
    while base < BITS:
        top = min(BITS, base + step)
        if open_cells is not None:
            rows = rows.join(open_cells, F.shiftright("h", BITS - base) == F.col("cell"), "left_semi")
        cells = rows.groupBy(F.shiftright("h", BITS - top).alias("c")).agg(F.sum("b").alias("b"), F.count("*").alias("n"))
        levels = cells.select(F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(top))).alias("depth"), "c", "b", "n")
        levels = levels.groupBy("depth", F.expr(f"shiftright(c, {top} - depth)").alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n_rows"))
        levels = stored(levels, "directory")
        fits = levels.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        over = levels.where(F.col("shard_bytes") > limit)
        # the shortest prefix that fits: it fits and its parent doesn't (the root has no parent)
        parent = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_p"))
        inner = fits.where(F.col("depth") > (base if base else 0)).withColumn("_p", F.shiftright("prefix", 1))
        first = (base if base else -1) + 1
        shards = inner.where(F.col("depth") > first).join(parent, ["depth", "_p"], "left_semi").drop("_p")
        shards = shards.unionByName(fits.where(F.col("depth") == first)) if base or first == 0 else shards
        done = shards if done is None else done.unionByName(shards)
        open_cells = over.where((F.col("depth") == top) & (F.col("depth") < BITS)).select(F.col("prefix").alias("cell"))
        if open_cells.isEmpty():
            break
        base = top
    return done.select("prefix", "depth", "shard_bytes", "n_rows", (F.col("shard_bytes") > limit).alias("oversize"))


def assign(docs: DataFrame, limit: int, key: str = "doc_id", size: str = "n_bytes", step: int = 12) -> DataFrame:
    """Every input row with ``shard`` (the prefix bits, "" for a single shard), ``shard_bytes`` and
    ``oversize``. Input columns of those names give way. Null sizes count as zero; an empty table
    gives no rows.

    The directory is expanded to the next multiple of ``step`` bits, at most 2**step slots a shard, and a row meets its
    slot by equality, once for each multiple that occurs: one, unless sizes are very uneven."""
    docs = docs.drop("shard", "shard_bytes", "oversize")
    h, cell, told_at = own_names("h", "cell", "told")
    dirs = stored(directory(docs.withColumn(size, F.coalesce(F.col(size), F.lit(0))), limit, key, size, step), "shards")
    top = F.least(F.ceil(F.col("depth") / step) * step, F.lit(BITS)).cast("int")
    tops = sorted(r[0] for r in dirs.select(top.alias("t")).distinct().collect())  # at most 61 numbers
    out = docs.withColumn(h, hash60(F.col(key)))
    told = F.struct("depth", "shard_bytes", "oversize")
    for t in tops:
        slots = dirs.where(top == t).select(
            F.explode(F.expr(f"sequence(shiftleft(prefix, {t} - depth), shiftleft(prefix + 1, {t} - depth) - 1)")).alias(f"{cell}{t}"), told.alias(f"{told_at}{t}"))
        out = out.withColumn(f"{cell}{t}", F.shiftright(h, BITS - t)).join(slots, f"{cell}{t}", "left")
    found = F.coalesce(*[F.col(f"{told_at}{t}") for t in tops]) if tops else F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("shard_bytes"), F.lit(False).alias("oversize"))
    return out.select(*docs.columns, prefix(F.col(h), found["depth"]).alias("shard"), found["shard_bytes"].alias("shard_bytes"), found["oversize"].alias("oversize"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Each shard in a folder of its own."""
    assigned.withColumn("shard_id", F.concat(F.lit("s"), "shard")).write.partitionBy("shard_id").parquet(path)
