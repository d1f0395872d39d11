"""How document filters overlap, kept up to date while files arrive.

The corpus is a stream of files, processed as available-now micro-batches. Four filters judge a text alone, in
column expressions; the fifth fails copies: texts that a document of a smaller id has too. Which copy that is
changes as files arrive, so each text (by its SHA-256) has a state: the smallest id so far and where it was counted. A
call and a state row for each text would cost far more than what they do, so texts are read and written in small buckets.
When a smaller id comes, what was counted for the earlier one is taken back (a count of -1 under its old mask of
failed filters, +1 under the new one). Each batch writes its changes summed by part and mask, and a repeated batch
writes them again in place; their sum over all batches is what one pass over everything would have counted.

Copies meet before the shuffle: a task sends, of each text, its smallest id and counts of all above, so a
text in a third of all documents reaches its state as a few rows a task. What every order of the filters
removes follows from the counts by mask, for an order only asks which failed filter comes first."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passageworks.functions.scale import shared_folder
from passageworks.llm.base import parts

FILTERS = "ABCDE"
COPY = 16  # the bit of E; A to D are bits 0 to 3
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMBINE = 200_000  # rows that a task combines at once
BUCKET_TEXTS = 512  # texts whose states are read and written together
SPACE = r"[\x20\x09-\x0D]+"


def buckets_for(table: DataFrame, texts: int = BUCKET_TEXTS) -> int:
    """Buckets of about so many texts, from the number of rows, which Parquet files state."""
    return max(2 * parts(table.sparkSession), -(-table.count() // texts))


def file_stream(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """A Parquet file or folder as a stream of its files, in about so many micro-batches."""
    table = spark.read.parquet(path)
    files = -(-len(table.inputFiles()) // batches)
    # as a pattern, for a stream takes no plain file
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{path[:-1]}[{path[-1]}]")


def failed(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    w = F.array_remove(F.split(text, SPACE), "")
    words, distinct = F.size(w), F.size(F.array_distinct(w))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda test, n: F.when(test, n).otherwise(0)
    return (bit(words < 100, 1) + bit(100 * distinct.cast("long") < 80 * words.cast("long"), 2)
            + bit(100 * upper.cast("long") > 10 * F.length(text).cast("long"), 4) + bit(text.rlike("[#$%&*|]"), 8))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(key, known, id, mask, part, flags)`` of each document; bit 0 of ``flags`` says good, bit 1 toxic."""
    t = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    t = t.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("key"), failed(F.col("t")).alias("mask"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.groupBy(F.col(doc_id).cast("long").alias("label_id")).agg((flag("quality") + 2 * flag("toxic")).alias("flags")).where("label_id IS NOT NULL")
    # documents without an id meet no label; a salt keeps them from meeting in one task
    salted = t.withColumn("salt", F.when(F.col("id").isNull(), F.crc32("key").cast("long")).otherwise(F.lit(-1)))
    j = salted.join(marks.select(F.col("label_id").alias("id"), F.lit(-1).cast("long").alias("salt"), "flags"), ["id", "salt"], "left")
    return j.select("key", F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.col("mask").cast("int").alias("mask"), "part",
                    F.coalesce("flags", F.lit(0)).cast("int").alias("flags"))


LEAST, ABOVE, APART = 0, 1, 2  # rows of a text's smallest id in a task, rows of larger ids, rows without an id
COMBINED = "key binary, kind int, id long, mask int, part string, flags int, n long"


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text in a task: its smallest id and how many rows have that, a larger or no id, by part and flags."""
    def out(held):
        t = pa.Table.from_batches(held).combine_chunks()
        codes = lambda c: t.column(c).combine_chunks().dictionary_encode()
        keys, names = codes("key"), codes("part")
        k, q = (np.asarray(x.indices, np.int64) for x in (keys, names))
        known, i, mask, flags = (t.column(c).to_numpy() for c in ("known", "id", "mask", "flags"))
        least = np.full(len(keys.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(least, k[known], i[known])
        kind = np.where(~known, APART, np.where(i > least[k], ABOVE, LEAST))
        o = np.lexsort((flags, q, kind, k))
        same = [x[o] for x in (k, kind, q, flags)]
        new = np.append(True, np.any([x[1:] != x[:-1] for x in same], axis=0))
        a = o[new]
        n = np.diff(np.append(np.flatnonzero(new), len(o)))
        return pa.RecordBatch.from_arrays(
            [keys.dictionary.take(pa.array(k[a])), pa.array(kind[a], pa.int32()), pa.array(np.where(kind[a] == APART, 0, least[k[a]])), pa.array(mask[a], pa.int32()),
             names.dictionary.take(pa.array(q[a])), pa.array(flags[a], pa.int32()), pa.array(n, pa.int64())], ["key", "kind", "id", "mask", "part", "flags", "n"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= COMBINE:
            yield out(held)
            held, rows = [], 0
    if rows:
        yield out(held)


CHANGE = "part string, mask int, flags int, n long"
STATE = "keys array<binary>, least array<long>, parts array<string>, flags array<int>, n array<long>"


def retract(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes that a batch makes to the texts of one bucket, summed, and their new states: of each text the
    smallest id and where its rows were counted."""
    rows = [r for f in frames for r in zip(*[f[c].tolist() for c in ("key", "kind", "id", "mask", "part", "flags", "n")])]
    held: dict[bytes, tuple[int, dict]] = {}
    if state.exists:
        for k, i, part, flags, n in zip(*state.get):
            held.setdefault(bytes(k), (i, {}))[1][part, flags] = n
    changes: Counter = Counter()
    for k, kind, i, mask, part, flags, n in rows:
        if kind != LEAST:
            changes[part, mask | (COPY if kind == ABOVE else 0), flags] += n
            continue
        k = bytes(k)
        least, counted = held.get(k, (None, {}))
        if least is None or i < least:
            for (old, f), m in counted.items():  # counted as no copy before, is one now
                changes[old, mask, f] -= m
                changes[old, mask | COPY, f] += m
            held[k] = least, counted = i, {}
        changes[part, mask | (COPY if i > least else 0), flags] += n
        if i == least:
            counted[part, flags] = counted.get((part, flags), 0) + n
    flat = [(k, i, part, f, n) for k, (i, counted) in held.items() for (part, f), n in counted.items()]
    if flat:
        state.update(tuple(list(x) for x in zip(*flat)))
    out = [(*c, n) for c, n in changes.items() if n]
    yield pd.DataFrame(out, columns=["part", "mask", "flags", "n"])


def counters(stream: DataFrame, labels: DataFrame, buckets: int = 1 << 16, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(part, mask, flags, n)``: documents by part, failed filters and labels, after all that the stream holds now."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/audit-{uuid4().hex}"
    combined = judged(stream, labels, doc_id, text, part).mapInArrow(combine, COMBINED)
    # SHA-256 is spread evenly, so its first digits make buckets of like size
    bucket = F.pmod(F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long"), F.lit(buckets))
    changes = combined.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(retract, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)
    by = ["part", "mask", "flags"]
    spark.createDataFrame([], CHANGE + ", batch long").write.partitionBy("batch").parquet(f"{base}/changes")

    def sink(df: DataFrame, batch: int) -> None:
        df.groupBy(*by).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{base}/changes/batch={batch}")

    store = "spark.sql.streaming.stateStore"  # files of a store aren't allocated ahead, for there are many small stores
    own = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        stream = changes.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink)
        stream.start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(CHANGE + ", batch long").parquet(f"{base}/changes")
    return found.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def _cases() -> list[tuple]:
    """For each mask, order and step what becomes of a document: 32 x 120 x 5 fixed rows."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for step, f in enumerate(order):
            before = sum(1 << g for g in order[:step])
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask >> f & 1, bool(mask & before)
                out.append((mask, "".join(FILTERS[g] for g in order), step + 1, int(not fails and not gone), int(fails and not gone), int(fails and gone),
                            int(mask == 1 << f), 120 // mask.bit_count() if fails else 0))
    return out


def audit(stream: DataFrame, labels: DataFrame, buckets: int = 1 << 16, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: one row per
    part, order of the five filters and step, zeros included.

    ``stream`` is a streaming table whose texts have their states in so many ``buckets``; ``labels`` has the id, ``quality`` and ``toxic``, and an id of several rows is good
    (toxic) if one of them says so. A null text is empty, a null part is the empty string. Rows of the same id and text are
    not copies of each other; rows without an id are no copies and make none. Only these columns are read. No rows: no rows."""
    c = counters(stream, labels, buckets, doc_id, text, part)
    names = ["kept", "removed", "redundant", "unique_fails", "weight"]
    cases = c.sparkSession.createDataFrame(_cases(), "mask int, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))
    j = c.join(F.broadcast(cases), "mask")
    total = lambda e: F.sum(e).cast("long")
    n = F.col("n")
    flag = lambda b: F.col("flags").bitwiseAND(b) != 0
    return j.groupBy("part", "filter_order", "step").agg(
        *[total(n * F.col(x)).alias(x) for x in names[:4]],
        total(F.when(flag(1), n * F.col("removed")).otherwise(0)).alias("good_lost"),
        total(F.when(flag(2), n * F.col("removed")).otherwise(0)).alias("toxic_lost"),
        total(n * F.col("weight")).alias("shapley"))
