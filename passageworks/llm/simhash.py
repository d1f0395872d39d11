"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints meet on pairs of 16-bit bands: two that differ in at most two bits agree in two of
the four bands, so each fingerprint goes to six buckets. Inside the buckets fingerprints are stored
vertically, 64 to a block, one word per bit; every (fingerprint, block) distance is counted for 64
partners at once with carry-save counters over the bit planes, and a block is left as soon as all
its partners exceed the radius. Only a spanning set of links leaves a bucket. A bucket above
``DENSE`` fingerprints is linked exactly by shared one-bit neighbours instead, an aggregation that
needs no bucket in one place."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.base import own_names, stored
from passageworks.operators.evaluation import leakage_groups

SEED, RADIUS, DENSE = 42, 2, 4096
BANDS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint of one text; null and texts without a word have 0."""
    w = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        joined = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, len(w))
        end = np.cumsum(size + 1) - 1
        a, b = (end - size)[: len(w) - words + 1].tolist(), end[words - 1:].tolist()
        shingles = map(joined.__getitem__, map(slice, a, b))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.add.reduce(np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, fp)``: one row per input row; ``row`` numbers the rows of a stored table and
    is the same whenever that table is read the same way."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fp)], ["doc_id", "row", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row long, fp long")


def close_pairs(groups: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All fingerprints of the groups, one behind the other, and the index pairs (i < j) inside a
    group that differ in at most ``radius`` bits."""
    sizes = np.array([len(g) for g in groups], np.int64)
    x = np.concatenate(groups).astype(np.uint64) if len(groups) else np.empty(0, np.uint64)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    blocks = -(-sizes // 64)
    first = np.cumsum(blocks) - blocks
    block = np.repeat(first, sizes) + place // 64
    lane = (place % 64).astype(np.uint64)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(x) else np.empty(0, np.int64)
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat((x >> np.uint64(b) & one) << lane, starts) for b in range(64)]) if len(x) else np.zeros((64, 0), np.uint64)
    valid = np.bitwise_or.reduceat(one << lane, starts) if len(x) else np.empty(0, np.uint64)
    # every fingerprint against its own block and the later blocks of its group
    many = np.repeat(first + blocks, sizes) - block
    q = np.repeat(np.arange(len(x)), many)
    k = block[q] + np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
    levels = (radius + 1).bit_length()
    counter = [np.zeros(len(q), np.uint64) for _ in range(levels)]
    over = ~valid[k]
    for b in range(64):
        carry = planes[b, k] ^ (np.uint64(0) - (x[q] >> np.uint64(b) & one))
        for c in counter:  # carry-save: sum and carry of every lane at once
            c[:], carry = c ^ carry, c & carry
        over |= carry
        if b % 4 == 3:
            past = over | _above(counter, radius)
            alive = past != ~np.uint64(0)
            if not alive.all():
                q, k, over, counter = q[alive], k[alive], over[alive], [c[alive] for c in counter]
    hit = ~(over | _above(counter, radius))
    some = np.flatnonzero(hit)
    bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    a, lanes = np.nonzero(bits)
    i, j = q[some][a], starts[k[some][a]] + lanes
    later = j > i
    return x, i[later], j[later]


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, by comparing the counter's bits from the top."""
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for n in range(len(counter) - 1, -1, -1):
        if radius >> n & 1:
            same &= counter[n]
        else:
            more |= same & counter[n]
            same &= ~counter[n]
    return more


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each one is linked to, directly or by others."""
    low = np.arange(n)
    while len(i):
        now = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(now, low[i], m)
        np.minimum.at(now, low[j], m)
        now = now[now]
        if (now == low).all():
            break
        low = now
    while (low[low] != low).any():
        low = low[low]
    return low


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """``(a, b)``: links that connect exactly the fingerprints (column ``fp``) connected by steps of
    at most two differing bits."""
    band = lambda n: F.shiftrightunsigned("fp", 16 * n).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*[F.lit(n << 32).bitwiseOR(F.shiftleft(band(a), 16)).bitwiseOR(band(b)) for n, (a, b) in enumerate(BANDS)])
    at = stored(distinct.select("fp", F.explode(keys).alias("key")), "bands")
    full = at.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = at.join(full, "key")
    lists = met.where(F.col("n") <= dense).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = [np.asarray(g.values, np.int64).view(np.uint64) for g in b.column("fps")]
            at, cells = [], 0
            for n, g in enumerate(groups):
                at.append(g)
                cells += len(g) * -(-len(g) // 64)
                if cells > 1 << 18 or n == len(groups) - 1:
                    x, i, j = close_pairs(at)
                    low = _spanning(len(x), i, j)
                    s = np.flatnonzero(low != np.arange(len(x)))
                    yield pa.RecordBatch.from_arrays([pa.array(x[s].view(np.int64)), pa.array(x[low[s]].view(np.int64))], ["a", "b"])
                    at, cells = [], 0

    sliced = lists.mapInArrow(compare, "a long, b long")
    crowd = met.where(F.col("n") > dense).select("fp").distinct()
    near = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << n if n < 63 else -(1 << 63))) for n in range(64)])).alias("v"))
    # a value next to two fingerprints, or a fingerprint next to another, joins them
    shared = near.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v").unionByName(crowd.select(F.col("fp").alias("v"))).distinct()
    through = near.join(shared, "v", "left_semi").select(F.col("fp").alias("a"), F.col("v").alias("b"))
    return sliced.unionByName(through)


def near_groups(docs: DataFrame, words: int = 3, dense: int = DENSE) -> DataFrame:
    """``(doc_id, row, fp, component_id)``, one row per input row.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at most two
    bits. Texts without a word have fingerprint 0 and are linked like others. Null ids take no part
    in the minimum, so a group of null ids alone has a null component. No rows: no rows."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = leakage_groups(stored(links(distinct, dense), "links"))
    named = distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = named.join(least, "component").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", "row", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """The input rows without all but one of each group: the one of the smallest doc_id stays
    (nulls last; of equal ids the first row). ``docs`` is a table read from files. Columns and
    values are unchanged."""
    row, name = own_names("row", "group")
    g = near_groups(docs, words)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    # a group is named by its component; groups of null ids alone are told apart by fingerprint
    keep = g.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias(name)).agg(F.min(order)["row"].alias(row)).select(row)
    return docs.withColumn(row, F.monotonically_increasing_id()).join(keep, row, "left_semi").drop(row)
