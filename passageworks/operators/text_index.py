"""R2 over stored postings: the corpus is analysed once, whatever the number of queries and searches.

Fragments are numbered in blocks of ``BLOCK``; a posting list belongs to a (block, field, term) and carries places in the block, term
counts and field lengths, with the greatest count and the least length. From these follows the most that a block can
add to a query, so a search reads scores where they can matter: the blocks of greatest bound first, which gives each
query a k-th score; then only blocks whose bound reaches it. Queries stay a table throughout: their terms meet the lists
by an equality join on the term, and what passes the driver is one row of totals. Lists are stored in folders by hash of the
term, so that a search reads the folders of its own terms only. Places and counts are packed, a byte each where they fit, and a
block's field lengths are stored once: lists are most of what is written, shuffled and sorted."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.scale import shared_folder
from passageworks.operators.retrieval import FIELDS, SCORE_DIGITS, analyze
from passageworks.operators.topk import rank_topk

BLOCK = 128        # fragments of a block
FOLDERS = 16       # folders of the posting table, by hash of the term
GROUP_QUERIES = 1024  # queries that meet a block in one task's group, about
FIRST_BLOCKS = 2   # blocks of greatest bound that a query's first k-th score is taken from


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


@dataclass
class TextIndex:
    """``postings(block, field, term, places, counts, n, most, least, folder)``, ``members(block, place, <by>, revision_id, sizes)``
    and ``lengths(block, counts)``, the packed sizes of all its members, stored; ``by`` names the fragment's id."""

    postings: DataFrame
    members: DataFrame
    lengths: DataFrame
    by: str


def _packed(x: np.ndarray, start: np.ndarray, wide: np.ndarray) -> pa.Array:
    """Lists of numbers as bytes, those of ``wide`` as 32-bit integers."""
    end = np.append(start[1:], len(x))
    if wide.any():
        return pa.array([x[a:z].astype("<i4" if w else "u1").tobytes() for a, z, w in zip(start, end, wide)], pa.binary())
    offsets = np.append(start, len(x)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.astype("u1").tobytes())])


def _unpacked(lists: list[bytes], n: np.ndarray) -> np.ndarray:
    if sum(map(len, lists)) == n.sum():
        return np.frombuffer(b"".join(lists), "u1").astype(np.int64)
    return np.concatenate([np.frombuffer(x, "u1" if len(x) == m else "<i4").astype(np.int64) for x, m in zip(lists, n)])


def _block_lists(tokens: pa.ListArray, block: int, field: int) -> list[pa.Array]:
    flat = tokens.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(tokens.offsets.to_numpy())
    row = np.repeat(np.arange(len(tokens)), size)
    pair, count = np.unique(code * len(tokens) + row, return_counts=True)
    code, row = pair // max(len(tokens), 1), (pair % max(len(tokens), 1)).astype(np.int32)
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
    n = len(start)
    most, least = (f.reduceat(x, start) if n else np.empty(0) for f, x in ((np.maximum, count), (np.minimum, size[row])))
    lists = [_packed(row, start, np.full(n, len(tokens) > 256)), _packed(count, start, most > 255)]
    return [pa.array(np.full(n, block), pa.int64()), pa.array(np.full(n, field), pa.int32()), flat.dictionary.take(pa.array(code[start])), *lists,
            pa.array(np.diff(np.append(start, len(code))), pa.int32()), pa.array(most, pa.int32()), pa.array(least, pa.int32())]


POSTING = "block long, field int, term string, places binary, counts binary, sizes array<int>, n int, most int, least int"


def build(frags: DataFrame, by: str = "fragment_id", block: int = BLOCK) -> TextIndex:
    """Analyse ``frags(<by>, revision_id, retrieval_content, content, section, title)`` and store the lists.

    A block's number is its first row's in the table that was read. Null fields have no terms."""
    spark = frags.sparkSession
    base = f"{shared_folder(spark)}/text-index-{uuid4().hex}"
    fields = list(FIELDS)
    none = F.array().cast("array<string>")
    tokens = {f: F.coalesce(analyze(F.col(f)), none) for f in fields}
    # analysis is the dear part: what is cleaned text of the same letters has the content's words
    same = F.lower(fields[0]).eqNullSafe(F.lower(fields[1]))
    tokens[fields[0]] = F.when(~same, tokens[fields[0]])
    analysed = frags.select(F.monotonically_increasing_id().alias("row"), by, "revision_id", *[t.alias(f) for f, t in tokens.items()])
    kinds = [analysed.schema[c] for c in (by, "revision_id")]
    # a row with a null field describes a fragment of the block, at its place; one of field -1 has the lengths of all
    schema = T.StructType([*T._parse_datatype_string(POSTING).fields, *[T.StructField(k.name, k.dataType) for k in kinds]])
    names = schema.fieldNames()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for b in batches:
            kind = [b.column(1).type, b.column(2).type]
            for a in range(0, b.num_rows, block):
                s = b.slice(a, block)
                at, n = s.column(0)[0].as_py(), s.num_rows
                columns = [s.column(i + 3) for i in range(len(fields))]
                alike = columns[0].is_null().to_numpy(zero_copy_only=False)
                if alike.any():
                    columns[0] = pa.concat_arrays([columns[1], columns[0]]).take(pa.array(np.arange(n) + n * ~alike))
                own = [np.diff(c.offsets.to_numpy()) for c in columns]
                place = pa.array(np.arange(n), pa.int32())
                lengths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(fields), pa.int32()), pa.array(np.stack(own, axis=1).reshape(-1), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), lengths, place,
                                                  pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), s.column(1), s.column(2)], names)
                packed = pa.array([np.stack(own, axis=1).astype("<i4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), packed,
                                                  pa.nulls(1, pa.list_(pa.int32())), pa.array([n], pa.int32()), *[pa.nulls(1, k) for k in (pa.int32(), pa.int32(), *kind)]], names)
                for i, c in enumerate(columns):
                    got = _block_lists(c, at, i)
                    got.insert(5, pa.nulls(len(got[0]), pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays([*got, *[pa.nulls(len(got[0]), k) for k in kind]], names)

    rows = analysed.mapInArrow(lists, schema).withColumn("folder", F.when(F.col("field").isNull(), -1).when(F.col("field") < 0, -2).otherwise(_folder(F.col("term"))))
    rows.write.partitionBy("folder").parquet(base)
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("folder", T.IntegerType())])).parquet(base)
    members = stored.where("folder = -1").select("block", F.col("n").alias("place"), by, "revision_id", "sizes")
    return TextIndex(stored.where("folder >= 0").drop("sizes", *[k.name for k in kinds]), members, stored.where("folder = -2").select("block", "counts"), by)


def keep(df: DataFrame, name: str) -> DataFrame:
    """A small result as a table in the shared folder: read as often as needed, computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _impact(count: Column, size: Column, mean: Column, k1: float, b: float) -> Column:
    return count * (k1 + 1) / (count + k1 * (1 - b + b * size / mean))


def _scored(index: TextIndex, pairs: DataFrame, packs: DataFrame, weights: DataFrame, live: DataFrame | None, means: list[float], k: int, k1: float, b: float, groups: int) -> DataFrame:
    """``(query_id, block, place, score)`` of the pairs (query, block): the k best fragments of each block and all that tie with the k-th."""
    boosts = list(FIELDS.values())
    asked = pairs.join(packs, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    blocks = pairs.select("block").distinct()
    lists = index.postings.join(weights.select("field", "term", "tid").distinct(), ["field", "term"]).join(blocks, "block", "left_semi")
    lists = lists.select("block", "tid", "field", "places", "counts", "n", F.lit(None).cast("array<int>").alias("alive"))
    other = lambda df, tid, counts, alive: df.join(blocks, "block", "left_semi").select(
        "block", F.lit(tid).cast("long").alias("tid"), F.lit(-1).alias("field"), F.lit(None).cast("binary").alias("places"), counts.alias("counts"), F.lit(0).alias("n"), alive.alias("alive"))
    lists = lists.unionByName(other(index.lengths, -2, F.col("counts"), F.lit(None).cast("array<int>")))
    if live is not None:
        lists = lists.unionByName(other(live, -1, F.lit(None).cast("binary"), F.col("places")))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))) if groups > 1 else lists.withColumn("part", F.lit(0).cast("long"))
    q_type = pairs.schema["query_id"].dataType
    out = T.StructType([T.StructField("query_id", q_type), T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("score", T.DoubleType())])
    filtered = live is not None

    def score(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        own = p[p["tid"] >= 0]
        if not len(q) or not len(own):
            return pd.DataFrame({"query_id": q["query_id"].iloc[:0], "block": [], "place": [], "score": []})
        tid, field, each = own["tid"].to_numpy(), own["field"].to_numpy(), own["n"].to_numpy()
        of = np.repeat(np.arange(len(own)), each)
        place, count = (_unpacked(own[c].tolist(), each) for c in ("places", "counts"))
        size = np.frombuffer(p.loc[p["tid"] == -2, "counts"].iloc[0], "<i4").reshape(-1, len(boosts))[place, field[of]]
        weight = count * (k1 + 1) / (count + k1 * (1 - b + b * size / np.array(means)[field[of]]))
        ids = np.concatenate(q["tids"].tolist())
        w, who = np.concatenate(q["ws"].tolist()), np.repeat(np.arange(len(q)), q["tids"].map(len))
        o = np.argsort(tid)
        at = np.minimum(np.searchsorted(tid[o], ids), len(own) - 1)
        hit = tid[o][at] == ids
        matrix = np.zeros((len(own), len(q)))
        np.add.at(matrix, (o[at[hit]], who[hit]), w[hit])
        total = np.zeros((place.max() + 1, len(q)))
        for f, boost in enumerate(boosts):
            mine = np.flatnonzero(field == f)
            if len(mine):
                part = np.zeros((len(total), len(mine)))
                sel = field[of] == f
                part[place[sel], np.searchsorted(mine, of[sel])] = weight[sel]
                np.maximum(total, boost * (part @ matrix[mine]), out=total)
        total = np.round(total, SCORE_DIGITS)
        if filtered:
            alive = p.loc[p["tid"] == -1, "alive"].tolist()
            on = np.zeros(len(total), bool)
            alive = np.concatenate(alive).astype(np.int64) if alive else np.empty(0, np.int64)
            on[alive[alive < len(total)]] = True
            total[~on] = 0
        least = np.partition(total, -k, axis=0)[-k] if len(total) > k else np.zeros(len(q))
        at, who = np.nonzero((total > 0) & (total >= least))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[who], "block": key[0], "place": at, "score": total[at, who]})

    return lists.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(score, out)


def bm25(
    queries: DataFrame, index: TextIndex, k: int = 20, k1: float = 1.2, b: float = 0.75, eligible: DataFrame | None = None,
    first_blocks: int = FIRST_BLOCKS, notes: dict | None = None,
) -> DataFrame:
    """R2. ``query_id, <by>, score, rank``, as ``retrieval.bm25_topk`` has it, from stored postings.

    ``queries(query_id, text)`` may be any number; ``eligible(revision_id)`` filters before the cut, statistics are
    those of the whole index. ``notes`` gets the numbers of (query, block) pairs: all with a shared term, and those scored."""
    by, names = index.by, list(FIELDS)
    totals = index.members.agg(F.count("*").alias("n"), *[F.sum(F.col("sizes")[i]).alias(f) for i, f in enumerate(names)]).first()
    n = totals["n"]
    means = [(totals[f] or 0) / n or 1.0 if n else 1.0 for f in names]
    words = queries.select("query_id", F.explode(analyze(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = keep(words.withColumn("folder", _folder(F.col("term"))), "query-terms")
    known = index.postings.join(words.select("folder", "term").distinct(), ["folder", "term"], "left_semi").groupBy("field", "term").agg(F.sum("n").alias("df"))
    known = keep(known.select("field", "term", "df", F.monotonically_increasing_id().alias("tid")), "query-vocabulary")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = keep(words.join(known, "term").select("query_id", "folder", "field", "term", "tid", (F.col("qtf") * idf).alias("w")), "query-weights")
    packs = weights.groupBy("query_id").agg(F.collect_list(F.struct("tid", "w")).alias("x")).select("query_id", F.col("x.tid").alias("tids"), F.col("x.w").alias("ws"))
    live = None
    if eligible is not None:
        live = keep(index.members.join(eligible.select("revision_id").distinct(), "revision_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("places")), "live")
    mean = F.element_at(F.array(*[F.lit(float(m)) for m in means]), F.col("field") + 1)
    boost = F.element_at(F.array(*[F.lit(x) for x in FIELDS.values()]), F.col("field") + 1)
    part = boost * F.col("w") * _impact(F.col("most"), F.col("least"), mean, k1, b)
    met = index.postings.select("block", "folder", "field", "term", "most", "least").join(weights, ["folder", "field", "term"])
    bound = met.groupBy("query_id", "block").agg(*[F.sum(F.when(F.col("field") == i, part)).alias(f"_{i}") for i in range(len(names))])
    bound = bound.select("query_id", "block", F.greatest(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(len(names))]).alias("bound"))
    bound = bound.join(live.select("block"), "block", "left_semi") if live is not None else bound
    bound = keep(bound, "bounds")
    groups = max(1, -(-queries.count() // GROUP_QUERIES))
    args = (packs, weights, live, means, k, k1, b, groups)
    first = rank_topk(bound, ["query_id"], [F.desc("bound"), F.asc("block")], first_blocks, "_r").drop("_r")
    first = keep(first.select("query_id", "block"), "first-pairs")
    found = keep(_scored(index, first, *args), "first-scores")
    floor = rank_topk(found, ["query_id"], [F.desc("score")], k, "_r").where(F.col("_r") == k).select("query_id", F.col("score").alias("floor"))
    rest = bound.join(first, ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    rest = keep(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 10.0 ** -SCORE_DIGITS)).select("query_id", "block"), "rest-pairs")
    if notes is not None:
        notes |= {"pairs": bound.count(), "scored": first.count() + rest.count()}
    found = found.unionByName(_scored(index, rest, *args))
    named = found.join(index.members.select("block", "place", by), ["block", "place"]).select("query_id", by, "score")
    return rank_topk(named, ["query_id"], [F.desc("score"), F.asc(by)], k)
