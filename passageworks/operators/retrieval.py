"""Many queries against a corpus: lexical, BM25 and vector search, fusion and packing.

The corpus is never shuffled for scoring. Queries of any number are cut into blocks bounded by rows,
bytes and matrix cells; each task scores its own fragments against one block and keeps its own
best k. These rows are written to the shared folder, so that what follows knows their size, reads them
as often as it likes and never scores twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from passageworks.functions.scale import shared_folder
from passageworks.functions.text import let, terms
from passageworks.operators.topk import TILE_ROWS, LocalBest, NearestVectors, rank_topk

BLOCK_ROWS = 4096          # queries of a block, about
VECTOR_ROWS = 32768        # query vectors of a block, about
BLOCK_BYTES = 32 << 20     # bytes of query text of a block, about
BLOCK_CELLS = 16 << 20     # cells of a block's (vocabulary x queries) matrix, unless it is one query
GATHER_CELLS = 4 << 20     # cells of one numpy gather
SCORE_DIGITS = 6           # scores are rounded before ranking, so that equal scores tie by id


def _blocks(queries: DataFrame, size: Column, rows: int, limit: int) -> Iterator[DataFrame]:
    """The query set by hash of the id, in as many parts as its rows and sizes ask for."""
    r = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n = max(1, -(-r["n"] // rows), -(-r["b"] // limit))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)


class _Best:
    """The table that gathers the best rows of all blocks; a block's broadcast ends with its job."""

    def __init__(self, spark: SparkSession, schema: T.StructType) -> None:
        self.spark, self.schema, self.n = spark, schema, 0
        self.path = f"{shared_folder(spark)}/best-{uuid4().hex}"

    def add(self, pool: DataFrame, index: tuple, scorer: Callable) -> None:
        shared = self.spark.sparkContext.broadcast(index)
        pool.mapInArrow(scorer(shared), self.schema).write.parquet(f"{self.path}/block={self.n}")
        self.n += 1
        shared.destroy()

    def ranked(self, key: str, k: int, merge: bool = False) -> DataFrame:
        got = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/block={i}" for i in range(self.n)])
        if merge:
            got = got.groupBy("query_id", key).agg(F.max("score").alias("score"))
        return rank_topk(got, ["query_id"], [F.desc("score"), F.asc(key)], k)


def _arrow(dt: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(dt.simpleString(), pa.int64())


def _query_indexes(queries: DataFrame, toks: Column, rows: int) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """Ids, vocabulary and the (vocabulary x queries) count matrix of one block after the other."""
    for block in _blocks(queries, F.octet_length("text"), rows, BLOCK_BYTES):
        got = block.select("query_id", toks.alias("t")).orderBy("query_id").collect()  # a block of bounded size
        while True:
            vocab: dict[str, int] = {}
            taken = 0
            for r in got:
                new = [t for t in dict.fromkeys(r["t"] or []) if t not in vocab]
                if taken and (len(vocab) + len(new)) * (taken + 1) > BLOCK_CELLS:
                    break
                vocab |= {t: len(vocab) + i for i, t in enumerate(new)}
                taken += 1
            m = np.zeros((len(vocab), taken))
            for j, r in enumerate(got[:taken]):
                for t in r["t"] or []:
                    m[vocab[t], j] += 1
            yield [r["query_id"] for r in got[:taken]], list(vocab), m
            got = got[taken:]
            if not got:
                break


def _slices(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that (rows x columns) stays bounded."""
    step = max(1, GATHER_CELLS // max(1, columns))
    for b in batches:
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def _hits(col: pa.ListArray, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term number) of every list entry that is in the vocabulary, in row order."""
    idx = pc.index_in(col.flatten(), value_set=vocab)
    term = idx.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
    ok = ~np.isnan(term) if term.dtype.kind == "f" else term >= 0
    return row[ok], term[ok].astype(np.int64)


def _accumulate(n: int, row: np.ndarray, weights: np.ndarray, term: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of ``weights * matrix[term]`` per row, in bounded slices of the hit list."""
    out = np.zeros((n, matrix.shape[1]))
    step = max(1, GATHER_CELLS // max(1, matrix.shape[1]))
    for a in range(0, len(row), step):
        r = row[a:a + step]
        starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[starts]] += np.add.reduceat(matrix[term[a:a + step]] * weights[a:a + step, None], starts, axis=0)
    return out


def lexical_topk(queries: DataFrame, frags: DataFrame, k: int = 5, by: str = "fragment_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """R1. ``query_id, <by>, score, rank``: the number of shared terms, ties by id ascending.

    ``frags`` has ``text`` = title, section and content joined by blanks."""
    qt, ft = queries.schema["query_id"].dataType, frags.schema[by].dataType
    types = (_arrow(qt), _arrow(ft), pa.int64())

    def scorer(shared):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, words, matrix = shared.value
            vocab_array = pa.array(words, pa.string())
            best = LocalBest(len(q_ids), k)
            for b in _slices(batches, len(q_ids)):
                row, term = _hits(b.column(1), vocab_array)
                s = _accumulate(b.num_rows, row, np.ones(len(row)), term, matrix)
                best.add(b.column(0).to_numpy(zero_copy_only=False), s)
            yield from best.batch(q_ids, ("query_id", by, "score"), types)

        return score

    out = _Best(queries.sparkSession, T.StructType([T.StructField("query_id", qt), T.StructField(by, ft), T.StructField("score", T.LongType())]))
    pool = frags.select(by, terms(F.col("text")).alias("t"))
    if queries.limit(block_rows + 1).count() > block_rows:  # several blocks read the terms
        path = f"{shared_folder(queries.sparkSession)}/terms-{uuid4().hex}"
        pool.write.parquet(path)
        pool = queries.sparkSession.read.schema(pool.schema).parquet(path)
    for ids, vocab, m in _query_indexes(queries, terms(F.col("text")), block_rows):
        out.add(pool, (ids, vocab, np.minimum(m, 1.0)), scorer)
    return out.ranked(by, k)


# Code-point ranges indexed as overlapping pairs, and the analyzer's stop words.
_CJK = r"\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uAC00-\uD7AF"
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these "
              "they this to was will with").split()


def analyze(col: Column) -> Column:
    """Search tokens with repeats: lower-case words without stop words, CJK runs as pairs."""

    def words(t: Column, pattern: str) -> Column:
        return F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: ~x.isin(STOP_WORDS))

    def tokens(t: Column) -> Column:
        # The class intersection is several times slower, so only texts with CJK pay for it.
        return F.when(~t.rlike(f"[{_CJK}]"), words(t, r"([\p{L}\p{Nd}]+)")).otherwise(F.concat(
            words(t, rf"([\p{{L}}\p{{Nd}}&&[^{_CJK}]]+)"),
            F.regexp_extract_all(t, F.lit(rf"(?=([{_CJK}]{{2}}))"), F.lit(1)),
            F.regexp_extract_all(t, F.lit(rf"(?<![{_CJK}])([{_CJK}])(?![{_CJK}])"), F.lit(1)),
        ))

    return let(F.lower(col), tokens)


# Searched fields and their boosts; the best field decides.
FIELDS = {"retrieval_content": 2.0, "content": 1.0, "section": 1.0, "title": 1.0}


def _matched(frags: DataFrame, vocab: list[str], ids: list[str]) -> DataFrame:
    """The fragments analysed once: ``ids`` and, per field, the numbers (``t``) and counts (``c``) of the vocabulary's words in it,
    and its length (``n``). Stored, for statistics and scores both read it and the texts are the dear part."""
    shared = frags.sparkSession.sparkContext.broadcast(vocab)
    fields = list(FIELDS)
    schema = T.StructType([frags.schema[c] for c in ids] + [T.StructField(f"{x}{i}", t) for i in range(len(fields)) for x, t in (
        ("t", T.ArrayType(T.IntegerType())), ("c", T.ArrayType(T.IntegerType())), ("n", T.IntegerType()))])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for b in batches:
            cols = [b.column(i) for i in range(len(ids))]
            for i in range(len(fields)):
                toks = b.column(len(ids) + i)
                row, term = _hits(toks, names)
                pair, tf = np.unique(row * max(1, len(names)) + term, return_counts=True)
                row, term = pair // max(1, len(names)), pair % max(1, len(names))
                at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
                cols += [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
                cols.append(pa.array(np.diff(toks.offsets.to_numpy()), pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    path = f"{shared_folder(frags.sparkSession)}/matched-{uuid4().hex}"
    frags.select(*ids, *[analyze(F.col(f)).alias(f"_{f}") for f in FIELDS]).mapInArrow(match, schema).write.parquet(path)
    return frags.sparkSession.read.schema(schema).parquet(path)


def _field_weights(matched: DataFrame, words: int) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Per field, the idf of each word of a block's vocabulary and the mean length. Counted inside each
    task, so that a task sends at most one row per field and word."""
    fields = list(FIELDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, size = np.zeros((len(fields), words), dtype=np.int64), 0, np.zeros(len(fields), dtype=np.int64)
        for b in batches:
            rows += b.num_rows
            for i in range(len(fields)):
                df[i] += np.bincount(b.column(2 * i).flatten().to_numpy(zero_copy_only=False), minlength=words).astype(np.int64)
                size[i] += int(b.column(2 * i + 1).to_numpy(zero_copy_only=False).sum())
        if not rows:
            return
        at_field, at_term = np.nonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([fields[i] for i in at_field] + fields, pa.string()),
             pa.array(at_term.tolist() + [-1] * len(fields), pa.int64()),
             pa.array(df[at_field, at_term].tolist() + [rows] * len(fields), pa.int64()),
             pa.array([0] * len(at_field) + size.tolist(), pa.int64())], names=["field", "term", "n", "size"])

    part = matched.select(*[f"{x}{i}" for i in range(len(fields)) for x in "tn"]).mapInArrow(count, "field string, term bigint, n bigint, size bigint")
    counted = part.groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()  # four rows a word; those of word -1 have the lengths
    total = {r["field"]: r for r in counted if r["term"] < 0}
    idf = {f: np.zeros(words) for f in FIELDS}
    for r in counted:
        if r["term"] >= 0:
            idf[r["field"]][r["term"]] = np.log(1 + (total[r["field"]]["n"] - r["n"] + 0.5) / (r["n"] + 0.5))
    return idf, {f: total[f]["size"] / total[f]["n"] or 1.0 if f in total else 1.0 for f in FIELDS}


def bm25_topk(
    queries: DataFrame, frags: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75,
    eligible: DataFrame | None = None, by: str = "fragment_id", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """R2. BM25 over the four fields, best boosted field per (query, fragment); eligible
    revisions only, filtered before scoring. Statistics are those of the whole index."""
    ids = [by] if eligible is None else list(dict.fromkeys([by, "revision_id"]))
    qt, ft = queries.schema["query_id"].dataType, frags.schema[by].dataType
    types = (_arrow(qt), _arrow(ft), pa.float64())
    fields = list(FIELDS)

    def scorer(shared):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, matrix, weight, mean = shared.value
            best = LocalBest(len(q_ids), k)
            for batch in _slices(batches, len(q_ids)):
                total = np.zeros((batch.num_rows, len(q_ids)))
                for i, field in enumerate(fields):
                    terms_, counts, lengths = batch.column(3 * i + 1), batch.column(3 * i + 2), batch.column(3 * i + 3)
                    row = np.repeat(np.arange(batch.num_rows), np.diff(terms_.offsets.to_numpy()))
                    if not len(row):
                        continue
                    term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms_, counts))
                    size = lengths.to_numpy(zero_copy_only=False)[row]
                    w = weight[field][term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean[field]))
                    np.maximum(total, FIELDS[field] * _accumulate(batch.num_rows, row, w, term, matrix), out=total)
                best.add(batch.column(0).to_numpy(zero_copy_only=False), np.round(total, SCORE_DIGITS))
            yield from best.batch(q_ids, ("query_id", by, "score"), types)

        return score

    out = _Best(queries.sparkSession, T.StructType([T.StructField("query_id", qt), T.StructField(by, ft), T.StructField("score", T.DoubleType())]))
    for q_ids, vocab, m in _query_indexes(queries, analyze(F.col("text")), block_rows):
        matched = _matched(frags, vocab, ids)
        pool = matched if eligible is None else matched.join(eligible, "revision_id", "left_semi")
        scored = pool.select(by, *[f"{x}{i}" for i in range(len(fields)) for x in "tcn"])
        out.add(scored, (q_ids, m, *_field_weights(matched, len(vocab))), scorer)
    return out.ranked(by, k)


def _unit(col: pa.ListArray, dims: int) -> np.ndarray:
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(v) != len(col) * dims:
        raise ValueError(f"every vector must have {dims} dimensions")
    v = v.reshape(len(col), dims)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def dense_topk(
    query_vecs: DataFrame, vecs: DataFrame, k: int = 20, eligible: DataFrame | None = None,
    by: str = "vec_id", dims: int = 64, owner: str | None = None, block_rows: int = VECTOR_ROWS,
) -> DataFrame:
    """R3. Exact cosine: query blocks of a fixed size as a matrix, the corpus streamed past them.

    R4 with ``owner``: several vectors belong to one owner, the best vector decides. A task sends its k
    best owners only: an owner that is not among them where its best vector lies is behind k others."""
    pool = vecs if eligible is None else vecs.join(eligible, by, "left_semi")
    key = owner or by
    qt, ft = query_vecs.schema["query_id"].dataType, vecs.schema[key].dataType
    types = (_arrow(qt), _arrow(ft), pa.float64())

    def scorer(shared):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, matrix = shared.value
            best = NearestVectors(matrix, k, SCORE_DIGITS, merge=owner is not None)
            for b in batches:
                for a in range(0, b.num_rows, TILE_ROWS):
                    part = b.slice(a, TILE_ROWS)
                    best.add(part.column(0).to_numpy(zero_copy_only=False), _unit(part.column(1), dims))
            yield from best.batch(q_ids, ("query_id", key, "score"), types)

        return score

    out = _Best(query_vecs.sparkSession, T.StructType([T.StructField("query_id", qt), T.StructField(key, ft), T.StructField("score", T.DoubleType())]))
    for block in _blocks(query_vecs.select("query_id", "embedding"), F.lit(0), block_rows, 1):
        rows = block.toArrow().combine_chunks()  # one block of a fixed size
        found = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        out.add(pool.select(key, "embedding"), (found[0].to_pylist(), _unit(found[1], dims)), scorer)
    return out.ranked(key, k, merge=owner is not None)


def multivector_topk(query_vecs: DataFrame, rep_vecs: DataFrame, owner: str, k: int = 20, **kw) -> DataFrame:
    """R4. Fragments by their best vector."""
    return dense_topk(query_vecs, rep_vecs, k, owner=owner, **kw)


def bound_vectors(frags: DataFrame, reps: DataFrame) -> DataFrame:
    """R4. What is embedded for each fragment: its content unless it has passages, and every
    representation."""
    passages = reps.where("kind = 'PASSAGE'").select("fragment_id").distinct()
    content = frags.join(passages, "fragment_id", "left_anti").select(
        "fragment_id", F.lit(0).cast("bigint").alias("ordinal"), F.lit("CONTENT").alias("kind"), F.col("content").alias("text"))
    return content.unionByName(reps.select("fragment_id", "ordinal", "kind", "text"))


def rrf(ranked: DataFrame, c: int = 60, k: int = 5, by: str = "fragment_id") -> DataFrame:
    """R6. Reciprocal rank fusion of ``ranked(query_id, route, <by>, rank)``; a query with one
    route keeps that route's order."""
    if not 1 <= c <= 1000:
        raise ValueError("c must be 1..1000")
    s = ranked.groupBy("query_id", by).agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 12).alias("score"))
    return rank_topk(s, ["query_id"], [F.desc("score"), F.asc(by)], k)


def fuse_queries(ranked: DataFrame, k: int = 20, c: int = 1, first_weight: float = 2.0, by: str = "fragment_id") -> DataFrame:
    """R7. Fusion over query rewrites: route 0 is the original query with its own weight; only
    an id's first rank within a route counts, the ranks of the others stay as they are."""
    first = ranked.groupBy("query_id", "route", by).agg(F.min("rank").alias("rank"))
    w = F.when(F.col("route") == 0, F.lit(first_weight)).otherwise(1.0)
    s = first.groupBy("query_id", by).agg(F.round(F.sum(w / (c + F.col("rank"))), 12).alias("score"))
    return rank_topk(s, ["query_id"], [F.desc("score"), F.asc(by)], k)


def verify_hits(hits: DataFrame, frags: DataFrame, eligible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R9. Hits whose revision is still published and matching, with unchanged content, first
    occurrence only; and the hits whose content differs from its source."""
    j = hits.join(frags.select("fragment_id", "revision_id", F.col("content_hash").alias("source_hash")), "fragment_id")
    j = j.join(eligible.select("revision_id"), "revision_id", "left_semi")
    same = F.col("content_hash") == F.col("source_hash")
    ok = j.where(same).groupBy("query_id", "fragment_id", "revision_id").agg(F.min("rank").alias("rank"))
    return ok, j.where(~same).select("query_id", "fragment_id", "rank")


def pack_budget(hits: DataFrame, max_bytes: int = 49152, k: int = 5, by: str = "fragment_id") -> DataFrame:
    """R10. In rank order take what still fits, skip what does not, stop at k.

    ``hits(query_id, <by>, rank, bytes)`` are ranked candidates, at most a few dozen per query,
    so folding one query's list is bounded."""
    init = F.struct(F.lit(0).cast("bigint").alias("b"), F.array().cast("array<bigint>").alias("take"))

    def step(a: Column, x: Column) -> Column:
        fit = (a["b"] + x["bytes"] <= max_bytes) & (F.size(a["take"]) < k)
        return F.struct(
            F.when(fit, a["b"] + x["bytes"]).otherwise(a["b"]).alias("b"),
            F.when(fit, F.concat(a["take"], F.array(x["rank"]))).otherwise(a["take"]).alias("take"))

    g = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), F.col(by).alias("id"),
                                             F.col("bytes").cast("bigint").alias("bytes")))).alias("xs"))
    g = g.withColumn("take", F.aggregate("xs", init, step, lambda a: a["take"]))
    kept = F.filter("xs", lambda x: F.array_contains(F.col("take"), x["rank"]))
    return g.select("query_id", F.posexplode(kept).alias("i", "x")).select(
        "query_id", F.col("x.id").alias(by), F.col("x.rank").alias("rank"),
        (F.col("i") + 1).cast("bigint").alias("position"), F.col("x.bytes").alias("bytes"))


def expand_neighbours(hits: DataFrame, links: DataFrame, roots: int = 8, max_extra: int = 8) -> DataFrame:
    """R11. Fragments related to the first hits, in (hit rank, link) order, new ones only. The first
    hits are those of the first positions: ranks may have holes where hits were refused."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))  # hits of a query are at most k
    top = hits.withColumn("_place", place).where(F.col("_place") <= roots).select("query_id", F.col("fragment_id"), "rank")
    cand = top.join(links, "fragment_id").select(
        "query_id", F.col("related").alias("fragment_id"), F.struct("rank", "ordinal").alias("o"))
    new = cand.join(hits.select("query_id", "fragment_id"), ["query_id", "fragment_id"], "left_anti")
    one = new.groupBy("query_id", "fragment_id").agg(F.min("o").alias("o"))
    return rank_topk(one, ["query_id"], [F.asc("o")], max_extra, "extra").select(
        "query_id", "fragment_id", "extra", F.col("o.rank").alias("root_rank"))


def apply_selection(selection: DataFrame, cands: DataFrame, limit: int = 8, max_bytes: int = 49152) -> tuple[DataFrame, DataFrame]:
    """R12. A chosen ordered id list per query: the packed rows of valid lists, and the reason
    why the others are refused (empty, too long, repeated or unknown ids)."""
    ids = selection.select("query_id", F.posexplode_outer("ids").alias("pos", "fragment_id"))
    j = ids.join(cands.select("query_id", "fragment_id", "bytes"), ["query_id", "fragment_id"], "left")
    s = j.groupBy("query_id").agg(
        F.count("fragment_id").alias("n"), F.countDistinct("fragment_id").alias("d"),
        F.count_if(F.col("fragment_id").isNotNull() & F.col("bytes").isNull()).alias("unknown"))
    s = s.withColumn("reason", F.when(F.col("n") == 0, "EMPTY").when(F.col("n") > limit, "TOO_MANY")
                     .when(F.col("d") < F.col("n"), "REPEATED").when(F.col("unknown") > 0, "UNKNOWN_ID"))
    bad = s.where(F.col("reason").isNotNull()).select("query_id", "reason")
    good = j.join(bad, "query_id", "left_anti").where(F.col("bytes").isNotNull())
    return pack_budget(good.withColumn("rank", F.col("pos") + 1), max_bytes, limit), bad


def citations(hits: DataFrame, frags: DataFrame, revs: DataFrame) -> DataFrame:
    """R13. Citation rows; the device snapshot is named only for device-scoped revisions."""
    j = hits.join(frags.select("fragment_id", "revision_id", "section", "content_hash"), "fragment_id").join(revs, "revision_id")
    return j.select(
        "query_id", "rank", "document_id", "revision_id", "fragment_id", "title", "source", "section", "content_hash",
        F.format_string("/v1/knowledge/revisions/%s/fragments/%s", F.col("revision_id").cast("string"),
                        F.col("fragment_id").cast("string")).alias("url"),
        F.when(F.col("scope") == "DEVICE", F.col("snapshot_id")).otherwise("").alias("device_snapshot_id"))


def embedding_text(title: Column, section: Column, cleaned: Column) -> Column:
    """R5. What the encoder reads for a fragment."""
    return F.concat_ws("\n", title, section, cleaned)


def refused_texts(texts: DataFrame, max_chars: int = 32000) -> DataFrame:
    """R5. ``id, reason`` of the texts that an encoder doesn't take: ``EMPTY`` (null, too) or ``TOO_LONG``."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return texts.select("id", F.when(n == 0, "EMPTY").when(n > max_chars, "TOO_LONG").alias("reason")).where("reason IS NOT NULL")


def embed(texts: DataFrame, encoder, dims: int, batch: int = 64, max_chars: int = 32000) -> DataFrame:
    """R5. ``id, text`` to ``id, embedding`` with a caller-supplied ``encoder(list[str]) -> array``.

    The encoder object is shipped once per task and called on batches of at most ``batch`` texts of 1 to
    ``max_chars`` characters; ``refused_texts`` has the others. Results are scaled to unit length."""
    schema = T.StructType([texts.schema["id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                v = np.asarray(encoder(part.column(1).to_pylist()), dtype=np.float64).reshape(part.num_rows, dims)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = (v / np.where(norm == 0, 1, norm)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", "text").where(F.length("text").between(1, max_chars)).mapInArrow(run, schema)
