"""Hybrid search as one plan: eligible revisions, word and vector routes, fusion, verification, expansion by section,
packing with each document's context, citations (R1 to R13 put together)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.operators import retrieval as R
from passageworks.operators import text_index as TI
from passageworks.operators import vector_index as VI

# Hits of a search and their bytes; candidates of a selection, hits whose sections are looked at, and
# fragments that these may add.
TOP_K, MAX_BYTES, CANDIDATES, ROOTS, EXTRA = 5, 48 * 1024, 40, 8, 8


@dataclass
class Library:
    """``fragments(fragment_id, revision_id, section, content_hash, context_bytes)`` and ``revisions(revision_id, document_id,
    title, source, scope, snapshot_id, document_context)`` as published; ``indexed(fragment_id, content_hash)`` what the
    index was built of; ``links(fragment_id, related, ordinal)``; ``words`` and ``vectors`` (or ``embeddings(fragment_id,
    embedding)``, searched exactly)."""

    fragments: DataFrame
    revisions: DataFrame
    indexed: DataFrame
    links: DataFrame
    words: TI.TextIndex | None = None
    vectors: VI.VectorIndex | None = None
    embeddings: DataFrame | None = None


def routes(queries: DataFrame, lib: Library, eligible: DataFrame, k: int, probes: int = 8, dims: int = 64) -> DataFrame:
    """``query_id, route, fragment_id, rank``: the k best by words (route 0) and by vectors (route 1), eligible ones only. A library
    without one of the two has the other route alone."""
    found = []
    if lib.words is not None:
        found.append(TI.bm25(queries.select("query_id", "text"), lib.words, k, eligible=eligible).select("query_id", F.lit(0).alias("route"), "fragment_id", "rank"))
    own = lib.fragments.join(eligible.select("revision_id"), "revision_id", "left_semi").select("fragment_id")
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    if lib.vectors is not None:
        # what isn't eligible goes before the cut, as for the exact search
        index = VI.VectorIndex(lib.vectors.vectors.join(own, "fragment_id", "left_semi"), lib.vectors.centroids, "fragment_id")
        found.append(VI.search(asked, index, probes, k).select("query_id", F.lit(1).alias("route"), "fragment_id", "rank"))
    elif lib.embeddings is not None:
        found.append(R.dense_topk(asked, lib.embeddings, k, eligible=own, by="fragment_id", dims=dims).select("query_id", F.lit(1).alias("route"), "fragment_id", "rank"))
    if not found:
        raise ValueError("the library has neither words nor vectors")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def search(
    queries: DataFrame, lib: Library, eligible: DataFrame, top_k: int = TOP_K, route_k: int = 20, c: int = 60, max_bytes: int = MAX_BYTES,
    candidates: bool = False, probes: int = 8, dims: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Results and gaps of ``queries(query_id, text, embedding)`` over the revisions of ``eligible(revision_id)``.

    Results: ``query_id, position, fragment_id, revision_id, score, bytes, expanded`` and the citation's columns. Hits are
    fused from both routes, kept if what was indexed is still what is published, and packed in order as long as context and document context
    fit ``max_bytes``. With ``candidates`` up to ``CANDIDATES`` hits are kept whatever their bytes, and the sections of the first ``ROOTS`` (ancestors,
    then neighbours) add up to ``EXTRA`` fragments behind them.

    Gaps: ``query_id, reason`` of the queries without a result: ``NO_PUBLISHED_KNOWLEDGE`` (nothing eligible), ``OVER_BUDGET`` (no hit fits),
    ``CHANGED_SOURCE`` (all hits differ from their source) or ``NO_RETRIEVAL_HIT``."""
    limit = CANDIDATES if candidates else top_k
    eligible = eligible.select("revision_id").distinct()
    fused = R.rrf(routes(queries, lib, eligible, max(route_k, limit), probes, dims), c, limit)
    fused = TI.keep(fused, "fused")  # at most a few rows a query, read by every step below
    hits = fused.join(lib.indexed.select("fragment_id", "content_hash"), "fragment_id")
    good, changed = R.verify_hits(hits, lib.fragments, eligible)
    sizes = lib.fragments.join(lib.revisions.select("revision_id", "document_context"), "revision_id").select(
        "fragment_id", (F.col("context_bytes") + F.octet_length("document_context")).cast("long").alias("bytes"))
    ranked = good.select("query_id", "fragment_id", "rank").join(sizes, "fragment_id")
    if candidates:
        place = F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("long")  # of at most CANDIDATES rows
        hit = ranked.withColumn("position", place)
        extra = R.expand_neighbours(ranked, lib.links, ROOTS, EXTRA).join(sizes, "fragment_id")
        extra = extra.join(lib.fragments.join(eligible, "revision_id", "left_semi").select("fragment_id"), "fragment_id", "left_semi")
        count = hit.groupBy("query_id").agg(F.count("*").alias("n"))
        # places are given after the ineligible ones went
        behind = F.row_number().over(W.partitionBy("query_id").orderBy("extra"))
        extra = extra.join(count, "query_id").select("query_id", "fragment_id", F.lit(None).cast("bigint").alias("rank"), (F.col("n") + behind).cast("long").alias("position"), "bytes")
        placed = hit.select("query_id", "fragment_id", "rank", "position", "bytes").unionByName(extra)
    else:
        placed = R.pack_budget(ranked, max_bytes, top_k).select("query_id", "fragment_id", "rank", "position", "bytes")
    cited = R.citations(placed.select("query_id", "fragment_id", F.col("position").alias("rank")), lib.fragments, lib.revisions)
    cited = cited.withColumnRenamed("rank", "position")
    score = fused.select("query_id", "fragment_id", "score")
    out = cited.join(placed, ["query_id", "fragment_id", "position"]).join(score, ["query_id", "fragment_id"], "left")
    out = out.withColumn("expanded", F.col("rank").isNull()).drop("rank")
    empty = eligible.limit(1).count() == 0
    lost = changed.select("query_id").distinct().withColumn("changed", F.lit(True))
    large = ranked.select("query_id").distinct().withColumn("large", F.lit(True))
    gaps = queries.select("query_id").join(placed.select("query_id").distinct(), "query_id", "left_anti").join(lost, "query_id", "left").join(large, "query_id", "left")
    reason = F.lit("NO_PUBLISHED_KNOWLEDGE") if empty else F.when(F.col("large"), "OVER_BUDGET").when(F.col("changed"), "CHANGED_SOURCE").otherwise("NO_RETRIEVAL_HIT")
    return out, gaps.select("query_id", reason.alias("reason"))
