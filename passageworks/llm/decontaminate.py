"""Benchmark decontamination over a positional inverted index, as DataFrame operations only.

The index holds (row, position, term) of every corpus word that a benchmark item uses, and is written
once to the shared folder. Each window of an item (13 words in a row, or a whole shorter item) is
looked up by its two rarest terms in the corpus: the rarest term's postings, less the term's place
in the item, are the alignments where the item could lie in a text; those that the second rarest
term confirms are intersected with the postings of all other words of the item. Runs of matched
words that hold a whole window are hits. What a benchmark adds (its vocabulary, its windows) and the
alignments are broadcast behind a check of their row counts; beyond it the same joins shuffle, and are told to, for Spark would
go by the size of files in which a row takes three bytes. Of the postings only those of texts with a confirmed alignment are then shuffled
(by a hash of the row, so that what is broadcast stays bounded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.llm.base import own_names, stored

WINDOW = 13
BROADCAST_ROWS = 500_000  # rows of three to five numbers (or a word and a number) that a benchmark adds
CORPUS_ROWS = 100_000  # rows of up to six numbers that grow with the corpus
SLOTS = 1 << 20  # hashes of rows
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lowered, nothing else; lower() does just that for a text of single bytes, and faster."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table, to be broadcast if it has few rows (``BROADCAST_ROWS`` unless told otherwise), and never if it has more."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df.hint("merge")


def _of_rows(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of the texts in ``found``, and of a few others."""
    slot, = own_names("slot")
    at = F.pmod(F.xxhash64("row"), F.lit(SLOTS).cast("bigint")).alias(slot)
    return postings.select("*", at).join(F.broadcast(found.select(at).distinct()), slot, "left_semi").drop(slot)


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, size, ipos, word)``: the words of each benchmark row, ``item`` numbering rows."""
    b = benchmark.select("item_id", F.monotonically_increasing_id().alias("item"), words(F.col("text")).alias("ws"))
    return b.select("item", "item_id", F.size("ws").alias("size"), F.posexplode("ws").alias("ipos", "word"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, row, n_words, pos, term)``: postings of the vocabulary's words, and for each text one
    row at position 0 whatever its first word is (at no position if it has no word)."""
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("ws"))
    e = d.select("doc_id", "row", F.size("ws").alias("n_words"), F.posexplode_outer("ws").alias("pos", "word"))
    return e.join(_small(vocabulary), "word", "left").where("term IS NOT NULL OR pos IS NULL OR pos = 0").select("doc_id", "row", "n_words", "pos", "term")


def windows(items: DataFrame, frequency: DataFrame, width: int) -> DataFrame:
    """``(item, term, ipos, term2, ipos2)``: the rarest and the second rarest place of each window,
    each pair once. A window of one word has no second."""
    f = items.join(frequency, "term", "left").select("item", "size", "ipos", "term", F.coalesce("n", F.lit(0)).alias("n"))
    last = F.greatest(F.col("size") - width, F.lit(0))
    at = f.select("*", F.explode(F.sequence(F.greatest(F.col("ipos") - width + 1, F.lit(0)), F.least("ipos", last))).alias("start"))
    own = at.groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("n", "ipos", "term"))).alias("x"))  # at most ``width``
    # one occurrence of every term needed: a window with an absent term can't occur
    own = own.where(F.col("x")[0]["n"] > 0).withColumn("y", F.get("x", F.lit(1)))
    return own.select("item", F.col("x")[0]["term"].alias("term"), F.col("x")[0]["ipos"].alias("ipos"), F.col("y.term").alias("term2"), F.col("y.ipos").alias("ipos2")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(doc_id, row, n_words, n_hit, items, contaminated)``, one row per input row; ``row`` numbers the
    rows of a table read from files, ``items`` lists the ids of items with a window in the text,
    sorted as strings.

    A null text has no words. Items without words find nothing; rows of one item id are items of
    their own whose id is listed once; items of null id hit, but aren't listed. Empty tables: no
    rows, or no hits."""
    terms = stored(benchmark_terms(benchmark), "items")
    vocabulary = stored(terms.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    items = stored(terms.join(_small(vocabulary), "word").select("item", "item_id", "size", "ipos", "term"), "terms")
    index = stored(build_index(docs, vocabulary), "postings")
    postings = index.where("term IS NOT NULL").select("row", "pos", "term")
    frequency = stored(postings.groupBy("term").agg(F.count("*").alias("n")), "frequency")
    looked = stored(windows(items, _small(frequency), width), "windows")
    # the rarest term's postings, offset-adjusted
    first = postings.join(_small(looked), "term").select(
        "row", "item", (F.col("pos") - F.col("ipos")).alias("delta"), F.col("term2").alias("term"), (F.col("pos") - F.col("ipos") + F.col("ipos2")).alias("pos"))
    first = stored(first.distinct(), "alignments")
    second = looked.select(F.col("term2").alias("term")).where("term IS NOT NULL").distinct()
    two = postings.join(_small(second), "term", "left_semi").join(_small(first.where("term IS NOT NULL"), CORPUS_ROWS), ["row", "pos", "term"]).select("row", "item", "delta")
    found = stored(two.unionByName(first.where("term IS NULL").select("row", "item", "delta")).distinct(), "confirmed")
    # every word of the item, where it would lie
    every = found.join(_small(items), "item").select("row", "item", "delta", "size", (F.col("delta") + F.col("ipos")).alias("pos"), "term")
    every = stored(every.where("pos >= 0"), "expected")
    few = every.count() <= CORPUS_ROWS
    met = (postings if few else _of_rows(postings, found)).join(_small(every, CORPUS_ROWS), ["row", "pos", "term"])
    # islands of consecutive positions, at most an item long
    w = W.partitionBy("row", "item", "delta").orderBy("pos")
    runs = met.withColumn("island", F.col("pos") - F.row_number().over(w))
    runs = runs.withColumn("n", F.count("*").over(W.partitionBy("row", "item", "delta", "island"))).where(F.col("n") >= F.least("size", F.lit(width)))
    hits = runs.select("row", "item", "pos").distinct()
    names = items.select("item", F.col("item_id").cast("string").alias("name")).distinct()
    by_row = hits.select("row", "pos").distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    listed = hits.select("row", "item").distinct().join(_small(names), "item").groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("items"))
    result = stored(by_row.join(listed, "row"), "hits")
    head = index.where("pos IS NULL OR pos = 0").select("doc_id", "row", F.col("n_words").cast("bigint").alias("n_words"))
    out = head.join(_small(result, CORPUS_ROWS), "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
    return out.select("doc_id", "row", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The input rows that aren't contaminated, unchanged. ``docs`` is a table read from files."""
    row, = own_names("row")
    bad = stored(contamination(docs, benchmark, width).where("contaminated").select(F.col("row").alias(row)), "contaminated")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(_small(bad), row, "left_anti").drop(row)
