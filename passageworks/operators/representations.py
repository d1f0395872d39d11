"""What is embedded of each fragment, built from its content and its representations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from passageworks.functions.text import let, strip
from passageworks.operators.fragments import bounded_section

Offsets = Callable[[list[str]], list[list[tuple[int, int]]]]  # of each text the tokens' starts and ends, in characters

# Tokens of a window with its prefix, the least budget, overlaps of representations and of content, most
# representations of a fragment.
WINDOW_TOKENS, LEAST_BUDGET, REP_OVERLAP, CONTENT_OVERLAP, MOST = 480, 128, 32, 64, 32


def _with_arrow(df: DataFrame, field: str, schema: str, make: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with one more column made of each Arrow batch."""
    kind = T._parse_datatype_string(schema)
    to = T.StructType([*df.schema.fields, T.StructField(field, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(make(b), to_arrow_type(kind))], [*b.schema.names, field])

    return df.mapInArrow(run, to)


def count_tokens(df: DataFrame, text: str, name: str, tokenizer: Offsets | None = None) -> DataFrame:
    """``df`` with the number of tokens of a text column; without a tokenizer, tokens are runs of other than white space."""
    if tokenizer is None:
        return df.withColumn(name, F.size(F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), F.lit(1))))
    return _with_arrow(df, name, "int", lambda b: [len(x) for x in tokenizer([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()])])


def _cuts(offsets: list[tuple[int, int]], text: str, budget: int, overlap: int) -> list[str]:
    if len(offsets) <= budget:
        return [text]
    out, start = [], 0
    while True:
        end = min(start + budget, len(offsets))
        out.append(text[offsets[start][0]:offsets[end - 1][1]].strip())
        if end == len(offsets):
            return [x for x in out if x]
        start = max(start + 1, end - overlap)


def windows(texts: DataFrame, overlap: int, tokenizer: Offsets | None = None) -> DataFrame:
    """``texts`` (with ``text`` and ``budget``) and ``windows``: the text itself if its tokens are within the budget, otherwise
    overlapping windows of so many tokens, cut at token borders. Repeated windows stay. A null text counts as empty.

    ``tokenizer`` maps texts to token offsets in characters and is called with a batch of texts inside the tasks."""
    t = texts.withColumn("text", F.coalesce("text", F.lit("")))
    if tokenizer is not None:
        def make(b: pa.RecordBatch) -> list:
            own, budget = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "budget"))
            return [_cuts(o, x, n, overlap) for o, x, n in zip(tokenizer(own), own, budget)]

        return _with_arrow(t, "windows", "array<string>", make)
    size = F.col("budget")
    step = F.greatest(size - overlap, F.lit(1))

    def cut(ts: Column) -> Column:
        n = F.size(ts)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: strip(F.array_join(F.slice(ts, k * step + 1, size), "")))
        return F.when(n <= size, F.array("text")).otherwise(F.filter(parts, lambda w: w != ""))

    return t.withColumn("windows", let(F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1)), cut))


def representations(
    frags: DataFrame, reps: DataFrame, tokenizer: Offsets | None = None, window_tokens: int = WINDOW_TOKENS,
    least_budget: int = LEAST_BUDGET, most: int = MOST,
) -> DataFrame:
    """``fragment_id, ordinal, kind, text, over_limit``: the representations of each fragment, windowed.

    ``frags(fragment_id, title, section, content)``, ``reps(fragment_id, ordinal, kind, text)``. A window has
    ``window_tokens`` less those of the fragment's prefix (title and bounded section, a line each), at least ``least_budget``.
    Representations of another kind than PASSAGE are cut into windows that overlap by 32 tokens; content that needs more than
    one window (overlapping by 64) gives the PASSAGE rows behind them. Of rows with equal kind and text the first stays.
    ``over_limit`` marks fragments with more than ``most``, which keep all of them."""
    prefix = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), bounded_section(F.coalesce("section", F.lit(""))), F.lit("\n"))
    f = count_tokens(frags.select("fragment_id", "content", prefix.alias("prefix")), "prefix", "n", tokenizer)
    f = f.select("fragment_id", "content", F.greatest(F.lit(least_budget), F.lit(window_tokens) - F.col("n")).cast("int").alias("budget"))
    own = reps.where("kind <> 'PASSAGE'").join(f.select("fragment_id", "budget"), "fragment_id")
    own = windows(own.select("fragment_id", "ordinal", "kind", "text", "budget"), REP_OVERLAP, tokenizer)
    own = own.select("fragment_id", F.lit(0).alias("after"), F.col("ordinal").cast("long").alias("at"), "kind", F.posexplode("windows").alias("k", "text"))
    content = windows(f.select("fragment_id", F.col("content").alias("text"), "budget"), CONTENT_OVERLAP, tokenizer).where(F.size("windows") > 1)
    content = content.select("fragment_id", F.lit(1).alias("after"), F.lit(0).cast("long").alias("at"), F.lit("PASSAGE").alias("kind"), F.posexplode("windows").alias("k", "text"))
    one = own.unionByName(content).groupBy("fragment_id", "kind", "text").agg(F.min(F.struct("after", "at", "k")).alias("place"))
    mine = W.partitionBy("fragment_id")  # a fragment's rows, bounded by its bytes
    return one.select("fragment_id", F.row_number().over(mine.orderBy("place", "kind", "text")).cast("long").alias("ordinal"), "kind", "text",
                      (F.count("*").over(mine) > most).alias("over_limit"))
