"""Log files to pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Limits of one log file.
MAX_LINE, MAX_LINES, MAX_PAGES = 65_536, 2_000_000, 10_000


def log_lines(files: DataFrame) -> DataFrame:
    """``file_id, text`` to ``file_id, line_no, bytes, nul``; a line's size includes its end."""
    raw = F.regexp_extract_all("text", F.lit(r"([^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+)"), F.lit(1))
    x = files.select("file_id", F.posexplode_outer(raw).alias("i", "line"))
    return x.select("file_id", (F.coalesce("i", F.lit(0)) + 1).cast("bigint").alias("line_no"), F.coalesce(F.octet_length("line"), F.lit(0)).cast("bigint").alias("bytes"),
                    F.coalesce(F.contains("line", F.lit("\0")), F.lit(False)).alias("nul"))


def page_logs(lines: DataFrame, max_lines: int = 200, max_bytes: int = 524288) -> tuple[DataFrame, DataFrame]:
    """S9. Pages of each file: a page ends after ``max_lines`` lines or once it has ``max_bytes`` bytes.

    Files over the limits are refused first, so what is left of a file is at most two million small
    rows of (line, bytes). Those pass a task in order; only sums are kept between batches."""
    g = lines.groupBy("file_id").agg(F.count("*").alias("n"), F.max("bytes").alias("m"), F.bool_or("nul").alias("nul"))
    reason = F.when(F.col("nul"), "TEXT_DECODE_FAILED").when((F.col("m") > MAX_LINE) | (F.col("n") > MAX_LINES), "TEXT_EXPANSION_LIMIT")
    g = g.withColumn("reason", reason)
    ok = lines.join(g.where("reason IS NULL").select("file_id"), "file_id", "left_semi").select("file_id", "line_no", "bytes")
    fid = lines.schema["file_id"].dataType.simpleString()
    schema = f"file_id {fid}, page bigint, start_line bigint, end_line bigint, start_offset bigint, end_offset bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, page, line, start, offset, first = None, 0, 0, 0, 0, 1
        for b in batches:
            out = []
            for f, part in b.groupby("file_id", sort=False):
                if f != file:
                    if file is not None and line >= first:
                        out.append((file, page + 1, first, line, start, offset))
                    file, page, line, start, offset, first = f, 0, 0, 0, 0, 1
                size = part["bytes"].to_numpy()
                ends = offset + np.cumsum(size)
                at = 0
                while at < len(size):
                    by_count = at + max_lines - (line - first + 1)
                    by_bytes = int(np.searchsorted(ends, start + max_bytes)) + 1
                    stop = min(by_count, by_bytes)
                    if stop > len(size):
                        line, offset, at = line + len(size) - at, int(ends[-1]), len(size)
                        break
                    line, offset = line + stop - at, int(ends[stop - 1])
                    page += 1
                    out.append((file, page, first, line, start, offset))
                    start, first, at = offset, line + 1, stop
            yield pd.DataFrame(out, columns=["file_id", "page", "start_line", "end_line", "start_offset", "end_offset"])
        if file is not None and line >= first:
            yield pd.DataFrame([(file, page + 1, first, line, start, offset)], columns=["file_id", "page", "start_line", "end_line", "start_offset", "end_offset"])

    pages = ok.repartition("file_id").sortWithinPartitions("file_id", "line_no").mapInPandas(fold, schema)
    many = pages.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_PAGES).select("file_id", F.lit("TEXT_EXPANSION_LIMIT").alias("reason"))
    gaps = g.where("reason IS NOT NULL").select("file_id", "reason").unionByName(many)
    return pages.join(many.select("file_id"), "file_id", "left_anti"), gaps


def check_log_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """S10. Pages that do not continue the one before, and files not covered to their last line and byte.
    A file has at most 10,000 pages."""
    w = W.partitionBy("file_id").orderBy("page")
    p = pages.withColumn("pl", F.coalesce(F.lag("end_line").over(w), F.lit(0))).withColumn("po", F.coalesce(F.lag("end_offset").over(w), F.lit(0))).withColumn(
        "no", F.row_number().over(w))
    bad = p.where((F.col("page") != F.col("no")) | (F.col("start_line") != F.col("pl") + 1) | (F.col("start_offset") != F.col("po")) | (F.col("end_line") < F.col("start_line"))
                  | (F.col("end_offset") < F.col("start_offset")) | (F.col("end_offset") - F.col("start_offset") > 2_000_000)).select("file_id", "page", F.lit("GAP").alias("reason"))
    last = pages.groupBy("file_id").agg(F.max("end_line").alias("l"), F.max("end_offset").alias("o"))
    j = files.join(last, "file_id", "left").where(~((F.col("l") == F.col("line_count")) & (F.col("o") == F.col("bytes"))) | F.col("l").isNull())
    return bad.unionByName(j.select("file_id", F.lit(0).cast("bigint").alias("page"), F.lit("INCOMPLETE").alias("reason")))
