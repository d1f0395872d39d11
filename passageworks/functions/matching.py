"""Many strings looked for in many texts, where the texts are read.

The strings are cut by hash into shards of bounded size; each shard goes to all tasks as an Aho-Corasick automaton, which finds
all its strings in one pass over a text. Ids and the strings found leave the scan: no text is exchanged, and strings that begin alike
share their beginning instead of meeting every text that has it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BYTES = 4 << 20  # bytes of strings in one automaton, about; a longer single string is a shard of its own

_built: dict[str, ahocorasick.Automaton] = {}  # of a worker process: the automaton it built last


def _automaton(name: str, strings: list[str]) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for s in strings:
            if s:
                a.add_word(s, s)
        a.make_automaton()
        _built[name] = a
    return _built[name]


def occurrences(texts: DataFrame, strings: DataFrame, text_id: str, string_id: str, inside: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(<string_id>, <text_id>)``, once each: ``strings(<string_id>, text)`` that occur in ``texts(<text_id>, text)``.

    ``inside`` are characters of a token: an occurrence that begins or ends with such a character may not
    go on with one. The empty string is in every text; null texts and strings take no part."""
    spark = texts.sparkSession
    named = strings.where("text IS NOT NULL").select("text").distinct()
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    own = texts.where("text IS NOT NULL").select(text_id, "text")
    schema = T.StructType([own.schema[text_id], T.StructField("string", T.StringType())])
    token = frozenset(inside or "")
    scans = []
    for n in range(shards):
        rows = named.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == n).collect()  # of bounded size
        shared = spark.sparkContext.broadcast((uuid4().hex, [r["text"] for r in rows]))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _automaton(*shared.value)
            every = [s for s in shared.value[1] if s == ""]
            for b in batches:
                at, hit = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    seen = set(every)
                    for end, s in find.iter(t) if len(find) else ():
                        if s in seen:
                            continue
                        a, z = end - len(s), end + 1
                        if token and ((a >= 0 and t[a] in token and t[a + 1] in token) or (z < len(t) and t[z] in token and t[end] in token)):
                            continue
                        seen.add(s)
                    hit.extend(seen)
                    at.extend([i] * len(seen))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hit, pa.string())], [text_id, "string"])

        if rows:
            scans.append(own.mapInArrow(look, schema))
    found = reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], schema)
    return found.join(strings.select(string_id, F.col("text").alias("string")), "string").select(string_id, text_id).distinct()
