"""Removal of repeated word windows by level-wise doubling.

A window is ``window`` consecutive words of one text; each word covered by a window that also starts in a
document of a smaller id is removed. A window can only repeat if its parts do, so windows grow by levels: those
of a first length that are seen in one document only are out; of the others' neighbours, windows of twice the
length are built and looked at again, until the wanted length is reached or none survives.

1. Texts are written once as chunks of words, bucketed by chunk, so that no later step moves text.
2. At each level a chunk hashes the windows whose two halves survived (their hash is made of the halves'
   hashes) and sends every value once, to buckets by value. A bucket answers with one bit for each value:
   whether another text has it as well. These hashes are as short as the corpus allows; a collision only keeps a window alive.
3. At the last level 128 bits are compared, with the smallest id of each value in its chunk; the bit says whether a
   smaller one exists. No collision of 128 bits is expected below some 10**18 windows.
4. Each chunk marks the words that its answers name.

A value travels once per chunk whatever its number of places, so a passage in a third of all texts is one
entry per chunk. Windows of a few words repeat in any corpus, which makes early levels useless; the first length
is therefore half the window unless told otherwise."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.functions.scale import shared_folder
from passageworks.llm.anchors import CHUNK, hashes, mixed, prefixes
from passageworks.llm.base import parts, stored

WINDOW, CHUNK_BYTES, BUCKET_VALUES = 13, 4 << 20, 4 << 20
U = np.uint64
STEP = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]


def lengths(window: int, first: int | None = None) -> list[int]:
    """The lengths of the levels: the first one doubled until the window's is reached."""
    out = [min(window, first or -(-window // 2))]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """A table bucketed by chunk: ids, rows and word counts of some texts, and their words, one space between any two."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            ids, rows, counts, texts = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0]], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in (ids, rows, counts)], pa.array([sum(counts)], pa.int64()),
                 pa.array([b" ".join(t for t in texts if t)], pa.binary())], ["chunk", "ids", "rows", "counts", "n_words", "data"])

        for b in batches:
            for i, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
                w = (t or b"").split()  # of bytes: at ASCII white space only
                t = b" ".join(w)
                if held and size + len(t) > chunk_bytes:
                    yield out()
                    held, size = [], 0
                held.append((i, r, len(w), t))
                size += len(t) + 1
        if held:
            yield out()

    spark = docs.sparkSession
    name = f"words_{uuid.uuid4().hex}"
    packed = d.mapInArrow(pack, "chunk long, ids array<long>, rows array<long>, counts array<long>, n_words long, data binary")
    packed.write.bucketBy(parts(spark), "chunk").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved from here on; the catalog needn't keep the name
    spark.sql(f"DROP TABLE {name}")
    return table


def word_hashes(data: np.ndarray, which: int) -> np.ndarray:
    """A hash of every word of a chunk's bytes."""
    if not len(data):
        return np.empty(0, np.uint64)
    gap = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gap + 1]), np.append(gap, len(data))
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # whole words of about CHUNK bytes at once
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + CHUNK, side="right")))
        p = prefixes(data[base:end[to - 1]], which)
        out[at:to] = mixed(hashes(p, start[at:to] - base, end[at:to] - base, which) + STEP[which] * (end[at:to] - start[at:to]).astype(np.uint64))
        at = to
    return out


def grown(h: np.ndarray, length: int, to: int, which: int) -> np.ndarray:
    """Hashes of the windows of ``to`` words from those of ``length`` words, of which two cover one."""
    n = max(len(h) - (to - length), 0)
    return mixed(h[:n] * STEP[which] + h[to - length:to - length + n]) if to > length else h


def grown_from_words(data: np.ndarray, to: int, which: int) -> np.ndarray:
    h, length = word_hashes(data, which), 1
    while length < to:
        h, length = grown(h, length, min(2 * length, to), which), min(2 * length, to)
    return h


def packed(x: np.ndarray) -> tuple[int, int, bytes]:
    """Least value, bytes a value, and the values above the least as byte planes; the upper planes compress well."""
    if not len(x):
        return 0, 0, b""
    low = x.min()
    over = (x - low).astype(np.uint64)
    width = max(1, -(-int(over.max()).bit_length() // 8))
    return int(low), width, over.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(low: int, width: int, planes: bytes, kind) -> np.ndarray:
    n = len(planes) // width if width else 0
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    over = out.reshape(-1).view(np.uint64)
    return (over + U(low)) if kind is np.uint64 else over.astype(np.int64) + low


class Windows:
    """The windows of one chunk through the levels. ``answers`` has the answer bits of earlier levels: length -> bits
    of the level's values in ascending order."""

    def __init__(self, c, levels: list[int], bits: int):
        self.levels, self.bits = levels, bits
        self.data = np.frombuffer(c["data"], np.uint8)
        self.counts = np.asarray(c["counts"], np.int64)
        ids = [None if x is None or x != x else int(x) for x in c["ids"]]
        self.known = np.array([x is not None for x in ids], bool)
        self.ids = np.array([x or 0 for x in ids], np.int64)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(self.owner))
        self.left[~self.known[self.owner]] = 0  # texts without an id take no part
        self.alive = self.left > 0
        self.h, self.length = None, 1

    def grow(self, to: int) -> None:
        self.h = grown_from_words(self.data, to, 0) if self.h is None else grown(self.h, self.length, to, 0)
        n, gap = len(self.h), to - self.length
        self.alive = self.alive[:n] & (self.left[:n] >= to) & (self.alive[gap:gap + n] if self.length > 1 else True)
        self.length = to

    def runs(self):
        """Places of the surviving windows in order of their values, and where each value's run starts."""
        at = np.flatnonzero(self.alive)
        v = self.h[at] if self.length == self.levels[-1] else self.h[at] >> U(64 - self.bits)
        if self.length == self.levels[-1]:
            w = grown_from_words(self.data, self.length, 1)[at]
            o = np.lexsort((w, v))
            v, w = v[o], w[o]
            new = np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1]))[:len(v)]
            start = np.flatnonzero(new)
            return at[o], start, v[start], w[start]
        o = np.argsort(v, kind="stable")
        v = v[o]
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1])[:len(v)])
        return at[o], start, v[start], None

    def through(self, answers: dict[int, np.ndarray], stop: int) -> None:
        """Replay the levels below ``stop``: what survives is what another text has too."""
        for length in self.levels:
            if length >= stop:
                break
            self.grow(length)
            at, start, _, _ = self.runs()
            if not len(start):
                continue
            self.alive[at] = np.repeat(answers[length], np.diff(np.append(start, len(at)))) if length in answers else False


def _answers(r: pd.DataFrame) -> dict[int, np.ndarray]:
    out = {}
    for length, g in r.groupby("length"):
        g = g.sort_values("bucket")
        out[int(length)] = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(g["bits"], g["n"])]).astype(bool)
    return out


MESSAGE = "bucket long, chunk long, n int, v0 decimal(20,0), vw int, v binary, w binary, i0 long, iw int, i binary"
NAMES = ["bucket", "chunk", "n", "v0", "vw", "v", "w", "i0", "iw", "i"]
ANSWER = "chunk long, bucket long, length int, n int, bits binary, alive long"


def _messages(c, x: Windows, length: int, buckets: int, bits: int) -> list[tuple]:
    x.grow(length)
    last = length == x.levels[-1]
    at, start, v, w = x.runs()
    if not len(v):
        return []
    high = v >> U(32) if last else v >> U(bits - 32)
    bucket = ((high * U(buckets)) >> U(32)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    end = np.append(start[1:], len(at))
    low = np.minimum.reduceat(x.ids[x.owner[at]], start) if last else None
    many = None if last else x.owner[at[start]] != x.owner[at[end - 1]]  # in several texts of this chunk
    out = []
    for a, b in zip(cut, np.append(cut[1:], len(v))):
        step = np.diff(v[a:b], prepend=v[a:a + 1])  # ascending, so the gaps are small
        _, vw, planes = packed(np.append(step, U(0)))  # the appended 0 makes the least value 0
        i0, iw, ids = packed(low[a:b]) if last else (0, 0, b"")
        out.append((int(bucket[a]), int(c["chunk"]), int(b - a), int(v[a]), vw, planes, w[a:b].tobytes() if last else np.packbits(many[a:b]).tobytes(), i0, iw, ids))
    return out


def _values(p: pd.DataFrame) -> list[np.ndarray]:
    out = []
    for n, v0, vw, planes in zip(p["n"], p["v0"], p["vw"], p["v"]):
        step = unpacked(0, int(vw), planes, np.uint64)[:int(n)]
        out.append(np.cumsum(step, dtype=np.uint64) + U(int(v0)))
    return out


def level(chunks: DataFrame, answers: DataFrame | None, levels: list[int], length: int, buckets: int, bits: int) -> DataFrame:
    """One level's answers: for each chunk and bucket one bit a value, and how many are set."""
    last = length == levels[-1]
    if answers is None:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.decimal128(20, 0), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            for b in batches:
                for c in b.to_pylist():
                    rows = [(*r[:3], Decimal(r[3]), *r[4:]) for r in _messages(c, Windows(c, levels, bits), length, buckets, bits)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], NAMES)

        sent = chunks.mapInArrow(send, MESSAGE)
    else:
        def find(key, c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(c):
                return pd.DataFrame([], columns=NAMES)
            c = c.iloc[0]
            x = Windows(c, levels, bits)
            x.through(_answers(r), length)
            return pd.DataFrame([(*m[:3], Decimal(m[3]), *m[4:]) for m in _messages(c, x, length, buckets, bits)], columns=NAMES)

        sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(find, MESSAGE)

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        v = _values(p)
        cut = np.cumsum([len(x) for x in v])[:-1]
        v = np.concatenate(v)
        if last:
            w = np.concatenate([np.frombuffer(x, np.uint64) for x in p["w"]])
            i = np.concatenate([unpacked(int(i0), int(iw), x, np.int64) for i0, iw, x in zip(p["i0"], p["iw"], p["i"])])
            o = np.lexsort((w, v))
            v, w, i = v[o], w[o], i[o]
            start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            least = np.repeat(np.minimum.reduceat(i, start), np.diff(np.append(start, len(v))))
            hit = i > least
        else:
            o = np.argsort(v, kind="stable")
            v = v[o]
            same = v[1:] == v[:-1]
            hit = np.append(False, same) | np.append(same, False)
            hit |= np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(p["w"], p["n"])]).astype(bool)[o]
        back = np.empty(len(v), bool)
        back[o] = hit
        return pd.DataFrame([(int(k), int(b), length, len(x), np.packbits(x).tobytes(), int(x.sum())) for k, b, x in zip(p["chunk"], p["bucket"], np.split(back, cut))],
                            columns=["chunk", "bucket", "length", "n", "bits", "alive"])

    return sent.groupBy("bucket").applyInPandas(meet, ANSWER)


def dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", first: int | None = None, keep_text: bool = True,
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id, row, n_words, n_removed, kept_sha256)`` and, if asked for, ``kept`` (the words that are left, one space
    between any two), one row per input row; ``row`` numbers the rows of a table read from files.

    A null or blank text has no words. Rows of one id are not repeats of each other; rows without an id keep all
    words and make no others repeats. Only the id and text columns are read, so others may have any name. A text is
    never cut: the longest one must fit a task, with some 60 bytes a word. No rows: no rows."""
    spark = docs.sparkSession
    levels = lengths(window, first)
    chunks = chunked(docs, doc_id, text, chunk_bytes)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(32, min(64, int(total).bit_length() + 6))
    buckets = max(96, 8 * parts(spark), total // BUCKET_VALUES)
    told = None
    for length in levels:
        answers = level(chunks, told, levels, length, buckets, bits)
        answers = stored(answers, f"level{length}")
        told = answers if told is None else told.unionByName(answers)
        if not answers.agg(F.sum("alive")).first()[0]:
            break  # no window survives
    return _marked(chunks, told, levels, bits, keep_text)


def _marked(chunks: DataFrame, told: DataFrame, levels: list[int], bits: int, keep_text: bool) -> DataFrame:
    names = ["doc_id", "row", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    window = levels[-1]

    def mark(key, c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(c):
            return pd.DataFrame([], columns=names)
        c = c.iloc[0]
        answers = _answers(r)
        x = Windows(c, levels, bits)
        x.through(answers, window)
        x.grow(window)
        at, start, _, _ = x.runs()
        depth = np.zeros(len(x.owner) + 1, np.int32)
        if len(start):
            size = np.diff(np.append(start, len(at)))
            ids = x.ids[x.owner[at]]
            gone = np.repeat(np.minimum.reduceat(ids, start), size) < ids
            if window in answers:
                gone |= np.repeat(answers[window], size)
            s = at[gone]
            depth[s] += 1  # a place starts one window only, and ends one
            depth[s + window] -= 1
        removed = np.cumsum(depth[:-1]) > 0
        words = c["data"].split(b" ") if len(c["data"]) else []
        rows, a = [], 0
        for k, (row, n) in enumerate(zip(c["rows"], x.counts.tolist())):
            out = removed[a:a + n]
            kept = b" ".join(words[a:a + n] if not out.any() else [w for w, gone in zip(words[a:a + n], out.tolist()) if not gone])
            rows.append((int(x.ids[k]) if x.known[k] else None, int(row), n, int(out.sum()), hashlib.sha256(kept).hexdigest(), *[kept.decode()] * keep_text))
            a += n
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        mark, "doc_id long, row long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
