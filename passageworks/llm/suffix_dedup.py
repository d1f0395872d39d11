"""Removal of repeated passages by a hash-compared suffix sort.

A window is any ``WINDOW`` bytes of one text. Each byte that lies in a window which also starts earlier
(smaller id, or the same text further left) is removed. Corpora are far too large to sort all their
suffixes, and most can't repeat, so the sort is given those that may:

1. Texts are written once as chunks of a few MB, bucketed by chunk, so that no later step moves text.
2. Each chunk sends its distinct anchor hashes, once each and as short as the corpus allows, to buckets by hash; bits
   come back that say which are seen in more than one place. A collision only keeps an anchor.
3. A repeated anchor's piece (all bytes of its windows, about 130) goes, by hash and once per
   chunk, to the anchor's bucket. Of equal pieces all but the earliest are repeats as a whole. Where an anchor has
   unlike pieces, their earliest copies go on. Bits come back, in the order in which the chunk sent.
4. Those pieces' suffixes are sorted: first by eight bytes, ties by a bottom-up mergesort that compares two suffixes by
   a binary search over prefix polynomial hashes for their common extension. Suffixes that share a
   whole window are united when their runs meet, after a comparison of their bytes.
5. Each chunk marks the bytes that its answers name.

Messages carry each value once per chunk, so a passage in a third of all texts reaches a bucket as
one entry per chunk. Anchors in very many places are dealt by piece, and their windows in up to four parts by what the
windows of a part share: equal windows have their anchor at the same offset, so those of one part (offsets next to each
other) have a core of at least 83 bytes in common, and equal windows the same core. All
messages are packed arrays; what belongs to a chunk stays in its bucket. Nothing is sampled, capped or gathered on the driver."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from passageworks.functions.scale import shared_folder
from passageworks.llm.anchors import GRAM, LOW, SPAN, WINDOW, chunk_anchors, hashes, mixed, prefixes
from passageworks.llm.base import parts, stored

CHUNK_BYTES = 4 << 20
HOT = 4096  # places of an anchor beyond which its pieces are dealt apart
PART = 18  # offsets of an anchor in its window that are one part of a piece in very many places
LEAST_BUCKETS = 96
FIRST = -(1 << 63)
U = np.uint64


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """Written as a table bucketed by chunk."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts(spark), "chunk").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, rest: bool = False) -> DataFrame:
    """A bucketed table of chunks: ids, row numbers and byte sizes of some texts, and their bytes. A text is never
    cut; ``row`` numbers the rows of a table read from files. ``rest``: also whether each text is null, and the row's other columns as c0, c1, ..."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("text"),
                    *[F.struct(F.col(text).isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text]).alias("rest")] * rest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, others, size = [], [], 0

        def out():
            ids, rows, texts = zip(*held)
            # the first row's number is the chunk's
            columns = [pa.array([rows[0]], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([rows], pa.list_(pa.int64())),
                       pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())]
            if rest:
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(others)))
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "rows", "sizes", "data"] + ["rest"] * rest)

        for b in batches:
            own, at = b.column("rest") if rest else None, 0
            each = own.nbytes // max(1, len(own)) if rest else 0
            for k, (i, r, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist())):
                t = t or b""
                if held and size + len(t) + each > chunk_bytes:
                    if rest:
                        others.append(own.slice(at, k - at))
                        at = k
                    yield out()
                    held, others, size = [], [], 0
                held.append((i, r, t))
                size += len(t) + each
            if rest:
                others.append(own.slice(at))
        if held:
            yield out()

    kind = T.StructType.fromDDL("chunk long, ids array<long>, rows array<long>, sizes array<long>, data binary")
    return bucketed(d.mapInArrow(pack, kind.add("rest", T.ArrayType(d.schema["rest"].dataType)) if rest else kind), "chunks")


def _by_bucket(bucket: np.ndarray):
    """(bucket, from, to) of each bucket that occurs in a sorted array."""
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return zip(bucket[cut].tolist(), cut.tolist(), np.append(cut[1:], len(bucket)).tolist())


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _owners(column, width: int) -> np.ndarray:
    return np.repeat(np.arange(len(column)), [len(x) // width for x in column])


def _packed(x: np.ndarray) -> bytes:
    """Least value, and what the values have above it in byte planes, no more than needed."""
    if not len(x):
        return b""
    low = x.min()
    over = x.astype(np.uint64) - np.uint64(low.astype(np.uint64))
    width = max(1, -(-int(over.max()).bit_length() // 8))
    return low.astype(np.int64).tobytes() + bytes([width]) + over.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    if not x:
        return np.empty(0, np.int64)
    low, width = np.frombuffer(x[:8], np.int64)[0], x[8]
    out = np.zeros(((len(x) - 9) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8, offset=9).reshape(width, -1).T
    return (out.reshape(-1).view(np.uint64) + low.astype(np.uint64)).view(np.int64)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def _chunk_order(ids, rows, sizes) -> np.ndarray:
    """The place of each text of a chunk in the order of (id, row), nulls first."""
    i = np.array([FIRST if x is None or x != x else int(x) for x in ids], np.int64)
    return np.lexsort((np.asarray(rows, np.int64), i)).argsort(), i


def repeated_anchors(chunks: DataFrame, buckets: int, hot_places: int = HOT, width: int = 8) -> DataFrame:
    """``(chunk, bucket, many, hot)``: of the anchors of a chunk in a bucket, in order, bits that say which occur in more than one place.
    Their upper ``width`` bytes are compared."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, data in zip(b.column("chunk").to_pylist(), b.column("sizes").to_pylist(), b.column("data").to_pylist()):
                g, n = np.unique(chunk_anchors(np.frombuffer(data, np.uint8), np.array(sizes, np.int64))[0], return_counts=True)
                bucket = (g % U(buckets)).astype(np.int64)
                o = np.argsort(bucket, kind="stable")
                top, n = np.ascontiguousarray(g[o]).view(np.uint8).reshape(-1, 8)[:, 8 - width:], np.minimum(n[o], 1 << 30).astype(np.uint32)
                rows = [(k, top[at:to].tobytes(), n[at:to].tobytes()) for k, at, to in _by_bucket(bucket[o])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                                                  *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]], ["bucket", "chunk", "grams", "n"])

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        top, n = _joined(p["grams"], np.uint8).reshape(-1, width), _joined(p["n"], np.uint32)
        g = np.zeros((len(n), 8), np.uint8)
        g[:, 8 - width:] = top
        _, at = np.unique(g.reshape(-1).view(np.uint64), return_inverse=True)
        total = np.bincount(at, weights=n)[at]
        many, hot, rows, to = total > 1, total > hot_places, [], 0
        for chunk, bucket, x in zip(p["chunk"], p["bucket"], p["n"]):
            at, to = to, to + len(x) // 4
            if many[at:to].any():
                rows.append((chunk, bucket, _bits(many[at:to]), _bits(hot[at:to])))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "many", "hot"])

    sent = chunks.select("chunk", "sizes", "data").mapInArrow(send, "bucket int, chunk long, grams binary, n binary")
    return sent.groupBy("bucket").applyInPandas(meet, "chunk long, bucket int, many binary, hot binary")


def pieces(chunks: DataFrame, repeated: DataFrame, buckets: int, width: int = 8) -> DataFrame:
    """What chunks say of their repeated anchors, bucketed by chunk. Pieces are numbered in the order of their bucket, anchor and
    hash. A row of kind 0 is a chunk's own notes: start of every occurrence in that order, whether it is its piece's first, and
    each piece's number of windows; rows of kind 1 go to a bucket: the number of the first piece, anchors, piece
    hashes, id and row of the chunk's first occurrence of each, and whether the anchor is in very many places."""

    def find(key, c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "bucket", "chunk", "start", "a", "b", "c", "d", "e"]
        if not len(c) or not len(r):
            return pd.DataFrame([], columns=names)
        chunk, sizes = c["chunk"].iat[0], np.asarray(c["sizes"].iat[0], np.int64)
        rows = np.asarray(c["rows"].iat[0], np.int64)
        place, ids = _chunk_order(c["ids"].iat[0], rows, sizes)
        g, h, lo, n = chunk_anchors(np.frombuffer(c["data"].iat[0], np.uint8), sizes)
        distinct, at = np.unique(g, return_inverse=True)
        bucket = (distinct % U(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")  # as they were sent
        span = {k: (a, b) for k, a, b in _by_bucket(bucket[o])}
        many, very = np.zeros(len(o), bool), np.zeros(len(o), bool)
        for k, m, v in zip(r["bucket"], r["many"], r["hot"]):
            a, b = span[k]
            many[o[a:b]], very[o[a:b]] = _unbits(m, b - a), _unbits(v, b - a)
        keep = many[at]
        g, h, lo, n, hot = g[keep], h[keep], lo[keep], n[keep], very[at[keep]]
        text = np.searchsorted(np.cumsum(sizes), lo, side="right")
        bucket = (np.where(hot, mixed(h), g) % U(buckets)).astype(np.int64)
        o = np.lexsort((lo, place[text], h, g, bucket))
        g, h, lo, n, hot, text, bucket = g[o], h[o], lo[o], n[o], hot[o], text[o], bucket[o]
        new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))[:len(g)]
        f = np.flatnonzero(new)
        out = [(0, -1, chunk, 0, _packed(lo), _bits(new), n[f].astype(np.uint8).tobytes(), None, None)]
        top = np.ascontiguousarray(g[f]).view(np.uint8).reshape(-1, 8)[:, 8 - width:]
        for b, at, to in _by_bucket(bucket[f]):
            k = f[at:to]
            out.append((1, b, chunk, at, top[at:to].tobytes(), h[k].tobytes(), _packed(ids[text[k]]), _packed(rows[text[k]]), _bits(hot[k])))
        return pd.DataFrame(out, columns=names)

    c = chunks.select("chunk", "ids", "rows", "sizes", "data")
    return bucketed(c.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInPandas(
        find, "kind int, bucket int, chunk long, start long, a binary, b binary, c binary, d binary, e binary"), "pieces")


def judged_pieces(notes: DataFrame, width: int = 8) -> DataFrame:
    """``(chunk, start, whole, sort, hot)``: bits of the pieces from number ``start`` on, which repeat an earlier piece as a whole, and
    which have suffixes that must be sorted."""

    def judge(p: pd.DataFrame) -> pd.DataFrame:
        h, i, r = _joined(p["b"], np.uint64), np.concatenate([_unpacked(x) for x in p["c"]]), np.concatenate([_unpacked(x) for x in p["d"]])
        each = [len(x) // 8 for x in p["b"]]
        hot = np.concatenate([_unbits(x, n) for x, n in zip(p["e"], each)])
        g = np.zeros((len(h), 8), np.uint8)
        g[:, 8 - width:] = _joined(p["a"], np.uint8).reshape(-1, width)
        g = g.reshape(-1).view(np.uint64)
        o = np.lexsort((r, i, h, g))
        first = np.append(True, (g[o][1:] != g[o][:-1]) | (h[o][1:] != h[o][:-1]))[:len(g)]
        gram = np.cumsum(np.append(True, g[o][1:] != g[o][:-1])[:len(g)]) - 1
        unlike = np.bincount(gram, weights=first)[gram] > 1
        whole, sort = np.zeros(len(g), bool), np.zeros(len(g), bool)
        whole[o] = ~first
        sort[o] = first & (unlike | hot[o])
        rows, to = [], 0
        for chunk, start, n in zip(p["chunk"], p["start"], each):
            at, to = to, to + n
            if whole[at:to].any() or sort[at:to].any():
                rows.append((chunk, start, *[_bits(x[at:to]) if x[at:to].any() else b"" for x in (whole, sort, hot & sort)]))
        return pd.DataFrame(rows, columns=["chunk", "start", "whole", "sort", "hot"])

    return notes.where("kind = 1").groupBy("bucket").applyInPandas(judge, "chunk long, start long, whole binary, sort binary, hot binary")


def _numbers(start, bits) -> np.ndarray:
    """The numbers that bits name, each from its start on."""
    return np.concatenate([np.empty(0, np.int64), *[s + np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for s, x in zip(start, bits)]])


def _anchored(p: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the anchor of the window at each of ``lo`` begins, from there, and its hash."""
    at, gram = np.empty(len(lo), np.int64), np.empty(len(lo), np.uint64)
    for k in range(0, len(lo), 1 << 14):
        s = lo[k:k + (1 << 14), None] + np.arange(SPAN)
        g = mixed(hashes(p, s, s + GRAM))
        a = (g & ~LOW).argmin(axis=1)  # the leftmost of the least
        at[k:k + len(a)], gram[k:k + len(a)] = a, g[np.arange(len(a)), a]
    return at, gram


def hot_parts(p: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces in very many places: index of the piece, first window, number of windows and hash of the core of each part. A piece's
    windows have the offsets anchor, anchor - 1, ...; a part has those between two multiples of PART."""
    top = anchor // PART
    each = top - (anchor - n + 1) // PART + 1
    which = np.repeat(np.arange(len(lo)), each)
    k = top[which] - (np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each))
    a, begin = anchor[which], lo[which] + anchor[which] - k * PART
    first = np.maximum(a - ((k + 1) * PART - 1), 0)
    m = np.minimum(a - k * PART, n[which] - 1) - first + 1
    return which, first, m, mixed(hashes(p, begin, begin + WINDOW - PART + 1) + k.astype(np.uint64))


def with_notes(chunks: DataFrame, notes: DataFrame, *columns: str, how: str = "left") -> DataFrame:
    """Chunks with what they noted, which lies in the same bucket."""
    own = notes.where("kind = 0").select("chunk", F.col("a").alias("lo"), F.col("b").alias("new"), F.col("c").alias("n"))
    return chunks.select("chunk", "rows", "sizes", "data", *columns).join(own, "chunk", how)


def _notes(lo: bytes, new: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all occurrences, the index of each piece's first one, and the pieces' numbers of windows."""
    lo = _unpacked(lo)
    return lo, np.flatnonzero(_unbits(new, len(lo))), np.frombuffer(n, np.uint8).astype(np.int64)


def sorted_pieces(chunks: DataFrame, notes: DataFrame, judged: DataFrame, buckets: int) -> DataFrame:
    """``(chunk, number, at, n, repeats)``: of pieces with windows that repeat an earlier one: the first window looked at, how many
    were, and a bit for each."""
    asked = judged.where(F.octet_length("sort") > 0).select("chunk", "start", "sort", "hot")

    def cut(key, c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "chunk", "data", "n", "number", "ids", "rows", "first", "at"]
        if not len(c) or not len(r):
            return pd.DataFrame([], columns=names)
        chunk, sizes, rows = c["chunk"].iat[0], np.asarray(c["sizes"].iat[0], np.int64), np.asarray(c["rows"].iat[0], np.int64)
        data = np.frombuffer(c["data"].iat[0], np.uint8)
        _, ids = _chunk_order(c["ids"].iat[0], rows, sizes)
        lo, f, n = _notes(c["lo"].iat[0], c["new"].iat[0], c["n"].iat[0])
        want = _numbers(r["start"], r["sort"])
        hot = np.isin(want, _numbers(r["start"], r["hot"]))
        lo, n = lo[f[want]], n[want]  # a piece's first occurrence in the chunk
        p = prefixes(data)
        anchor, gram = _anchored(p, lo)
        bucket = (gram % U(buckets)).astype(np.int64)
        which, first = np.arange(len(want)), np.zeros(len(want), np.int64)
        if hot.any():
            some = np.flatnonzero(hot)
            w, start, m, core = hot_parts(p, lo[some], n[some], anchor[some])
            which = np.concatenate([np.flatnonzero(~hot), some[w]])
            first, n = np.concatenate([np.zeros((~hot).sum(), np.int64), start]), np.concatenate([n[~hot], m])
            bucket = np.concatenate([bucket[~hot], (core % U(buckets)).astype(np.int64)])
        lo, want = lo[which], want[which]
        text = np.searchsorted(np.cumsum(sizes), lo, side="right")
        at = lo - (np.cumsum(sizes) - sizes)[text] + first
        o = np.argsort(bucket, kind="stable")
        out = []
        for b, x, y in _by_bucket(bucket[o]):
            k = o[x:y]
            out.append((b, chunk, b"".join(data[s:s + m].tobytes() for s, m in zip((lo + first)[k].tolist(), (n[k] + WINDOW - 1).tolist())), n[k].astype(np.uint8).tobytes(),
                        _packed(want[k]), _packed(ids[text[k]]), _packed(rows[text[k]]), first[k].astype(np.uint8).tobytes(), _packed(at[k])))
        return pd.DataFrame(out, columns=names)

    def order(p: pd.DataFrame) -> pd.DataFrame:
        data, n = _joined(p["data"], np.uint8), _joined(p["n"], np.uint8).astype(np.int64)
        first, own = _joined(p["first"], np.uint8), _owners(p["n"].tolist(), 1)
        number, ids, rows, at = [np.concatenate([_unpacked(x) for x in p[k]]) for k in ("number", "ids", "rows", "at")]
        size = n + WINDOW - 1
        piece = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(size) - size)[piece] + offset
        rank = np.lexsort((at[piece] + offset, rows[piece], ids[piece])).argsort()
        flag = repeats(data, start, rank)
        some = np.flatnonzero(np.bincount(piece, weights=flag, minlength=len(n)))
        told = np.zeros(len(n), bool)
        told[some] = True
        flag = flag[told[piece]]
        begin = np.cumsum(n[some]) - n[some]
        out = []
        for k, x, y in _by_bucket(own[some]):
            s = some[x:y]
            out.append((p["chunk"].iat[k], _packed(number[s]), first[s].tobytes(), n[s].astype(np.uint8).tobytes(), _bits(flag[begin[x]:begin[y - 1] + n[some[y - 1]]])))
        return pd.DataFrame(out, columns=["chunk", "number", "at", "n", "repeats"])

    sent = with_notes(chunks, notes, "ids", how="inner").groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(
        cut, "bucket int, chunk long, data binary, n binary, number binary, ids binary, rows binary, first binary, at binary")
    return sent.groupBy("bucket").applyInPandas(order, "chunk long, number binary, at binary, n binary, repeats binary")


def repeats(data: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix of ``data`` (by start): do its first ``WINDOW`` bytes also start at a suffix of smaller rank?

    Sorted by the first eight bytes; suffixes that agree in those are merged bottom-up. A merge
    places every suffix in the neighbouring run by binary search, comparing by hashes; of two that
    share the window the later is marked and leaves the sort."""
    n = len(start)
    flag = np.zeros(n, bool)
    if not n:
        return flag
    p = prefixes(data)
    whole = hashes(p, start, start + WINDOW)
    head = np.lib.stride_tricks.sliding_window_view(data, 8)[start].copy().view(">u8").ravel()
    e = np.argsort(head, kind="stable")
    group = np.cumsum(np.append(True, head[e][1:] != head[e][:-1])) - 1
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    run = np.arange(n)  # run of each suffix inside its group; runs of a group are numbered without gaps
    run = run - run[np.searchsorted(group, group)]
    while True:
        # groups of one run are sorted
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        many = np.repeat(run[last] > 0, np.diff(np.append(-1, last)))
        e, group, run = e[many], group[many], run[many]
        if not len(e):
            return flag
        key = np.stack([group, run])
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        length = np.diff(np.append(first, len(e)))
        mine = np.repeat(np.arange(len(first)), length)
        # the neighbouring run: the next one for even runs, the one before for odd
        even = run % 2 == 0
        other = np.where(even, mine + 1, mine - 1)
        there = (other < len(first)) & (group[first[np.minimum(other, len(first) - 1)]] == group)
        other = np.where(there, other, mine)
        lo, hi = first[other].copy(), np.where(there, first[other] + length[other], first[other])
        begin, same = lo.copy(), np.full(len(e), -1)
        while True:
            act = np.flatnonzero(lo < hi)
            if not len(act):
                break
            mid = (lo[act] + hi[act]) // 2
            c = _compare(data, p, whole, windows, start, e[mid], e[act])
            same[act[c == 0]] = mid[c == 0]
            less = c < 0
            lo[act[less]] = mid[less] + 1
            hi[act[~less]] = mid[~less]
            hi[act[c == 0]] = lo[act[c == 0]]
        placed = np.where(same >= 0, same, lo) - begin
        goes = (same >= 0) & (rank[e] > rank[e[np.maximum(same, 0)]])
        flag[e[goes]] = True
        where = np.arange(len(e)) - first[mine] + placed  # place in the merged run
        stay = ~goes
        o = np.lexsort((where[stay], run[stay] // 2, group[stay]))
        e, group, run = e[stay][o], group[stay][o], (run[stay] // 2)[o]


def _compare(data, p, whole, windows, start, a, b) -> np.ndarray:
    """-1, 0, 1: the windows of suffixes a before, equal to, or after those of b."""
    out = np.zeros(len(a), np.int8)
    equal = whole[a] == whole[b]
    k = np.flatnonzero(equal)
    for at in range(0, len(k), 1 << 16):  # the bytes decide what the hashes claim
        some = k[at:at + (1 << 16)]
        equal[some] = (windows[start[a[some]]] == windows[start[b[some]]]).all(axis=1)
    k = np.flatnonzero(~equal)
    x, y = start[a[k]], start[b[k]]
    lo, hi = np.zeros(len(k), np.int64), np.full(len(k), WINDOW - 1)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        shared = hashes(p, x, x + mid) == hashes(p, y, y + mid)
        lo, hi = np.where(shared, mid, lo), np.where(shared, hi, mid - 1)
    d, f = data[x + lo].astype(np.int16), data[y + lo].astype(np.int16)
    for i in np.flatnonzero(d == f):  # a prefix hash that collided: compare the bytes themselves
        u, v = windows[x[i]].tobytes(), windows[y[i]].tobytes()
        d[i], f[i] = (u > v), (u < v)
    out[k] = np.where(d < f, -1, 1)
    return out


def marks(chunks: DataFrame, chunk_bytes: int, hot_places: int) -> tuple[DataFrame, DataFrame]:
    """What chunks noted of their pieces; and what they were told of them: rows of kind 1 are pieces that repeat as a whole, from number
    ``start`` on, rows of kind 2 windows that repeat."""
    n = chunks.count()
    buckets = max(LEAST_BUCKETS, n // 2)
    # bytes of an anchor's hash that tell it from most others: about one in 256 at most shares them
    width = min(8, max(4, -(-((n * chunk_bytes // 24).bit_length() + 8) // 8)))
    notes = pieces(chunks, repeated_anchors(chunks, buckets, hot_places, width), buckets, width)
    judged = stored(judged_pieces(notes, width), "judged")
    windows = sorted_pieces(chunks, notes, judged, max(LEAST_BUCKETS, n))
    none = F.lit(None).cast("binary")
    told = judged.where(F.octet_length("whole") > 0).select("chunk", F.lit(1).alias("kind"), "start", F.col("whole").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
    return notes, told.unionByName(windows.select("chunk", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("start"), F.col("number").alias("a"), F.col("at").alias("b"), F.col("n").alias("c"), F.col("repeats").alias("d")))


def _removed(size: int, notes: tuple, told: list[tuple]) -> np.ndarray:
    """Which of a chunk's bytes go."""
    depth = np.zeros(size + 1, np.int64)
    if notes[0] is not None:
        lo, f, n = _notes(*notes)
        gone = np.ones(len(lo), bool)
        gone[f] = False
        whole = [x for x in told if x[0] == 1]
        gone[f[_numbers([x[1] for x in whole], [x[2] for x in whole])]] = True
        each = np.repeat(n, np.diff(np.append(f, len(lo))))
        np.add.at(depth, lo[gone], 1)
        np.add.at(depth, lo[gone] + each[gone] + WINDOW - 1, -1)
        for _, _, number, at, m, flags in (x for x in told if x[0] == 2):
            m = np.frombuffer(m, np.uint8).astype(np.int64)
            start = lo[f[_unpacked(number)]] + np.frombuffer(at, np.uint8)
            s = np.repeat(start, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            s = s[_unbits(flags, len(s))]
            np.add.at(depth, s, 1)
            np.add.at(depth, s + WINDOW, -1)
    return np.cumsum(depth[:-1]) > 0


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, chunk_bytes: int = CHUNK_BYTES,
          hot_places: int = HOT) -> DataFrame:
    """``(doc_id, row, n_bytes, n_removed, n_spans, kept_sha256)`` and, if asked for, ``kept`` (what is left, less
    characters cut in part), one row per input row; ``row`` numbers the rows of a table read from files.

    A null text is empty; texts below the window's length are kept whole. Rows of one id count in
    the order they are read, null ids before all others. No rows: no rows."""
    chunks = chunked(docs, doc_id, text, chunk_bytes)
    notes, told = marks(chunks, chunk_bytes, hot_places)

    def mark(key, c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
        if not len(c):
            return pd.DataFrame([], columns=names)
        data, sizes = np.frombuffer(c["data"].iat[0], np.uint8), np.asarray(c["sizes"].iat[0], np.int64)
        removed = _removed(len(data), tuple(c[x].iat[0] for x in ("lo", "new", "n")), list(zip(*[r[x] for x in ("kind", "start", "a", "b", "c", "d")])) if len(r) else [])
        ends = np.cumsum(sizes)
        rows = []
        for i, row, a, b in zip(c["ids"].iat[0], c["rows"].iat[0], (ends - sizes).tolist(), ends.tolist()):
            m = removed[a:b]
            kept = data[a:b][~m].tobytes()
            spans = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if b > a else 0
            rows.append((None if i is None or i != i else int(i), int(row), b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * keep_text))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"doc_id": "Int64"})

    return with_notes(chunks, notes, "ids").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        mark, "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)


def drop_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, hot_places: int = HOT) -> DataFrame:
    """The input rows with the repeated passages cut out of ``text``, and ``n_chars`` (if there is one) counted anew.
    ``docs`` is a table read from files. A character of which only some bytes are cut goes as a
    whole; a null text stays null; other columns are unchanged. They lie in the chunks with their text, so that no text is moved."""
    chunks = chunked(docs, chunk_bytes=chunk_bytes, rest=True)
    notes, told = marks(chunks, chunk_bytes, hot_places)
    place = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != "text"}
    kind = T.StructType([*[T.StructField(place[c], docs.schema[c].dataType) for c in place], T.StructField("kept", T.StringType())])
    types = [to_arrow_type(f.dataType) for f in kind]

    def mark(c: pa.Table, r: pa.Table) -> pa.Table:
        if not c.num_rows:
            return pa.table({})
        data, sizes = np.frombuffer(c["data"][0].as_buffer(), np.uint8), c["sizes"][0].values.to_numpy(zero_copy_only=False)
        removed = _removed(len(data), tuple(c[x][0].as_py() for x in ("lo", "new", "n")), list(zip(*[r[x].to_pylist() for x in ("kind", "start", "a", "b", "c", "d")])) if r.num_rows else [])
        ends = np.cumsum(sizes)
        rest = c["rest"][0].values
        rest = dict(zip([f.name for f in rest.type], rest.flatten()))
        kept = [None if none else data[a:b][~removed[a:b]].tobytes().decode("utf-8", "ignore")
                for none, a, b in zip(rest["none"].to_pylist(), (ends - sizes).tolist(), ends.tolist())]
        columns = [*[rest[f.name] for f in kind[:-1]], pa.array(kept, pa.string())]
        return pa.Table.from_arrays([x.cast(t) for x, t in zip(columns, types)], names=kind.names)

    d = with_notes(chunks, notes, "rest").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(mark, kind)
    out = [F.col("kept").alias(c) if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(place[c]).alias(c, metadata=docs.schema[c].metadata) for c in docs.columns]
    return d.select(*out)
