"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All words that a task hasn't met yet are laid out as one flat symbol array. Each round looks up the
rank of every adjacent pair, takes the minimum per word (segment), merges its leftmost place in all
words at once and closes the gaps; words without a pair leave. Pairs of characters that no piece
holds next to each other end a segment beforehand, so even a text without spaces falls into short
segments. Several places of a word merge in one round only where no piece made of the merged one
could come first, so the order is the tokenizer's own: best score, then leftmost."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passageworks.llm.pieces import MARK, Vocabulary, vocabulary, words_of

NONE = np.int64(1 << 40)
CACHE = 400_000  # words a task remembers; beyond it starts afresh


class Merger:
    def __init__(self, v: Vocabulary):
        self.v = v
        texts = {v.pieces[i]: i for i in v.plain}
        chars = sorted({c for p in texts for c in p} - set(texts))
        #: symbols: pieces by id, then characters that are no piece of their own; -1 is any other
        self.symbol = {**texts, **{c: v.size + n for n, c in enumerate(chars)}}
        self.many = v.size + len(chars) + 2
        order = {s: r for r, s in enumerate(sorted({float(v.scores[i]) for i in v.plain}, reverse=True))}
        rows, adjacent = [], set()
        for p, i in texts.items():
            rank = order[float(v.scores[i])]
            adjacent.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    rows.append((a * self.many + b, i, rank))
        rows.sort()
        self.pair, self.made, self.rank = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.adjacent = np.array(sorted(ord(a) << 21 | ord(b) for a, b in adjacent), np.int64)
        points = sorted(c for c in self.symbol if len(c) == 1)
        self.points = np.array([ord(c) for c in points], np.int64)
        self.point_symbol = np.array([self.symbol[c] for c in points], np.int64)

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def _ranks(self, a: np.ndarray, b: np.ndarray, joined: np.ndarray) -> np.ndarray:
        key = np.where(joined & (a >= 0) & (b >= 0), a * self.many + b, -1)
        at, hit = self._find(self.pair, key)
        return np.where(hit, self.rank[at], NONE)

    def _in_turn(self, sym, seg, here, made, own, first, best) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of best rank, those that merging one after the other would take in a row: up to the
        first one in each word whose new piece makes a pair that is as good with a neighbour and so comes next."""
        before, after = np.maximum(here - 1, 0), np.minimum(here + 2, len(sym) - 1)
        left = sym[before]
        touch = np.flatnonzero(~first[1:] & (here[1:] == here[:-1] + 2)) + 1  # the piece merged just before is the neighbour
        left[touch] = made[touch - 1]
        near = np.minimum(self._ranks(left, made, (here > 0) & (seg[before] == own)), self._ranks(made, sym[after], (here + 2 < len(sym)) & (seg[after] == own)))
        stop = np.cumsum(near <= best)
        start = np.flatnonzero(first)
        passed = np.append(0, stop[:-1])  # stops before each place, of all words
        take = passed == np.repeat(passed[start], np.diff(np.append(start, len(here))))
        return here[take], made[take]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, spaces standing for the word mark."""
        sizes = np.array([len(w) for w in words], np.int64)
        cp = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        at, known = self._find(self.points, cp)
        sym = np.where(known, self.point_symbol[at], -1)
        cut = np.ones(len(cp), bool)
        if len(cp) > 1:
            cut[1:] = (word[1:] != word[:-1]) | ~self._find(self.adjacent, cp[:-1] << 21 | cp[1:])[1]
        seg, place = np.cumsum(cut) - 1, np.arange(len(cp))
        out_sym, out_place = [], []
        while len(sym):
            key = np.where((sym[:-1] >= 0) & (sym[1:] >= 0) & (seg[1:] == seg[:-1]), sym[:-1] * self.many + sym[1:], -1)
            at, hit = self._find(self.pair, key)
            rank = np.append(np.where(hit, self.rank[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            lengths = np.diff(np.append(starts, len(seg)))
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = best == NONE
            out_sym.append(sym[over])
            out_place.append(place[over])
            here = np.flatnonzero((rank == best) & ~over)
            if len(here):
                made, own = self.made[at[here]], seg[here]
                first = np.append(True, own[1:] != own[:-1])
                # runs of overlapping places merge at every other one, from the left
                run = np.flatnonzero(np.append(True, (here[1:] != here[:-1] + 1) | first[1:]))
                odd = (np.arange(len(here)) - np.repeat(run, np.diff(np.append(run, len(here))))) % 2 == 1
                here, made, own, first = here[~odd], made[~odd], own[~odd], first[~odd]
                here, made = self._in_turn(sym, seg, here, made, own, first, best[here])
                sym[here] = made
                keep = ~over
                keep[here + 1] = False
            else:
                keep = ~over
            sym, seg, place = sym[keep], seg[keep], place[keep]
        sym, place = np.concatenate([*out_sym, np.empty(0, np.int64)]), np.concatenate([*out_place, np.empty(0, np.int64)])
        o = np.argsort(place)
        sym, place = sym[o], place[o]
        ids: list[list[int]] = [[] for _ in words]
        owner = word[place] if len(place) else place
        for s, p, w in zip(sym.tolist(), place.tolist(), owner.tolist()):
            if 0 <= s < self.v.size:
                ids[w].append(s)
            else:  # no piece: its bytes
                ids[w].extend(self.v.byte_id[b] for b in chr(cp[p]).encode("utf-8", "replace"))
        return ids


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(vocabulary(path))


class Codec:
    """Encodes and decodes whole texts; remembers the ids of words, which are packed as uint32."""

    def __init__(self, path: str):
        self.m, self.known = merger(path), {}
        v = self.m.v
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (v.bos, v.eos))
        self.piece = v.bytes_out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with begin and end ids, as little-endian uint32."""
        if len(self.known) > CACHE:
            self.known = {}
        cut = [words_of(t) for t in texts]
        new = list({w for ws in cut for w in ws} - self.known.keys())
        for at in range(0, len(new), 50_000):
            some = new[at:at + 50_000]
            self.known.update((w, np.array(i, "<u4").tobytes()) for w, i in zip(some, self.m.encode(some)))
        get = self.known.__getitem__
        return [b"".join([self.bos, *map(get, ws), self.eos]) for ws in cut]

    def decode(self, ids: bytes) -> str:
        """Pieces joined, marks as spaces, the leading dummy space off; bytes that are no UTF-8 read
        as U+FFFD."""
        out = b"".join(map(self.piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Every input row with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, as asked for, the ``ids`` (array) and
    the ``decoded`` text. Input columns of those names give way. A null text is the empty text,
    whose ids are begin and end. Whole texts; one row in, one row out, in the same partition."""
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if ids else {}) | ({"decoded": "string"} if decoded else {})
    docs = docs.drop(*new)
    schema = f"{docs._jdf.schema().toDDL()}, " + ", ".join(f"{k} {t}" for k, t in new.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            for at in range(0, len(texts), 512):
                part = b.slice(at, 512)
                packed = codec.encode(texts[at:at + 512])
                back = [codec.decode(p) for p in packed]
                cols = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
                if ids:
                    cols.append(pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32())))
                if decoded:
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *new])

    return docs.mapInArrow(run, schema)
