"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every piece that ends at each character; a dynamic programme keeps
only the best score and its number of pieces per position, never the pieces. The tie rules are the
unigram tokenizer's: of equal scores the path whose last piece starts first stays; a character
without a piece of its own costs the lowest score less ten and counts as its UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from passageworks.llm.pieces import MARK, vocabulary, words_of

CACHE = 1_000_000  # words a task remembers; beyond it starts afresh
PENALTY = 10.0


class Counter:
    """Counts the pieces of words. Scores here are whole numbers, so sums are exact and a word's
    best path does not depend on the words around it."""

    def __init__(self, path: str):
        v = vocabulary(path)
        self.machine, self.known = ahocorasick.Automaton(), {}
        for i in v.plain:
            self.machine.add_word(v.pieces[i], (len(v.pieces[i]), float(v.scores[i])))
        self.machine.make_automaton()
        self.single = {v.pieces[i] for i in v.plain if len(v.pieces[i]) == 1}
        self.unknown = float(min(v.scores[i] for i in v.plain)) - PENALTY

    def word(self, word: str) -> int:
        text = word.replace(" ", MARK)
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, piece in self.machine.iter(text):
            ends[end + 1].append(piece)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            score = None
            for size, own in sorted(ends[e], reverse=True):  # the earliest start first
                s = best[e - size] + own
                if score is None or s > score:
                    score, c = s, count[e - size] + 1
            if text[e - 1] not in self.single:
                s = best[e - 1] + self.unknown
                if score is None or s > score:
                    score, c = s, count[e - 1] + len(text[e - 1].encode())
            best[e], count[e] = score, c
        return count[n]

    def text(self, text: str) -> int:
        if len(self.known) > CACHE:
            self.known = {}
        known, total = self.known, 0
        for w in words_of(text):
            c = known.get(w)
            if c is None:
                c = known[w] = self.word(w)
            total += c
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Every input row with the number of unigram pieces of its whole text, without begin and end. An input column of that
    name gives way. Null and empty texts have 0."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = pa.array([c.text(t or "") for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, name])

    return docs.mapInArrow(run, f"{docs._jdf.schema().toDDL()}, {name} long")
