"""Toxic passages by maximum-scoring segment search.

A token's features are the word and its beginnings of three to six letters, for insults are inflected.
Features score their log-odds between toxic and clean training texts under an informative Dirichlet
prior (the prior is the corpus itself), kept where the odds stand out of their own error; a token
scores its best feature, less a small loss for every token. Copies among the training texts count
once: a text whose least shingle hash was met before is left out. A linear scan finds all maximal
segments of a text. With Karlin-Altschul parameters (lambda from the clean token scores, K from the highest segments of
clean texts) a segment's score becomes an extreme-value excess, and a text's excesses become
a probability by a logistic curve fitted on the training sample, whose classes weigh as much as they
have labels in the whole training table."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.base import stored

SAMPLE = 40_000  # labelled training rows, at most
PRIOR = 0.03  # the prior weighs as much as this share of the training texts
Z, ODDS = 2.5, 3.0  # a feature is kept beyond this many errors and this log-odds
STEMS = (3, 4, 5, 6)
CACHE = 1_000_000
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    score: dict[str, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, ...] = (-4.0, 1.0, 0.0)
    known: dict[str, float] = field(default_factory=dict)  # words a task has met


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of token scores, in order: none can be
    extended or cut to a higher score, and they don't overlap.

    Only the tokens of positive score are visited; each candidate keeps the sum before it, the sum up to its end and the
    place of the nearest earlier candidate that starts lower, which it joins unless that one ends as high. As the places
    make a chain, no candidate is passed over twice."""
    at = np.flatnonzero(x > 0)
    if not len(at):
        return []
    total = np.cumsum(x)
    found: list[list] = []
    for p in at.tolist():
        end = float(total[p])
        begin, left, j = p, end - float(x[p]), len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < end:
            begin, _, left, _, lower = found[j]
            del found[j:]
            j = lower
        found.append([begin, p + 1, left, end, j])
    return [(b, e, right - left) for b, e, left, right, _ in found]


def parts(word: str) -> list[str]:
    return [word, *[f"{word[:n]}-" for n in STEMS if len(word) > n]]


def scores(words: list[str], m: Model) -> np.ndarray:
    known = m.known
    if len(known) > CACHE:
        known.clear()
    for w in set(words).difference(known):
        got = [m.score[p] for p in parts(w) if p in m.score]
        high = max(got, default=0.0)
        known[w] = high if high > 0 else min(got, default=0.0)
    return np.fromiter(map(known.__getitem__, words), float, len(words)) - m.drift


def least_hashes(words: list[str]) -> tuple[int, int]:
    """Two least hashes of the text's runs of five words; near copies mostly share them."""
    runs = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    return tuple(min(xxhash.xxh64_intdigest(r, seed) >> 1 for r in runs) for seed in (1, 2))


def features(words: list[str], m: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """The highest extreme-value excess, the sum of the positive ones, and their segments."""
    if not words:
        return -10.0, 0.0, []
    limit = np.log(max(m.k, 1e-9) * len(words))
    found = [(b, e, m.lam * s - limit) for b, e, s in segments(scores(words, m))]
    best = max((f[2] for f in found), default=-limit)
    good = [f for f in found if f[2] > 0]
    return float(max(best, -10.0)), float(sum(f[2] for f in good)), good


def probability(best: float, total: float, m: Model) -> float:
    a, b, c = m.weights
    return float(1 / (1 + np.exp(-np.clip(a + b * best + c * np.log1p(total), -30, 30))))


def labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_weights(labels: DataFrame, bound: int = SAMPLE) -> np.ndarray:
    """Labelled ids, clean and toxic, for each one that ``sample_of`` takes."""
    n = {int(r["toxic"]): r["count"] for r in labelled(labels).groupBy("toxic").count().collect()}  # two rows
    return np.array([max(n.get(y, 0) / (bound // 2), 1.0) for y in (0, 1)])


def sample_of(labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` labelled ids, by hash: half of them toxic where there are as many."""
    one = labelled(labels)
    pick = lambda y: one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2)
    return pick(1).unionByName(pick(0))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, all of which are training rows.
    Without labelled rows of both kinds every text scores the same."""
    sc = docs.sparkSession.sparkContext
    picked = F.broadcast(sample_of(labels, bound))  # at most ``bound`` rows
    texts = docs.select("doc_id", "text").join(picked, "doc_id")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [least_hashes(tokens(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *[pa.array([x[k] for x in h], pa.int64()) for k in (0, 1)]], ["doc_id", "toxic", "h0", "h1"])

    hashes = stored(texts.mapInArrow(least, f"doc_id long, toxic {labels.schema['toxic'].dataType.simpleString()}, h0 long, h1 long"), "least")
    first = [hashes.groupBy(h).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct() for h in ("h0", "h1")]
    single = hashes.join(first[0], "doc_id", "left_semi").join(first[1], "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text").join(F.broadcast(single), "doc_id")  # again at most ``bound`` rows
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))  # three parts for the odds, one for the calibration

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_seen = (Counter(), Counter()), [0, 0]
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                seen[1 if y else 0].update({p for w in set(tokens(t)) for p in parts(w)})
                docs_seen[1 if y else 0] += 1
        words = list(seen[0].keys() | seen[1].keys())
        cols = [[c[w] for w in words] + [n] for c, n in zip(seen, docs_seen)]
        yield pa.RecordBatch.from_arrays([pa.array([*words, ""], pa.string()), *[pa.array(c, pa.int64()) for c in cols]], ["word", "clean", "toxic"])

    n = known.where(fold != 0).mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = stored(n, "words")  # the empty word counts the texts
    total = n.where("word = ''").agg(F.coalesce(F.sum("clean"), F.lit(0)).alias("c"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    m = Model()
    if not total["c"] or not total["t"]:
        return m
    c, t = float(total["c"]), float(total["t"])
    n = n.where("word <> '' AND clean + toxic > 2")
    weight = PRIOR * (c + t)
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + weight - F.col(y) - prior))
    d = n.withColumn("delta", odds("toxic", t) - odds("clean", c)).withColumn(
        "z", F.col("delta") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
    top = d.where((F.abs("z") > Z) & (F.abs("delta") > ODDS)).select("word", "delta").toPandas()  # words of the bounded sample
    m.score = dict(zip(top["word"], top["delta"]))
    held = known.where(fold == 0).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # a row for each id
    bc = sc.broadcast(m)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("text").to_pylist():
                seen.update((scores(tokens(t), bc.value) + bc.value.drift).round(6).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.float64()), pa.array(seen.values(), pa.int64())], ["x", "n"])

    # values are as many as kept features, at most
    v = held.where("toxic = 0").mapInArrow(values, "x double, n long").groupBy("x").agg(F.sum("n").alias("n")).toPandas()
    x, weight = np.append(v["x"].to_numpy(float), max(m.score.values(), default=1.0)), np.append(v["n"].to_numpy(float), 1.0)
    m.drift = max(0.3, 2 * float((weight * x).sum() / weight.sum()))
    m.lam = _lambda(x - m.drift, weight / weight.sum())
    bc2 = sc.broadcast(m)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                w = tokens(text)
                found = [x[2] for x in segments(scores(w, bc2.value))]
                rows.append((len(w), max(found, default=0.0), found))
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
                                              pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["toxic", "n", "best", "all"])

    rows = held.mapInArrow(score, "toxic long, n long, best double, all array<double>").where("n > 0").toPandas()
    if not len(rows):
        return m
    clean = rows[rows["toxic"] == 0]
    m.k = max(len(clean), 1) / max(float((clean["n"] * np.exp(-m.lam * clean["best"])).sum()), 1e-9)
    limit = np.log(m.k * rows["n"].to_numpy(float))
    best = np.maximum(m.lam * rows["best"].to_numpy(float) - limit, -10.0)
    total = np.array([np.maximum(m.lam * np.asarray(a, float) - q, 0).sum() for a, q in zip(rows["all"], limit)])
    m.weights = _logistic(np.column_stack([np.ones(len(rows)), best, np.log1p(total)]), rows["toxic"].to_numpy(float), each=class_weights(labels, bound)[rows["toxic"].to_numpy(int)])
    return m


def _lambda(x: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p * exp(lambda x) = 1, for a negative mean and some positive x."""
    if not (x > 0).any():
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * x, 700))).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * x, 700))).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, each: np.ndarray | None = None) -> tuple[float, ...]:
    """Newton steps with a small ridge, halved while they don't help; ``each`` has the weights of the rows."""
    w = np.zeros(x.shape[1])
    each = np.ones(len(y)) if each is None else each
    loss = lambda w: (each * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + ridge / 2 * (w @ w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + ridge * w
        h = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step, now = np.linalg.solve(h, g), loss(w)
        for _ in range(30):
            if loss(w - step) <= now:
                break
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, model: Model, text: str = "text", passages: bool = True) -> DataFrame:
    """Every input row with ``score`` (0 to 1), ``predicted`` and, if asked for, ``passages``: the significant segments as
    (begin, end, excess) in tokens. Input columns of those names give way. Null and empty texts
    score like a text without any toxic token. Whole texts, in the same partition."""
    new = {"score": "double", "predicted": "int"} | ({"passages": "array<struct<begin:int,end:int,excess:double>>"} if passages else {})
    docs = docs.drop(*new)
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        for b in batches:
            f = [features(tokens(t), m) for t in b.column(text).to_pylist()]
            p = [probability(x[0], x[1], m) for x in f]
            cols = [pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())]
            if passages:
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("excess", pa.float64())]))
                cols.append(pa.array([[{"begin": s, "end": e, "excess": x} for s, e, x in r[2]] for r in f], kind))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new])

    return docs.mapInArrow(run, f"{docs._jdf.schema().toDDL()}, " + ", ".join(f"{c} {t}" for c, t in new.items()))
