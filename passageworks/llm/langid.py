"""Language identification by interpolated Kneser-Ney character models.

Every training text is counted, whole, as character 4-grams per language, and every 4-gram counted is
part of its language's model; lower orders are continuation counts of those. Up to ``LOCAL`` counts
the models lie in shared sorted arrays of mixed n-gram codes, a column per language, which tasks
get by broadcast. Larger models stay tables: blocks of texts name the 4-grams they hold, joins over
the four orders find these 4-grams' probabilities, and each block meets its own. A text goes to the language of the lowest
cross-entropy per character; a softmax whose scale is fitted on a bounded sample turns entropies
into a score, and the same sample sets how far above a language's usual entropy a text of its
length may lie before it is rejected."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passageworks.llm.base import own_names, stored

ORDER = 4
LOCAL = 1_200_000  # counts of a model that is broadcast; larger ones are joined
BLOCK = 1 << 23  # characters of a block of texts that meets a joined model
CALIBRATION = 4_000  # rows of the calibration sample of a language, at most
FEW = 30  # a language of fewer calibration rows takes the pooled limits
CHUNK = 1 << 20  # characters handled at once
SPACE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def _alphabet() -> np.ndarray:
    """By code point: letters as their lower-case form, all else a space."""
    t = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_TABLE: list[np.ndarray] = []


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram codes of all texts, one behind the other, and the number of each text's codes, which
    is 0 for a text without a letter. Runs of other characters are one space; a letter above U+FFFF is two symbols,
    the halves that it has in UTF-16, which no other letter has."""
    if not _TABLE:
        _TABLE.append(_alphabet())
    sizes = np.array([len(t) + ORDER for t in texts], np.int64)
    flat = _TABLE[0][np.frombuffer("".join("\n\n\n" + t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    high = flat > 0xFFFF
    if high.any():
        width = 1 + high
        sizes = np.add.reduceat(width, np.cumsum(sizes) - sizes)
        first = np.cumsum(width) - width
        c = flat[high] - np.uint32(0x10000)
        flat = np.repeat(flat, width)
        flat[first[high]], flat[first[high] + 1] = 0xD800 + (c >> np.uint32(10)), 0xDC00 + (c & np.uint32(0x3FF))
    start = np.cumsum(sizes) - sizes
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != SPACE) | (flat[:-1] != SPACE)
    for lead in range(ORDER - 1):
        keep[start + lead] = True
    if len(flat):
        keep[start + ORDER - 1] &= flat[start + ORDER - 1] != SPACE
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    flat = flat[keep].astype(np.uint64)
    n = np.bincount(owner, minlength=len(texts))
    if len(flat) < ORDER:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    code = flat[:-3] << U(48) | flat[1:-2] << U(32) | flat[2:-1] << U(16) | flat[3:]
    own = owner[3:] == owner[:-3]
    letters = np.zeros(len(texts), bool)
    letters[owner[flat != SPACE]] = True
    own &= letters[owner[3:]]
    return code[own], np.where(letters, n - 3, 0)


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    at, size = [], 0
    for i, t in enumerate(texts):
        at.append(i)
        size += len(t)
        if size > CHUNK:
            yield at
            at, size = [], 0
    if at:
        yield at


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, gram, n)`` over whole texts; rows of null language are left out. Each task adds up
    what it has read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}

        def merged(parts):
            g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for b in batches:
            ts, ls = [t or "" for t in b.column("text").to_pylist()], b.column("lang").to_pylist()
            for name in sorted(set(ls)):
                own = [t for t, x in zip(ts, ls) if x == name]
                for at in _chunks(own):
                    seen.setdefault(name, []).append(np.unique(codes([own[i] for i in at])[0], return_counts=True))
                if sum(len(p[0]) for p in seen[name]) > 2_000_000:
                    seen[name] = [merged(seen[name])]
                    if len(seen[name][0][0]) > 1_000_000:
                        g, n = seen.pop(name)[0]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        for name, parts in seen.items():
            g, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    d = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return d.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _level(gram: np.ndarray, n: np.ndarray) -> dict:
    """One order of one language: absolute discount, and totals and types by context."""
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    context = gram >> U(16)
    c, at = np.unique(context, return_inverse=True)
    total = np.bincount(at, weights=n)
    types = np.bincount(at)
    return {"gram": gram, "own": np.maximum(n - d, 0) / total[at], "context": c, "weight": d * types / total}


def _mixed(x: np.ndarray) -> np.ndarray:
    return x * MIX  # odd factor: one to one


@dataclass
class Model:
    """Natural logarithms of P(character | up to three before), by order and language."""

    languages: list[str]
    grams: list[np.ndarray]  # sorted mixed codes of orders 4, 3, 2, 1
    logp: list[np.ndarray]  # (grams, languages)
    contexts: list[np.ndarray]  # sorted mixed codes of the contexts of orders 4, 3, 2
    logw: list[np.ndarray]  # the weight left to the lower order
    floor: np.ndarray | None = None  # of a character no model has seen
    scale: float = 1.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None  # (languages, 2): variance of the mean and per character
    z: float = 14.0  # wide: a text in two of the languages is no junk

    def entropy(self, code: np.ndarray) -> np.ndarray:
        """Minus log probability, (codes, languages)."""
        out = np.empty((len(code), len(self.languages)), np.float32)
        left, back = np.arange(len(code)), None
        for level in range(4):
            bits = U(16 * (4 - level)) if level else None
            g = code[left] if bits is None else code[left] & ((U(1) << bits) - U(1))
            h = _mixed(g)
            at = np.minimum(np.searchsorted(self.grams[level], h), len(self.grams[level]) - 1)
            hit = self.grams[level][at] == h
            p = self.logp[level][at[hit]]
            out[left[hit]] = -(p if back is None else p + back[hit])
            left, g = left[~hit], g[~hit]
            back = None if back is None else back[~hit]
            if not len(left):
                break
            if level == 3:
                out[left] = -(self.floor + (0 if back is None else back))
                break
            c = _mixed(g >> U(16))
            at = np.minimum(np.searchsorted(self.contexts[level], c), len(self.contexts[level]) - 1)
            w = np.where((self.contexts[level][at] == c)[:, None], self.logw[level][at], np.float32(0))
            back = w if back is None else back + w
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text and language, and the numbers of characters."""
        ce, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for at in _chunks(texts):
            code, size = codes([texts[i] for i in at])
            n[at] = size
            some = np.flatnonzero(size)
            if len(some):
                total = np.add.reduceat(self.entropy(code), (np.cumsum(size) - size)[some], axis=0, dtype=np.float64)
                ce[np.array(at)[some]] = total / size[some, None]
        return ce, n


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of arrays of 4-grams and counts by language."""
    languages = sorted(counts)
    levels: list[list[dict]] = [[], [], [], []]
    for name in languages:
        g, n = counts[name]
        o = np.argsort(g)
        g, n = g[o], n[o].astype(np.float64)
        for level in range(4):
            levels[level].append(_level(g, n))
            mask = (U(1) << U(16 * (3 - level))) - U(1) if level < 3 else U(0)
            g, n = np.unique(g & mask, return_counts=True)  # one for each character seen before it
            n = n.astype(np.float64)
    many = len(np.unique(np.concatenate([x["gram"] for x in levels[3]]))) + 1
    m = Model(languages, [], [], [], [])
    grams = [np.unique(np.concatenate([x["gram"] for x in own])) for own in levels]
    low = None
    for level in (3, 2, 1, 0):
        g, p, w = grams[level], np.zeros((len(grams[level]), len(languages))), []
        ctx = np.unique(np.concatenate([x["context"] for x in levels[level]]))
        weight = np.ones((len(ctx), len(languages)))
        for k, x in enumerate(levels[level]):
            weight[np.searchsorted(ctx, x["context"]), k] = x["weight"]
            p[np.searchsorted(g, x["gram"]), k] = x["own"]
        left = weight[np.searchsorted(ctx, g >> U(16))]
        if level == 3:
            p += left / many
            m.floor = weight[0] / many  # of each language
        else:
            p += left * low[1][np.searchsorted(low[0], g & ((U(1) << U(16 * (3 - level))) - U(1)))]
        low = (g, p)
        o = np.argsort(_mixed(g))
        m.grams.insert(0, _mixed(g)[o])
        m.logp.insert(0, np.log(np.maximum(p[o], 1e-12)).astype(np.float32))
        if level < 3:
            o = np.argsort(_mixed(ctx))
            m.contexts.insert(0, _mixed(ctx)[o])
            m.logw.insert(0, np.log(np.maximum(weight[o], 1e-12)).astype(np.float32))
    m.floor = np.log(np.maximum(m.floor, 1e-12)).astype(np.float32)
    return m


@dataclass
class Joined:
    """A model of any size: tables of what each order adds, and what a task needs in ``fit``."""

    fit: Model  # without n-grams
    own: list[DataFrame]  # of orders 4, 3, 2, 1: (gram, own), an array by language
    weight: list[DataFrame]  # (context, weight)
    many: int  # characters, and one for all unseen


def build_joined(counts: DataFrame, languages: list[str]) -> Joined:
    """The model of ``counts(lang, gram, n)``, stored; the same as ``build`` makes of its rows."""
    j, level = Joined(Model(languages, [], [], [], []), [], [], 0), counts
    by_lang = lambda c, other: F.array(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col(c))), F.lit(other)) for x in languages])
    for k in range(4):
        if k:
            mask = (1 << 16 * (4 - k)) - 1
            level = stored(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n")), "order")
        few = level.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("ones"), F.count(F.when(F.col("n") == 2, 1)).alias("twos"))
        few = few.select("lang", F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5).alias("d"))
        rows = level.withColumn("context", F.shiftrightunsigned("gram", 16)).join(F.broadcast(few), "lang")  # a row for each language
        ctx = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*") / F.sum("n")).alias("w"))
        own = rows.join(ctx, ["lang", "context"]).select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"))
        j.own.append(stored(own.groupBy("gram").agg(by_lang("p", 0.0).alias("own")), "own"))
        j.weight.append(stored(ctx.groupBy("context").agg(by_lang("w", 1.0).alias("weight")), "weight"))
    j.many = j.own[3].count() + 1
    return j


def probabilities(grams: DataFrame, j: Joined) -> DataFrame:
    """``(gram, p)`` of distinct 4-grams, known or not: ``p`` is an array by language."""
    need = [grams.select("gram")]
    for k in range(1, 4):
        need.append(need[-1].select(F.col("gram").bitwiseAND(F.lit((1 << 16 * (4 - k)) - 1)).alias("gram")).distinct())
    many = len(j.fit.languages)
    flat = lambda x: F.array_repeat(F.lit(x), many)
    low = None
    for k in (3, 2, 1, 0):
        x = need[k].withColumn("context", F.shiftrightunsigned("gram", 16)).join(j.own[k], "gram", "left").join(j.weight[k], "context", "left")
        if low is None:
            x = x.withColumn("low", flat(1.0 / j.many))
        else:
            x = x.withColumn("below", F.col("gram").bitwiseAND(F.lit((1 << 16 * (3 - k)) - 1))).join(low.select(F.col("gram").alias("below"), F.col("p").alias("low")), "below")
        left = F.zip_with(F.coalesce("weight", flat(1.0)), "low", lambda w, p: w * p)
        low = x.select("gram", F.zip_with(F.coalesce("own", flat(0.0)), left, lambda o, p: o + p).alias("p"))
    return low


def measured(docs: DataFrame, j: Joined, text: str = "text", names: tuple[str, str] = ("_n", "_ce")) -> DataFrame:
    """Every row of ``docs`` with its characters and its cross-entropy by language, under ``names``.
    ``docs`` is a table read from files, or a plan over one that keeps its rows' order."""
    schema = docs._jdf.schema().toDDL()
    mark, = own_names("block")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                if size > BLOCK:
                    at, size = at + 1, 0
                out.append(at)
                size += len(t or "")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, mark])

    tagged = docs.mapInArrow(blocks, f"{schema}, {mark} long")  # the texts are not written once more

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, block = [t or "" for t in b.column("t").to_pylist()], b.column("_block").to_numpy()
            for k in np.unique(block):
                own = [texts[i] for i in np.flatnonzero(block == k)]
                for at in _chunks(own):
                    g = np.unique(codes([own[i] for i in at])[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(g.view(np.int64))], ["_block", "gram"])

    pairs = stored(tagged.select(F.col(mark).alias("_block"), F.col(text).alias("t")).mapInArrow(held, "_block long, gram long").distinct(), "held")
    told = pairs.join(probabilities(pairs.select("gram").distinct(), j), "gram").select("_block", "gram", "p")
    many = len(j.fit.languages)

    def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
        texts = [t or "" for t in rows.column(text).to_pylist()]
        ce, n = np.zeros((len(texts), many)), np.zeros(len(texts), np.int64)
        if len(own):
            g = own.column("gram").to_numpy().view(np.uint64)
            e = -np.log(own.column("p").combine_chunks().flatten().to_numpy().reshape(-1, many))
            o = np.argsort(g)
            g, e = g[o], e[o].astype(np.float32)
            for at in _chunks(texts):
                code, size = codes([texts[i] for i in at])
                n[at] = size
                some = np.flatnonzero(size)
                if len(some):
                    where = np.searchsorted(g, code)
                    if where.max() >= len(g) or (g[where] != code).any():
                        raise ValueError("a block has 4-grams it did not name")
                    total = np.add.reduceat(e[where], (np.cumsum(size) - size)[some], axis=0, dtype=np.float64)
                    ce[np.array(at)[some]] = total / size[some, None]
        out = rows.drop_columns([mark])
        return out.append_column(names[0], pa.array(n)).append_column(names[1], pa.array(list(ce), pa.list_(pa.float64())))

    return tagged.groupBy(mark).cogroup(told.groupBy("_block")).applyInArrow(meet, f"{schema}, {names[0]} long, {names[1]} array<double>")


def train(docs: DataFrame, calibration: int = CALIBRATION, local: int = LOCAL) -> Model | Joined | None:
    """A model of ``docs(doc_id, text, lang)``, all of which are training rows; None without any
    labelled letter."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = stored(gram_counts(known), "grams")
    sizes = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}  # the languages
    if not sizes:
        return None
    if sum(sizes.values()) <= local:
        by_lang = {}
        for name in sorted(sizes):
            own = counts.where(F.col("lang") == name).select("gram", "n").toPandas()  # ``local`` rows in all, at most
            by_lang[name] = own["gram"].to_numpy(np.int64).view(np.uint64), own["n"].to_numpy(np.int64)
        m = build(by_lang)
    else:
        m = build_joined(counts, sorted(sizes))
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    sample = sample_of(known, rows, calibration)
    if isinstance(m, Joined):
        told = measured(stored(sample, "sample"), m).select("lang", F.col("_n").alias("n"), F.col("_ce").alias("ce"))
    else:
        bc = sample.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ce, n = bc.value.texts(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(n), pa.array(list(ce), pa.list_(pa.float64()))], ["lang", "n", "ce"])

        told = sample.mapInArrow(run, "lang string, n long, ce array<double>")
    calibrate(m.fit if isinstance(m, Joined) else m, told.where("n > 0").toPandas(), rows)
    return m


def sample_of(known: DataFrame, rows: dict[str, int], bound: int = CALIBRATION) -> DataFrame:
    """``(lang, text)``: of each language the ``bound`` rows of least hash. A threshold that lets
    about twice as many pass comes first, so that no language is ranked in whole."""
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(2 * bound / n)) for x, n in rows.items()], F.lit(1.0))
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    near = known.select("lang", "text", "doc_id", h.alias("h")).where(F.col("h") <= share * (1 << 40))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    return near.withColumn("place", place).where(F.col("place") <= bound).select("lang", "text")


def calibrate(m: Model, rows, many: dict[str, int] | None = None) -> None:
    """Fit the score's scale and the usual entropy by language on a sample of (lang, n, ce) that is
    bounded by language; ``many`` has the rows of each language in the corpus. Languages of few
    rows in the sample share the spread, and at least the centre, of all."""
    size = len(m.languages)
    m.centre, m.spread = np.full(size, np.inf), np.zeros((size, 2))
    if not len(rows):
        return
    ce, n = np.array(rows["ce"].tolist()), rows["n"].to_numpy()
    want = np.array([m.languages.index(x) for x in rows["lang"]])
    seen = np.bincount(want, minlength=size)
    share = np.array([(many or {}).get(x, k) for x, k in zip(m.languages, seen)]) / np.maximum(seen, 1)
    scales = [0.25, 0.5, 1, 2, 4, 8]
    losses = []
    for s in scales:
        p = posterior(ce, n, s)
        losses.append(np.average(-np.log(np.maximum(p[np.arange(len(want)), want], 1e-9)), weights=share[want]))
    m.scale = scales[int(np.argmin(losses))]
    right = ce.argmin(axis=1) == want
    if not right.any():
        right[:] = True
    own, k, n = ce[np.arange(len(want)), want][right], want[right], n[right]
    found = np.bincount(k, minlength=size)
    full = np.flatnonzero(found >= FEW)
    for a in np.flatnonzero(found):
        m.centre[a] = np.median(own[k == a])
    base = full if len(full) else np.flatnonzero(found)
    pool = np.isin(k, base)
    for a in full:
        m.spread[a] = _spread((own[k == a] - m.centre[a]) ** 2, n[k == a])
    usual, between = np.median(m.centre[base]), np.var(m.centre[base])
    shared = np.array(_spread((own[pool] - m.centre[k[pool]]) ** 2, n[pool])) + [between, 0]
    for a in np.flatnonzero(found < FEW):
        m.centre[a] = max(m.centre[a], usual) if found[a] else usual
        m.spread[a] = shared


def _spread(d2: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Variance of the mean and per character, of squared distances of texts of these sizes."""
    long = size >= np.median(size)
    return np.median(d2[long]) / 0.455 + 1e-3, np.median(d2[~long] * size[~long]) / 0.455 + 1.0 if (~long).any() else 1.0


def posterior(ce: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
    x = -ce * (scale * np.sqrt(np.maximum(n, 1)))[:, None]
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def verdicts(m: Model, e: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Language, score, cross-entropy and rejection of texts of given entropies and sizes."""
    k, p = e.argmin(axis=1), posterior(e, n, m.scale)
    own, i = n > 0, np.arange(len(n))
    far = m.centre[k] + m.z * np.sqrt(m.spread[k, 0] + m.spread[k, 1] / np.maximum(n, 1))
    pred = [m.languages[a] if ok else "und" for a, ok in zip(k, own)]
    bad = ~own | (e[i, k] > far)
    return [pa.array(pred, pa.string()), pa.array(np.where(own, p[i, k], 0.0), pa.float64()), pa.array(e[i, k], pa.float64(), mask=~own), pa.array(bad, pa.bool_())]


def identify(docs: DataFrame, model: Model | Joined | None, text: str = "text") -> DataFrame:
    """Every input row with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``. Input columns of those
    names give way.

    A null text or one without a letter is ``und`` with score 0, and rejected; so is every text
    where there is no model. Whole texts, one row in, one row out; in the same partition, unless the
    model is a joined one."""
    new = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "rejected": "boolean"}
    docs = docs.drop(*new)
    joined = isinstance(model, Joined)
    bc = docs.sparkSession.sparkContext.broadcast(model.fit if joined else model)
    names = tuple(own_names("n", "ce"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        for b in batches:
            if m is None:
                n = b.num_rows
                cols = [pa.array(["und"] * n), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array([True] * n)]
            elif joined:
                e = np.array(b.column(names[1]).to_pylist()).reshape(-1, len(m.languages))
                cols, b = verdicts(m, e, b.column(names[0]).to_numpy()), b.drop_columns(list(names))
            else:
                cols = verdicts(m, *m.texts([t or "" for t in b.column(text).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new])

    schema = f"{docs._jdf.schema().toDDL()}, " + ", ".join(f"{c} {t}" for c, t in new.items())
    return (measured(docs, model, text, names) if joined else docs).mapInArrow(run, schema)
