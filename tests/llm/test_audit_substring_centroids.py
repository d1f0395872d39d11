"""Filter audit, substring dedup and centroid clustering against brute force; edge cases of each."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passageworks.llm import centroids, filter_audit, substring_dedup

rng = random.Random(11)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# filter interaction audit


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = SPACE.findall(t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])) if x}
        docs.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                out[part, "".join(order), step + 1] = (len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("batches", [1, 5])
def test_audit(spark, table, tmp_path, batches):
    base = [words(rng.choice([20, 150]), rng.choice([20, 5000])) for _ in range(12)] + ["", None, "ABC DEF", "a & b", "é " * 120, words(30_000)]
    rows = [(i, rng.choice(base), rng.choice(["en", "de", None])) for i in range(300)]
    rows += [(5, rows[7][1], "en"), (5, rows[7][1], "en"), (None, base[0], "fr"), (None, base[0], None), (-3, base[1], "en")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    path = str(tmp_path / "docs.parquet")
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, key long, mask string").repartition(9)
    docs.write.parquet(path)
    got = filter_audit.audit(filter_audit.file_stream(spark, path, batches), table(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in got} == brute_audit(rows, labels)


def test_audit_takes_earlier_counts_back(spark, table, tmp_path):
    """Ids that fall from file to file: every batch makes the copy so far one that fails."""
    path = str(tmp_path / "docs.parquet")
    for i in (9, 7, 5, 3):
        spark.createDataFrame([(i, "same text", f"p{i}")], "doc_id long, text string, lang string").write.mode("append").parquet(path)
    counts = filter_audit.counters(filter_audit.file_stream(spark, path, 4), table([], "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.mask, r.n) for r in counts} == {("p3", 1, 1), ("p5", 17, 1), ("p7", 17, 1), ("p9", 17, 1)}


def test_audit_of_nothing(spark, table, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(path)
    assert filter_audit.audit(filter_audit.file_stream(spark, path, 4), table([], "doc_id long, quality int, toxic int")).collect() == []


def test_combine_sends_a_text_once(spark):
    """A task's copies of one text become one row for its smallest id and one for all above."""
    rows = [("k", True, i, 0, "en", 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, known boolean, id long, mask int, part string, flags int").withColumn("key", F.col("key").cast("binary"))
    got = df.coalesce(1).mapInArrow(filter_audit.combine, filter_audit.COMBINED).collect()
    assert sorted((r.kind, r.id, r.n) for r in got) == [(0, 0, 1), (1, 0, 999)]


# substring dedup


def brute_substrings(rows, n):
    least = {}
    split = [(i, (text or "").encode().split()) for i, text in rows]
    for i, w in split:
        if i is not None:
            for s in range(len(w) - n + 1):
                g = tuple(w[s:s + n])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - n + 1):
            if i is not None and least[tuple(w[s:s + n])] < i:
                gone.update(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "first", "vocabulary"), [(13, None, 400), (13, 1, 6), (5, 2, 3), (1, None, 30), (8, 4, 3)])
def test_substrings(table, window, first, vocabulary):
    shared = words(60, vocabulary).split()
    rows = []
    for k in range(60):
        a = rng.randrange(40)
        rows.append((k, words(rng.randrange(40), vocabulary) + rng.choice([" ", "\n\t ", "\x0b"]) + " ".join(shared[a:a + rng.randrange(25)]) + " " + words(9, vocabulary)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "same " * 40), (104, "same " * 40), (105, "é x " * 20), (106, "Words " * 14), (107, "words " * 14)]
    rows += [(200 + k, rows[0][1]) for k in range(10)] + [(200, rows[0][1]), (200, rows[1][1]), (None, rows[2][1]), (None, rows[2][1]), (-5, rows[3][1])]
    rows += [(300, words(20_000, 3000)), (301, "x" * 300_000 + " " + words(30))]
    rows.append((302, rows[-2][1] + " y " + rows[-1][1]))
    docs = table([(*r, 1, 2) for r in rows], "doc_id long, text string, chunk long, row long")
    got = substring_dedup.dedup(docs, window, first=first, chunk_bytes=1 << 12).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got], key=str) == brute_substrings(rows, window)


def test_levels():
    assert substring_dedup.lengths(13) == [7, 13]
    assert substring_dedup.lengths(13, 1) == [1, 2, 4, 8, 13]
    assert substring_dedup.lengths(1) == [1]


def test_substrings_with_colliding_level_hashes(table, monkeypatch):
    """The first level's short hashes only choose candidates: with all of them equal the result is the same."""
    rows = [(k, words(30, 50)) for k in range(20)] + [(50, "a b " * 10), (51, "a b " * 10)]
    real = substring_dedup.packed
    assert real(np.array([5, 9], np.uint64))[0] == 5
    docs = table(rows, "doc_id long, text string")
    got = substring_dedup.dedup(docs, 13, first=1, keep_text=True).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got], key=str) == brute_substrings(rows, 13)


def test_substrings_of_nothing(table):
    assert substring_dedup.dedup(table([], "doc_id long, text string")).collect() == []
    got = substring_dedup.dedup(table([(1, None), (None, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got} == {(1, 0, 0, ""), (None, 0, 0, "")}


def test_packing_of_values():
    for x in (np.array([], np.uint64), np.array([7], np.uint64), np.array([3, 1 << 63, 5, (1 << 64) - 1], np.uint64)):
        low, width, planes = substring_dedup.packed(x)
        assert (substring_dedup.unpacked(low, width, planes, np.uint64) == x).all()
    x = np.array([-5, 0, 1 << 40], np.int64)
    assert (substring_dedup.unpacked(*substring_dedup.packed(x), np.int64) == x).all()


# centroid clustering


def brute_clusters(rows, k, rounds, width):
    v = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    v = [(i, np.array([max(-(1 << 26), min(1 << 26, x)) for x in e], object)) for i, e in v]
    c = [np.array(e, object) for _, e in sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), list(e)) for i, e in v)[:k]]
    near = lambda e: min((int(((e - x) ** 2).sum()), j) for j, x in enumerate(c))
    for _ in range(rounds):
        to = [near(e)[1] for _, e in v]
        for j in range(len(c)):
            own = [e for (_, e), t in zip(v, to) if t == j]
            if own:
                c[j] = np.array([sum(x) // len(own) for x in zip(*own)], object)
    at = [near(e) for _, e in v]
    total = {j: sum(d for d, t in at if t == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, t, d, total[t], sum(total.values()), sha[t]) for (i, _), (d, t) in zip(v, at)], key=str)


@pytest.mark.parametrize(("width", "k", "n"), [(4, 8, 400), (64, 8, 150), (1, 3, 50), (3, 8, 5)])
def test_centroids(table, width, k, n):
    r = np.random.default_rng(5)
    middle = r.normal(size=(4, width))
    rows = [(int(i), [float(np.float32(x)) for x in middle[r.integers(4)] + 0.2 * r.normal(size=width)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(3, rows[1][1]), (3, rows[1][1]), (None, rows[2][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * (width + 1)), (2003, [None] * width), (2004, [float("nan")] * width), (2005, [float("inf")] * width)]
    docs = table([(*x, 1, "v") for x in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got = centroids.cluster(docs, k, 6, width, block=8).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute_clusters(rows, k, 6, width)


def test_centroids_hold_very_large_components(table):
    rows = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(12)]
    got = centroids.cluster(table(rows, "vec_id long, embedding array<float>"), 2, 3, 2).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute_clusters(rows, 2, 3, 2)


def test_no_vectors(table):
    assert centroids.cluster(table([], "vec_id long, embedding array<float>"), 8, 10, 64).collect() == []


def test_hilbert_neighbours_touch():
    """Every place of the curve is visited once, and consecutive places differ by one step in one coordinate."""
    for axes, bits in ((2, 3), (3, 2), (5, 2)):
        n = 1 << axes * bits
        cells = np.stack([(np.arange(n) >> bits * a) & ((1 << bits) - 1) for a in range(axes)], axis=1)
        key = centroids.hilbert(cells, bits)
        order = cells[sorted(range(n), key=lambda i: key[i].tobytes())]
        assert len({k.tobytes() for k in key}) == n
        assert (np.abs(np.diff(order.astype(int), axis=0)).sum(axis=1) == 1).all()


def test_boxes_drop_centroids_that_cannot_win(table):
    r = np.random.default_rng(2)
    middle = 5 * r.normal(size=(8, 16))
    rows = [(i, [float(x) for x in middle[i % 8] + 0.1 * r.normal(size=16)]) for i in range(4000)]
    notes = []
    centroids.cluster(table(rows, "vec_id long, embedding array<double>"), 8, 5, 16, notes=notes).count()
    assert all(seen <= pairs and pairs == 8 * 4000 for seen, pairs in notes)
    assert notes[-1][0] < 0.75 * notes[-1][1]
