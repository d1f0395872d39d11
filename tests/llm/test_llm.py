"""Operators against brute force, exact round trips and held-out rows; edge cases of each."""

import datetime
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from passageworks.llm import anchors, base, chat, decontaminate, langid, piece_bpe, sharding, simhash, suffix_dedup, token_count, topk_search, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, score double, row long"
rng = random.Random(7)
EDGE = [(1, None, None, None, None), (2, "", "en", 1.0, 5), (3, "a", None, None, 5), (None, "some words here", "en", None, None), (3, "a", None, None, 5)]


def words(n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


# suffix-array dedup


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        t = (text or "").encode()
        m = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            if t[s:s + 100] in seen:
                m[s:s + 100] = True
            seen.add(t[s:s + 100])
        out[i] = len(t), int(m.sum()), int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(table, hot):
    shared = words(60)
    rows = [(k, words(rng.randint(0, 80)) + shared[rng.randint(0, 40):rng.randint(60, 300)] + words(5)) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "ab" * 300), (103, "é中" * 200), (104, "x" * 99), (105, "x" * 100), (106, "x" * 101)]
    rows += [(200 + k, rows[0][1]) for k in range(10)]
    big = words(60_000)
    rows += [(300, big), (301, big[5000:200_000] + "?" + big[100_000:])]
    got = suffix_dedup.dedup(table(rows, "doc_id long, text string"), chunk_bytes=1 << 14, hot_places=hot).collect()
    assert {r.doc_id: tuple(r)[2:6] for r in got} == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got if r.doc_id < 100)


def test_suffix_sort_ties():
    data, starts = b"", []
    base = bytes(rng.choice(b"ab") for _ in range(150))
    for _ in range(80):
        x = bytearray(base if rng.random() < 0.8 else b"a" * 150)
        x[rng.randrange(150)] = rng.choice(b"abc")
        starts += range(len(data), len(data) + 51)
        data += bytes(x)
    rank = np.array(rng.sample(range(len(starts)), len(starts)))
    best = {}
    for s, r in zip(starts, rank):
        best[data[s:s + 100]] = min(best.get(data[s:s + 100], 1 << 60), r)
    got = suffix_dedup.repeats(np.frombuffer(data, np.uint8), np.array(starts), rank)
    assert got.tolist() == [best[data[s:s + 100]] < r for s, r in zip(starts, rank)]


def test_suffix_sort_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "hashes", lambda p, a, b, which=0: np.zeros(len(a), np.uint64))
    data = b"a" * 100 + b"b" * 100 + b"a" * 100
    got = suffix_dedup.repeats(np.frombuffer(data, np.uint8), np.array([0, 100, 200]), np.array([0, 1, 2]))
    assert got.tolist() == [False, False, True]


def test_windows_have_one_anchor_each():
    data = np.frombuffer(words(4000).encode(), np.uint8)
    sizes = np.array([0, 50, 100, 7000, len(data) - 7150])
    _, _, lo, n = anchors.chunk_anchors(data, sizes)
    assert n.sum() == np.maximum(sizes - 99, 0).sum() and n.max() <= anchors.SPAN


def test_drop_repeats_keeps_rows_and_columns(table):
    d = table([(*EDGE[0][:2], None, None, 4), *[(k, words(40), "en", 0.5, k) for k in range(5)], (9, "", "en", None, None)], DOCS)
    out = suffix_dedup.drop_repeats(d)
    assert out.columns == d.columns and sorted(map(str, out.collect())) == sorted(map(str, d.collect()))


def disk(path):
    return sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*") if f.is_file())


def test_suffix_dedup_notes_are_small(table, tmp_path, monkeypatch):
    """What chunks write of their repeated pieces, less the texts themselves, stays below the texts' size, though all repeats."""
    texts = [words(2000) for _ in range(40)]
    d = table([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    for module in (suffix_dedup, base):
        monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path))
    got = suffix_dedup.dedup(d, keep_text=False, chunk_bytes=1 << 16).collect()
    assert [r.n_bytes if r.doc_id >= 40 else 0 for r in got] == [r.n_removed for r in got]
    chunks, all_of_it = sum(disk(str(f)) for f in tmp_path.glob("chunks*")), disk(str(tmp_path))
    assert 0 < chunks and all_of_it - chunks < 0.8 * 3 * sum(map(len, texts))


def test_parts_of_a_piece_in_very_many_places():
    """Four parts at most, each window in one, and equal windows of two pieces in parts of equal core."""
    data = np.frombuffer(words(3000).encode(), np.uint8)
    _, _, lo, n = anchors.chunk_anchors(data, np.array([len(data)]))
    p = anchors.prefixes(data)
    anchor, _ = suffix_dedup._anchored(p, lo)
    which, first, m, core = suffix_dedup.hot_parts(p, lo, n, anchor)
    assert np.bincount(which).max() <= 4 and (np.bincount(which, weights=m) == n).all()
    moved = np.frombuffer(b"?" * 70 + data.tobytes()[137:], np.uint8)
    _, _, lo2, n2 = anchors.chunk_anchors(moved, np.array([len(moved)]))
    q = anchors.prefixes(moved)
    which2, first2, m2, core2 = suffix_dedup.hot_parts(q, lo2, n2, suffix_dedup._anchored(q, lo2)[0])
    at = {lo[w] + f + k: c for w, f, x, c in zip(which, first, m, core) for k in range(x)}
    at2 = {lo2[w] + f + k: c for w, f, x, c in zip(which2, first2, m2, core2) for k in range(x)}
    assert len(at) == n.sum() and len(at2) == n2.sum()
    assert all(at2[s] == at[s + 67] for s in range(70, len(moved) - 99))


def test_drop_repeats_moves_no_text(spark, table):
    """Rows stay with their text's chunk: what is shuffled goes by chunk or bucket, and no chunk moves; columns of any kind are unchanged."""
    shared = words(60)
    rows = [(k, None if k == 7 else words(30) + shared + words(9), k % 3, k, {"a": [k, None]}, datetime.datetime(2024, 1, 1 + k), None if k % 2 else bytes([k])) for k in range(20)]
    d = table(rows, "doc_id long, text string, n_chars int, `a b` long, m map<string,array<int>>, ts timestamp, b binary")
    before = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = suffix_dedup.drop_repeats(d, chunk_bytes=1 << 10)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got, kept = {r.doc_id: r for r in out.collect()}, {r.doc_id: r.kept for r in suffix_dedup.dedup(d).collect()}
        full = {r.doc_id: r for r in d.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(re.findall(r"Exchange (\w+\(\w+)#", plan)) == {"hashpartitioning(chunk", "hashpartitioning(bucket"} and "_row" not in plan
    assert out.columns == d.columns and out.dtypes == d.dtypes and got.keys() == full.keys()
    for k, r in got.items():
        assert r.text == (None if k == 7 else kept[k]) and r.n_chars == (None if k == 7 else len(kept[k])) and r[3:] == full[k][3:]
    assert sum(shared in (r.text or "") for r in got.values()) == 1


# SimHash


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", " \t", "A", "a B", "É x\x1cy\x0bz q", *[words(rng.randint(0, 50)) for _ in range(50)]]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("dense", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, dense):
    fps = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ rng.choice([0, 1 << rng.randrange(64)]) for _ in range(rng.randint(1, 60))}
    fps = sorted(fps)
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.leakage_groups(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense)).collect()
    component = {r.node: r.component for r in got}
    pairs = lambda name: {frozenset((a, b)) for a in signed for b in signed if a < b and name(a) == name(b)}
    where = {f: root(k) for k, f in enumerate(signed)}
    assert pairs(lambda f: component.get(f, f)) == pairs(where.get)


def test_near_groups_and_stage(table):
    text = words(300)
    rows = [(5, text, "en", None, 1), (4, text.upper(), "en", None, 1), (7, text, "fr", None, 1), *EDGE, (8, words(300), "en", 0.1, 3)]
    d = table(rows, DOCS)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_groups(d).collect()}
    assert {c for (i, _), c in got.items() if i in (4, 5, 7)} == {4} and got[1, 0] == 1 and got[2, 0] == 1
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 8]


# language


def test_language(table):
    make = lambda ab, n: [words(rng.randint(3, 40), ab) for _ in range(n)]
    rows = [(k, t, lang, None, None) for k, (t, lang) in enumerate([*[(t, "xx") for t in make("abcde", 80)], *[(t, "yy") for t in make("defgh", 80)]])]
    m = langid.train(table(rows, DOCS))
    test = table([(1000 + k, t, lang, None, None) for k, (t, lang) in enumerate([*[(t, "xx") for t in make("abcde", 20)], *[(t, "yy") for t in make("defgh", 20)]])] +
                 [*EDGE, (2000, "123 !?", "xx", None, None), (2001, "zq" * 40_000, "xx", None, None)], DOCS)
    out = langid.identify(test, m).collect()
    assert all(r.lang_pred == r.lang for r in out if r.doc_id and 1000 <= r.doc_id < 1040) and all(0 <= r.score <= 1 for r in out)
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in out if r.doc_id in (1, 2, 2000))
    assert [r.rejected for r in out if r.doc_id == 2001] == [True]


def test_probabilities_sum_to_one():
    g, n = np.unique(langid.codes([words(50) for _ in range(20)])[0], return_counts=True)
    m = langid.build({"xx": (g, n)})
    seen = np.unique(np.concatenate([g & np.uint64(0xFFFF), [np.uint64(ord("z"))]]))
    for context in (g[0] >> np.uint64(16), np.uint64(ord("q")) << np.uint64(32)):
        p = np.exp(-m.entropy(np.array([context << np.uint64(16) | c for c in seen], np.uint64))[:, 0])
        assert abs(p.sum() - 1) < 1e-3


def test_language_without_labels(table):
    d = table([(1, "abc", None, None, None)], DOCS)
    assert langid.train(d) is None and langid.identify(d, None).first().lang_pred == "und"


def test_language_joined_model_is_the_broadcast_one(table, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 500)  # several blocks in a partition
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))  # many 4-grams that occur once or twice
    rows = [(k, words(rng.randint(3, 40), ab), lang, None, None) for k, (ab, lang) in enumerate([("abcde", "xx"), ("defgh", "yy"), (wide, "zz")] * 40)]
    train = table(rows, DOCS)
    a, b = langid.train(train), langid.train(train, local=10)
    assert isinstance(b, langid.Joined) and len(a.grams[0]) == b.own[0].count() == train_grams(rows)
    assert np.allclose(a.centre, b.fit.centre, atol=1e-4) and np.allclose(a.spread, b.fit.spread, rtol=1e-2, atol=1e-4) and a.scale == b.fit.scale
    test = table([(1000 + k, words(rng.randint(3, 40), ab + "xyz"), "xx", 1.0, 5) for k, ab in enumerate(["abcde", "defgh", wide] * 5)] + EDGE, DOCS)
    key = lambda r: (str(r.doc_id), r.text or "")
    x, y = [sorted(langid.identify(test, m).collect(), key=key) for m in (a, b)]
    assert len(x) == len(y) == 20
    for p, q in zip(x, y):
        assert (p.doc_id, p.text, p.row, p.lang_pred, p.rejected) == (q.doc_id, q.text, q.row, q.lang_pred, q.rejected)
        assert abs(p.cross_entropy - q.cross_entropy) < 1e-3 if p.cross_entropy is not None else q.cross_entropy is None


def train_grams(rows):
    return len(np.unique(langid.codes([r[1] for r in rows])[0]))


def test_language_limits_of_rare_languages(table):
    rows = [(k, words(rng.randint(3, 40), ab), lang, None, None) for k, (ab, lang) in enumerate([("abcde", "xx"), ("defgh", "yy")] * 400)]
    rare = [(k, words(60, "stuvw"), "zz", None, None) for k in range(5000, 5002)]
    d = table(rows + rare, DOCS)
    m = langid.train(d, calibration=40)  # a sample of all languages together mostly has no row of zz
    assert np.isfinite(m.centre).all() and m.spread[2, 0] > 0.8 * m.spread[:2, 0].min() and m.centre[2] >= np.median(m.centre[:2])
    sizes = {"xx": 400, "yy": 400, "zz": 2}
    got = [r.lang for r in langid.sample_of(d, sizes, 40).collect()]
    assert [got.count(x) for x in sizes] == [40, 40, 2]
    junk = table([(1, "sq" * 4000, "zz", None, None), (2, rare[0][1], "zz", None, None)], DOCS)
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in langid.identify(junk, m).collect()}[2] == ("zz", False)
    same = table([(7, words(20, "abcde"), "xx", None, None) for _ in range(100)], DOCS)  # one id, and 40 of its rows
    assert langid.sample_of(same, {"xx": 100}, 40).count() == 40


# sharding


def test_sharding(table):
    rows = [(k, rng.randint(0, 50)) for k in range(300)] + [(5000, 400), (7, 90), (7, 90), (None, 3), (8, None)]
    out = sharding.assign(table(rows, "doc_id long, n_bytes long"), 100, step=3).collect()
    assert len(out) == len(rows)
    total, key = {}, {}
    for r in out:
        total[r.shard] = total.get(r.shard, 0) + (r.n_bytes or 0)
        key.setdefault(r.shard, set()).add(r.doc_id)
    assert all(r.shard_bytes == total[r.shard] for r in out) and all(t <= 100 or len(key[s]) == 1 for s, t in total.items())
    assert not any(a != b and b.startswith(a) for a in total for b in total)
    for s in total:  # a split was needed: the buddy's rows would not fit in the parent
        if s and total[s] <= 100:
            assert sum(t for x, t in total.items() if x.startswith(s[:-1])) > 100


def test_sharding_empty(table):
    assert sharding.assign(table([], "doc_id long, n_bytes long"), 10).collect() == []


# toxicity


def test_segments_are_the_maximal_ones():
    def brute(x, at=0):
        if not any(v > 0 for v in x):
            return []
        b, e = max(((b, e) for b in range(len(x)) for e in range(b + 1, len(x) + 1)), key=lambda p: (round(sum(x[p[0]:p[1]]), 9), p[0] - p[1]))
        return brute(x[:b], at) + [(at + b, at + e)] + brute(x[e:], at + e)

    for _ in range(60):
        x = [rng.choice([-3, -2, -1.5, -1, 1.25, 2.5, 4]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [s[:2] for s in toxicity.segments(np.array(x))] == brute(x)


def test_toxicity(table):
    rows = [(k, words(60), int(k % 5 == 0)) for k in range(400)]
    rows = [(k, t + (" vilex" + rng.choice("abc") + " " + words(3)) * 2 if y else t, y) for k, t, y in rows]
    d = table(rows, "doc_id long, text string, toxic int")
    train, test = d.where("doc_id < 300"), d.where("doc_id >= 300")
    m = toxicity.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    out = toxicity.score_documents(test, m).collect()
    assert all(r.predicted == r.toxic and 0 <= r.score <= 1 for r in out)
    assert all(bool(r.passages) == bool(r.toxic) for r in out)
    e = toxicity.score_documents(table(EDGE, DOCS), m).collect()
    assert len(e) == len(EDGE) and all(r.predicted == 0 for r in e)


def test_toxicity_scores_keep_the_share_of_the_classes(table):
    # 400 of 4,000 clean texts and all 200 toxic ones have the insult: a third of its texts are toxic
    make = lambda k, bad, y: (k, words(12) + (" qqqq zzzz" if bad else ""), y)
    d = table([make(k, k % 10 == 0, 0) for k in range(4000)] + [make(5000 + k, True, 1) for k in range(200)], "doc_id long, text string, toxic long")
    docs, labels = d.select("doc_id", "text"), d.select("doc_id", "toxic")
    assert toxicity.class_weights(labels, 800).tolist() == [10, 1] and toxicity.class_weights(labels).tolist() == [1, 1]
    test = table([make(9000 + k, True, 0) for k in range(20)], "doc_id long, text string, toxic long")
    for bound in (toxicity.SAMPLE, 800):  # all clean texts, or a tenth of them
        m = toxicity.train(docs, labels, bound=bound)
        p = [r.score for r in toxicity.score_documents(test, m).collect()]
        assert m.score and 0.1 < np.mean(p) < 0.5, (bound, np.mean(p))
    x, y = np.ones((1000, 1)), np.repeat([0.0, 1.0], [500, 500])  # one to one in the sample, 32 to one in truth
    assert abs(toxicity._logistic(x, y, each=np.where(y == 0, 32.0, 1.0))[0] + np.log(32)) < 0.01


def test_toxicity_without_labels(table):
    d = table([(1, "a b", 0)], "doc_id long, text string, toxic int")
    assert toxicity.score_documents(d, toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))).first().predicted == 0


# tokens


def odd_texts():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    alphabet = " aábcdeth▁\n\t0123<s>/中文字é́ﬁ　😀\x00ing"
    out = ["", " ", "  ", " " * 37, "▁" * 21 + "x", "\n\n\n  \n", "a" * 500, "the" * 300, "=" * 101, "中文" * 3000]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return sp, out + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(300)]


def test_pieces_are_the_librarys():
    sp, texts = odd_texts()
    c = piece_bpe.Codec(PIECES)
    want = sp.encode(texts, add_bos=True, add_eos=True)
    got = c.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want and [c.decode(g) for g in got] == [sp.decode(w) for w in want]


def test_piece_columns(table):
    out = piece_bpe.encode_decode(table([(*r[:2], "n", 0.5, 1) for r in EDGE], "doc_id long, text string, ids string, score double, row long"), PIECES)
    empty = [r for r in out.collect() if r.doc_id in (1, 2)]
    assert all(r.ids == [1, 2] and r.n_tokens == 2 and r.decoded == "" for r in empty) and out.count() == len(EDGE)


def test_token_counts_are_the_unigram_models():
    from tokenizers import Tokenizer, models

    from passageworks.llm.pieces import vocabulary

    v = vocabulary(PIECES)
    unigram = Tokenizer(models.Unigram([(p, float(s)) for p, s in zip(v.pieces, v.scores)], v.unk, True))
    c = token_count.Counter(PIECES)
    texts = ["".join(rng.choice(" aábcdeth\n\t0123/中文字é́ﬁ　😀ing") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    assert [c.text(t) for t in texts] == [len(unigram.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) for t in texts]
    assert c.text("") == 0


def test_token_columns(table):
    out = token_count.count_tokens(table(EDGE, DOCS), PIECES).collect()
    assert len(out) == len(EDGE) and all(r.n_tokens == 0 for r in out if r.doc_id in (1, 2))


# top-k


def test_topk(table):
    rows = [(k % 190, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(9)]) for k in range(200)]
    rows += [(500, None), (520, [None, 1.0]), (540, [float("nan")]), (560, [float("inf")]), (None, [1.0])]
    d = table([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, rank int")
    got = topk_search.top_k(d, 7, 10, candidate_block=40, query_block=6).collect()
    v = [(i, [int(np.floor(64 * x)) for x in e]) for i, e in rows[:200]]
    want = []
    for q, (i, e) in enumerate(v):
        if i % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), j) for c, (j, f) in enumerate(v) if c != q)
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:7])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(d.where("vec_id < 0"), 7, 10).collect() == []


# chat


def test_chat_round_trip(table):
    hard = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>", "[\\INST]", "a\\", "[/INST", "<", "", None, "<s>[user]x</s>", " [/INST]", "[INST] ", "\\\\n\n</s", "x" * 50_000]
    roles = ["user", "assistant", "system", None, "a]b\\c<s>\nd", "\\c", "\\\\l]"]
    rows = [(c, t, rng.choice(roles), rng.choice(hard)) for c in range(40) for t in range(rng.randint(1, 200 if c == 0 else 6))] + [(50, 1, "user", "a"), (50, 1, "user", "a"), (None, None, "user", "b")]
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1] or 0)]
        got = [(t.role, t.text) for t in out[c].turns]
        assert got == own
        assert out[c].loss_text == "".join(t for r, t in own if r == "assistant")
    assert len(out[50].turns) == 2


# decontamination


def test_contamination(table):
    items = [(1, words(20)), (10, words(40)), (2, "Short Item Of É"), (3, ""), (4, None), (2, "again short"), (None, words(15)), (6, "rep " * 20)]
    text = [t or "" for _, t in items]
    rows = [(0, words(30) + " " + text[0] + " " + words(10)), (1, text[1][:120]), (2, "x short item of É y"), (3, None), (4, ""), (5, " ".join(text[1].split()[5:17])),
            (6, " ".join(text[1].split()[5:18])), (7, text[6]), (8, "rep " * 50), (9, "AGAIN, Short! " + words(400)), (9, "again short"), (None, text[0])]
    rows += [(100 + k, words(40)) for k in range(20)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for item, u in items:
            g = split(u)
            k = min(13, len(g))
            for s in range(len(g) - k + 1) if g else []:
                for a in range(len(w) - k + 1):
                    if w[a:a + k] == g[s:s + k]:
                        hit |= set(range(a, a + k))
                        names |= {str(item)} - {"None"}
        want.append((i, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    d, b = table([(*r, "x") for r in rows], "doc_id long, text string, items string"), table(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in got))) == sorted(map(str, want))
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x[4] for x in want)
    assert decontaminate.contamination(d, b.where("item_id < 0")).where("n_hit > 0").count() == 0


def test_large_tables_are_not_broadcast_by_file_size(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda rows: spark.range(1000).join(decontaminate._small(t, rows), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(100_000) and "SortMergeJoin" in plan(99_999) and "Broadcast" not in plan(99_999)


def test_contamination_by_shuffled_joins(table, monkeypatch):
    texts = [words(40) for _ in range(30)]
    d = table([(k, t + (" " + texts[k % 5] if k >= 20 else "")) for k, t in enumerate(texts)], "doc_id long, text string")
    b = table([(k, texts[k] if k < 4 else " ".join(texts[k].split()[:7])) for k in range(8)], "item_id long, text string")
    want = sorted(map(str, decontaminate.contamination(d, b).collect()))
    for name in ("BROADCAST_ROWS", "CORPUS_ROWS"):
        monkeypatch.setattr(decontaminate, name, 0)
    for slots in (1 << 20, 3):
        monkeypatch.setattr(decontaminate, "SLOTS", slots)
        got = decontaminate.contamination(d, b).collect()
        assert sorted(map(str, got)) == want and sum(r.n_hit > 0 for r in got) > 10


def test_empty_tables(table):
    d = table([], DOCS)
    assert suffix_dedup.dedup(d).count() == simhash.near_groups(d).count() == 0
    assert token_count.count_tokens(d, PIECES).count() == piece_bpe.encode_decode(d, PIECES).count() == langid.identify(d, langid.train(d)).count() == 0
    assert decontaminate.contamination(d, table([], "item_id long, text string")).count() == 0
    assert chat.format_conversations(table([], "conv_id long, turn long, role string, text string")).count() == 0


# the pipeline and the registered queries


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = p.language(spark, docs, sf)
    assert lang.columns == docs.columns
    out = p.run(spark, sf)
    n = out.count()
    assert 0 < n < docs.count() and out.agg(F.count_distinct("doc_id")).first()[0] == n


@pytest.mark.parametrize("name", ["op4_shards", "op7_topk", "op8_chat", "op10_decontaminate"])
def test_queries_match_sql(spark, sf, name):
    import duckdb

    import __spark_entry__ as entry
    from check_oracle import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_native_plans(spark, sf):
    import __spark_entry__ as entry

    for name in ("op8_chat", "op10_decontaminate"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
