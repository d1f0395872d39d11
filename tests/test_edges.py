"""Hand-made cases: byte limits, version order, skew helpers, file sources, alternative plans."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passageworks.functions import scale, text as TX
from passageworks.operators import conversations as C
from passageworks.operators import enrichment as E
from passageworks.operators import evaluation as M
from passageworks.operators import fragments as FR
from passageworks.operators import knowledge as K
from passageworks.operators import observations as V
from passageworks.operators import retrieval as R
from passageworks.sources import files as FI
from passageworks.streaming import state as X


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("text", ["a" * 100, "é" * 40, "汉字" * 30, "x" + "𝒳" * 20, "", "short"])
def test_cut_bytes_keeps_runes_and_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(TX.cut_bytes(F.col("t"), 16).alias("p")).first()["p"]
    assert "".join(got) == text and all(len(p.encode()) <= 16 for p in got)
    assert all(len((a + b[:1]).encode()) > 16 for a, b in zip(got, got[1:]))


def test_pack_covers_lines_within_limit(spark):
    text = "# h\n" + "\n".join(["汉" * n for n in (3, 50, 1, 1, 7, 0, 2)])
    fr = FR.fragments(docs(spark, text), 30).orderBy("start_line", "part").collect()
    assert all(len(r["content"].encode()) <= 30 for r in fr)
    assert "".join("".join(r["content"].split()) for r in fr) == "".join(text.split("\n")[1:])
    assert fr[0]["section"].startswith("h（第1部分）")


def test_sections_ignore_headings_in_fences(spark):
    s = FR.sections(docs(spark, "intro\n# A\nx\n```\n# no\n```\n## B c\ny\n#tag\n")).orderBy("section_no").collect()
    assert [(r["section"], r["start_line"]) for r in s] == [("正文", 1), ("A", 3), ("B c", 8)]


def test_terms_have_runs_and_pairs(spark):
    got = spark.createDataFrame([("Ab c，汉字x",)], "t string").select(TX.terms(F.col("t")).alias("t")).first()["t"]
    assert set(got) == {"ab", "c", "汉字x", "汉字", "字x"}


def test_versions_compare_by_position(spark):
    revs = spark.createDataFrame([(1, "DEVICE", "m", None, None, None, "R2", "R10", None, None, "p")],
                                 "revision_id long, scope string, model string, firmware string, driver string, hardware_revision string, fw_min string, fw_max string, drv_min string, drv_max string, policy_id string")
    dev = spark.createDataFrame([(1, "m", "R9", None, None), (2, "m", "R11", None, None), (3, "m", None, None, None)],
                                "device_id long, model string, firmware string, driver string, hardware_revision string")
    pol = spark.createDataFrame([("p", "m", ["R2", "R9", "R10", "R11"], [])], "policy_id string, model string, firmware_order array<string>, driver_order array<string>")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 9)], "revision_id long, device_id long")
    got = {r["device_id"]: r["status"] for r in K.assess(pairs, revs, dev, pol).collect()}
    assert got == {1: "MATCH", 2: "MISMATCH", 3: "UNKNOWN", 9: "UNKNOWN"}


def test_running_equals_window_on_a_hot_key(spark):
    rng = np.random.default_rng(1)
    data = [("hot" if i % 3 else f"k{i % 7}", i, int(rng.integers(0, 100))) for i in range(600)]
    df = spark.createDataFrame(data, "k string, at long, v long").withColumn("chunk", F.floor(F.col("at") / 50))
    got = {r["at"]: (r["n"], r["s"], r["m"], r["l"]) for r in scale.running(
        df, ["k"], "chunk", ["at"], {"n": ("count", "v"), "s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}).collect()}
    seen = {}
    for k, at, v in data:
        h = seen.setdefault(k, [])
        assert got[at] == (len(h), sum(h), max(h) if h else None, h[-1] if h else None)
        h.append(v)


def test_exact_quantiles_with_ties(spark):
    v = [float(x) for x in np.random.default_rng(2).integers(0, 9, 501)] + [1e9]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    r = scale.exact_quantiles(df, [], "v", {"p50": (0.5, lambda n: F.floor((n - 1) / 2) + 1), "p95": (0.95, lambda n: F.ceil(n * F.lit(95) / 100)), "top": (1.0, lambda n: n)}).first()
    s = sorted(v)
    assert (r["p50"], r["p95"], r["top"]) == (s[(len(s) - 1) // 2], s[-(-len(s) * 95 // 100) - 1], s[-1])


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(80)] + [(500, 501)]
    got = {r["node"]: r["component"] for r in M.leakage_groups(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[200 + i] for i in range(80)} == {100} and got[501] == 500


def fragments_frame(spark):
    words = "alpha beta gamma delta 汉字 epsilon".split()
    rows = [(i, i, f"t{i % 3}", "s", " ".join(words[(i * j) % 6] for j in range(1, 9)), " ".join(words[(i + j) % 6] for j in range(4))) for i in range(60)]
    return spark.createDataFrame(rows, "fragment_id long, revision_id long, title string, section string, content string, retrieval_content string")


def as_set(df):
    return {tuple(r) for r in df.select("query_id", "fragment_id", "rank", "score").collect()}


def test_query_blocks_give_the_same_results(spark, monkeypatch):
    f = fragments_frame(spark)
    q = spark.createDataFrame([(1, "alpha gamma 汉字"), (2, "delta beta beta"), (3, "nothing"), (4, ""), (5, None)], "query_id long, text string")
    lex = f.withColumn("text", F.concat_ws(" ", "title", "section", "content"))
    a, b = as_set(R.lexical_topk(q, lex, 5)), as_set(R.bm25_topk(q, f, 7))
    assert as_set(R.lexical_topk(q, lex, 5, block_rows=1)) == a and as_set(R.bm25_topk(q, f, 7, block_rows=2)) == b and len(b) == 14
    for name in ("BLOCK_CELLS", "GATHER_CELLS"):
        monkeypatch.setattr(R, name, 2)
    assert as_set(R.lexical_topk(q, lex, 5)) == a and as_set(R.bm25_topk(q, f, 7)) == b
    assert as_set(R.lexical_topk(q.limit(0), lex, 5)) == set() and as_set(R.bm25_topk(q, f.limit(0), 7)) == set()


def test_vector_blocks_give_the_same_results(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 5, i // 3, [float(x) for x in rng.normal(size=8)]) for i in range(90)]
    v = spark.createDataFrame(rows, "vec_id long, label int, trio long, embedding array<float>").repartition(7)
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda d: {tuple(r) for r in d.collect()}
    assert key(R.dense_topk(q, v, 4, dims=8)) == key(R.dense_topk(q, v, 4, dims=8, block_rows=20))
    m = np.array([r[3] for r in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    for owner, at in (("label", 1), ("trio", 2)):
        ids = np.array([r[at] for r in rows])
        want = set()
        for i in range(90):
            top = sorted((-s[i][ids == o].max(), o) for o in set(ids.tolist()))[:3]
            want |= {(i, o, n + 1) for n, (_, o) in enumerate(top)}
        for size in (20, 4096):
            got = R.multivector_topk(q, v, owner, 3, dims=8, block_rows=size)
            assert {(r["query_id"], r[owner], r["rank"]) for r in got.collect()} == want


def test_nearest_vectors_are_those_of_all_pairs(monkeypatch):
    from passageworks.operators import topk

    monkeypatch.setattr(topk, "TILE_QUERIES", 16)
    monkeypatch.setattr(topk, "TILE_HITS", 40)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x[100:180] = x[7]  # many copies of one vector
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50] = np.nan
    s = np.round(x @ x.T, 6)
    order = rng.permutation(300)
    for ids, merge in ((np.arange(300), False), (np.array([f"f{i:03d}" for i in range(300)], object), False), (np.arange(300) // 3, True), (np.arange(300) % 3, True)):
        best = topk.NearestVectors(x, 5, 6, merge)
        put, made = best._put, []
        best._put = lambda a, who, *rest: (made.append(len(who)), put(a, who, *rest))
        for a in range(0, 300, 64):
            best.add(ids[order[a:a + 64]], x[order[a:a + 64]])
        got = {}
        kinds = (pa.int64(), pa.string() if ids.dtype == object else pa.int64(), pa.float64())
        for b in best.batch(list(range(300)), ("q", "id", "score"), kinds):
            for r in b.to_pylist():
                got.setdefault(r["q"], []).append((r["score"], r["id"]))
        for q in set(range(300)) - {50}:
            each = {}
            for i in set(range(300)) - {50}:
                each[ids[i]] = max(each.get(ids[i], -9), s[q, i])
            want = sorted(((v, i) for i, v in each.items()), key=lambda e: (-e[0], e[1]))[:5]
            assert [i for _, i in got[q]] == [i for _, i in want] and np.allclose([v for v, _ in got[q]], [v for v, _ in want], atol=2e-6)
        assert 50 not in got and sum(made) < 300 * 130


def test_embedding_leaves_out_refused_texts(spark):
    t = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "x" * 9), (5, "汉字\U0001D4B3")], "id long, text string")
    encode = lambda texts: [[len(x), 0.0] for x in texts]
    assert {r["id"]: list(r["embedding"]) for r in R.embed(t, encode, 2, batch=1, max_chars=8).collect()} == {1: [1.0, 0.0], 5: [1.0, 0.0]}
    assert {tuple(r) for r in R.refused_texts(t, 8).collect()} == {(2, "EMPTY"), (3, "EMPTY"), (4, "TOO_LONG")}


def test_packing_skips_but_rules_stop(spark):
    hits = spark.createDataFrame([(1, 10, 1, 60), (1, 11, 2, 90), (1, 12, 3, 30), (1, 13, 4, 20)], "query_id long, fragment_id long, rank long, bytes long")
    assert [r["fragment_id"] for r in R.pack_budget(hits, 100, 5).orderBy("rank").collect()] == [10, 12]
    h = hits.select(F.col("query_id").alias("run_id"), "fragment_id", F.col("fragment_id").alias("revision_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("rank").alias("ordinal"), "bytes")
    rules = spark.createDataFrame([(10, "r", 1, 1)], "revision_id long, rule_id string, start_line int, end_line int")
    assert [r["fragment_id"] for r in V.rules_for_fragments(rules, h, 100)[0].collect()] == [10]


def test_chunks_respect_the_limit(spark):
    d = docs(spark, "\n\n".join("p" * n for n in (40, 50, 60, 30)))
    b = FR.blocks(d).withColumn("block_id", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("doc_id").orderBy("start_line")).cast("long"))
    plan = spark.createDataFrame([(0, 1, 1, 4)], "doc_id long, chunk_no long, start_block long, end_block long")
    chunks, bad = E.apply_boundaries(d, b, plan, 100)
    assert [len(r["content"]) for r in chunks.orderBy("part").collect()] == [92, 92] and bad.count() == 0


def test_assets_split_at_source_rows(spark):
    f = spark.createDataFrame([("f", "sec", 5, 8, "a\nb\nc\nd")], "fragment_id string, section string, start_line long, end_line long, content string")
    q = spark.createDataFrame([("f", 1, "q")], "fragment_id string, ordinal long, text string")
    a = spark.createDataFrame([("f", 5 + i % 4, 5 + i % 4, "IMAGE", f"d{i}") for i in range(20)], "fragment_id string, start_line long, end_line long, kind string, text string")
    got = E.attach_representations(f, q, a, 16).orderBy("part").collect()
    assert [(r["start_line"], r["end_line"], r["content"], len(r["assets"])) for r in got] == [(5, 7, "a\nb\nc", 15), (8, 8, "d", 5)]


def test_escaped_cells(spark):
    line = r"| a \| b | c\\ |  | d |"
    got = spark.createDataFrame([(line,)], "l string").select(E.cells(F.col("l")).alias("c")).first()["c"]
    assert got == ["a | b", "c\\", "", "d"]


def test_attempt_window_is_anchored(spark):
    m = 60_000_000
    a = spark.createDataFrame([("k", i, t * m) for i, t in enumerate([0, 14, 15, 16, 29, 30, 100])], "key string, attempt_id long, at long")
    assert [r["attempt"] for r in X.attempt_windows(a).orderBy("at").collect()] == [1, 2, 1, 2, 3, 1, 1]


def test_draft_state_clears_on_an_end(spark):
    ev = spark.createDataFrame([("r", 1, "draft_started", 1), ("r", 2, "answer", 0), ("s", 1, "draft_started", 1), ("s", 2, "draft_started", 2), ("s", 3, "draft_retracted", 1)],
                               "response_id string, seq long, type string, draft_version long")
    assert {r["response_id"]: r["active_version"] for r in C.draft_state(ev).collect()} == {"r": 0, "s": 2}


def test_files(spark, tmp_path):
    (tmp_path / "seeds.tsv").write_text("document\tkind\tquestion\trequired_facts\tanchors\nd1 + d2\tk\tq\ta || b\tx || d2::y\n")
    s = FI.read_seeds(spark, str(tmp_path / "seeds.tsv")).first()
    assert s["documents"] == ["d1", "d2"] and [(a["document"], a["anchor"]) for a in s["anchor_list"]] == [("d1", "x"), ("d2", "y")]
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "e.json").write_text(json.dumps({"name": "e", "status": "complete", "expected": 0, "config": {"split": "s"}, "rows": []}, indent=1))
    (folder / "x.json").write_text("{}")
    good, other = FI.read_experiments(spark, str(folder))
    assert [r["name"] for r in good.collect()] == ["e"] and other.count() == 1
    (tmp_path / "a.jsonl").write_text('{"case_id":"c","response":{"id":"r","usage":{"total_tokens":3}}}\nbroken\n')
    assert [r["case_id"] for r in FI.read_attempts(spark, str(tmp_path / "a.jsonl")).collect() if r["_corrupt_record"] is None] == ["c"]
    FI.write_report(good.select("name"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_a_generation_is_published_only_if_complete(spark, tmp_path):
    f = spark.createDataFrame([("d", "f1"), ("d", "f2")], "document_id string, fragment_id string")
    r = spark.createDataFrame([("f1", "QUESTION")], "fragment_id string, kind string")
    m = lambda n: spark.createDataFrame([("d", 2, n)], "document_id string, fragments long, representations long")
    assert not FI.publish_generation(f, r, m(2), str(tmp_path), "g1")
    assert FI.publish_generation(f, r, m(1), str(tmp_path), "g2")
    assert FI.read_current(spark, str(tmp_path), "fragments").count() == 2
    assert FI.publish_generation(f.limit(1), r, m(1).withColumn("fragments", F.lit(1).cast("long")), str(tmp_path), "g3")
    assert FI.read_current(spark, str(tmp_path), "fragments").count() == 1 and spark.read.parquet(f"{tmp_path}/current").count() == 2


def test_numbers_are_whole_decimals(spark):
    from passageworks.operators.observations import compare

    rows = [(v, v in ("81", "+81", "8.1e1", "81.")) for v in ("81", "+81", "8.1e1", "81.", " 81", "81 ", "81d", "81f", "NaN", "Infinity", "", None)]
    d = spark.createDataFrame(rows, "v string, want boolean")
    assert all(r.got == r.want for r in d.select("want", compare(F.col("v"), F.lit("GT"), F.lit("80")).alias("got")).collect())


def test_neighbours_start_from_positions(spark):
    from passageworks.operators.retrieval import expand_neighbours

    hits = spark.createDataFrame([(1, 10, 3), (1, 11, 12)], "query_id int, fragment_id int, rank int")
    links = spark.createDataFrame([(10, 0, 20), (11, 0, 21)], "fragment_id int, ordinal int, related int")
    assert [tuple(r) for r in expand_neighbours(hits, links, roots=2).orderBy("extra").collect()] == [(1, 20, 1, 3), (1, 21, 2, 12)]


def test_many_literals(spark):
    from passageworks.operators.enrichment import scan_literals

    d = spark.createDataFrame([("a", "x k1004 y"), ("b", "none")], "source string, text string")
    out = scan_literals(d, "text", "source", [f"k{n}" for n in range(1000, 2005)]).collect()
    assert [(r.source, r.texts) for r in out] == [("a", 1)]


def test_spans_fill_rows(spark):
    from passageworks.sources import pages as PG

    c = lambda t, r=1, k=1: (t, r, k)
    tables = [
        (1, [[c("h"), c("i"), c("j")], [c("a", 3), c("b", 1, 2)], [c("x"), c("y", 2)], [c("z")], [c("p"), c("q"), c("r")]]),
        (2, [[c("h"), c("h"), c("j")], [c("a"), c("b", 2), c("d")], [c("w", 1, 2)], [c("o", None, None), c("n", 1, 0), c("m", 1, 2)]]),
        (3, [[c("h")], None, [], [c(None)]]), (4, []), (5, None), (6, [None])]
    t = spark.createDataFrame(tables, "table_id long, rows array<array<struct<text string, rowspan int, colspan int>>>")
    good, ragged = PG.expand_spans(t)
    got = {(r["table_id"], r["row"]): (r["cells"], r["text"]) for r in good.collect()}
    assert got == {
        (1, 1): (["a", "b", "b"], "h：a\ni：b\nj：b"), (1, 2): (["a", "x", "y"], "h：a\ni：x\nj：y"), (1, 3): (["a", "z", "y"], "h：a\ni：z\nj：y"),
        (1, 4): (["p", "q", "r"], "h：p\ni：q\nj：r"), (2, 1): (["a", "b", "d"], "h：b\nj：d"),
        (2, 3): (["o", "m", "m"], "h：m\nj：m"), (3, 3): ([None], "")}
    assert sorted(map(tuple, ragged.collect())) == [(2, 2), (3, 1), (3, 2)]


def test_containment_has_no_limit_on_short_needles(spark):
    texts = [f"alpha w{i} beta 汉字{i} tail" for i in range(1300)] + ["", "x", "Äé\U0001D4B3 end", None]
    d = docs(spark, *texts)
    needles = [f"w{i} beta" for i in range(1200)] + [f"a w{i} b" for i in range(50)] + ["", None, "x", "\U0001D4B3", "é\U0001D4B3 e", "字7 t", "no such", "a", "w1 beta 汉字1 t"]
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id long, text string")
    want = sorted((i, j) for i, x in enumerate(needles) if x is not None for j, t in enumerate(texts) if t is not None and x in t)
    assert sorted(map(tuple, M.containment(n, d).collect())) == want
    assert sorted(r[0] for r in M.absent(n, d).collect()) == [i for i in range(len(needles)) if i not in {w[0] for w in want}]


def test_response_events_wait_for_the_missing(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from passageworks.streaming.run import drain

    at = lambda minutes: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minutes)
    ev = lambda seq, minutes, kind="answer_delta", r="r": (r, seq, kind, 1, "ab", at(minutes))
    batches = [
        [ev(1, 0, "draft_started"), ev(3, 2), ev(1, 0, "draft_started", "s"), ev(4, 3, "answer_delta", "s")],
        [ev(2, 1), ev(3, 2)],
        [ev(1, 60, "progress", "clock")], [ev(2, 61, "progress", "clock")],
        [ev(3, 58, "answer_delta", "s"), ev(5, 62, "answer", "s"), ev(4, 58, "answer_delta", "s")]]
    path = str(tmp_path / "events")
    for b in batches:
        spark.createDataFrame(b, "response_id string, seq long, type string, draft_version long, delta string, at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {}
    for x in drain(X.response_events_stream(stream, "5 minutes")).collect():
        got.setdefault(x["response_id"], set()).add((x["seq"], x["active_version"], x["bytes"], x["closed"], x["refused"]))
    assert got["r"] == {(1, 1, 0, False, False), (2, 1, 2, False, False), (3, 1, 4, False, False)}
    assert got["s"] == {(1, 1, 0, False, False), (4, 1, 2, False, False), (3, 1, 2, False, True), (5, 0, 0, True, False)}


def test_a_rule_lies_in_any_one_fragment_that_has_its_lines(spark):
    """Two parts of one long line share it; a rule over it lies in both, one over two fragments' lines in neither."""
    from passageworks.operators import observations as V

    frags = spark.createDataFrame([(1, "a", 1, 3), (1, "b", 3, 3), (1, "c", 3, 6), (1, "d", 8, 9)], "revision_id long, fragment_id string, start_line int, end_line int")
    spans = {"whole": (3, 3), "first": (2, 3), "last": (3, 5), "over": (2, 4), "out": (7, 7), "partly": (8, 10)}
    rules = spark.createDataFrame([(1, k, "RECOVERY", "E1", "c", *v) for k, v in spans.items()], "revision_id long, rule_id string, kind string, error_code string, conclusion string, start_line int, end_line int")
    cond = rules.selectExpr("revision_id", "rule_id", "'metrics' AS capability", "'EQ' AS operator", "'f' AS field", "'' AS component", "'abc' AS value", "'ms' AS unit", "60 AS max_age_seconds", "map('k', 'v') AS parameters")
    got = sorted((r["rule_id"], r["reason"]) for r in V.validate_rules(rules, cond, frags).collect())
    assert got == [("out", "FRAGMENT"), ("over", "FRAGMENT"), ("partly", "FRAGMENT")]
