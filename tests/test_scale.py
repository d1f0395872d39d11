"""Radix selection, neighbours in order, and strings found in the scan."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from passageworks.functions.matching import occurrences
from passageworks.functions.scale import exact_quantiles, neighbours
from passageworks.operators import evaluation as M
from passageworks.operators import knowledge as K

rng = random.Random(5)
RANKS = {"low": (0.0, lambda n: F.lit(1)), "mid": (0.5, lambda n: F.ceil(n / 2)), "p95": (0.95, lambda n: F.ceil(n * 0.95)), "high": (1.0, lambda n: n)}


def _want(v):
    v = sorted(v)
    n = len(v)
    return v[0], v[math.ceil(n / 2) - 1], v[math.ceil(n * 0.95) - 1], v[-1]


def test_order_statistics_of_any_values(spark):
    near = [struct.unpack("d", struct.pack("q", struct.unpack("q", struct.pack("d", 1.5))[0] + k))[0] for k in range(50)]
    groups = {"a": [rng.uniform(-1e9, 1e9) for _ in range(2000)], "b": [7.0] * 500, "c": near * 3, "d": [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf")], "e": [3.25],
              "f": [float(rng.randrange(10)) for _ in range(999)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("a", None), ("z", None)], "g string, v double").repartition(4)
    got = {r["g"]: (r["low"], r["mid"], r["p95"], r["high"]) for r in exact_quantiles(df, ["g"], "v", RANKS).collect()}
    assert got == {g: _want(v) for g, v in groups.items()}
    one = exact_quantiles(df.where("g = 'a'"), [], "v", RANKS).first()
    assert (one["low"], one["mid"], one["p95"], one["high"]) == _want(groups["a"])
    assert exact_quantiles(df.where("g = 'q'"), ["g"], "v", RANKS).collect() == []


def test_no_window_over_the_values(spark):
    """Windows stand on histograms only: below each there is an aggregation."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = exact_quantiles(df, ["g"], "v", RANKS)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if "Window [" in line]
    for i in at:
        below = [line for line in plan[i + 1:] if "Aggregate [" in line or "MapInArrow" in line]
        assert below and "Aggregate [" in below[0]


@pytest.mark.parametrize("keys", [["k"], ["k", "l"], []])
def test_neighbours(spark, keys):
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice(["x", None]), i) for i in rng.sample(range(100_000), 3000)]
    df = spark.createDataFrame(rows, "k string, l string, i long").repartition(6)
    got = {r["i"]: (r["p"], r["n"]) for r in neighbours(df, keys, "i", "p", "n").collect()}
    want, last = {}, {}
    key = lambda r: tuple(dict(zip("kli", r))[k] for k in keys)
    for r in sorted(rows, key=lambda r: r[2]):
        p = last.get(key(r))
        want[r[2]] = (p, None)
        if p is not None:
            want[p] = (want[p][0], r[2])
        last[key(r)] = r[2]
    assert got == want


def test_neighbours_have_no_window_on_the_key(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = neighbours(df, ["k"], "id", "p", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_part" in plan and "windowspecdefinition(k" not in plan


# strings in texts


def test_occurrences_against_brute_force(spark):
    letters = "ab é中\n."
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab" * 50_000)]
    strings = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(5)))) for i in range(150)] + [(500, None), (501, ""), (502, "ab"), (503, "ab"), (504, "ab" * 400)]
    t, s = spark.createDataFrame(texts, "t long, text string").repartition(3), spark.createDataFrame(strings, "s long, text string")
    want = {(i, k) for i, x in strings for k, y in texts if x is not None and y is not None and x in y}
    for size in (1 << 22, 300):
        assert {tuple(r) for r in occurrences(t, s, "t", "s", shard_bytes=size).collect()} == want
    assert {tuple(r) for r in M.containment(s.withColumnRenamed("s", "needle_id"), t.withColumnRenamed("t", "doc_id")).collect()} == want
    assert occurrences(t, s.where("s < 0"), "t", "s").collect() == []


def test_names_that_begin_alike_meet_only_their_texts(spark):
    reg = spark.range(10_000).select(F.col("id").alias("device_id"), F.concat(F.lit("Node "), F.col("id").cast("string")).alias("name"), F.array(F.lit(None).cast("string")).alias("aliases"))
    reg = reg.withColumn("device_id", F.col("device_id") + 1_000_000)
    texts = spark.range(2000).select(F.col("id").alias("text_id"), F.concat(F.lit("the node "), F.col("id").cast("string"), F.lit(", up")).alias("text"))
    got = K.find_mentions(texts, reg)
    assert {tuple(r) for r in got.collect()} == {(i, 1_000_000 + i) for i in range(2000)}


def test_no_text_is_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(1, "alpha beta")], "text_id long, text string")
        reg = spark.createDataFrame([(5, "beta", None)], "device_id long, name string, aliases array<string>")
        plan = K.find_mentions(texts, reg)._jdf.queryExecution().executedPlan().toString()
        above = plan.split("MapInArrow")[0]
        assert plan.count("MapInArrow") >= 1 and "Exchange" in above
        assert all("Exchange" not in part for part in plan.split("MapInArrow")[1].split("Scan")[:1])
        assert [tuple(r) for r in K.find_mentions(texts, reg).collect()] == [(1, 5)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recall_with_totals(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, id long, rank long")
    rel = spark.createDataFrame([(1, 11), (1, 50), (2, 60), (3, 1)], "query_id long, id long")
    full = sorted(map(tuple, M.retrieval_metrics(hits, rel).collect()))
    totals = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    assert full == sorted(map(tuple, M.retrieval_metrics(hits, rel.where("id = 11"), totals=totals).collect()))


def test_equal_profiles_are_assessed_once(spark):
    """Blocks of a few ids, columns without a value, two revisions for each device column; against every pair assessed by itself."""
    cols = "scope string, model string, firmware string, driver string, hardware_revision string, fw_min string, fw_max string, drv_min string, drv_max string, policy_id string"
    kinds = [("DEVICE", "m", None, None, None, None, None, None, None, None), ("DEVICE", "m", "v1", None, "", None, None, None, None, "p"), ("DEVICE", "m", None, "d2", None, "v0", "v2", None, None, "p"),
             ("DEVICE", "n", None, None, "h", None, None, "d1", "d2", "q"), ("DEVICE", "n", None, None, None, "v2", "v0", None, None, "q"), ("GENERAL", "m", None, None, None, None, None, None, None, None),
             ("DEVICE", None, None, None, None, None, None, None, None, None)]
    revs = spark.createDataFrame([(i, *kinds[i % len(kinds)]) for i in range(90)], "revision_id long, " + cols)
    devs = [("m", "v1", None, "h"), ("m", "v2", "d2", None), ("m", None, "d1", "h"), ("n", "v1", "d1", "h"), ("n", "v9", "d2", "g"), (None, "v1", None, None)]
    devices = spark.createDataFrame([(i, *devs[i % len(devs)]) for i in range(80)], "device_id long, model string, firmware string, driver string, hardware_revision string")
    policies = spark.createDataFrame([("p", "m", ["v0", "v1", "v2"], []), ("q", "n", ["v0", "v1"], ["d1", "d2"])], "policy_id string, model string, firmware_order array<string>, driver_order array<string>")
    every = K.assess(K.candidate_pairs(revs, devices), revs, devices, policies).where("status = 'MATCH'").select("revision_id", "device_id")
    got = K.matching_pairs(revs, devices, policies, ids=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) and got.count() > 500
    profiles, blocks = K._blocks(devices, "device_id", K.DEVICE_PROFILE, 4)
    assert profiles.count() == len(devs) and blocks.count() > 2 * len(devs) and blocks.agg(F.max(F.size("ids"))).first()[0] < 14


def test_a_frequent_name_is_joined_once_a_query(spark):
    """3,000 devices share an alias; no join makes a row per query and device of a name."""
    reg = spark.range(3000).selectExpr("id AS device_id", "'n' || id AS name", "array('same', 'SAME', '7') AS aliases")
    q = spark.createDataFrame([(i, " Same ") for i in range(50)] + [(100, "N5"), (101, "nobody"), (102, None), (103, "n1"), (103, "1"), (104, "n1"), (104, "n2"), (105, "7")], "query_id long, text string")
    out = K.resolve_names(q, reg)
    got = {r["query_id"]: (r["candidates"], r["status"], r["device_id"]) for r in out.collect()}
    assert all(got[i] == (3000, "AMBIGUOUS", None) for i in range(50))
    assert got[100] == (1, "RESOLVED", 5) and got[101] == got[102] == (0, "NO_RECORD", None) and got[103] == (1, "RESOLVED", 1) and got[104] == (2, "AMBIGUOUS", None) and got[105][0] == 3000
    single = K.resolve_names(spark.range(50).selectExpr("id AS query_id", "'same' AS text"), reg)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "candidates" in plan[plan.index("LeftOuter"):]  # names are counted below the join


def test_kept_citations_and_metrics_meet_in_one_shuffle(spark):
    from passageworks.operators import answers as A
    from passageworks.operators import evaluation as M

    claims = spark.createDataFrame([(1, 1, [10, 11]), (1, 2, [12]), (2, 1, [10]), (3, 1, [13]), (None, 1, [10])], "answer_id long, claim_index long, ids array<long>")
    verdicts = spark.createDataFrame([(1, 1, "SUPPORTED"), (1, 2, "UNSUPPORTED"), (2, 1, None), (3, 1, "CONTRADICTED"), (None, 1, "CONTRADICTED")], "answer_id long, claim_index long, verdict string")
    cites = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 12, "c"), (1, 14, "d"), (1, None, "e"), (2, 10, "f"), (2, None, "g"), (3, 13, "h"), (None, 10, "i"), (4, 9, "j")], "answer_id long, fragment_id long, note string")
    conflicts = spark.createDataFrame([(1, 14), (3, 99), (1, None)], "answer_id long, id long")
    for given in (cites, cites.drop("note")):
        kept = A.keep_supported(claims, verdicts, given, conflicts, 3)[1]
        assert kept.columns == given.columns and kept.select("answer_id", "fragment_id").count() == 7
    assert {r["note"] for r in A.keep_supported(claims, verdicts, cites, conflicts)[1].collect()} == set("abdfgij")
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

    responses = spark.createDataFrame([(1, True, "ANSWERED"), (2, True, "PARTIAL"), (3, False, "UNRESOLVED")], "case_id long, answerable boolean, status string")
    cited = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, None)], "case_id long, id long")
    relevant = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "case_id long, id long")
    m = M.answer_metrics(responses, cited, relevant, 3)
    got = {r["case_id"]: (r["citation_recall"], r["citation_precision"], r["citation_hit"]) for r in m.collect()}
    assert got == {1: (1 / 2, 1 / 3, 1.0), 2: (0.0, 0.0, 0.0), 3: (None, None, None)}
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan
