"""State of streams that end, one newest sample a field, and windows of a key that never pauses."""

import datetime as dt
import random
from uuid import uuid4

import pandas as pd
import pytest
from pyspark.sql import functions as F

from passageworks.functions.scale import shared_folder
from passageworks.operators.observations import compare, number
from passageworks.streaming import state as X
from passageworks.streaming.run import ROCKSDB

T0 = dt.datetime(2024, 1, 1)
rng = random.Random(9)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def replay(spark, tmp_path, batches, schema, build):
    """Each list of rows as one micro-batch; what was emitted, and the state operator's progress of each batch."""
    path, out = str(tmp_path / "in"), f"{shared_folder(spark)}/replay-{uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        q = build(stream).writeStream.outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).foreachBatch(lambda d, n: got.extend(d.collect())).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return got, [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]


EVENTS = "response_id string, seq long, type string, draft_version long, delta string, at timestamp"


def test_the_state_of_ended_responses_leaves_the_store(spark, tmp_path):
    """Responses with gaps, a repeat, events behind the end; at last no row of state is left."""
    e = lambda r, n, kind, m, v=1: (r, n, kind, v, "ab", at(m))
    batches = [
        [e("r", 1, "draft_started", 0), e("r", 2, "answer_delta", 1), e("s", 1, "draft_started", 0), e("s", 4, "answer", 3), e("s", 5, "progress", 3)],
        [e("r", 3, "answer", 2), e("r", 2, "answer_delta", 2), e("s", 3, "answer_delta", 3), e("s", 2, "answer_delta", 3)],
        [e("r", 4, "progress", 4), e("s", 6, "progress", 4), e("s", 3, "answer_delta", 4)],
        [e("u", 1, "answer", 600)],
        [e("v", 1, "answer", 1200)],
        [e("w", 1, "answer", 1800)],
    ]
    got, seen = replay(spark, tmp_path, batches, EVENTS, lambda s: X.response_events_stream(s, "1 minute", keep_ms=120_000))
    rows = {(x["response_id"], x["seq"], x["closed"], x["refused"]) for x in got}
    assert rows == {("r", 1, False, False), ("r", 2, False, False), ("r", 3, True, False), ("r", 4, True, True),
                    ("s", 1, False, False), ("s", 2, False, False), ("s", 3, False, False), ("s", 4, True, False), ("s", 5, True, True), ("s", 6, True, True),
                    ("u", 1, True, False), ("v", 1, True, False), ("w", 1, True, False)}
    assert max(p["numRowsTotal"] for p in seen) >= 4
    # the last response alone, whose end the watermark has not passed: its value and its timer in both indexes
    assert seen[-1]["numRowsTotal"] <= 3


def test_responses_share_the_state_of_a_bucket(spark, tmp_path):
    """All in one bucket as each by itself, gaps given up by the timer that is first among them; the bucket is a row, and leaves the store."""
    e = lambda r, n, kind, m, v=1: (r, n, kind, v, "ab", at(m))
    batches = [
        [x for i in range(200) for x in (e(f"r{i}", 1, "draft_started", 0), e(f"r{i}", 3, "answer_delta", 1 + i % 3), e(f"r{i}", 4, "answer" if i % 2 else "progress", 4))] + [e(None, 1, "progress", 0, None)],
        [e(f"r{i}", 2, "answer_delta", 3) for i in range(0, 200, 4)] + [e(None, 2, "answer", 4)],
        [e("late", 1, "answer", 60)], [e("late", 1, "progress", 61)], [e(f"r{i}", 2, "answer_delta", 62) for i in range(200)], [e("end", 1, "answer", 600)], [e("end2", 1, "answer", 1200)]]
    got = {}
    for buckets in (1, 4096):
        rows, seen = replay(spark, tmp_path / str(buckets), batches, EVENTS, lambda s, n=buckets: X.response_events_stream(s, "1 minute", keep_ms=120_000, buckets=n))
        got[buckets] = sorted(map(str, rows))
        if buckets == 1:
            assert max(p["numRowsTotal"] for p in seen) < 210  # a row for each response, none for each event
    assert got[1] == got[4096] and len([x for x in got[1] if "seq=2" in x and "refused=True" in x]) == 50


def test_keys_share_the_state_of_a_bucket(spark, tmp_path):
    """A thousand keys have one row of state, and a null conversation or hash is one like any other."""
    batches = [[(n, n % 500 if n % 500 else None, str(n % 2), "h" if n % 3 else None, n) for n in range(b, 6000, 3)] for b in (2, 0, 1)]
    rows, seen = replay(spark, tmp_path, batches, "request_id long, conversation_id long, key string, hash string, ordinal long", lambda s: X.idempotent_stream(s, buckets=1))
    first, want = {}, {}
    for b in batches:
        for n, c, k, h, _ in b:
            i, h0 = first.setdefault((c, k), (n, h))
            want[n] = ("accepted" if i == n else "replayed" if h == h0 else "conflict", i)
    assert {x["request_id"]: (x["outcome"], x["first_id"]) for x in rows} == want and len(rows) == 6000
    assert seen[-1]["numRowsTotal"] == 1


def test_windows_leave_the_store_when_they_end(spark, tmp_path):
    us = lambda m: 1_700_000_000_000_000 + int(m * 60_000_000)
    batches = [[("k", 1, us(0)), ("k", 2, us(5)), ("l", 3, us(1))], [("k", 4, us(14)), ("k", 5, us(16))], [("l", 6, us(100))], [("m", 7, us(300))], [("m", 8, us(600))]]
    got, seen = replay(spark, tmp_path, batches, "key string, attempt_id long, at long", lambda s: X.attempt_windows_stream(s, late="1 minute"))
    assert {(x["attempt_id"], x["attempt"]) for x in got} == {(1, 1), (2, 2), (3, 1), (4, 3), (5, 1), (6, 1), (7, 1), (8, 1)}
    assert seen[-1]["numRowsTotal"] <= 3  # one open window: its value and its timer


def _numbers(times, span):
    out, until, n = [], None, 0
    for t in times:
        n, until = (1, t + span) if until is None or t >= until else (n + 1, until)
        out.append(n)
    return out


@pytest.mark.parametrize("chunk", [None, 1000, 3000])
def test_windows_of_chunks_join_up(spark, chunk):
    rows, n = [], 0
    for key in ("hot", "b", "c", None):
        t = rng.randrange(5000)
        for _ in range(3000 if key == "hot" else 200):
            n += 1
            rows.append((key, n, t))
            t += rng.choice([0, 1, 2, 7, 7, 400, 999, 1000, 1001] if key == "hot" else [0, 3, 900, 20_000])
    df = spark.createDataFrame(rows, "key string, attempt_id long, at long").repartition(5)
    got = {r["attempt_id"]: r["attempt"] for r in X.attempt_windows(df, 1000, chunk).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((t, i) for k, i, t in rows if k == key)
        want |= {i: x for (_, i), x in zip(own, _numbers([t for t, _ in own], 1000))}
    assert got == want


def test_a_key_without_pause_runs_in_many_tasks(spark):
    span = 900_000_000
    df = spark.range(100_000).select(F.lit("hot").alias("key"), F.col("id").alias("attempt_id"), (F.col("id") * 30_000_000).alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = X.attempt_windows(df, span).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["task"] for r in got}) > 1
    per = span // 30_000_000
    assert all(r["attempt"] == r["attempt_id"] % per + 1 for r in got) and len(got) == 100_000


READINGS = "device_id long, field string, value string, unit string, observed_at timestamp"


def test_each_reading_meets_the_state_once(spark, tmp_path):
    conditions = spark.createDataFrame(
        [(f"r{n}", c, f, "GT", str(n), "ms") for n in range(20) for c, f in ((1, "a"), (2, "b"))] + [("same", 1, "a", "EQ", "x", "ms"), ("never", 1, "z", "GT", "1", "ms")],
        "rule_id string, cond_no int, field string, operator string, value string, unit string")
    batches = [
        [(1, "a", "5", "ms", at(0)), (1, "b", "50", "ms", at(0)), (1, "other", "1", "ms", at(0)), (2, "a", "99", "ms", at(0))],
        [(1, "a", "50", "ms", at(2)), (1, "a", "1", "ms", at(1)), (2, "b", "99", "s", at(1))],
        [(1, "a", "3", "ms", at(2)), (2, "a", "x", "ms", at(3)), (2, "a", None, "ms", at(2))],
    ]
    got, seen = replay(spark, tmp_path, batches, READINGS, lambda s: X.rule_alerts_stream(s, conditions))
    said = {}
    for x in got:
        said.setdefault((x["device_id"], x["rule_id"]), []).append(x["holds"])
    assert said[1, "r4"] == [True, False] and said[1, "r10"] == [False, True, False] and said[1, "r2"] == [True] and said[2, "r1"] == [False]
    assert said[2, "same"] == [False, True] and ("never" not in {r for _, r in said})
    assert [p["numRowsUpdated"] for p in seen] and len(said) == 42
    plan = X.rule_alerts_stream(spark.readStream.schema(READINGS).parquet(str(tmp_path / "in")), conditions)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan  # the operator's input rows are the readings


def test_devices_of_a_bucket_keep_their_own_samples():
    from unittest.mock import MagicMock

    rules = {"r": [("a", "GT", "1", 1.0, "u"), ("b", "LT", "9", 9.0, "u")]}
    p = X._Alerts(rules, {"a": {"r"}, "b": {"r"}})
    held, state = {}, MagicMock()
    state.containsKey = lambda k: k in held
    state.getValue = lambda k: held[k]
    state.updateValue = lambda k, v: held.__setitem__(k, v)
    p.init(MagicMock(getMapState=lambda *_: state))
    cols = ["device_id", "field", "at", "value", "number", "unit"]
    say = lambda *rows: [tuple(r) for d in p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=cols)]), None) for r in d.to_numpy().tolist()]
    assert say((1, "a", 5, "2", 2.0, "u"), (2, "a", 5, "0", 0.0, "u"), (3, "c", 5, "0", 0.0, "u")) == [(1, "r", False, 5), (2, "r", False, 5)]
    assert say((1, "b", 6, "3", 3.0, "u"), (2, "b", 6, "3", 3.0, "u")) == [(1, "r", True, 6)]
    assert say((1, "a", 5, "1", 1.0, "u"), (2, "a", 4, "7", 7.0, "u")) == [(1, "r", False, 6)]  # two samples of one time; an older one
    assert len(held) == 2


NUMBERS = ["5", "+7.", ".5", "5.e3", "1_000", "1_2.3_4e1_0", "0x1p7", "-0X1.8p+1", "0x_1Fp0", "0x.8p1", "1e-400"]
NOT = ["", " 81", "81 ", "81\n", "\n81", "81d", "81f", "0x1", "0x1p", "0x1p7d", "1__0", "_1", "1_", "1_.5", "1._5", "1e_5", "1e400", "NaN", "Infinity", "inf", "٣", "1,0", ".", "e5", "0xp1", None]


def test_texts_that_are_numbers(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS + NOT], "x string").select("x", number(F.col("x")).alias("n"), compare(F.col("x"), F.lit("GE"), F.lit("-1e9")).alias("c"))
    got = {r["x"]: (r["n"], r["c"]) for r in df.collect()}
    assert [got[x][0] for x in NUMBERS] == [5, 7, 0.5, 5000, 1000, 12.34e10, 128, -3, 31, 1, 0]
    assert all(got[x] == (None, False) for x in NOT) and all(got[x][1] for x in NUMBERS)
