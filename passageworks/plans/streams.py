"""Registered queries that replay the events table as a stream and must equal their batch twins."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passageworks.functions.scale import shared_folder
from passageworks.plans import conversations as PC
from passageworks.plans import knowledge as PK
from passageworks.plans.registry import query
from passageworks.sources.tables import table
from passageworks.streaming import state as X
from passageworks.streaming.run import drain, event_stream

DRAFT = [
    "user_id || '-' || day(ts) div 6 AS response_id",
    "CASE event_type WHEN 'click' THEN 'draft_started' WHEN 'view' THEN 'answer_delta' WHEN 'purchase' THEN 'answer_delta' WHEN 'error' THEN 'draft_retracted' ELSE CASE WHEN event_id % 4 = 0 THEN 'answer' ELSE 'progress' END END AS type",
    "CASE WHEN event_type = 'signup' THEN 0 ELSE 1 + event_id % 3 END AS draft_version", "'d' || event_id || ';' AS delta", "CAST(ts AS TIMESTAMP) AS at"]


@query("x01_response_events", f"""WITH {PC.DE}, o AS (SELECT r, seq, row_number() OVER (PARTITION BY r ORDER BY seq) AS n FROM ev),
fs AS (SELECT o.r, o.seq, list_reduce(list({{'t': e.type, 'v': e.v}} ORDER BY e.seq), lambda a, x: CASE WHEN x.t = 'draft_started' THEN x.v WHEN x.t = 'draft_retracted' THEN CASE WHEN x.v = a THEN 0 ELSE a END WHEN x.t = 'answer' THEN 0 ELSE a END, 0::BIGINT) AS active,
  coalesce(bool_or(e.type = 'answer') FILTER (e.seq < o.seq), false) AS over FROM o JOIN ev e ON e.r = o.r AND e.seq <= o.seq GROUP BY ALL)
SELECT fs.r AS response_id, o.n AS seq, ev.type, CASE WHEN over THEN 0 ELSE active END AS active_version, over OR ev.type = 'answer' AS closed, over AS refused
FROM fs JOIN ev ON ev.r = fs.r AND ev.seq = fs.seq JOIN o ON o.r = fs.r AND o.seq = fs.seq""")
def x01(spark, sf):
    """Sequences of each response from 1, dealt over three micro-batches so that most come out of order; an answer ends its response."""
    seq = F.row_number().over(W.partitionBy(F.expr("user_id || '-' || day(ts) div 6")).orderBy("event_id")).cast("bigint")
    ev = table(spark, sf, "events").withColumn("seq", seq).selectExpr(*DRAFT, "seq", "event_id")
    path = f"{shared_folder(spark)}/responses-{uuid4().hex}"
    ev.repartition(3, "event_id").drop("event_id").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return drain(X.response_events_stream(stream, late="60 days", buckets=X.buckets_for(table(spark, sf, "events").count()))).select("response_id", "seq", "type", "active_version", "closed", "refused")


@query("x02_newest_snapshots", f"WITH {PK._ARR} SELECT device_id, arrival, observed_at, seen IS NULL OR observed_at > seen AS accepted FROM s")
def x02(spark, sf):
    a = event_stream(spark, sf, "events").selectExpr("user_id AS device_id", "event_id AS arrival", "unix_micros(CAST(ts AS TIMESTAMP)) - (event_id % 5) * 21600000000 AS observed_at")
    return drain(X.newest_snapshots_stream(a))


ATT = "'u' || user_id % 10 AS key", "event_id AS attempt_id", "unix_micros(CAST(ts AS TIMESTAMP)) AS at"
ATT_SQL = """WITH a AS (SELECT 'u' || user_id % 10 AS k, event_id, epoch_us(ts) AS t FROM events),
f AS (SELECT k, list(event_id ORDER BY t, event_id) AS ids, list_reduce(list(t ORDER BY t, event_id), lambda s, x: CASE WHEN s.c = 0 OR s.u <= x THEN {'c': 1::BIGINT, 'u': x + 3600000000, 'o': list_append(s.o, 1)} ELSE {'c': s.c + 1, 'u': s.u, 'o': list_append(s.o, s.c + 1)} END,
  {'c': 0::BIGINT, 'u': 0::BIGINT, 'o': []::BIGINT[]}).o AS o FROM a GROUP BY 1)
SELECT k AS key, unnest(ids) AS attempt_id, unnest(o) AS attempt FROM f"""


@query("x03_attempt_windows", ATT_SQL)
def x03(spark, sf):
    return X.attempt_windows(table(spark, sf, "events").selectExpr(*ATT), 3600_000_000).drop("at")


@query("x03_attempt_windows_stream", ATT_SQL)
def x03b(spark, sf):
    return drain(X.attempt_windows_stream(event_stream(spark, sf, "events").selectExpr(*ATT), 3600_000_000, "60 days")).drop("at")


OBS = "user_id AS device_id", "event_type AS field", "value", "CAST(ts AS TIMESTAMP) AS observed_at"
X4_SQL = """SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, user_id AS device_id, event_type AS field, count(*) AS n, min(value) AS low, max(value) AS high, arg_max(value, {'t': ts, 'v': value}) AS last FROM events GROUP BY ALL"""


@query("x04_observation_windows", X4_SQL)
def x04(spark, sf):
    w = X.observation_windows(table(spark, sf, "events").selectExpr(*OBS), "1 day")
    return w.withColumn("start_us", F.unix_micros("start")).drop("start")


@query("x04_observation_windows_stream", X4_SQL)
def x04b(spark, sf):
    w = drain(X.observation_windows(event_stream(spark, sf, "events").selectExpr(*OBS), "1 day"), latest_by=["start", "device_id", "field"])
    return w.withColumn("start_us", F.unix_micros("start")).drop("start")


@query("x05_rule_alerts", """WITH c AS (SELECT t AS rule_id, unnest([{'n': 1, 'f': t, 'o': 10}, {'n': 2, 'f': 'click', 'o': 80}]) AS c FROM (SELECT DISTINCT 'r-' || event_type AS t0, event_type AS t FROM events)),
p AS (SELECT user_id, rule_id, c.n AS n, ts, bool_and(CASE c.n WHEN 1 THEN value > 10 ELSE value < 80 END) AS ok FROM c JOIN events ON event_type = c.f GROUP BY ALL),
l AS (SELECT user_id, rule_id, n, arg_max(ok, ts) AS ok FROM p GROUP BY ALL)
SELECT user_id AS device_id, 'r-' || rule_id AS rule_id, bool_and(ok) AND count(*) = 2 AS holds FROM l GROUP BY ALL""")
def x05(spark, sf):
    rules = table(spark, sf, "events").select("event_type").distinct().selectExpr(
        "'r-' || event_type AS rule_id", "inline(array(named_struct('cond_no', 1, 'field', event_type, 'operator', 'GT', 'value', '10'), named_struct('cond_no', 2, 'field', 'click', 'operator', 'LT', 'value', '80')))").withColumn("unit", F.lit("ms"))
    v = event_stream(spark, sf, "events").selectExpr("user_id AS device_id", "event_type AS field", "CAST(value AS STRING) AS value", "'ms' AS unit", "ts AS observed_at")
    return drain(X.rule_alerts_stream(v, rules, buckets=X.buckets_for(table(spark, sf, "events").count())), latest_by=["device_id", "rule_id"]).drop("at")


@query("x06_first_latency", """WITH a AS (SELECT user_id AS r, ts FROM events WHERE event_type = 'signup'), d AS (SELECT user_id AS r, ts FROM events WHERE event_type IN ('view', 'purchase'))
SELECT a.r AS response_id, epoch_us(a.ts) AS accepted_us, min(epoch_us(d.ts)) - epoch_us(a.ts) AS first_delta_us FROM a JOIN d ON d.r = a.r AND d.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR GROUP BY a.r, a.ts""")
def x06(spark, sf):
    e = event_stream(spark, sf, "events").selectExpr("user_id AS response_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts")
    return X.first_latency(drain(X.latency_pairs_stream(e.where("event_type = 'signup'"), e.where("event_type IN ('view', 'purchase')"), "6 hours"), "append"))


@query("x07_without_replays", """WITH r AS (SELECT event_id, user_id, event_type, event_id % 7 AS k, row_number() OVER (PARTITION BY user_id, event_id % 7, event_type ORDER BY event_id) AS n FROM events)
SELECT user_id AS conversation_id, k::VARCHAR AS key, event_type AS hash FROM r WHERE n = 1""")
def x07b(spark, sf):
    r = event_stream(spark, sf, "events").selectExpr("user_id AS conversation_id", "CAST(event_id % 7 AS STRING) AS key", "event_type AS hash", "CAST(ts AS TIMESTAMP) AS ts")
    return drain(X.without_replays_stream(r, "90 days"), "append").drop("ts")


@query("x07_idempotent_intake", f"""WITH {PC.RQ} SELECT request_id, CASE WHEN rq.k = '' OR fid = request_id THEN 'accepted' WHEN fh = h THEN 'replayed' ELSE 'conflict' END AS outcome,
 CASE WHEN rq.k = '' THEN request_id ELSE fid END AS first_id FROM rq LEFT JOIN f USING (conversation_id, k)""")
def x07(spark, sf):
    r = event_stream(spark, sf, "events").selectExpr(
        "event_id AS request_id", "user_id AS conversation_id", "CASE WHEN event_type = 'view' THEN '' ELSE get_json_object(props, '$.k') END AS key", "event_type AS hash", "event_id AS ordinal")
    return drain(X.idempotent_stream(r, buckets=X.buckets_for(table(spark, sf, "events").count())))
