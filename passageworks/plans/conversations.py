"""Registered queries of conversation and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions.text import sha
from passageworks.operators import conversations as C
from passageworks.plans.registry import query
from passageworks.sources.tables import table


@query("c01_sequence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders")
def c01(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return C.sequence(o, "o_custkey", ["o_orderdate", "o_orderkey"], "year").select("o_orderkey", "sequence")


@query("c01_last_sequence", "SELECT c_custkey AS o_custkey, count(o_orderkey) AS last_sequence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def c01b(spark, sf):
    return C.last_sequence(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), table(spark, sf, "orders"), "o_custkey")


RQ = """rq AS (SELECT event_id AS request_id, user_id AS conversation_id, CASE WHEN event_type = 'view' THEN '' ELSE json_extract_string(props, '$.k') END AS k, event_type AS h, event_id AS o FROM events),
f AS (SELECT conversation_id, k, arg_min(request_id, o) AS fid, arg_min(h, o) AS fh FROM rq WHERE k <> '' GROUP BY ALL)"""


def requests(spark, sf):
    return C.idempotent(table(spark, sf, "events").selectExpr(
        "event_id AS request_id", "user_id AS conversation_id", "CASE WHEN event_type = 'view' THEN '' ELSE get_json_object(props, '$.k') END AS key", "event_type AS hash", "event_id AS ordinal"))


@query("c02_accepted", f"WITH {RQ} SELECT request_id FROM rq LEFT JOIN f USING (conversation_id, k) WHERE rq.k = '' OR fid = request_id")
def c02(spark, sf):
    return requests(spark, sf)[0]


@query("c02_replayed", f"WITH {RQ} SELECT request_id, fid AS replay_of FROM rq JOIN f USING (conversation_id, k) WHERE fid <> request_id AND fh = h")
def c02b(spark, sf):
    return requests(spark, sf)[1]


@query("c02_conflicts", f"WITH {RQ} SELECT request_id, fid AS conflicts_with FROM rq JOIN f USING (conversation_id, k) WHERE fid <> request_id AND fh <> h")
def c02c(spark, sf):
    return requests(spark, sf)[2]


@query("c03_response_rules", """WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, CASE o_orderstatus WHEN 'P' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'ANSWERED' END AS st, o_custkey || '-' || o_orderkey % 2 AS q, CASE WHEN o_orderkey % 4 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) WHEN o_orderkey % 41 = 1 THEN o_orderkey - 1 END AS ro FROM orders),
e AS (SELECT r.id, CASE WHEN o.id IS NULL OR o.c <> r.c THEN 'RETRY_NOT_FOUND' WHEN o.st <> 'FAILED' THEN 'RETRY_NOT_FAILED' WHEN o.q <> r.q THEN 'RETRY_CHANGED' END AS reason FROM r LEFT JOIN r o ON o.id = r.ro WHERE r.ro IS NOT NULL)
SELECT c::VARCHAR AS id, 'TWO_ACTIVE' AS reason FROM r WHERE st = 'RUNNING' GROUP BY c HAVING count(*) > 1 UNION ALL SELECT id::VARCHAR, reason FROM e WHERE reason IS NOT NULL""")
def c03(spark, sf):
    r = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS response_id", "o_custkey AS conversation_id", "CASE o_orderstatus WHEN 'P' THEN 'RUNNING' WHEN 'F' THEN 'FAILED' ELSE 'ANSWERED' END AS status", "o_custkey || '-' || o_orderkey % 2 AS question",
        "CASE WHEN o_orderkey % 4 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) WHEN o_orderkey % 41 = 1 THEN o_orderkey - 1 END AS retry_of", "CAST(NULL AS ARRAY<STRING>) AS attachments")
    return C.response_rules(r)


@query("c04_search_history", """WITH c AS (SELECT c_custkey AS conversation_id, c_name AS title, TIMESTAMP '2024-01-01' + to_hours((c_custkey % 700)::INT) AS created_at FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 > 0)
SELECT conversation_id, title FROM c WHERE (created_at < TIMESTAMP '2024-01-25' OR (created_at = TIMESTAMP '2024-01-25' AND conversation_id < 700)) AND (contains(lower(title), '77')
  OR conversation_id IN (SELECT o_custkey FROM orders WHERE contains(lower(o_orderpriority), 'high') OR (o_orderstatus <> 'P' AND contains(o_orderkey::VARCHAR, 'high')) ))
ORDER BY created_at DESC, conversation_id DESC LIMIT 50""")
def c04(spark, sf):
    # The first text only hits questions (order priorities) or titles that hold it.
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey AS conversation_id", "c_mktsegment AS owner", "CASE WHEN contains(c_name, '77') THEN c_name || ' HIGH' ELSE c_name END AS title",
        "CAST(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, CAST(c_custkey % 700 AS INT)) AS TIMESTAMP) AS created_at", "CASE WHEN c_custkey % 10 = 0 THEN 1 END AS deleted_at")
    r = table(spark, sf, "orders").selectExpr("o_custkey AS conversation_id", "o_orderpriority AS question", "CAST(o_orderkey AS STRING) AS answer", "CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'ANSWERED' END AS status")
    return C.search_history(c, r, "BUILDING", "High", ("2024-01-25 00:00:00", "700"), 50).select("conversation_id", F.regexp_replace("title", " HIGH$", "").alias("title"))


@query("c05_message_page", "SELECT turn + 1 AS sequence, role FROM conversations WHERE conv_id = 3 AND turn + 1 > 1 AND turn + 1 < 7 ORDER BY turn LIMIT 4")
def c05(spark, sf):
    r = table(spark, sf, "conversations").selectExpr("conv_id AS conversation_id", "turn + 1 AS sequence", "role")
    return C.message_page(r, 3, 1, 7, 4).select("sequence", "role")


def window_parts(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    r = C.sequence(o, "o_custkey", ["o_orderdate", "o_orderkey"], "year").selectExpr(
        "o_custkey AS conversation_id", "sequence", "o_orderpriority AS question", "CASE o_orderkey % 5 WHEN 0 THEN 'ANSWERED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'UNRESOLVED' WHEN 3 THEN 'NEEDS_CLARIFICATION' ELSE 'FAILED' END AS status",
        "'ans' || o_orderkey AS answer", "'gap' || o_custkey AS gaps", "CASE WHEN o_orderkey % 15 = 0 OR o_orderkey % 15 = 3 THEN 'reply' || o_orderkey END AS reply")
    return C.context_window(r, 6, 4, 150)


CW = """r AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS q,
  CASE WHEN o_orderkey % 15 IN (0, 3) THEN 'reply' || o_orderkey WHEN o_orderkey % 5 IN (0, 1) THEN 'ans' || o_orderkey ELSE '' END AS shown, CASE WHEN o_orderkey % 5 < 4 THEN 'gap' || o_custkey ELSE '' END AS g FROM orders)"""


@query("c06_recent_turns", f"WITH {CW} SELECT c AS conversation_id, s AS sequence, q AS question, shown, g AS shown_gaps FROM r WHERE s > n - 6")
def c06(spark, sf):
    return window_parts(spark, sf)[0]


@query("c06_compaction", f"WITH {CW} SELECT c AS conversation_id, (s - 1) // 4 + 1 AS batch, min(s) AS from_sequence, max(s) AS through_sequence FROM r WHERE s <= n - 6 GROUP BY ALL")
def c06b(spark, sf):
    return window_parts(spark, sf)[1]


@query("c06_sizes", f"WITH {CW} SELECT c AS conversation_id, sum(strlen(q) + strlen(shown) + strlen(g))::BIGINT AS bytes, sum(strlen(q) + strlen(shown) + strlen(g)) > 150 AS over_limit FROM r WHERE s > n - 6 GROUP BY 1")
def c06c(spark, sf):
    return window_parts(spark, sf)[2]


@query("c07_source_ids", """WITH f AS (SELECT l_orderkey AS conversation_id, l_partkey % 30 AS source_id, min(CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END * 1000000000000 + l_linenumber * 10000000000::BIGINT + l_partkey * 1000 + l_suppkey) AS o FROM lineitem GROUP BY ALL)
SELECT conversation_id, source_id, row_number() OVER (PARTITION BY conversation_id ORDER BY o) AS ordinal FROM f""")
def c07(spark, sf):
    return C.source_ids(table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS conversation_id", "CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS part", "l_linenumber AS turn", "l_partkey * 1000 + l_suppkey AS pos", "l_partkey % 30 AS source_id"))


@query("c08_latest_summary", "SELECT conv_id AS conversation_id, max(turn) AS version, sha256(arg_max(text, turn)) AS text_sha FROM conversations GROUP BY 1")
def c08(spark, sf):
    s = table(spark, sf, "conversations").selectExpr("conv_id AS conversation_id", "turn AS version", "text")
    return C.latest_summary(s, ["text"]).select("conversation_id", "version", sha(F.col("text")).alias("text_sha"))


@query("c09_cascade_delete", """WITH d AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey % 9 = 0)
SELECT 'responses' AS "table", o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey IN (FROM d) UNION ALL
SELECT 'executions', l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IN (FROM d)""")
def c09(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "conversation_id")
    li = table(spark, sf, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("conversation_id", "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id")
    gone = table(spark, sf, "customer").where("c_acctbal < 0 OR c_custkey % 9 = 0").select(F.col("c_custkey").alias("conversation_id"))
    return C.cascade_delete(gone, {"responses": (o, "o_orderkey"), "executions": (li, "id")})


def draft_events(spark, sf):
    """One response per user and day; the version grows with every start."""
    e = table(spark, sf, "events").selectExpr(
        "user_id || '-' || day(ts) div 6 AS response_id", "event_id AS seq",
        "CASE event_type WHEN 'click' THEN 'draft_started' WHEN 'view' THEN 'answer_delta' WHEN 'purchase' THEN 'answer_delta' WHEN 'error' THEN 'draft_retracted' ELSE CASE WHEN event_id % 4 = 0 THEN 'answer' ELSE 'progress' END END AS type",
        "CASE WHEN event_type = 'signup' THEN 0 ELSE 1 + event_id % 3 END AS draft_version", "'d' || event_id || ';' AS delta")
    return e


DE = """ev AS (SELECT user_id || '-' || date_part('day', ts)::BIGINT // 6 AS r, event_id AS seq, CASE event_type WHEN 'click' THEN 'draft_started' WHEN 'view' THEN 'answer_delta' WHEN 'purchase' THEN 'answer_delta' WHEN 'error' THEN 'draft_retracted'
   ELSE CASE WHEN event_id % 4 = 0 THEN 'answer' ELSE 'progress' END END AS type, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 + event_id % 3 END AS v, 'd' || event_id || ';' AS delta FROM events),
fo AS (SELECT r, max(seq) AS last_sequence, max(v) AS max_version, list_reduce(list({'t': type, 'v': v} ORDER BY seq), lambda a, x: CASE WHEN x.t = 'draft_started' THEN x.v WHEN x.t = 'draft_retracted' THEN CASE WHEN x.v = a THEN 0 ELSE a END
   WHEN x.t = 'answer' THEN 0 ELSE a END, 0::BIGINT) AS active FROM ev GROUP BY 1)"""


@query("c10_draft_state", f"WITH {DE} SELECT r AS response_id, last_sequence, max_version, active AS active_version FROM fo")
def c10(spark, sf):
    return C.draft_state(draft_events(spark, sf))


@query("c11_transition_events", """WITH s AS (SELECT l_orderkey AS r, l_linenumber AS n, ['QUEUED', 'RUNNING', 'RUNNING', 'ANSWERED', 'FAILED', 'NEEDS_CLARIFICATION', 'CANCELING', 'PARTIAL'][(min(l_partkey) % 8)::INT + 1] AS st FROM lineitem GROUP BY ALL),
p AS (SELECT *, lag(st) OVER w AS pv, row_number() OVER w = 1 AS f FROM s WINDOW w AS (PARTITION BY r ORDER BY n)),
e AS (SELECT r, n, unnest(list_filter([CASE WHEN f THEN {'type': 'accepted', 'status': 'QUEUED', 'o': 0} END, CASE WHEN st <> 'QUEUED' AND coalesce(pv, '') <> st THEN {'type': CASE WHEN st IN ('RUNNING', 'CANCELING') THEN 'progress'
   WHEN st = 'NEEDS_CLARIFICATION' THEN 'clarification_required' WHEN st = 'FAILED' THEN 'failed' ELSE 'answer' END, 'status': st, 'o': 1} END], lambda x: x IS NOT NULL)) AS e FROM p)
SELECT r AS response_id, row_number() OVER (PARTITION BY r ORDER BY n, e.o) AS sequence, e.type AS type, e.status AS status FROM e""")
def c11(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("response_id"), F.col("l_linenumber").alias("seq")).agg(F.min("l_partkey").alias("k")).selectExpr(
        "response_id", "seq", "element_at(array('QUEUED', 'RUNNING', 'RUNNING', 'ANSWERED', 'FAILED', 'NEEDS_CLARIFICATION', 'CANCELING', 'PARTIAL'), CAST(k % 8 AS INT) + 1) AS status")
    return C.transition_events(s)


@query("c12_draft_text", f"""WITH {DE} SELECT ev.r AS response_id, v AS draft_version, sum(strlen(delta))::BIGINT AS bytes, string_agg(delta, '' ORDER BY seq) AS text FROM ev JOIN fo USING (r) WHERE type = 'answer_delta' AND v = active AND active > 0 GROUP BY ALL HAVING sum(strlen(delta)) <= 24""")
def c12(spark, sf):
    return C.draft_text(draft_events(spark, sf), 24)[0]


@query("c12_oversize_drafts", f"""WITH {DE} SELECT ev.r AS response_id, v AS draft_version, sum(strlen(delta))::BIGINT AS bytes FROM ev JOIN fo USING (r) WHERE type = 'answer_delta' AND v = active AND active > 0 GROUP BY ALL HAVING sum(strlen(delta)) > 24""")
def c12b(spark, sf):
    return C.draft_text(draft_events(spark, sf), 24)[1]


def readers(spark, sf):
    ev = table(spark, sf, "lineitem").selectExpr("l_orderkey AS response_id", "l_linenumber AS seq").distinct()
    cur = table(spark, sf, "orders").selectExpr("o_orderkey + 1000000 AS reader_id", "o_orderkey AS response_id", "o_custkey % 9 AS after")
    return C.replay_after(ev, cur)


@query("c13_replay_after", "SELECT DISTINCT o_orderkey + 1000000 AS reader_id, o_orderkey AS response_id, l_linenumber::BIGINT AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > o_custkey % 9")
def c13(spark, sf):
    return readers(spark, sf)[0]


@query("c13_cursors_ahead", "SELECT o_orderkey + 1000000 AS reader_id, o_orderkey AS response_id FROM orders WHERE o_custkey % 9 > coalesce((SELECT max(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), 0)")
def c13b(spark, sf):
    return readers(spark, sf)[1]


@query("c14_attempt_limits", """WITH e AS (SELECT o_orderkey AS id, o_custkey AS r, o_orderdate AS op, o_orderdate + to_days((1 + o_orderkey % 10)::INT) AS cl, o_orderpriority AS pool FROM orders),
n AS (SELECT pool, t, sum(d) AS d FROM (SELECT pool, op AS t, 1 AS d FROM e UNION ALL SELECT pool, cl, -1 FROM e) GROUP BY ALL),
b AS (SELECT pool, t, sum(d) OVER (PARTITION BY pool ORDER BY t) - d AS q FROM n)
SELECT id AS execution_id, 'ATTEMPTS' AS reason FROM (SELECT id, row_number() OVER (PARTITION BY r ORDER BY op, id) AS k FROM e) WHERE k > 3
UNION ALL SELECT id, 'QUEUE' FROM e JOIN b ON b.pool = e.pool AND b.t = e.op WHERE q >= 20""")
def c14(spark, sf):
    e = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("response_id"), F.col("o_orderdate").alias("opened"),
        (F.col("o_orderdate") + F.make_dt_interval((1 + F.col("o_orderkey") % 10).cast("int"))).alias("closed"), F.col("o_orderpriority").alias("pool")).withColumn("year", F.year("opened"))
    return C.attempt_limits(e, "year")


@query("c15_cited", "SELECT p_partkey AS revision_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) OR p_partkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)")
def c15(spark, sf):
    li = table(spark, sf, "lineitem")
    return C.cited(table(spark, sf, "part").select(F.col("p_partkey").alias("revision_id")), li.where("l_tax > 0.07").select(F.col("l_partkey").alias("revision_id")),
                   li.where("l_discount > 0.09").select(F.col("l_suppkey").alias("revision_id")))
