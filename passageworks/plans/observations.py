"""Registered queries of observations and diagnosis. One user and day of events is one piece of
evidence, an event type is a field, a user is a device and a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.operators import observations as V
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import marked_frags
from passageworks.sources.tables import table

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("v01_validate_requests", """WITH r AS (SELECT o_orderkey AS id, o_orderkey % 5 AS c, o_custkey % 18 AS nf, o_orderdate AS ws, o_orderdate + to_hours((o_custkey % 30)::INT - 2) AS we, o_custkey * 97 % 100000 AS ma, o_custkey % 21 AS w FROM orders),
e AS (SELECT id AS request_id, CASE WHEN c = 4 THEN 'CAPABILITY' WHEN nf < 1 OR nf > 16 THEN 'FIELD_COUNT' WHEN we <= ws OR we - ws > INTERVAL 24 HOUR OR we > TIMESTAMP '2024-01-31 00:00:05' THEN 'WINDOW'
  WHEN ma < 1 OR ma > 86400 THEN 'MAX_AGE' WHEN w = 3 THEN 'PARAMETERS' WHEN w = 7 THEN 'FIELD' END AS reason FROM r) SELECT * FROM e WHERE reason IS NOT NULL""")
def v01(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "element_at(array('metrics', 'alerts', 'logs', 'metrics', 'other'), CAST(o_orderkey % 5 AS INT) + 1) AS capability", "'' AS component",
        "CASE WHEN o_custkey % 18 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(1, CAST(o_custkey % 18 AS INT)), i -> CASE WHEN o_custkey % 21 = 7 THEN ' ' ELSE 'f' || i END) END AS fields",
        "o_orderdate AS window_start", "o_orderdate + make_dt_interval(0, CAST(o_custkey % 30 AS INT) - 2) AS window_end", "o_custkey * 97 % 100000 AS max_age_seconds",
        "map(CASE WHEN o_custkey % 21 = 3 THEN ' ' ELSE 'k' END, 'v') AS parameters")
    return V.validate_requests(o, now())


EV_SQL = """ev AS (SELECT user_id || '-' || date_part('day', ts)::BIGINT AS evidence_id, user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type AS field, value, ts FROM events)"""


def values(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "user_id || '-' || day(ts) AS evidence_id", "user_id", "CAST(date_trunc('day', ts) AS TIMESTAMP) AS day", "event_type AS field", "CAST(value AS STRING) AS value",
        "CASE WHEN event_id % 29 = 0 THEN 's' ELSE 'ms' END AS unit", "CAST(ts AS TIMESTAMP) AS observed_at", "event_id")


def headers(spark, sf):
    return values(spark, sf).select("evidence_id", "user_id", "day").distinct().selectExpr(
        "evidence_id", "user_id", "element_at(array('OK', 'PARTIAL', 'NO_RECORD', 'STALE', 'OK', 'BROKEN'), CAST((user_id + day(day)) % 6 AS INT) + 1) AS status",
        "CASE WHEN user_id % 4 = 0 THEN array('click', 'view', 'purchase', 'error', 'signup') ELSE array('click', 'view', 'purchase', 'error') END AS fields",
        "CASE WHEN user_id % 3 = 0 THEN array('view', 'purchase') ELSE CAST(array() AS ARRAY<STRING>) END AS missing", "day AS window_start", "day + interval 1 day AS window_end",
        "day AS echo_start", "CASE WHEN user_id % 37 = 0 THEN day ELSE day + interval 1 day END AS echo_end", "user_id % 41 > 0 AS identity_ok", "'src' AS source", "'raw' AS raw_ref",
        "1 + user_id % 40 * 86400 AS max_age_seconds")


@query("v02_validate_observations", f"""WITH {EV_SQL},
h AS (SELECT DISTINCT evidence_id, user_id, day, ['OK', 'PARTIAL', 'NO_RECORD', 'STALE', 'OK', 'BROKEN'][((user_id + date_part('day', day)) % 6)::INT + 1] AS status,
  CASE WHEN user_id % 4 = 0 THEN ['click', 'view', 'purchase', 'error', 'signup'] ELSE ['click', 'view', 'purchase', 'error'] END AS fields, CASE WHEN user_id % 3 = 0 THEN ['view', 'purchase'] ELSE []::VARCHAR[] END AS missing FROM ev),
g AS (SELECT evidence_id, list_distinct(list(field)) AS found, count(*) AS n FROM ev GROUP BY 1),
j AS (SELECT h.*, found, n, list_filter(fields, lambda f: NOT list_contains(found, f)) AS lack FROM h JOIN g USING (evidence_id)),
x AS (SELECT evidence_id, status, NOT (status = 'BROKEN' OR user_id % 41 = 0 OR user_id % 37 = 0 OR (status = 'NO_RECORD') OR len(list_filter(found, lambda f: NOT list_contains(fields, f))) > 0
  OR (status = 'OK' AND (len(lack) > 0 OR len(missing) > 0)) OR (status = 'PARTIAL' AND len(list_filter(lack, lambda f: NOT list_contains(missing, f))) > 0) OR list_has_any(missing, found)) AS valid FROM j)
SELECT evidence_id, CASE WHEN valid THEN status ELSE 'FAILED' END AS status, valid FROM x""")
def v02(spark, sf):
    return V.validate_observations(headers(spark, sf), values(spark, sf)).select("evidence_id", "status", "valid")


@query("v03_freshness", f"""WITH {EV_SQL}, h AS (SELECT evidence_id, user_id, day, min(ts) AS oldest FROM ev GROUP BY ALL),
f AS (SELECT evidence_id, ['OK', 'PARTIAL', 'NO_RECORD', 'STALE', 'OK', 'BROKEN'][((user_id + date_part('day', day)) % 6)::INT + 1] AS status,
  least(day + INTERVAL 1 DAY, oldest) >= TIMESTAMP '{NOW}' - to_seconds((1 + user_id % 40 * 86400)::BIGINT) AS fresh FROM h)
SELECT evidence_id, fresh, CASE WHEN NOT fresh AND status IN ('OK', 'PARTIAL', 'NO_RECORD') THEN 'STALE' ELSE status END AS status FROM f""")
def v03(spark, sf):
    return V.freshness(headers(spark, sf), values(spark, sf), now()).select("evidence_id", "fresh", "status")


# Texts that are numbers to the comparison, with the number, and texts that are none
NUMBERS = [("5", 5.0), ("1_000", 1000.0), ("0x1p7", 128.0), ("-0X1.8p+1", -3.0), (".5e1", 5.0), ("+7.", 7.0), ("0x_1Fp0", 31.0), ("1_2.5_0e+1_0", 12.5e10)]
NO_NUMBERS = ["abc", "NaN", "Infinity", " 81", "81d", "81\n", "1__0", "_1", "1_", "0x1", "1e400", "", "1_.5", "0x1p", "٣", "8 1"]
_TEXTS = [x for x, _ in NUMBERS] + NO_NUMBERS


def _sql_text(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


_LIST = f"[{', '.join(map(_sql_text, _TEXTS))}]"
_VALUES = f"[{', '.join([f'{n!r}::DOUBLE' for _, n in NUMBERS] + ['NULL'] * len(NO_NUMBERS))}]"


@query("v04_compare", f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1 + (event_id // 3) % {len(_TEXTS)} END AS i, value, ['EQ', 'GT', 'GE', 'LT', 'LE', 'XX'][(event_id % 6)::INT + 1] AS op,
  CASE WHEN event_id % 4 = 0 THEN '5.0' ELSE (user_id % 100)::VARCHAR END AS w FROM events),
n AS (SELECT *, CASE WHEN i IS NULL THEN value::VARCHAR ELSE {_LIST}[i] END AS v, CASE WHEN i IS NULL THEN value::DOUBLE ELSE {_VALUES}[i] END AS a, w::DOUBLE AS b FROM e)
SELECT event_id, CASE op WHEN 'EQ' THEN v = w WHEN 'GT' THEN coalesce(a > b, false) WHEN 'GE' THEN coalesce(a >= b, false) WHEN 'LT' THEN coalesce(a < b, false) WHEN 'LE' THEN coalesce(a <= b, false) ELSE false END AS holds FROM n""")
def v04(spark, sf):
    made = F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (F.expr("event_id div 3") % len(_TEXTS) + 1).cast("int"))
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).otherwise(made).alias("v"),
        F.expr("element_at(array('EQ', 'GT', 'GE', 'LT', 'LE', 'XX'), CAST(event_id % 6 AS INT) + 1) AS op"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN '5.0' ELSE CAST(user_id % 100 AS STRING) END AS w"))
    return e.select("event_id", V.compare(F.col("v"), F.col("op"), F.col("w")).alias("holds"))


def hold_parts(spark, sf):
    v = values(spark, sf)
    ev = v.select("evidence_id", F.col("user_id").alias("run_id")).distinct().selectExpr("evidence_id", "run_id", "'metrics' AS capability", "'' AS component", "'[]' AS params")
    c = v.select("user_id", "field").distinct().selectExpr(
        "user_id AS run_id", "'rule-' || field AS rule_id", "inline(array(named_struct('cond_no', 1, 'field', field, 'operator', 'GT', 'value', '4', 'max_age_seconds', 2592000), "
        "named_struct('cond_no', 2, 'field', 'click', 'operator', 'LT', 'value', '60', 'max_age_seconds', 1728000)))").selectExpr(
        "*", "'metrics' AS capability", "'' AS component", "'[]' AS params", "'ms' AS unit")
    inc = v.select(F.col("user_id").alias("run_id")).distinct().withColumn("occurred_at", F.lit("2024-01-02").cast("timestamp"))
    cited = c.select("run_id", "rule_id").distinct().join(ev.select("run_id", "evidence_id"), "run_id").where("substring(evidence_id, -1) <> '3'")
    return c, ev, v, inc, cited


HOLD_SQL = f"""{EV_SQL}, w AS (SELECT *, CASE WHEN event_id % 29 = 0 THEN 's' ELSE 'ms' END AS unit FROM (SELECT event_id, user_id || '-' || date_part('day', ts)::BIGINT AS evidence_id, user_id, event_type AS field, value, ts FROM events)),
c AS (SELECT DISTINCT user_id, 'rule-' || field AS rule_id, unnest([{{'n': 1, 'f': field}}, {{'n': 2, 'f': 'click'}}]) AS c FROM w),
p AS (SELECT c.user_id, rule_id, c.n AS n, evidence_id, max(ts) AS last, bool_and(ts >= TIMESTAMP '2024-01-02' AND unit = 'ms' AND ts >= TIMESTAMP '{NOW}' - to_seconds(CASE c.n WHEN 1 THEN 2592000 ELSE 1728000 END)
     AND CASE c.n WHEN 1 THEN value > 4 ELSE value < 60 END) AS ok FROM c JOIN w ON w.user_id = c.user_id AND w.field = c.f GROUP BY ALL),
t AS (SELECT user_id, rule_id, n, bool_and(ok) AND bool_or(right(evidence_id, 1) <> '3') AS met FROM (SELECT *, max(last) OVER (PARTITION BY user_id, rule_id, n) AS newest FROM p) WHERE last = newest GROUP BY ALL),
hd AS (SELECT c.user_id, c.rule_id, bool_and(coalesce(met, false)) AS holds FROM c LEFT JOIN t ON t.user_id = c.user_id AND t.rule_id = c.rule_id AND t.n = c.c.n GROUP BY ALL)"""


@query("v05_conditions_hold", f"WITH {HOLD_SQL} SELECT user_id AS run_id, rule_id, holds FROM hd")
def v05(spark, sf):
    return V.conditions_hold(*hold_parts(spark, sf), now())


def hypotheses(spark, sf):
    c = hold_parts(spark, sf)[0]
    return c.select("run_id", "rule_id").distinct().selectExpr(
        "run_id", "rule_id", "rule_id || '-h' AS hypothesis_id", "element_at(array('CONFIRMED', 'SUPPORTED', 'CANDIDATE', 'RECOVERED'), CAST((run_id + length(rule_id)) % 4 AS INT) + 1) AS status",
        "CASE WHEN run_id % 5 = 0 THEN 'E2' ELSE 'E1' END AS incident_code", "CASE WHEN run_id % 7 = 0 THEN 'other' ELSE 'cause ' || rule_id END AS conclusion")


HYP_SQL = """hy AS (SELECT DISTINCT user_id AS run_id, 'rule-' || event_type AS rule_id, ['CONFIRMED', 'SUPPORTED', 'CANDIDATE', 'RECOVERED'][((user_id + length('rule-' || event_type)) % 4)::INT + 1] AS status FROM events)"""


@query("v06_confirm", f"""WITH {HOLD_SQL},{HYP_SQL}
SELECT hy.run_id, hy.rule_id || '-h' AS hypothesis_id, status, CASE status WHEN 'CONFIRMED' THEN holds AND hy.rule_id <> 'rule-view' AND run_id % 5 > 0 AND run_id % 7 > 0 AND hy.rule_id IN ('rule-click', 'rule-error', 'rule-view')
 WHEN 'RECOVERED' THEN holds AND run_id % 5 > 0 AND hy.rule_id NOT IN ('rule-click', 'rule-error', 'rule-view') ELSE true END AS accepted FROM hy JOIN hd ON hd.user_id = hy.run_id AND hd.rule_id = hy.rule_id""")
def v06(spark, sf):
    rules = table(spark, sf, "events").select("event_type").distinct().selectExpr(
        "'rule-' || event_type AS rule_id", "CASE WHEN event_type IN ('click', 'error', 'view') THEN 'ROOT_CAUSE' ELSE 'RECOVERY' END AS kind", "'E1' AS error_code",
        "'cause rule-' || event_type AS conclusion", "event_type <> 'view' AS published")
    return V.confirm(hypotheses(spark, sf), rules, V.conditions_hold(*hold_parts(spark, sf), now()))


@query("v07_root_status", f"""WITH {HYP_SQL} SELECT run_id, CASE WHEN bool_or(status = 'CONFIRMED') THEN 'CONFIRMED' WHEN bool_or(status = 'SUPPORTED') THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS root_status FROM hy GROUP BY 1""")
def v07(spark, sf):
    return V.root_status(hypotheses(spark, sf))


@query("v08_validate_rules", f"""WITH {S.MARKED},{S.frags()},
r AS (SELECT doc_id, section_no, part, CASE WHEN doc_id % 23 = 0 THEN 'same' ELSE 'r' || section_no || '.' || part END AS rule_id, CASE WHEN doc_id % 11 = 0 THEN 'OTHER' ELSE 'ROOT_CAUSE' END AS kind,
   CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'E1' END AS code, start_line AS a, end_line + CASE WHEN doc_id % 7 = 0 THEN 2 WHEN doc_id % 17 = 0 THEN -100 ELSE 0 END AS b,
   CASE WHEN doc_id % 19 = 0 THEN 0 WHEN doc_id % 29 = 0 THEN 17 ELSE 2 END AS n, doc_id % 31 = 0 AS badc FROM frag),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS inrev, count(*) OVER (PARTITION BY doc_id, rule_id) AS copies, sum(n) OVER (PARTITION BY doc_id, rule_id) AS nc,
   EXISTS (SELECT 1 FROM frag f WHERE f.doc_id = r.doc_id AND r.a BETWEEN f.start_line AND f.end_line AND r.b BETWEEN f.start_line AND f.end_line) AS inside FROM r),
e AS (SELECT doc_id AS revision_id, rule_id, CASE WHEN inrev > 32 THEN 'TOO_MANY' WHEN copies > 1 THEN 'ID' WHEN kind = 'OTHER' THEN 'KIND' WHEN code = ' ' THEN 'TEXT' WHEN b < a THEN 'LINES' WHEN nc = 0 OR nc > 16 THEN 'CONDITIONS'
   WHEN NOT inside THEN 'FRAGMENT' WHEN badc THEN 'CONDITION' END AS reason FROM k) SELECT DISTINCT * FROM e WHERE reason IS NOT NULL""")
def v08(spark, sf):
    fr = marked_frags(spark, sf).withColumn("revision_id", F.col("doc_id"))
    r = fr.selectExpr(
        "revision_id", "CASE WHEN doc_id % 23 = 0 THEN 'same' ELSE 'r' || section_no || '.' || part END AS rule_id", "CASE WHEN doc_id % 11 = 0 THEN 'OTHER' ELSE 'ROOT_CAUSE' END AS kind",
        "CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'E1' END AS error_code", "'c' AS conclusion", "start_line", "end_line + CASE WHEN doc_id % 7 = 0 THEN 2 WHEN doc_id % 17 = 0 THEN -100 ELSE 0 END AS end_line",
        "CASE WHEN doc_id % 19 = 0 THEN 0 WHEN doc_id % 29 = 0 THEN 17 ELSE 2 END AS n")
    c = r.where("n > 0").selectExpr(
        "revision_id", "rule_id", "explode(sequence(1, n)) AS i", "'metrics' AS capability", "CASE WHEN revision_id % 31 = 0 THEN 'GT' ELSE 'EQ' END AS operator", "'f' AS field", "'' AS component",
        "'abc' AS value", "'ms' AS unit", "60 AS max_age_seconds", "map('k', 'v') AS parameters")
    return V.validate_rules(r.drop("n"), c, fr)


def step_parts(spark, sf):
    """Lines of an order are the steps of a run; each depends on lower-numbered ones, and a few close a cycle."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_id")).agg(
        F.min("l_partkey").alias("k"), F.min("l_returnflag").alias("flag"), F.min("l_suppkey").alias("s"))
    steps = s.selectExpr("run_id", "step_id", "CASE WHEN k % 4 = 0 THEN CAST(array() AS ARRAY<INT>) WHEN k % 37 = 0 THEN array(step_id + 1, 99) WHEN k % 5 = 0 THEN array(step_id + 1) ELSE array(step_id - 1) END AS depends_on")
    ex = s.where("flag <> 'N'").selectExpr("run_id", "step_id", "CASE WHEN s % 6 = 0 THEN 'FAILED' WHEN s % 6 = 1 THEN 'REUSED' ELSE 'SUCCEEDED' END AS status")
    pre = s.where("k % 3 = 0").selectExpr("run_id", "step_id", "s % 2 = 0 AS holds")
    return steps, ex, pre


STEP_SQL = """s AS (SELECT l_orderkey AS run_id, l_linenumber AS step_id, min(l_partkey) AS k, min(l_returnflag) AS flag, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
d AS (SELECT run_id, step_id, unnest(CASE WHEN k % 4 = 0 THEN [] WHEN k % 37 = 0 THEN [step_id + 1, 99] WHEN k % 5 = 0 THEN [step_id + 1] ELSE [step_id - 1] END) AS dep FROM s)"""


@query("v09_ready_steps", f"""WITH {STEP_SQL} SELECT run_id, step_id::BIGINT AS step_id FROM s WHERE flag = 'N' AND NOT (k % 3 = 0 AND s % 2 <> 0)
AND NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = s.run_id AND d.step_id = s.step_id AND NOT EXISTS (SELECT 1 FROM s o WHERE o.run_id = d.run_id AND o.step_id = d.dep AND o.flag <> 'N' AND o.s % 6 > 0))""")
def v09(spark, sf):
    return V.ready_steps(*step_parts(spark, sf))


@query("v10_check_steps", f"""WITH RECURSIVE {STEP_SQL}, e AS (SELECT d.* FROM d JOIN s t ON t.run_id = d.run_id AND t.step_id = d.dep),
r(run_id, a, b) AS (SELECT run_id, step_id, dep FROM e UNION SELECT r.run_id, r.a, e.dep FROM r JOIN e ON e.run_id = r.run_id AND e.step_id = r.b)
SELECT DISTINCT run_id, step_id::VARCHAR AS step_id, 'UNKNOWN_DEPENDENCY' AS reason FROM d WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.run_id = d.run_id AND t.step_id = d.dep)
UNION ALL SELECT DISTINCT run_id, NULL, 'CYCLE' FROM r WHERE a = b""")
def v10(spark, sf):
    return V.check_steps(step_parts(spark, sf)[0])


@query("v11_repeated_steps", """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS step_id, min(l_partkey) % 3 AS t, min(l_suppkey) % 2 AS q, min(l_returnflag) AS flag, min(l_quantity) AS qt FROM lineitem GROUP BY ALL)
SELECT DISTINCT a.run_id, a.step_id::BIGINT AS step_id FROM s a JOIN s b ON a.run_id = b.run_id AND a.t = b.t AND a.q = b.q AND a.step_id <> b.step_id WHERE a.flag = 'N' AND b.flag <> 'N' AND a.qt >= 10""")
def v11(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_id")).agg(
        (F.min("l_partkey") % 3).cast("string").alias("target"), (F.min("l_suppkey") % 2).alias("q"), F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("qt"))
    s = s.selectExpr("run_id", "step_id", "'OBSERVE' AS kind", "target", "CASE WHEN step_id % 2 = 0 THEN '  Read　 VALUE ' || q ELSE 'read value ' || q END AS query", "CAST(NULL AS STRING) AS observation",
                     "CASE WHEN qt < 10 THEN 'new data' ELSE '' END AS retry_reason", "flag")
    return V.repeated_steps(s.where("flag = 'N'"), s.where("flag <> 'N'"))


@query("v12_reusable", f"""WITH {EV_SQL}, h AS (SELECT evidence_id, user_id, day, min(ts) AS oldest FROM ev GROUP BY ALL),
f AS (SELECT evidence_id, user_id % 50 AS k, day + INTERVAL 1 DAY AS we FROM h WHERE (user_id + date_part('day', day)) % 6 IN (0, 2, 4) AND least(day + INTERVAL 1 DAY, oldest) >= TIMESTAMP '{NOW}' - to_seconds((1 + user_id % 40 * 86400)::BIGINT)),
b AS (SELECT k, arg_max(evidence_id, {{'w': we, 'e': evidence_id}}) AS evidence_id FROM f GROUP BY 1)
SELECT c_custkey AS request_id, evidence_id FROM customer JOIN b ON k = c_custkey % 60""")
def v12(spark, sf):
    e = V.freshness(
        headers(spark, sf).withColumn("m", F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), (F.col("user_id") % 50).cast("string"))), values(spark, sf), now())
    e = e.withColumn("query_key", V.parameters_key("m"))
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.create_map(F.lit("a"), (F.col("c_custkey") % 60).cast("string"), F.lit("b"), F.lit("1")).alias("m"))
    return V.reusable(r.withColumn("query_key", V.parameters_key("m")), e, "query_key")


@query("v13_no_progress", """SELECT run_id, ordinal FROM (SELECT user_id AS run_id, event_id AS ordinal, value < 40 AS r, lag(value < 40, 1) OVER w AS a, lag(value < 40, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r AND a AND b""")
def v13(spark, sf):
    return V.no_progress(table(spark, sf, "events").selectExpr("user_id AS run_id", "event_id AS ordinal", "CASE WHEN value < 40 THEN 'REUSED' ELSE 'SUCCEEDED' END AS status"))


@query("v15_budget", """WITH g AS (SELECT user_id AS run_id, least(300000, sum(greatest(CASE WHEN event_type = 'view' THEN event_id * 13 % 20000 - 500 ELSE 0 END, 0)))::BIGINT AS active_used_ms,
  count(*) FILTER (event_type IN ('click', 'error')) AS tool_calls, count(*) FILTER (event_type = 'purchase') AS model_calls FROM events GROUP BY 1)
SELECT *, active_used_ms >= 300000 OR tool_calls >= 30 OR model_calls >= 20 AS exhausted FROM g""")
def v15(spark, sf):
    return V.budget(table(spark, sf, "events").selectExpr(
        "user_id AS run_id", "CASE WHEN event_type IN ('click', 'error') THEN 'TOOL' WHEN event_type = 'purchase' THEN 'MODEL' ELSE 'ACTIVE' END AS kind", "CASE WHEN event_type = 'view' THEN event_id * 13 % 20000 - 500 END AS active_ms"))


def fragment_rules(spark, sf):
    fr = marked_frags(spark, sf)
    hits = fr.selectExpr("doc_id AS run_id", "fragment_id", "doc_id AS revision_id", "start_line", "end_line", "start_line * 1000 + part AS ordinal", "CAST(octet_length(content) AS BIGINT) AS bytes")
    rules = fr.selectExpr("doc_id AS revision_id", "'r' || start_line || '.' || part AS rule_id", "start_line + 1 AS start_line", "end_line + CAST(doc_id % 3 = 0 AS INT) AS end_line")
    return V.rules_for_fragments(rules, hits, 6000)


_KEPT = "kp AS (SELECT *, sum(strlen(content)) OVER (PARTITION BY doc_id ORDER BY start_line * 1000 + part) AS total FROM frag QUALIFY total <= 6000)"


@query("v17_kept_fragments", f"WITH {S.MARKED},{S.frags()},{_KEPT} SELECT doc_id AS run_id, fragment_id, total::BIGINT AS total FROM kp")
def v17(spark, sf):
    return fragment_rules(spark, sf)[0].select("run_id", "fragment_id", "total")


@query("v17_attached_rules", f"""WITH {S.MARKED},{S.frags()},{_KEPT}, r AS (SELECT doc_id, 'r' || start_line || '.' || part AS rule_id, start_line + 1 AS a, end_line + (doc_id % 3 = 0)::INT AS b FROM frag)
SELECT kp.doc_id AS run_id, kp.fragment_id, r.rule_id FROM kp JOIN r ON r.doc_id = kp.doc_id AND r.a >= kp.start_line AND r.b <= kp.end_line AND r.a <= r.b""")
def v17b(spark, sf):
    return fragment_rules(spark, sf)[1]


def snapshots(spark, sf):
    c = table(spark, sf, "customer")
    runs = table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "o_custkey AS device_id", "'s' || o_custkey % 7 AS snapshot_id")
    ex = table(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "l_linenumber AS step_id", "CASE WHEN l_returnflag = 'R' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status")
    return V.invalidate(runs, c.where("c_custkey % 9 > 0").selectExpr("c_custkey AS device_id", "'s' || CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 7 ELSE 9 END AS snapshot_id"), ex)


@query("v18_invalidated_runs", """SELECT o_orderkey AS run_id, o_custkey AS device_id, 's' || CASE WHEN c_custkey IS NOT NULL AND c_nationkey % 2 = 1 THEN 9 ELSE o_custkey % 7 END AS snapshot_id, c_custkey IS NOT NULL AND c_nationkey % 2 = 1 AS invalidated
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 9 > 0""")
def v18(spark, sf):
    return snapshots(spark, sf)[0]


@query("v18_interrupted", "SELECT CASE WHEN l_returnflag = 'R' THEN 'INTERRUPTED' ELSE 'SUCCEEDED' END AS status, count(*) AS n FROM lineitem GROUP BY 1")
def v18b(spark, sf):
    return snapshots(spark, sf)[1].groupBy("status").agg(F.count("*").alias("n"))
