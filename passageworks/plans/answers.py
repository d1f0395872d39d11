"""Registered queries of the answer audit. An order is an answer, its lines are the claims, parts are
the cited fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions.scale import parts_for
from passageworks.operators import answers as A
from passageworks.operators.text_index import keep
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import docs_of, marked_frags
from passageworks.sources.tables import table


def claims(spark, sf, parts=None):
    lines = table(spark, sf, "lineitem")
    lines = lines.repartition(parts, "l_orderkey") if parts else lines
    return lines.groupBy(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim_index")).agg(
        F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.min("l_suppkey").alias("s"), F.min("l_tax").alias("tax")).selectExpr(
        "*", "array_distinct(array(a, b, s)) AS ids")


CL = "cl AS (SELECT l_orderkey AS answer_id, l_linenumber AS claim_index, min(l_partkey) AS a, max(l_partkey) AS b, min(l_suppkey) AS s, min(l_tax) AS tax FROM lineitem GROUP BY ALL)"


@query("a01_check_verdicts", f"""WITH {CL}, v AS (SELECT answer_id, claim_index + (a % 50 = 3)::INT * 20 AS i, CASE WHEN b % 23 = 0 THEN 'MAYBE' WHEN s % 3 = 0 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS verdict,
  CASE WHEN a % 29 = 0 THEN ' ' ELSE 'why' END AS reason, CASE WHEN a % 31 = 0 THEN 17 ELSE s % 4 END AS n, unnest(CASE WHEN a % 37 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM cl),
g AS (SELECT answer_id, i, count(*) AS c, bool_or(trim(reason) = '') AS br, max(n) AS m, bool_or(verdict = 'MAYBE') AS bv, bool_or(verdict = 'SUPPORTED' AND n = 0) AS bare FROM v GROUP BY ALL),
j AS (SELECT coalesce(cl.answer_id, g.answer_id) AS answer_id, coalesce(claim_index, i) AS claim_index, CASE WHEN cl.answer_id IS NULL THEN 'UNKNOWN_CLAIM' WHEN c IS NULL THEN 'MISSING' WHEN c > 1 THEN 'REPEATED' WHEN br THEN 'REASON'
  WHEN m > 16 THEN 'TOO_MANY_SUPPORTS' WHEN bv THEN 'VERDICT' WHEN bare THEN 'NO_SUPPORT' END AS reason FROM cl FULL JOIN g ON g.answer_id = cl.answer_id AND g.i = cl.claim_index)
SELECT answer_id, claim_index::BIGINT AS claim_index, reason FROM j WHERE reason IS NOT NULL""")
def a01(spark, sf):
    c = claims(spark, sf)
    v = c.selectExpr("answer_id", "claim_index + CAST(a % 50 = 3 AS INT) * 20 AS claim_index", "CASE WHEN b % 23 = 0 THEN 'MAYBE' WHEN s % 3 = 0 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS verdict",
                     "CASE WHEN a % 29 = 0 THEN ' ' ELSE 'why' END AS reason", "CASE WHEN a % 31 = 0 THEN 17 ELSE s % 4 END AS supports", "explode(CASE WHEN a % 37 = 0 THEN array(1, 2) ELSE array(1) END) AS copy")
    return A.check_verdicts(c, v)


@query("a02_check_supports", f"""WITH {S.MARKED},{S.frags()},
x AS (SELECT doc_id AS answer_id, part AS claim_index, fragment_id AS evidence_id, start_line, end_line, string_split(content, chr(10)) AS ls, section_no FROM frag),
sp AS (SELECT *, start_line AS a, CASE WHEN answer_id % 7 = 2 THEN end_line + 1 ELSE least(end_line, start_line + 1) END AS b FROM x),
q AS (SELECT *, CASE WHEN answer_id % 5 = 1 THEN 'invented' ELSE array_to_string(ls[1:(b - a + 1)], chr(10)) END AS quote FROM sp)
SELECT DISTINCT answer_id, claim_index, evidence_id, a AS start_line, b AS end_line, CASE WHEN answer_id % 11 = 4 THEN 'NOT_CITED' WHEN b > end_line OR b - a + 1 > len(ls) THEN 'RANGE'
  WHEN trim(quote) = '' OR quote <> array_to_string(ls[1:(b - a + 1)], chr(10)) OR strlen(quote) > 16384 THEN 'QUOTE' WHEN answer_id % 13 = 5 THEN 'REPEATED' END AS reason FROM q
WHERE answer_id % 11 = 4 OR b > end_line OR b - a + 1 > len(ls) OR trim(quote) = '' OR answer_id % 5 = 1 OR answer_id % 13 = 5 OR strlen(quote) > 16384""")
def a02(spark, sf):
    f = marked_frags(spark, sf)
    s = f.selectExpr("doc_id AS answer_id", "part AS claim_index", "fragment_id AS evidence_id", "start_line", "CASE WHEN doc_id % 7 = 2 THEN end_line + 1 ELSE least(end_line, start_line + 1) END AS end_line",
                     "split(content, '\n', -1) AS ls").selectExpr(
        "*", "CASE WHEN answer_id % 5 = 1 THEN 'invented' ELSE array_join(slice(ls, 1, CAST(end_line - start_line + 1 AS INT)), '\n') END AS quote").drop("ls")
    s = s.unionByName(s.where("answer_id % 13 = 5"))
    return A.check_supports(s, s.where("answer_id % 11 <> 4").select("answer_id", "claim_index", "evidence_id"),
                            f.select(F.col("fragment_id").alias("evidence_id"), "start_line", "end_line", "content"))


def conflict_parts(spark, sf):
    conf = table(spark, sf, "lineitem").where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("answer_id")).agg(
        F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y")).where("x % 3 = 0").selectExpr(
        "answer_id", "CASE WHEN x % 21 = 0 THEN ' ' ELSE 's' || x END AS subject", "CASE WHEN x % 15 = 0 THEN array(x) WHEN x % 33 = 0 THEN array(x, x) ELSE array(x, y) END AS ids")
    return A.block_conflicts(claims(spark, sf), conf)


CF = """cf AS (SELECT l_orderkey AS answer_id, min(l_partkey) AS x, min(l_suppkey) AS y FROM lineitem WHERE l_linenumber = 2 GROUP BY 1 HAVING min(l_partkey) % 3 = 0),
bl AS (SELECT answer_id, unnest([x, y]) AS id FROM cf WHERE x % 21 > 0 AND x % 15 > 0 AND (x % 33 > 0) AND x <> y)"""


@query("a03_unblocked_claims", f"WITH {CL},{CF} SELECT answer_id, claim_index::BIGINT AS claim_index FROM cl WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.answer_id = cl.answer_id AND bl.id IN (cl.a, cl.b, cl.s))")
def a03(spark, sf):
    return conflict_parts(spark, sf)[0].select("answer_id", "claim_index")


@query("a03_conflict_gaps", f"WITH {CF} SELECT answer_id, '资料冲突，已暂停受影响建议：s' || x AS gap FROM cf WHERE x % 21 > 0 AND x % 15 > 0 AND x % 33 > 0 AND x <> y")
def a03b(spark, sf):
    return conflict_parts(spark, sf)[1]


@query("a03_bad_conflicts", f"WITH {CF} SELECT answer_id, CASE WHEN x % 21 = 0 THEN ' ' ELSE 's' || x END AS subject FROM cf WHERE x % 21 = 0 OR x % 15 = 0 OR x % 33 = 0 OR x = y")
def a03c(spark, sf):
    return conflict_parts(spark, sf)[2]


def citation_parts(spark, sf):
    c = claims(spark, sf).selectExpr("answer_id", "claim_index", "array(a, b) AS ids")
    allowed = table(spark, sf, "lineitem").where("l_partkey % 97 > 0").selectExpr("l_orderkey AS answer_id", "l_partkey AS fragment_id", "CASE WHEN l_partkey % 89 = 0 THEN 'old' ELSE 'h' || l_partkey END AS content_hash").distinct()
    fr = table(spark, sf, "part").selectExpr("p_partkey AS fragment_id", "'h' || p_partkey AS content_hash", "CASE WHEN p_size = 7 THEN 'WITHDRAWN' ELSE 'PUBLISHED' END AS status", "CASE WHEN p_partkey % 101 = 0 THEN 'UNKNOWN' ELSE 'MATCH' END AS applicability")
    return A.check_citations(c, allowed, fr)


CI = f"""{CL}, id AS (SELECT answer_id, f, min(o) AS o FROM (SELECT answer_id, unnest([a, b]) AS f, claim_index * 10 + unnest([0, 1]) AS o FROM cl) GROUP BY ALL),
pb AS (SELECT id.*, CASE WHEN f % 97 = 0 OR p_partkey IS NULL THEN 'INVALID' WHEN p_size = 7 OR f % 101 = 0 THEN 'UNRESOLVED' WHEN f % 89 = 0 THEN 'INVALID' END AS problem FROM id LEFT JOIN part ON p_partkey = f),
fa AS (SELECT answer_id, arg_min(problem, o) AS problem FROM pb WHERE problem IS NOT NULL GROUP BY 1)"""


@query("a04_citations", f"WITH {CI} SELECT answer_id, f AS fragment_id, row_number() OVER (PARTITION BY answer_id ORDER BY o) AS ordinal FROM pb WHERE answer_id NOT IN (SELECT answer_id FROM fa)")
def a04(spark, sf):
    return citation_parts(spark, sf)[0]


@query("a04_failed_answers", f"WITH {CI} SELECT * FROM fa")
def a04b(spark, sf):
    return citation_parts(spark, sf)[1]


def supported(spark, sf):
    parts = parts_for(spark, 8 * table(spark, sf, "lineitem").count())
    c = keep(claims(spark, sf, parts), "claims")  # read by all parts below
    v = c.selectExpr("answer_id", "claim_index", "CASE WHEN s % 5 = 0 THEN 'CONTRADICTED' ELSE 'SUPPORTED' END AS verdict")
    cites = c.repartition(parts, "answer_id").select("answer_id", F.explode("ids").alias("fragment_id")).distinct()
    conf = c.where("a % 9 = 0").selectExpr("answer_id", "a AS id")
    return A.keep_supported(c, v, cites, conf, parts)


@query("a05_supported_claims", f"WITH {CL} SELECT answer_id, claim_index::BIGINT AS claim_index FROM cl WHERE s % 5 > 0")
def a05(spark, sf):
    return supported(spark, sf)[0].select("answer_id", "claim_index")


@query("a05_kept_citations", f"""WITH {CL}, ct AS (SELECT DISTINCT answer_id, unnest([a, b, s]) AS f FROM cl), us AS (SELECT answer_id, unnest([a, b, s]) AS f FROM cl WHERE s % 5 > 0 UNION SELECT answer_id, a FROM cl WHERE a % 9 = 0)
SELECT answer_id, f AS fragment_id FROM ct WHERE answer_id NOT IN (SELECT answer_id FROM cl WHERE s % 5 = 0) OR EXISTS (SELECT 1 FROM us WHERE us.answer_id = ct.answer_id AND us.f = ct.f)""")
def a05b(spark, sf):
    return supported(spark, sf)[1]


@query("a06_final_status", """WITH j AS (SELECT o_orderkey AS answer_id, o_custkey % 2 AS docs, o_custkey % 3 = 0 AS need, count(l_orderkey) FILTER (l_tax > 0.06) AS c, count(l_orderkey) FILTER (l_tax < 0.01) AS o,
  count(l_orderkey) FILTER (l_discount > 0.07) AS g FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT answer_id, CASE WHEN c = 0 AND o = 0 AND docs = 0 AND need THEN 'NEEDS_CLARIFICATION' WHEN c = 0 AND o = 0 THEN 'UNRESOLVED' WHEN g > 0 THEN 'PARTIAL' ELSE 'ANSWERED' END AS status FROM j""")
def a06(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("answer_id", F.col("l_orderkey"))
    ans = table(spark, sf, "orders").selectExpr("o_orderkey AS answer_id", "o_custkey % 2 AS documents", "o_custkey % 3 = 0 AS needs_context")
    return A.final_status(ans, li.where("l_tax > 0.06"), li.where("l_tax < 0.01"), li.where("l_discount > 0.07"))


@query("a09_private_sources", """WITH s AS (SELECT o_orderkey AS r, o_custkey AS c, CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 's' || o_orderkey END AS source_id, CASE o_orderkey % 7 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'EXECUTION' WHEN 2 THEN 'EXECUTION' ELSE 'ATTACHMENT' END AS kind FROM orders)
SELECT r AS response_id, source_id, CASE WHEN source_id = '' THEN 'ID' WHEN kind = 'OTHER' THEN 'KIND' ELSE kind END AS reason FROM s LEFT JOIN customer ON c_custkey = c
WHERE source_id = '' OR kind = 'OTHER' OR (kind = 'ATTACHMENT' AND NOT coalesce(c_nationkey % 3 > 0 AND c % 8 > 0, false)) OR (kind = 'EXECUTION' AND (r % 5 = 0 OR r % 3 = 0))""")
def a09(spark, sf):
    o = table(spark, sf, "orders")
    src = o.selectExpr("o_orderkey AS response_id", "o_custkey AS conversation_id", "CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 's' || o_orderkey END AS source_id",
                       "CASE o_orderkey % 7 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'EXECUTION' WHEN 2 THEN 'EXECUTION' ELSE 'ATTACHMENT' END AS source_kind", "o_custkey AS attachment_id",
                       "CASE WHEN o_custkey % 8 > 0 THEN 'h' || o_custkey ELSE 'x' END AS attachment_hash", "o_orderkey AS execution_id", "'c' AS content_sha256", "'k' AS code_sha256")
    att = table(spark, sf, "customer").selectExpr("c_custkey AS attachment_id", "c_custkey AS conversation_id", "'h' || c_custkey AS sha256", "CASE WHEN c_nationkey % 3 = 0 THEN 'PARSING' ELSE 'READY' END AS status")
    exe = o.selectExpr("o_orderkey AS execution_id", "o_custkey AS conversation_id", "o_orderkey AS response_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status",
                       "o_orderkey % 3 > 0 AS cleaned", "'s' || o_orderkey AS source_id", "'c' AS content_sha256", "'k' AS code_sha256")
    return A.check_private_sources(src, att, exe)


@query("a10_select_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
r AS (SELECT doc_id, ls, text, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 + doc_id % 3 END AS a, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 + doc_id % 5 END AS b FROM l),
x AS (SELECT *, CASE WHEN a = 0 THEN text ELSE array_to_string(ls[a:b], chr(10)) END AS t, a > 0 AND (b > len(ls) OR b < a) AS bad FROM r),
s AS (SELECT doc_id, t, CASE WHEN bad THEN 'INVALID_RANGE' WHEN strlen(t) > 4000 THEN 'NEEDS_RANGE' ELSE 'OK' END AS status FROM x)
SELECT doc_id AS request_id, status, CASE WHEN status = 'OK' THEN sha256(t) END AS content_sha256 FROM s""")
def a10(spark, sf):
    d = docs_of(spark, sf)
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), "text")
    req = d.selectExpr("doc_id AS request_id", "doc_id AS page_id", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 + doc_id % 3 END AS start_line", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 + doc_id % 5 END AS end_line")
    return A.select_lines(pages, req, 4000).select("request_id", "status", "content_sha256")
