"""Registered queries of publication, applicability and devices. Parts act as revisions, suppliers
as devices, brands as version policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions.text import sha
from passageworks.operators import knowledge as K
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import docs_of, marked_frags
from passageworks.sources.tables import table

REV_SQL = """rv AS (SELECT p_partkey AS revision_id, CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name END AS title, p_brand AS source, p_type AS content,
  CASE WHEN p_partkey % 43 = 0 THEN 'ALL' WHEN p_size % 3 = 0 THEN 'GENERAL' ELSE 'DEVICE' END AS scope,
  CASE WHEN p_size % 3 = 0 AND p_partkey % 10 > 0 THEN NULL WHEN p_partkey % 47 = 0 THEN '' ELSE p_brand END AS model,
  CASE WHEN p_size % 3 > 0 AND p_partkey % 4 IN (0, 2) THEN 'v' || p_size % 7 END AS firmware,
  CASE WHEN p_size % 3 > 0 AND p_partkey % 5 = 0 THEN 'h' || p_size % 2 END AS hardware_revision,
  CASE WHEN p_size % 3 > 0 AND (p_partkey % 4 = 1 OR p_partkey % 60 = 0) THEN 'v' || p_size % 4 END AS fw_min,
  CASE WHEN p_size % 3 > 0 AND p_partkey % 4 = 1 AND p_partkey % 53 > 0 THEN 'v' || (p_size % 4 + 3) END AS fw_max,
  CASE WHEN p_size % 3 > 0 THEN p_brand END AS policy_id FROM part)"""


def revs(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS revision_id", "CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE p_name END AS title", "p_brand AS source", "p_type AS content",
        "CASE WHEN p_partkey % 43 = 0 THEN 'ALL' WHEN p_size % 3 = 0 THEN 'GENERAL' ELSE 'DEVICE' END AS scope",
        "CASE WHEN p_size % 3 = 0 AND p_partkey % 10 > 0 THEN NULL WHEN p_partkey % 47 = 0 THEN '' ELSE p_brand END AS model",
        "CASE WHEN p_size % 3 > 0 AND p_partkey % 4 IN (0, 2) THEN 'v' || p_size % 7 END AS firmware", "CAST(NULL AS STRING) AS driver",
        "CASE WHEN p_size % 3 > 0 AND p_partkey % 5 = 0 THEN 'h' || p_size % 2 END AS hardware_revision",
        "CASE WHEN p_size % 3 > 0 AND (p_partkey % 4 = 1 OR p_partkey % 60 = 0) THEN 'v' || p_size % 4 END AS fw_min",
        "CASE WHEN p_size % 3 > 0 AND p_partkey % 4 = 1 AND p_partkey % 53 > 0 THEN 'v' || (p_size % 4 + 3) END AS fw_max",
        "CAST(NULL AS STRING) AS drv_min", "CAST(NULL AS STRING) AS drv_max", "CASE WHEN p_size % 3 > 0 THEN p_brand END AS policy_id")


@query("t03_revision_errors", f"""WITH {REV_SQL}, x AS (SELECT *, coalesce(model, '') || coalesce(firmware, '') || coalesce(hardware_revision, '') || coalesce(fw_min, '') || coalesce(fw_max, '') || coalesce(policy_id, '') AS al FROM rv),
e AS (SELECT revision_id, CASE WHEN trim(title) = '' THEN 'CONTENT' WHEN scope NOT IN ('GENERAL', 'DEVICE') THEN 'SCOPE' WHEN scope = 'GENERAL' AND al <> '' THEN 'GENERAL_RESTRICTED'
 WHEN scope = 'DEVICE' AND coalesce(model, '') = '' THEN 'MODEL' WHEN (fw_min IS NOT NULL OR fw_max IS NOT NULL) AND (firmware IS NOT NULL OR fw_min IS NULL OR fw_max IS NULL) THEN 'RANGE' END AS reason FROM x)
SELECT * FROM e WHERE reason IS NOT NULL""")
def t03(spark, sf):
    return K.validate_revisions(revs(spark, sf))[1]


@query("t05_representation_violations", f"""WITH {S.MARKED},{S.frags()},
rp AS (SELECT fragment_id, start_line AS fs, end_line AS fe, content, unnest([
   {{'k': 'QUESTION', 't': 'q1', 'a': 0, 'b': 0}}, {{'k': CASE WHEN part % 2 = 0 THEN 'OTHER' ELSE ' question' END, 't': 'q2', 'a': 0, 'b': 0}},
   {{'k': CASE WHEN section_no % 3 = 0 THEN 'IMAGE' ELSE 'PASSAGE' END, 't': 'i', 'a': CASE WHEN doc_id % 2 = 0 THEN start_line ELSE 0 END, 'b': CASE WHEN doc_id % 10 = 4 THEN 0 WHEN doc_id % 2 = 0 THEN end_line ELSE 0 END}},
   {{'k': 'TABLE', 't': CASE WHEN doc_id % 7 = 0 THEN '' ELSE 't' END, 'a': CASE WHEN doc_id % 3 = 0 THEN start_line + 1 ELSE 0 END, 'b': CASE WHEN doc_id % 3 = 0 THEN end_line + (doc_id % 4 = 1)::INT ELSE 0 END}},
   {{'k': 'TABLE', 't': CASE WHEN doc_id % 5 = 0 THEN 't' ELSE 'u' END, 'a': 0, 'b': 0}}]) AS r FROM frag),
rr AS (SELECT fragment_id, fs, fe, content, upper(trim(r.k)) AS k, trim(r.t) AS t, r.a AS a, r.b AS b FROM rp),
fl AS (SELECT fragment_id AS doc_id, content AS text FROM frag),{S.lines('fl', 'ln')},
sl AS (SELECT rr.*, row_number() OVER () AS rid FROM rr),
sx AS (SELECT s.rid, x.line, x.content AS c, x.outside AS o, coalesce(sum(starts_with({S.trim('x.content')}, '```')::INT) OVER (PARTITION BY s.rid ORDER BY x.line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS so
   FROM sl s JOIN ln x ON x.doc_id = s.fragment_id AND x.line BETWEEN greatest(s.a - s.fs + 1, 1) AND s.b - s.fs + 1 WHERE s.a > 0 AND s.b >= s.a),
sf AS (SELECT rid, bool_or(contains(c, '![')) AND bool_or(contains(c, '](')) AS img, bool_or(so AND NOT starts_with({S.trim('c')}, '```') AND {S.TABLE_LINE.replace('content', 'c')}) AS tab FROM sx GROUP BY 1),
b AS (SELECT fragment_id, CASE WHEN k NOT IN ('QUESTION', 'TABLE', 'IMAGE', 'PASSAGE') THEN 'KIND' WHEN t = '' THEN 'TEXT' WHEN (a = 0) <> (b = 0) THEN 'HALF_RANGE' WHEN a > 0 AND k NOT IN ('TABLE', 'IMAGE') THEN 'RANGE_KIND'
   WHEN a > 0 AND (a < fs OR b < a OR b > fe) THEN 'RANGE' WHEN a > 0 AND k = 'IMAGE' AND NOT coalesce(img, false) THEN 'NO_IMAGE' WHEN a > 0 AND k = 'TABLE' AND NOT coalesce(tab, false) THEN 'NO_TABLE' END AS reason FROM sl LEFT JOIN sf USING (rid)),
d AS (SELECT fragment_id, 'DUPLICATE' AS reason FROM rr GROUP BY fragment_id, k, t, a, b HAVING count(*) > 1),
n AS (SELECT fragment_id, count(*) FILTER (k = 'QUESTION') AS q, count(*) FILTER (k = 'IMAGE') AS i FROM rr GROUP BY 1),
h AS (SELECT doc_id AS fragment_id, bool_or(outside AND NOT starts_with({S.trim('content')}, '```') AND {S.IMAGE_LINE}) AS img FROM ln GROUP BY 1)
SELECT DISTINCT * FROM (SELECT * FROM b WHERE reason IS NOT NULL UNION ALL SELECT * FROM d UNION ALL SELECT fragment_id, 'QUESTIONS' FROM n WHERE q < 2
 UNION ALL SELECT fragment_id, 'IMAGE_WITHOUT_DESCRIPTION' FROM n JOIN h USING (fragment_id) WHERE i = 0 AND img)""")
def t05(spark, sf):
    fr = marked_frags(spark, sf)
    st = lambda k, t, a, b: f"named_struct('kind', {k}, 'text', {t}, 'start_line', {a}, 'end_line', {b})"
    reps = fr.selectExpr("fragment_id", "inline(array(" + ", ".join([
        st("'QUESTION'", "'q1'", "0L", "0L"), st("CASE WHEN part % 2 = 0 THEN 'OTHER' ELSE ' question' END", "'q2'", "0L", "0L"),
        st("CASE WHEN section_no % 3 = 0 THEN 'IMAGE' ELSE 'PASSAGE' END", "'i'", "CASE WHEN doc_id % 2 = 0 THEN start_line ELSE 0L END",
           "CASE WHEN doc_id % 10 = 4 THEN 0L WHEN doc_id % 2 = 0 THEN end_line ELSE 0L END"),
        st("'TABLE'", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE 't' END", "CASE WHEN doc_id % 3 = 0 THEN start_line + 1 ELSE 0L END",
           "CASE WHEN doc_id % 3 = 0 THEN end_line + CAST(doc_id % 4 = 1 AS INT) ELSE 0L END"),
        st("'TABLE'", "CASE WHEN doc_id % 5 = 0 THEN 't' ELSE 'u' END", "0L", "0L")]) + "))")
    return K.validate_representations(fr, reps)


@query("k01_published", """SELECT revision_id FROM (SELECT l_partkey AS revision_id, arg_max(CASE WHEN l_returnflag = 'R' THEN 'WITHDRAWN' WHEN l_returnflag = 'A' THEN 'DRAFT' ELSE 'PUBLISHED' END,
  {'t': l_shipdate, 'k': l_orderkey * 10 + l_linenumber}) AS st FROM lineitem GROUP BY 1) WHERE st = 'PUBLISHED'""")
def k01(spark, sf):
    log = table(spark, sf, "lineitem").selectExpr(
        "l_partkey AS revision_id", "CASE WHEN l_returnflag = 'R' THEN 'WITHDRAWN' WHEN l_returnflag = 'A' THEN 'DRAFT' ELSE 'PUBLISHED' END AS status",
        "l_shipdate AS ts", "l_orderkey * 10 + l_linenumber AS seq")
    return K.published(log)


DEV_SQL = """dv AS (SELECT s_suppkey AS device_id, 'Brand#' || (s_suppkey % 25 + 1) AS model, CASE WHEN s_suppkey % 7 > 0 THEN 'v' || s_nationkey % 9 END AS firmware, 'h' || s_suppkey % 3 AS hardware_revision FROM supplier WHERE s_suppkey % 31 > 0),
po AS (SELECT DISTINCT p_brand AS policy_id, CASE WHEN p_brand LIKE '%7' THEN 'x' ELSE p_brand END AS model, ['v3', 'v0', 'v5', 'v1', 'v4', 'v2', 'v6'] AS fo FROM part WHERE p_brand NOT LIKE '%9')"""


def devices(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 31 > 0").selectExpr(
        "s_suppkey AS device_id", "'Brand#' || (s_suppkey % 25 + 1) AS model", "CASE WHEN s_suppkey % 7 > 0 THEN 'v' || s_nationkey % 9 END AS firmware",
        "CAST(NULL AS STRING) AS driver", "'h' || s_suppkey % 3 AS hardware_revision")


def policies(spark, sf):
    return table(spark, sf, "part").where("p_brand NOT LIKE '%9'").select("p_brand").distinct().selectExpr(
        "p_brand AS policy_id", "CASE WHEN p_brand LIKE '%7' THEN 'x' ELSE p_brand END AS model", "array('v3','v0','v5','v1','v4','v2','v6') AS firmware_order",
        "CAST(array() AS ARRAY<STRING>) AS driver_order")


_CK = """j AS (SELECT p.*, rv.* EXCLUDE (revision_id), dv.device_id IS NOT NULL AS known, dv.model AS dm, dv.firmware AS df, dv.hardware_revision AS dh, po.model AS pm, coalesce(fo, []) AS fo
 FROM pr p JOIN rv USING (revision_id) LEFT JOIN dv USING (device_id) LEFT JOIN po USING (policy_id)),
c AS (SELECT *, CASE WHEN coalesce(model, '') = '' THEN NULL WHEN model <> dm THEN 'MISMATCH' ELSE 'MATCH' END AS c1,
  CASE WHEN firmware IS NULL THEN NULL WHEN df IS NULL THEN 'UNKNOWN' WHEN firmware <> df THEN 'MISMATCH' ELSE 'MATCH' END AS c2,
  CASE WHEN hardware_revision IS NULL THEN NULL WHEN hardware_revision <> dh THEN 'MISMATCH' ELSE 'MATCH' END AS c3,
  coalesce(list_position(fo, fw_min), 0) AS lo, coalesce(list_position(fo, fw_max), 0) AS hi, coalesce(list_position(fo, df), 0) AS at FROM j),
d AS (SELECT *, CASE WHEN fw_min IS NULL AND fw_max IS NULL THEN NULL WHEN df IS NULL OR coalesce(pm, '') <> coalesce(model, '') OR len(fo) = 0 OR lo = 0 OR hi = 0 OR lo > hi OR c.at = 0 THEN 'UNKNOWN'
  WHEN c.at < lo OR c.at > hi THEN 'MISMATCH' ELSE 'MATCH' END AS c4 FROM c),
a AS (SELECT revision_id, device_id, CASE WHEN scope = 'GENERAL' THEN 'scope=MATCH' WHEN scope <> 'DEVICE' OR NOT known THEN 'device=UNKNOWN'
  ELSE array_to_string(list_filter(['model=' || c1, 'firmware=' || c2, 'hardware_revision=' || c3, 'firmware=' || c4], lambda x: x IS NOT NULL), ',') END AS checks FROM d)"""


@query("k02_assess", f"""WITH {REV_SQL},{DEV_SQL}, pr AS (SELECT DISTINCT l_partkey AS revision_id, l_suppkey AS device_id FROM lineitem),{_CK}
SELECT revision_id, device_id, checks, CASE WHEN contains(checks, 'MISMATCH') THEN 'MISMATCH' WHEN contains(checks, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'MATCH' END AS status FROM a""")
def k02(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("revision_id"), F.col("l_suppkey").alias("device_id")).distinct()
    a = K.assess(pairs, revs(spark, sf), devices(spark, sf), policies(spark, sf))
    return a.withColumn("checks", F.array_join(F.transform("checks", lambda c: F.concat(c["field"], F.lit("="), c["status"])), ","))


@query("k03_match_candidates", f"""WITH {REV_SQL},{DEV_SQL}, pr AS (SELECT revision_id, device_id FROM rv JOIN dv USING (model) WHERE scope = 'DEVICE'),{_CK}
SELECT revision_id, device_id FROM a WHERE NOT contains(checks, 'MISMATCH') AND NOT contains(checks, 'UNKNOWN')""")
def k03(spark, sf):
    return K.matching_pairs(revs(spark, sf), devices(spark, sf), policies(spark, sf))


@query("k04_policy_violations", """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN ' m' WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS model, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 's' END AS source,
  CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['a', 'b' || c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'a' WHEN c_custkey % 19 = 0 THEN ' c' ELSE 'c' END] END AS o FROM customer),
e AS (SELECT id AS policy_id, CASE WHEN trim(model) = '' OR trim(model) <> model THEN 'MODEL' WHEN trim(source) = '' THEN 'SOURCE' WHEN len(o) = 0 THEN 'NO_ORDER'
  WHEN len(list_distinct(o)) < len(o) OR list_contains(o, ' c') THEN 'ORDER' END AS reason FROM p) SELECT * FROM e WHERE reason IS NOT NULL""")
def k04(spark, sf):
    return K.validate_policies(table(spark, sf, "customer").selectExpr(
        "c_custkey AS policy_id", "CASE WHEN c_custkey % 11 = 0 THEN ' m' WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS model", "CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 's' END AS source",
        "CASE WHEN c_custkey % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array('a', 'b' || c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'a' WHEN c_custkey % 19 = 0 THEN ' c' ELSE 'c' END) END AS firmware_order",
        "CAST(NULL AS ARRAY<STRING>) AS driver_order"))


@query("k05_gap_reasons", """WITH a AS (SELECT l_orderkey AS q, count(*) AS n, count(*) FILTER (l_tax < 0.02) AS m, count(*) FILTER (l_tax >= 0.07) AS u FROM lineitem GROUP BY 1),
h AS (SELECT l_orderkey AS q, count(*) AS h FROM lineitem WHERE l_tax < 0.02 AND l_quantity < 30 GROUP BY 1),
j AS (SELECT o_orderkey AS query_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(u, 0) AS u, coalesce(h, 0) AS h FROM orders LEFT JOIN a ON a.q = o_orderkey LEFT JOIN h ON h.q = o_orderkey),
g AS (SELECT *, CASE WHEN n = 0 THEN 'NO_PUBLISHED_KNOWLEDGE' WHEN m = 0 AND u > 0 THEN 'UNKNOWN_APPLICABILITY' WHEN m = 0 THEN 'VERSION_MISMATCH' WHEN query_id % 13 = 0 THEN 'RETRIEVAL_FAILED' WHEN h = 0 THEN 'NO_RETRIEVAL_HIT' ELSE '' END AS gap_reason FROM j)
SELECT query_id, gap_reason, CASE WHEN gap_reason = '' THEN 'FOUND' WHEN u > 0 THEN 'NEEDS_CONTEXT' ELSE 'NOT_FOUND' END AS status FROM g""")
def k05(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    a = li.select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_tax") < 0.02, "MATCH").when(F.col("l_tax") >= 0.07, "UNKNOWN").otherwise("MISMATCH").alias("status"))
    return K.gap_reasons(o, a, li.where("l_tax < 0.02 AND l_quantity < 30").select(F.col("l_orderkey").alias("query_id")), o.where("query_id % 13 = 0"))


@query("k06_corpus_generation", """WITH h AS (SELECT sha256(doc_id::VARCHAR) AS k, doc_id::VARCHAR AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
g AS (SELECT left(k, 4) AS p, sha256(string_agg(v, chr(10) ORDER BY k)) AS d FROM h GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY p)) AS generation FROM g""")
def k06(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_anti")
    return K.corpus_generation(d.select(F.col("doc_id").alias("revision_id")))


@query("k06_two_level_digest", """WITH h AS (SELECT sha256(doc_id::VARCHAR) AS k, sha256(text) AS v FROM documents),
g AS (SELECT left(k, 4) AS p, count(*) AS c, sha256(string_agg(v, chr(10) ORDER BY k)) AS d FROM h GROUP BY 1)
SELECT sum(c)::BIGINT AS items, sha256(string_agg(d, chr(10) ORDER BY p)) AS digest FROM g""")
def k06b(spark, sf):
    return K.two_level_digest(table(spark, sf, "documents").select("doc_id", sha(F.col("text")).alias("h")), "doc_id", "h")


_ARR = "a AS (SELECT user_id AS device_id, event_id AS arrival, epoch_us(ts) - (event_id % 5) * 21600000000 AS observed_at FROM events), s AS (SELECT *, max(observed_at) OVER (PARTITION BY device_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)"


def arrivals(spark, sf):
    return K.newest_snapshots(table(spark, sf, "events").selectExpr(
        "user_id AS device_id", "event_id AS arrival", "unix_micros(CAST(ts AS TIMESTAMP)) - (event_id % 5) * 21600000000 AS observed_at", "event_id div 1000 AS chunk"), "chunk")


@query("k07_newest_snapshots", f"WITH {_ARR} SELECT device_id, observed_at, arrival FROM s WHERE seen IS NULL OR observed_at > seen QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY arrival DESC) = 1")
def k07(spark, sf):
    return arrivals(spark, sf)[0]


@query("k07_refused_snapshots", f"WITH {_ARR} SELECT device_id, arrival, observed_at FROM s WHERE observed_at <= seen")
def k07b(spark, sf):
    return arrivals(spark, sf)[1].select("device_id", "arrival", "observed_at")


@query("k08_resolve_names", """WITH n AS (SELECT s_suppkey AS d, lower(unnest([s_suppkey::VARCHAR, s_name, 'sup-' || s_suppkey % 40])) AS nm FROM supplier),
q AS (SELECT c_custkey AS query_id, lower(trim(CASE c_custkey % 3 WHEN 0 THEN ' SUPPLIER#' || lpad((c_custkey % 150)::VARCHAR, 9, '0') WHEN 1 THEN 'Sup-' || c_custkey % 60 ELSE c_custkey::VARCHAR END)) AS nm FROM customer),
g AS (SELECT query_id, count(DISTINCT d) AS candidates, min(d) AS device_id FROM q LEFT JOIN n USING (nm) GROUP BY 1)
SELECT query_id, candidates, CASE WHEN candidates = 0 THEN 'NO_RECORD' WHEN candidates = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN candidates = 1 THEN device_id END AS device_id FROM g""")
def k08(spark, sf):
    reg = table(spark, sf, "supplier").selectExpr("s_suppkey AS device_id", "s_name AS name", "array('sup-' || s_suppkey % 40) AS aliases")
    q = table(spark, sf, "customer").selectExpr("c_custkey AS query_id", "CASE c_custkey % 3 WHEN 0 THEN ' SUPPLIER#' || lpad(CAST(c_custkey % 150 AS STRING), 9, '0') WHEN 1 THEN 'Sup-' || c_custkey % 60 ELSE CAST(c_custkey AS STRING) END AS text")
    return K.resolve_names(q, reg)


@query("k09_find_mentions", """WITH w AS (SELECT item_id AS d, regexp_split_to_array(text, '\\s+') AS ws FROM benchmark),
n AS (SELECT d, lower(unnest([d::VARCHAR, ws[1], ws[3] || ' ' || ws[4]])) AS nm FROM w),
p AS (SELECT DISTINCT d, CASE WHEN regexp_matches(nm, '^[a-z0-9_.:/-]') THEN '(^|[^a-z0-9_.:/-])' ELSE '' END || regexp_escape(nm) || CASE WHEN regexp_matches(nm, '[a-z0-9_.:/-]$') THEN '([^a-z0-9_.:/-]|$)' ELSE '' END AS rx FROM n WHERE nm <> '')
SELECT DISTINCT doc_id AS text_id, d AS device_id FROM documents JOIN p ON regexp_matches(lower(text), '(?s)' || rx)""")
def k09(spark, sf):
    reg = table(spark, sf, "benchmark").select(F.col("item_id").alias("device_id"), F.split("text", r"\s+").alias("ws")).select(
        "device_id", F.col("ws")[0].alias("name"), F.array(F.concat(F.col("ws")[2], F.lit(" "), F.col("ws")[3])).alias("aliases"))
    return K.find_mentions(docs_of(spark, sf).select(F.col("doc_id").alias("text_id"), "text"), reg)


def owners(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS row_id", "CASE WHEN o_custkey % 3 = 0 THEN 'u' || o_custkey END AS owner", "o_orderpriority AS source_owner")
    m = o.where("source_owner < '5'").select("source_owner").distinct().withColumn("target", F.concat(F.lit("u-"), "source_owner"))
    prev = m.where("source_owner LIKE '2%'").unionByName(m.where("source_owner LIKE '3%'").withColumn("target", F.lit("other")))
    return K.map_owners(o, m, prev)


@query("k10_mapped_rows", """SELECT o_orderkey AS row_id, o_orderpriority AS source_owner, CASE WHEN o_custkey % 3 = 0 THEN 'u' || o_custkey WHEN left(o_orderpriority, 1) IN ('1', '4') THEN 'u-' || o_orderpriority END AS owner FROM orders""")
def k10(spark, sf):
    return owners(spark, sf)[0]


@query("k10_mapped_counts", """SELECT o_orderpriority AS source_owner, count(*) FILTER (o_custkey % 3 > 0) AS mapped FROM orders WHERE left(o_orderpriority, 1) IN ('1', '4') GROUP BY 1""")
def k10b(spark, sf):
    return owners(spark, sf)[1]


@query("k10_mapping_conflicts", """SELECT DISTINCT o_orderpriority AS source_owner, 'u-' || o_orderpriority AS target, 'other' AS old FROM orders WHERE o_orderpriority LIKE '3%'""")
def k10c(spark, sf):
    return owners(spark, sf)[2]
