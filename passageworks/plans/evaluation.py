"""Registered queries of evaluation, on cases, runs and judgements derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions.scale import neighbours, parts_for
from passageworks.functions.text import SPACE_CLASS, sha, split_lines
from passageworks.operators import evaluation as M
from passageworks.operators import retrieval as R
from passageworks.plans import retrieval as PR
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import docs_of
from passageworks.sources.tables import table


def s(c):
    return F.col(c).cast("string")


@query("m01_check_dataset", """WITH d AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT doc_id % 200 AS g, CASE WHEN doc_id % 400 < 200 AND doc_id % 37 <> 0 THEN 'development' ELSE 'heldout' END AS split FROM d)
SELECT g::VARCHAR AS id, 'LEAK' AS reason FROM c GROUP BY g HAVING count(DISTINCT split) > 1
UNION ALL SELECT doc_id::VARCHAR, CASE WHEN doc_id % 11 = 0 THEN 'SOURCE' ELSE 'QUOTE' END FROM d WHERE doc_id % 11 = 0 OR doc_id % 9 = 0""")
def m01(spark, sf):
    d = docs_of(spark, sf)
    cases = d.select((F.col("doc_id") % 200).alias("group"),
                     F.when((F.col("doc_id") % 400 < 200) & (F.col("doc_id") % 37 != 0), "development").otherwise("heldout").alias("split"))
    quote = F.array_join(F.slice(split_lines(F.col("text")), 1, 2), "\n")
    quote = F.when(F.col("doc_id") % 9 == 0, F.concat(quote, F.lit("!"))).otherwise(quote)
    ev = d.select(F.col("doc_id").alias("case_id"), "doc_id", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
                  F.when(F.col("doc_id") % 11 == 0, "0").otherwise(sha(F.col("text"))).alias("content_sha256"),
                  quote.alias("quote"), sha(quote).alias("quote_sha256"))
    return M.check_dataset(cases, ev, d)


@query("m02_leakage_groups", """WITH RECURSIVE e AS (
  SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b FROM documents WHERE doc_id % 13 <> 5
  UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY text) FROM documents),
u AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL),
r(node, lab) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.lab FROM r JOIN u ON u.a = r.node)
SELECT node, min(lab) AS component FROM r GROUP BY 1""")
def m02(spark, sf):
    d = table(spark, sf, "documents")
    chain = neighbours(d.where("doc_id % 13 <> 5"), ["source", "lang"], "doc_id", "p", "b").select(F.col("doc_id").alias("a"), "b")
    first = d.groupBy(sha(F.col("text")).alias("h")).agg(F.min("doc_id").alias("b"))
    same = d.select(F.col("doc_id").alias("a"), sha(F.col("text")).alias("h")).join(first, "h").select("a", "b")
    return M.leakage_groups(chain.where("b IS NOT NULL").unionByName(same))


@query("m03_split_global", """WITH g AS (SELECT DISTINCT o_custkey AS "group" FROM orders),
r AS (SELECT "group", row_number() OVER (ORDER BY sha256('split-v1:' || "group")) AS rk, count(*) OVER () AS n FROM g)
SELECT "group", CASE WHEN rk <= n * 2 // 5 THEN 'development' ELSE 'heldout' END AS split FROM r""")
def m03(spark, sf):
    return M.split_global(table(spark, sf, "orders").select(F.col("o_custkey").alias("group")), "split-v1")


@query("m04_split_by_category", """WITH g AS (SELECT c_custkey AS "group", arg_min(o_orderpriority, o_orderkey) AS category FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('manual-eval-v1:' || "group")) AS rk, count(*) OVER (PARTITION BY category) AS n FROM g)
SELECT "group", category, CASE WHEN rk <= greatest(1, round_even(n / 2, 0)) OR "group" % 50 = 7 THEN 'development' ELSE 'heldout' END AS split FROM r""")
def m04(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("ordinal"))
    forced = table(spark, sf, "customer").where("c_custkey % 50 = 7").select(F.col("c_custkey").alias("group"))
    return M.split_by_category(o, "manual-eval-v1", forced)


def _pick(kind: str, n: int, held: int, prev: list[str]) -> str:
    used = " ".join(f"AND d NOT IN (SELECT d FROM {p})" for p in prev)
    return f"""{kind}_o AS (SELECT d, arg_min(doc_id, h) AS id, min(h) AS h FROM it WHERE lang = '{kind}' AND d NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) {used} GROUP BY 1),
{kind}_p AS (SELECT * FROM {kind}_o ORDER BY h LIMIT {n}),
{kind}_s AS (SELECT d, id, '{kind}' AS kind, CASE WHEN row_number() OVER (ORDER BY sha256('s1:split:' || d)) <= {held} THEN 'heldout' ELSE 'development' END AS split FROM {kind}_p)"""


@query("m05_stratified_sample", f"""WITH it AS (SELECT doc_id, lang, doc_id % 400 AS d, sha256('s1:' || doc_id) AS h FROM documents),
{_pick('en', 10, 3, [])},{_pick('fr', 20, 7, ['en_s'])},{_pick('de', 30, 10, ['en_s', 'fr_s'])}
SELECT d AS document_id, id, kind, split FROM (SELECT * FROM en_s UNION ALL SELECT * FROM fr_s UNION ALL SELECT * FROM de_s)""")
def m05(spark, sf):
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), (F.col("doc_id") % 400).alias("document_id"))
    ex = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return M.stratified_sample(items, [("en", 10, 3), ("fr", 20, 7), ("de", 30, 10)], "s1", ex)


@query("m06_retrieval_metrics", f"""WITH {PR.DENSE_SQL}, d AS (SELECT query_id, vec_id, score FROM dn), t AS ({PR.ranked('score', 'd', 'vec_id', 20)}),
h AS (SELECT query_id, vec_id // 3 AS id, min(rank) AS rank FROM t WHERE rank <= 5 GROUP BY ALL),
r AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id // 3 AS id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 10 = b.vec_id % 10),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) AS h5, min(rank) AS best, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN h USING (query_id, id) GROUP BY 1)
SELECT query_id, coalesce(h1, 0) / n AS recall_at_1, coalesce(h3, 0) / n AS recall_at_3, coalesce(h5, 0) / n AS recall_at_5, coalesce(h5, 0) / 5 AS precision_at_5,
 (coalesce(h5, 0) > 0)::INT::DOUBLE AS hit_at_5, coalesce(1 / best, 0)::DOUBLE AS mrr_at_5,
 round(coalesce(dcg, 0) / list_sum(list_transform(range(1, 1 + least(5, n)), lambda i: 1 / log2(i + 1))), 9) AS ndcg_at_5 FROM n LEFT JOIN g USING (query_id)""")
def m06(spark, sf):
    t = R.dense_topk(PR.query_vectors(spark, sf), PR.vectors(spark, sf), 20)
    hits = t.select("query_id", F.floor(F.col("vec_id") / 3).alias("id"), "rank")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 3).alias("id"), "label", (F.col("vec_id") % 10).alias("m"))
    topics = e.select("query_id", "label", "m")
    # relevant is whatever shares a query's topic: counted per topic, and looked up for the hits only
    relevant = e.select("label", "m", "id").distinct()
    totals = topics.join(relevant.groupBy("label", "m").agg(F.count("*").alias("n")), ["label", "m"]).select("query_id", "n")
    found = hits.select("query_id", "id").distinct().join(topics, "query_id").join(relevant, ["label", "m", "id"], "left_semi")
    return M.retrieval_metrics(hits, found, totals=totals).withColumn("ndcg_at_5", F.round("ndcg_at_5", 9))


@query("m07_summarize", """WITH e AS (SELECT event_type, CASE WHEN user_id % 3 > 0 THEN (event_id % 7)::DOUBLE END AS recall, value FROM events)
SELECT event_type, count(*) AS count, round(avg(recall), 9) AS mean_recall, round(avg(value), 9) AS latency_mean, quantile_cont(value, 0.5) AS latency_p50,
 quantile_disc(value, 0.95) AS latency_p95 FROM e GROUP BY 1""")
def m07(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("user_id") % 3 > 0, (F.col("event_id") % 7).cast("double")).alias("recall"), "value")
    r = M.summarize(e, ["event_type"], ["recall"], "value")
    return r.withColumn("mean_recall", F.round("mean_recall", 9)).withColumn("latency_mean", F.round("latency_mean", 9))


def baseline(spark, sf):
    e = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 997 == 5, "").otherwise(F.concat(F.lit("s"), s("event_id"))).alias("sample_id"),
        F.col("event_type").alias("metric"), (F.col("value") < 60).alias("pass"), F.col("value").alias("elapsed_ms"))
    return M.baseline_report(e)


@query("m08_baseline_metrics", "SELECT event_type AS metric, count(*) FILTER (value < 60) AS passed, count(*) AS applicable FROM events GROUP BY 1")
def m08a(spark, sf):
    return baseline(spark, sf)[0]


@query("m08_baseline_times", """WITH o AS (SELECT DISTINCT CASE WHEN event_id % 997 = 5 THEN '' ELSE 's' || event_id END AS i, value FROM events),
r AS (SELECT value, row_number() OVER (ORDER BY value) AS rk, count(*) OVER () AS n FROM o)
SELECT max(CASE WHEN rk = (n - 1) // 2 + 1 THEN value END) AS p50_ms, max(CASE WHEN rk = (95 * n - 1) // 100 + 1 THEN value END) AS p95_ms FROM r""")
def m08b(spark, sf):
    return baseline(spark, sf)[1]


@query("m08_baseline_failures", """WITH e AS (SELECT CASE WHEN event_id % 997 = 5 THEN '' ELSE 's' || event_id END AS sample_id, event_type AS metric, value FROM events),
b AS (SELECT sample_id FROM e GROUP BY 1 HAVING sample_id = '' OR count(DISTINCT value) > 1 OR min(value) <= 0)
SELECT sample_id, metric FROM e WHERE NOT value < 60 AND sample_id NOT IN (SELECT sample_id FROM b) UNION ALL SELECT sample_id, 'INVALID_SAMPLE' FROM b""")
def m08c(spark, sf):
    return baseline(spark, sf)[2]


@query("m09_answer_metrics", """WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 20 AS id FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 20 AS id FROM lineitem WHERE l_linenumber < 6),
g AS (SELECT k, count(c.id) AS cited, count(r.id) AS relevant, count(*) FILTER (c.id IS NOT NULL AND r.id IS NOT NULL) AS b
      FROM (SELECT k, id, id AS cid FROM c) c1(k, id, cid) FULL JOIN (SELECT k, id, id AS rid FROM r) r1(k, id, rid) USING (k, id), LATERAL (SELECT cid AS id) c, LATERAL (SELECT rid AS id) r GROUP BY 1),
j AS (SELECT o_orderkey, o_orderstatus <> 'P' AS a, CASE o_orderkey % 4 WHEN 0 THEN 'ANSWERED' WHEN 1 THEN 'UNRESOLVED' WHEN 2 THEN 'FAILED' ELSE 'PARTIAL' END AS st,
   coalesce(cited, 0) AS cited, coalesce(relevant, 0) AS relevant, coalesce(b, 0) AS b FROM orders LEFT JOIN g ON k = o_orderkey)
SELECT o_orderkey AS case_id, (st <> 'FAILED')::INT::DOUBLE AS processing_success, (st = 'ANSWERED')::INT::DOUBLE AS answer_rate,
 CASE WHEN NOT a THEN (st = 'UNRESOLVED')::INT::DOUBLE END AS abstention_accuracy, CASE WHEN a AND relevant > 0 THEN b / relevant END AS citation_recall,
 CASE WHEN a THEN CASE WHEN cited > 0 THEN b / cited ELSE 0 END END::DOUBLE AS citation_precision, CASE WHEN a THEN (b > 0)::INT::DOUBLE END AS citation_hit FROM j""")
def m09(spark, sf):
    li = table(spark, sf, "lineitem")
    st = F.element_at(F.array(*[F.lit(x) for x in ("ANSWERED", "UNRESOLVED", "FAILED", "PARTIAL")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    resp = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") != "P").alias("answerable"), st.alias("status"))
    return M.answer_metrics(resp, li.select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 20).alias("id")),
                            li.where("l_linenumber < 6").select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 20).alias("id")),
                            parts_for(spark, 2 * li.count()))


@query("m10_citation_integrity", """SELECT l_orderkey AS response_id, avg(CASE WHEN p_partkey IS NOT NULL AND l_linenumber <> 3 AND p_size % 10 <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS citation_integrity,
 bool_and(p_partkey IS NOT NULL AND l_linenumber <> 3 AND p_size % 10 <> 0) AS intact FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def m10(spark, sf):
    cites = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("response_id"), F.col("l_partkey").alias("fragment_id"),
        F.when(F.col("l_linenumber") == 3, "x").otherwise(F.concat(F.lit("h"), s("l_partkey"))).alias("content_hash"))
    fr = table(spark, sf, "part").select(F.col("p_partkey").alias("fragment_id"), F.concat(F.lit("h"), s("p_partkey")).alias("content_hash"),
                                         F.when(F.col("p_size") % 10 == 0, "WITHDRAWN").otherwise("PUBLISHED").alias("status"))
    return M.citation_integrity(cites, fr)


def _n(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE_CLASS}\\\\]+', '', 'g')"



@query("m11_anchor_metrics", f"""WITH {PR.R1_SQL}, t AS ({PR.ranked('score', 'lx', 'fragment_id', 5)}),
ev AS (SELECT item_id, unnest([left(text, 40), right(text, 30)]) AS anchor, 'src' || item_id % 20 AS expected FROM benchmark),
p AS (SELECT item_id, anchor, coalesce(bool_or(contains({_n('d.text')}, {_n('anchor')})), false) AS h, coalesce(bool_or(d.source = expected), false) AS s
  FROM ev LEFT JOIN t ON t.query_id = item_id LEFT JOIN documents d ON d.doc_id = t.fragment_id GROUP BY ALL)
SELECT item_id AS case_id, avg(h::INT)::DOUBLE AS evidence_recall, bool_and(h)::INT::DOUBLE AS all_evidence, bool_or(s)::INT::DOUBLE AS document_hit FROM p GROUP BY 1""")
def m11(spark, sf):
    b = table(spark, sf, "benchmark")
    ev = b.select(F.col("item_id").alias("case_id"), F.explode(F.array(F.left("text", F.lit(40)), F.right("text", F.lit(30)))).alias("anchor"),
                  F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    hits = R.lexical_topk(PR.passages(spark, sf), PR.lexical_text(PR.corpus(spark, sf)), 5)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("fragment_id"), F.col("text").alias("content"), "source")
    return M.anchor_metrics(ev, hits.join(d, "fragment_id").select(F.col("query_id").alias("case_id"), "content", "source"))


def needles(spark, sf):
    return table(spark, sf, "benchmark").select(F.concat(F.lit("b"), s("item_id")).alias("needle_id"), "text").unionByName(
        table(spark, sf, "part").select("p_name").distinct().select(F.concat(F.lit("p"), F.col("p_name")).alias("needle_id"), F.col("p_name").alias("text")))


_ND = "n AS (SELECT 'b' || item_id AS needle_id, text AS t FROM benchmark UNION ALL SELECT DISTINCT 'p' || p_name, p_name FROM part)"


@query("m12_containment", f"WITH {_ND} SELECT needle_id, doc_id FROM n JOIN documents ON contains(text, t)")
def m12(spark, sf):
    return M.containment(needles(spark, sf), docs_of(spark, sf))


@query("m12_absent", f"WITH {_ND} SELECT needle_id FROM n WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, t))")
def m12b(spark, sf):
    return M.absent(needles(spark, sf), docs_of(spark, sf))


def judged(spark, sf):
    facts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") < 0.1).alias("facts_met"))
    o = table(spark, sf, "orders").join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 11 == 0, "REPLAY").otherwise("LIVE").alias("data_mode"),
        F.when(F.col("o_orderstatus") == "F", "ANSWERED").when(F.col("o_orderstatus") == "O", "UNRESOLVED").otherwise("PARTIAL").alias("status"),
        (F.col("o_orderkey") % 17 == 0).alias("error"), F.coalesce("facts_met", F.array().cast("array<boolean>")).alias("facts_met"),
        F.size(F.coalesce("facts_met", F.array().cast("array<boolean>"))).alias("required_facts"),
        (F.col("o_custkey") % 19 == 0).cast("int").alias("contradictions"), (F.col("o_custkey") % 23 == 0).cast("int").alias("unsupported_claims"),
        (F.col("o_custkey") % 29 != 0).alias("direct_answer"), (F.col("o_orderstatus") != "O").alias("answerable"),
        (F.col("o_custkey") % 31 != 0).alias("citation_integrity"), (F.col("o_custkey") % 2 == 0).alias("correct_abstention"))


@query("m13_answer_pass", """WITH f AS (SELECT l_orderkey, bool_and(l_discount < 0.1) AS met FROM lineitem GROUP BY 1)
SELECT o_orderkey AS case_id, coalesce(met, true) AND o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0 AND o_custkey % 19 <> 0 AND o_custkey % 23 <> 0 AND o_custkey % 29 <> 0
 AND CASE WHEN o_orderstatus = 'O' THEN o_custkey % 2 = 0 ELSE o_orderstatus = 'F' AND o_custkey % 31 <> 0 END AS passed FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def m13(spark, sf):
    return M.answer_pass(judged(spark, sf)).select("case_id", "passed")


@query("m14_accuracy_wilson", """WITH g AS (SELECT o_orderpriority AS p, count(*) AS total, count(*) FILTER (o_totalprice > 100000) AS passed,
  avg((o_totalprice > 100000)::INT) FILTER (o_orderstatus <> 'P') AS a, avg((o_totalprice > 100000)::INT) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1)
SELECT p AS o_orderpriority, total, passed, round(passed / total, 9) AS accuracy, round(a, 9) AS answerable_accuracy, round(b, 9) AS abstention_accuracy,
 round((passed / total + 3.8416 / (2 * total)) / (1 + 3.8416 / total) - 1.96 * sqrt(passed / total * (1 - passed / total) / total + 3.8416 / (4 * total * total)) / (1 + 3.8416 / total), 9)::DOUBLE AS wilson_low,
 round((passed / total + 3.8416 / (2 * total)) / (1 + 3.8416 / total) + 1.96 * sqrt(passed / total * (1 - passed / total) / total + 3.8416 / (4 * total * total)) / (1 + 3.8416 / total), 9)::DOUBLE AS wilson_high FROM g""")
def m14(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") > 100000).alias("passed"), (F.col("o_orderstatus") != "P").alias("answerable"))
    r = M.accuracy_wilson(o, ["o_orderpriority"])
    return r.select("o_orderpriority", "total", "passed", *[F.round(c, 9).alias(c) for c in ("accuracy", "answerable_accuracy", "abstention_accuracy", "wilson_low", "wilson_high")])


def audit_rows(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_orderkey").alias("case_id"),
                                             (F.col("o_custkey") % 3 != 0).alias("passed"), sha(s("o_custkey")).alias("answer_hash"))


_AUD = """r AS (SELECT o_orderpriority AS experiment, o_orderkey AS case_id, o_custkey % 3 <> 0 AS passed, sha256(o_custkey::VARCHAR) AS h FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY experiment, passed ORDER BY sha256(case_id::VARCHAR)) AS rk, count(*) OVER (PARTITION BY experiment, passed) AS n FROM r),
q AS (SELECT experiment, case_id FROM k WHERE NOT passed OR rk <= ceil(n / 5))"""


@query("m15_audit_sample", f"WITH {_AUD} SELECT * FROM q")
def m15(spark, sf):
    return M.audit_sample(audit_rows(spark, sf))


@query("m15_audited_accuracy", f"""WITH {_AUD},
a AS (SELECT experiment, case_id, CASE WHEN experiment = '2-HIGH' AND case_id % 50 = 1 THEN 'old' ELSE h END AS h, case_id % 4 <> 0 AS ap FROM r WHERE experiment <> '5-LOW' OR case_id % 2 = 0),
j AS (SELECT r.*, a.ap, q.case_id IS NOT NULL AS need FROM r LEFT JOIN a USING (experiment, case_id, h) LEFT JOIN q USING (experiment, case_id)),
g AS (SELECT experiment, bool_and(NOT need OR ap IS NOT NULL) AS complete, count(ap) AS audited, avg(coalesce(ap, passed)::INT) AS acc FROM j GROUP BY 1)
SELECT experiment, complete, audited, CASE WHEN complete THEN round(acc, 9) END AS answer_accuracy FROM g""")
def m15b(spark, sf):
    r = audit_rows(spark, sf)
    a = r.where("experiment <> '5-LOW' OR case_id % 2 = 0").select(
        "experiment", "case_id", F.expr("CASE WHEN experiment = '2-HIGH' AND case_id % 50 = 1 THEN 'old' ELSE answer_hash END").alias("answer_sha256"),
        (F.col("case_id") % 4 != 0).alias("passed"))
    return M.audited_accuracy(r, a).withColumn("answer_accuracy", F.round("answer_accuracy", 9))


def gate(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    block = F.expr("c_custkey div 40")  # forty experiments share a dataset
    ex = c.select(
        k.alias("experiment"), F.when(k % 2 == 0, "development").otherwise("heldout").alias("split"), F.when(k % 7 == 0, "running").otherwise("complete").alias("status"),
        F.lit(10).alias("expected"), F.when(k % 5 == 0, 9).otherwise(10).alias("completed"), (k % 9 == 0).cast("int").alias("errors"), (k % 3 == 0).alias("answers"),
        F.when(k % 4 > 0, F.col("c_acctbal") / 10000).alias("answer_accuracy"), (F.col("c_acctbal") / 9000).alias("evidence_recall"),
        F.when(k % 11 > 0, F.lit(0.97)).alias("all_evidence"), F.lit(0.5).alias("target"), block.alias("dataset"), F.concat(F.lit("cfg"), (k % 3).cast("string")).alias("config"))
    sel = c.where((k % 40 == 1) & (block % 4 < 3)).select(block.alias("heldout_dataset"), F.concat(F.lit("cfg"), (block % 3).cast("string")).alias("config"), block.alias("selection"))
    uses = c.where((k % 40 == 7) & (block % 4 < 2)).select(block.alias("selection"), k.alias("experiment"))
    return M.freeze_gate(ex, sel, uses)


@query("m16_may_freeze", """SELECT c_custkey AS experiment, coalesce(c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 9 <> 0 AND
 CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 10000 >= 0.5 ELSE false END
 ELSE c_custkey % 11 > 0 AND least(c_acctbal / 9000, 0.97) >= 0.5 END, false) AS may_freeze FROM customer WHERE c_custkey % 2 = 0""")
def m16(spark, sf):
    return gate(spark, sf)[0]


@query("m16_heldout_check", """WITH c AS (SELECT c_custkey AS k, c_custkey // 40 AS d FROM customer)
SELECT k AS experiment, CASE WHEN d % 4 = 3 OR d NOT IN (SELECT d FROM c WHERE k % 40 = 1) THEN 'NOT_FROZEN' WHEN d % 3 <> k % 3 THEN 'CONFIG_DIFFERS'
 WHEN d % 4 < 2 AND k % 40 <> 7 AND d IN (SELECT d FROM c WHERE k % 40 = 7) THEN 'ALREADY_USED' ELSE 'ALLOWED' END AS heldout_check FROM c WHERE k % 2 = 1""")
def m16b(spark, sf):
    return gate(spark, sf)[1]


@query("m17_bad_cases", """SELECT l_orderkey AS case_id, l_linenumber AS run FROM lineitem WHERE CASE WHEN l_linenumber <> 2 THEN l_discount < 0.05 ELSE false END OR l_tax < 0.02 OR l_quantity < 5""".replace(
    "l_linenumber AS run", "l_linenumber::BIGINT AS run"))
def m17(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("run"), F.when(F.col("l_linenumber") != 2, 0.95 + F.col("l_discount")).alias("recall_at_5"),
        F.when(F.col("l_tax") < 0.02, 0.5).otherwise(1.0).alias("mrr_at_5"), F.lit(None).cast("double").alias("citation_precision"),
        F.array(F.when(F.col("l_quantity") < 5, 0.5), F.lit(1.0)).alias("scores"))
    r = li.withColumn("recall_at_5", F.round("recall_at_5", 6))
    return M.bad_cases(r).select("case_id", "run")


@query("m18_recheck_headlines", """SELECT experiment, metric FROM (SELECT DISTINCT l_returnflag || l_linestatus AS experiment FROM lineitem), (VALUES ('tax'), ('discount')) t(metric)
 WHERE (experiment LIKE 'A%' AND metric = 'tax') OR (experiment LIKE 'N%' AND metric = 'discount')""")
def m18(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("experiment"),
        F.explode(F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"))).alias("metric", "value"))
    saved = li.groupBy("experiment", "metric").agg(F.avg("value").alias("saved")).where("NOT (experiment LIKE 'N%' AND metric = 'discount')").withColumn(
        "saved", F.expr("saved + CASE WHEN experiment LIKE 'A%' AND metric = 'tax' THEN 1e-6 ELSE 0 END"))
    return M.recheck_headlines(li, saved).select("experiment", "metric")


@query("m19_score_distribution", """WITH s AS (SELECT source, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
  FROM documents LEFT JOIN labels USING (doc_id)), m AS (SELECT source, round(avg(score), 9) AS mean, count(score) AS scored FROM s GROUP BY 1)
SELECT source, score, count(*) AS n, mean, scored FROM s JOIN m USING (source) GROUP BY ALL""")
def m19(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    j = d.select("source", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).when(F.col("quality") == 1, 0.5).when(F.col("quality") == 0, 0.0).alias("score"))
    return M.score_distribution(j, ["source"]).withColumn("mean", F.round("mean", 9))


@query("m20_usage", """WITH a AS (SELECT conv_id % 10 AS artifact, conv_id AS case_id, turn, CASE WHEN turn % 3 = 0 THEN sha256(text) ELSE conv_id || '-' || turn // 4 END AS k,
  length(text) AS p, turn AS c FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 2),
o AS (SELECT artifact, k, arg_min({'case_id': case_id, 'p': p, 'c': c}, turn * 1000000 + case_id) AS x FROM a GROUP BY ALL),
f AS (SELECT DISTINCT conv_id % 10 AS artifact, conv_id AS case_id FROM conversations WHERE conv_id NOT IN (SELECT x.case_id FROM o)),
u AS (SELECT artifact, 1 AS calls, x.p AS p, x.c AS c FROM o UNION ALL SELECT artifact, CASE WHEN case_id % 3 = 0 THEN 2 ELSE 1 END, case_id, 7 FROM f)
SELECT artifact, sum(calls)::BIGINT AS calls, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens FROM u GROUP BY 1""")
def m20(spark, sf):
    c = table(spark, sf, "conversations")
    att = c.where("role = 'assistant' AND conv_id % 5 <> 2").select(
        (F.col("conv_id") % 10).alias("artifact"), F.col("conv_id").alias("case_id"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(s("conv_id"), F.lit("-"), F.floor(F.col("turn") / 4).cast("string"))).alias("response_id"),
        F.col("text").alias("raw"), F.length("text").cast("bigint").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"),
        (F.length("text") + F.col("turn")).alias("total_tokens"), (F.col("turn") * 1000000 + F.col("conv_id")).alias("ordinal"))
    rows = c.select("conv_id").distinct().select(
        (F.col("conv_id") % 10).alias("artifact"), F.col("conv_id").alias("case_id"), F.col("conv_id").alias("prompt_tokens"), F.lit(7).cast("bigint").alias("completion_tokens"),
        (F.col("conv_id") + 7).alias("total_tokens"), F.when(F.col("conv_id") % 3 == 0, 2).alias("recorded_attempts"))
    return M.usage(rows, att)


@query("m21_registry", """WITH r AS (SELECT c_nationkey AS e, c_custkey % 15 AS k, 3 AS ev FROM customer WHERE c_nationkey % 6 <> 5 OR c_custkey % 15 <> 4 GROUP BY ALL
   UNION ALL SELECT c_nationkey, 7, 3 FROM customer WHERE c_nationkey % 4 = 1 GROUP BY ALL),
g AS (SELECT e, count(*) AS runs, count(DISTINCT k) AS ids, sum(ev) AS evaluations FROM r GROUP BY 1),
c AS (SELECT DISTINCT n_regionkey AS ds, n_nationkey % 2 AS sp, c_custkey % 15 AS k FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 3),
z AS (SELECT ds, sp, count(*) AS size FROM c GROUP BY ALL),
j AS (SELECT n_nationkey AS e, n_regionkey AS ds, n_nationkey % 2 AS sp, coalesce(runs, 0) AS runs, coalesce(ids, 0) AS ids, coalesce(evaluations, 0) AS evaluations, size,
  (SELECT count(DISTINCT r.k) FROM r JOIN c ON c.k = r.k WHERE r.e = n_nationkey AND c.ds = n_regionkey AND c.sp = n_nationkey % 2) AS known
  FROM nation LEFT JOIN g ON g.e = n_nationkey LEFT JOIN z ON z.ds = n_regionkey AND z.sp = n_nationkey % 2)
SELECT e::BIGINT AS experiment, ds::BIGINT AS dataset, sp::BIGINT AS split, runs::BIGINT AS runs, evaluations::BIGINT AS evaluations, CASE WHEN e % 9 = 8 OR (e % 10 = 3 AND runs <> 14) THEN 'INCOMPLETE' WHEN size IS NULL THEN 'NO_DATASET'
 WHEN ids < runs THEN 'REPEATED_ID' WHEN known <> ids OR size <> ids THEN 'IDS_DIFFER' WHEN e % 3 = 0 THEN 'published' ELSE 'pending' END AS state FROM j""")
def m21(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    one = c.where("c_nationkey % 6 <> 5 OR c_custkey % 15 <> 4").select(F.col("c_nationkey").alias("experiment"), (F.col("c_custkey") % 15).alias("case_id"), F.lit(3).alias("evaluations")).distinct()
    runs = one.unionByName(c.where("c_nationkey % 4 = 1").select(F.col("c_nationkey").alias("experiment"), F.lit(7).cast("bigint").alias("case_id"), F.lit(3).alias("evaluations")).distinct())
    size = runs.groupBy("experiment").agg(F.count("*").alias("sz"))
    ex = n.select(F.col("n_nationkey").alias("experiment"), F.col("n_regionkey").alias("dataset"), (F.col("n_nationkey") % 2).alias("split"),
                  F.when(F.col("n_nationkey") % 9 == 8, "running").otherwise("complete").alias("status")).join(size, "experiment", "left").withColumn(
        "expected", F.when(F.col("experiment") % 10 == 3, 14).otherwise(F.coalesce("sz", F.lit(0)))).drop("sz")
    cases = n.where("n_regionkey <> 3").join(c, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("dataset"), (F.col("n_nationkey") % 2).alias("split"), (F.col("c_custkey") % 15).alias("case_id")).distinct()
    return M.registry(ex, runs, cases, n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("experiment")))


# Many publications name the same dataset; those of some nations were published twice under ids of their own
def references(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("key"),
                    F.when(F.col("c_nationkey") % 5 == 3, F.col("c_custkey") % 2 + F.col("c_nationkey") * 10).otherwise(F.col("c_nationkey") * 10).cast("string").alias("id"))


_REFS = "r AS (SELECT 'd' || c_nationkey AS key, (c_nationkey * 10 + CASE WHEN c_nationkey % 5 = 3 THEN c_custkey % 2 ELSE 0 END)::VARCHAR AS id FROM customer), g AS (SELECT key, min(id) AS id, count(DISTINCT id) AS n FROM r GROUP BY 1)"


@query("m21_merged_references", f"WITH {_REFS} SELECT key, id FROM g WHERE n = 1")
def m21b(spark, sf):
    return M.merge_references(references(spark, sf))[0]


@query("m21_conflicting_references", f"WITH {_REFS} SELECT key, n FROM g WHERE n > 1")
def m21c(spark, sf):
    return M.merge_references(references(spark, sf))[1]


@query("m22_run_checks", """SELECT o_orderkey AS response_id, CASE WHEN o_orderkey % 8 = 0 THEN 'not_applicable' WHEN o_custkey % 5 > 0 THEN 'pass' ELSE 'fail' END AS live_data_mode,
 CASE o_orderkey % 8 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' ELSE 'pass' END AS processing_success,
 CASE WHEN o_orderkey % 8 NOT IN (3, 4) THEN 'not_applicable' WHEN o_custkey % 3 > 0 THEN 'pass' ELSE 'fail' END AS citation_presence FROM orders""")
def m22(spark, sf):
    st = F.get(F.array(*[F.lit(x) for x in (None, "FAILED", "RUNNING", "ANSWERED", "PARTIAL", "UNRESOLVED", "CANCELED", "NEEDS_CLARIFICATION")]), (F.col("o_orderkey") % 8).cast("int"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("response_id"), st.alias("status"),
                                          F.when(F.col("o_custkey") % 5 > 0, "LIVE").otherwise("REPLAY").alias("data_mode"), (F.col("o_custkey") % 3).alias("citations"))
    return M.run_checks(o)


def traces(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "CHAIN").when(F.col("event_type") == "view", "RETRIEVER").when(F.col("event_type") == "purchase", "LLM").otherwise("TOOL")
    return M.trace_coverage(e.where("event_type = 'error'").select(((F.col("user_id") * 131 + F.col("event_id") * 7) % 5000).alias("trace_id")),
                            e.where("event_type <> 'error'").select((F.col("event_id") % 5000).alias("trace_id"), kind.alias("kind")))


@query("m23_missing_traces", """SELECT DISTINCT (user_id * 131 + event_id * 7) % 5000 AS trace_id FROM events WHERE event_type = 'error'
 AND (user_id * 131 + event_id * 7) % 5000 NOT IN (SELECT event_id % 5000 FROM events WHERE event_type <> 'error')""")
def m23(spark, sf):
    return traces(spark, sf)[0]


@query("m23_span_kinds", """WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'CHAIN' WHEN 'view' THEN 'RETRIEVER' WHEN 'purchase' THEN 'LLM' ELSE 'TOOL' END AS kind, count(*) AS n
  FROM events WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT unnest(['CHAIN', 'RETRIEVER', 'EMBEDDING', 'LLM', 'EVALUATOR']) AS kind)
SELECT coalesce(s.kind, r.kind) AS kind, coalesce(n, 0) AS n, r.kind IS NOT NULL AS required FROM s FULL JOIN r ON s.kind = r.kind""")
def m23b(spark, sf):
    return traces(spark, sf)[1]


@query("m24_capacity", """WITH c AS (SELECT o_orderpriority AS pool, unnest([{'at': o_orderdate, 'd': 1}, {'at': o_orderdate + to_days((1 + o_orderkey % 10)::INT), 'd': -1}]) AS e FROM orders),
n AS (SELECT pool, e.at AS t, sum(e.d) AS d FROM c GROUP BY ALL)
SELECT pool, max(b)::BIGINT AS peak FROM (SELECT pool, sum(d) OVER (PARTITION BY pool ORDER BY t) AS b FROM n) GROUP BY 1""")
def m24(spark, sf):
    o = table(spark, sf, "orders")
    ch = o.select(F.col("o_orderpriority").alias("pool"), F.explode(F.array(
        F.struct(F.col("o_orderdate").alias("at"), F.lit(1).alias("delta")),
        F.struct((F.col("o_orderdate") + F.make_dt_interval((1 + F.col("o_orderkey") % 10).cast("int"))).alias("at"), F.lit(-1).alias("delta")))).alias("e"))
    ch = ch.select("pool", "e.at", "e.delta").withColumn("month", F.date_trunc("month", "at"))
    return M.capacity(ch, ["pool"], "month")


@query("m24_waits", """WITH r AS (SELECT o_orderpriority AS pool, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rk, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT pool, max(CASE WHEN rk = (n - 1) // 2 + 1 THEN v END) AS p50, max(CASE WHEN rk = (95 * n - 1) // 100 + 1 THEN v END) AS p95 FROM r GROUP BY 1""")
def m24b(spark, sf):
    return M.waits(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pool"), "o_totalprice"), ["pool"], "o_totalprice")
