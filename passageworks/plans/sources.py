"""Registered queries of sources: pages, logs, seeds, experiments, generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions.text import sha
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import docs_of, marked_frags
from passageworks.sources import files as FI
from passageworks.sources import logs as LG
from passageworks.sources import pages as PG
from passageworks.sources.tables import spread, table


def pages(spark, sf):
    return spread(table(spark, sf, "pages"))


CANON = "'https://' || lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
PLAIN = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("s01_article_titles", f"SELECT page_id, {CANON.format(u='url')} AS url, {PLAIN.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, {PLAIN.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS page_title FROM pages")
def s01(spark, sf):
    return PG.normalize_pages(pages(spark, sf)).select("page_id", "url", "title", "page_title")


@query("s01_normalize_pages")
def s01b(spark, sf):
    return PG.normalize_pages(pages(spark, sf)).select("page_id", "content_sha256", "bytes", "reason")


_INNER = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?s)<h1>.*?</h1>', '')"


@query("s01_article_letters", f"SELECT page_id, sha256(regexp_replace({PLAIN.format(x=_INNER)}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')) AS letters_sha256 FROM pages")
def s01c(spark, sf):
    """The letters and digits of each article's body, whatever markup stands between them."""
    p = PG.normalize_pages(pages(spark, sf))
    return p.select("page_id", sha(F.regexp_replace("body", r"[^\p{L}\p{Nd}]+", "")).alias("letters_sha256"))


@query("s02_navigation", f"""WITH n AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>')) AS a,
  unnest(range(1, 1 + len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>')))) AS ordinal FROM pages),
l AS (SELECT page_id, ordinal, {PLAIN.format(x="regexp_extract(a, '>([^<]*)</a>', 1)")} AS title, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' || ltrim(regexp_extract(a, 'href="([^"]*)"', 1), '/') AS u FROM n)
SELECT page_id, ordinal::BIGINT AS ordinal, title, title AS breadcrumb, 'document' AS kind, {CANON.format(u='u')} AS url FROM l""")
def s02(spark, sf):
    return PG.navigation(pages(spark, sf)).select("page_id", "ordinal", "title", "breadcrumb", "kind", "url")


@query("s03_canonical_url", """SELECT page_id, 'https://docs.example.com' || CASE WHEN contains(p, '/en/') THEN left(p, strpos(p, '/en/') - 1) || '/manual/' || substring(p, strpos(p, '/en/') + 4) ELSE p END AS url
FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def s03(spark, sf):
    return table(spark, sf, "pages").select("page_id", PG.canonical_url(F.col("url"), "docs.example.com", {"/en/": "/manual/"}).alias("url"))


def altered(spark, sf):
    html = F.col("html")
    html = F.when(F.col("page_id") % 7 == 1, F.regexp_replace(html, "(?s)<title>.*?</title>", "<title>Security Verification</title>")).when(
        F.col("page_id") % 11 == 2, F.replace(F.replace(html, F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))).when(
        F.col("page_id") % 13 == 3, F.regexp_replace(html, "(?s)<article>.*?</article>", "<article><h1>t</h1><p>* short - _text</p></article>")).otherwise(html)
    return pages(spark, sf).withColumn("html", html)


@query("s04_refused_pages", """SELECT page_id, CASE WHEN page_id % 7 = 1 THEN 'CHALLENGE' WHEN page_id % 11 = 2 THEN 'NO_ARTICLE' ELSE 'NO_TEXT' END AS reason FROM pages WHERE page_id % 7 = 1 OR page_id % 11 = 2 OR page_id % 13 = 3""")
def s04(spark, sf):
    return PG.gate_pages(PG.normalize_pages(altered(spark, sf)))[1]


@query("s04_navigation_gate", """WITH n AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1)) AS h FROM pages)
SELECT page_id, count(*) AS entries, count(DISTINCT regexp_extract(h, '^([^?#]*)', 1)) AS urls FROM n GROUP BY 1 HAVING count(*) < 6 OR count(DISTINCT regexp_extract(h, '^([^?#]*)', 1)) < count(*)""")
def s04b(spark, sf):
    return PG.gate_navigation(PG.navigation(pages(spark, sf)), ["page_id"], 6)


@query("s05_corpus_manifest", """WITH h AS (SELECT sha256(doc_id::VARCHAR) AS k, sha256(text) AS v FROM documents), g AS (SELECT left(k, 4) AS p, sha256(string_agg(v, chr(10) ORDER BY k)) AS d FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM documents) AS captured, (SELECT sum(strlen(text)) FROM documents)::BIGINT AS bytes, (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS failed, sha256(string_agg(d, chr(10) ORDER BY p)) AS corpus_sha256 FROM g""")
def s05(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), sha(F.col("text")).alias("sha"), F.octet_length("text").alias("bytes"))
    want = d.select("id").unionByName(d.where("id % 50 = 0").select((F.col("id") + 1000000000).alias("id")))
    return PG.corpus_manifest(d, want)


def ingest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), sha(F.col("text")).alias("sha"))
    return PG.pending(d, d.where("id % 3 <> 2").withColumn("sha", F.when(F.col("id") % 6 == 1, F.lit("old")).otherwise(F.col("sha"))))


@query("s06_pending", "SELECT doc_id AS id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 2")
def s06(spark, sf):
    return ingest(spark, sf)[0]


@query("s06_drift", "SELECT doc_id AS id, sha256(text) AS sha, 'old' AS old_sha FROM documents WHERE doc_id % 6 = 1")
def s06b(spark, sf):
    return ingest(spark, sf)[1]


@query("s07_seed_anchors", """SELECT p_partkey AS seed, CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS facts, unnest(CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE ['d' || p_partkey, p_type] END) AS document,
 unnest(['first', p_name]) AS anchor FROM part""")
def s07(spark, sf):
    raw = table(spark, sf, "part").selectExpr(
        "p_partkey AS seed", "CASE WHEN p_size % 2 = 0 THEN p_brand || ' + x' ELSE 'd' || p_partkey END AS document", "'how' AS kind", "p_name AS question",
        "CASE WHEN p_size % 3 = 0 THEN 'a || b||c' ELSE 'a || b' END AS required_facts", "'first || ' || p_type || '::' || p_name AS anchors")
    s = FI.parse_seeds(raw)
    return s.select("seed", F.size("facts").alias("facts"), F.explode("anchor_list").alias("a")).select("seed", "facts", "a.document", "a.anchor")


def experiment_files(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(True).alias("answerable"), F.col("o_totalprice").alias("latency_ms"),
        F.struct(F.lit("ANSWERED").alias("status"), F.lit("LIVE").alias("data_mode"), F.struct(F.lit(1).alias("calls"), F.col("o_custkey").alias("total_tokens")).alias("model_usage")).alias("result"))).alias("rows"))
    doc = F.to_json(F.struct(F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("name"), F.lit("complete").alias("status"), F.size("rows").alias("expected"),
                             F.struct(F.lit("heldout").alias("split"), F.lit("d").alias("dataset_sha256")).alias("config"), "rows"))
    value = F.when(F.col("o_custkey") % 10 == 0, "not json").when(F.col("o_custkey") % 10 == 1, '{"name":"x","status":"complete"}').otherwise(doc)
    return FI.parse_experiments(rows.select(F.col("o_custkey").cast("string").alias("path"), value.alias("value")))


@query("s08_experiments", "SELECT 'e' || o_custkey AS name, count(*) AS expected, count(*) AS n_rows, sum(o_custkey)::BIGINT AS tokens FROM orders WHERE o_custkey % 10 > 1 GROUP BY o_custkey")
def s08(spark, sf):
    e = experiment_files(spark, sf)[0]
    return e.select("name", "expected", F.size("rows").alias("n_rows"), F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, r: a + r["result"]["model_usage"]["total_tokens"]).alias("tokens"))


@query("s08_other_files", "SELECT DISTINCT o_custkey::VARCHAR AS path FROM orders WHERE o_custkey % 10 <= 1")
def s08b(spark, sf):
    return experiment_files(spark, sf)[1]


def log_pages(spark, sf):
    f = docs_of(spark, sf).select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 17 == 3, F.concat("text", F.lit("\0"))).otherwise(F.col("text")).alias("text"))
    return LG.page_logs(LG.log_lines(f), 5, 900)


PAGES = """ln AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: strlen(x)::BIGINT + CASE WHEN i < len(string_split(text, chr(10))) THEN 1 ELSE 0 END)) AS b,
   unnest(range(1, 1 + len(string_split(text, chr(10))))) AS n FROM documents WHERE doc_id % 17 <> 3),
fo AS (SELECT doc_id, list_reduce(list({'b': b, 'n': n} ORDER BY n), lambda a, x: CASE WHEN a.c = 5 OR a.b >= 900 THEN {'c': 1::BIGINT, 'b': x.b, 'p': a.p + 1, 'o': list_append(a.o, a.p + 1)} ELSE {'c': a.c + 1, 'b': a.b + x.b, 'p': a.p, 'o': list_append(a.o, a.p)} END,
   {'c': 0::BIGINT, 'b': 0::BIGINT, 'p': 1::BIGINT, 'o': []::BIGINT[]}).o AS o FROM ln GROUP BY 1),
pg AS (SELECT ln.doc_id AS file_id, o[n] AS page, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line, sum(b)::BIGINT AS s FROM ln JOIN fo USING (doc_id) GROUP BY ALL),
pp AS (SELECT file_id, page, start_line, end_line, (sum(s) OVER (PARTITION BY file_id ORDER BY page) - s)::BIGINT AS start_offset, (sum(s) OVER (PARTITION BY file_id ORDER BY page))::BIGINT AS end_offset FROM pg)"""


@query("s09_page_logs", f"WITH {PAGES} SELECT * FROM pp")
def s09(spark, sf):
    return log_pages(spark, sf)[0]


@query("s09_refused_logs", "SELECT doc_id AS file_id, CASE WHEN doc_id % 17 = 3 THEN 'TEXT_DECODE_FAILED' ELSE 'TEXT_EXPANSION_LIMIT' END AS reason FROM documents WHERE doc_id % 17 = 3 OR list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) >= 65536")
def s09b(spark, sf):
    return log_pages(spark, sf)[1]


@query("s10_check_log_pages", f"""WITH {PAGES}, k AS (SELECT * FROM pp WHERE NOT (file_id % 9 = 0 AND page = 2)),
c AS (SELECT *, coalesce(lag(end_line) OVER w, 0) AS pl, coalesce(lag(end_offset) OVER w, 0) AS po, row_number() OVER w AS no FROM k WINDOW w AS (PARTITION BY file_id ORDER BY page)),
f AS (SELECT doc_id AS file_id, len(string_split(text, chr(10))) AS l, strlen(text) AS b FROM documents WHERE doc_id % 17 <> 3), m AS (SELECT file_id, max(end_line) AS l, max(end_offset) AS o FROM k GROUP BY 1)
SELECT file_id, page, 'GAP' AS reason FROM c WHERE page <> no OR start_line <> pl + 1 OR start_offset <> po UNION ALL
SELECT f.file_id, 0, 'INCOMPLETE' FROM f LEFT JOIN m USING (file_id) WHERE m.l IS NULL OR m.l <> f.l OR m.o <> f.b""")
def s10(spark, sf):
    p = log_pages(spark, sf)[0].where("NOT (file_id % 9 = 0 AND page = 2)")
    files = docs_of(spark, sf).where("doc_id % 17 <> 3").select(F.col("doc_id").alias("file_id"), F.size(F.split("text", "\n", -1)).alias("line_count"), F.octet_length("text").alias("bytes"))
    return LG.check_log_pages(p, files)


def spanned(spark, sf):
    cell = lambda t, r=1, c=1: f"named_struct('text', {t}, 'rowspan', {r}, 'colspan', {c})"
    t = table(spark, sf, "customer").selectExpr("c_custkey AS table_id", "array(" + ", ".join([
        f"array({cell("'k'")}, {cell("'v'")}, {cell("'w'")})", f"array({cell('c_name', 2)}, {cell('c_mktsegment')}, {cell("'n' || c_nationkey")})", f"array({cell("'both'", 1, 2)})",
        f"array({cell("'wide'", 2, 2)}, {cell("'z'")})", f"CASE WHEN c_custkey % 7 = 0 THEN array({cell("'a'")}, {cell("'b'")}) ELSE array({cell("'a'")}) END"]) + ") AS rows")
    return PG.expand_spans(t)


@query("s11_evidence_rows", """SELECT c_custkey AS table_id, unnest([1, 2, 3, 4])::BIGINT AS "row", unnest(['k：' || c_name || chr(10) || 'v：' || c_mktsegment || chr(10) || 'w：n' || c_nationkey, 'k：' || c_name || chr(10) || 'v：both' || chr(10) || 'w：both',
 'k：wide' || chr(10) || 'v：wide' || chr(10) || 'w：z', 'k：wide' || chr(10) || 'v：wide' || chr(10) || 'w：a']) AS text FROM customer WHERE c_custkey % 7 > 0 UNION ALL
SELECT c_custkey, unnest([1, 2, 3]), unnest(['k：' || c_name || chr(10) || 'v：' || c_mktsegment || chr(10) || 'w：n' || c_nationkey, 'k：' || c_name || chr(10) || 'v：both' || chr(10) || 'w：both', 'k：wide' || chr(10) || 'v：wide' || chr(10) || 'w：z']) FROM customer WHERE c_custkey % 7 = 0""")
def s11(spark, sf):
    return spanned(spark, sf)[0].select("table_id", "row", "text")


@query("s11_ragged_rows", "SELECT c_custkey AS table_id, 4::BIGINT AS \"row\" FROM customer WHERE c_custkey % 7 = 0")
def s11b(spark, sf):
    return spanned(spark, sf)[1]


@query("s12_observation_values", "SELECT user_id || '-' || date_part('day', ts)::BIGINT AS evidence_id, event_type AS field, count(*) AS n, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM events GROUP BY ALL")
def s12(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.expr("day(ts)").alias("d")).agg(F.collect_list(F.struct(
        F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), F.lit("ms").alias("unit"), F.col("ts").alias("observed_at"))).alias("values"))
    obs = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("d").cast("string")).alias("evidence_id"), F.col("user_id").cast("string").alias("device_id"), "values")
    v = FI.split_observations(obs)[1]
    return v.groupBy("evidence_id", "field").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


_LINE = """CASE event_id % 7 WHEN 0 THEN 'no json ' || event_id WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '{"evidence_id": "e' || event_id || '", "values": "none"' WHEN 3 THEN ''
 ELSE '{"evidence_id": "e' || event_id || '", "device_id": "' || user_id || '", "values": [{"field": "' || event_type || '", "value": "' || value || '", "unit": "ms"}]}' END"""


@query("s12_malformed_observations", f"""SELECT event_id, CASE WHEN event_id % 7 < 4 THEN {_LINE} END AS malformed, CASE WHEN event_id % 7 > 3 THEN 'e' || event_id END AS evidence_id, CASE WHEN event_id % 7 > 3 THEN user_id::VARCHAR END AS device_id,
 CASE WHEN event_id % 7 > 3 THEN event_type END AS field FROM events""")
def s12b(spark, sf):
    """Lines of which some are no observation: other text, other JSON, cut off, empty."""
    e = table(spark, sf, "events").select("event_id", F.expr(_LINE).alias("value"))
    return FI.parse_observations(e).select("event_id", "malformed", "evidence_id", "device_id", F.get("values", F.lit(0))["field"].alias("field"))


@query("s14_generation_gaps", f"""WITH {S.MARKED},{S.frags()}, c AS (SELECT doc_id, count(*) AS f FROM frag GROUP BY 1)
SELECT doc_id AS document_id, f AS fragments, CASE WHEN doc_id % 20 = 0 THEN f + 1 ELSE f END AS want_f, 2 * f AS representations, CASE WHEN doc_id % 20 = 10 THEN 1 ELSE 2 * f END AS want_r FROM c
WHERE doc_id % 20 = 0 OR (doc_id % 20 = 10 AND 2 * f <> 1)""")
def s14(spark, sf):
    fr = marked_frags(spark, sf).select(F.col("doc_id").alias("document_id"), "fragment_id")
    reps = fr.select("fragment_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    c = FI.generation_counts(fr, reps)
    m = c.selectExpr("document_id", "CASE WHEN document_id % 20 = 0 THEN fragments + 1 ELSE fragments END AS fragments", "CASE WHEN document_id % 20 = 10 THEN 1L ELSE representations END AS representations")
    return FI.generation_gaps(c, m)


