"""Registered queries of tables, assets, generated descriptions and their checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from passageworks.functions.text import sha
from passageworks.operators import enrichment as E
from passageworks.operators import fragments as FR
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import BLOCKS, LIMIT, docs_of, marked_docs, marked_frags
from passageworks.sources.tables import table


def numbered_blocks(docs):
    b = FR.blocks(docs)
    return b.withColumn("block_id", F.row_number().over(W.partitionBy("doc_id").orderBy("start_line")).cast("bigint"))


NB = f"{S.MARKED},{BLOCKS},{S.pack('bg', 'pk', 1800, 'doc_id, run, kind, section', cut_long=False).replace('USING (doc_id, run, kind, section, start_line)', 'ON i.doc_id = f.doc_id AND i.run = f.run')},nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS id FROM pk)"


def chunked(spark, sf, max_bytes):
    d = marked_docs(spark, sf)
    b = numbered_blocks(d)
    ends = b.groupBy("doc_id").agg(F.collect_list("block_id").alias("xs")).select(
        "doc_id", F.concat(F.filter("xs", lambda x: x % 3 == 0), F.array(F.lit(-5).cast("bigint"))).alias("ends"))
    return E.apply_boundaries(d, b, E.end_plan(ends, b), max_bytes)


@query("t09_chunks", f"""WITH {NB}, c AS (SELECT doc_id, id, section, start_line, end_line, CASE WHEN id = 1 THEN 1 ELSE 1 + (id - 2 + 3 - 0) // 3 END AS g0, CASE WHEN id = 1 THEN 0 ELSE 1 + (id - 1) // 3 END AS g FROM nb),
h AS (SELECT doc_id, CASE WHEN id = 1 THEN -1 ELSE (id - 1) // 3 END AS g, min(start_line) AS start_line, max(end_line) AS end_line FROM c GROUP BY ALL),
s AS (SELECT doc_id, g, string_agg(coalesce(section, ''), ' / ' ORDER BY f) AS section FROM (SELECT doc_id, CASE WHEN id = 1 THEN -1 ELSE (id - 1) // 3 END AS g, coalesce(section, '') AS section, min(id) AS f FROM c GROUP BY ALL) GROUP BY ALL)
SELECT h.doc_id, s.section, h.start_line, h.end_line, sha256({S.trim('string_agg(l.content, chr(10) ORDER BY l.line)')}) AS content_sha FROM h JOIN s USING (doc_id, g) JOIN lines l ON l.doc_id = h.doc_id AND l.line BETWEEN h.start_line AND h.end_line GROUP BY ALL""")
def t09(spark, sf):
    return chunked(spark, sf, 1 << 30)[0].select("doc_id", "section", "start_line", "end_line", sha(F.col("content")).alias("content_sha"))


_BODY = S.trim("array_to_string(ls[{a}:{z}], chr(10))")


@query("t09_bounded_chunks", f"""WITH {NB}, c AS (SELECT doc_id, CASE WHEN id = 1 THEN 1 ELSE 1 + (id + 2) // 3 END AS chunk_no, list({{'a': start_line, 'z': end_line}} ORDER BY id) AS bs FROM nb GROUP BY ALL),
f AS (SELECT c.doc_id, chunk_no, ls, list_reduce(bs, lambda p, x: CASE WHEN len(p) > 0 AND strlen({_BODY.format(a='p[-1].a', z='x.z')}) <= {LIMIT} THEN list_append(p[1:len(p) - 1], {{'a': p[-1].a, 'z': x.z}}) ELSE list_append(p, x) END,
  []::STRUCT(a BIGINT, z BIGINT)[]) AS ps FROM c JOIN (SELECT doc_id, string_split(text, chr(10)) AS ls FROM marked) m USING (doc_id)),
u AS (SELECT doc_id, chunk_no, ls, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS part FROM f)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, part::BIGINT AS part, strlen({_BODY.format(a='p.a', z='p.z')})::BIGINT AS bytes FROM u""")
def t09b(spark, sf):
    return chunked(spark, sf, LIMIT)[0].select("doc_id", "chunk_no", "part", F.octet_length("content").cast("bigint").alias("bytes"))


@query("t09_plan_violations", f"""WITH {NB}, n AS (SELECT doc_id, count(*) AS n FROM nb GROUP BY 1)
SELECT doc_id, 1::BIGINT AS chunk_no, CASE doc_id % 5 WHEN 0 THEN 'NOT_CONTIGUOUS' WHEN 1 THEN 'UNKNOWN_BLOCK' END AS reason FROM n WHERE doc_id % 5 < 2
UNION ALL SELECT doc_id, 0, 'OMITS_BLOCKS' FROM n WHERE doc_id % 5 = 2 AND n > 1""")
def t09c(spark, sf):
    d = marked_docs(spark, sf)
    b = numbered_blocks(d)
    plan = b.groupBy("doc_id").agg(F.count("*").alias("n")).selectExpr(
        "doc_id", "1L AS chunk_no", "CASE WHEN doc_id % 5 = 0 THEN 2L ELSE 1L END AS start_block",
        "CASE WHEN doc_id % 5 = 0 THEN greatest(n, 2L) WHEN doc_id % 5 = 1 THEN n + 1 WHEN doc_id % 5 = 2 THEN 1L ELSE n END AS end_block")
    return E.apply_boundaries(d, b, plan, 1 << 30)[1].where("reason <> 'OVERSIZE'")


def _cells(x: str) -> str:
    v = S.trim(x)
    return f"list_transform(regexp_extract_all('|' || regexp_replace(regexp_replace({v}, '^\\|', ''), '\\|$', ''), '(?s)\\|((?:\\\\.|[^|\\\\]|\\\\$)*)', 1), lambda c: {S.trim("regexp_replace(c, '(?s)\\\\(.)', '\\1', 'g')")})"


@query("t11_table_rows", f"""WITH {S.MARKED},{BLOCKS},
tb AS (SELECT doc_id, start_line, list_transform(string_split(body, chr(10)), lambda l: {_cells('l')}) AS cs FROM bg WHERE kind = 'table'),
sk AS (SELECT *, CASE WHEN len(cs) > 1 AND len(list_filter(cs[2], lambda c: NOT regexp_full_match(c, ':?-{{3,}}:?'))) = 0 THEN 2 ELSE 1 END AS k FROM tb),
r AS (SELECT doc_id, start_line, cs[1] AS h, k, unnest(cs[(k + 1):]) AS c, unnest(range(1, len(cs) - k + 1)) AS i FROM sk WHERE len(cs) > k)
SELECT doc_id, start_line AS table_line, array_to_string(h, chr(31)) AS headers, i::BIGINT AS "row", (start_line + k + i - 1)::BIGINT AS line,
 array_to_string((list_concat(c, list_transform(range(greatest(len(h) - len(c), 0)), lambda x: '')))[1:len(h)], chr(31)) AS cells FROM r""")
def t11(spark, sf):
    r = E.table_rows(marked_docs(spark, sf))
    return r.select("doc_id", "table_line", F.array_join("headers", "\x1f").alias("headers"), "row", "line", F.array_join("cells", "\x1f").alias("cells"))


@query("t12_split_tables", """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, [l_shipdate::DATE::VARCHAR, 'p' || l_partkey, l_returnflag] AS c FROM lineitem),
x AS (SELECT doc_id, n, n + 1 AS line, 'f' || (n + 1) // 5 AS f, strlen(array_to_string(c, '')) + 6 + 2 + 2 + 2 AS b FROM r),
fo AS (SELECT doc_id, list_reduce(list({'n': n, 'g': f, 'z': b} ORDER BY n), lambda a, x: CASE WHEN a.c = 0 OR a.g <> x.g OR a.c >= 3 OR a.z + x.z > 80 THEN {'c': 1::BIGINT, 'z': x.z, 'g': x.g, 'p': a.p + 1, 'o': list_append(a.o, a.p + 1)}
   ELSE {'c': a.c + 1, 'z': a.z + x.z, 'g': x.g, 'p': a.p, 'o': list_append(a.o, a.p)} END, {'c': 0::BIGINT, 'z': 0::BIGINT, 'g': '', 'p': 0::BIGINT, 'o': []::BIGINT[]}).o AS o FROM x GROUP BY 1)
SELECT x.doc_id, 1::BIGINT AS table_line, o[n] AS part, min(f) AS fragment_id, min(line) AS start_line, max(line) AS end_line, count(*) AS rows FROM x JOIN fo USING (doc_id) GROUP BY ALL""")
def t12(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("row", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("bigint"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).cast("bigint").alias("table_line"), "row", (F.col("row") + 1).alias("line"),
                     F.array(F.to_date("l_shipdate").cast("string"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), "l_returnflag").alias("cells"))
    own = rows.select("doc_id", "line", F.concat(F.lit("f"), F.floor(F.col("line") / 5).cast("string")).alias("fragment_id"))
    return E.split_tables(rows, own, 3, 80)


@query("t16_attach_representations", f"""WITH {S.MARKED},{S.frags('marked', LIMIT)},
im AS (SELECT fragment_id, start_line + i % (end_line - start_line + 1) AS a, i FROM (SELECT *, unnest(range(1, doc_id % 40 + 1)) AS i FROM frag)),
fl AS (SELECT fragment_id, start_line, unnest(string_split(content, chr(10))) AS content, unnest(range(0, len(string_split(content, chr(10))))) AS k FROM frag),
tm AS (SELECT fragment_id, min(start_line + k) AS a, max(start_line + k) AS z FROM fl WHERE {S.TABLE_LINE} GROUP BY 1),
r AS (SELECT fragment_id, a, z, count(*) AS c FROM (SELECT fragment_id, a, a AS z FROM im UNION ALL SELECT fragment_id, a, z FROM tm) GROUP BY ALL),
g AS (SELECT fragment_id, sum(c)::BIGINT AS n, list({{'a': a, 'c': c}} ORDER BY a, z) AS rs FROM r GROUP BY 1),
p AS (SELECT f.*, coalesce(n, 0) AS n, CASE WHEN n > 16 THEN list_reduce(rs, lambda p, x: CASE WHEN len(p) > 0 AND p[-1].c + x.c <= 16 THEN list_append(p[1:len(p) - 1], {{'a': p[-1].a, 'c': p[-1].c + x.c}}) ELSE list_append(p, x) END,
  []::STRUCT(a BIGINT, c BIGINT)[]) ELSE [{{'a': start_line, 'c': coalesce(n, 0)}}] END AS ps FROM frag f LEFT JOIN g USING (fragment_id)),
u AS (SELECT *, unnest(ps) AS e, unnest(range(1, len(ps) + 1)) AS pt FROM p)
SELECT fragment_id, pt::BIGINT AS part, CASE WHEN n > 16 THEN section || '（资产分片' || pt || '）' ELSE section END AS section, CASE WHEN pt = 1 THEN start_line ELSE e.a END AS start_line,
 coalesce(ps[pt + 1].a - 1, end_line) AS end_line, 1::BIGINT AS questions, e.c AS assets FROM u""")
def t16(spark, sf):
    fr = marked_frags(spark, sf)
    q = fr.selectExpr("fragment_id", "1L AS ordinal", "'q ' || section AS text")
    a = fr.where("doc_id % 40 > 0").selectExpr("fragment_id", "start_line AS s", "end_line AS e", "explode(sequence(1, CAST(doc_id % 40 AS INT))) AS i").selectExpr(
        "fragment_id", "s + i % (e - s + 1) AS start_line", "s + i % (e - s + 1) AS end_line", "'IMAGE' AS kind", "'d' || i AS text")
    return E.attach_representations(fr, q, a).select("fragment_id", "part", "section", "start_line", "end_line", F.size("questions").cast("bigint").alias("questions"), F.size("assets").cast("bigint").alias("assets"))


REW = """o_orderkey AS id, o_orderpriority AS original, CASE o_orderkey % 8 WHEN 0 THEN '{"queries":["a ' || o_custkey || '","b"]}' WHEN 1 THEN 'QUERY: x' || chr(10) || ' query：y' || chr(10) || 'noise' WHEN 2 THEN '{"queries":["one"]}'
 WHEN 3 THEN '{"queries":["a","b"],"extra":1}' WHEN 4 THEN 'QUERY: ' || o_orderpriority || chr(10) || 'QUERY: z' WHEN 5 THEN 'query: query 1' || chr(10) || 'QUERY: 问题2' || chr(10) || 'QUERY: p' || chr(10) || 'QUERY: p'
 WHEN 6 THEN '{"queries":["a","b","c","d"]}' ELSE 'QUERY: u' || chr(10) || 'QUERY: v' || chr(10) || 'QUERY: w' END AS raw"""


def rewrites(spark, sf):
    return E.parse_rewrites(table(spark, sf, "orders").selectExpr(*[x for x in (REW[:REW.index(",")], "o_orderpriority AS original", REW[REW.index("CASE"):])]), 3)


@query("t26_rewrites", """WITH g AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN [o_orderpriority, 'a ' || o_custkey, 'b'] WHEN 1 THEN [o_orderpriority, 'x', 'y'] ELSE [o_orderpriority, 'u', 'v', 'w'] END AS q FROM orders WHERE o_orderkey % 8 IN (0, 1, 7))
SELECT id, unnest(range(0, len(q)))::BIGINT AS route, unnest(q) AS query FROM g""")
def t26(spark, sf):
    return rewrites(spark, sf)[0]


@query("t26_invalid_rewrites", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 8 NOT IN (0, 1, 7)")
def t26b(spark, sf):
    return rewrites(spark, sf)[1]


@query("t27_enrichment", """WITH e AS (SELECT o_orderkey AS id, o_custkey % 2 = 0 AS t, o_custkey % 3 = 0 AS i, o_orderkey % 11 AS k FROM orders),
r AS (SELECT id, CASE k WHEN 0 THEN 'MISSING' WHEN 1 THEN 'REPEATED_ID' WHEN 2 THEN 'QUESTION_COUNT' WHEN 3 THEN 'TEXT' WHEN 4 THEN 'DUPLICATE_QUESTIONS' WHEN 5 THEN 'ASSETS' WHEN 6 THEN CASE WHEN t THEN 'TOO_MANY' END END AS reason FROM e)
SELECT * FROM r WHERE reason IS NOT NULL UNION ALL SELECT -id - 1, 'UNKNOWN_ID' FROM e WHERE k = 7""")
def t27(spark, sf):
    o = table(spark, sf, "orders")
    exp = o.selectExpr("o_orderkey AS id", "o_custkey % 2 = 0 AS has_table", "o_custkey % 3 = 0 AS has_image")
    p = o.where("o_orderkey % 11 > 0").selectExpr(
        "explode(CASE o_orderkey % 11 WHEN 1 THEN array(o_orderkey, o_orderkey) WHEN 7 THEN array(o_orderkey, -o_orderkey - 1) ELSE array(o_orderkey) END) AS id",
        "CASE o_orderkey % 11 WHEN 2 THEN array('q') WHEN 3 THEN array('q', ' ') WHEN 4 THEN array('q', 'q ') ELSE array('q1', 'q2') END AS questions",
        "CASE WHEN o_orderkey % 11 = 5 AND o_custkey % 2 = 1 THEN array('t') WHEN o_orderkey % 11 = 5 OR o_custkey % 2 = 1 THEN CAST(array() AS ARRAY<STRING>) WHEN o_orderkey % 11 = 6 THEN array('t', 't', 't', 't') ELSE array('t') END AS tables",
        "CASE WHEN o_custkey % 3 = 0 THEN array('i') ELSE CAST(array() AS ARRAY<STRING>) END AS images")
    return E.validate_enrichment(exp, p)


@query("t27_table_enrichment", """WITH l AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT id, CASE id % 9 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'ROWS' WHEN 3 THEN 'ROW_TEXT' WHEN 4 THEN 'SUMMARY' WHEN 5 THEN 'SUMMARY' WHEN 8 THEN 'ROWS' END AS reason FROM l) SELECT * FROM r WHERE reason IS NOT NULL""")
def t27b(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_rows"))
    rows = "transform(sequence(1, CAST(n_rows AS INT)), i -> named_struct('row', i, 'text', CASE WHEN id % 9 = 3 AND i = 1 THEN ' ' ELSE 'x' END))"
    p = t.where("id % 9 > 0").selectExpr(
        "id", "CASE WHEN id % 9 = 1 THEN 'LIST' WHEN id % 9 IN (4, 5, 6) THEN 'data' ELSE 'explanatory' END AS type",
        f"CASE WHEN id % 9 = 2 THEN array(named_struct('row', 99, 'text', 'x')) WHEN id % 9 IN (5, 6) THEN filter({rows}, r -> false) ELSE {rows} END AS rows",
        "CASE WHEN id % 9 IN (4, 6, 8) THEN 's' ELSE ' ' END AS summary")
    return E.validate_table_enrichment(t, p)


_ign = ", ".join(f"'{w}'" for w in E.IGNORED)


@query("t28_discriminators", f"""WITH x AS (SELECT doc_id, lower(source || ' ' || lang) AS sc, list_transform(list_concat(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.:/-]{{3,}}'), regexp_extract_all(text, '[“"]([^”"]{{2,40}})[”"]', 1)), lambda v: {S.trim('v')}) AS v FROM documents),
u AS (SELECT doc_id, sc, unnest(v) AS w, unnest(range(len(v))) AS i FROM x), d AS (SELECT doc_id, sc, w, min(i) AS i FROM u GROUP BY ALL),
k AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM d WHERE NOT contains(sc, lower(w)) AND lower(w) NOT IN ({_ign}))
SELECT doc_id, count(*) AS n, sha256(string_agg(w, chr(10) ORDER BY r)) AS terms_sha FROM k WHERE r <= 30 GROUP BY 1""")
def t28(spark, sf):
    d = docs_of(spark, sf).select("doc_id", F.col("text").alias("description"), F.col("source").alias("title"), F.col("lang").alias("section"))
    return E.discriminators(d).where(F.size("discriminators") > 0).select("doc_id", F.size("discriminators").alias("n"), sha(F.array_join("discriminators", "\n")).alias("terms_sha"))


def _prev(n: int) -> str:
    h = n * 5 // 8
    return f"CASE WHEN length(text) > {n} THEN left(text, {h}) || chr(10) || '[中间省略，仅作选择预览]' || chr(10) || right(text, {n - h}) ELSE text END"


@query("t30_adaptive_preview", f"""WITH p AS (SELECT doc_id, doc_id // 10 AS q, {_prev(1600)} AS p0, {_prev(800)} AS p1, {_prev(400)} AS p2, {_prev(200)} AS p3, {_prev(100)} AS p4 FROM documents),
s AS (SELECT q, CASE WHEN sum(strlen(p0)) <= 8000 THEN 1600 WHEN sum(strlen(p1)) <= 8000 THEN 800 WHEN sum(strlen(p2)) <= 8000 THEN 400 WHEN sum(strlen(p3)) <= 8000 THEN 200 WHEN sum(strlen(p4)) <= 8000 THEN 100 END AS runes FROM p GROUP BY 1)
SELECT doc_id, q AS query_id, runes::BIGINT AS runes, sha256(CASE runes WHEN 1600 THEN p0 WHEN 800 THEN p1 WHEN 400 THEN p2 WHEN 200 THEN p3 WHEN 100 THEN p4 END) AS preview_sha FROM p JOIN s USING (q)""")
def t30(spark, sf):
    c = docs_of(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 10).alias("query_id"), F.col("text").alias("content"))
    return E.adaptive_preview(c, max_bytes=8000).select("doc_id", "query_id", "runes", sha(F.col("preview")).alias("preview_sha"))


@query("t32_redact_json", """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN props WHEN event_id % 6 = 0 THEN '{"a":[{"z":1}],"k":"' || event_type || '","n":{"x":' || user_id || '}}' ELSE '{"k":2}' END AS props FROM events""")
def t32(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id", """CASE WHEN event_id % 3 > 0 THEN props WHEN event_id % 6 = 0 THEN '{"k": "' || event_type || '", "reasoning": "r", "n": {"reasoning_content": 2, "x": ' || user_id || '}, "a": [{"reasoning": {"q": 1}, "z": 1}]}'
        ELSE '{"reasoning_content": "x", "k": 2}' END AS props""")
    return E.redact_json(e, "props")


LITERALS = ["AKIA", "password", "@", "Copyright", "License", "BEGIN"]


@query("t33_scan_literals", "WITH h AS (SELECT source, " + " + ".join(f"contains(text, '{x}')::BIGINT" for x in LITERALS) + " AS n FROM documents) SELECT source, count(*) AS texts, sum(n)::BIGINT AS hits FROM h WHERE n > 0 GROUP BY 1")
def t33(spark, sf):
    return E.scan_literals(table(spark, sf, "documents"), "text", "source", LITERALS)


_ATTRS = {"session.id": "user_id", "llm.provider": "event_type", "input.value": "props", "llm.token_count.total": "event_id", "llm.prompts": "event_type"}


@query("t32_public_attributes", """SELECT event_id, 'llm.provider=' || event_type || ';llm.token_count.total=' || event_id || ';session.id=' || user_id AS attributes FROM events""")
def t32b(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.create_map(*[x for k, c in _ATTRS.items() for x in (F.lit(k), F.col(c).cast("string"))]).alias("attributes"))
    return E.public_attributes(e, "attributes").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("attributes"))
