"""Registered queries of the text and fragment transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions import text as TX
from passageworks.operators import fragments as FR
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.sources.tables import spread, table

LIMIT = 2048  # fragment size of the registered queries; the library default is 12288


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"))


def marked_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headings, fences, tables, images and header lines, which the given texts lack."""

    def mark(x, i):
        n = i + 1
        return (
            F.when(n == 1, F.concat(F.lit("# "), x))
            .when(n % 23 == 10, "")
            .when((n % 11 == 7) | (n % 11 == 9), "```")
            .when(n % 11 == 8, F.concat(F.lit("# in fence "), x))
            .when(n % 11 == 4, F.concat(F.lit("## "), F.left(x, F.lit(40))))
            .when(n % 19 == 3, F.concat(F.lit("### "), F.left(x, F.lit(30))))
            .when((n % 13 == 5) | (n % 13 == 6),
                  F.concat(F.lit("| "), F.left(x, F.lit(20)), F.lit(" | "), F.length(x).cast("string"), F.lit(" |")))
            .when(n % 17 == 6, F.concat(F.lit("!["), F.left(x, F.lit(12)), F.lit("](https://img.example.com/"),
                                        (n % 5).cast("string"), F.lit(".png)")))
            .when(n % 29 == 11, F.concat(F.lit("来源："), F.left(x, F.lit(10))))
            .otherwise(x)
        )

    return docs_of(spark, sf).select(
        "doc_id", F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text")
    )


def marked_frags(spark: SparkSession, sf: str) -> DataFrame:
    return FR.fragments(marked_docs(spark, sf), LIMIT)


@query("t01_sections", f"""WITH {S.MARKED},{S.lines('marked')},{S.sections()}
SELECT doc_id, section_no, section, start_line, sha256(body) AS body_sha, strlen(body)::BIGINT AS body_bytes FROM sec""")
def t01(spark, sf):
    return FR.sections(marked_docs(spark, sf)).select(
        "doc_id", "section_no", "section", "start_line", TX.sha(F.col("body")).alias("body_sha"),
        F.octet_length("body").alias("body_bytes"))


@query("t02_pack_lines", f"""WITH {S.MARKED},{S.frags()}
SELECT doc_id, section_no, part, section, start_line, end_line, content_hash, fragment_id, strlen(content)::BIGINT AS bytes FROM frag""")
def t02(spark, sf):
    return marked_frags(spark, sf).select(
        "doc_id", "section_no", "part", "section", "start_line", "end_line", "content_hash", "fragment_id",
        F.octet_length("content").alias("bytes"))


@query("t04_supplied_fragments", f"""WITH {S.MARKED},{S.frags()},
sup AS (SELECT doc_id, section, start_line + (doc_id % 7 = 3)::BIGINT AS start_line, end_line,
   CASE WHEN doc_id % 7 = 1 THEN content || 'x' ELSE content END AS content, start_line AS ordinal FROM frag
   WHERE NOT (doc_id % 7 = 2 AND section_no % 2 = 1)),
ord AS (SELECT *, max(end_line) OVER (PARTITION BY doc_id ORDER BY ordinal, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end,
   count(*) OVER (PARTITION BY doc_id) AS n FROM sup),
chk AS (SELECT o.*, (SELECT {S.trim("string_agg(l.content, chr(10) ORDER BY l.line)")} FROM lines l
     WHERE l.doc_id = o.doc_id AND l.line BETWEEN o.start_line AND o.end_line) AS expected,
     (SELECT max(l.line) FROM lines l WHERE l.doc_id = o.doc_id) AS total FROM ord o),
per AS (SELECT doc_id, start_line AS line, CASE WHEN n > 4096 THEN 'TOO_MANY'
   WHEN {S.trim('section')} = '' OR strlen(section) > 512 OR start_line < 1 OR end_line < start_line OR end_line > total
        OR start_line <= coalesce(prev_end, 0) THEN 'RANGE'
   WHEN coalesce(expected, '') = '' OR content <> expected OR strlen(content) > 12288 THEN 'TEXT' END AS reason FROM chk),
om AS (SELECT l.doc_id, l.line, 'OMITTED' AS reason FROM lines l WHERE l.doc_id IN (SELECT doc_id FROM sup)
   AND {S.trim('l.content')} <> '' AND NOT regexp_matches({S.trim('l.content')}, '^(#|来源：|目录：|更新时间：)')
   AND NOT EXISTS (SELECT 1 FROM sup s WHERE s.doc_id = l.doc_id AND l.line BETWEEN s.start_line AND s.end_line))
SELECT doc_id, line::BIGINT AS line, reason FROM per WHERE reason IS NOT NULL UNION ALL SELECT doc_id, line::BIGINT, reason FROM om""")
def t04(spark, sf):
    docs = marked_docs(spark, sf)
    fr = FR.fragments(docs, LIMIT).where("NOT (doc_id % 7 = 2 AND section_no % 2 = 1)")
    sup = fr.select(
        "doc_id", "section", (F.col("start_line") + F.when(F.expr("doc_id % 7 = 3"), 1).otherwise(0)).alias("start_line"),
        "end_line", F.when(F.expr("doc_id % 7 = 1"), F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"),
        F.struct(F.col("start_line"), F.col("end_line")).alias("ordinal"))
    return FR.validate_fragments(docs, sup)


@query("t06_asset_flags", f"""WITH {S.MARKED},{S.frags()},
fl AS (SELECT fragment_id AS doc_id, content AS text FROM frag),{S.lines('fl', 'ln')},
fg AS (SELECT doc_id, bool_or(outside AND NOT starts_with({S.trim('content')}, '```') AND {S.TABLE_LINE}) AS has_table,
       bool_or(outside AND NOT starts_with({S.trim('content')}, '```') AND {S.IMAGE_LINE}) AS has_image FROM ln GROUP BY 1)
SELECT doc_id AS fragment_id, has_table, has_image FROM fg""")
def t06(spark, sf):
    return FR.asset_flags(marked_frags(spark, sf)).select("fragment_id", "has_table", "has_image")


BLOCKS = f"""{S.lines('marked')},
bk AS (SELECT *, CASE WHEN starts_with({S.trim('content')}, '```') OR NOT outside THEN 'code'
   WHEN {S.trim('content')} = '' THEN 'blank' WHEN regexp_matches({S.trim('content')}, '^(来源：|目录：|更新时间：)') THEN 'meta'
   WHEN regexp_matches(content, '^\\s*#{{1,6}}\\s+\\S') THEN 'heading' WHEN {S.TABLE_LINE} THEN 'table'
   WHEN regexp_matches(content, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' ELSE 'text' END AS raw FROM lines),
bo AS (SELECT *, last_value(CASE WHEN raw <> 'meta' THEN raw END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS owner FROM bk),
bd AS (SELECT *, CASE WHEN raw <> 'meta' THEN raw WHEN owner = 'text' THEN 'text' ELSE 'blank' END AS kind FROM bo),
bs AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN {S.trim("regexp_replace(content, '^\\s*#{1,6}\\s+', '')")} END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY line) AS section,
   (coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line), '-') <> kind OR kind IN ('image', 'heading')
     OR (starts_with({S.trim('content')}, '```') AND outside))::INT AS st FROM bd),
br AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM bs),
bg AS (SELECT doc_id, run, kind, min(section) AS section, min(line) AS start_line, string_agg(content, chr(10) ORDER BY line) AS body
   FROM br WHERE kind NOT IN ('blank', 'heading') GROUP BY ALL)"""


@query("t07_blocks", f"""WITH {S.MARKED},{BLOCKS},{S.pack('bg', 'pk', 1800, 'doc_id, run, kind, section', cut_long=False).replace('USING (doc_id, run, kind, section, start_line)', 'ON i.doc_id = f.doc_id AND i.run = f.run')}
SELECT doc_id, kind, coalesce(section, '') AS section, start_line, end_line, sha256(content) AS content_sha FROM pk""")
def t07(spark, sf):
    return FR.blocks(marked_docs(spark, sf)).select(
        "doc_id", "kind", "section", "start_line", "end_line", TX.sha(F.col("content")).alias("content_sha"))


@query("t08_greedy_batches", """WITH b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice::BIGINT % 9000) AS bytes,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
f AS (SELECT l_orderkey, list_reduce(list({'o': ord, 'b': bytes + 256} ORDER BY ord),
   lambda a, x: CASE WHEN a.no = 0 OR a.b + x.b > 12288 OR a.n >= 4
     THEN {'no': a.no + 1, 'n': 1::BIGINT, 'b': x.b, 'out': list_append(a.out, {'o': x.o, 'no': a.no + 1})}
     ELSE {'no': a.no, 'n': a.n + 1, 'b': a.b + x.b, 'out': list_append(a.out, {'o': x.o, 'no': a.no})} END,
   {'no': 0::BIGINT, 'n': 0::BIGINT, 'b': 0::BIGINT, 'out': []::STRUCT(o BIGINT, no BIGINT)[]}).out AS out FROM b GROUP BY 1),
u AS (SELECT l_orderkey, unnest(out) AS e FROM f)
SELECT l_orderkey, e.o AS ord, e.no AS batch_no, b.bytes + 256 AS batch_bytes FROM u JOIN b USING (l_orderkey) WHERE b.ord = e.o""")
def t08(spark, sf):
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem")
    items = li.select(
        "l_orderkey", (F.bround("l_extendedprice").cast("bigint") % 9000).alias("bytes"),
        F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("bigint").alias("ord"))
    return FR.greedy_batches(items, ["l_orderkey"], "ord", "bytes", 12288, 4, 256)


@query("t10_split_documents", f"""WITH s AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS t, unnest(range(0, len(regexp_split_to_array(text, '\\n{{2,}}')))) AS i FROM s WHERE strlen(text) > 4096),
c AS (SELECT doc_id, i, t, CASE WHEN strlen(t) <= 4096 THEN [0::BIGINT] ELSE list_reduce(
      list_transform(string_split(t, ''), lambda c: strlen(c)::BIGINT),
      lambda a, x: CASE WHEN a.b + x > 4096 THEN {{'b': x, 'k': a.k + 1, 'cuts': list_append(a.cuts, a.k)}}
                   ELSE {{'b': a.b + x, 'k': a.k + 1, 'cuts': a.cuts}} END,
      {{'b': 0::BIGINT, 'k': 0::BIGINT, 'cuts': [0::BIGINT]}}).cuts END AS cuts FROM p),
q AS (SELECT doc_id, i, unnest(list_transform(cuts, lambda c, j: substring(t, (c + 1)::BIGINT, coalesce(cuts[j + 1], length(t)) - c))) AS t,
      unnest(range(0, len(cuts))) AS j FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k FROM q),
f AS (SELECT doc_id, list_reduce(list(strlen(t)::BIGINT ORDER BY k), lambda a, x: CASE
      WHEN a.n > 0 AND a.b + 2 + x > 4096 THEN {{'n': 1::BIGINT, 'b': x, 'k': a.k + 1, 'cuts': list_append(a.cuts, a.k)}}
      WHEN a.n = 0 THEN {{'n': 1::BIGINT, 'b': x, 'k': a.k + 1, 'cuts': a.cuts}}
      ELSE {{'n': a.n + 1, 'b': a.b + 2 + x, 'k': a.k + 1, 'cuts': a.cuts}} END,
      {{'n': 0::BIGINT, 'b': 0::BIGINT, 'k': 0::BIGINT, 'cuts': [0::BIGINT]}}).cuts AS cuts FROM k GROUP BY 1),
g AS (SELECT k.doc_id, len(list_filter(f.cuts, lambda c: c <= k.k)) AS part, {S.trim("string_agg(t, chr(10) || chr(10) ORDER BY k.k)")} || chr(10) AS content
      FROM k JOIN f USING (doc_id) GROUP BY ALL),
u AS (SELECT doc_id, part, content FROM g UNION ALL SELECT doc_id, 1, text FROM s WHERE strlen(text) <= 4096),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts FROM u)
SELECT doc_id, part::BIGINT AS part, parts, CASE WHEN parts > 1 THEN '（第' || part || '/' || parts || '部分）' ELSE '' END AS suffix, sha256(content) AS content_sha FROM n""")
def t10(spark, sf):
    d = docs_of(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return FR.split_documents(d, 4096).select("doc_id", "part", "parts", "suffix", TX.sha(F.col("content")).alias("content_sha"))


@query("t13_line_owner", f"""WITH {S.MARKED},{S.frags()}
SELECT l.doc_id, l.line::BIGINT AS line, f.fragment_id FROM lines l LEFT JOIN frag f ON f.doc_id = l.doc_id AND l.line BETWEEN f.start_line AND f.end_line""")
def t13(spark, sf):
    docs = marked_docs(spark, sf)
    return FR.line_owner(FR.lines(docs), FR.fragments(docs, LIMIT)).select("doc_id", "line", "fragment_id")


@query("t14_asset_context", f"""WITH {S.MARKED},{S.lines('marked')},
a AS (SELECT doc_id, line AS at FROM lines WHERE {S.IMAGE_LINE}),
pl AS (SELECT doc_id, line, {S.trim('content')} AS c FROM lines WHERE {S.trim('content')} <> '' AND NOT ({S.TABLE_LINE}) AND NOT ({S.IMAGE_LINE})),
b AS (SELECT a.doc_id, a.at, p.line, p.c, row_number() OVER (PARTITION BY a.doc_id, a.at ORDER BY p.line DESC) AS rn
      FROM a JOIN pl p ON p.doc_id = a.doc_id AND p.line BETWEEN a.at - 4 AND a.at - 1),
f AS (SELECT a.doc_id, a.at, p.line, p.c, row_number() OVER (PARTITION BY a.doc_id, a.at ORDER BY p.line) AS rn
      FROM a JOIN pl p ON p.doc_id = a.doc_id AND p.line BETWEEN a.at + 1 AND a.at + 4)
SELECT a.doc_id, a.at::BIGINT AS line,
 coalesce((SELECT string_agg(c, ' ' ORDER BY line) FROM b WHERE b.doc_id = a.doc_id AND b.at = a.at AND rn <= 2), '') AS before,
 coalesce((SELECT string_agg(c, ' ' ORDER BY line) FROM f WHERE f.doc_id = a.doc_id AND f.at = a.at AND rn <= 2), '') AS after FROM a""")
def t14(spark, sf):
    ls = FR.lines(marked_docs(spark, sf))
    assets = ls.where(FR.is_image_line(F.col("content"))).select(
        "doc_id", F.col("line").alias("asset_id"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return FR.asset_context(assets, ls).select("doc_id", F.col("asset_id").alias("line"), "before", "after")


_IMG = r'!\[([^\]]*)\]\(([^ )]+)(?: "([^"]*)")?\)'


@query("t15_image_refs", f"""WITH {S.MARKED},{S.lines('marked')},
r AS (SELECT doc_id, line, unnest(regexp_extract_all(content, '{_IMG}', 0)) AS ref, unnest(range(1, len(regexp_extract_all(content, '{_IMG}', 0)) + 1)) AS position FROM lines)
SELECT doc_id, line::BIGINT AS line, position::BIGINT AS position, regexp_extract(ref, '{_IMG}', 1) AS alt, regexp_extract(ref, '{_IMG}', 2) AS url,
  regexp_extract(ref, '{_IMG}', 3) AS title, sha256(regexp_extract(ref, '{_IMG}', 2)) AS url_sha FROM r""")
def t15(spark, sf):
    return FR.image_refs(marked_docs(spark, sf))[0]


@query("t15_distinct_images", f"""WITH {S.MARKED},{S.lines('marked')},
r AS (SELECT unnest(regexp_extract_all(content, '{_IMG}', 2)) AS url FROM lines)
SELECT url, sha256(url) AS url_sha, count(*) AS uses FROM r GROUP BY ALL""")
def t15b(spark, sf):
    return FR.image_refs(marked_docs(spark, sf))[1]


@query("t17_retrieval_context", f"""WITH {S.MARKED},{S.frags()},
rp AS (SELECT fragment_id, start_line, unnest([
   {{'ordinal': 1, 'kind': 'QUESTION', 'text': 'q ' || section, 'at': 0}},
   {{'ordinal': 2, 'kind': 'TABLE', 'text': 't ' || length(content), 'at': end_line}},
   {{'ordinal': 3, 'kind': 'IMAGE', 'text': 'i ' || part, 'at': start_line}},
   {{'ordinal': 4, 'kind': 'TABLE_SUMMARY', 'text': 's ' || section_no, 'at': 0}}]) AS r FROM frag),
lb AS (SELECT fragment_id, start_line, r.ordinal, r.at, CASE r.kind WHEN 'IMAGE' THEN '[图片说明] ' WHEN 'TABLE_SUMMARY' THEN '[表格摘要] ' ELSE '[表格说明] ' END || r.text AS shown
   FROM rp WHERE r.kind <> 'QUESTION'),
cl AS (SELECT fragment_id, unnest(string_split(content, chr(10))) AS t, start_line + unnest(range(0, len(string_split(content, chr(10))))) AS at FROM frag),
al AS (SELECT fragment_id, cl.at AS pos, 0 AS o, t FROM cl UNION ALL
       SELECT lb.fragment_id, CASE WHEN lb.at = 0 THEN 1000000000 ELSE lb.at END, ordinal, shown FROM lb
       WHERE lb.at = 0 OR EXISTS (SELECT 1 FROM cl WHERE cl.fragment_id = lb.fragment_id AND cl.at = lb.at))
SELECT fragment_id, sha256(string_agg(t, chr(10) ORDER BY pos, o)) AS context_sha FROM al GROUP BY 1""")
def t17(spark, sf):
    fr = marked_frags(spark, sf)
    rep = lambda o, k, t, at: F.struct(F.lit(o).cast("bigint").alias("ordinal"), F.lit(k).alias("kind"), t.alias("text"), at.cast("bigint").alias("end_line"))
    reps = fr.select("fragment_id", F.inline(F.array(
        rep(1, "QUESTION", F.concat(F.lit("q "), "section"), F.lit(0)),
        rep(2, "TABLE", F.concat(F.lit("t "), F.length("content").cast("string")), F.col("end_line")),
        rep(3, "IMAGE", F.concat(F.lit("i "), F.col("part").cast("string")), F.col("start_line")),
        rep(4, "TABLE_SUMMARY", F.concat(F.lit("s "), F.col("section_no").cast("string")), F.lit(0)))))
    return FR.retrieval_context(fr, reps).select("fragment_id", TX.sha(F.col("context")).alias("context_sha"))


def _clean_sql(x: str) -> str:
    # The patterns of functions/text.py in SQL's dialect.
    for p, to in ((r"!\[([^\]]*)\]\([^)\n]*\)", r" 图片 \1 "), (r"\[([^\]]+)\]\([^)\n]*\)", r" \1 "), (r"https?://[^\s)>]+", " "),
                  (r"(?m)^\s*#{1,6}\s*", ""), (r"(?m)^\s*(?:[-+]\s+|[0-9]+[.)]\s+)", ""), (r"[|`*_~<>]", " "),
                  ("[" + TX.SPACE_CLASS + "]+", " ")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return S.trim(x)


@query("t18_clean_text", f"WITH {S.MARKED} SELECT doc_id, sha256({_clean_sql('text')}) AS clean_sha, length({_clean_sql('text')})::BIGINT AS n FROM marked")
def t18(spark, sf):
    c = TX.clean_text(F.col("text"))
    return marked_docs(spark, sf).select("doc_id", TX.sha(c).alias("clean_sha"), F.length(c).alias("n"))


@query("t19_token_windows", f"""WITH tk AS (SELECT doc_id AS id, text, regexp_extract_all(text, '\\S+\\s*') AS ts FROM documents),
w AS (SELECT id, text, ts, len(ts) AS n, unnest(range(0, 1 + CASE WHEN len(ts) <= 200 THEN 0 ELSE ceil((len(ts) - 200) / 136.0)::BIGINT END)) AS k FROM tk),
x AS (SELECT id, k, CASE WHEN n <= 200 THEN text ELSE {S.trim("array_to_string(ts[(k * 136 + 1):(k * 136 + 200)], '')")} END AS text,
   len(ts[(k * 136 + 1):(k * 136 + 200)]) AS n_tokens FROM w),
d AS (SELECT id, text, n_tokens, min(k) AS k FROM x GROUP BY ALL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS window_no, n_tokens::BIGINT AS n_tokens, sha256(text) AS text_sha,
  count(*) OVER (PARTITION BY id) > 64 AS over_limit FROM d""")
def t19(spark, sf):
    d = docs_of(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return FR.token_windows(d, budget=200, overlap=64).select("id", "window_no", "n_tokens", TX.sha(F.col("text")).alias("text_sha"), "over_limit")


_HDR = "'# t' || chr(10) || '来源：' || source || chr(10) || '目录：' || lang || ' > ' || source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## s' || chr(10) ELSE '' END || '更新时间：' || doc_id || chr(10) || text"


@query("t21_document_context", f"""SELECT doc_id, '目录：' || lang || ' > ' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '更新时间：' || doc_id END AS context FROM documents""")
def t21(spark, sf):
    d = docs_of(spark, sf)
    head = F.concat(F.lit("# t\n来源："), "source", F.lit("\n目录："), "lang", F.lit(" > "), "source", F.lit("\n"),
                    F.when(F.expr("doc_id % 3 = 0"), "## s\n").otherwise(""), F.lit("更新时间："), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    return FR.document_context(d.withColumn("text", head)).select("doc_id", "context")


LINKS_SQL = f"""hd AS (SELECT doc_id, line, length(regexp_extract(content, '^(#{{1,6}}) ', 1)) AS level FROM lines WHERE outside AND regexp_matches(content, '^#{{1,6}} ')),
fn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line, part) AS no FROM frag),
st AS (SELECT f.doc_id, f.fragment_id, h.line, row_number() OVER (PARTITION BY f.fragment_id ORDER BY h.line DESC) AS up
   FROM fn f JOIN hd h ON h.doc_id = f.doc_id AND h.line < f.start_line
   WHERE NOT EXISTS (SELECT 1 FROM hd g WHERE g.doc_id = f.doc_id AND g.line > h.line AND g.line < f.start_line AND g.level <= h.level)),
an AS (SELECT a.doc_id, a.fragment_id, a.up - 2 AS ordinal, a.line AS lo, b.line AS hi FROM st a JOIN st b ON b.fragment_id = a.fragment_id AND b.up = a.up - 1),
rl AS (SELECT an.doc_id, an.fragment_id, ordinal, arg_min(f.fragment_id, f.no) AS related FROM an JOIN fn f ON f.doc_id = an.doc_id AND f.start_line > lo AND f.start_line < hi GROUP BY ALL),
sb AS (SELECT doc_id, fragment_id, lag(fragment_id) OVER w AS p, lead(fragment_id) OVER w AS n FROM fn WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
lk AS (SELECT doc_id, fragment_id, related, ordinal::BIGINT AS ordinal FROM rl
UNION ALL SELECT doc_id, fragment_id, p, 100 FROM sb WHERE p IS NOT NULL UNION ALL SELECT doc_id, fragment_id, n, 101 FROM sb WHERE n IS NOT NULL)"""


@query("t22_section_links", f"WITH {S.MARKED},{S.frags()},{LINKS_SQL} SELECT * FROM lk")
def t22(spark, sf):
    docs = marked_docs(spark, sf)
    return FR.section_links(docs, FR.fragments(docs, LIMIT))


@query("t23_terms", f"""SELECT doc_id, len({S.terms('text')})::BIGINT AS n_terms, sha256(array_to_string(list_sort({S.terms('text')}), ' ')) AS terms_sha FROM documents""")
def t23(spark, sf):
    t = TX.terms(F.col("text"))
    return docs_of(spark, sf).select("doc_id", F.size(t).alias("n_terms"), TX.sha(F.array_join(F.array_sort(t), " ")).alias("terms_sha"))


@query("t24_norm", f"SELECT doc_id, sha256(regexp_replace(text, '[{TX.SPACE_CLASS}\\x{{1C}}-\\x{{1F}}\\\\]+', '', 'g')) AS norm_sha FROM documents")
def t24(spark, sf):
    return docs_of(spark, sf).select("doc_id", TX.sha(TX.norm(F.col("text"))).alias("norm_sha"))


@query("t25_locate_anchors", f"""WITH {S.MARKED},{S.lines('marked')},
a AS (SELECT doc_id, left(string_split(text, chr(10))[1 + len(string_split(text, chr(10))) // 2], 24) AS anchor FROM documents),
h AS (SELECT a.doc_id, a.anchor, min(l.line) AS start_line FROM a JOIN lines l ON l.doc_id = a.doc_id AND NOT starts_with(l.content, '#') AND contains(l.content, a.anchor) GROUP BY ALL)
SELECT h.doc_id, h.anchor, h.start_line::BIGINT AS start_line, h.start_line::BIGINT AS end_line,
  coalesce((SELECT {S.trim("ltrim(arg_max(g.content, g.line), '#')")} FROM lines g WHERE g.doc_id = h.doc_id AND g.line < h.start_line AND starts_with(g.content, '#')), '') AS section,
  sha256(l.content) AS quote_sha256 FROM h JOIN lines l ON l.doc_id = h.doc_id AND l.line = h.start_line""")
def t25(spark, sf):
    ls = F.split("text", "\n", -1)
    anchors = docs_of(spark, sf).select("doc_id", F.left(F.get(ls, F.floor(F.size(ls) / 2).cast("int")), F.lit(24)).alias("anchor"))
    return FR.locate_anchors(anchors, marked_docs(spark, sf)).select("doc_id", "anchor", "start_line", "end_line", "section", "quote_sha256")


@query("t29_length_audit", f"""WITH {S.MARKED},{S.frags()}, n AS (SELECT len(regexp_extract_all(content, '\\S+')) AS n FROM frag)
SELECT count(*) AS fragments, count(*) FILTER (n > 256) AS over_limit, max(n)::BIGINT AS max_tokens FROM n""")
def t29(spark, sf):
    return FR.length_audit(marked_frags(spark, sf), 256)
