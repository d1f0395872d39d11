"""Registered queries of retrieval. Documents are fragments; benchmark passages are the queries;
a revision is published unless its label marks it toxic."""

from __future__ import annotations

from pyspark.sql import functions as F

from passageworks.functions import text as TX
from passageworks.functions.scale import neighbours
from passageworks.operators import fragments as FR
from passageworks.operators import representations as RP
from passageworks.operators import retrieval as R
from passageworks.operators import search as SE
from passageworks.operators import text_index as TI
from passageworks.operators import vector_index as VI
from passageworks.plans import text_sql as S
from passageworks.plans.registry import query
from passageworks.plans.text import LINKS_SQL, docs_of, marked_docs, marked_frags
from passageworks.sources.tables import spread, table


def passages(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def published(spark, sf):
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").join(toxic, "doc_id", "left_anti").select(
        F.col("doc_id").alias("revision_id"))


def corpus(spark, sf):
    return docs_of(spark, sf).select(
        F.col("doc_id").alias("fragment_id"), F.col("doc_id").alias("revision_id"), F.col("source").alias("title"),
        F.col("lang").alias("section"), F.col("text").alias("content"), TX.clean_text(F.col("text")).alias("retrieval_content"))


def lexical_text(c):
    return c.withColumn("text", F.concat_ws(" ", "title", "section", "content"))


def vectors(spark, sf):
    return spread(table(spark, sf, "embeddings"))


def query_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def ranked(score: str, src: str, by: str, k: int, digits: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {by}) AS rank FROM {src}) WHERE rank <= {k}"""


R1_SQL = f"""q AS (SELECT item_id AS query_id, unnest({S.terms('text')}) AS t FROM benchmark),
d AS (SELECT doc_id AS fragment_id, unnest({S.terms("source || ' ' || lang || ' ' || text")}) AS t FROM documents),
lx AS (SELECT query_id, fragment_id, count(*) AS score FROM q JOIN d USING (t) GROUP BY ALL)"""


@query("r01_lexical_topk", f"WITH {R1_SQL} {ranked('score', 'lx', 'fragment_id', 5)}")
def r01(spark, sf):
    return R.lexical_topk(passages(spark, sf), lexical_text(corpus(spark, sf)), 5)


@query("r01_lexical_topk_join", f"WITH {R1_SQL} {ranked('score', 'lx', 'fragment_id', 5)}")
def r01_join(spark, sf):
    """The same in several query blocks."""
    return R.lexical_topk(passages(spark, sf), lexical_text(corpus(spark, sf)), 5, block_rows=64)


_stop = ", ".join(f"'{w}'" for w in R.STOP_WORDS)


def _clean(x: str) -> str:
    from passageworks.plans.text import _clean_sql

    return _clean_sql(x)


BM25_SQL = f"""fl AS (SELECT doc_id AS fragment_id, 'retrieval_content' AS field, 2.0::DOUBLE AS boost, {_clean('text')} AS x FROM documents UNION ALL
  SELECT doc_id, 'content', 1, text FROM documents UNION ALL SELECT doc_id, 'section', 1, lang FROM documents UNION ALL SELECT doc_id, 'title', 1, source FROM documents),
tk AS (SELECT fragment_id, field, boost, list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: w NOT IN ({_stop})) AS ts FROM fl),
st AS (SELECT field, count(*)::DOUBLE AS n, avg(len(ts)) AS avg_len FROM tk GROUP BY 1),
po AS (SELECT fragment_id, field, boost, len(ts) AS size, unnest(ts) AS term FROM tk),
tf AS (SELECT fragment_id, field, boost, size, term, count(*)::DOUBLE AS tf FROM po GROUP BY ALL),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
qs AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: w NOT IN ({_stop}))) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM qs GROUP BY ALL),
sc AS (SELECT query_id, fragment_id, field, any_value(boost) * sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_len))) AS s
   FROM tf JOIN qt USING (term) JOIN df USING (field, term) JOIN st USING (field)
   WHERE fragment_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL),
bm AS (SELECT query_id, fragment_id, round(max(s), 6) AS score FROM sc GROUP BY ALL HAVING round(max(s), 6) > 0)"""


@query("r02_bm25_topk", f"WITH {BM25_SQL} {ranked('score', 'bm', 'fragment_id', 20)}")
def r02(spark, sf):
    """In one scan of the corpus a query block, for a corpus that is searched once."""
    return R.bm25_topk(passages(spark, sf), corpus(spark, sf), 20, eligible=published(spark, sf))


@query("r02_postings_topk", f"WITH {BM25_SQL} {ranked('score', 'bm', 'fragment_id', 20)}")
def r02_postings(spark, sf):
    """From stored postings, for a corpus that is searched again and again."""
    return TI.bm25(passages(spark, sf), TI.build(corpus(spark, sf)), 20, eligible=published(spark, sf))


DENSE_SQL = """dn AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, v.label AS label,
   round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v)"""


@query("r03_dense_topk", f"WITH {DENSE_SQL}, d AS (SELECT query_id, vec_id, score FROM dn) {ranked('score', 'd', 'vec_id', 20)}")
def r03(spark, sf):
    return R.dense_topk(query_vectors(spark, sf), vectors(spark, sf), 20)


CELLS, RECALL = 64, 0.95  # cells of the vector index, and the recall that sets how many are probed


def approximate(spark, sf):
    """The index, and the vectors whose id is divisible by 50 as queries with their found neighbours."""
    index = VI.build(vectors(spark, sf), CELLS)
    q = query_vectors(spark, sf).where("query_id % 50 = 0")
    return q, VI.search(q, index, VI.probes_for(index, RECALL), 20)


@query("r03_approximate_topk")
def r03_approximate(spark, sf):
    return approximate(spark, sf)[1]


@query("r03_approximate_recall", "SELECT count(*) AS queries, 20 * count(*) AS wanted, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def r03_recall(spark, sf):
    """Whether the approximate search finds at least 0.9 of the exact neighbours."""
    q, found = approximate(spark, sf)
    got = VI.recall(found, R.dense_topk(q, vectors(spark, sf), 20))
    return got.select("queries", "wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))


@query("r04_multivector_topk", f"""WITH {DENSE_SQL}, d AS (SELECT query_id, label::BIGINT AS label, max(score) AS score FROM dn GROUP BY ALL) {ranked('score', 'd', 'label', 5)}""")
def r04(spark, sf):
    return R.multivector_topk(query_vectors(spark, sf), vectors(spark, sf), "label", 5)


@query("r04_three_vectors", f"""WITH {DENSE_SQL}, d AS (SELECT query_id, vec_id // 3 AS fragment_id, max(score) AS score FROM dn GROUP BY ALL) {ranked('score', 'd', 'fragment_id', 20)}""")
def r04b(spark, sf):
    """Fragments of three vectors each."""
    v = vectors(spark, sf).withColumn("fragment_id", F.floor(F.col("vec_id") / 3))
    return R.multivector_topk(query_vectors(spark, sf), v, "fragment_id", 20)


@query("r05_embedding_text", f"SELECT doc_id, sha256(source || chr(10) || lang || chr(10) || {_clean('text')}) AS text_sha FROM documents")
def r05(spark, sf):
    c = corpus(spark, sf)
    return c.select(F.col("fragment_id").alias("doc_id"),
                    TX.sha(R.embedding_text(F.col("title"), F.col("section"), F.col("retrieval_content"))).alias("text_sha"))


@query("r05_refused_texts", "SELECT doc_id AS id, CASE WHEN length(text) > 0 THEN 'TOO_LONG' ELSE 'EMPTY' END AS reason FROM documents WHERE coalesce(length(text), 0) NOT BETWEEN 1 AND 32000")
def r05b(spark, sf):
    return R.refused_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def made_representations(spark, sf):
    """Documents as fragments, most of them longer than a window; a summary, a question and the question again for each."""
    fr = docs_of(spark, sf).select(F.col("doc_id").alias("fragment_id"), F.col("source").alias("title"), F.concat_ws(" / ", "lang", F.repeat("source", 30), "source").alias("section"), F.col("text").alias("content"))
    kinds = [(0, "SUMMARY", F.lower("content")), (1, "QUESTION", F.col("title")), (2, "QUESTION", F.col("title")), (3, "PASSAGE", F.col("content"))]
    reps = fr.select("fragment_id", F.inline(F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(k).alias("kind"), t.alias("text")) for n, k, t in kinds])))
    return fr, RP.representations(fr, reps, window_tokens=200)


def _bounded(x: str) -> str:
    p = f"string_split({x}, ' / ')"
    c = f"({p}[1] || ' / ... / ' || {p}[-1])"
    return f"CASE WHEN strlen({x}) <= 512 THEN {x} WHEN strlen({c}) <= 512 THEN {c} ELSE {S.trim(f'{c}[1:list_max(list_filter(range(0, length({c}) + 1), lambda n: strlen({c}[1:n]) <= 512))]')} END"


_SECTION = "lang || ' / ' || repeat(source, 30) || ' / ' || source"
REP_SQL = f"""f AS (SELECT doc_id AS id, text, source AS title, greatest(128, 200 - len(regexp_extract_all(source || chr(10) || {_bounded(_SECTION)} || chr(10), '\\S+'))) AS budget FROM documents),
r AS (SELECT id, 0 AS after, 0 AS pos, 'SUMMARY' AS kind, lower(text) AS text, budget, 32 AS o FROM f UNION ALL SELECT id, 0, 1, 'QUESTION', title, budget, 32 FROM f
  UNION ALL SELECT id, 1, 0, 'PASSAGE', text, budget, 64 FROM f),
t AS (SELECT *, regexp_extract_all(text, '\\S+\\s*') AS ts FROM r),
w AS (SELECT *, unnest(range(0, 1 + CASE WHEN len(ts) <= budget THEN 0 ELSE CAST(ceil((len(ts) - budget) / (budget - o)::DOUBLE) AS BIGINT) END)) AS k FROM t WHERE after = 0 OR len(ts) > budget),
x AS (SELECT id, after, pos, k, kind, CASE WHEN len(ts) <= budget THEN text ELSE {S.trim("array_to_string(ts[(k * (budget - o) + 1):(k * (budget - o) + budget)], '')")} END AS text FROM w),
u AS (SELECT id, kind, text, min(after * 1000000000 + pos * 1000000 + k) AS place FROM x GROUP BY ALL),
rp AS (SELECT id AS fragment_id, row_number() OVER (PARTITION BY id ORDER BY place, kind, text) AS ordinal, kind, text, count(*) OVER (PARTITION BY id) > 32 AS over_limit FROM u)"""


@query("t19_representations", f"WITH {REP_SQL} SELECT fragment_id, ordinal, kind, sha256(text) AS text_sha, over_limit FROM rp")
def t19_representations(spark, sf):
    return made_representations(spark, sf)[1].select("fragment_id", "ordinal", "kind", TX.sha(F.col("text")).alias("text_sha"), "over_limit")


@query("r04_bound_vectors", f"""WITH {REP_SQL} SELECT fragment_id, ordinal, kind, sha256(text) AS text_sha FROM rp UNION ALL
SELECT doc_id, 0, 'CONTENT', sha256(text) FROM documents WHERE doc_id NOT IN (SELECT fragment_id FROM rp WHERE kind = 'PASSAGE')""")
def r04_bound(spark, sf):
    return R.bound_vectors(*made_representations(spark, sf)).select("fragment_id", "ordinal", "kind", TX.sha(F.col("text")).alias("text_sha"))


_LONG = "CASE doc_id % 4 WHEN 0 THEN lang || ' / ' || text || ' / ' || source WHEN 1 THEN repeat('页é', 200) || ' / ' || source || ' / ' || lang WHEN 2 THEN source || ' / ' || repeat('a ', 300) ELSE lang END"


@query("t19_bounded_sections", f"SELECT doc_id, {_bounded('x')} AS section FROM (SELECT doc_id, {_LONG} AS x FROM documents)")
def t19_bounded(spark, sf):
    return docs_of(spark, sf).select("doc_id", FR.bounded_section(F.expr(_LONG)).alias("section"))


def two_routes(spark, sf):
    """Lexical and BM25 lists of the same queries."""
    a = R.lexical_topk(passages(spark, sf), lexical_text(corpus(spark, sf)), 20).select(
        "query_id", F.lit(0).alias("route"), "fragment_id", "rank")
    b = R.bm25_topk(passages(spark, sf), corpus(spark, sf), 20, eligible=published(spark, sf)).select(
        "query_id", F.lit(1).alias("route"), "fragment_id", "rank")
    return a.unionByName(b)


ROUTES_SQL = f"""{R1_SQL},{BM25_SQL},
l1 AS ({ranked('score', 'lx', 'fragment_id', 20)}), l2 AS ({ranked('score', 'bm', 'fragment_id', 20)}),
ro AS (SELECT query_id, 0 AS route, fragment_id, rank FROM l1 UNION ALL SELECT query_id, 1, fragment_id, rank FROM l2)"""


@query("r06_rrf", f"""WITH {ROUTES_SQL}, s AS (SELECT query_id, fragment_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM ro GROUP BY ALL)
{ranked('score', 's', 'fragment_id', 5)}""")
def r06(spark, sf):
    return R.rrf(two_routes(spark, sf), 60, 5)


@query("r07_fuse_queries", f"""WITH {DENSE_SQL}, d AS (SELECT query_id, vec_id, score FROM dn), t AS ({ranked('score', 'd', 'vec_id', 20)}),
r AS (SELECT query_id // 4 AS query_id, query_id % 4 AS route, vec_id // 3 AS id, min(rank) AS rank FROM t GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(CASE WHEN route = 0 THEN 2.0::DOUBLE ELSE 1 END / (1 + rank)), 12) AS score FROM r GROUP BY ALL)
{ranked('score', 's', 'id', 20)}""")
def r07(spark, sf):
    t = R.dense_topk(query_vectors(spark, sf), vectors(spark, sf), 20)
    routes = t.select(F.floor(F.col("query_id") / 4).alias("query_id"), (F.col("query_id") % 4).alias("route"),
                      F.floor(F.col("vec_id") / 3).alias("id"), "rank")
    return R.fuse_queries(routes, 20, by="id")


HITS_SQL = f"""{BM25_SQL}, h AS ({ranked('score', 'bm', 'fragment_id', 20)}),
hb AS (SELECT h.query_id, h.fragment_id, h.rank, strlen(d.text)::BIGINT AS bytes, sha256(d.text) AS source_hash, d.lang, d.source
  FROM h JOIN documents d ON d.doc_id = h.fragment_id)"""


def bm25_hits(spark, sf):
    h = R.bm25_topk(passages(spark, sf), corpus(spark, sf), 20, eligible=published(spark, sf))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("fragment_id"), F.octet_length("text").alias("bytes"),
                                             TX.sha(F.col("text")).alias("source_hash"))
    return h.select("query_id", "fragment_id", "rank").join(d, "fragment_id")


def verify_parts(spark, sf):
    h = bm25_hits(spark, sf).withColumn(
        "content_hash", F.when(F.col("fragment_id") % 7 == 3, F.concat("source_hash", F.lit("x"))).otherwise(F.col("source_hash")))
    twice = h.unionByName(h.withColumn("rank", F.col("rank") + 20))
    fr = table(spark, sf, "documents").select(F.col("doc_id").alias("fragment_id"), F.col("doc_id").alias("revision_id"),
                                              TX.sha(F.col("text")).alias("content_hash"))
    elig = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("revision_id"))
    return R.verify_hits(twice.drop("bytes", "source_hash"), fr, elig)


@query("r09_verified_hits", f"""WITH {HITS_SQL} SELECT query_id, fragment_id, fragment_id AS revision_id, rank FROM hb
WHERE fragment_id % 7 <> 3 AND fragment_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def r09(spark, sf):
    return verify_parts(spark, sf)[0]


@query("r09_changed_hits", f"""WITH {HITS_SQL} SELECT query_id, fragment_id, rank + x AS rank FROM hb, (VALUES (0), (20)) t(x)
WHERE fragment_id % 7 = 3 AND fragment_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def r09b(spark, sf):
    return verify_parts(spark, sf)[1]


@query("r10_pack_budget", f"""WITH {HITS_SQL},
f AS (SELECT query_id, list_reduce(list({{'r': rank, 'id': fragment_id, 'b': bytes}} ORDER BY rank),
   lambda a, x: CASE WHEN a.b + x.b <= 12000 AND len(a.o) < 5 THEN {{'b': a.b + x.b, 'o': list_append(a.o, x)}} ELSE a END,
   {{'b': 0::BIGINT, 'o': []::STRUCT(r BIGINT, id BIGINT, b BIGINT)[]}}).o AS o FROM hb GROUP BY 1),
u AS (SELECT query_id, unnest(o) AS e, unnest(range(1, len(o) + 1)) AS position FROM f)
SELECT query_id, e.id AS fragment_id, e.r AS rank, position, e.b AS bytes FROM u""")
def r10(spark, sf):
    return R.pack_budget(bm25_hits(spark, sf), 12000, 5)


def neighbour_links(spark, sf):
    """The previous and next document of the same source count as its siblings."""
    d = neighbours(table(spark, sf, "documents"), ["source"], "doc_id", "p", "n")
    return d.select(F.col("doc_id").alias("fragment_id"), F.posexplode(F.array("p", "n")).alias("ordinal", "related")).where("related IS NOT NULL")


@query("r11_expand_neighbours", f"""WITH {HITS_SQL},
sb AS (SELECT doc_id, lag(doc_id) OVER w AS p, lead(doc_id) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
lk AS (SELECT doc_id AS fragment_id, 0 AS o, p AS related FROM sb UNION ALL SELECT doc_id, 1, n FROM sb),
cd AS (SELECT hb.query_id, lk.related AS fragment_id, min(hb.rank * 10 + lk.o) AS o FROM hb JOIN lk USING (fragment_id)
   WHERE hb.rank <= 8 AND lk.related IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hb x WHERE x.query_id = hb.query_id AND x.fragment_id = lk.related) GROUP BY ALL)
SELECT query_id, fragment_id, extra, o // 10 AS root_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS extra FROM cd) WHERE extra <= 8""")
def r11(spark, sf):
    return R.expand_neighbours(bm25_hits(spark, sf), neighbour_links(spark, sf))


def selection_parts(spark, sf):
    h = bm25_hits(spark, sf)
    sel = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fragment_id"))).alias("xs")).select(
        "query_id",
        F.when(F.col("query_id") % 5 == 0, F.transform("xs", lambda x: x["fragment_id"]))
        .when(F.col("query_id") % 5 == 1, F.transform(F.slice("xs", 1, 3), lambda x: x["fragment_id"] * 0 + F.col("xs")[0]["fragment_id"]))
        .when(F.col("query_id") % 5 == 2, F.array(F.lit(-1).cast("bigint")))
        .when(F.col("query_id") % 5 == 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.reverse(F.slice("xs", 1, 6)), lambda x: x["fragment_id"])).alias("ids"))
    return R.apply_selection(sel, h, 8, 12000)


_R12_SQL = f"""WITH {HITS_SQL}, n AS (SELECT query_id, count(*) AS n FROM hb GROUP BY 1),
ch AS (SELECT query_id, fragment_id, bytes, CASE WHEN query_id % 5 = 4 THEN 1 + least(n, 6) - rank ELSE rank END AS pos FROM hb JOIN n USING (query_id)
  WHERE (query_id % 5 = 0 AND n <= 8) OR (query_id % 5 = 1 AND n = 1) OR (query_id % 5 = 4 AND rank <= 6)),
f AS (SELECT query_id, list_reduce(list({{'r': pos, 'id': fragment_id, 'b': bytes}} ORDER BY pos),
   lambda a, x: CASE WHEN a.b + x.b <= 12000 AND len(a.o) < 8 THEN {{'b': a.b + x.b, 'o': list_append(a.o, x)}} ELSE a END,
   {{'b': 0::BIGINT, 'o': []::STRUCT(r BIGINT, id BIGINT, b BIGINT)[]}}).o AS o FROM ch GROUP BY 1),
u AS (SELECT query_id, unnest(o) AS e, unnest(range(1, len(o) + 1)) AS position FROM f)
SELECT query_id, e.id AS fragment_id, e.r AS rank, position, e.b AS bytes FROM u"""


@query("r12_refused_selections", f"""WITH {HITS_SQL}, n AS (SELECT query_id, count(*) AS n FROM hb GROUP BY 1)
SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'TOO_MANY' WHEN 1 THEN 'REPEATED' WHEN 2 THEN 'UNKNOWN_ID' ELSE 'EMPTY' END AS reason FROM n
WHERE (query_id % 5 = 0 AND n > 8) OR (query_id % 5 = 1 AND n > 1) OR query_id % 5 IN (2, 3)""")
def r12b(spark, sf):
    return selection_parts(spark, sf)[1]


@query("r12_apply_selection", _R12_SQL)
def r12(spark, sf):
    return selection_parts(spark, sf)[0]


@query("r13_citations", f"""WITH {HITS_SQL} SELECT query_id, rank, fragment_id AS document_id, fragment_id AS revision_id, fragment_id, source AS title, source, lang AS section,
  source_hash AS content_hash, '/v1/knowledge/revisions/' || fragment_id || '/fragments/' || fragment_id AS url,
  CASE WHEN fragment_id % 2 = 0 THEN 'snap-' || fragment_id ELSE '' END AS device_snapshot_id FROM hb""")
def r13(spark, sf):
    d = table(spark, sf, "documents")
    fr = d.select(F.col("doc_id").alias("fragment_id"), F.col("doc_id").alias("revision_id"), F.col("lang").alias("section"),
                  TX.sha(F.col("text")).alias("content_hash"))
    revs = d.select(F.col("doc_id").alias("revision_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), "source",
                    F.when(F.col("doc_id") % 2 == 0, "DEVICE").otherwise("GENERAL").alias("scope"),
                    F.concat(F.lit("snap-"), F.col("doc_id").cast("string")).alias("snapshot_id"))
    return R.citations(bm25_hits(spark, sf).select("query_id", "fragment_id", "rank"), fr, revs)


@query("search_passages", f"""WITH {S.frags('documents', 12288)},
q AS (SELECT item_id AS query_id, unnest({S.terms('text')}) AS t FROM benchmark),
d AS (SELECT fragment_id, unnest({S.terms("section || ' ' || content")}) AS t FROM frag),
lx AS (SELECT query_id, fragment_id, count(*) AS score FROM q JOIN d USING (t) GROUP BY ALL), tk AS ({ranked('score', 'lx', 'fragment_id', 5)})
SELECT tk.query_id, tk.rank, tk.score, tk.fragment_id, f.doc_id, contains(regexp_replace(f.content, '[{TX.SPACE_CLASS}\\\\]+', '', 'g'),
   regexp_replace(b.text, '[{TX.SPACE_CLASS}\\\\]+', '', 'g')) AS contains_passage
FROM tk JOIN frag f USING (fragment_id) JOIN benchmark b ON b.item_id = tk.query_id""")
def search_passages(spark, sf):
    """For each benchmark passage the five best fragments and whether one contains it."""
    fr = FR.fragments(docs_of(spark, sf)).select("fragment_id", "doc_id", "section", "content")
    hits = R.lexical_topk(passages(spark, sf), fr.select("fragment_id", F.concat_ws(" ", "section", "content").alias("text")), 5)
    q = passages(spark, sf).withColumnRenamed("text", "passage")
    j = fr.join(hits, "fragment_id").join(q, "query_id")
    return j.select("query_id", "rank", "score", "fragment_id", "doc_id",
                    F.contains(TX.norm(F.col("content")), TX.norm(F.col("passage"))).alias("contains_passage"))


def section_library(spark, sf):
    """Sections of the marked documents as fragments, by word and vector; a document's first section has its vector, and
    some sections have changed since they were indexed."""
    docs = marked_docs(spark, sf)
    fr = TI.keep(marked_frags(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "sections")
    first = fr.groupBy("doc_id").agg(F.min_by("fragment_id", F.struct("start_line", "part")).alias("fragment_id"))
    vecs = table(spark, sf, "embeddings").join(first, F.col("vec_id") == F.col("doc_id")).select("fragment_id", "embedding")
    words = TI.build(fr.select("fragment_id", F.col("doc_id").alias("revision_id"), F.col("source").alias("title"), "section", "content", F.lower("content").alias("retrieval_content")))
    d = table(spark, sf, "documents")
    revs = d.select(F.col("doc_id").alias("revision_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), "source", F.lit("GENERAL").alias("scope"),
                    F.lit("").alias("snapshot_id"), F.concat("lang", F.lit(" > "), "source").alias("document_context"))
    own = fr.select("fragment_id", F.col("doc_id").alias("revision_id"), "section", "content_hash", F.octet_length("content").alias("context_bytes"))
    old = fr.select("fragment_id", F.when(F.col("doc_id") % 7 == 3, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    return SE.Library(own, revs, old, FR.section_links(docs, fr), words=words, embeddings=vecs)


def hybrid(spark, sf, candidates, top_k=5, max_bytes=2000):
    q = passages(spark, sf).join(query_vectors(spark, sf), "query_id", "left")
    return SE.search(q, section_library(spark, sf), published(spark, sf), top_k=top_k, max_bytes=max_bytes, candidates=candidates)


HYBRID_SQL = f"""{S.MARKED},{S.frags()},{LINKS_SQL},
fl AS (SELECT fragment_id, doc_id, 'r' AS field, 2.0::DOUBLE AS boost, lower(content) AS x FROM frag UNION ALL SELECT fragment_id, doc_id, 'c', 1, content FROM frag
  UNION ALL SELECT fragment_id, doc_id, 's', 1, section FROM frag UNION ALL SELECT fragment_id, doc_id, 't', 1, source FROM frag JOIN documents USING (doc_id)),
tk AS (SELECT fragment_id, doc_id, field, boost, list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: w NOT IN ({_stop})) AS ts FROM fl),
st2 AS (SELECT field, count(*)::DOUBLE AS n, avg(len(ts)) AS avg_len FROM tk GROUP BY 1),
tf AS (SELECT fragment_id, doc_id, field, boost, size, term, count(*)::DOUBLE AS tf FROM (SELECT fragment_id, doc_id, field, boost, len(ts) AS size, unnest(ts) AS term FROM tk) GROUP BY ALL),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: w NOT IN ({_stop}))) AS term FROM benchmark) GROUP BY ALL),
ok AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
sc AS (SELECT query_id, fragment_id, field, any_value(boost) * sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg_len))) AS s
   FROM tf JOIN qt USING (term) JOIN df USING (field, term) JOIN st2 USING (field) WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY ALL),
bm AS (SELECT query_id, fragment_id, round(max(s), 6) AS score FROM sc GROUP BY ALL HAVING round(max(s), 6) > 0),
ve AS (SELECT fn.fragment_id, e.embedding FROM fn JOIN embeddings e ON e.vec_id = fn.doc_id WHERE fn.no = 1 AND fn.doc_id IN (SELECT doc_id FROM ok)),
dn AS (SELECT b.item_id AS query_id, ve.fragment_id, round(list_cosine_similarity(q.embedding::DOUBLE[], ve.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, ve)"""


def _hybrid_sql(route_k: int, k: int) -> str:
    return f"""{HYBRID_SQL}, l1 AS ({ranked('score', 'bm', 'fragment_id', route_k)}), l2 AS ({ranked('score', 'dn', 'fragment_id', route_k)}),
rr AS (SELECT query_id, fragment_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, fragment_id, rank FROM l1 UNION ALL SELECT query_id, fragment_id, rank FROM l2) GROUP BY ALL),
fu AS ({ranked('score', 'rr', 'fragment_id', k)}),
fb AS (SELECT f.fragment_id, f.doc_id, f.section, f.content_hash, d.source, strlen(f.content) + strlen(d.lang || ' > ' || d.source) AS bytes FROM frag f JOIN documents d USING (doc_id)),
hb AS (SELECT fu.query_id, fu.fragment_id, fu.rank, bytes FROM fu JOIN fb USING (fragment_id) WHERE doc_id % 7 <> 3)"""


_CITED = """SELECT p.query_id, p.position, p.fragment_id, fb.doc_id AS document_id, fb.doc_id AS revision_id, fb.source AS title, fb.source, fb.section, fb.content_hash,
  '/v1/knowledge/revisions/' || fb.doc_id || '/fragments/' || p.fragment_id AS url, '' AS device_snapshot_id, p.bytes, fu.score, p.expanded
FROM placed p JOIN fb USING (fragment_id) LEFT JOIN fu ON fu.query_id = p.query_id AND fu.fragment_id = p.fragment_id"""


@query("search_hybrid", f"""WITH {_hybrid_sql(20, 5)},
f AS (SELECT query_id, list_reduce(list({{'r': rank, 'id': fragment_id, 'b': bytes}} ORDER BY rank),
   lambda a, x: CASE WHEN a.b + x.b <= 2000 AND len(a.o) < 5 THEN {{'b': a.b + x.b, 'o': list_append(a.o, x)}} ELSE a END,
   {{'b': 0::BIGINT, 'o': []::STRUCT(r BIGINT, id VARCHAR, b BIGINT)[]}}).o AS o FROM hb GROUP BY 1),
placed AS (SELECT query_id, e.id AS fragment_id, position, e.b AS bytes, false AS expanded FROM (SELECT query_id, unnest(o) AS e, unnest(range(1, len(o) + 1)) AS position FROM f))
{_CITED}""")
def search_hybrid(spark, sf):
    """Words and vectors fused, verified, packed with the document's context, cited."""
    return hybrid(spark, sf, False)[0]


@query("search_candidates", f"""WITH {_hybrid_sql(40, 40)},
hp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM hb),
cd AS (SELECT hp.query_id, lk.related AS fragment_id, min(hp.rank * 1000 + lk.ordinal) AS o FROM hp JOIN lk USING (fragment_id)
  WHERE hp.position <= 8 AND NOT EXISTS (SELECT 1 FROM hb x WHERE x.query_id = hp.query_id AND x.fragment_id = lk.related) GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS extra FROM cd QUALIFY extra <= 8),
placed AS (SELECT query_id, fragment_id, position, bytes, false AS expanded FROM hp UNION ALL
  SELECT ex.query_id, ex.fragment_id, (SELECT count(*) FROM hb WHERE hb.query_id = ex.query_id) + extra, fb.bytes, true FROM ex JOIN fb USING (fragment_id))
{_CITED}""")
def search_candidates(spark, sf):
    """Forty hits and what their sections add: first fragments under their ancestors, then neighbours."""
    return hybrid(spark, sf, True)[0]


@query("search_gaps", f"""WITH {_hybrid_sql(20, 1)}, g AS (SELECT item_id AS query_id, (SELECT count(*) FROM hb WHERE hb.query_id = item_id) AS good, (SELECT count(*) FROM hb WHERE hb.query_id = item_id AND bytes <= 200) AS fit,
  (SELECT count(*) FROM fu WHERE fu.query_id = item_id) AS hits FROM benchmark)
SELECT query_id, CASE WHEN good > 0 THEN 'OVER_BUDGET' WHEN hits > 0 THEN 'CHANGED_SOURCE' ELSE 'NO_RETRIEVAL_HIT' END AS reason FROM g WHERE fit = 0""")
def search_gaps(spark, sf):
    """The best hit alone, and little room for it."""
    return hybrid(spark, sf, False, 1, 200)[1]
