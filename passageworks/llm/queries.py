"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from passageworks.llm import (
    centroids, chat, decontaminate, filter_audit, langid, piece_bpe, sharding, simhash, substring_dedup, suffix_dedup, token_count, topk_search, toxicity,
)
from passageworks.llm.base import crc, documents, query

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARD_BYTES = 32 << 20
AUDIT_BATCHES = 4  # micro-batches that the files present are dealt into


@query("op1_suffix_dedup")
def op1(spark, sf):
    return suffix_dedup.dedup(documents(spark, sf), keep_text=False).drop("row")


@query("op2_simhash")
def op2(spark, sf):
    g = simhash.near_groups(documents(spark, sf))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_language")
def op3(spark, sf):
    d = documents(spark, sf)
    held = crc("doc_id") % 3 == 1
    model = langid.train(d.where(~held).select("doc_id", "text", "lang"))
    return langid.identify(d.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


_HASH = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"


@query("op4_shards", f"""WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n, {_HASH} AS h FROM documents),
p AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n) AS b FROM d, range(0, 61) r(depth) GROUP BY ALL),
s AS (SELECT d.doc_id, d.h, p.depth, p.b, row_number() OVER (PARTITION BY d.doc_id ORDER BY p.depth) AS k FROM d JOIN p ON p.prefix = d.h >> (60 - p.depth) WHERE p.b <= {SHARD_BYTES} OR p.depth = 60)
SELECT doc_id, substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, CAST(b AS BIGINT) AS shard_bytes, b > {SHARD_BYTES} AS oversize FROM s WHERE k = 1""")
def op4(spark, sf):
    d = documents(spark, sf).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    return sharding.assign(d, SHARD_BYTES).select("doc_id", "shard", "shard_bytes", "oversize")


@query("op5_toxicity")
def op5(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    held = crc("doc_id") % 5 == 0
    model = toxicity.train(d.where(~held), spark.read.parquet(f"{sf}/labels.parquet").where(~held))
    out = toxicity.score_documents(d, model)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


@query("op6_pieces")
def op6(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    return piece_bpe.encode_decode(d, PIECES, ids=False, decoded=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_topk", """WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.row AS qrow, c.vec_id, c.row, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY qrow ORDER BY score DESC, vec_id, row) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20""")
def op7(spark, sf):
    return topk_search.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), 20, 20)


_TAG = r"replace(replace(replace(replace(role, '\', '\\'), ']', '\c'), '<', '\l'), chr(10), '\n')"
_CTRL = r"([<\[])(\\*)((?:/?s>)|(?:/?INST\]))"


@query("op8_chat", rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<s>[' || {_TAG} || ']' || CASE WHEN role = 'user' THEN '[INST] ' ELSE '' END || regexp_replace(text, '{_CTRL}', '\1\\\2\3', 'g') || CASE WHEN role = 'user' THEN ' [/INST]' ELSE '' END || '</s>' AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r)) AS turns_sha256,
coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(r)) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""")
def op8(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    r = chat.read_back(chat.format_conversations(c.unionByName(extra)))
    sha = lambda s: F.sha2(s.cast("binary"), 256)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                    sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op9_tokens")
def op9(spark, sf):
    d = documents(spark, sf).select("doc_id", "text")
    return token_count.count_tokens(d, PIECES).select("doc_id", "n_tokens")


_ITEM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontaminate", rf"""WITH b AS (SELECT item_id, row_number() OVER () AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, item, least(13, len(w)) AS k, w[s : s + least(13, len(w)) - 1] AS g FROM b, range(1, 100000) r(s) WHERE len(w) > 0 AND s <= greatest(len(w) - 12, 1)),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM win), wins AS (SELECT DISTINCT item_id, k, g FROM win),
g AS (SELECT row, k, s, w[s : s + k - 1] AS g FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT g.row, g.s, g.k, wins.item_id FROM g JOIN wins ON wins.k = g.k AND wins.g = g.g),
n AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + k)) AS p FROM h) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(xs, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (row) LEFT JOIN i USING (row)""")
def op10(spark, sf):
    c = decontaminate.contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_MASK = {f: 1 << n for n, f in enumerate(filter_audit.FILTERS)}
_LETTERS = "(VALUES " + ", ".join(f"('{f}', {b})" for f, b in _MASK.items()) + ")"


@query("op11_filter_audit", rf"""WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS m FROM w),
c AS (SELECT part, m, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM {_LETTERS} x(f, b)),
o AS (SELECT [a.b, b.b, c.b, d.b, e.b] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS past FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER ((m & (past | bit)) = 0) AS kept, sum(n) FILTER ((m & bit) <> 0 AND (m & past) = 0) AS removed,
  sum(n) FILTER ((m & bit) <> 0 AND (m & past) <> 0) AS redundant, sum(n) FILTER (m = bit) AS unique_fails,
  sum(n * good) FILTER ((m & bit) <> 0 AND (m & past) = 0) AS good_lost, sum(n * bad) FILTER ((m & bit) <> 0 AND (m & past) = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""")
def op11(spark, sf):
    stream = filter_audit.file_stream(spark, f"{sf}/documents.parquet", AUDIT_BATCHES)
    return filter_audit.audit(stream, spark.read.parquet(f"{sf}/labels.parquet"), filter_audit.buckets_for(documents(spark, sf)))


@query("op12_substring_dedup", rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, row, s, md5(array_to_string(w[s : s + 12], ' ')) AS h FROM (SELECT doc_id, row, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
x AS (SELECT row, list(DISTINCT p) AS gone FROM (SELECT row, unnest(range(s, s + 13)) AS p FROM g JOIN m USING (h) WHERE doc_id > least) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256 FROM d LEFT JOIN x USING (row)""")
def op12(spark, sf):
    return substring_dedup.dedup(documents(spark, sf), keep_text=False).drop("row")


_SQUARE = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _rounds(rounds: int) -> str:
    out = []
    for k in range(rounds):
        out.append(f"""a{k} AS MATERIALIZED (SELECT v.r, any_value(v.e) AS e, arg_min(c.k, ({_SQUARE}, c.k)) AS k FROM v, c{k} c GROUP BY v.r),
c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN (SELECT k, list({_FLOOR} ORDER BY p) AS e FROM
  (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(1, 65)) AS p FROM a{k}) GROUP BY k, p) GROUP BY k) m USING (k))""")
    return ",\n".join(out)


@query("op13_centroids", f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS INTEGER) AS k, e FROM v) WHERE k < 8),
{_rounds(10)},
z AS (SELECT r, any_value(vec_id) AS vec_id, CAST(arg_min(k, (d, k)) AS INTEGER) AS cluster, min(d) AS distance FROM (SELECT v.r, v.vec_id, c.k, {_SQUARE} AS d FROM v, c10 c) GROUP BY r)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM z JOIN c10 c ON c.k = z.cluster""")
def op13(spark, sf):
    return centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"), k=8, rounds=10, width=64)
