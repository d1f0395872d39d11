"""Tables, assets, generated descriptions and their checks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.functions.text import SPACES, let, split_lines, strip
from passageworks.operators.fragments import blocks, is_table_line
from passageworks.operators.knowledge import first_reason


def end_plan(ends: DataFrame, blks: DataFrame) -> DataFrame:
    """T9. Chunk ends to ranges: clamped to the document's blocks, sorted, distinct, the last block added.
    ``ends(doc_id, ends ARRAY)`` to ``doc_id, chunk_no, start_block, end_block``."""
    b = blks.groupBy("doc_id").agg(F.min("block_id").alias("lo"), F.max("block_id").alias("hi"))
    j = ends.join(b, "doc_id")
    xs = F.array_sort(F.array_distinct(F.concat(F.transform("ends", lambda e: F.least(F.greatest(e, F.col("lo")), F.col("hi"))), F.array("hi"))))
    j = j.select("doc_id", "lo", xs.alias("xs")).select("doc_id", "lo", "xs", F.posexplode("xs").alias("i", "end_block"))
    return j.select("doc_id", (F.col("i") + 1).cast("bigint").alias("chunk_no"),
                    F.coalesce(F.get("xs", F.col("i") - 1) + 1, F.col("lo")).cast("bigint").alias("start_block"), F.col("end_block").cast("bigint").alias("end_block"))


def apply_boundaries(docs: DataFrame, blks: DataFrame, plan: DataFrame, max_bytes: int = 12288) -> tuple[DataFrame, DataFrame]:
    """T9. Chunks assembled from a boundary plan, and the plan's violations.

    ``blks(doc_id, block_id, start_line, end_line, section)``; the plan must cover a document's blocks
    without gap or overlap. Sections are joined in first-seen order; a chunk over ``max_bytes`` is cut
    before the block that passes it. Everything is per document, whose size is bounded."""
    w = W.partitionBy("doc_id").orderBy("start_block", "chunk_no")
    b = blks.groupBy("doc_id").agg(F.min("block_id").alias("lo"), F.max("block_id").alias("hi"), F.count("*").alias("n"))
    p = plan.join(b, "doc_id").withColumn("want", F.coalesce(F.lag("end_block").over(w) + 1, F.col("lo")))
    bad = p.select("doc_id", "chunk_no", first_reason(
        (F.col("start_block") != F.col("want"), "NOT_CONTIGUOUS"), (F.col("end_block") < F.col("start_block"), "EMPTY"), (F.col("end_block") > F.col("hi"), "UNKNOWN_BLOCK"),
    ).alias("reason")).where(F.col("reason").isNotNull())
    tail = p.groupBy("doc_id").agg(F.max("end_block").alias("e"), F.first("hi").alias("hi")).where("e < hi").select(
        "doc_id", F.lit(0).cast("bigint").alias("chunk_no"), F.lit("OMITS_BLOCKS").alias("reason"))
    good = plan.join(bad.select("doc_id").unionByName(tail.select("doc_id")).distinct(), "doc_id", "left_anti")
    ids = good.select("doc_id", "chunk_no", F.explode(F.sequence("start_block", "end_block")).alias("block_id"))
    bs = ids.join(blks, ["doc_id", "block_id"]).groupBy("doc_id", "chunk_no").agg(
        F.array_sort(F.collect_list(F.struct("block_id", "start_line", "end_line", "section"))).alias("bs"))
    j = bs.join(docs.select("doc_id", split_lines(F.col("text")).alias("ls")), "doc_id")
    body = lambda a, z: strip(F.array_join(F.slice("ls", a.cast("int"), (z - a + 1).cast("int")), "\n"))
    raw = lambda a, z: F.array_join(F.slice("ls", a.cast("int"), (z - a + 1).cast("int")), "\n")
    size, left, right = F.octet_length, lambda t: F.ltrim(t, F.lit(SPACES)), lambda t: F.rtrim(t, F.lit(SPACES))
    # i: blocks seen; end: the last one's end; bytes: of the part so far, without white space in front; kept: without that behind, too
    init = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("bytes"), F.lit(0).alias("kept"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, x: Column) -> Column:
        alone = lambda t: F.struct(size(left(t)).alias("bytes"), size(strip(t)).alias("kept"))
        # each line is joined once more only with its own block
        longer = lambda t: let(acc["bytes"] + 1 + size(t), lambda n: F.struct(
            n.alias("bytes"), F.when(right(t) == "", acc["kept"]).otherwise(n - size(t) + size(right(t))).alias("kept")))
        begin = let(raw(x["start_line"], x["end_line"]), alone)
        go_on = let(raw(acc["end"] + 1, x["end_line"]), longer)

        def put(n: Column) -> Column:
            over = (acc["i"] > 0) & (n["kept"] > max_bytes)
            now = F.when((acc["i"] == 0) | over, begin).otherwise(n)
            return let(now, lambda m: F.struct((acc["i"] + 1).alias("i"), x["end_line"].cast("bigint").alias("end"), m["bytes"].alias("bytes"), m["kept"].alias("kept"),
                                               F.when(over, F.concat(acc["cuts"], F.array(acc["i"]))).otherwise(acc["cuts"]).alias("cuts")))

        return let(go_on, put)

    j = j.withColumn("cuts", F.aggregate("bs", init, step, lambda a: a["cuts"]))
    part = j.select("doc_id", "chunk_no", "ls", F.posexplode(F.transform(
        "cuts", lambda c, i: F.slice("bs", c + 1, F.coalesce(F.get("cuts", i + 1), F.size("bs")) - c))).alias("part", "g"))
    a, z = F.col("g")[0]["start_line"], F.element_at("g", -1)["end_line"]
    chunks = part.select(
        "doc_id", "chunk_no", (F.col("part") + 1).cast("bigint").alias("part"), F.array_join(F.array_distinct(F.transform("g", lambda x: x["section"])), " / ").alias("section"),
        a.alias("start_line"), z.alias("end_line"), body(a, z).alias("content"))
    wrong = chunks.where((F.col("content") == "") | (F.octet_length("content") > max_bytes)).select("doc_id", "chunk_no", F.lit("OVERSIZE").alias("reason"))
    return chunks, bad.unionByName(tail).unionByName(wrong)


def cells(line: Column) -> Column:
    """T11. The cells of a Markdown table line; a backslash keeps the next character as it is."""
    v = strip(line)
    v = F.when(F.startswith(v, F.lit("|")), F.substr(v, F.lit(2))).otherwise(v)
    v = F.when(F.endswith(v, F.lit("|")), F.left(v, F.length(v) - 1)).otherwise(v)
    raw = F.regexp_extract_all(F.concat(F.lit("|"), v), F.lit(r"(?s)\|((?:\\.|[^|\\]|\\$)*)"), F.lit(1))
    return F.transform(raw, lambda c: strip(F.regexp_replace(c, r"(?s)\\(.)", "$1")))


def table_rows(docs: DataFrame) -> DataFrame:
    """T11. The data rows of every Markdown table: ``doc_id, table_line, headers, row, line, cells``.

    The second line is skipped if it is a separator; rows are padded or cut to the header's width."""
    t = blocks(docs, 2**31 - 1).where("kind = 'table'")
    all_cells = F.transform(F.split("content", "\n", -1), cells)
    t = t.select("doc_id", F.col("start_line").alias("table_line"), "section", all_cells.alias("cs"))
    head = F.col("cs")[0]
    sep = F.forall(F.coalesce(F.get("cs", F.lit(1)), F.array(F.lit(""))), lambda c: F.regexp_like(c, F.lit("^:?-{3,}:?$")))
    t = t.withColumn("skip", F.when(sep, 2).otherwise(1)).where(F.size("cs") > F.col("skip"))
    x = t.select("doc_id", "table_line", "section", head.alias("headers"), "skip", F.posexplode(F.slice("cs", F.col("skip") + 1, F.size("cs"))).alias("i", "c"))
    width = F.size("headers")
    padded = F.slice(F.concat("c", F.array_repeat(F.lit(""), F.greatest(width - F.size("c"), F.lit(0)))), F.lit(1), width)
    return x.select("doc_id", "table_line", "section", "headers", (F.col("i") + 1).cast("bigint").alias("row"),
                    (F.col("table_line") + F.col("skip") + F.col("i")).cast("bigint").alias("line"), padded.alias("cells"))


def split_tables(rows: DataFrame, owners: DataFrame, max_rows: int = 10, max_bytes: int = 6144) -> DataFrame:
    """T12. Table parts: a new one where the owning fragment changes, after ``max_rows`` rows, or before
    ``max_bytes`` of cells would be passed. A table is part of one document, so its fold is bounded."""
    size = F.octet_length(F.to_json("cells")) + F.size("cells") - 1
    j = rows.join(owners.select("doc_id", "line", "fragment_id"), ["doc_id", "line"], "left")
    g = j.groupBy("doc_id", "table_line").agg(F.array_sort(F.collect_list(F.struct("row", "line", "fragment_id", size.cast("bigint").alias("b")))).alias("xs"))
    init = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("b"), F.lit(None).cast("string").alias("f"), F.array().cast("array<bigint>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        new = (a["n"] == 0) | ~a["f"].eqNullSafe(x["fragment_id"]) | (a["n"] >= max_rows) | (a["b"] + x["b"] > max_bytes)
        return F.struct(F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, x["b"]).otherwise(a["b"] + x["b"]).alias("b"), x["fragment_id"].alias("f"),
                        F.when(new, F.concat(a["starts"], F.array(x["row"]))).otherwise(a["starts"]).alias("starts"))

    g = g.withColumn("starts", F.aggregate("xs", init, step, lambda a: a["starts"]))
    part = g.select("doc_id", "table_line", F.posexplode(F.transform("starts", lambda s, i: F.filter(
        "xs", lambda x: (x["row"] >= s) & (x["row"] < F.coalesce(F.get("starts", i + 1), F.lit(2**62)))))).alias("i", "p"))
    return part.select("doc_id", "table_line", (F.col("i") + 1).cast("bigint").alias("part"), F.col("p")[0]["fragment_id"].alias("fragment_id"),
                       F.col("p")[0]["line"].alias("start_line"), F.element_at("p", -1)["line"].alias("end_line"), F.size("p").cast("bigint").alias("rows"))


def attach_representations(frags: DataFrame, questions: DataFrame, assets: DataFrame, max_assets: int = 16) -> DataFrame:
    """T16. Fragments with their questions and asset descriptions, cut at source rows where they have
    more than ``max_assets`` descriptions; a table fragment without one gets a marker.

    Output: ``fragment_id, part, section, start_line, end_line, content, questions, assets``."""
    q = questions.groupBy("fragment_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("qs"))
    item = F.struct("start_line", "end_line", "kind", "text")
    s = assets.groupBy("fragment_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    none = F.array().cast("array<struct<start_line:bigint,end_line:bigint,kind:string,text:string>>")
    f = frags.join(q, "fragment_id", "left").join(s, "fragment_id", "left").withColumn("xs", F.coalesce("xs", none)).withColumn("ls", F.split("content", "\n", -1))
    tl = F.filter(F.transform("ls", lambda x, i: F.when(is_table_line(x), F.struct((F.col("start_line") + i).cast("bigint").alias("at"), x.alias("x")))), lambda x: x.isNotNull())
    f = f.withColumn("tl", tl)
    names = F.filter(cells(F.col("tl")[0]["x"]), lambda c: c != "")
    sep = F.forall(cells(F.col("tl")[0]["x"]), lambda c: F.regexp_like(c, F.lit("^:?-{3,}:?$")))
    # The sentences that describe a table without a description.
    marker = F.struct(F.col("tl")[0]["at"].alias("start_line"), F.element_at("tl", -1)["at"].alias("end_line"), F.lit("TABLE_SUMMARY").alias("kind"), F.when(
        sep, F.concat(F.lit("“"), "section", F.lit("”中的表格结构标记。"))).otherwise(F.concat(F.lit("“"), "section", F.lit("”中的表格包含列："), F.array_join(names, "、"), F.lit("。"))).alias("text"))
    bare = (F.size("tl") > 0) & ~F.exists("xs", lambda x: F.startswith(x["kind"], F.lit("TABLE")))
    f = f.withColumn("xs", F.when(bare, F.concat("xs", F.array(marker))).otherwise(F.col("xs")))
    span = lambda x: F.struct(x["start_line"].alias("a"), x["end_line"].alias("z"))
    ranges = F.transform(F.array_distinct(F.transform(F.array_sort("xs"), span)), lambda r: F.struct(
        r["a"].alias("a"), r["z"].alias("z"), F.size(F.filter("xs", lambda x: span(x) == r)).alias("c")))
    f = f.withColumn("rs", F.when(F.size("xs") > max_assets, ranges))
    init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array(F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("a"))).alias("ps"))

    def step(acc: Column, r: Column) -> Column:
        new = (acc["n"] > 0) & (acc["n"] + r["c"] > max_assets)
        return F.struct(F.when(new, r["c"]).otherwise(acc["n"] + r["c"]).alias("n"), (acc["i"] + 1).alias("i"),
                        F.when(new, F.concat(acc["ps"], F.array(F.struct(acc["i"].alias("g"), r["a"].alias("a"))))).otherwise(acc["ps"]).alias("ps"))

    f = f.withColumn("ps", F.aggregate(F.coalesce("rs", F.array().cast("array<struct<a:bigint,z:bigint,c:int>>")), init, step, lambda a: a["ps"]))
    part = f.select("*", F.posexplode("ps").alias("i", "p"))
    nxt = F.get("ps", F.col("i") + 1)
    lo = F.when(F.col("i") == 0, F.col("start_line")).otherwise(F.col("p.a"))
    hi = F.coalesce(nxt["a"] - 1, F.col("end_line"))
    mine = F.slice("rs", F.col("p.g") + 1, F.coalesce(nxt["g"], F.size("rs")) - F.col("p.g"))
    body = strip(F.array_join(F.slice("ls", (lo - F.col("start_line") + 1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int")), "\n"))
    split = F.col("rs").isNotNull()
    return part.select(
        "fragment_id", (F.col("i") + 1).cast("bigint").alias("part"),
        F.when(split, F.concat("section", F.lit("（资产分片"), (F.col("i") + 1).cast("string"), F.lit("）"))).otherwise(F.col("section")).alias("section"),
        lo.cast("bigint").alias("start_line"), hi.cast("bigint").alias("end_line"), F.when(split, body).otherwise(F.col("content")).alias("content"),
        F.transform(F.coalesce("qs", F.array().cast("array<struct<ordinal:bigint,text:string>>")), lambda x: x["text"]).alias("questions"),
        F.when(split, F.filter("xs", lambda x: F.exists(mine, lambda r: (r["a"] == x["start_line"]) & (r["z"] == x["end_line"])))).otherwise(F.col("xs")).alias("assets"))


def parse_rewrites(df: DataFrame, max_rewrites: int) -> tuple[DataFrame, DataFrame]:
    """T26. ``id, original, raw`` to the queries to run (the original first) and the ids whose output is
    invalid: fewer than two or more than ``max_rewrites`` new queries, or one that repeats the original."""
    only = F.coalesce(F.json_object_keys("raw") == F.array(F.lit("queries")), F.lit(False)) | F.coalesce(F.size(F.json_object_keys("raw")) == 0, F.lit(False))
    parsed = F.from_json("raw", "queries array<string>")["queries"]
    tagged = F.transform(F.filter(F.transform(F.split(F.replace("raw", F.lit("："), F.lit(":")), "\n", -1), strip),
                                  lambda x: F.startswith(F.upper(x), F.lit("QUERY:"))), lambda x: strip(F.substr(x, F.lit(7))))
    xs = F.transform(F.when(only, F.coalesce(parsed, F.array().cast("array<string>"))).otherwise(tagged), strip)
    # Fixed value: names that a model leaves in place of a query.
    ok = F.filter(xs, lambda x: (x != "") & (F.octet_length(x) <= 2000) & ~F.regexp_like(F.lower(x), F.lit(r"^(?:问题|query)\s*\d+$")))
    d = df.select("id", strip(F.col("original")).alias("original"), F.array_distinct(ok).alias("c"))
    bad = (F.size("c") < 2) | (F.size("c") > max_rewrites) | F.array_contains("c", F.col("original"))
    good = d.where(~bad).select("id", F.posexplode(F.concat(F.array("original"), "c")).alias("route", "query"))
    return good.withColumn("route", F.col("route").cast("bigint")), d.where(bad).select("id")


def _bad_text(x: Column, limit: int) -> Column:
    return F.coalesce((strip(x) == "") | (F.octet_length(x) > limit), F.lit(True))


def validate_enrichment(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """T27. ``expected(id, has_table, has_image)`` against ``produced(id, questions, tables, images)``."""
    n = produced.groupBy("id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("questions", "tables", "images")])
    j = expected.join(n, "id", "full")
    texts = F.concat("questions", "tables", "images")
    q = F.transform("questions", strip)
    reason = first_reason(
        (F.col("has_table").isNull(), "UNKNOWN_ID"), (F.col("n").isNull(), "MISSING"), (F.col("n") > 1, "REPEATED_ID"),
        ((F.size("questions") < 2) | (F.size("questions") > 5), "QUESTION_COUNT"), (F.exists(texts, lambda x: _bad_text(x, 4096)), "TEXT"),
        (F.size(F.array_distinct(q)) < F.size(q), "DUPLICATE_QUESTIONS"),
        ((F.col("has_table") != (F.size("tables") > 0)) | (F.col("has_image") != (F.size("images") > 0)), "ASSETS"),
        ((F.size("tables") > 3) | (F.size("images") > 3) | (F.size(texts) > 20), "TOO_MANY"))
    return j.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


def validate_table_enrichment(tables: DataFrame, produced: DataFrame) -> DataFrame:
    """T27. ``tables(id, n_rows)`` against ``produced(id, type, rows ARRAY<STRUCT<row, text>>, summary)``:
    explanatory tables need every row in order and no summary, data tables one summary and no rows."""
    n = produced.groupBy("id").agg(F.count("*").alias("n"), F.first(F.upper("type")).alias("type"), F.first("rows").alias("rows"), F.first("summary").alias("summary"))
    j = tables.join(n, "id", "full")
    full = F.transform("rows", lambda r: r["row"].cast("bigint")) == F.sequence(F.lit(1).cast("bigint"), F.col("n_rows").cast("bigint"))
    expl = F.col("type") == "EXPLANATORY"
    reason = first_reason(
        (F.col("n_rows").isNull(), "UNKNOWN_ID"), (F.col("n").isNull(), "MISSING"), (F.col("n") > 1, "REPEATED_ID"), (~F.col("type").isin("EXPLANATORY", "DATA"), "TYPE"),
        (expl & (~full | (strip(F.col("summary")) != "")), "ROWS"), (expl & F.exists("rows", lambda r: _bad_text(r["text"], 4096)), "ROW_TEXT"),
        (~expl & ((F.size("rows") > 0) | _bad_text(F.col("summary"), 8192)), "SUMMARY"))
    return j.select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


# Words that say nothing about one image; a corpus adds its own product names.
IGNORED = ("pod", "node", "service", "configmap", "deployment", "页面", "界面", "按钮", "截图", "配置", "操作", "步骤")


def discriminators(df: DataFrame, keep: int = 30, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """T28. Words and quoted phrases of ``description`` that neither title nor section has, first-seen order."""
    scope = F.concat(F.lower("title"), F.lit(" "), F.lower("section"))
    xs = F.concat(F.regexp_extract_all("description", F.lit(r"([A-Za-z][A-Za-z0-9_.:/-]{3,})"), F.lit(1)),
                  F.regexp_extract_all("description", F.lit(r"[“\"]([^”\"]{2,40})[”\"]"), F.lit(1)))
    ok = let(scope, lambda s: F.filter(F.array_distinct(F.transform(xs, strip)), lambda x: ~F.contains(s, F.lower(x)) & ~F.lower(x).isin(*ignored)))
    return df.withColumn("discriminators", F.slice(ok, 1, keep))


# Fixed value: what stands for the left-out middle of a preview.
CUT = "\n[中间省略，仅作选择预览]\n"


def adaptive_preview(cands: DataFrame, start: int = 1600, floor: int = 100, max_bytes: int = 262144, overhead: int = 0) -> DataFrame:
    """T30. Candidates of a query shortened to the largest of the halved sizes at which all of them fit
    the limit; ``runes`` is NULL (and the preview too) where even the smallest does not."""
    sizes = [start]
    while sizes[-1] > floor:
        sizes.append(sizes[-1] // 2)

    def preview(n: int) -> Column:
        head = n * 5 // 8
        return F.when(F.length("content") > n, F.concat(F.left("content", F.lit(head)), F.lit(CUT), F.right("content", F.lit(n - head)))).otherwise(F.col("content"))

    total = cands.groupBy("query_id").agg(*[F.sum(F.octet_length(preview(n)) + overhead).alias(f"b{n}") for n in sizes])
    pick = F.when(F.col(f"b{sizes[0]}") <= max_bytes, sizes[0])
    for n in sizes[1:]:
        pick = pick.when(F.col(f"b{n}") <= max_bytes, n)
    j = cands.join(total.select("query_id", pick.alias("runes")), "query_id")
    text = F.when(F.col("runes") == sizes[0], preview(sizes[0]))
    for n in sizes[1:]:
        text = text.when(F.col("runes") == n, preview(n))
    return j.withColumn("preview", text)


# Keys never exported, attributes that may be.
PRIVATE_KEYS = ("reasoning", "reasoning_content")
PUBLIC_ATTRIBUTES = ("openinference.span.kind", "session.id", "llm.model_name", "llm.provider", "llm.system", "llm.retry_count",
                     "llm.token_count.prompt", "llm.token_count.completion", "llm.token_count.total", "embedding.model_name")


def redact_json(df: DataFrame, col: str, drop_keys: tuple[str, ...] = PRIVATE_KEYS, max_bytes: int = 65536) -> DataFrame:
    """T32. JSON text without the private keys at any depth, or a marker where it is too long."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in sorted(v.items()) if k not in drop_keys}
        return [clean(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def strip_keys(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(clean(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return t

        return s.map(one)

    private = F.lit(False)
    for k in drop_keys:
        private = private | F.contains(col, F.lit(k))
    # Only texts that mention a private key are parsed.
    out = df.withColumn(col, F.when(private, strip_keys(F.when(private, F.col(col)))).otherwise(F.col(col)))
    return out.withColumn(col, F.when(F.octet_length(col) > max_bytes, '{"truncated":true}').otherwise(F.col(col)))


def public_attributes(df: DataFrame, col: str) -> DataFrame:
    """T32. A span's attribute map cut down to the public ones."""
    return df.withColumn(col, F.map_filter(col, lambda k, _v: k.isin(*PUBLIC_ATTRIBUTES)))


def scan_literals(df: DataFrame, col: str, source: str, literals: list[str]) -> DataFrame:
    """T33. How many texts of each source hold one of a few known literals; the literals are not output."""
    if not literals or any(not x for x in literals):
        raise ValueError("literals must not be empty")
    n = F.size(F.filter(F.array(*[F.lit(x) for x in literals]), lambda x: F.contains(F.col(col), x)))
    return df.select(source, n.alias("hits")).where("hits > 0").groupBy(source).agg(F.count("*").alias("texts"), F.sum("hits").alias("hits"))
