"""Documents to sections, fragments, blocks and their checks.

A document is one row, so everything that only needs its own document is computed from the
row's line array without any shuffle; windows are used only where rows really come from
different inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.functions.text import FENCE, cut_bytes, fragment_key, let, sha, split_lines, strip

BODY = "正文"


def lines(docs: DataFrame) -> DataFrame:
    """One row per source line: ``doc_id, line (1-based), content``. Narrow."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("pos", "content")).select(
        "doc_id", (F.col("pos") + 1).alias("line"), "content"
    )


def _positions(flags: Column) -> Column:
    """0-based indexes of the true entries."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def fences(line_array: Column) -> Column:
    return _positions(F.transform(line_array, lambda x: F.startswith(strip(x), F.lit(FENCE))))


def outside(fence_pos: Column, i: Column) -> Column:
    """True where an even number of fence lines precedes index ``i``."""
    return F.size(F.filter(fence_pos, lambda p: p < i)) % 2 == 0


def sections(docs: DataFrame) -> DataFrame:
    """T1. One row per section: ``doc_id, section_no, section, start_line, body``.

    A heading is a line that starts with ``#`` and contains a space, outside code fences.
    ``body`` is the section text with outer white space removed; blank sections are left out.
    """

    def build(ls: Column, heads: Column) -> Column:
        def one(k: Column) -> Column:
            from_ = F.when(k == 0, 0).otherwise(F.get(heads, k - 1) + 1)
            to = F.coalesce(F.get(heads, k), F.size(ls))
            name = F.when(k == 0, F.lit(BODY)).otherwise(
                strip(F.ltrim(F.get(ls, F.get(heads, k - 1)), F.lit("#")))
            )
            return F.struct(
                k.cast("bigint").alias("section_no"),
                name.alias("section"),
                (from_ + 1).cast("bigint").alias("start_line"),
                strip(F.array_join(F.slice(ls, from_ + 1, to - from_), "\n")).alias("body"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(heads)), one)

    def heads(ls: Column, fp: Column) -> Column:
        return _positions(
            F.transform(
                ls, lambda x, i: F.startswith(x, F.lit("#")) & F.contains(x, F.lit(" ")) & outside(fp, i)
            )
        )

    arr = let(
        split_lines(F.col("text")),
        lambda ls: let(fences(ls), lambda fp: let(heads(ls, fp), lambda h: build(ls, h))),
    )
    return docs.select("doc_id", F.inline(F.filter(arr, lambda s: s["body"] != "")))


def _pack(body: Column, start: Column, max_bytes: int, cut_long: bool = True) -> Column:
    """Greedy packing of a text's lines as ``array<struct<text, start_line, end_line>>``.

    The fold carries byte counts and cut positions; only a finished chunk appends to the
    result, so the cost is linear in the number of lines.
    """
    items = F.flatten(
        F.transform(
            F.split(body, "\n", -1),
            lambda x, i: let(
                cut_bytes(x, max_bytes) if cut_long else F.array(x),
                lambda ps: F.transform(
                    ps,
                    lambda p, j: F.struct(
                        i.alias("i"), p.alias("t"), F.octet_length(p).alias("b"), (j < F.size(ps) - 1).alias("hard")
                    ),
                ),
            ),
        )
    )

    def ends(it: Column) -> Column:
        """Item index after which each chunk is closed."""
        init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(0).alias("k"),
                        F.array().cast("array<int>").alias("cuts"))

        def step(acc: Column, x: Column) -> Column:
            over = (acc["n"] > 0) & (x["hard"] | (acc["b"] + x["b"] + 1 > max_bytes))
            cuts = F.when(over, F.concat(acc["cuts"], F.array(acc["k"]))).otherwise(acc["cuts"])
            k = acc["k"] + 1
            n = F.when(x["hard"], 0).when(over, 1).otherwise(acc["n"] + 1)
            b = F.when(x["hard"], 0).when(over | (acc["n"] == 0), x["b"]).otherwise(acc["b"] + x["b"] + 1)
            return F.struct(
                n.alias("n"), b.alias("b"), k.alias("k"),
                F.when(x["hard"], F.concat(cuts, F.array(k))).otherwise(cuts).alias("cuts"),
            )

        return F.aggregate(it, init, step, lambda a: F.array_distinct(F.concat(a["cuts"], F.array(a["k"]))))

    def chunk(it: Column, cs: Column) -> Column:
        return F.transform(
            cs,
            lambda e, i: let(
                F.slice(it, F.coalesce(F.get(cs, i - 1), F.lit(0)) + 1, e - F.coalesce(F.get(cs, i - 1), F.lit(0))),
                lambda part: F.struct(
                    strip(F.array_join(F.transform(part, lambda p: p["t"]), "\n")).alias("content"),
                    (start + F.element_at(part, 1)["i"]).alias("start_line"),
                    (start + F.element_at(part, -1)["i"]).alias("end_line"),
                ),
            ),
        )

    packed = let(items, lambda it: let(ends(it), lambda cs: chunk(it, cs)))
    return F.filter(packed, lambda c: c["content"] != "")


def pack_lines(sects: DataFrame, max_bytes: int = 12288) -> DataFrame:
    """T2. Fragments of at most ``max_bytes`` bytes, cut at line ends, long lines at runes."""
    packed = sects.select("doc_id", "section_no", "section", _pack(F.col("body"), F.col("start_line"), max_bytes).alias("c"))
    part = packed.select(
        "doc_id", "section_no", "section", F.size("c").alias("parts"), F.posexplode("c").alias("part", "x")
    )
    frag = part.select(
        "doc_id",
        "section_no",
        (F.col("part") + 1).cast("bigint").alias("part"),
        F.when(F.col("parts") > 1, F.format_string("%s（第%d部分）", "section", F.col("part") + 1))
        .otherwise(F.col("section")).alias("section"),
        F.col("x.start_line").alias("start_line"),
        F.col("x.end_line").alias("end_line"),
        F.col("x.content").alias("content"),
    )
    return frag.withColumn(
        "fragment_id", fragment_key(F.col("doc_id"), F.col("start_line"), F.col("part"))
    ).withColumn("content_hash", sha(F.col("content")))


def fragments(docs: DataFrame, max_bytes: int = 12288) -> DataFrame:
    """T1 then T2: a document to its fragments, without a shuffle."""
    return pack_lines(sections(docs), max_bytes)


def is_table_line(x: Column) -> Column:
    t = strip(x)
    return F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|")) & (
        F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))) >= 3
    )


def is_image_line(x: Column) -> Column:
    return F.contains(x, F.lit("![")) & F.contains(x, F.lit("]("))


def _has(text: Column, test) -> Column:
    def inner(ls: Column) -> Column:
        return let(
            fences(ls),
            lambda fp: F.exists(
                F.transform(
                    ls, lambda x, i: test(x) & ~F.startswith(strip(x), F.lit(FENCE)) & outside(fp, i)
                ),
                lambda b: b,
            ),
        )

    return let(F.split(text, "\n", -1), inner)


def asset_flags(frags: DataFrame, col: str = "content") -> DataFrame:
    """T6. Whether a fragment holds a Markdown table or image outside code fences."""
    return frags.withColumn("has_table", _has(F.col(col), is_table_line)).withColumn(
        "has_image", _has(F.col(col), is_image_line)
    )


# Prefixes of header lines that carry provenance, not content.
META = ("来源：", "目录：", "更新时间：")


def _starts_with_any(x: Column, prefixes: tuple[str, ...]) -> Column:
    cond = F.startswith(x, F.lit(prefixes[0]))
    for p in prefixes[1:]:
        cond = cond | F.startswith(x, F.lit(p))
    return cond


def blocks(docs: DataFrame, max_bytes: int = 1800) -> DataFrame:
    """T7. Consecutive lines of one kind (code, table, image, text) under their heading.

    An image line is a block of its own; code runs from fence to fence; blank lines end a text
    run; header lines count as text only inside a text run. Runs over ``max_bytes`` are cut at
    line ends."""

    def raw_kind(ls: Column, fp: Column) -> Column:
        return F.transform(
            ls,
            lambda x, i: F.when(F.startswith(strip(x), F.lit(FENCE)) | ~outside(fp, i), "code")
            .when(strip(x) == "", "blank").when(_starts_with_any(strip(x), META), "meta")
            .when(x.rlike(r"^\s*#{1,6}\s+\S"), "heading").when(is_table_line(x), "table")
            .when(x.rlike(r"!\[[^\]]*\]\([^)]+\)"), "image").otherwise("text"),
        )

    def kinds(ks: Column) -> Column:
        def owner(i: Column) -> Column:
            return F.try_element_at(F.filter(F.slice(ks, F.lit(1), i), lambda k: k != "meta"), F.lit(-1))

        return F.transform(
            ks, lambda k, i: F.when(k != "meta", k).when((i > 0) & (owner(i) == "text"), "text").otherwise("blank")
        )

    def islands(ls: Column, ks: Column, fp: Column) -> Column:
        starts = _positions(
            F.transform(
                ks,
                lambda k, i: (i == 0) | (k != F.get(ks, i - 1)) | (k == "image") | (k == "heading")
                | (F.array_contains(fp, i) & outside(fp, i)),
            )
        )
        heads = _positions(F.transform(ks, lambda k: k == "heading"))
        return let(
            heads,
            lambda hs: let(
                starts,
                lambda st: F.transform(
                    st,
                    lambda s, j: F.struct(
                        F.get(ks, s).alias("kind"),
                        (s + 1).cast("bigint").alias("start_line"),
                        strip(F.regexp_replace(
                            F.get(ls, F.try_element_at(F.filter(hs, lambda h: h < s), F.lit(-1))),
                            r"^\s*#{1,6}\s+", "")).alias("section"),
                        F.slice(ls, s + 1, F.coalesce(F.get(st, j + 1), F.size(ls)) - s).alias("ls"),
                    ),
                ),
            ),
        )

    arr = let(
        split_lines(F.col("text")),
        lambda ls: let(
            fences(ls), lambda fp: let(raw_kind(ls, fp), lambda rk: let(kinds(rk), lambda ks: islands(ls, ks, fp)))
        ),
    )
    runs = docs.select("doc_id", F.inline(F.filter(arr, lambda b: ~b["kind"].isin("blank", "heading"))))
    cut = runs.select(
        "doc_id", "kind", "section",
        F.explode(_pack(F.array_join("ls", "\n"), F.col("start_line"), max_bytes, cut_long=False)).alias("c"),
    )
    return cut.select(
        "doc_id", "kind", F.coalesce("section", F.lit("")).alias("section"), F.col("c.start_line").alias("start_line"),
        F.col("c.end_line").alias("end_line"), F.col("c.content").alias("content"),
    )


def greedy_batches(
    items: DataFrame, by: list[str], order: str, size: str, max_bytes: int,
    max_items: int | None = None, overhead: int = 0,
) -> DataFrame:
    """T8. Consecutive items of one group into batches of bounded bytes and count.

    A group is one document, section or table, whose own size is bounded; only
    ``(order, bytes)`` pairs are gathered, the payload stays where it is and is joined back
    by the caller on ``by + [order]``.
    """
    g = items.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), (F.col(size) + overhead).alias("b")))).alias("xs")
    )
    init = F.struct(
        F.lit(0).cast("bigint").alias("no"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("b"),
        F.array().cast("array<bigint>").alias("starts"),
    )

    def step(acc: Column, x: Column) -> Column:
        full = acc["b"] + x["b"] > max_bytes
        if max_items is not None:
            full = full | (acc["n"] >= max_items)
        new = (acc["no"] == 0) | full
        return F.struct(
            F.when(new, acc["no"] + 1).otherwise(acc["no"]).cast("bigint").alias("no"),
            F.when(new, 1).otherwise(acc["n"] + 1).cast("bigint").alias("n"),
            F.when(new, x["b"]).otherwise(acc["b"] + x["b"]).cast("bigint").alias("b"),
            F.when(new, F.concat(acc["starts"], F.array(x["o"].cast("bigint")))).otherwise(acc["starts"]).alias("starts"),
        )

    starts = F.aggregate("xs", init, step, lambda a: a["starts"])
    b = g.withColumn("starts", starts)
    return b.select(
        *by,
        F.explode(
            F.transform(
                "xs",
                lambda x: F.struct(
                    x["o"].alias(order), x["b"].cast("bigint").alias("batch_bytes"),
                    F.size(F.filter(F.col("starts"), lambda s: s <= x["o"])).cast("bigint").alias("batch_no"),
                ),
            )
        ).alias("e"),
    ).select(*by, "e.*")


def split_documents(docs: DataFrame, max_bytes: int = 225280) -> DataFrame:
    """T10. Documents over the limit are cut at blank-line paragraphs, long paragraphs at runes."""
    text = F.col("text")

    def merge(ps: Column) -> Column:
        init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(0).alias("k"),
                        F.array().cast("array<int>").alias("cuts"))

        def step(acc: Column, p: Column) -> Column:
            size = F.octet_length(p)
            over = (acc["n"] > 0) & (acc["b"] + 2 + size > max_bytes)
            return F.struct(
                F.when(over, 1).otherwise(acc["n"] + 1).alias("n"),
                F.when(over | (acc["n"] == 0), size).otherwise(acc["b"] + 2 + size).alias("b"),
                (acc["k"] + 1).alias("k"),
                F.when(over, F.concat(acc["cuts"], F.array(acc["k"]))).otherwise(acc["cuts"]).alias("cuts"),
            )

        cuts = F.aggregate(ps, init, step, lambda a: F.concat(a["cuts"], F.array(a["k"])))

        def part(cs: Column, e: Column, i: Column) -> Column:
            at = F.coalesce(F.get(cs, i - 1), F.lit(0))
            return F.concat(strip(F.array_join(F.slice(ps, at + 1, e - at), "\n\n")), F.lit("\n"))

        return let(cuts, lambda cs: F.transform(cs, lambda e, i: part(cs, e, i)))

    paragraphs = F.flatten(F.transform(F.split(text, "\n{2,}", -1), lambda p: cut_bytes(p, max_bytes)))
    parts = F.when(F.octet_length(text) <= max_bytes, F.array(text)).otherwise(let(paragraphs, merge))
    return (
        docs.select("doc_id", parts.alias("ps"))
        .select("doc_id", F.size("ps").cast("bigint").alias("parts"), F.posexplode("ps").alias("i", "content"))
        .select(
            "doc_id", (F.col("i") + 1).cast("bigint").alias("part"), "parts",
            F.when(F.col("parts") > 1, F.format_string("（第%d/%d部分）", F.col("i") + 1, F.col("parts")))
            .otherwise("").alias("suffix"),
            "content",
        )
    )


def line_owner(lns: DataFrame, frags: DataFrame) -> DataFrame:
    """T13. The fragment that contains each line: ranges are expanded to line numbers and
    joined by equality, so there is no range join."""
    owned = frags.select(
        "doc_id", "fragment_id", F.explode(F.sequence("start_line", "end_line")).alias("line")
    )
    return lns.join(owned, ["doc_id", "line"], "left")


def validate_fragments(docs: DataFrame, frags: DataFrame, max_bytes: int = 12288, max_count: int = 4096) -> DataFrame:
    """T4. Violations of supplied fragments: range, overlap, text, size and omitted lines."""
    src = docs.select("doc_id", split_lines(F.col("text")).alias("ls"))
    w = W.partitionBy("doc_id").orderBy("ordinal")
    f = frags.withColumn("prev_end", F.max("end_line").over(w.rowsBetween(W.unboundedPreceding, -1)))
    f = f.withColumn("n", F.count("*").over(W.partitionBy("doc_id"))).join(src, "doc_id")
    expected = strip(
        F.array_join(F.slice("ls", F.greatest(F.col("start_line"), F.lit(1)).cast("int"),
                             F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int")), "\n")
    )
    bad_range = (
        (strip(F.col("section")) == "") | (F.octet_length("section") > 512) | (F.col("start_line") < 1)
        | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.size("ls"))
        | (F.col("start_line") <= F.coalesce("prev_end", F.lit(0)))
    )
    reason = (
        F.when(F.col("n") > max_count, "TOO_MANY")
        .when(bad_range, "RANGE")
        .when((expected == "") | (F.col("content") != expected) | (F.octet_length("content") > max_bytes), "TEXT")
    )
    per_fragment = f.select("doc_id", F.col("start_line").cast("bigint").alias("line"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )
    own = frags.where((F.col("end_line") >= F.col("start_line")) & (F.col("start_line") >= 1)).select(
        "doc_id", F.explode(F.sequence("start_line", "end_line")).alias("line")
    )
    t = strip(F.col("content"))
    # Prefixes of lines that need no owner.
    exempt = t == ""
    for p in ("#", "来源：", "目录：", "更新时间："):
        exempt = exempt | F.startswith(t, F.lit(p))
    omitted = (
        lines(docs.join(frags.select("doc_id").distinct(), "doc_id", "left_semi"))
        .where(~exempt)
        .join(own, ["doc_id", "line"], "left_anti")
        .select("doc_id", F.col("line").cast("bigint").alias("line"), F.lit("OMITTED").alias("reason"))
    )
    return per_fragment.unionByName(omitted)


def asset_context(assets: DataFrame, lns: DataFrame, reach: int = 4, keep: int = 2) -> DataFrame:
    """T14. The nearest ``keep`` ordinary lines within ``reach`` lines on each side of an asset.

    Offsets are expanded on the asset side and joined by (doc, line) equality."""
    near = assets.select(
        "doc_id", "asset_id", "start_line", "end_line",
        F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("off"),
    ).where("off <> 0")
    near = near.withColumn(
        "line", F.when(F.col("off") < 0, F.col("start_line") + F.col("off")).otherwise(F.col("end_line") + F.col("off"))
    )
    plain = lns.where((strip(F.col("content")) != "") & ~is_table_line(F.col("content")) & ~is_image_line(F.col("content")))
    hit = near.join(plain, ["doc_id", "line"]).withColumn("side", F.when(F.col("off") < 0, "before").otherwise("after"))
    rank = F.row_number().over(W.partitionBy("doc_id", "asset_id", "side").orderBy(F.abs("off")))
    hit = hit.withColumn("rn", rank).where(F.col("rn") <= keep)

    def side(name: str) -> Column:
        xs = F.array_sort(
            F.collect_list(F.when(F.col("side") == name, F.struct("line", strip(F.col("content")).alias("c"))))
        )
        return F.array_join(F.transform(xs, lambda x: x["c"]), " ").alias(name)

    ctx = hit.groupBy("doc_id", "asset_id").agg(side("before"), side("after"))
    return assets.join(ctx, ["doc_id", "asset_id"], "left").fillna("", ["before", "after"])


def image_refs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T15. Image references by position, and the distinct images by the hash of their url."""
    # Fixed value: alt text, target, optional quoted title.
    pattern = r'!\[([^\]]*)\]\(([^ )]+)(?: "([^"]*)")?\)'
    lns = lines(docs).where(F.contains("content", F.lit("![")))
    whole = lns.select(
        "doc_id", "line", F.posexplode(F.regexp_extract_all("content", F.lit("(" + pattern + ")"), F.lit(1))).alias("pos", "ref")
    )
    refs = whole.select(
        "doc_id", F.col("line").cast("bigint").alias("line"), (F.col("pos") + 1).cast("bigint").alias("position"),
        F.regexp_extract("ref", pattern, 1).alias("alt"), F.regexp_extract("ref", pattern, 2).alias("url"),
        F.regexp_extract("ref", pattern, 3).alias("title"),
    ).withColumn("url_sha", sha(F.col("url")))
    distinct = refs.groupBy("url_sha").agg(F.first("url").alias("url"), F.count("*").alias("uses"))
    return refs, distinct


def image_kind(content: Column) -> Column:
    """The format of cached image bytes by their leading bytes, NULL if none matches."""
    head = F.hex(F.substring(content, 1, 12))
    # Magic bytes.
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
        .when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.startswith(head, F.lit("474946383761")) | F.startswith(head, F.lit("474946383961")), "gif")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


# Labels under which descriptions are shown with the source text.
LABELS = {"TABLE": "表格说明", "TABLE_TEXT": "表格说明", "TABLE_SUMMARY": "表格摘要", "IMAGE": "图片说明"}


def retrieval_context(frags: DataFrame, reps: DataFrame) -> DataFrame:
    """T17. Source text with each description placed after the line it describes.

    A fragment has at most 64 representations, so gathering them per fragment is bounded."""
    label = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])
    shown = reps.where(F.col("kind").isin(*LABELS)).select(
        "fragment_id", "ordinal", F.col("end_line").alias("at"),
        F.concat(F.lit("["), label[F.col("kind")], F.lit("] "), F.col("text")).alias("shown"),
    )
    per = shown.groupBy("fragment_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "at", "shown"))).alias("rs"))
    joined = frags.join(per, "fragment_id", "left").withColumn(
        "rs", F.coalesce("rs", F.array().cast("array<struct<ordinal:bigint,at:bigint,shown:string>>"))
    )
    placed = F.flatten(
        F.transform(
            F.split("content", "\n", -1),
            lambda x, i: F.concat(
                F.array(x),
                F.transform(
                    F.filter(F.col("rs"), lambda r: (r["at"] > 0) & (r["at"] == F.col("start_line") + i)),
                    lambda r: r["shown"],
                ),
            ),
        )
    )
    last = F.transform(F.filter("rs", lambda r: F.coalesce(r["at"], F.lit(0)) <= 0), lambda r: r["shown"])
    return joined.withColumn("context", F.array_join(F.concat(placed, last), "\n")).drop("rs")


def token_windows(
    texts: DataFrame, budget: int = 480, overlap: int = 64, tokens: Column | None = None,
    prefix_tokens: Column | int = 0, min_budget: int = 128, limit: int = 64,
) -> DataFrame:
    """T19. Overlapping token windows: ``texts(id, text)`` to ``id, window_no, n_tokens, text``.

    ``tokens`` is the tokenizer hook: an array of token texts, each with the white space that
    follows it, so that joining a slice gives back the source text (white-space tokens by
    default). Repeated windows of one text are kept once; ``over_limit`` marks texts with more
    than ``limit`` windows, which are kept whole.
    """
    tok = F.regexp_extract_all("text", F.lit(r"(\S+\s*)"), F.lit(1)) if tokens is None else tokens
    prefix = F.lit(prefix_tokens) if isinstance(prefix_tokens, int) else prefix_tokens
    size = F.greatest(F.lit(min_budget), F.lit(budget) - prefix).cast("int")

    def cut(ts: Column) -> Column:
        n = F.size(ts)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / (size - overlap)).cast("int"))
        wins = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: let(
                F.slice(ts, k * (size - overlap) + 1, size),
                lambda w: F.struct(strip(F.array_join(w, "")).alias("text"), F.size(w).cast("bigint").alias("n")),
            ),
        )
        return F.when(n <= size, F.array(F.struct(F.col("text").alias("text"), n.cast("bigint").alias("n")))).otherwise(
            F.array_distinct(F.filter(wins, lambda w: w["text"] != ""))
        )

    return (
        texts.select("id", let(tok, cut).alias("ws"))
        .select("id", (F.size("ws") > limit).alias("over_limit"), F.posexplode("ws").alias("k", "w"))
        .select("id", (F.col("k") + 1).cast("bigint").alias("window_no"), F.col("w.n").alias("n_tokens"),
                F.col("w.text").alias("text"), "over_limit")
    )


def bounded_section(section: Column, max_bytes: int = 512) -> Column:
    """T19. A section path within a byte bound: first and last step, then a cut at a rune."""
    steps = F.split(section, " / ")
    compact = F.concat(F.element_at(steps, 1), F.lit(" / ... / "), F.element_at(steps, -1))
    return (
        F.when(F.octet_length(section) <= max_bytes, section)
        .when(F.octet_length(compact) <= max_bytes, compact)
        .otherwise(strip(F.element_at(cut_bytes(compact, max_bytes), 1)))
    )


def document_context(docs: DataFrame, max_bytes: int = 4096) -> DataFrame:
    """T21. The leading breadcrumb and update-time lines of a document's header.

    The fold stops looking at the first ``##`` or body line; a field that would pass the limit
    ends the scan as well."""
    init = F.struct(F.lit(False).alias("done"), F.lit(0).alias("b"), F.array().cast("array<string>").alias("f"))

    def step(acc: Column, raw: Column) -> Column:
        x = strip(raw)
        field = F.startswith(x, F.lit("目录：")) | F.startswith(x, F.lit("更新时间："))
        fits = acc["b"] + F.octet_length(x) + 1 <= max_bytes
        body = (x != "") & ~F.startswith(x, F.lit("# ")) & ~F.startswith(x, F.lit("来源："))
        take = ~acc["done"] & ~F.startswith(x, F.lit("##")) & field & fits
        done = acc["done"] | F.startswith(x, F.lit("##")) | (field & ~fits) | (~field & body)
        return F.struct(
            done.alias("done"),
            F.when(take, acc["b"] + F.octet_length(x) + 1).otherwise(acc["b"]).alias("b"),
            F.when(take, F.concat(acc["f"], F.array(x))).otherwise(acc["f"]).alias("f"),
        )

    return docs.withColumn(
        "context", F.aggregate(split_lines(F.col("text")), init, step, lambda a: F.array_join(a["f"], "\n"))
    )


def section_links(docs: DataFrame, frags: DataFrame) -> DataFrame:
    """T22. Related fragments of each fragment: the first fragment directly under every
    ancestor heading (nearest ancestor first), then the previous and the next one.

    Per document: heading lines with levels come from the row's own line array; each fragment
    keeps its heading stack; ancestors become equi-joins on (doc, heading line).
    """

    def headings(ls: Column, fp: Column) -> Column:
        level = lambda x: F.length(F.regexp_extract(x, "^(#{1,6}) ", 1))
        hs = F.transform(
            ls,
            lambda x, i: F.struct((i + 1).cast("bigint").alias("line"),
                                  F.when(outside(fp, i), level(x)).otherwise(0).alias("level")),
        )
        return F.filter(hs, lambda h: h["level"] > 0)

    hd = docs.select(
        "doc_id",
        let(split_lines(F.col("text")), lambda ls: let(fences(ls), lambda fp: headings(ls, fp))).alias("hs"),
    )
    order = W.partitionBy("doc_id").orderBy("start_line", "part")
    base = frags.select("doc_id", "fragment_id", "start_line", "part").withColumn("no", F.row_number().over(order))
    f = base.join(hd, "doc_id")

    def stack(hs: Column, upto: Column) -> Column:
        init = F.array().cast("array<struct<line:bigint,level:int>>")
        return F.aggregate(
            F.filter(hs, lambda h: h["line"] < upto), init,
            lambda acc, h: F.concat(F.filter(acc, lambda a: a["level"] < h["level"]), F.array(h)),
        )

    f = f.withColumn("st", stack(F.col("hs"), F.col("start_line")))
    up = f.select(
        "doc_id", "fragment_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("st") - 1, F.lit(1))),
                lambda k: F.struct(
                    F.get(F.col("st"), F.size("st") - 1 - k)["line"].alias("from"),
                    F.get(F.col("st"), F.size("st") - k)["line"].alias("to"),
                ),
            )
        ).alias("ordinal", "r"),
    ).where(F.col("r.from").isNotNull())
    # The first fragment after a heading line, keyed by the nearest heading above it.
    nearest = f.where(F.size("st") > 0).select(
        "doc_id", F.col("fragment_id").alias("related"), F.element_at("st", -1)["line"].alias("from"),
        F.col("start_line").alias("rel_line"), "no",
    )
    first = nearest.groupBy("doc_id", "from").agg(F.min_by(F.struct("related", "rel_line"), F.col("no")).alias("x"))
    anc = (
        up.select("doc_id", "fragment_id", "ordinal", F.col("r.from").alias("from"), F.col("r.to").alias("to"))
        .join(first, ["doc_id", "from"])
        .where(F.col("x.rel_line") < F.col("to"))
        .select("doc_id", "fragment_id", F.col("x.related").alias("related"), F.col("ordinal").cast("bigint").alias("ordinal"))
    )
    sib = base.select("doc_id", "fragment_id", F.lag("fragment_id").over(order).alias("p"), F.lead("fragment_id").over(order).alias("n"))
    sib = sib.select(
        "doc_id", "fragment_id",
        F.explode(F.array(F.struct(F.col("p").alias("related"), F.lit(100).cast("bigint").alias("ordinal")),
                          F.struct(F.col("n").alias("related"), F.lit(101).cast("bigint").alias("ordinal")))).alias("s"),
    ).select("doc_id", "fragment_id", "s.related", "s.ordinal").where(F.col("related").isNotNull())
    return anc.unionByName(sib)


def locate_anchors(anchors: DataFrame, docs: DataFrame) -> DataFrame:
    """T25. The first non-heading line of the named document that contains each anchor, with
    its nearest heading, the quoted lines and their hash. A quote that starts a manifest runs
    to the line before the next fence."""
    src = docs.select("doc_id", split_lines(F.col("text")).alias("ls"))
    j = anchors.join(src, "doc_id")
    at = F.array_position(
        F.transform("ls", lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.col("anchor"))), True
    )
    j = j.withColumn("start_line", at).where("start_line > 0")
    tail = F.slice("ls", F.col("start_line").cast("int"), F.size("ls"))
    next_fence = F.array_position(F.transform(tail, lambda x: F.startswith(strip(x), F.lit(FENCE))), True)
    is_manifest = F.startswith(strip(F.get("ls", (F.col("start_line") - 1).cast("int"))), F.lit("apiVersion:"))
    j = j.withColumn(
        "end_line",
        F.when(is_manifest & (next_fence > 0), F.col("start_line") + next_fence - 2)
        .when(is_manifest & (next_fence == 0), F.size("ls")).otherwise(F.col("start_line")),
    )
    above = F.slice("ls", F.lit(1), (F.col("start_line") - 1).cast("int"))
    head = F.try_element_at(F.filter(above, lambda x: F.startswith(x, F.lit("#"))), F.lit(-1))
    quote = F.array_join(
        F.slice("ls", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n"
    )
    return j.select(
        "doc_id", "anchor", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
        F.coalesce(strip(F.ltrim(head, F.lit("#"))), F.lit("")).alias("section"),
        quote.alias("quote"), sha(quote).alias("quote_sha256"),
    )


def length_audit(frags: DataFrame, limit: int = 512, tokens: Column | None = None) -> DataFrame:
    """T29. How many fragments pass the token limit, and the longest."""
    n = F.size(F.filter(F.split("content", r"\s+", -1), lambda t: t != "")) if tokens is None else tokens
    return frags.select(n.cast("bigint").alias("n")).agg(
        F.count("*").alias("fragments"), F.count_if(F.col("n") > limit).alias("over_limit"), F.max("n").alias("max_tokens")
    )
