"""Audit of drafted answers against their evidence (A1-A10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.functions.text import sha, strip
from passageworks.operators.knowledge import first_reason

# Fixed value: the verdicts a review may give.
VERDICTS = ("SUPPORTED", "UNSUPPORTED", "CONTRADICTED")


def check_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A1. Claims and verdicts of an answer that do not pair off, or whose verdict is malformed."""
    v = verdicts.groupBy("answer_id", "claim_index").agg(
        F.count("*").alias("n"),
        F.bool_or(F.coalesce((strip(F.col("reason")) == "") | (F.octet_length("reason") > 2000), F.lit(True))).alias("bad_reason"),
        F.bool_or(F.coalesce(~F.col("verdict").isin(*VERDICTS), F.lit(True))).alias("bad_verdict"),
        F.max("supports").alias("most"), F.bool_or((F.col("verdict") == "SUPPORTED") & (F.col("supports") == 0)).alias("bare"))
    j = claims.select("answer_id", "claim_index", F.lit(True).alias("claim")).join(v, ["answer_id", "claim_index"], "full")
    reason = first_reason(
        (F.col("claim").isNull(), "UNKNOWN_CLAIM"), (F.col("n").isNull(), "MISSING"), (F.col("n") > 1, "REPEATED"),
        (F.col("bad_reason"), "REASON"), (F.col("most") > 16, "TOO_MANY_SUPPORTS"), (F.col("bad_verdict"), "VERDICT"), (F.col("bare"), "NO_SUPPORT"))
    return j.select("answer_id", "claim_index", reason.alias("reason")).where(F.col("reason").isNotNull())


def check_supports(supports: DataFrame, cites: DataFrame, sources: DataFrame, max_quote: int = 16384) -> DataFrame:
    """A2. Supports that cite what their claim does not, lie outside the source, misquote it, or repeat.

    ``sources(evidence_id, start_line, end_line, content)`` are bounded fragments; the quoted lines are
    cut from the joined row itself."""
    key = ["answer_id", "claim_index", "evidence_id"]
    j = supports.join(cites.select(*key, F.lit(True).alias("cited")).distinct(), key, "left").join(
        sources.select("evidence_id", F.col("start_line").alias("s0"), F.col("end_line").alias("s1"), F.split("content", "\n", -1).alias("ls")), "evidence_id", "left")
    twice = supports.groupBy(*key, "start_line", "end_line").agg(F.count("*").alias("copies"))
    j = j.join(twice, [*key, "start_line", "end_line"])
    frm = (F.col("start_line") - F.col("s0") + 1).cast("int")
    n = (F.col("end_line") - F.col("start_line") + 1).cast("int")
    inside = (F.col("start_line") >= F.col("s0")) & (n >= 1) & (F.col("end_line") <= F.col("s1"))
    exact = F.array_join(F.slice("ls", F.greatest(frm, F.lit(1)), F.greatest(n, F.lit(0))), "\n")
    reason = first_reason(
        (F.col("cited").isNull() | F.col("s0").isNull(), "NOT_CITED"), (~inside, "RANGE"), (frm + n - 1 > F.size("ls"), "RANGE"),
        ((strip(F.col("quote")) == "") | (F.octet_length("quote") > max_quote) | (F.col("quote") != exact), "QUOTE"), (F.col("copies") > 1, "REPEATED"))
    return j.select(*key, "start_line", "end_line", reason.alias("reason")).where(F.col("reason").isNotNull()).distinct()


def block_conflicts(claims: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3. Claims that cite no conflicted id, the gaps the conflicts become, and malformed conflicts
    (blank subject, fewer than 2 or more than 8 ids, a repeated id)."""
    size = F.size("ids")
    bad = (strip(F.col("subject")) == "") | (F.octet_length("subject") > 2000) | (size < 2) | (size > 8) | (F.size(F.array_distinct("ids")) < size)
    ok = conflicts.where(~bad)
    blocked = ok.select("answer_id", F.explode("ids").alias("id")).distinct()
    hit = claims.select("answer_id", "claim_index", F.explode("ids").alias("id")).join(blocked, ["answer_id", "id"], "left_semi")
    kept = claims.join(hit.select("answer_id", "claim_index"), ["answer_id", "claim_index"], "left_anti")
    gaps = ok.select("answer_id", F.concat(F.lit("资料冲突，已暂停受影响建议："), "subject").alias("gap"))
    return kept, gaps, conflicts.where(bad).select("answer_id", "subject")


def check_citations(claims: DataFrame, allowed: DataFrame, frags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4. Citations of each answer in first-seen order, and the answers that fail: INVALID for ids that
    were not retrieved or whose text differs, UNRESOLVED for revisions withdrawn or no longer matching.

    ``frags`` has ``content_hash``, ``status`` and ``applicability`` as they are now."""
    ids = claims.select("answer_id", "claim_index", F.posexplode("ids").alias("pos", "fragment_id"))
    first = ids.groupBy("answer_id", "fragment_id").agg(F.min(F.struct("claim_index", "pos")).alias("o"))
    j = first.join(allowed.select("answer_id", "fragment_id", F.col("content_hash").alias("seen")), ["answer_id", "fragment_id"], "left").join(
        frags.select("fragment_id", "content_hash", "status", "applicability"), "fragment_id", "left")
    stale = (F.col("status") != "PUBLISHED") | (F.col("applicability") != "MATCH")
    verdict = (F.when(F.col("seen").isNull() | F.col("status").isNull(), "INVALID").when(stale, "UNRESOLVED")
               .when(F.col("seen") != F.col("content_hash"), "INVALID"))
    j = j.withColumn("problem", verdict)
    # The first problem met in reading order decides, as it ends the check.
    failed = j.where(F.col("problem").isNotNull()).groupBy("answer_id").agg(F.min_by("problem", "o").alias("problem"))
    good = j.join(failed, "answer_id", "left_anti")
    order = F.row_number().over(W.partitionBy("answer_id").orderBy("o"))  # ids of one answer's claims
    return good.select("answer_id", "fragment_id", order.cast("bigint").alias("ordinal")), failed


def keep_supported(claims: DataFrame, verdicts: DataFrame, citations: DataFrame, conflict_ids: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A5. Supported claims, and the citations that one of them or a conflict still uses; an answer with
    only supported claims keeps its citations.

    All that belongs to an answer meets in one shuffle (of so many ``parts``); what follows stays in its task."""
    key = ["answer_id", "claim_index"]
    good = claims.join(verdicts.where("verdict = 'SUPPORTED'").select(*key).distinct(), key, "left_semi")
    kind = claims.schema["ids"].dataType
    more = [c for c in citations.columns if c not in ("answer_id", "fragment_id")]
    cite = F.struct(*more) if more else F.lit(True)
    rows = [claims.select(*key, "ids"), verdicts.select(*key, (F.col("verdict") == "SUPPORTED").alias("ok")),
            conflict_ids.select("answer_id", F.array("id").cast(kind).alias("ids"), F.lit(True).alias("conflict")),
            citations.select("answer_id", F.array("fragment_id").cast(kind).alias("ids"), cite.alias("cite"))]
    x = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).where("answer_id IS NOT NULL OR cite IS NOT NULL")
    x = x.repartition(parts, "answer_id") if parts else x.repartition("answer_id")
    own, of = W.partitionBy("answer_id"), W.partitionBy(*key)
    x = x.withColumn("dropped", F.col("answer_id").isNotNull() & F.coalesce(F.max(~F.col("ok")).over(own), F.lit(False)))
    # an answer without a dropped claim keeps its citations, whatever is used
    x = x.withColumn("good", F.coalesce(F.col("conflict"), F.max("ok").over(of) & F.col("claim_index").isNotNull(), F.lit(False)) & F.col("cite").isNull())
    x = x.where("cite IS NOT NULL OR good AND dropped").select("answer_id", "dropped", "cite", "good", F.explode("ids").alias("id"))
    x = x.withColumn("used", F.max("good").over(W.partitionBy("answer_id", "id")) & F.col("id").isNotNull())
    kept = x.where("cite IS NOT NULL AND (used OR NOT dropped)").withColumnRenamed("id", "fragment_id")
    return good, kept.select(*[F.col(f"cite.{c}") if c in more else c for c in citations.columns])


def final_status(answers: DataFrame, claims: DataFrame, observations: DataFrame, gaps: DataFrame) -> DataFrame:
    """A6. ``answers(answer_id, documents, needs_context)`` to ANSWERED, PARTIAL, UNRESOLVED or NEEDS_CLARIFICATION."""
    n = lambda d, name: d.groupBy("answer_id").agg(F.count("*").alias(name))
    j = answers.join(n(claims, "c"), "answer_id", "left").join(n(observations, "o"), "answer_id", "left").join(n(gaps, "g"), "answer_id", "left").fillna(0, ["c", "o", "g"])
    nothing = (F.col("c") == 0) & (F.col("o") == 0)
    return j.select("answer_id", F.when(nothing & (F.col("documents") == 0) & F.col("needs_context"), "NEEDS_CLARIFICATION").when(nothing, "UNRESOLVED")
                    .when(F.col("g") > 0, "PARTIAL").otherwise("ANSWERED").alias("status"))


def check_private_sources(sources: DataFrame, attachments: DataFrame, executions: DataFrame) -> DataFrame:
    """A9. Private sources whose attachment or execution is another one, has another hash or is not finished."""
    a = attachments.select("attachment_id", F.col("conversation_id").alias("a_conv"), F.col("sha256").alias("a_sha"), F.col("status").alias("a_status"))
    e = executions.select("execution_id", F.col("conversation_id").alias("e_conv"), F.col("response_id").alias("e_resp"), F.col("status").alias("e_status"), "cleaned",
                          F.col("source_id").alias("e_source"), F.col("content_sha256").alias("e_sha"), F.col("code_sha256").alias("e_code"))
    twice = sources.groupBy("response_id", "source_id").agg(F.count("*").alias("copies"))
    j = sources.join(twice, ["response_id", "source_id"]).join(a, "attachment_id", "left").join(e, "execution_id", "left")
    att = (F.col("a_conv") == F.col("conversation_id")) & (F.col("a_sha") == F.col("attachment_hash")) & F.col("a_status").isin("READY", "PARTIAL")
    exe = ((F.col("e_conv") == F.col("conversation_id")) & (F.col("e_resp") == F.col("response_id")) & (F.col("e_status") == "SUCCEEDED") & F.col("cleaned")
           & (F.col("e_source") == F.col("source_id")) & (F.col("e_sha") == F.col("content_sha256")) & (F.col("e_code") == F.col("code_sha256")))
    reason = first_reason(
        ((F.col("source_id") == "") | (F.col("copies") > 1), "ID"), (~F.col("source_kind").isin("ATTACHMENT", "EXECUTION"), "KIND"),
        ((F.col("source_kind") == "ATTACHMENT") & ~F.coalesce(att, F.lit(False)), "ATTACHMENT"),
        ((F.col("source_kind") == "EXECUTION") & ~F.coalesce(exe, F.lit(False)), "EXECUTION"))
    return j.select("response_id", "source_id", reason.alias("reason")).where(F.col("reason").isNotNull()).distinct()


def select_lines(pages: DataFrame, requests: DataFrame, max_bytes: int = 49152) -> DataFrame:
    """A10. The requested lines of a log page: OK with text and hash, INVALID_RANGE, or NEEDS_RANGE when
    the output would pass the limit. ``start_line`` 0 asks for the whole page."""
    j = requests.join(pages.select("page_id", F.col("start_line").alias("p0"), F.col("end_line").alias("p1"), F.col("text").alias("page")), "page_id")
    a, b = F.col("start_line"), F.col("end_line")
    whole = a == 0
    ls = F.split("page", "\n", -1)
    frm, n = (a - F.col("p0") + 1).cast("int"), (b - a + 1).cast("int")
    bad = ~whole & ((F.col("p0") < 1) | (a < F.col("p0")) | (b > F.col("p1")) | (n < 1) | (frm + n - 1 > F.size(ls)))
    text: Column = F.when(whole, F.col("page")).otherwise(F.array_join(F.slice(ls, F.greatest(frm, F.lit(1)), F.greatest(n, F.lit(0))), "\n"))
    status = F.when(bad, "INVALID_RANGE").when(F.octet_length(text) > max_bytes, "NEEDS_RANGE").otherwise("OK")
    j = j.withColumn("status", status).withColumn("out", F.when(F.col("status") == "OK", text))
    return j.select("request_id", "page_id", "status", F.col("out").alias("text"), sha(F.col("out")).alias("content_sha256"))
