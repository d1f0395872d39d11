"""Conversation and event logs, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.functions.scale import running

# Response states and event types.
ACTIVE = ("QUEUED", "RUNNING", "CANCELING")
RETRYABLE = ("FAILED", "CANCELED", "INTERRUPTED")
SHOWN = ("ANSWERED", "PARTIAL")
TERMINAL_EVENTS = ("answer", "failed", "canceled", "interrupted", "clarification_required")


def sequence(rows: DataFrame, by: str, order: list[str], chunk: str) -> DataFrame:
    """C1. 1-based position of each row in its conversation."""
    return running(rows, [by], chunk, order, {"_n": ("count", order[0])}).withColumn("sequence", F.col("_n") + 1).drop("_n")


def last_sequence(parents: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """C1. The last position per conversation, 0 without messages."""
    n = rows.groupBy(by).agg(F.count("*").alias("last_sequence"))
    return parents.select(by).join(n, by, "left").fillna(0, ["last_sequence"])


def idempotent(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C2. ``requests(request_id, conversation_id, key, hash, ordinal)``: accepted, replays with the
    request they repeat, and conflicts. An empty key never matches anything."""
    keyed = requests.where(F.coalesce("key", F.lit("")) != "")
    first = keyed.groupBy("conversation_id", "key").agg(F.min_by(F.struct(F.col("request_id").alias("first_id"), F.col("hash").alias("first_hash")), "ordinal").alias("f"))
    j = keyed.join(first, ["conversation_id", "key"])
    again = j.where(F.col("request_id") != F.col("f.first_id"))
    same = F.col("hash") == F.col("f.first_hash")
    accepted = j.where(F.col("request_id") == F.col("f.first_id")).select("request_id").unionByName(
        requests.where(F.coalesce("key", F.lit("")) == "").select("request_id"))
    return accepted, again.where(same).select("request_id", F.col("f.first_id").alias("replay_of")), again.where(~same).select("request_id", F.col("f.first_id").alias("conflicts_with"))


def response_rules(responses: DataFrame) -> DataFrame:
    """C3. Conversations with two active responses, and retries of something else than an unchanged
    failed, canceled or interrupted question of the same conversation."""
    act = responses.where(F.col("status").isin(*ACTIVE)).groupBy("conversation_id").agg(F.count("*").alias("n")).where("n > 1")
    two = act.select(F.col("conversation_id").cast("string").alias("id"), F.lit("TWO_ACTIVE").alias("reason"))
    o = responses.select(F.col("response_id").alias("retry_of"), F.col("conversation_id").alias("oc"), F.col("status").alias("os"), F.col("question").alias("oq"), F.col("attachments").alias("oa"))
    j = responses.where(F.col("retry_of").isNotNull()).join(o, "retry_of", "left")
    reason = (F.when(F.col("oc").isNull() | (F.col("oc") != F.col("conversation_id")), "RETRY_NOT_FOUND")
              .when(~F.col("os").isin(*RETRYABLE), "RETRY_NOT_FAILED").when((F.col("oq") != F.col("question")) | ~F.col("oa").eqNullSafe(F.col("attachments")), "RETRY_CHANGED"))
    return two.unionByName(j.select(F.col("response_id").cast("string").alias("id"), reason.alias("reason")).where(F.col("reason").isNotNull()))


def search_history(convs: DataFrame, responses: DataFrame, owner: str, text: str = "", after: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """C4. One page of an owner's conversations whose title, a question, or a shown answer contains the
    text, newest first. The page starts after ``(created_at, id)``; no offset is counted."""
    if not 1 <= limit <= 100 or len(text.encode()) > 256:
        raise ValueError("limit must be 1..100 and text at most 256 bytes")
    c = convs.where((F.col("owner") == owner) & F.col("deleted_at").isNull())
    if after is not None:
        ts, cid = F.lit(after[0]).cast("timestamp"), F.lit(after[1]).cast(convs.schema["conversation_id"].dataType)
        c = c.where((F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("conversation_id") < cid)))
    if text:
        low = text.lower()
        has = lambda x: F.contains(F.lower(F.coalesce(F.col(x), F.lit(""))), F.lit(low))
        match = responses.where(has("question") | (F.col("status").isin(*SHOWN) & has("answer"))).select("conversation_id").distinct()
        c = c.join(match.withColumn("m", F.lit(True)), "conversation_id", "left").where(has("title") | F.col("m")).drop("m")
    return c.orderBy(F.desc("created_at"), F.desc("conversation_id")).limit(limit)


def message_page(responses: DataFrame, conversation_id, after: int = 0, before: int = 0, limit: int = 100) -> DataFrame:
    """C5. One page of a conversation's messages between two positions (0 = open end)."""
    if after < 0 or before < 0 or not 1 <= limit <= 100:
        raise ValueError("bad page")
    r = responses.where((F.col("conversation_id") == conversation_id) & (F.col("sequence") > after))
    return (r.where(F.col("sequence") < before) if before else r).orderBy("sequence").limit(limit)


def history_turn() -> tuple[Column, Column]:
    """C6. What of a past turn may be shown again: its answer, and its gaps."""
    s = F.col("status")
    answer = F.when(s.isin("ANSWERED", "NEEDS_CLARIFICATION") & F.col("reply").isNotNull(), F.col("reply")).when(s.isin(*SHOWN), F.col("answer")).otherwise("")
    gaps = F.when(s.isin(*SHOWN, "UNRESOLVED", "NEEDS_CLARIFICATION"), F.coalesce("gaps", F.lit(""))).otherwise("")
    return answer, gaps


def context_window(responses: DataFrame, keep: int = 6, step: int = 4, max_bytes: int = 49152) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C6. Per conversation the last ``keep`` turns, the batches of at most ``step`` older turns that are
    compacted one after the other, and the bytes of the kept turns with a flag when they pass the limit.

    Positions are dense (C1), so a turn's batch follows from its position and the conversation's last
    one; no window runs over a conversation."""
    last = responses.groupBy("conversation_id").agg(F.max("sequence").alias("last"))
    answer, gaps = history_turn()
    j = responses.join(last, "conversation_id").select("conversation_id", "sequence", "last", "question", answer.alias("shown"), gaps.alias("shown_gaps"))
    old = F.col("sequence") <= F.col("last") - keep
    recent = j.where(~old).drop("last")
    batch = j.where(old).groupBy("conversation_id", (F.floor((F.col("sequence") - 1) / step) + 1).alias("batch")).agg(
        F.min("sequence").alias("from_sequence"), F.max("sequence").alias("through_sequence"))
    size = recent.groupBy("conversation_id").agg(F.sum(F.octet_length("question") + F.octet_length("shown") + F.octet_length("shown_gaps")).alias("bytes"))
    return recent, batch, size.withColumn("over_limit", F.col("bytes") > max_bytes)


def source_ids(items: DataFrame) -> DataFrame:
    """C7. ``items(conversation_id, part, turn, pos, source_id)``: distinct sources in first-seen order."""
    f = items.where(F.coalesce(F.col("source_id").cast("string"), F.lit("")) != "").groupBy("conversation_id", "source_id").agg(F.min(F.struct("part", "turn", "pos")).alias("o"))
    return f.select("conversation_id", "source_id", F.row_number().over(W.partitionBy("conversation_id").orderBy("o")).cast("bigint").alias("ordinal"))


def latest_summary(summaries: DataFrame, payload: list[str]) -> DataFrame:
    """C8. The newest version of each conversation's summary."""
    return summaries.groupBy("conversation_id").agg(F.max_by(F.struct("version", *payload), "version").alias("s")).select("conversation_id", "s.*")


def cascade_delete(deleted: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """C9. What goes with deleted conversations: ``table, id`` over tables given as (frame with
    ``conversation_id``, id column)."""
    out = None
    for name, (df, key) in tables.items():
        part = df.join(deleted.select("conversation_id"), "conversation_id", "left_semi").select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def draft_state(events: DataFrame) -> DataFrame:
    """C10. Last sequence, highest draft version and the active draft of each response.

    The draft started last is active unless its own retraction or an end of the response came later;
    two aggregations, first per version, decide that without ordering a response's events."""
    t, v = F.col("type"), F.col("draft_version")
    per = events.groupBy("response_id", "draft_version").agg(
        F.max("seq").alias("seq"), F.max(F.when(t == "draft_started", F.col("seq"))).alias("started"),
        F.max(F.when(t == "draft_retracted", F.col("seq"))).alias("retracted"), F.max(F.when(t.isin(*TERMINAL_EVENTS), F.col("seq"))).alias("ended"))
    g = per.groupBy("response_id").agg(
        F.max("seq").alias("last_sequence"), F.coalesce(F.max(v), F.lit(0)).alias("max_version"), F.max("ended").alias("ended"),
        F.max_by(F.struct("draft_version", "started", "retracted"), "started").alias("d"))
    z = lambda c: F.coalesce(F.col(c), F.lit(-1))
    live = F.col("d.started").isNotNull() & (z("d.retracted") < F.col("d.started")) & (z("ended") < F.col("d.started"))
    return g.select("response_id", "last_sequence", "max_version", F.when(live, F.col("d.draft_version")).otherwise(0).alias("active_version"))


def transition_events(statuses: DataFrame) -> DataFrame:
    """C11. ``statuses(response_id, seq, status)`` to numbered events. A response passes through a
    handful of states, so its rows are few."""
    w = W.partitionBy("response_id").orderBy("seq")
    s = statuses.withColumn("prev", F.lag("status").over(w)).withColumn("first", F.row_number().over(w) == 1)
    kind = (F.when(F.col("status").isin("RUNNING", "CANCELING"), "progress").when(F.col("status") == "NEEDS_CLARIFICATION", "clarification_required")
            .when(F.col("status").isin(*RETRYABLE), F.lower("status")).otherwise("answer"))
    change = F.when((F.col("status") != "QUEUED") & ~F.col("prev").eqNullSafe(F.col("status")), kind)
    ev = F.array_compact(F.array(F.when(F.col("first"), F.struct(F.lit("accepted").alias("type"), F.lit("QUEUED").alias("status"))),
                                 F.when(change.isNotNull(), F.struct(change.alias("type"), F.col("status").alias("status")))))
    e = s.select("response_id", "seq", F.posexplode(ev).alias("pos", "e"))
    return e.select("response_id", F.row_number().over(W.partitionBy("response_id").orderBy("seq", "pos")).cast("bigint").alias("sequence"), "e.type", "e.status")


def draft_text(events: DataFrame, max_bytes: int = 524288) -> tuple[DataFrame, DataFrame]:
    """C12. The text of each response's active draft, and the drafts over the limit. Sizes are summed
    first, so only drafts within the limit are gathered."""
    active = draft_state(events).where("active_version > 0").select("response_id", F.col("active_version").alias("draft_version"))
    d = events.where("type = 'answer_delta'").join(active, ["response_id", "draft_version"])
    size = d.groupBy("response_id", "draft_version").agg(F.sum(F.octet_length("delta")).alias("bytes"))
    big = size.where(F.col("bytes") > max_bytes)
    ok = d.join(size.where(F.col("bytes") <= max_bytes), ["response_id", "draft_version"])
    text = ok.groupBy("response_id", "draft_version").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("xs"), F.first("bytes").alias("bytes"))
    return text.select("response_id", "draft_version", "bytes", F.array_join(F.transform("xs", lambda x: x["delta"]), "").alias("text")), big


def replay_after(events: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C13. Events after each reader's cursor, and the cursors that are ahead of their response."""
    last = events.groupBy("response_id").agg(F.max("seq").alias("last"))
    c = cursors.join(last, "response_id", "left").fillna(0, ["last"])
    ok = c.where(F.col("after") <= F.col("last")).select("reader_id", "response_id", "after")
    out = events.join(ok, "response_id").where(F.col("seq") > F.col("after"))
    return out.select("reader_id", "response_id", "seq"), c.where(F.col("after") > F.col("last")).select("reader_id", "response_id")


def attempt_limits(executions: DataFrame, chunk: str, attempts: int = 3, queue: int = 20) -> DataFrame:
    """C14. ``executions(execution_id, response_id, opened, closed, pool)`` that should have been refused:
    beyond the attempts of their response, or opened while the queue was full."""
    rank = running(executions, ["response_id"], chunk, ["opened", "execution_id"], {"before": ("count", "execution_id")})
    over = rank.where(F.col("before") >= attempts).select("execution_id", F.lit("ATTEMPTS").alias("reason"))
    ch = executions.select("pool", F.explode(F.array(F.struct(F.col("opened").alias("at"), F.lit(1).alias("d")), F.struct(F.col("closed").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    net = ch.groupBy("pool", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).withColumn("day", F.to_date("at"))
    open_ = running(net, ["pool"], "day", ["at"], {"queued": ("sum", "d")}).select("pool", F.col("at").alias("opened"), "queued")
    full = executions.join(open_, ["pool", "opened"]).where(F.col("queued") >= queue).select("execution_id", F.lit("QUEUE").alias("reason"))
    return over.unionByName(full)


def cited(revs: DataFrame, citations: DataFrame, reviews: DataFrame) -> DataFrame:
    """C15. Revisions that some citation or review refers to."""
    used = citations.select("revision_id").unionByName(reviews.select("revision_id")).distinct()
    return revs.select("revision_id").join(used, "revision_id", "left_semi")


