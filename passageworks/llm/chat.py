"""Chat formatting by a grammar round trip, as DataFrame expressions only.

Grammar of the output, one conversation a string:

    conversation := turn*
    turn         := "<s>[" tag "]" payload "</s>"
    tag          := role with "\\" and "]" and line ends escaped
    payload      := text without a bare control string

Control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. A user turn's payload stands
between ``[INST] `` and `` [/INST]``. The parser is deterministic: it cuts at ``</s>``, reads the tag, takes the
wrapper off and removes one backslash from every control string that has one behind its first
character. A turn is first rendered as it is; what the parser reads back is compared with the
source, and a turn that comes back different is rendered again with one backslash more in each
control string it holds. Escaping adds and parsing removes exactly one, so the second comparison
always holds; ``format_turns`` still makes it and fails the task otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inside a text: a control string, or one that was escaped any number of times.
_BARE = r"([<\[])(\\*)((?:/?s>)|(?:/?INST\]))"
_ESCAPED = r"([<\[])\\(\\*)((?:/?s>)|(?:/?INST\]))"
END = "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _tag(role: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("]", "\\c"), ("<", "\\l"), ("\n", "\\n")):
        role = F.replace(role, F.lit(raw), F.lit(safe))
    return role


def _role(tag: Column) -> Column:
    """The inverse of ``_tag``: doubled backslashes are set aside as "]", which no tag holds bare."""
    tag = F.replace(tag, F.lit("\\\\"), F.lit("]"))
    for raw, safe in (("\n", "\\n"), ("<", "\\l")):
        tag = F.replace(tag, F.lit(safe), F.lit(raw))
    pieces = F.split(tag, r"\\c")
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("]"), F.lit("\\"))), "]")


def render(role: Column, payload: Column) -> Column:
    return F.concat(F.lit("<s>["), _tag(role), F.lit("]"),
                    F.when(role == "user", F.concat(F.lit("[INST] "), payload, F.lit(" [/INST]"))).otherwise(payload), F.lit(END))


def parse(rendered: Column) -> Column:
    """The turns of a rendered string as array<struct<role, text>>; what isn't a turn gives a null role."""
    bodies = F.split(rendered, END)

    def turn(b: Column) -> Column:
        tag = F.regexp_extract(b, r"(?s)^<s>\[([^\]]*)\]", 1)
        bare = F.substr(b, F.length(tag) + 6)
        role = F.when(F.startswith(b, F.lit("<s>[")), _role(tag))
        inner = F.when(
            (role == "user") & F.startswith(bare, F.lit("[INST] ")) & F.endswith(bare, F.lit(" [/INST]")) & (F.length(bare) >= 15),
            F.substr(bare, F.lit(8), F.length(bare) - 15)).otherwise(bare)
        return F.struct(role.alias("role"), unescape(inner).alias("text"), F.regexp_count(inner, F.lit(r"<s>|\[/?INST\]")).alias("stray"))

    return F.transform(F.slice(bodies, F.lit(1), F.greatest(F.size(bodies) - 1, F.lit(0))), turn)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One rendered string per row of (conv_id, turn, role, text), null role or text as empty.

    Rows are rendered where they lie; nothing is grouped here. Other columns are not carried."""
    c = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def same(rendered: Column) -> Column:
        back = parse(rendered)
        return (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")) & (back[0]["stray"] == 0)

    plain = c.withColumn("_raw", render(F.col("role"), F.col("text")))
    second = render(F.col("role"), escape(F.col("text")))
    chosen = plain.withColumn("rendered", F.when(F.coalesce(same(F.col("_raw")), F.lit(False)), F.col("_raw")).otherwise(second))
    checked = F.when(F.coalesce(same(F.col("rendered")), F.lit(False)), F.col("rendered")).otherwise(
        F.raise_error(F.lit("a turn does not survive the round trip")))
    return chosen.select("conv_id", "turn", "role", checked.alias("rendered"))


def format_conversations(conversations: DataFrame, run: int = 64) -> DataFrame:
    """``(conv_id, formatted)``: each conversation's turns in the order of turn, ties by role and text.

    Turns of up to ``run`` consecutive numbers are joined first, so a conversation with very many
    turns reaches its last task as few strings; its text, which is the result itself, moves once.
    Null conversation ids form one conversation, null turn numbers come first. No rows: no rows."""
    t = format_turns(conversations).withColumn("_run", F.floor(F.col("turn") / run))
    joined = t.groupBy("conv_id", "_run").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "rendered"))), lambda x: x["rendered"]), "").alias("_s"))
    return joined.groupBy("conv_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_run", F.lit(-(1 << 62))).alias("r"), "_s"))), lambda x: x["_s"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of ``(conv_id, formatted)`` as the parser sees them, with the loss mask: the
    texts of assistant turns."""
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns")).withColumn(
        "loss_text", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""))
