"""Device observations, threshold rules and diagnosis steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passageworks.functions.text import SPACE_CLASS, canonical_json, sha, strip
from passageworks.operators.knowledge import first_reason

# Capabilities, comparison operators and observation states.
CAPABILITIES = ("metrics", "alerts", "logs")
OPERATORS = ("EQ", "GT", "GE", "LT", "LE")
STATES = ("OK", "NO_RECORD", "PARTIAL", "FAILED", "STALE", "UNSUPPORTED")


def _seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def _bad_parameters(c: str) -> Column:
    e = F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>")))
    return (F.size(e) > 16) | F.exists(e, lambda x: (strip(x["key"]) == "") | (F.octet_length(x["key"]) > 100) | (F.octet_length(x["value"]) > 1000))


def validate_requests(req: DataFrame, now: Column) -> DataFrame:
    """V1. Requests with the first reason against them."""
    span = _seconds(F.col("window_end")) - _seconds(F.col("window_start"))
    reason = first_reason(
        (~F.col("capability").isin(*CAPABILITIES), "CAPABILITY"),
        ((F.size("fields") < 1) | (F.size("fields") > 16), "FIELD_COUNT"), (F.octet_length("component") > 200, "COMPONENT"),
        ((span <= 0) | (span > 86400) | (_seconds(F.col("window_end")) > _seconds(now) + 5), "WINDOW"),
        ((F.col("max_age_seconds") < 1) | (F.col("max_age_seconds") > 86400), "MAX_AGE"), (_bad_parameters("parameters"), "PARAMETERS"),
        (F.exists("fields", lambda f: (strip(f) == "") | (F.octet_length(f) > 100)) | (F.size(F.array_distinct("fields")) < F.size("fields")), "FIELD"))
    return req.select("request_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def validate_observations(headers: DataFrame, values: DataFrame) -> DataFrame:
    """V2. Headers with ``valid``; an invalid observation becomes FAILED, and its values count for nothing."""
    v = values.join(headers.select("evidence_id", "fields", "window_start", "window_end"), "evidence_id")
    bad = (~F.array_contains("fields", F.col("field")) | (F.col("value") == "") | (F.octet_length("value") > 4000) | (strip(F.col("unit")) == "")
           | (F.octet_length("unit") > 100) | (F.col("observed_at") < F.col("window_start")) | (F.col("observed_at") > F.col("window_end")))
    # ``found`` is at most the 16 requested fields plus wrong ones, and one wrong field already decides.
    g = v.groupBy("evidence_id").agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad"),
        F.collect_set(F.when(F.array_contains("fields", F.col("field")), F.col("field"))).alias("found"))
    j = headers.join(g, "evidence_id", "left").fillna(0, ["n"]).fillna(False, ["bad"]).withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    lacking = F.array_except("fields", "found")
    s = F.col("status")
    wrong = (
        ~s.isin(*STATES) | ~F.col("identity_ok") | ~(F.col("window_start") == F.col("echo_start")) | ~(F.col("window_end") == F.col("echo_end"))
        | (strip(F.col("source")) == "") | (strip(F.col("raw_ref")) == "") | (F.octet_length("source") > 2000) | (F.octet_length("raw_ref") > 2000)
        | (F.col("n") > 256) | (s.isin("FAILED", "UNSUPPORTED", "NO_RECORD") & (F.col("n") > 0)) | F.col("bad")
        | (s.isin("OK", "PARTIAL", "STALE") & (F.col("n") == 0)) | ((s == "OK") & (F.size(lacking) > 0))
        | ((s == "PARTIAL") & (F.size(F.array_except(lacking, "missing")) > 0)) | (F.size(F.array_except("missing", "fields")) > 0)
        | F.arrays_overlap("missing", "found") | ((F.size("missing") > 0) & (s == "OK")))
    return j.withColumn("valid", ~F.coalesce(wrong, F.lit(True))).withColumn("status", F.when(F.col("valid"), s).otherwise("FAILED")).drop("bad", "found", "n")


def freshness(evidence: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """V3. ``fresh`` if window end and every sample are within the maximal age; otherwise OK, PARTIAL
    and NO_RECORD become STALE."""
    oldest = values.groupBy("evidence_id").agg(F.min("observed_at").alias("oldest"))
    j = evidence.join(oldest, "evidence_id", "left")
    cutoff = _seconds(now) - F.col("max_age_seconds")
    fresh = (_seconds(F.col("window_end")) >= cutoff) & F.coalesce(_seconds(F.col("oldest")) >= cutoff, F.lit(True))
    j = j.withColumn("fresh", fresh)
    return j.withColumn("status", F.when(~F.col("fresh") & F.col("status").isin("OK", "PARTIAL", "NO_RECORD"), "STALE").otherwise(F.col("status"))).drop("oldest")


#: A whole decimal or hexadecimal number, digits parted by single underscores or not; a cast alone would also take surrounding
#: blanks, line ends and type suffixes.
_D, _H = "[0-9](_?[0-9])*", "[0-9a-fA-F](_?[0-9a-fA-F])*"
DECIMAL = rf"({_D}(\.({_D})?)?|\.{_D})([eE][+-]?{_D})?"
HEXADECIMAL = rf"0[xX](_?{_H}(\.({_H})?)?|\.{_H})[pP][+-]?{_D}"
NUMBER = rf"\A[+-]?({DECIMAL}|{HEXADECIMAL})\z"


def number(c: Column) -> Column:
    """The finite number that a text is, or null."""
    n = F.when(c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit(""))).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def compare(value: Column, op: Column, want: Column) -> Column:
    """V4. EQ compares text; the other operators need two finite numbers."""
    a, b = number(value), number(want)
    num = F.when(op == "GT", a > b).when(op == "GE", a >= b).when(op == "LT", a < b).when(op == "LE", a <= b)
    return F.when(op == "EQ", value == want).otherwise(F.coalesce(num, F.lit(False)))


def parameters_key(c: str) -> Column:
    """A parameter map as text that can be joined on; no map and an empty map are the same."""
    return F.coalesce(canonical_json(F.col(c)), F.lit("[]"))


def conditions_hold(conditions: DataFrame, evidence: DataFrame, values: DataFrame, incidents: DataFrame, cited: DataFrame, now: Column) -> DataFrame:
    """V5. Per (run, rule): do all conditions hold on the newest samples?

    ``conditions(run_id, rule_id, cond_no, capability, component, params, field, operator, value, unit,
    max_age_seconds)``; ``evidence`` is already usable (OK, fresh, of the run's device and mode). Samples
    are reduced to one row per (condition, evidence) before anything else, so the newest time comes from
    those few rows and no window over the samples is needed."""
    v = evidence.select("evidence_id", "run_id", "capability", "component", "params").join(
        values.select("evidence_id", "field", F.col("value").alias("have"), F.col("unit").alias("have_unit"), "observed_at"), "evidence_id")
    c = conditions.join(incidents.select("run_id", "occurred_at"), "run_id")
    j = v.join(c, ["run_id", "capability", "component", "params", "field"])
    ok = ((F.col("observed_at") >= F.col("occurred_at")) & (_seconds(F.col("observed_at")) >= _seconds(now) - F.col("max_age_seconds"))
          & (F.col("have_unit") == F.col("unit")) & compare(F.col("have"), F.col("operator"), F.col("value")))
    key = ["run_id", "rule_id", "cond_no"]
    per = j.groupBy(*key, "evidence_id").agg(F.max("observed_at").alias("last"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_ok"))
    newest = per.groupBy(*key).agg(F.max("last").alias("newest"))
    cite = cited.select("run_id", "rule_id", "evidence_id", F.lit(True).alias("cited")).distinct()
    at = per.join(newest, key).where(F.col("last") == F.col("newest")).join(cite, ["run_id", "rule_id", "evidence_id"], "left")
    met = at.groupBy(*key).agg((F.bool_and("all_ok") & F.bool_or(F.coalesce("cited", F.lit(False)))).alias("met"))
    return conditions.select(*key).distinct().join(met, key, "left").groupBy("run_id", "rule_id").agg(
        F.bool_and(F.coalesce("met", F.lit(False))).alias("holds"))


def confirm(hypotheses: DataFrame, rules: DataFrame, holds: DataFrame) -> DataFrame:
    """V6. CONFIRMED needs a published ROOT_CAUSE rule of the incident's error code and conclusion whose
    conditions hold, RECOVERED a RECOVERY rule; other claims of those states are refused."""
    j = hypotheses.join(rules.select("rule_id", "kind", "error_code", F.col("conclusion").alias("rule_conclusion"), "published"), "rule_id", "left").join(
        holds, ["run_id", "rule_id"], "left")
    base = F.coalesce("published", F.lit(False)) & (F.col("error_code") == F.col("incident_code")) & F.coalesce("holds", F.lit(False))
    ok = (F.when(F.col("status") == "CONFIRMED", base & (F.col("kind") == "ROOT_CAUSE") & (F.col("rule_conclusion") == F.col("conclusion")))
          .when(F.col("status") == "RECOVERED", base & (F.col("kind") == "RECOVERY")).otherwise(F.lit(True)))
    return j.select("run_id", "hypothesis_id", "status", F.coalesce(ok, F.lit(False)).alias("accepted"))


def root_status(hypotheses: DataFrame) -> DataFrame:
    """V7. CONFIRMED over SUPPORTED over UNKNOWN."""
    level = F.max(F.when(F.col("status") == "CONFIRMED", 2).when(F.col("status") == "SUPPORTED", 1).otherwise(0))
    return hypotheses.groupBy("run_id").agg(level.alias("l")).select(
        "run_id", F.when(F.col("l") == 2, "CONFIRMED").when(F.col("l") == 1, "SUPPORTED").otherwise("UNKNOWN").alias("root_status"))


def bad_condition() -> Column:
    """V8. Whether a condition row is invalid."""
    c = F.col
    bad = (~c("capability").isin(*CAPABILITIES) | ~c("operator").isin(*OPERATORS) | (strip(c("field")) == "") | (F.octet_length("field") > 100)
           | (F.octet_length("component") > 200) | (c("value") == "") | (F.octet_length("value") > 4000) | (strip(c("unit")) == "")
           | (F.octet_length("unit") > 100) | (c("max_age_seconds") < 1) | (c("max_age_seconds") > 86400) | _bad_parameters("parameters")
           | ((c("operator") != "EQ") & number(c("value")).isNull()))
    return F.coalesce(bad, F.lit(True))


def validate_rules(rules: DataFrame, conditions: DataFrame, frags: DataFrame) -> DataFrame:
    """V8. Rules with the first reason against them. A rule must lie inside one fragment: both its end
    lines are looked up by equality, and some fragment must have them both. Parts of a long line share it."""
    per = rules.groupBy("revision_id").agg(F.count("*").alias("in_revision"))
    twice = rules.groupBy("revision_id", "rule_id").agg(F.count("*").alias("copies"))
    cond = conditions.groupBy("revision_id", "rule_id").agg(F.count("*").alias("n"), F.bool_or(bad_condition()).alias("bad"))
    own = frags.select("revision_id", "fragment_id", F.explode(F.sequence("start_line", "end_line")).alias("l"))
    span = ["revision_id", "start_line", "end_line"]
    a, b = (own.select("revision_id", "fragment_id", F.col("l").alias(c)) for c in ("start_line", "end_line"))
    inside = (rules.select(*span).distinct().join(a, ["revision_id", "start_line"]).join(b, ["revision_id", "end_line", "fragment_id"], "left_semi")
              .select(*span, F.lit(True).alias("inside")).distinct())
    j = (rules.join(per, "revision_id").join(twice, ["revision_id", "rule_id"]).join(cond, ["revision_id", "rule_id"], "left")
         .join(inside, span, "left"))
    reason = first_reason(
        (F.col("in_revision") > 32, "TOO_MANY"), ((F.col("rule_id") == "") | (F.octet_length("rule_id") > 100) | (F.col("copies") > 1), "ID"),
        (~F.col("kind").isin("ROOT_CAUSE", "RECOVERY"), "KIND"),
        ((strip(F.col("error_code")) == "") | (F.octet_length("error_code") > 200) | (strip(F.col("conclusion")) == "") | (F.octet_length("conclusion") > 2000), "TEXT"),
        ((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "LINES"),
        ((F.coalesce("n", F.lit(0)) == 0) | (F.coalesce("n", F.lit(0)) > 16), "CONDITIONS"),
        (F.col("inside").isNull(), "FRAGMENT"), (F.col("bad"), "CONDITION"))
    return j.select("revision_id", "rule_id", reason.alias("reason")).where(F.col("reason").isNotNull()).distinct()


def ready_steps(steps: DataFrame, executions: DataFrame, preconditions: DataFrame) -> DataFrame:
    """V9. Steps not executed yet whose dependencies all succeeded and whose preconditions hold."""
    done = executions.where(F.col("status").isin("SUCCEEDED", "REUSED")).select("run_id", F.col("step_id").alias("dep"))
    deps = steps.select("run_id", "step_id", F.explode("depends_on").alias("dep"))
    waiting = deps.join(done, ["run_id", "dep"], "left_anti").select("run_id", "step_id")
    blocked = preconditions.where(~F.col("holds")).select("run_id", "step_id")
    key = ["run_id", "step_id"]
    return steps.select(*key).join(executions.select(*key), key, "left_anti").join(waiting, key, "left_anti").join(blocked, key, "left_anti")


def check_steps(steps: DataFrame, executions: DataFrame | None = None, cap: int = 30) -> DataFrame:
    """V10. Plans with too many steps, dependencies that are neither planned nor succeeded, and cycles.

    A plan has at most ``cap`` steps, so after larger ones are set aside a plan fits one row; there
    steps without remaining dependencies are peeled off ``cap`` times, and what is left is cyclic."""
    n = steps.groupBy("run_id").agg(F.count("*").alias("n"))
    big = n.where(F.col("n") > cap).select("run_id", F.lit(None).cast("string").alias("step_id"), F.lit("TOO_MANY").alias("reason"))
    s = steps.join(n.where(F.col("n") <= cap).select("run_id"), "run_id", "left_semi")
    deps = s.select("run_id", "step_id", F.explode("depends_on").alias("dep"))
    unknown = deps.join(s.select("run_id", F.col("step_id").alias("dep")), ["run_id", "dep"], "left_anti")
    if executions is not None:
        unknown = unknown.join(executions.where(F.col("status").isin("SUCCEEDED", "REUSED")).select("run_id", F.col("step_id").alias("dep")), ["run_id", "dep"], "left_anti")
    unknown = unknown.select("run_id", F.col("step_id").cast("string"), F.lit("UNKNOWN_DEPENDENCY").alias("reason")).distinct()
    plan = s.groupBy("run_id").agg(F.collect_list(F.struct("step_id", "depends_on")).alias("left"))

    def peel(left: Column, _round: Column) -> Column:
        ids = F.transform(left, lambda x: x["step_id"])
        return F.filter(left, lambda x: F.arrays_overlap(x["depends_on"], ids))

    rest = plan.where(F.size(F.aggregate(F.sequence(F.lit(1), F.lit(cap)), F.col("left"), peel)) > 0)
    return big.unionByName(unknown).unionByName(rest.select("run_id", F.lit(None).cast("string").alias("step_id"), F.lit("CYCLE").alias("reason")))


def fingerprint(kind: Column, target: Column, query: Column, observation: Column) -> Column:
    """V11. Identity of what a step asks: kind, target, query without case and spacing, observation."""
    q = F.lower(strip(F.regexp_replace(query, f"[{SPACE_CLASS}]+", " ")))
    return sha(F.to_json(F.struct(kind.alias("kind"), target.alias("target"), q.alias("query"), observation.alias("observation")), {"ignoreNullFields": "false"}))


def repeated_steps(steps: DataFrame, executions: DataFrame, reusable_ids: DataFrame | None = None) -> DataFrame:
    """V11. Planned steps that ask again what another step of the run asked, without a retry reason."""
    fp = lambda d: d.withColumn("fp", fingerprint(F.col("kind"), F.col("target"), F.col("query"), F.col("observation")))
    old = fp(executions).select("run_id", "fp", F.col("step_id").alias("old_step"))
    new = fp(steps).where(strip(F.coalesce("retry_reason", F.lit(""))) == "").select("run_id", "fp", "step_id")
    out = new.join(old, ["run_id", "fp"]).where("step_id <> old_step")
    if reusable_ids is not None:
        out = out.join(reusable_ids.select("run_id", "old_step"), ["run_id", "old_step"], "left_anti")
    return out.select("run_id", "step_id").distinct()


def reusable(requests: DataFrame, evidence: DataFrame, query_key: str) -> DataFrame:
    """V12. The newest evidence that answers an identical whole query; ``evidence`` has ``fresh`` from V3."""
    e = evidence.where(F.col("status").isin("OK", "NO_RECORD") & F.col("fresh")).groupBy(query_key).agg(
        F.max_by("evidence_id", F.struct("window_end", "evidence_id")).alias("evidence_id"))
    return requests.join(e, query_key).select("request_id", "evidence_id")


def no_progress(executions: DataFrame) -> DataFrame:
    """V13. Executions that reuse after two reuses in a row. A run has at most its budget of tool calls."""
    w = W.partitionBy("run_id").orderBy("ordinal")
    r = F.col("status") == "REUSED"
    x = executions.select("run_id", "ordinal", r.alias("r"), F.lag(r, 1).over(w).alias("a"), F.lag(r, 2).over(w).alias("b"))
    return x.where("r AND a AND b").select("run_id", "ordinal")


def budget(events: DataFrame, active_ms: int = 300000, tools: int = 30, models: int = 20) -> DataFrame:
    """V15. What a run has used (active time is cut at its limit) and whether that exhausts it."""
    g = events.groupBy("run_id").agg(
        F.least(F.lit(active_ms).cast("bigint"), F.sum(F.greatest(F.coalesce("active_ms", F.lit(0)), F.lit(0))).cast("bigint")).alias("active_used_ms"),
        F.count_if(F.col("kind") == "TOOL").alias("tool_calls"), F.count_if(F.col("kind") == "MODEL").alias("model_calls"))
    return g.withColumn("exhausted", (F.col("active_used_ms") >= active_ms) | (F.col("tool_calls") >= tools) | (F.col("model_calls") >= models))


def rules_for_fragments(rules: DataFrame, hits: DataFrame, max_bytes: int = 49152) -> tuple[DataFrame, DataFrame]:
    """V17. Retrieved fragments in order until the first that would pass the byte limit (no skipping),
    and the rules that lie inside the kept fragments. A query has a few dozen hits at most."""
    w = W.partitionBy("run_id").orderBy("ordinal")
    x = hits.withColumn("total", F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = x.where(F.col("total") <= max_bytes)
    r = rules.select("revision_id", "rule_id", F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    inside = kept.select("run_id", "fragment_id", "revision_id", "start_line", "end_line").withColumn("r_start", F.explode(F.sequence("start_line", "end_line")))
    att = inside.join(r, ["revision_id", "r_start"]).where((F.col("r_end") <= F.col("end_line")) & (F.col("r_end") >= F.col("r_start")))
    return kept, att.select("run_id", "fragment_id", "rule_id")


def invalidate(runs: DataFrame, snapshots: DataFrame, executions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V18. Runs whose device has another snapshot now lose knowledge, hypotheses and result; running
    executions become INTERRUPTED."""
    j = runs.join(snapshots.select("device_id", F.col("snapshot_id").alias("current")), "device_id", "left")
    changed = F.coalesce(F.col("current") != F.col("snapshot_id"), F.lit(False))
    out = j.select("run_id", "device_id", F.coalesce("current", "snapshot_id").alias("snapshot_id"), changed.alias("invalidated"))
    ex = executions.withColumn("status", F.when(F.col("status") == "RUNNING", "INTERRUPTED").otherwise(F.col("status")))
    return out, ex
