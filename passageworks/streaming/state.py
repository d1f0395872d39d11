"""Keyed state on streams (X1-X3, X5, X7) and the watermark operators.

Rows of one key and micro-batch are put in order before they meet the state; a micro-batch is
bounded by the source's own options (files or offsets per trigger). Late-data rules are this
library's own and are stated with each function. A stream that runs for ever passes ``ttl_ms`` (a
week, say), after which a silent key is forgotten; that needs processing time, with which a run to
the end of the input never ends, so it is off by default.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passageworks.operators.conversations import TERMINAL_EVENTS
from passageworks.operators.observations import number



def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(by, kind="stable")


class _Keyed(StatefulProcessor):
    """A processor with one value state, optionally with a time to live."""

    columns = ""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.columns, self.ttl_ms)


def _run(df: DataFrame, keys: list[str], processor: _Keyed | _Intake, schema: str) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(schema), outputMode="Update",
        timeMode="ProcessingTime" if processor.ttl_ms else "None")


BUCKETS = 4096  # keys of a bucket are read and written together


def buckets_for(rows: int, each: int = 1024) -> int:
    """Buckets of about so many rows of the whole input, if their number is known."""
    return max(64, -(-rows // each))


def _bucket(buckets: int, *keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


class _Response:
    """Last sequence, active draft and its size, events that wait (by sequence) for the ones before them, the sequences given
    up (first to last); of a response that has ended only its last sequence and when it is forgotten."""

    __slots__ = ("last", "active", "size", "gone", "waiting", "skipped")

    def __init__(self, last: int = 0, active: int = 0, size: int = 0, gone: int | None = None) -> None:
        self.last, self.active, self.size, self.gone = last, active, size, gone
        self.waiting: dict[int, tuple] = {}
        self.skipped: dict[int, int] = {}

    def due(self) -> int | None:
        return self.gone if self.gone is not None else min((v[3] for v in self.waiting.values()), default=None)

    def take(self, name, seq: int, kind, version: int, size: int, at: int, out: list) -> None:
        if seq > self.last:
            if self.gone is not None:
                out.append((name, seq, kind, 0, 0, True, True))
            else:
                self.waiting.setdefault(seq, (kind, version, size, at))
            return
        gap = next(((a, z) for a, z in self.skipped.items() if a <= seq <= z), None)
        if gap:  # it was given up; a repeated delivery of any other event is dropped
            out.append((name, seq, kind, self.active, self.size, False, True))
            del self.skipped[gap[0]]
            for a, z in ((gap[0], seq - 1), (seq + 1, gap[1])):
                if a <= z:
                    self.skipped[a] = z

    def go(self, name, until: int, keep_ms: int, out: list) -> None:
        """Let waiting events go in order: those without a gap before them, and, gap or not, those that
        are followed by or are an event of a time up to ``until`` (milliseconds). What waits behind the end is refused."""
        due = max([seq for seq, v in self.waiting.items() if v[3] <= until], default=0)
        for seq in sorted(self.waiting):
            kind, version, n, at = self.waiting[seq]
            if self.gone is not None:
                out.append((name, seq, kind, 0, 0, True, True))
                continue
            if seq > self.last + 1:
                if seq > due:
                    break
                self.skipped[self.last + 1] = seq - 1
            self.last = seq
            if kind == "draft_started":
                self.active, self.size = version, 0
            elif kind == "draft_retracted" and version == self.active:
                self.active, self.size = 0, 0
            elif kind == "answer_delta" and version == self.active:
                self.size += n
            elif kind in TERMINAL_EVENTS:
                self.active, self.size, self.gone = 0, 0, at + keep_ms
            del self.waiting[seq]
            out.append((name, seq, kind, self.active, self.size, self.gone is not None, False))
        if self.gone is not None:
            self.waiting, self.skipped = {}, {}


class _Lifecycle(StatefulProcessor):
    """The responses of a bucket, and one timer at the first time at which one of them has something to do."""

    columns = ("last long, active long, bytes long, gone long, seqs array<long>, types array<string>, versions array<long>, sizes array<long>, ats array<long>, "
               "firsts array<long>, tos array<long>")

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "due long")
        self.responses = handle.getMapState("responses", "id string", self.columns)

    def _load(self) -> dict:
        held = {}
        if self.timer.exists():
            for (name,), (last, active, size, gone, seqs, types, versions, sizes, ats, firsts, tos) in self.responses.iterator():
                r = held[name] = _Response(int(last), int(active), int(size), None if gone is None or gone != gone else int(gone))
                r.waiting = {int(seq): (kind, int(v), int(n), int(at)) for seq, kind, v, n, at in zip(seqs, types, versions, sizes, ats)}
                r.skipped = {int(a): int(z) for a, z in zip(firsts, tos)}
        return held

    def _save(self, held: dict, touched, expired: bool = False) -> None:
        for name in touched:
            r = held[name]
            events = zip(*[(seq, *v) for seq, v in r.waiting.items()]) if r.waiting else [()] * 5
            self.responses.updateValue((name,), (r.last, r.active, r.size, r.gone, *[list(x) for x in events], list(r.skipped), list(r.skipped.values())))
        before = self.timer.get()[0] if self.timer.exists() and not expired else None
        due = min((t for t in (r.due() for r in held.values()) if t is not None), default=None)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.timer.update((due,))
        else:
            self.timer.clear()

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held, out, touched = self._load(), [], {}
        d = _ordered(rows, ["seq"])
        for name, seq, kind, version, n, at in zip(*[d[c].tolist() for c in ("response_id", "seq", "type", "version", "size", "ms")]):
            r = touched[name] = held.setdefault(name, _Response())
            r.take(name, seq, kind, version, n, at, out)
        for name, r in touched.items():
            if r.gone is None:
                r.go(name, -1, self.keep_ms, out)
        self._save(held, touched)
        yield pd.DataFrame(out, columns=LIFECYCLE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        held, out, touched = self._load(), [], []
        for name, r in list(held.items()):
            if r.due() is None or r.due() > now:
                continue
            if r.gone is None:
                r.go(name, now, self.keep_ms, out)
                touched.append(name)
            else:
                self.responses.removeKey((name,))
                del held[name]
        self._save(held, touched, expired=True)
        yield pd.DataFrame(out, columns=LIFECYCLE)


LIFECYCLE = ["response_id", "seq", "type", "active_version", "bytes", "closed", "refused"]


def response_events_stream(events: DataFrame, late: str = "10 minutes", keep_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """X1. Every event once, in order of its sequence from 1, with the active draft and its size after it.

    ``events(response_id, seq, type, draft_version, delta, at)``. An event whose predecessors are missing
    waits for them, at most until the watermark (newest ``at`` less ``late``) passes its own time; then the
    gap is given up, and what arrives for it later is returned as ``refused``. Repeated events are dropped,
    and so are, by Spark's own rule, events whose time lies before the watermark.

    A terminal event ends its response: events behind it are returned as ``refused``, whatever waited or was given up leaves
    the state at once, and the rest of the state when the watermark has passed the terminal event's time by ``keep_ms``. Later
    than that a response id is a new response.

    Responses have their states in so many ``buckets``: a call and state rows for each would cost far more than what they do."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    e = events.withColumn("at", F.col("at").cast("timestamp")).select(
        _bucket(buckets, "response_id"), "response_id", "seq", "type", zero(F.col("draft_version")).alias("version"), zero(F.octet_length("delta")).alias("size"),
        F.unix_millis("at").alias("ms"), "at").withWatermark("at", late)
    return e.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Lifecycle(keep_ms), outputMode="Update", timeMode="EventTime",
        outputStructType=T.StructType.fromDDL("response_id string, seq long, type string, active_version long, bytes long, closed boolean, refused boolean"))


class _Newest(_Keyed):
    columns = "observed_at long"

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        d = _ordered(rows, ["arrival"])
        seen = self.state.get()[0] if self.state.exists() else None
        before = d["observed_at"].cummax().shift()
        if seen is not None:
            before = before.fillna(seen).clip(lower=seen)
        self.state.update((int(max(d["observed_at"].max(), seen if seen is not None else d["observed_at"].max())),))
        yield pd.DataFrame({"device_id": key[0], "arrival": d["arrival"].to_numpy(), "observed_at": d["observed_at"].to_numpy(),
                            "accepted": ~(d["observed_at"] <= before).to_numpy()})


def newest_snapshots_stream(arrivals: DataFrame) -> DataFrame:
    """X2. Each arrival with whether it is newer than all before it."""
    return _run(arrivals.select("device_id", "arrival", "observed_at"), ["device_id"], _Newest(), "device_id long, arrival long, observed_at long, accepted boolean")


def _windows(ts, span: int, count: int, until: int) -> tuple[list[int], int, int]:
    """Number of each attempt in its window; the first attempt at or after the end opens a new one."""
    out = []
    for t in ts:
        count, until = (1, t + span) if count == 0 or until <= t else (count + 1, until)
        out.append(count)
    return out, count, until


class _Attempts(StatefulProcessor):
    """Count and end of the open window; a timer at its end removes both."""

    def __init__(self, span: int) -> None:
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "count long, until long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        d = _ordered(rows, ["at", "attempt_id"])
        count, until = self.state.get() if self.state.exists() else (0, 0)
        before = int(until)
        n, count, until = _windows([int(t) for t in d["at"]], self.span, int(count), before)
        self.state.update((count, until))
        if until != before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-until // 1000))
        yield pd.DataFrame({"key": key[0], "attempt_id": d["attempt_id"].to_numpy(), "at": d["at"].to_numpy(), "attempt": n})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def attempt_windows_stream(attempts: DataFrame, span_us: int = 900_000_000, late: str = "10 minutes") -> DataFrame:
    """X3. ``attempts(key, attempt_id, at in microseconds)`` with their number in a window that the first
    attempt opens for 15 minutes and nothing extends. Limits compare ``attempt`` with 30 or 5.

    A window's state leaves the store when the watermark (newest ``at`` less ``late``) has passed its end: attempts that
    come after that lie in a later window anyway, and attempts from before the watermark are dropped by Spark's own rule."""
    a = attempts.select("key", "attempt_id", "at", F.timestamp_micros("at").alias("time")).withWatermark("time", late)
    return a.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Attempts(span_us), outputMode="Update", timeMode="EventTime", outputStructType=T.StructType.fromDDL("key string, attempt_id long, at long, attempt long"))


NEVER = -(1 << 62)


def _chain(t: np.ndarray, span: int, first: int) -> np.ndarray:
    """Places of the attempts that open a window, from the one at ``first`` on."""
    out = []
    while first < len(t):
        out.append(first)
        first = int(np.searchsorted(t, t[first] + span))
    return np.array(out, np.int64)


def attempt_windows(attempts: DataFrame, span_us: int = 900_000_000, chunk_us: int | None = None) -> DataFrame:
    """X3 in batch, as a scan over composed transitions.

    A key's time is cut into chunks of many windows. What a chunk does to a window that is open when it begins depends
    only on where that one ends, so each chunk becomes a map from the first attempt that opens a window of its own to the end of
    the chunk's last window: entries for the attempts of its first span only. The maps, a small share of the rows, are
    applied one after the other per key; then all chunks number their attempts at the same time."""
    chunk_us = chunk_us or 128 * span_us
    a = attempts.select("key", "attempt_id", F.col("at").cast("long").alias("at")).withColumn("chunk", F.floor(F.col("at") / chunk_us))

    def transitions(key, d: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(d["at"].to_numpy())
        # the attempts of the first span, and the first one behind it: a window open before ends by then
        n = min(int(np.searchsorted(t, key[1] * chunk_us + span_us)) + 1, len(t))
        after = np.searchsorted(t, t + span_us)
        end, tail = t + span_us, len(t) - np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):  # end and attempts of the last window of the chain from each attempt
            if after[i] < len(t):
                end[i], tail[i] = end[after[i]], tail[after[i]]
        keep = np.flatnonzero(np.append(True, t[1:n] != t[:n - 1]))
        return pd.DataFrame({"key": key[0], "chunk": key[1], "opens": t[keep], "ends": end[keep], "tail": tail[keep], "n": len(t)})

    maps = a.groupBy("key", "chunk").applyInPandas(transitions, "key string, chunk long, opens long, ends long, tail long, n long")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, until, count, own, done = None, NEVER, 0, 0, True
        for b in batches:
            out = []
            for k, c, opens, ends, tail, n in zip(*[b[x].tolist() for x in ("key", "chunk", "opens", "ends", "tail", "n")]):
                if cur != (k, c):
                    count += 0 if done else own  # all attempts of the chunk before lay in the open window
                    if cur is None or cur[0] != k:
                        until, count = NEVER, 0
                    cur, own, done = (k, c), n, False
                    out.append((k, c, until, count))
                if not done and opens >= until:
                    until, count, done = ends, tail, True
            yield pd.DataFrame(out, columns=["key", "chunk", "until", "count"])

    ordered = maps.repartition("key").sortWithinPartitions("key", "chunk", "opens")
    entries = ordered.mapInPandas(carry, "key string, chunk long, until long, count long")

    def number(key, d: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["at", "attempt_id"], kind="stable")
        t, n = d["at"].to_numpy(), np.arange(1, len(d) + 1)
        first = int(np.searchsorted(t, int(e["until"].iat[0])))
        n[:first] += int(e["count"].iat[0])  # these go on in the window open before
        opens = _chain(t, span_us, first)
        if len(opens):
            n[first:] -= opens[np.searchsorted(opens, np.arange(first, len(t)), side="right") - 1]
        return d.assign(attempt=n)[["key", "attempt_id", "at", "attempt"]]

    return a.groupBy("key", "chunk").cogroup(entries.groupBy("key", "chunk")).applyInPandas(number, "key string, attempt_id long, at long, attempt long")


def observation_windows(values: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """X4. Count, extremes and last value per (window, device, field), on a table or a stream.

    On a stream, values older than the watermark (newest time seen less ``late``) are dropped."""
    v = values.withWatermark("observed_at", late) if values.isStreaming else values
    w = F.window("observed_at", size, slide) if slide else F.window("observed_at", size)
    g = v.groupBy(w, "device_id", "field").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("observed_at", "value")).alias("last"))
    return g.select(F.col("window.start").alias("start"), "device_id", "field", "n", "low", "high", "last")


class _Alerts(StatefulProcessor):
    """Of each device of a bucket, in one state row: the samples of the newest time per field and what was last reported of each
    rule, each with the time until which it is remembered (2**62: for good)."""

    columns = ("fields array<string>, ats array<long>, texts array<array<string>>, numbers array<array<double>>, units array<array<string>>, kept array<long>, "
               "rules array<string>, said array<boolean>, told array<long>")

    def __init__(self, rules: dict, fields: dict, ttl_ms: int | None = None) -> None:
        self.rules, self.fields, self.ttl_ms = rules, fields, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.devices = handle.getMapState("devices", "device_id long", self.columns, self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        now: dict[int, dict[str, tuple[int, set]]] = {}
        for d in rows:
            for device, field, at, text, number, unit in zip(*[d[c].tolist() for c in ("device_id", "field", "at", "value", "number", "unit")]):
                if field not in self.fields:
                    continue
                own = now.setdefault(None if device != device else device, {})
                held = own.get(field)
                if held is None or at >= held[0]:
                    sample = (text, None if number is None or number != number else number, unit)
                    own[field] = (at, {sample} if held is None or at > held[0] else held[1] | {sample})
        out: list[tuple] = []
        for device, own in now.items():
            self._device(device, own, out)
        yield pd.DataFrame(out, columns=["device_id", "rule_id", "holds", "at"])

    def _device(self, device, own: dict, out: list) -> None:
        clock = int(time.time() * 1000)
        until = 1 << 62 if self.ttl_ms is None else clock + self.ttl_ms
        newest, said = {}, {}
        if self.devices.containsKey((device,)):
            *samples, rules, holds, told = [list(x) for x in self.devices.getValue((device,))]
            newest = {f: (at, set(zip(*map(list, lists))), z) for f, at, *lists, z in zip(*samples) if z > clock}
            said = {r: (h, z) for r, h, z in zip(rules, holds, told) if z > clock}
        touched = set()
        for field, (at, samples) in own.items():
            if field in newest:
                old, held, _ = newest[field]
                if old > at:
                    continue
                if old == at:
                    samples = samples | held
            newest[field] = (at, samples, until)
            touched |= self.fields[field]
        for rule in sorted(touched):
            got = [(newest.get(c[0]), c) for c in self.rules[rule]]
            holds = all(s is not None and all(_holds(x, c) for x in s[1]) for s, c in got)
            if rule not in said or said[rule][0] != holds:
                said[rule] = (holds, until)
                out.append((device, rule, holds, max(int(s[0]) for s, _ in got if s is not None)))
        if touched:
            lists = [[list(x) for x in zip(*sorted(s, key=str))] for _, s, _ in newest.values()]
            self.devices.updateValue((device,), (
                list(newest), [n[0] for n in newest.values()], *[[x[i] for x in lists] for i in range(3)], [n[2] for n in newest.values()],
                list(said), [h for h, _ in said.values()], [z for _, z in said.values()]))


def _holds(sample: tuple, condition: tuple) -> bool:
    """Whether a (text, number, unit) meets a (field, operator, text, number, unit), as ``observations.compare`` has it."""
    (text, a, unit), (_, op, want, b, want_unit) = sample, condition
    if text is None or want is None or unit is None or unit != want_unit:
        return False
    if op == "EQ":
        return text == want
    if a is None or b is None:
        return False
    return {"GT": a > b, "GE": a >= b, "LT": a < b, "LE": a <= b}.get(op, False)


MAX_CONDITIONS = 1_000_000  # conditions that tasks hold; more are an error, not cut


def rule_alerts_stream(values: DataFrame, conditions: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """X5. A row whenever a rule starts or stops holding on the newest samples of a device.

    ``conditions(rule_id, cond_no, field, operator, value, unit)`` is a static table of at most ``MAX_CONDITIONS`` rows, which goes
    to all tasks. Each reading meets the state of its device once, which keeps the newest samples of a field and judges there the
    rules that mention it. All samples at the newest time must agree; a condition without a sample doesn't hold. Devices have their
    states in so many ``buckets``: a call and a state row a field and rule would each cost far more than what they do."""
    c = conditions.select("rule_id", "field", "operator", "value", number(F.col("value")).alias("number"), "unit").limit(MAX_CONDITIONS + 1).collect()
    if len(c) > MAX_CONDITIONS:
        raise ValueError(f"more than {MAX_CONDITIONS} conditions")
    rules: dict[str, list] = {}
    fields: dict[str, set] = {}
    for r in c:
        rules.setdefault(r["rule_id"], []).append((r["field"], r["operator"], r["value"], r["number"], r["unit"]))
        fields.setdefault(r["field"], set()).add(r["rule_id"])
    v = values.select(_bucket(buckets, "device_id"), "device_id", "field", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"), "value", number(F.col("value")).alias("number"), "unit")
    return v.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Alerts(rules, fields, ttl_ms), outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None",
        outputStructType=T.StructType.fromDDL("device_id long, rule_id string, holds boolean, at long"))


def latency_pairs_stream(accepted: DataFrame, deltas: DataFrame, bound: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """X6. Accepted responses with their deltas inside the bound, as a stream-stream join whose state is
    dropped once the watermarks have passed the bound; ``first_latency`` keeps the first delta."""
    a = accepted.select("response_id", F.col("ts").alias("accepted_at")).withWatermark("accepted_at", late)
    d = deltas.select(F.col("response_id").alias("r"), F.col("ts").alias("delta_at")).withWatermark("delta_at", late)
    cond = (F.col("response_id") == F.col("r")) & (F.col("delta_at") >= F.col("accepted_at")) & (F.col("delta_at") <= F.col("accepted_at") + F.expr(f"interval {bound}"))
    return a.join(d, cond).select("response_id", "accepted_at", "delta_at")


def first_latency(pairs: DataFrame) -> DataFrame:
    """X6. Microseconds from acceptance to the first delta."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return pairs.groupBy("response_id", "accepted_at").agg((F.min(us("delta_at")) - F.first(us("accepted_at"))).alias("first_delta_us")).select(
        "response_id", us("accepted_at").alias("accepted_us"), "first_delta_us")


class _Intake(StatefulProcessor):
    """The first request of each key of a bucket and, with a time to live, until when it counts."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "state", "conversations array<string>, keys array<string>, ids array<long>, hashes array<string>, until array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        now = timer_values.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        until = now + (self.ttl_ms or 0)
        first = {}
        if self.state.exists():
            first = {(c, k): (i, h, u) for c, k, i, h, u in zip(*self.state.get()) if not self.ttl_ms or u > now}
        held, out = len(first), []
        d = _ordered(rows, ["ordinal"])
        for c, k, i, h in zip(*[d[x].tolist() for x in ("conversation_id", "key", "request_id", "hash")]):
            seen = first.get((c, k))
            if seen is None:
                first[c, k] = (i, h, until)
                out.append((i, "accepted", i))
            else:
                out.append((i, "replayed" if h == seen[1] else "conflict", seen[0]))
        if len(first) > held:
            self.state.update(([c for c, _ in first], [k for _, k in first], *[list(x) for x in zip(*first.values())]))
        yield pd.DataFrame(out, columns=["request_id", "outcome", "first_id"])


def idempotent_stream(requests: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """X7. Keyed requests as accepted, replayed or conflict. Requests without a key need no state and
    are accepted as they come. Keys have their states in so many ``buckets``."""
    keyed = requests.where(F.coalesce("key", F.lit("")) != "").select(
        _bucket(buckets, "conversation_id", "key"), F.col("conversation_id").cast("string").alias("conversation_id"), "key", "request_id", "hash", "ordinal")
    out = _run(keyed, ["bucket"], _Intake(ttl_ms), "request_id long, outcome string, first_id long")
    free = requests.where(F.coalesce("key", F.lit("")) == "").select("request_id", F.lit("accepted").alias("outcome"), F.col("request_id").alias("first_id"))
    return out.unionByName(free)


def without_replays_stream(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """X7. Requests with exact repeats inside the watermark delay left out."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["conversation_id", "key", "hash"])
