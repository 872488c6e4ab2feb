"""The fold of a panel's events: sealed receipts of steps, sessions and a timeline, in batch and from streams.

Events: panel, seq (its order in the panel), type, body (a JSON object of the fields in BODY), and for
streams at (a timestamp that doesn't fall as seq grows). Nearly all that a panel shows is "the last
event of a type since another type": so an event is turned into slots by column expressions, batch
results are aggregations by max_by over segments that running maxima number, and a stream's state is
the slots of the step that is open. Rows with a null panel, seq or type take no part, events of other
types change nothing, a body that is no such object counts as one of nulls, and of events that repeat a
panel's seq one by order of type and body counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a panel keeps.
MAX_TIMELINE, MAX_RECEIPTS = 200, 40
#: Sequence numbers of a panel that one task folds; a long panel is many blocks.
BLOCK = 65_536

BODY = (
    "task string, goal string, step bigint, ok boolean, ms double, bytes bigint, image_bytes bigint, boxes bigint, regions bigint, detected bigint, applied bigint, forgeries bigint, "
    "risk string, requested bigint, outside bigint, elements bigint, available bigint, budget bigint, analysis string, metrics bigint, channel string, model string, kind string, "
    "endpoint string, fields bigint, leaks bigint, blocked boolean, reason string, changed boolean, action string, ref string, withheld boolean, scope string, message string, "
    "max_steps bigint, steps bigint, reachable boolean, alternatives bigint"
)
#: What a step's receipt is made of: the type that fills a slot, and the fields it takes.
SLOTS = {
    "frame": ("frame/captured", "bytes"),
    "vision": ("vision/done", "boxes"),
    "merged": ("detections/merged", "regions"),
    "redacted": ("redaction/done", "applied detected forgeries risk"),
    "baked": ("bake/done", "requested applied outside"),
    "sent": ("context/sent", "bytes image_bytes"),
    "analysed": ("context/sent", "analysis metrics"),
    "answered": ("context/transmitted", "channel model"),
    "gate": ("privacy/verified", "fields leaks blocked reason"),
    "refused": ("error", "message"),
    "acted": ("action/executed", "action ref ok withheld"),
    "network": (None, "type reason"),
    "checked": ("page/verified", "changed"),
}


def _t() -> Column:
    return F.col("type")


_TYPES = dict(field.split(" ") for field in BODY.split(", ")) | {"type": "string"}
_SLOTS = ", ".join(f"{slot}: struct<{', '.join(f'{f}: {_TYPES[f]}' for f in fields.split())}>" for slot, (_, fields) in SLOTS.items())
#: A receipt as a stream keeps it.
RAW = f"seq bigint, step bigint, e2e_ms double, task string, backend struct<kind: string, endpoint: string, model: string>, slots struct<{_SLOTS}>, late boolean, revision int"


def parsed(events: DataFrame, *more: str) -> DataFrame:
    """panel, seq, type, b (the body's fields) and the columns named."""
    body = F.coalesce(F.from_json("body", BODY), F.from_json(F.lit("{}"), BODY))
    return events.where("panel is not null and seq is not null and type is not null").select("panel", "seq", "type", *more, body.alias("b"))


def _once(events: DataFrame) -> DataFrame:
    return events.groupBy("panel", "seq").agg(F.min(F.struct("type", "body")).alias("_e")).select("panel", "seq", "_e.type", "_e.body")


def _fills() -> dict[str, Column]:
    """When an event fills a slot."""
    fills = {slot: _t() == type_ for slot, (type_, _) in SLOTS.items() if type_}
    return fills | {
        "analysed": (_t() == "context/sent") & F.col("b.analysis").isNotNull(),
        "refused": (_t() == "error") & F.coalesce(F.col("b.scope") == "validate", F.lit(False)),
        # The last of these says what became of the context and its picture.
        "network": _t().isin("context/sent", "context/transmitted") | ((_t() == "privacy/verified") & F.coalesce(F.col("b.blocked"), F.lit(False))),
        # A check of the page while its own step is still open.
        "checked": (_t() == "page/verified") & F.coalesce(F.col("b.step") == F.col("_step"), F.lit(False)),
    }


def _slot(slot: str) -> Column:
    return F.struct(*(F.col("type") if f == "type" else F.col(f"b.{f}") for f in SLOTS[slot][1].split()))


def running(rows: DataFrame, columns: dict[str, tuple[str, Column, bool]], block: int = BLOCK) -> DataFrame:
    """`rows` with running maxima or sums of a panel by seq: name -> (max or sum, what, whether of earlier rows only).

    A panel is folded in blocks of seq side by side; what a block starts from comes from the sums of the
    blocks before it, of which there is one row a block.
    """
    rows = rows.withColumn("_block", F.floor(F.col("seq") / block))
    fold = {"max": F.max, "sum": F.sum}
    both = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    ends = rows.groupBy("panel", "_block").agg(*(fold[how](what).alias(f"_end_{name}") for name, (how, what, _) in columns.items()))
    before = Window.partitionBy("panel").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("panel", "_block", *(fold[how](f"_end_{name}").over(before).alias(f"_end_{name}") for name, (how, _, _) in columns.items()))
    inside = Window.partitionBy("panel", "_block").orderBy("seq")
    here = {name: fold[how](what).over(inside.rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)) for name, (how, what, earlier) in columns.items()}
    out = rows.withColumns(here).join(ends, ["panel", "_block"])
    return out.withColumns({name: both[how](F.col(name), F.col(f"_end_{name}")) for name, (how, _, _) in columns.items()}).drop("_block", *(f"_end_{name}" for name in columns))


def _placed(events: DataFrame, block: int) -> DataFrame:
    """Events with where they stand: _session, _open (what began the step), _done (the last seal before), _backend, _step."""
    start, frame, done = _t() == "session/start", _t() == "frame/captured", _t() == "step/done"
    rows = running(
        parsed(_once(events)),
        {
            "_session": ("max", F.when(start, F.struct("seq", "b.task")), False),
            "_open": ("max", F.when(start | frame, F.struct("seq", frame.alias("frame"))), False),
            "_done": ("max", F.when(done, F.col("seq")), True),
            "_backend": ("max", F.when(_t() == "backend/selected", F.struct("seq", F.struct("b.kind", "b.endpoint", "b.model").alias("as"))), False),
            "_frames": ("sum", F.when(frame, 1).otherwise(0), False),
        },
        block,
    )
    # A step that is open counts on from the number of the last that was sealed.
    base = F.when(done, F.struct("seq", F.coalesce("b.step", F.lit(0)).alias("step"), "_frames")).when(start, F.struct("seq", F.lit(0).cast("long").alias("step"), "_frames"))
    rows = running(rows, {"_base": ("max", base, False)}, block)
    step = F.coalesce(F.col("_base.step"), F.lit(0)) + F.col("_frames") - F.coalesce(F.col("_base._frames"), F.lit(0))
    live = F.coalesce(F.col("_open.frame") & (F.col("_done").isNull() | (F.col("_done") < F.col("_open.seq"))), F.lit(False))
    return rows.withColumns({"_step": step, "_live": live})


def receipts(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per sealed step, of all sessions: what it captured, covered, sent and did (see `finished`).

    A step begins at frame/captured and is sealed by the next step/done; its number is the seal's. A
    step/done without a step of its own (none was begun, or it is sealed already) gives an empty receipt,
    so nothing that comes after a seal changes it, but for page/verified, which goes to the last receipt of its step in its session.
    """
    rows = _placed(events, block)
    done, check = _t() == "step/done", _t() == "page/verified"
    # An event tells of the step it is in, and a seal or a check may tell of itself: one pass, one grouping.
    of = lambda what, id_: F.struct(F.lit(what).alias("what"), F.col(id_).alias("id"))
    told = F.array(F.when(F.col("_live"), of("step", "_open.seq")), F.when(done & ~F.col("_live"), of("empty", "seq")), F.when(check, of("check", "seq")))
    rows = rows.withColumn("_of", F.explode(F.filter(told, lambda x: x.isNotNull())))
    seal = F.struct("seq", "b.step", "b.ms", F.col("_backend.as").alias("backend"), "_session")
    step = F.col("_of.what") == "step"
    slots = [F.max_by(_slot(s), F.when(step & when, F.col("seq"))).alias(s) for s, when in _fills().items()]
    found = F.max(F.when(check & ~step, F.struct("seq", "b.changed"))).alias("_check")
    grouped = rows.groupBy("panel", "_of").agg(F.max_by(seal, F.when(done | ~step, F.col("seq"))).alias("_seal"), found, *slots).where("_seal is not null")
    both = grouped.select("panel", F.col("_seal.seq").alias("seq"), F.col("_seal._session.seq").alias("_session"), F.col("_seal._session.task").alias("task"), F.col("_seal.step").alias("step"), F.col("_seal.ms").alias("e2e_ms"), F.col("_seal.backend").alias("backend"), "_check", *SLOTS)
    # Checks of pages meet the last receipt of their step before them, in order of seq.
    both = both.withColumn("_seal", F.when(F.col("_check").isNull(), F.col("seq")))
    w = Window.partitionBy("panel", "step", "_session").orderBy("seq")
    both = both.withColumn("_of", F.max("_seal").over(w))
    late = F.max("_check").over(Window.partitionBy("panel", "step", "_session", "_of"))["changed"]
    return finished(both.withColumn("_late", F.when(F.col("step").isNotNull(), late)).where("_seal is not null"))


def finished(raw: DataFrame, *more: str) -> DataFrame:
    """Receipts from their slots: claims are made only of what was measured."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.lit("not-checked")
    network, prepared = F.col("network.type"), F.col("sent").isNotNull()
    left = F.when(F.col("answered.channel") == "cloud", "sent").otherwise("stayed-on-device")
    image = zero("sent.image_bytes")
    told = network == "context/transmitted"
    blocked = F.coalesce(F.col("gate.blocked"), F.lit(False))
    return raw.select(
        "panel", "seq", *more, "task", "step", "e2e_ms", F.col("backend.kind").alias("backend"), F.col("backend.model").alias("backend_model"),
        F.col("frame").isNotNull().alias("captured"), zero("frame.bytes").alias("frame_bytes"), zero("vision.boxes").alias("vision_detections"), zero("merged.regions").alias("pii_regions"),
        zero("redacted.applied").alias("redactions_applied"), zero("redacted.detected").alias("redactions_detected"), zero("redacted.forgeries").alias("forgeries_stripped"), F.col("redacted.risk").alias("residual_risk"),
        zero("baked.requested").alias("pixel_ops_requested"), zero("baked.applied").alias("pixel_ops_applied"), zero("baked.outside").alias("pixel_ops_outside"),
        F.coalesce("analysed.analysis", F.lit("not-run")).alias("analysis"), zero("analysed.metrics").alias("metrics_sent"),
        F.when(F.col("gate").isNull(), none).when(blocked, "blocked").otherwise("verified-absent").alias("raw_content"), F.when(~blocked, zero("gate.fields")).alias("checked_fields"), zero("gate.leaks").alias("leaks"),
        F.when(network == "privacy/verified", "blocked").when(told & prepared, left).otherwise(none).alias("context"), F.when(told & prepared, zero("sent.bytes")).alias("context_bytes"),
        F.when(network == "privacy/verified", "blocked").when(prepared & (image == 0) & network.isNotNull(), "verified-absent").when(told & prepared, left).otherwise(none).alias("screenshot"),
        F.col("answered.model").alias("model_answered"), F.col("acted.action").alias("action"), F.col("acted.ref").alias("action_ref"),
        F.when(F.col("refused").isNotNull(), "fail").when(F.col("acted").isNotNull(), "pass").otherwise("not-reached").alias("validation"),
        F.when(F.col("acted").isNull(), "not-reached").when(F.col("acted.withheld"), "withheld").when(F.col("acted.ok"), "pass").otherwise("fail").alias("execution"),
        F.coalesce(F.when(F.coalesce("_late", "checked.changed"), "changed").when(~F.coalesce("_late", "checked.changed"), "unchanged"), none).alias("verification"),
    )


def kept(receipts: DataFrame, keep: int = MAX_RECEIPTS) -> DataFrame:
    """The last receipts of each panel."""
    w = Window.partitionBy("panel").orderBy(F.desc("seq"))
    return receipts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def sessions(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per panel and session (null: events before any), of which the last is what the panel shows.

    Counts are of the session; stage times, budget, refusal, loop and banner are those of the last event that
    tells them; a refusal ends with the next frame, a banner of an unavailable backend with that or a
    selection, and health with the selection of a backend of another kind. Backend and health outlast a session.
    """
    rows = _placed(events, block)
    kind = F.col("b.kind")
    health = ("max", F.when(_t() == "backend/health", F.struct("seq", kind.alias("kind"), "b.reachable")), False)
    rows = running(rows, {"_health": health}, block)
    # A selection of another kind than that of the last probe ends it.
    ends = (_t() == "backend/selected") & F.col("_health").isNotNull() & ~kind.eqNullSafe(F.col("_health.kind"))
    rows = running(rows, {"_ended": ("max", F.when(ends, F.col("seq")), False)}, block)
    last = lambda what, when: F.max_by(what, F.when(when, F.col("seq")))
    is_ = lambda t: t == _t()
    of = lambda t, c: last(F.col(f"b.{c}"), is_(t))
    total = lambda t, c: F.coalesce(F.sum(F.when(is_(t), F.col(f"b.{c}"))), F.lit(0))
    no, started = F.lit(None).cast("string"), F.col("_session").isNotNull()
    refusal = is_("frame/captured") | ((_t() == "error") & (F.col("b.scope") == "validate"))
    banner = _t().isin("frame/captured", "backend/selected", "backend/unavailable")
    stages = {"capture_ms": "frame/captured", "vision_ms": "vision/done", "redact_ms": "redaction/done", "bake_ms": "bake/done", "server_ms": "server/response", "execute_ms": "action/executed", "e2e_ms": "step/done"}
    out = rows.groupBy("panel", F.col("_session.seq").alias("session")).agg(
        of("session/start", "task").alias("task"), of("session/start", "goal").alias("goal"),
        F.coalesce(last(is_("session/start"), _t().isin("session/start", "session/end")) & F.bool_or(started), F.lit(False)).alias("running"),
        F.count_if(is_("action/executed") & started).alias("actions"), F.count_if(is_("step/done")).alias("steps"), F.count_if(is_("error")).alias("errors"), F.count_if(is_("backend/unavailable")).alias("backend_errors"),
        total("vision/done", "boxes").alias("detections"), total("redaction/done", "applied").alias("redactions"), total("redaction/done", "forgeries").alias("forgeries_stripped"),
        *(of(t, "ms").alias(name) for name, t in stages.items()), of("context/sent", "elements").alias("elements"), of("context/sent", "budget").alias("token_budget"),
        last(F.when(is_("error"), F.col("b.message")).otherwise(no), refusal).alias("last_refusal"), last(F.when(is_("backend/unavailable"), kind).otherwise(no), banner).alias("unavailable"),
        last(F.when(is_("loop/stopped"), F.col("b.reason")).otherwise(no), _t().isin("loop/step", "loop/stopped")).alias("loop_reason"), last(F.when(is_("loop/stopped"), F.col("b.steps")).otherwise(F.col("b.step")), _t().isin("loop/step", "loop/stopped")).alias("loop_step"),
        of("action/executed", "action").alias("last_action"), of("action/executed", "ok").alias("last_ok"), F.max_by("_backend", "seq").alias("_b"), F.max_by("_health", "seq").alias("_h"), F.max_by("_ended", "seq").alias("_e"),
    )
    healthy = F.when(F.col("_e").isNull() | (F.col("_e") < F.col("_h.seq")), F.col("_h.reachable"))
    return out.withColumns({"backend": F.col("_b.as.kind"), "reachable": healthy}).drop("_b", "_h", "_e")


def timeline_items(events: DataFrame, *more: str) -> DataFrame:
    """A line for each event that has one: panel, seq, label, detail, kind. By itself per event, so for streams too."""
    b = lambda c: F.coalesce(F.col(f"b.{c}").cast("string"), F.lit("?"))
    say = lambda text, *cs: F.format_string(text, *cs)
    word = lambda c, yes, no: F.when(F.col(f"b.{c}"), yes).otherwise(no)
    full, cloud = F.col("b.elements") == F.col("b.available"), F.col("b.channel") == "cloud"
    ms = F.round(F.coalesce("b.ms", F.lit(0.0))).cast("long")
    lines = {
        "session/start": (F.lit("session"), b("goal"), F.lit("info")),
        "session/end": (F.lit("session"), say("ended: %s", b("reason")), F.lit("info")),
        "frame/captured": (F.lit("capture"), say("%s bytes in %d ms", b("bytes"), ms), F.lit("info")),
        "vision/done": (F.lit("vision"), say("%s boxes", b("boxes")), F.lit("info")),
        "detections/merged": (F.lit("merge"), say("%s regions", b("regions")), F.lit("info")),
        "redaction/done": (F.lit("redaction"), say("%s of %s applied, risk %s", b("applied"), b("detected"), b("risk")), F.lit("redaction")),
        "bake/done": (F.lit("bake"), say("%s of %s pixel operations, %s outside", b("applied"), b("requested"), b("outside")), F.lit("redaction")),
        "context/sent": (F.lit("sent"), say("%s of %s elements, %s bytes", b("elements"), b("available"), b("bytes")), F.when(full, "info").otherwise("warn")),
        "context/transmitted": (F.when(cloud, "privacy gate").otherwise("local planner"), b("model"), F.when(cloud, "sent").otherwise("redaction")),
        "privacy/verified": (F.lit("egress gate"), F.when(F.col("b.blocked"), say("blocked: %s", b("reason"))).otherwise(say("%s fields scanned", b("fields"))), word("blocked", "error", "redaction")),
        "page/verified": (F.lit("page check"), say("step %s: %s", b("step"), word("changed", "changed", "unchanged")), word("changed", "info", "warn")),
        "server/response": (b("model"), F.coalesce(F.col("b.action"), F.lit("no usable action")), F.lit("info")),
        "action/executed": (F.lit("action"), F.concat_ws(" ", "b.action", "b.ref", word("ok", "ok", "failed")), F.lit("action")),
        "notice": (b("scope"), b("message"), F.lit("info")),
        "error": (b("scope"), b("message"), F.lit("error")),
        "loop/stopped": (F.lit("loop"), say("after %s: %s", b("steps"), b("reason")), F.when(F.col("b.reason") == "done", "info").otherwise("error")),
        "step/done": (say("step %s", b("step")), say("%s in %d ms", word("ok", "ok", "failed"), ms), word("ok", "info", "error")),
        "backend/selected": (F.lit("backend"), F.concat_ws(" ", "b.kind", "b.endpoint", "b.model"), F.lit("info")),
        "backend/health": (F.lit("backend health"), say("%s: %s", b("kind"), word("reachable", "connected", "unavailable")), word("reachable", "info", "error")),
        "backend/unavailable": (F.lit("backend"), say("%s unavailable, %s others offered", b("kind"), b("alternatives")), F.lit("error")),
    }
    pick = lambda i: F.coalesce(*(F.when(_t() == t, line[i]) for t, line in lines.items()))
    rows = parsed(events, *more).where(_t().isin(*lines))
    return rows.select("panel", "seq", *more, pick(0).alias("label"), pick(1).alias("detail"), pick(2).alias("kind"), (_t() == "session/start").alias("starts"))


def timeline(events: DataFrame, keep: int = MAX_TIMELINE) -> DataFrame:
    """The last lines of each panel's last session: a panel's other lines don't move, as their rank is cut before the shuffle."""
    w = Window.partitionBy("panel").orderBy(F.desc("seq"))
    rows = timeline_items(_once(events)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    start = F.max(F.when(F.col("starts"), F.col("seq"))).over(Window.partitionBy("panel"))
    return rows.withColumn("_s", start).where("_s is null or seq >= _s").drop("_n", "_s", "starts")


class _Steps(StatefulProcessor):
    """A panel's open step, events that wait for their turn, and the last receipts, for checks of pages that come late."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "state string")
        self.waiting = handle.getMapState("waiting", "seq bigint", "at bigint, type string, event string")
        self.sealed = handle.getListState("sealed", "receipt string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        first = None
        for batch in rows:
            for seq, at, type_, event in zip(batch["seq"], batch["at_ms"], batch["type"], batch["event"], strict=True):
                # What comes after its turn is late: it opens no sealed step again.
                if state["seq"] is not None and seq <= state["seq"]:
                    continue
                if self.waiting.containsKey((int(seq),)) and self.waiting.getValue((int(seq),))[1:] <= (type_, event):
                    continue
                self.waiting.updateValue((int(seq),), (int(at), type_, event))
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = [], None
        for (seq,), (at, type_, event) in self.waiting.iterator():
            if at <= now:
                ready.append((seq, type_, event))
            else:
                later = at if later is None else min(later, at)
        state = self._state()
        kept = [json.loads(r[0]) for r in self.sealed.get()] if ready else []
        out = []
        for seq, type_, event in sorted(ready):
            self.waiting.removeKey((seq,))
            out += [(key[0], json.dumps(r)) for r in step_of(state, kept, seq, type_, json.loads(event))]
            del kept[: -self.keep]
        if ready:
            self.open.update((json.dumps(state),))
            if kept:
                self.sealed.put([(json.dumps(r),) for r in kept])
            else:
                self.sealed.clear()
        if later is not None:
            self.handle.registerTimer(later)
        if out:
            yield pd.DataFrame(out, columns=["panel", "receipt"])

    def close(self) -> None:
        pass

    def _state(self) -> dict:
        return json.loads(self.open.get()[0]) if self.open.exists() else {"seq": None, "slots": None, "at": 0, "session": None, "task": None, "backend": None}


def step_of(state: dict, kept: list[dict], seq: int, type_: str, event: dict) -> list[dict]:
    """Take one event of a panel in its turn; the receipts that it seals or revises."""
    state["seq"] = seq
    if type_ == "session/start":
        state.update(session=seq, task=event.get("task"), slots=None, at=0)
        kept.clear()
    elif type_ == "frame/captured":
        state.update(slots={}, at=state["at"] + 1)
    elif type_ == "backend/selected":
        state["backend"] = event["backend"]
    if type_ == "page/verified":
        if event.get("step") == state["at"] and state["slots"] is not None:
            state["slots"]["checked"] = event["slots"]["checked"]
        of = [r for r in kept if r["step"] is not None and r["step"] == event.get("step")][-1:]
        for r in of:
            r.update(late=event["slots"]["checked"].get("changed"), revision=r["revision"] + 1)
        return of
    if type_ == "step/done":
        sealed = {"seq": seq, "step": event.get("step"), "e2e_ms": event.get("ms"), "task": state["task"], "backend": state["backend"], "slots": state["slots"] or {}, "late": None, "revision": 0}
        state.update(slots=None, at=event.get("step") or 0)
        kept.append(sealed)
        return [sealed]
    if state["slots"] is not None:
        state["slots"].update(event["slots"])
    return []


def receipts_stream(events: DataFrame, delay: str = "1 minute", keep: int = MAX_RECEIPTS) -> DataFrame:
    """Receipts of a stream, and a `revision`: 0 when a step is sealed, one more at each check of its page.

    Events wait until the watermark (`delay`) has passed them and are taken in order of seq, so any order within
    the delay gives the rows of `receipts`, of which the highest revision counts. What comes later than that is dropped: sealed
    steps stay sealed. State holds the events of one delay, an open step and `keep` receipts. A check of a
    page whose receipt has gone from these, or from a session before, gives no row.
    """
    fills = _fills() | {"checked": _t() == "page/verified"}
    slots = F.struct(*(F.when(fills[s], _slot(s)).alias(s) for s in SLOTS))
    event = F.to_json(F.struct("b.step", "b.ms", "b.task", F.when(_t() == "backend/selected", F.struct("b.kind", "b.endpoint", "b.model")).alias("backend"), slots.alias("slots")))
    rows = parsed(events.where("at is not null").withWatermark("at", delay), "at").select("panel", "seq", "at", F.unix_millis("at").alias("at_ms"), "type", event.alias("event"))
    out = rows.groupBy("panel").transformWithStateInPandas(_Steps(keep), "panel string, receipt string", "append", "EventTime")
    raw = F.from_json("receipt", RAW)
    flat = out.select("panel", raw.alias("r")).select("panel", "r.seq", "r.step", "r.e2e_ms", "r.task", "r.backend", "r.slots.*", F.col("r.late").alias("_late"), "r.revision")
    return finished(flat, "revision")
