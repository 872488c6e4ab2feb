"""Folds of panels' events against a plain loop, in batch, with small blocks, and from shuffled streams."""

import datetime as dt
import json
import random

import pytest

from loomsift.streaming import panels as P

TYPES = [t for t, _ in P.SLOTS.values() if t] + ["session/start", "step/done", "step/done", "context/sent", "context/transmitted", "context/transmitted", "privacy/verified", "page/verified", "page/verified", "backend/selected", "backend/health", "backend/unavailable", "error", "session/end", "server/response", "notice", "loop/step", "loop/stopped", "unknown"]
START = dt.datetime(2024, 1, 1)


def made(panel, n, seed):
    """Events of a panel, some fields missing."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        body = {f: rng.randrange(3) for f in "step bytes image_bytes boxes regions detected applied forgeries requested outside elements available budget metrics fields leaks steps".split()}
        body |= {f: rng.random() < 0.5 for f in ("ok", "blocked", "changed", "withheld", "reachable")}
        body |= {"ms": float(rng.randrange(99)), "risk": rng.choice(["none", "low"]), "channel": rng.choice(["cloud", "on-device"]), "model": rng.choice("mn"), "kind": rng.choice(["a", "b"]), "endpoint": "e"}
        body |= {"scope": rng.choice(["validate", "plan"]), "message": f"m{seq}", "action": "click", "ref": "e1", "analysis": rng.choice(["ran", "refused"]), "task": f"t{seq}", "goal": "g", "reason": rng.choice(["done", "max-steps"])}
        type_ = rng.choice([t for t in TYPES if t != "session/start"]) if rng.random() < 0.97 else "session/start"
        out.append((panel, seq, START + dt.timedelta(seconds=seq), type_, json.dumps({k: v for k, v in body.items() if rng.random() < 0.9})))
    return out


def plain(events):
    """The receipts and sessions of one panel, event by event."""
    empty = lambda: dict(frame=None, boxes=0, risk=None, applied=0, ops=0, analysis="not-run", raw="not-checked", fields=0, context="not-checked", cbytes=None, shot="not-checked", answered=None, action=None, validation="not-reached", execution="not-reached", verification="not-checked", backend=None, sealed=False, step=0)
    r, all_, kept, backend, health, task, sent = empty(), [], [], None, None, None, None
    ses = dict(steps=0, errors=0, refusal=None, banner=None, health=None, backend=None, actions=0)
    for _, seq, _, t, body in events:
        b = json.loads(body)
        get = lambda k, d=0: b.get(k, d)  # noqa: E731, B023
        if t == "session/start":
            r, kept, task, sent = empty(), [], get("task", None), None
            ses = dict(steps=0, errors=0, refusal=None, banner=None, actions=0)
        elif t == "frame/captured":
            r, sent = empty() | dict(frame=get("bytes"), backend=backend, step=r["step"] + 1), None
            ses.update(refusal=None, banner=None)
        elif t == "vision/done":
            r["boxes"] = get("boxes")
        elif t == "redaction/done":
            r.update(applied=get("applied"), risk=get("risk", None))
        elif t == "bake/done":
            r["ops"] = get("applied")
        elif t == "context/sent":
            sent = (get("bytes"), get("image_bytes"))
            r.update(context="not-checked", cbytes=None, shot="not-checked" if sent[1] else "verified-absent", analysis=get("analysis", None) or r["analysis"])
        elif t == "context/transmitted":
            left = "sent" if get("channel", None) == "cloud" else "stayed-on-device"
            r["answered"] = get("model", None)
            r.update(context=left, cbytes=sent[0], shot=left if sent[1] else "verified-absent") if sent else r.update(context="not-checked", cbytes=None, shot="not-checked")
        elif t == "privacy/verified":
            blocked = get("blocked", False)
            r.update(raw="blocked" if blocked else "verified-absent", fields=None if blocked else get("fields"))
            if blocked:
                r.update(context="blocked", shot="blocked", cbytes=None)
        elif t == "error":
            ses["errors"] += 1
            if get("scope", None) == "validate":
                r["validation"] = "fail"
                ses["refusal"] = get("message", None)
        elif t == "action/executed":
            ses["actions"] += task is not None or any(e[3] == "session/start" and e[1] < seq for e in events)
            r.update(action=get("action", None), validation="fail" if r["validation"] == "fail" else "pass", execution="withheld" if get("withheld", False) else "pass" if get("ok", False) else "fail")
        elif t == "backend/selected":
            backend = get("kind", None)
            r["backend"] = backend
            ses["banner"] = None
            health = health if health and health[0] == backend else None
        elif t == "backend/health":
            health = (get("kind", None), get("reachable", None))
        elif t == "backend/unavailable":
            ses["banner"] = get("kind", None)
        elif t == "page/verified":
            said = {True: "changed", False: "unchanged", None: None}[get("changed", None)]
            if "step" in b and said:
                if r["step"] == b["step"]:
                    r["verification"] = said
                for k in [k for k in kept if k["step"] == b["step"]][-1:]:
                    k["verification"] = said
        elif t == "step/done":
            ses["steps"] += 1
            fresh = r["frame"] is not None and not r["sealed"]
            out = (r if fresh else empty() | dict(backend=backend)) | dict(sealed=True, step=get("step"), seq=seq, task=task, ms=get("ms", None), null_step="step" not in b)
            r = dict(out)
            kept.append(out)
            all_.append(out)
    return all_, ses | dict(health=health[1] if health else None, backend=backend)


COLUMNS = dict(seq="seq", task="task", ms="e2e_ms", backend="backend", boxes="vision_detections", risk="residual_risk", applied="redactions_applied", ops="pixel_ops_applied", analysis="analysis", raw="raw_content", fields="checked_fields", context="context", cbytes="context_bytes", shot="screenshot", answered="model_answered", action="action", validation="validation", execution="execution", verification="verification")


def want(events):
    out = {}
    for panel in {e[0] for e in events}:
        for r in plain(sorted((e for e in events if e[0] == panel), key=lambda e: e[1]))[0]:
            # Receipts of no stated step meet no checks; every receipt's check must say something.
            out[panel, r["seq"]] = {k: r[k] for k in COLUMNS} | dict(step=None if r["null_step"] else r["step"])
    return out


def got(df):
    return {(r["panel"], r["seq"]): {k: r[c] for k, c in COLUMNS.items()} | dict(step=r["step"]) for r in df.collect()}


SCHEMA = "panel string, seq long, at timestamp, type string, body string"


def full(events):
    """Without events whose step or finding is missing, of which the plain loop says less."""
    return [e for e in events if not (e[3] in ("page/verified", "step/done") and not {"step", "changed"} <= set(json.loads(e[4])))]


@pytest.fixture(scope="module")
def events():
    return full(made("p", 1400, 1) + made("q", 300, 2) + made("r", 5, 3))


@pytest.mark.parametrize("block", [7, 64, P.BLOCK])
def test_receipts_and_sessions(spark, events, block):
    shuffled = random.Random(5).sample(events, len(events))
    df = spark.createDataFrame(shuffled + shuffled[:40] + [(None, 1, START, "step/done", "{}"), ("p", None, START, "step/done", "{}"), ("p", 10**6, START, None, "{}"), ("p", 10**6, START, "step/finished", "no json")], SCHEMA)
    expected = want(events)
    result = got(P.receipts(df, block))
    assert result.keys() == expected.keys()
    assert {k: v for k, v in result.items() if v != expected[k]} == {}
    assert len({v["verification"] for v in result.values()}) == 3 and len({v["execution"] for v in result.values()}) == 4 and len({v["context"] for v in result.values()}) == 4
    last = {}
    for r in P.sessions(df, block).collect():
        last[r.panel] = max(last.get(r.panel, (-2,)), (-1 if r.session is None else r.session, r))
    for panel in "pqr":
        s, r = plain([e for e in events if e[0] == panel])[1], last[panel][1]
        assert (s["steps"], s["errors"], s["refusal"], s["banner"], s["actions"]) == (r.steps, r.errors, r.last_refusal, r.unavailable, r.actions)
        assert (s["backend"], s["health"]) == (r.backend, r.reachable)


def test_a_seal_stays(spark):
    e = lambda i, t, **b: ("p", i, START, t, json.dumps(b))
    df = spark.createDataFrame([e(0, "session/start", task="t"), e(1, "step/done", step=1), e(2, "frame/captured", bytes=5), e(3, "step/done", step=2, ms=9.0), e(4, "redaction/done", applied=7), e(5, "step/done", step=3), e(6, "page/verified", step=2, changed=False), e(7, "session/start", task="u"), e(8, "page/verified", step=3, changed=True)], SCHEMA)
    rows = {r.step: (r.task, r.captured, r.redactions_applied, r.e2e_ms, r.verification) for r in P.receipts(df).collect()}
    assert rows == {1: ("t", False, 0, None, "not-checked"), 2: ("t", True, 0, 9.0, "unchanged"), 3: ("t", False, 0, None, "not-checked")}
    assert [r.step for r in P.kept(P.receipts(df), 1).collect()] == [3]
    none = df.limit(0)
    assert P.receipts(none).count() == P.sessions(none).count() == P.timeline(none).count() == 0


def test_timeline(spark, events):
    df = spark.createDataFrame(events, SCHEMA)
    silent = {"backend/health"} - {"backend/health"} | {"loop/step", "unknown"}
    rows = P.timeline(df, 50).collect()
    for panel in "pqr":
        mine = [e for e in events if e[0] == panel]
        since = max((e[1] for e in mine if e[3] == "session/start"), default=0)
        lines = [e[1] for e in mine if e[1] >= since and e[3] not in silent][-50:]
        assert sorted(r.seq for r in rows if r.panel == panel) == lines
    assert all(r.label and r.detail and r.kind for r in rows)


def test_stream_equals_batch(spark, events, tmp_path):
    """Four files: each event comes in its own or the next one, so far out of order; then one long after all."""
    rng = random.Random(8)
    parts = [[] for _ in range(4)]
    for e in events:
        parts[min(3, e[1] // 400 + rng.randrange(2))].append(e)
    end = START + dt.timedelta(days=9)
    late = [("p", 3, START, "frame/captured", "{}"), ("p", 4, START, "step/done", '{"step": 1}')]
    parts += [[("z", 0, end, "notice", "{}")], late, [("z", 1, end + dt.timedelta(days=1), "notice", "{}")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(rng.sample(part, len(part)), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = P.receipts_stream(stream, "14 minutes", keep=1000).writeStream.format("memory").queryName("panels").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    out = spark.table("panels")
    # Of a receipt the highest revision counts.
    assert got(out.orderBy("revision")) == want(events)
