"""Whole requests: what may leave, what may not, and why."""

import copy
import json

import pytest
from pyspark.errors import PySparkException

from loomsift.operators import egress, payloads


def atom(text, **more):
    return {"kind": "page-data", "text": text, "redacted": False, "truncated": False, **more}


CLEAN = {
    "schemaVersion": 1, "taskId": "t", "step": 2, "goal": "sign in", "url": "https://a.example/", "nonce": "5eed", "viewport": {"w": 1}, "redactionSummary": {}, "budget": {}, "title": atom("Sign in"),
    "history": [{"name": atom("Next"), "note": "went on"}], "clarifications": [{"question": "Which one?"}],
    "elements": [{"ref": "e1", "role": "link", "isSensitive": False, "name": atom("Go [[PII:EMAIL:1:5eed]]"), "value": None, "tag": "a", "container": 0, "attrs": [{"key": "href", "value": atom("https://a.example/x")}]}],
    "containers": [{"tag": "my-form", "role": None, "parent": None, "attrs": [{"key": "id", "value": atom("f")}]}],
    "analysis": {"schemaVersion": 1, "columns": [{"index": 0, "label": atom("Sales"), "kind": "numeric", "stats": {"mean": 2.5}}], "trends": [{"direction": "rising", "strength": "weak"}], "refusal": None},
    "screenshot": {"base64": "QQ", "format": "jpeg", "width": 768, "height": 432, "opsRequested": 3, "opsApplied": 0, "opsOutsideFrame": 3},
}


def changed(*steps):
    """The clean request with a value put (or, with `...`, removed) at a path."""
    whole = copy.deepcopy(CLEAN)
    *way, last, value = steps
    at = whole
    for step in way:
        at = at[step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return whole


E0, S0, C0, COL = ("elements", 0), ("screenshot",), ("containers", 0), ("analysis", "columns", 0)
CASES = [
    (CLEAN, []),
    (changed("rawHtml", "<html>"), ["unexpected-field"]),
    (changed("a.b", 1), ["unexpected-field"]),
    (changed(*E0, "domPath", "body"), ["unexpected-field"]),
    (changed(*E0, "name", "bare text"), ["unquoted-page-text"]),
    (changed(*E0, "value", {}), ["unquoted-page-text"]),
    (changed(*E0, "name", atom("x", extra=1)), ["unexpected-field"]),
    (changed(*E0, "name", atom(5)), ["unexpected-field"]),
    (changed(*E0, "name", {**atom("x"), "kind": "html"}), ["unquoted-page-text"]),
    (changed(*E0, "name", atom("a ``` b")), ["fence-token"]),
    (changed(*E0, "tag", "<b>"), ["unexpected-field"]),
    (changed(*E0, "container", "0"), ["missing-field"]),
    (changed(*E0, "isSensitive", ...), ["missing-field"]),
    (changed("elements", 0, 7), ["missing-field"]),
    (changed(*E0, "attrs", 0, "key", "onclick"), ["unexpected-field"]),
    (changed(*E0, "attrs", 0, "value", None), ["missing-field"]),
    (changed(*E0, "attrs", {}), ["missing-field"]),
    (changed(*C0, "role", "Form!"), ["unexpected-field"]),
    (changed(*C0, "parent", ...), ["missing-field"]),
    (changed(*C0, "title", "x"), ["unexpected-field"]),
    (changed("step", "2"), ["missing-field"]),
    (changed("nonce", ""), ["missing-field"]),
    (changed("history", ...), ["missing-field"]),
    (changed(*COL, "label", "Sales"), ["unquoted-page-text"]),
    (changed(*COL, "kind", "money"), ["unquoted-page-text"]),
    (changed(*COL, "note", 1), ["unexpected-field"]),
    (changed(*COL, "stats", {"a": [{"b": "Jane"}]}), ["unquoted-page-text"]),
    (changed("analysis", "trends", 0, "direction", "up"), ["unquoted-page-text"]),
    (changed("analysis", []), ["not-a-context"]),
    (changed("screenshot", "x"), ["unbaked-screenshot"]),
    (changed(*S0, "opsApplied", ...), ["unbaked-screenshot"]),
    (changed(*S0, "width", 0), ["unbaked-screenshot"]),
    (changed(*S0, "format", "gif"), ["unbaked-screenshot"]),
    (changed(*S0, "opsOutsideFrame", 1), ["unverified-screenshot"]),
    (changed("goal", "[[PII:EMAIL:1:bad]] and [[PII:NAME:2:]]"), ["forged-placeholder"]),
    (changed("viewport", {"[[PII:EMAIL:1:bad]]": 1}), ["forged-placeholder"]),
    (changed("schemaVersion", 2), ["not-a-context"]),
    (changed("schemaVersion", True), ["not-a-context"]),
    ([CLEAN], ["not-a-context"]),
    ("text", ["not-a-context"]),
]
RAW = [
    (None, ["not-a-context"]),
    ("", ["not-a-context"]),
    ("{", ["not-a-context"]),
    ('{"schemaVersion":NaN}', ["not-a-context"]),
    ("[" * 60_000 + "]" * 60_000, ["not-a-context"]),
    (json.dumps(CLEAN)[:-1] + ',"goal":"again"}', ["unexpected-field"]),
    (json.dumps(changed("budget", {"x": "DEEP"})).replace('"DEEP"', "[" * 90 + "]" * 90), ["unexpected-field"]),
    (json.dumps(CLEAN).replace("sign in", "\\ud800 1" + "0" * 400), []),
    (json.dumps(CLEAN).replace('"step": 2', '"step": 1' + "0" * 5000), []),
    (json.dumps(changed("goal", "x" * 3_000_000)), ["not-a-context"]),
]


def test_every_violation(spark):
    said = [(json.dumps(r), c) for r, c in CASES] + RAW
    rows = spark.createDataFrame([(i, r, "other") for i, (r, _) in enumerate(said)], "payload_id int, json string, path string")
    got = {i: [] for i in range(len(said))}
    for v in payloads.violations(rows).collect():
        got[v["payload_id"]].append(v["code"])
        assert "Jane" not in v["detail"] and "bare" not in v["detail"]
    assert got == {i: c for i, (_, c) in enumerate(said)}


def test_texts_that_a_model_reads(spark):
    rows = spark.createDataFrame([(None, json.dumps(CLEAN)), (None, json.dumps({**CLEAN, "title": atom("")}))], "key int, name string")
    got = sorted((r["path"], r["text"]) for r in payloads.text_fields(rows, "key", "name").collect())
    assert got == sorted([("title", "Sign in"), *[(p, t) for p, t in [
        ("history[0].name", "Next"), ("history[0].note", "went on"), ("clarifications[0].question", "Which one?"), ("elements[0].name", "Go [[PII:EMAIL:1:5eed]]"),
        ("elements[0].attrs[0].value", "https://a.example/x"), ("containers[0].attrs[0].value", "f"), ("analysis.columns[0].label", "Sales")] for _ in range(2)]])


def test_verdicts_fail_closed(spark):
    leak = changed("elements", 0, "name", atom("write to jane.doe@mail.example.com"))
    sent = [CLEAN, leak, changed("title", atom("<div>x")), changed("history", 0, "note", "jane.doe@mail.example.com"), changed("step", None)]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(sent)] + [(9, None)], "payload_id int, json string")
    got = {r["payload_id"]: (r["n_fields"], r["n_violations"], r["n_findings"], r["ok"]) for r in payloads.verdicts(rows).collect()}
    assert got == {0: (8, 0, 0, True), 1: (8, 0, 1, False), 2: (8, 0, 1, False), 3: (8, 0, 1, False), 4: (8, 1, 0, False), 9: (0, 1, 0, False)}
    assert egress.demand_clean(payloads.verdicts(rows.where("payload_id = 0"))).count() == 1
    with pytest.raises(PySparkException):
        egress.demand_clean(payloads.verdicts(rows)).collect()
    assert payloads.verdicts(rows.where("payload_id < 0")).count() == 0
