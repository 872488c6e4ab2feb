"""Actions that a model proposes: read from its text, checked against what the page allows."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import text as T

#: Action types with the fields they need, limits, and words of a question that asks for credentials.
FIELDS = {"click": (), "type": ("text",), "select": ("option",), "scroll": ("direction",), "key": ("key",), "navigate": ("url",), "wait": (), "ask_user": ("question",), "done": ("summary",), "abort": ("reason",)}
CHOICES = {"direction": ("up", "down", "left", "right"), "key": ("Enter", "Escape", "Tab", "Backspace")}
NUMBERS = {"scroll": ("amountPx", 400.0, 100_000.0), "wait": ("ms", 1000.0, 600_000.0)}
TARGET_KEYS = ("tag", "role", "id", "name", "type", "placeholder", "href", "label", "text", "within")
MAX_SCROLL_PX, MAX_WAIT_MS, MAX_TYPE_CHARS = 5000, 10_000, 1000
CREDENTIALS = r"(?i)\b(password|passcode|passphrase|pin|otp|one[- ]time (code|password)|cvv|cvc|security code|card number|credit card|debit card|social security|aadhaar|passport number|api[- ]?key|secret key|seed phrase|private key|mfa|2fa|verification code)\b"

_TOKENS = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.DOTALL)
ACTION = "struct<code:string,type:string,ref:string,target:map<string,string>,text:string,amount:double,submit:boolean>"


def json_objects(text: str) -> list[str]:
    """Outermost {...} of a text, braces in strings aside."""
    out, depth, begin = [], 0, 0
    for m in _TOKENS.finditer(text):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[begin : m.end()])
    return out


def read_action(text: str | None) -> dict:
    """The one action in a text: code is ok, or what is wrong."""
    fail = lambda code: {"code": code}
    if not text or not text.strip():
        return fail("empty-input")
    found = json_objects(text)
    if not found:
        return fail("no-json-found")
    actions, unknown, broken = [], False, False
    for chunk in found:
        try:
            value = json.loads(chunk)
        except (ValueError, RecursionError):  # the latter where brackets go deeper than any action's
            broken = True
            continue
        inner = value.get("action")
        value = inner if isinstance(inner, dict) and isinstance(inner.get("type"), str) else value
        if value.get("type") in FIELDS if isinstance(value.get("type"), str) else False:
            actions.append(value)
        else:
            unknown |= isinstance(value.get("type"), str)
    if len(actions) != 1:
        return fail("multiple-actions" if actions else "unknown-type" if unknown else "malformed-json" if broken else "not-an-object")
    a = actions[0]
    kind, out = a["type"], {"code": "ok", "type": a["type"], "submit": a.get("submit") is True}
    if kind in ("click", "type", "select"):
        target = a.get("target")
        if target is not None:
            if not isinstance(target, dict) or any(isinstance(target.get(k), (bool, list, dict)) for k in TARGET_KEYS):
                return fail("bad-field-type")
            out["target"] = {k: str(target[k])[:300] for k in TARGET_KEYS if target.get(k) is not None and str(target[k]).strip()}
            if not out["target"]:
                return fail("missing-field")
        elif a.get("ref") is None:
            return fail("missing-field")
        elif not isinstance(a["ref"], str):
            return fail("bad-field-type")
        else:
            out["ref"] = a["ref"]
    for f in FIELDS[kind]:
        if f not in a:
            return fail("missing-field")
        if not isinstance(a[f], str) or a[f] not in CHOICES.get(f, (a[f],)):
            return fail("bad-field-type")
        out["text"] = a[f]
    if kind in NUMBERS:
        name, usual, most = NUMBERS[kind]
        v = a.get(name, usual)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or isinstance(v, float) and not math.isfinite(v):
            return fail("bad-field-type")
        if not 0 <= v <= most:  # whole numbers of any length compare exactly
            return fail("out-of-range")
        out["amount"] = float(v)
    return out


def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = [read_action(t) for t in texts]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("code", "type", "ref", "target", "text", "amount", "submit")})


def parse_actions(outputs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and `action`: code (ok, or an error code), type, ref, target, text, amount, submit."""
    return outputs.withColumn("action", F.pandas_udf(_parse, ACTION)(F.col(text)))


def limits_of(elements: DataFrame) -> DataFrame:
    """Per page what actions may do: valid, sensitive and typeable refs."""
    typeable = F.col("role").isin("textbox", "searchbox", "combobox", "spinbutton")
    pick = lambda cond: F.collect_set(F.when(cond, F.col("ref")))
    return elements.groupBy("page_id").agg(pick(F.lit(True)).alias("valid"), pick(F.col("is_sensitive")).alias("sensitive"), pick(typeable).alias("typeable"))


def refusal(action: Column, valid: Column, sensitive: Column, typeable: Column, origins: Column, current: Column | None = None, resolved: Column | None = None, confirmed: bool = False) -> Column:
    """Why an action may not run, or null.

    resolved: struct(status, ref) of the action's target; current: text that its field holds.
    """
    kind, text = action["type"], action["text"]
    ref = F.coalesce(resolved["ref"], action["ref"]) if resolved is not None else action["ref"]
    known = F.coalesce(F.array_contains(valid, ref), F.lit(False))
    targeted = action["target"].isNotNull()
    status = resolved["status"] if resolved is not None else F.lit("no-match")
    touches = kind.isin("click", "type", "select")
    origin = F.regexp_extract(F.lower(text), r"^(https?://[^/?#]+)", 1)
    absolute = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    guard = F.lit(confirmed)
    return (
        F.when(action["code"] != "ok", action["code"])
        .when(touches & targeted & (F.coalesce(status, F.lit("no-match")) == "ambiguous"), "ambiguous-target")
        .when(touches & targeted & (F.coalesce(status, F.lit("no-match")) != "ok"), "no-such-target")
        .when(touches & ~known, "unknown-ref")
        .when((kind == "type") & F.array_contains(sensitive, ref) & ~guard, "sensitive-target")
        .when((kind == "type") & ~F.coalesce(F.array_contains(typeable, ref), F.lit(False)), "not-typeable")
        .when((kind == "type") & (F.length(text) > MAX_TYPE_CHARS), "text-too-long")
        .when((kind == "type") & ~action["submit"] & (text != "") & (F.trim(current if current is not None else F.lit(None).cast("string")) == F.trim(text)), "already-typed")
        .when((kind == "navigate") & (~absolute | (origin == "")), "bad-url")
        .when((kind == "navigate") & ~F.array_contains(origins, origin), "origin-not-allowed")
        .when((kind == "scroll") & (action["amount"] > MAX_SCROLL_PX), "scroll-too-far")
        .when((kind == "wait") & (action["amount"] > MAX_WAIT_MS), "wait-too-long")
        .when((kind == "ask_user") & text.rlike(CREDENTIALS), "asks-for-credential")
    )


def clean_words(action: Column) -> Column:
    """The text of a question, summary or reason, neutralised and capped."""
    most = F.when(action["type"] == "done", 600).otherwise(200)
    return F.when(action["type"].isin("ask_user", "done", "abort"), F.substring(T.neutralize(action["text"]), F.lit(1), most)).otherwise(action["text"])
