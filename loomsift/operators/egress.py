"""Checks on JSON that leaves: allowed keys only, whole atoms, own placeholders, no personal data. They fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions.text import FENCES
from loomsift.operators.spans import text_leaks

#: Keys that a payload, an element and a text atom may have.
CONTEXT_KEYS = ("schemaVersion", "taskId", "step", "goal", "url", "title", "viewport", "elements", "screenshot", "redactionSummary", "nonce", "history", "clarifications", "budget", "analysis", "containers")
ELEMENT_KEYS = ("ref", "role", "name", "groupName", "value", "rect", "states", "isSensitive", "tag", "attrs", "container")
ATOM_KEYS = ("kind", "text", "redacted", "truncated")
MAX_REQUEST_BYTES = 2 * 1024 * 1024


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object that aren't allowed; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed])))


def bad_atom(json: Column) -> Column:
    """Why a JSON text atom may not leave: its keys, its kind, or a fence mark in its text; else null."""
    keys = F.array_sort(F.json_object_keys(json))
    text = F.get_json_object(json, "$.text")
    fenced = F.lit(False)
    for mark in FENCES:
        fenced |= F.contains(text, F.lit(mark))
    whole = keys == F.array(*[F.lit(k) for k in sorted(ATOM_KEYS)])
    return F.when(~F.coalesce(whole, F.lit(False)), "atom-keys").when(F.coalesce(F.get_json_object(json, "$.kind") != "page-data", F.lit(True)), "atom-kind").when(F.coalesce(fenced, F.lit(False)), "fence-token")


def inspect_payloads(payloads: DataFrame, key: str = "payload_id", json: str = "json") -> DataFrame:
    """Violations of each payload: key, code, detail. None means that it may leave."""
    j = F.col(json)
    top = F.transform(unknown_keys(j, CONTEXT_KEYS), lambda k: F.struct(F.lit("unknown-key").alias("code"), k.alias("detail")))
    each = F.from_json(F.get_json_object(j, "$.elements"), "array<string>")
    odd = F.flatten(F.transform(each, lambda e: F.transform(F.coalesce(unknown_keys(e, ELEMENT_KEYS), F.array(F.lit("?"))), lambda k: F.struct(F.lit("unknown-element-key").alias("code"), k.alias("detail")))))
    names = F.filter(F.transform(each, lambda e: F.get_json_object(e, "$.name")), lambda n: n.isNotNull())
    atoms = F.transform(F.filter(F.transform(names, bad_atom), lambda c: c.isNotNull()), lambda c: F.struct(F.lit("bad-atom").alias("code"), c.alias("detail")))
    shape = F.when(F.json_object_keys(j).isNull(), F.array(F.struct(F.lit("not-an-object").alias("code"), F.lit("").alias("detail"))))
    version = F.when(F.coalesce(F.get_json_object(j, "$.schemaVersion") != "1", F.lit(True)), F.array(F.struct(F.lit("schema-version").alias("code"), F.coalesce(F.get_json_object(j, "$.schemaVersion"), F.lit("none")).alias("detail"))))
    size = F.when(F.octet_length(j) > MAX_REQUEST_BYTES, F.array(F.struct(F.lit("too-large").alias("code"), F.octet_length(j).cast("string").alias("detail"))))
    found = F.flatten(F.array_compact(F.array(shape, version, size, top, odd, atoms)))
    return payloads.select(F.col(key), F.explode(found).alias("v")).select(key, "v.*")


def inspect_screenshots(shots: DataFrame) -> DataFrame:
    """The rows whose counters don't show that every requested operation was applied or lay outside.

    Columns: requested, applied, outside; a missing or negative counter is a violation too.
    """
    r, a, o = F.col("requested"), F.col("applied"), F.col("outside")
    fine = (r >= 0) & (a >= 0) & (o >= 0) & (o <= r) & (r - o <= a)
    return shots.where(~F.coalesce(fine, F.lit(False)))


def verify(texts: DataFrame, key: str, text: str, nonce: str, min_confidence: float = 0.5) -> DataFrame:
    """One row per row of `texts`: key, n_findings, ok. A null text has no findings."""
    n = F.aggregate(text_leaks(text, nonce, min_confidence), F.lit(0).cast("long"), lambda a, f: a + f["n"])
    return texts.select(F.col(key), n.alias("n_findings")).withColumn("ok", F.col("n_findings") == 0)


def demand_clean(checked: DataFrame) -> DataFrame:
    """The rows as they are; reading them fails if one isn't ok."""
    return checked.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.lit("a text that must be clean has findings")).cast("boolean")))
