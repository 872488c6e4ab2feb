"""Whole JSON requests before they leave: every value of any nesting is a row, checked by its place.

A place is a path without its numbers, such as elements[].attrs[].value. What may stand at a place is told by the
tables below; whatever they don't name is a violation, so a new field fails closed. Details name places and members
and never quote a text. Checks are column expressions on one value's row; only verdicts meet the rows of a request.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from itertools import accumulate, chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions.cells import PLACEHOLDER
from loomsift.functions.text import FENCES
from loomsift.operators.egress import ATOM_KEYS, CONTEXT_KEYS, ELEMENT_KEYS, MAX_REQUEST_BYTES
from loomsift.operators.spans import MARKUP_TAGS, text_spans

#: Members that an object at a place may have.
KEYS = {
    "": CONTEXT_KEYS,
    "elements[]": ELEMENT_KEYS,
    "elements[].attrs[]": ("key", "value"),
    "containers[]": ("tag", "role", "attrs", "parent"),
    "containers[].attrs[]": ("key", "value"),
    "analysis": ("schemaVersion", "tablesFound", "tableIndex", "rowsAnalyzed", "cellsRead", "columns", "trends", "correlations", "outliers", "forecasts", "series", "chartsDetected", "computeMs", "refusal"),
    "analysis.columns[]": ("index", "label", "kind", "n", "nMissing", "nRedacted", "nUnparsed", "distinct", "stats"),
}
#: JSON kinds that a member may have; `absent` where it may be missing.
SHAPES = {
    "": {
        "taskId": "string", "step": "number", "goal": "string", "url": "string", "nonce": "string", "viewport": "object", "redactionSummary": "object", "budget": "object",
        "history": "array", "clarifications": "array", "elements": "array", "containers": "array absent", "analysis": "object null absent", "screenshot": "object null absent",
    },
    "elements[]": {"ref": "string", "role": "string", "isSensitive": "boolean", "tag": "string absent", "container": "number null absent", "attrs": "array absent"},
    "containers[]": {"tag": "string", "role": "string null", "parent": "number null", "attrs": "array absent"},
    "elements[].attrs[]": {"key": "string", "value": "object"},
    "containers[].attrs[]": {"key": "string", "value": "object"},
    "analysis": {"columns": "array absent"},
    "screenshot": {"base64": "string", "format": "string", "width": "number", "height": "number", "opsRequested": "number", "opsApplied": "number", "opsOutsideFrame": "number"},
}
#: Wrong kinds that aren't told as `missing-field`.
_OTHER_CODES = {("", "analysis"): "not-a-context", ("", "screenshot"): "unbaked-screenshot", ("elements[]", "tag"): "unexpected-field", ("containers[]", "tag"): "unexpected-field", ("containers[]", "role"): "unexpected-field"}
#: Items of these arrays are objects.
ITEMS = ("elements[]", "containers[]", "elements[].attrs[]", "containers[].attrs[]", "analysis.columns[]")
#: Texts of a page: whole atoms or nothing.
ATOMS = ("title", "elements[].name", "elements[].groupName", "elements[].value", "elements[].attrs[].value", "containers[].attrs[].value", "analysis.columns[].label")
#: Texts that a model reads; these may be plain strings, too.
FIELDS = (*ATOMS, "history[].name", "history[].note", "clarifications[].question")
#: Attributes that may leave, formats of pictures, words that an analysis may hold.
ATTRIBUTES = ("id", "name", "type", "placeholder", "href", "aria-label")
FORMATS = ("jpeg", "png")
WORDS = {
    "kind": ("numeric", "temporal", "categorical", "redacted", "unknown"),
    "direction": ("rising", "falling", "flat", "high", "low"),
    "strength": ("none", "weak", "moderate", "strong"),
    "method": ("linear-least-squares", "last-value", "moving-average"),
    "band": ("low", "medium", "high"),
    "momentum": ("accelerating", "steady", "decelerating"),
    "refusal": ("no-table-found", "no-numeric-column", "too-many-cells", "timed-out", "all-columns-redacted"),
}
#: Names of tags and of roles.
TAG, ROLE = "^[a-z][a-z0-9-]{0,40}$", "^[a-z][a-z-]{0,40}$"

#: Values below this depth aren't walked; their request has a violation. Characters of names in details, of values that
#: members are known by, and of rows that leave the walk at once.
DEEPEST, _NAME, _SHORT, _ROWS = 64, 40, 64, 4 << 20

_VALUE = "path string, place string, name string, kind string, text string, within string, members map<string,struct<kind:string,value:string>>, twice boolean, foreign bigint, fit boolean"
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


class _Twice(dict):
    """An object of which the text names a member twice; the last value counts, but the first would leave, too."""


def _object(pairs: list) -> dict:
    whole = dict(pairs)
    return whole if len(whole) == len(pairs) else _Twice(whole)


def _no_number(word: str):
    raise ValueError(word)


_KINDS = {type(None): "null", bool: "boolean", float: "number", str: "string", list: "array"}


def _kind(value) -> str:
    return _KINDS.get(type(value), "object")


def _scalar(value) -> str | None:
    """A scalar as text; halves of character pairs, which no column can hold, become question marks."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, bool):
        return "true" if value else "false"
    return repr(value) if isinstance(value, float) else None


def _values(text: str | None) -> Iterator[tuple]:
    """The values of one request in document order, as rows of _VALUE."""
    try:
        root = json.loads(text, object_pairs_hook=_object, parse_int=float, parse_constant=_no_number)
    except (TypeError, ValueError, RecursionError):
        yield "", "", "", "malformed", None, None, {}, False, 0, False
        return
    fit = isinstance(root, dict) and type(root.get("schemaVersion")) is float and root["schemaVersion"] == 1
    nonce = root.get("nonce") if isinstance(root, dict) else None
    own = f":{nonce}]]" if isinstance(nonce, str) and nonce else None
    foreign = lambda s: sum(own not in m for m in re.findall(PLACEHOLDER, s, re.ASCII)) if own and "[[" in s else 0
    left = [("", "", "", root, None, 0)]
    while left:
        path, place, name, value, within, depth = left.pop()
        below, members, strange = [], {}, 0
        if depth > DEEPEST:
            yield path, place, name, "too-deep", None, within, {}, False, 0, fit
            continue
        if isinstance(value, dict):
            marker = value.get("kind")
            marker = _scalar(marker) if isinstance(marker, str) and len(marker) <= _SHORT else None
            for k, v in value.items():
                strange += foreign(k)
                said = _scalar(k)[:_NAME]
                plain = said if k == said and _PLAIN.fullmatch(k) else f'["{said}"]'
                dot = "." if path and plain == said else ""
                below.append((path + dot + plain, place + dot + plain, plain, v, marker, depth + 1))
                members[plain] = (_kind(v), None if isinstance(v, str) and len(v) > _SHORT else _scalar(v))
        elif isinstance(value, list):
            below = [(f"{path}[{i}]", f"{place}[]", name, v, None, depth + 1) for i, v in enumerate(value)]
        elif isinstance(value, str):
            strange = foreign(value)
        left.extend(reversed(below))
        yield path, place, name, _kind(value), _scalar(value), within, members, isinstance(value, _Twice), strange, fit


def _walk(batches: Iterator) -> Iterator:
    """Batches of (key, request) as batches of values, of some 4 million characters each."""
    import pyarrow as pa

    types = [pa.string()] * 6 + [None, pa.bool_(), pa.int64(), pa.bool_()]

    def members(maps: list[dict]) -> pa.MapArray:
        """The maps from three flat columns: names, kinds, values."""
        ends = list(accumulate(map(len, maps), initial=0))
        said = [v for m in maps for v in m.values()]
        flat = pa.StructArray.from_arrays([pa.array([k for k, _ in said], pa.string()), pa.array([v for _, v in said], pa.string())], names=["kind", "value"])
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for m in maps for k in m], pa.string()), flat)

    def packed(keys: pa.Array, at: list[int], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = [pa.array(c, t) if t else members(c) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], names=names)

    names = ["key", *[c.split()[0] for c in _VALUE.split(", ")]]
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        at, rows, size = [], [], 0
        for i in range(batch.num_rows):
            for row in _values(texts[i].as_py()):
                at.append(i)
                rows.append(row)
                size += 200 + len(row[0]) + len(row[1]) + len(row[4] or "") + 100 * len(row[6])
                if size > _ROWS:
                    yield packed(keys, at, rows, names)
                    at, rows, size = [], [], 0
        if rows:
            yield packed(keys, at, rows, names)


def values(requests: DataFrame, key: str = "payload_id", json: str = "json") -> DataFrame:
    """Every value of every request as a row: key, path, place, name, kind, text, within, members, twice, foreign, fit.

    path: where it is, with numbers; place: without; name: the member it is, or is an item of. kind: a JSON kind, or
    `malformed` for a text that is no JSON (a null text, too), `too-large`, `too-deep`. text: of scalars. within: the
    `kind` of the object it is a member of. members: of objects, by name, kind and short value. twice: is a member
    named twice? foreign: placeholders in it, or in its members' names, that don't carry the request's nonce. fit: is
    the request an object of version 1? A request has one row at least. Rows of one key stay rows of their own.
    """
    k, j = F.col(f"`{key}`").alias("key"), F.col(f"`{json}`").cast("string")
    large = F.coalesce(F.octet_length(j) > MAX_REQUEST_BYTES, F.lit(False))
    walked = requests.where(~large).select(k, j.alias("json"))
    walked = walked.mapInArrow(_walk, f"key {requests.schema[key].dataType.simpleString()}, {_VALUE}")
    refused = {"kind": F.lit("too-large"), "path": F.lit(""), "place": F.lit(""), "name": F.lit(""), "twice": F.lit(False), "foreign": F.lit(0).cast("long"), "fit": F.lit(False), "members": F.create_map().cast("map<string,struct<kind:string,value:string>>")}
    rest = requests.where(large).select(k, *[refused.get(c, F.lit(None).cast("string")).alias(c) for c in walked.columns[1:]])
    return walked.unionByName(rest).withColumnRenamed("key", key)


def _found(code: Column | str, detail: Column) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), detail.alias("detail"))


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _at(table: dict, place: Column) -> Column:
    """The array of structs or names that a table has for a place; null at others."""
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(p), v) for p, v in table.items())), place)


def found_in() -> Column:
    """Violations of one row of `values`, structs (code, detail); empty if there is none."""
    place, path, kind, text, name = F.col("place"), F.col("path"), F.col("kind"), F.col("text"), F.col("name")
    here = F.when(path == "", F.lit("the request")).otherwise(path)
    member = lambda k: F.concat(path, F.when(path == "", "").otherwise("."), k)
    keys, one = F.map_keys("members"), lambda condition, code, detail: F.when(F.coalesce(condition, F.lit(False)), F.array(_found(code, detail)))
    value = lambda k: F.col("members")[k]["value"].cast("double")
    atom = place.isin(*ATOMS)

    unknown = F.transform(F.array_sort(F.array_except(keys, _at({p: _words(k) for p, k in KEYS.items()}, place))), lambda k: _found("unexpected-field", F.concat(member(k), F.lit(" is no field of a request"))))
    wanted = {p: F.array(*[F.struct(F.lit(m).alias("m"), F.lit(kinds).alias("kinds"), F.lit(_OTHER_CODES.get((p, m), "unbaked-screenshot" if p == "screenshot" else "missing-field")).alias("code")) for m, kinds in s.items()]) for p, s in SHAPES.items()}
    has = lambda w: F.coalesce(F.col("members")[w["m"]]["kind"], F.lit("absent"))
    wrong = F.transform(F.filter(_at(wanted, place), lambda w: ~F.array_contains(F.split(w["kinds"], " "), has(w))), lambda w: _found(w["code"], F.concat(member(w["m"]), F.lit(" is "), has(w), F.lit(", not "), F.regexp_replace(w["kinds"], " ", " or "))))
    whole = (F.array_sort(keys) == _words(tuple(sorted(ATOM_KEYS)))) & (F.col("members")["text"]["kind"] == "string")
    marked = F.col("members")["kind"]["value"] == "page-data"
    fenced = F.lit(False)
    for mark in FENCES:
        fenced |= F.contains(text, F.lit(mark))
    in_atom = (name == "text") & place.isin(*[f"{a}.text" for a in ATOMS])
    in_label = place.startswith("analysis.columns[].label")
    known = F.array_contains(_at({k: _words(w) for k, w in WORDS.items()}, name), text)
    ops = value("opsRequested") - value("opsOutsideFrame") > value("opsApplied")
    positive = lambda v: F.coalesce((v > 0) & (v < math.inf), F.lit(False))
    counters = F.exists(F.array(*[value(c) for c in ("opsRequested", "opsApplied", "opsOutsideFrame")]), lambda v: v == math.inf)
    is_object, is_string = kind == "object", kind == "string"

    fitting = [
        F.when(is_object, unknown),
        F.when(is_object, wrong),
        one(F.col("twice"), "unexpected-field", F.concat(here, F.lit(" names a member twice"))),
        one(place.isin(*ITEMS) & ~is_object, "missing-field", F.concat(here, F.lit(" is no object"))),
        one(atom & ~is_object & (kind != "null"), "unquoted-page-text", F.concat(here, F.lit(" is "), kind, F.lit(", not a text atom"))),
        one(atom & is_object & ~F.coalesce(marked, F.lit(False)), "unquoted-page-text", F.concat(here, F.when(F.size(keys) == 0, " is an empty object, not a text atom").otherwise(" is no text atom"))),
        one(atom & is_object & marked & ~F.coalesce(whole, F.lit(False)), "unexpected-field", F.concat(here, F.lit(" is an atom of other members"))),
        one(in_atom & fenced, "fence-token", F.concat(here, F.lit(" holds a mark that ends the data of a prompt"))),
        one((place == "nonce") & is_string & (text == ""), "missing-field", F.lit("nonce is empty")),
        one(place.isin("elements[].tag", "containers[].tag") & is_string & ~text.rlike(TAG), "unexpected-field", F.concat(here, F.lit(" is no tag name"))),
        one((place == "containers[].role") & is_string & ~text.rlike(ROLE), "unexpected-field", F.concat(here, F.lit(" is no role name"))),
        one(place.isin("elements[].attrs[].key", "containers[].attrs[].key") & is_string & ~text.isin(*ATTRIBUTES), "unexpected-field", F.concat(here, F.lit(" is no attribute that may leave"))),
        one(place.startswith("analysis.") & ~in_label & is_string & ~F.coalesce(known, F.lit(False)), "unquoted-page-text", F.concat(here, F.lit(" is a text that no analysis holds"))),
        one((place == "screenshot.base64") & is_string & (text == ""), "unbaked-screenshot", F.lit("screenshot.base64 is empty")),
        one((place == "screenshot.format") & is_string & ~text.isin(*FORMATS), "unbaked-screenshot", F.lit("screenshot.format is neither jpeg nor png")),
        one(place.isin("screenshot.width", "screenshot.height") & (kind == "number") & ~positive(text.cast("double")), "unbaked-screenshot", F.concat(here, F.lit(" isn't positive"))),
        one((place == "screenshot") & is_object & counters, "unbaked-screenshot", F.lit("a counter of screenshot isn't finite")),
        one((place == "screenshot") & is_object & ops, "unverified-screenshot", F.lit("screenshot shows what operations should have covered")),
        one(F.col("foreign") > 0, "forged-placeholder", F.concat(F.col("foreign").cast("string"), F.lit(" placeholders in "), here, F.lit(" carry another nonce"))),
    ]
    none = F.array().cast("array<struct<code:string,detail:string>>")
    refusal = F.when(kind.isin("malformed", "too-large"), F.array(_found("not-a-context", kind))).otherwise(F.array(_found("not-a-context", F.lit("no object of version 1"))))
    deep = F.array(_found("unexpected-field", F.concat(place, F.lit(" is too deep"))))
    return F.when(~F.col("fit"), F.when(path == "", refusal).otherwise(none)).when(kind == "too-deep", deep).otherwise(F.flatten(F.array_compact(F.array(*fitting))))


def violations(requests: DataFrame, key: str = "payload_id", json: str = "json") -> DataFrame:
    """key, path, code, detail: all violations of every request. A request without a row may leave."""
    rows = values(requests, key, json)
    return rows.select(F.col(f"`{key}`"), "path", F.explode(found_in()).alias("v")).select(F.col(f"`{key}`"), "path", "v.*")


def _field() -> Column:
    """The place of a text that a model reads, at the row that holds the text; else null."""
    inside = F.regexp_extract("place", r"^(.*)\.text$", 1)
    return F.when((F.col("kind") != "string") | (F.col("text") == ""), None).when(F.col("place").isin(*FIELDS), F.col("place")).when(inside.isin(*FIELDS) & (F.col("within") == "page-data"), inside)


def text_fields(requests: DataFrame, key: str = "payload_id", json: str = "json") -> DataFrame:
    """key, path, text: the texts of every request that a model reads, atoms and plain strings, but for empty ones."""
    rows = values(requests, key, json).where(F.col("fit"))
    return rows.where(_field().isNotNull()).select(F.col(f"`{key}`"), F.regexp_replace("path", r"\.text$", "").alias("path"), "text")


def left_in(text: Column, min_confidence: float = 0.5) -> Column:
    """Findings of one text, structs (code, detail): personal data beside placeholders by kind, and markup. No values."""
    beside = F.regexp_replace(text, PLACEHOLDER, " ")
    kinds = F.transform(text_spans(beside, min_confidence), lambda s: _found("personal-data", s["kind"]))
    markup = F.when(text.rlike(rf"(?i)<\s*(?:{'|'.join(MARKUP_TAGS)})\b"), F.array(_found("unquoted-page-text", F.lit("markup"))))
    return F.concat(kinds, F.coalesce(markup, F.array().cast("array<struct<code:string,detail:string>>")))


def verdicts(requests: DataFrame, key: str = "payload_id", json: str = "json", min_confidence: float = 0.5) -> DataFrame:
    """key, n_fields, n_violations, n_findings, ok: may each request leave? Rows of one key are judged together.

    `egress.demand_clean` makes reading fail where one may not.
    """
    rows = values(requests, key, json)
    field = F.col("fit") & _field().isNotNull()
    each = rows.select(F.col(f"`{key}`"), field.cast("long").alias("f"), F.size(found_in()).cast("long").alias("v"), F.when(field, F.size(left_in(F.col("text"), min_confidence))).otherwise(0).cast("long").alias("p"))
    out = each.groupBy(F.col(f"`{key}`")).agg(F.sum("f").alias("n_fields"), F.sum("v").alias("n_violations"), F.sum("p").alias("n_findings"))
    return out.withColumn("ok", (F.col("n_violations") == 0) & (F.col("n_findings") == 0))
