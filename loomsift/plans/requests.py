"""Queries on whole requests: a request holds one document's texts, tampered with by the document's number."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.functions.text import FENCES
from loomsift.operators import payloads as P
from loomsift.operators.spans import MARKUP_TAGS
from loomsift.plans.catalog import _sql_spans, query, table

_ATOM = '{"kind":"page-data","text":%s,"redacted":false,"truncated":false}'
#: A request; TEXT, LANG and SOURCE are a document's, as JSON strings.
_REQUEST = (
    '{"schemaVersion":1,"taskId":"t","step":3,"goal":"read it","url":"https://a.example/","nonce":"5eed","viewport":{"w":1280},"redactionSummary":{},"budget":{},'
    f'"title":{_ATOM % "TEXT"},"history":[{{"name":{_ATOM % "LANG"},"note":SOURCE}}],"clarifications":[{{"question":LANG}}],'
    f'"elements":[{{"ref":"e1","role":"link","isSensitive":false,"name":{_ATOM % "SOURCE"},"groupName":null,"tag":"a","container":0,"attrs":[{{"key":"href","value":{_ATOM % "LANG"}}}]}}],'
    '"containers":[{"tag":"li","role":null,"parent":null,"attrs":[]}],'
    f'"analysis":{{"schemaVersion":1,"columns":[{{"index":0,"label":{_ATOM % "SOURCE"},"kind":"numeric","stats":{{"mean":[1.5]}}}}],"trends":[{{"direction":"rising"}}],"refusal":null}},'
    '"screenshot":{"base64":"QQ","format":"png","width":768,"height":432,"opsRequested":3,"opsApplied":2,"opsOutsideFrame":1}}'
)
#: What is put in the place of what, by a document's number; the first leaves the request as it is.
_TAMPERED = [
    ("~", "~"), ('"budget":', '"html":"<b>","budget":'), ('"step":3', '"step":"3"'), ('"ref":"e1"', '"ref":"e1","domPath":"body"'), ('"groupName":null', '"groupName":"bare"'), ('"groupName":null', '"groupName":{}'),
    ('"tag":"a"', '"tag":"<a>"'), ('"key":"href"', '"key":"onclick"'), ('"role":null', '"role":"List item"'), ('"parent":null,', ""), ('"kind":"numeric"', '"kind":"money"'), ('"mean":[1.5]', '"mean":[{"who":"x"}]'),
    ('"opsApplied":2', '"opsApplied":1'), ('"opsApplied":2,', ""), ('"format":"png"', '"format":"gif"'), ('"goal":"read it"', '"goal":"[[PII:EMAIL:1:bad]] [[PII:EMAIL:2:5eed]]"'), ('"groupName":null', '"groupName":' + _ATOM % '"a ``` b"'),
    ('"groupName":null', '"groupName":' + (_ATOM % '"x"').replace('"redacted":false,', "")), ('"nonce":"5eed"', '"nonce":""'), ('"schemaVersion":1,"taskId"', '"schemaVersion":2,"taskId"'), ('"attrs":[]', '"attrs":[7,{"key":"id","value":null,"more":1}]'),
    ('"width":768', '"width":0'), ('"refusal":null', '"refusal":"no-table-found","pages":2'), ('"elements":[', '"elements":[[],'), ('"groupName":null', '"groupName":' + _ATOM % '"<div>mail jane.doe@mail.example.com"'),
]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = {}
    for word, column in (("TEXT", "text"), ("LANG", "lang"), ("SOURCE", "source")):
        whole = F.to_json(F.struct(F.coalesce(column, F.lit("")).alias("t")))
        said[word] = F.substring(whole, F.lit(6), F.length(whole) - 6)
    parts = [said.get(p, F.lit(p)) for p in re.split("(TEXT|LANG|SOURCE)", _REQUEST)]
    which = (F.col("doc_id") % len(_TAMPERED)).cast("int")
    old, new = (F.get(F.array(*[F.lit(x[i]) for x in _TAMPERED]), which) for i in (0, 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.concat(*parts), old, new).alias("json"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


_SQL_REQUEST = _quoted(_REQUEST).replace("TEXT", "' || to_json(coalesce(text, '')) || '").replace("LANG", "' || to_json(coalesce(lang, '')) || '").replace("SOURCE", "' || to_json(coalesce(source, '')) || '")
_SQL_TAMPERED = f"replace({_SQL_REQUEST}, {_sql_list(a for a, _ in _TAMPERED)}[CAST(doc_id % {len(_TAMPERED)} AS INT) + 1], {_sql_list(b for _, b in _TAMPERED)}[CAST(doc_id % {len(_TAMPERED)} AS INT) + 1])"
_SQL_VALUES = f"""p AS (SELECT doc_id, {_SQL_TAMPERED} AS j FROM documents),
    r AS (SELECT doc_id, j, coalesce(json_type(j) = 'OBJECT' AND json_extract_string(j, '$.schemaVersion') = '1', false) AS fit FROM p),
    x AS (SELECT r.doc_id, substr(t.fullkey, 3) AS path, substr(t.path, 3) AS above, t.key, t.atom ->> '$' AS text,
        CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM r, json_tree(r.j) AS t WHERE fit),
    v AS (SELECT *, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS place, regexp_replace(above, '\\[\\d+\\]', '[]', 'g') AS place_above, regexp_extract(path, '([A-Za-z_]+)(\\[\\d+\\])*$', 1) AS name FROM x)"""
_KEY_ROWS = ", ".join(f"({_quoted(p)}, {_sql_list(k)})" for p, k in P.KEYS.items())
_SHAPE_ROWS = ", ".join(f"({_quoted(p)}, {_quoted(m)}, {_sql_list(k.split())}, {_quoted(P._OTHER_CODES.get((p, m), 'unbaked-screenshot' if p == 'screenshot' else 'missing-field'))})" for p, s in P.SHAPES.items() for m, k in s.items())
_WORD_ROWS = ", ".join(f"({_quoted(k)}, {_sql_list(w)})" for k, w in P.WORDS.items())
_FENCED = " OR ".join(f"contains(text, {_quoted(m)})" for m in FENCES)
_SQL_VIOLATIONS = f"""o AS (SELECT v.doc_id, v.path, list(c.key) FILTER (c.key IS NOT NULL) AS keys, max(CASE WHEN c.key = 'kind' THEN c.text END) = 'page-data' AS marked, bool_or(c.key = 'text' AND c.kind = 'string') AS has_text
        FROM v LEFT JOIN v c ON c.doc_id = v.doc_id AND c.above = v.path AND c.path <> '' WHERE v.kind = 'object' GROUP BY ALL),
    a AS (SELECT v.*, keys, coalesce(marked, false) AS marked, coalesce(list_sort(keys) = {_sql_list(sorted(P.ATOM_KEYS))} AND has_text, false) AS whole FROM v LEFT JOIN o USING (doc_id, path)),
    s AS (SELECT doc_id, max(CASE WHEN key = 'opsRequested' THEN CAST(text AS DOUBLE) END) - max(CASE WHEN key = 'opsOutsideFrame' THEN CAST(text AS DOUBLE) END) AS due, max(CASE WHEN key = 'opsApplied' THEN CAST(text AS DOUBLE) END) AS done FROM v WHERE above = 'screenshot' AND kind = 'number' GROUP BY doc_id),
    found AS (
        SELECT doc_id, '' AS path, 'not-a-context' AS code FROM r WHERE NOT fit
        UNION ALL SELECT doc_id, above, 'unexpected-field' FROM v JOIN (VALUES {_KEY_ROWS}) AS k(p, allowed) ON v.place_above = k.p WHERE path <> '' AND NOT list_contains(allowed, key) AND NOT place LIKE '%[]'
        UNION ALL SELECT b.doc_id, b.path, h.code FROM v b JOIN (VALUES {_SHAPE_ROWS}) AS h(p, member, kinds, code) ON b.place = h.p AND b.kind = 'object'
            LEFT JOIN v c ON c.doc_id = b.doc_id AND c.path = CASE WHEN b.path = '' THEN member ELSE b.path || '.' || member END WHERE NOT list_contains(kinds, coalesce(c.kind, 'absent'))
        UNION ALL SELECT doc_id, path, 'missing-field' FROM v WHERE list_contains({_sql_list(P.ITEMS)}, place) AND kind <> 'object'
        UNION ALL SELECT doc_id, path, CASE WHEN kind = 'object' AND marked THEN 'unexpected-field' ELSE 'unquoted-page-text' END FROM a WHERE list_contains({_sql_list(P.ATOMS)}, place) AND kind <> 'null' AND NOT (kind = 'object' AND marked AND whole)
        UNION ALL SELECT doc_id, path, 'fence-token' FROM v WHERE list_contains({_sql_list(f"{x}.text" for x in P.ATOMS)}, place) AND ({_FENCED})
        UNION ALL SELECT doc_id, path, 'missing-field' FROM v WHERE place = 'nonce' AND text = ''
        UNION ALL SELECT doc_id, path, 'unexpected-field' FROM v WHERE kind = 'string' AND (place IN ('elements[].tag', 'containers[].tag') AND NOT regexp_matches(text, '{P.TAG}') OR place = 'containers[].role' AND NOT regexp_matches(text, '{P.ROLE}')
            OR place IN ('elements[].attrs[].key', 'containers[].attrs[].key') AND NOT list_contains({_sql_list(P.ATTRIBUTES)}, text))
        UNION ALL SELECT doc_id, path, 'unquoted-page-text' FROM v LEFT JOIN (VALUES {_WORD_ROWS}) AS w(word, known) ON v.name = w.word WHERE kind = 'string' AND starts_with(place, 'analysis.') AND NOT starts_with(place, 'analysis.columns[].label') AND NOT coalesce(list_contains(known, text), false)
        UNION ALL SELECT doc_id, path, 'unbaked-screenshot' FROM v WHERE place = 'screenshot.format' AND text NOT IN ('jpeg', 'png') OR place IN ('screenshot.width', 'screenshot.height') AND CAST(text AS DOUBLE) <= 0 OR place = 'screenshot.base64' AND text = ''
        UNION ALL SELECT doc_id, 'screenshot', 'unverified-screenshot' FROM s WHERE due > done
        UNION ALL SELECT doc_id, path, 'forged-placeholder' FROM v JOIN r USING (doc_id) WHERE kind = 'string' AND json_extract_string(j, '$.nonce') <> '' AND len(list_filter(regexp_extract_all(text, '\\[\\[PII:[A-Z_]+:\\d+:[0-9a-f]*\\]\\]'), lambda m: NOT contains(m, ':' || json_extract_string(j, '$.nonce') || ']]'))) > 0)"""
_SQL_FIELDS = f"""f AS (SELECT c.doc_id, CASE WHEN c.key = 'text' AND NOT list_contains({_sql_list(P.FIELDS)}, c.place) THEN c.above ELSE c.path END AS path, c.text FROM v c LEFT JOIN v k ON k.doc_id = c.doc_id AND k.above = c.above AND k.key = 'kind' AND k.path <> ''
    WHERE c.kind = 'string' AND c.text <> '' AND (list_contains({_sql_list(P.FIELDS)}, c.place) OR c.key = 'text' AND list_contains({_sql_list(P.FIELDS)}, c.place_above) AND k.text = 'page-data'))"""


@query(f"WITH {_SQL_VALUES}, {_SQL_VIOLATIONS} SELECT doc_id, path, code FROM found")
def e1_whole_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All violations of requests, those of an analysis and a picture among them."""
    return P.violations(_requests(spark, sf_dir), "doc_id").select("doc_id", "path", "code")


@query(f"WITH {_SQL_VALUES}, {_SQL_FIELDS} SELECT doc_id, path, len(text) AS chars, md5(text) AS md5 FROM f")
def e6_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of requests that a model reads."""
    return P.text_fields(_requests(spark, sf_dir), "doc_id").select("doc_id", "path", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))


@query(f"""
    WITH {_SQL_VALUES}, {_SQL_VIOLATIONS}, {_SQL_FIELDS},
    g AS (SELECT doc_id, doc_id || ' ' || path AS id, regexp_replace(text, '\\[\\[PII:[A-Z_]+:\\d+:[0-9a-f]*\\]\\]', ' ', 'g') AS text, regexp_matches(text, '(?i)<\\s*(?:{'|'.join(MARKUP_TAGS)})\\b') AS markup FROM f), {_sql_spans('m', 'g')},
    n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM g JOIN m USING (id) WHERE confidence >= 0.5 UNION ALL SELECT doc_id FROM g WHERE markup) GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS n_fields FROM f GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n_violations FROM found GROUP BY doc_id)
    SELECT doc_id, coalesce(n_fields, 0) AS n_fields, coalesce(n_violations, 0) AS n_violations, coalesce(n, 0) AS n_findings, b.doc_id IS NULL AND n.doc_id IS NULL AS ok FROM p LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def e8_request_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May each request leave? Those of documents with personal data may not, nor those tampered with."""
    return P.verdicts(_requests(spark, sf_dir), "doc_id")
