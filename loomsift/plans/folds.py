"""Queries on folds of panels' events: each user is a panel, and an event's number says what it reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.plans.catalog import query, table
from loomsift.streaming import panels as P

#: What an event reports, by a number made of its own, its user's and its value's.
_KINDS = [
    "frame/captured", "vision/done", "detections/merged", "redaction/done", "bake/done", "context/sent", "context/transmitted", "privacy/verified", "action/executed", "step/done",
    "page/verified", "error", "frame/captured", "context/sent", "step/done", "backend/selected", "context/transmitted", "backend/health", "page/verified", "notice",
]
_K = "(event_id * 7 + user_id * 3 + CAST(floor(coalesce(value, 0)) AS BIGINT)) % 20"
#: An event's fields in terms of its number i, the same text for both engines.
_FIELDS = {
    "step": "i % 4 + 1", "ok": "i % 3 > 0", "bytes": "i % 1000", "image_bytes": "i % 2 * 50", "boxes": "i % 6", "regions": "i % 5", "detected": "i % 9", "applied": "i % 7", "forgeries": "i % 2",
    "risk": "CASE WHEN i % 2 = 0 THEN 'none' ELSE 'low' END", "requested": "i % 8", "outside": "i % 3", "elements": "i % 40", "available": "i % 41", "budget": "1000 + i % 10",
    "analysis": "CASE WHEN i % 3 > 0 THEN 'ran' END", "metrics": "i % 11", "channel": "CASE WHEN i % 2 = 0 THEN 'cloud' ELSE 'on-device' END", "model": "concat('m', i % 3)", "kind": "concat('k', i % 2)",
    "endpoint": "'e'", "fields": "i % 30", "leaks": "i % 4", "blocked": "i % 5 = 0", "reason": "concat('r', i % 4)", "changed": "i % 2 = 0", "action": "'click'", "ref": "concat('e', i % 12)", "withheld": "i % 6 = 0",
    "scope": "CASE WHEN i % 2 = 0 THEN 'validate' ELSE 'plan' END", "message": "concat('m', i % 100)", "reachable": "i % 3 = 0", "task": "concat('t', i)", "goal": "'g'",
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("panel"), F.col("event_id").alias("seq"), F.col("event_id").alias("i"), F.col("ts").alias("at"), "value", F.expr(_K).cast("int").alias("k"))
    type_ = F.when((F.col("k") == 19) & (F.col("i") % 5 == 0), "session/start").otherwise(F.element_at(F.array(*map(F.lit, _KINDS)), F.col("k") + 1))
    body = F.to_json(F.struct(F.col("value").alias("ms"), *(F.expr(sql).alias(name) for name, sql in _FIELDS.items())))
    return rows.select("panel", "seq", "at", type_.alias("type"), body.alias("body"))


def _of(field: str, number: str) -> str:
    """A field of the event of that number; null where there is none."""
    return f"CASE WHEN {number} IS NOT NULL THEN {_FIELDS[field].replace('i % ', f'{number} % ').replace(', i)', f', {number})')} END"


_SQL_PLACED = f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS panel, event_id AS s, value AS v, CAST({_K} AS INT) AS k FROM events),
    t AS (SELECT *, CASE WHEN k = 19 AND s % 5 = 0 THEN 'session/start' ELSE {_KINDS}[k + 1] END AS type FROM e),
    r AS (SELECT *, max(s) FILTER (type IN ('session/start', 'frame/captured')) OVER w AS opened, max(s) FILTER (type = 'session/start') OVER w AS ses, max(s) FILTER (type = 'backend/selected') OVER w AS backend,
            max(s) FILTER (type = 'step/done') OVER (PARTITION BY panel ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done, max(s) FILTER (type IN ('session/start', 'step/done')) OVER w AS base,
            max(s) FILTER (type = 'backend/health') OVER w AS health, count(*) FILTER (type = 'frame/captured') OVER w AS frames
        FROM t WINDOW w AS (PARTITION BY panel ORDER BY s)),
    b AS (SELECT *, opened <> coalesce(ses, -1) AND (done IS NULL OR done < opened) AS live,
            CASE WHEN base IS NULL OR base = ses THEN 0 ELSE base % 4 + 1 END + frames - coalesce(max(frames) FILTER (type IN ('session/start', 'step/done')) OVER (PARTITION BY panel ORDER BY s), 0) AS step
        FROM r)
"""
_LAST = {
    "frame": "type = 'frame/captured'", "vision": "type = 'vision/done'", "merged": "type = 'detections/merged'", "redacted": "type = 'redaction/done'", "baked": "type = 'bake/done'", "sent": "type = 'context/sent'",
    "analysed": "type = 'context/sent' AND s % 3 > 0", "told": "type = 'context/transmitted'", "gate": "type = 'privacy/verified'", "stopped": "type = 'privacy/verified' AND s % 5 = 0",
    "refused": "type = 'error' AND s % 2 = 0", "acted": "type = 'action/executed'", "checked": "type = 'page/verified' AND s % 4 + 1 = step",
}
_SQL_RECEIPTS = f"""{_SQL_PLACED},
    own AS (SELECT panel, opened, {', '.join(f'max(s) FILTER ({when}) AS {name}' for name, when in _LAST.items())} FROM b WHERE live GROUP BY panel, opened),
    seals AS (SELECT b.panel, s, v, ses, backend, lead(s) OVER (PARTITION BY b.panel, ses, s % 4 ORDER BY s) AS following, own.* EXCLUDE (panel, opened)
        FROM b LEFT JOIN own ON own.panel = b.panel AND own.opened = b.opened AND b.live WHERE type = 'step/done'),
    late AS (SELECT l.panel, l.s, max(c.s) AS late FROM seals l JOIN b c ON c.type = 'page/verified' AND c.panel = l.panel AND c.ses IS NOT DISTINCT FROM l.ses AND c.s % 4 = l.s % 4 AND c.s > l.s AND c.s < coalesce(l.following, 9223372036854775807) GROUP BY ALL),
    a AS (SELECT seals.*, coalesce(late, checked) AS seen, coalesce(stopped > greatest(coalesce(told, -1), coalesce(sent, -1)), false) AS shut, coalesce(sent > coalesce(told, -1), false) AS waits FROM seals LEFT JOIN late USING (panel, s)),
    f AS (SELECT *, NOT shut AND NOT waits AND told IS NOT NULL AND sent IS NOT NULL AS claimed, {_of('channel', 'told')} AS channel FROM a)
    SELECT panel, s AS seq, {_of('task', 'ses')} AS task, s % 4 + 1 AS step, v AS e2e_ms, {_of('kind', 'backend')} AS backend, {_of('model', 'backend')} AS backend_model, frame IS NOT NULL AS captured,
        coalesce(frame % 1000, 0) AS frame_bytes, coalesce(vision % 6, 0) AS vision_detections, coalesce(merged % 5, 0) AS pii_regions, coalesce(redacted % 7, 0) AS redactions_applied, coalesce(redacted % 9, 0) AS redactions_detected,
        coalesce(redacted % 2, 0) AS forgeries_stripped, {_of('risk', 'redacted')} AS residual_risk, coalesce(baked % 8, 0) AS pixel_ops_requested, coalesce(baked % 7, 0) AS pixel_ops_applied, coalesce(baked % 3, 0) AS pixel_ops_outside,
        CASE WHEN analysed IS NULL THEN 'not-run' ELSE 'ran' END AS analysis, coalesce(analysed % 11, 0) AS metrics_sent,
        CASE WHEN gate IS NULL THEN 'not-checked' WHEN gate % 5 = 0 THEN 'blocked' ELSE 'verified-absent' END AS raw_content, CASE WHEN gate IS NULL THEN 0 WHEN gate % 5 > 0 THEN gate % 30 END AS checked_fields, coalesce(gate % 4, 0) AS leaks,
        CASE WHEN shut THEN 'blocked' WHEN NOT claimed THEN 'not-checked' WHEN channel = 'cloud' THEN 'sent' ELSE 'stayed-on-device' END AS context, CASE WHEN claimed THEN sent % 1000 END AS context_bytes,
        CASE WHEN shut THEN 'blocked' WHEN sent % 2 = 0 THEN 'verified-absent' WHEN NOT claimed THEN 'not-checked' WHEN channel = 'cloud' THEN 'sent' ELSE 'stayed-on-device' END AS screenshot,
        {_of('model', 'told')} AS model_answered, {_of('action', 'acted')} AS action, {_of('ref', 'acted')} AS action_ref, CASE WHEN refused IS NOT NULL THEN 'fail' WHEN acted IS NOT NULL THEN 'pass' ELSE 'not-reached' END AS validation,
        CASE WHEN acted IS NULL THEN 'not-reached' WHEN acted % 6 = 0 THEN 'withheld' WHEN acted % 3 > 0 THEN 'pass' ELSE 'fail' END AS execution,
        CASE WHEN seen IS NULL THEN 'not-checked' WHEN seen % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS verification
    FROM f
"""


@query(_SQL_RECEIPTS)
def h2_sealed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.receipts(_events(spark, sf_dir))


_STAGES = {"capture_ms": "frame/captured", "vision_ms": "vision/done", "redact_ms": "redaction/done", "bake_ms": "bake/done", "server_ms": "server/response", "execute_ms": "action/executed", "e2e_ms": "step/done"}
_SQL_SESSIONS = f"""{_SQL_PLACED},
    h AS (SELECT *, max(s) FILTER (type = 'backend/selected' AND health IS NOT NULL AND s % 2 <> health % 2) OVER (PARTITION BY panel ORDER BY s) AS ended FROM b),
    g AS (SELECT panel, ses, count(*) FILTER (type = 'action/executed') AS acts, count(*) FILTER (type = 'step/done') AS steps, count(*) FILTER (type = 'error') AS errors, sum(s % 6) FILTER (type = 'vision/done') AS boxes,
            sum(s % 7) FILTER (type = 'redaction/done') AS applied, sum(s % 2) FILTER (type = 'redaction/done') AS forged, {', '.join(f"arg_max(v, s) FILTER (type = '{t}') AS {n}" for n, t in _STAGES.items())},
            max(s) FILTER (type = 'context/sent') AS sent, max(s) FILTER (type = 'error' AND s % 2 = 0) AS refused, max(s) FILTER (type = 'frame/captured') AS frame, max(s) FILTER (type = 'action/executed') AS acted,
            max(backend) AS backend, max(health) AS health, max(ended) AS ended FROM h GROUP BY ALL)
    SELECT panel, ses AS session, {_of('task', 'ses')} AS task, {_of('goal', 'ses')} AS goal, ses IS NOT NULL AS running, CASE WHEN ses IS NULL THEN 0 ELSE acts END AS actions, steps, errors, CAST(0 AS BIGINT) AS backend_errors,
        CAST(coalesce(boxes, 0) AS BIGINT) AS detections, CAST(coalesce(applied, 0) AS BIGINT) AS redactions, CAST(coalesce(forged, 0) AS BIGINT) AS forgeries_stripped, {', '.join(_STAGES)}, {_of('elements', 'sent')} AS elements, {_of('budget', 'sent')} AS token_budget,
        CASE WHEN refused > coalesce(frame, -1) THEN concat('m', refused % 100) END AS last_refusal, CAST(NULL AS VARCHAR) AS unavailable, CAST(NULL AS VARCHAR) AS loop_reason, CAST(NULL AS BIGINT) AS loop_step,
        {_of('action', 'acted')} AS last_action, {_of('ok', 'acted')} AS last_ok, {_of('kind', 'backend')} AS backend, CASE WHEN ended IS NULL OR ended < health THEN {_of('reachable', 'health')} END AS reachable
    FROM g
"""


@query(_SQL_SESSIONS)
def h1_panel_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sessions(_events(spark, sf_dir))


_SQL_TIMELINE = f"""{_SQL_PLACED},
    n AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY s DESC) AS n, max(ses) OVER (PARTITION BY panel) AS started FROM b)
    SELECT panel, s AS seq,
        CASE type WHEN 'session/start' THEN 'session' WHEN 'frame/captured' THEN 'capture' WHEN 'vision/done' THEN 'vision' WHEN 'detections/merged' THEN 'merge' WHEN 'redaction/done' THEN 'redaction' WHEN 'bake/done' THEN 'bake'
            WHEN 'context/sent' THEN 'sent' WHEN 'context/transmitted' THEN CASE WHEN s % 2 = 0 THEN 'privacy gate' ELSE 'local planner' END WHEN 'privacy/verified' THEN 'egress gate' WHEN 'page/verified' THEN 'page check'
            WHEN 'action/executed' THEN 'action' WHEN 'step/done' THEN concat('step ', s % 4 + 1) WHEN 'backend/selected' THEN 'backend' WHEN 'backend/health' THEN 'backend health' ELSE CASE WHEN s % 2 = 0 THEN 'validate' ELSE 'plan' END END AS label,
        CASE type WHEN 'session/start' THEN 'g' WHEN 'frame/captured' THEN concat(s % 1000, ' bytes in ', CAST(round(v) AS BIGINT), ' ms') WHEN 'vision/done' THEN concat(s % 6, ' boxes') WHEN 'detections/merged' THEN concat(s % 5, ' regions')
            WHEN 'redaction/done' THEN concat(s % 7, ' of ', s % 9, ' applied, risk ', CASE WHEN s % 2 = 0 THEN 'none' ELSE 'low' END) WHEN 'bake/done' THEN concat(s % 7, ' of ', s % 8, ' pixel operations, ', s % 3, ' outside')
            WHEN 'context/sent' THEN concat(s % 40, ' of ', s % 41, ' elements, ', s % 1000, ' bytes') WHEN 'context/transmitted' THEN concat('m', s % 3) WHEN 'privacy/verified' THEN CASE WHEN s % 5 = 0 THEN concat('blocked: r', s % 4) ELSE concat(s % 30, ' fields scanned') END
            WHEN 'page/verified' THEN concat('step ', s % 4 + 1, ': ', CASE WHEN s % 2 = 0 THEN 'changed' ELSE 'unchanged' END) WHEN 'action/executed' THEN concat('click e', s % 12, CASE WHEN s % 3 > 0 THEN ' ok' ELSE ' failed' END)
            WHEN 'step/done' THEN concat(CASE WHEN s % 3 > 0 THEN 'ok' ELSE 'failed' END, ' in ', CAST(round(v) AS BIGINT), ' ms') WHEN 'backend/selected' THEN concat('k', s % 2, ' e m', s % 3)
            WHEN 'backend/health' THEN concat('k', s % 2, CASE WHEN s % 3 = 0 THEN ': connected' ELSE ': unavailable' END) ELSE concat('m', s % 100) END AS detail,
        CASE WHEN type IN ('redaction/done', 'bake/done') THEN 'redaction' WHEN type = 'context/sent' THEN CASE WHEN s % 40 = s % 41 THEN 'info' ELSE 'warn' END WHEN type = 'context/transmitted' THEN CASE WHEN s % 2 = 0 THEN 'sent' ELSE 'redaction' END
            WHEN type = 'privacy/verified' THEN CASE WHEN s % 5 = 0 THEN 'error' ELSE 'redaction' END WHEN type = 'page/verified' THEN CASE WHEN s % 2 = 0 THEN 'info' ELSE 'warn' END WHEN type = 'action/executed' THEN 'action'
            WHEN type = 'step/done' THEN CASE WHEN s % 3 > 0 THEN 'info' ELSE 'error' END WHEN type = 'backend/health' THEN CASE WHEN s % 3 = 0 THEN 'info' ELSE 'error' END WHEN type = 'error' THEN 'error' ELSE 'info' END AS kind
    FROM n WHERE n <= 200 AND (started IS NULL OR s >= started)
"""


@query(_SQL_TIMELINE)
def h1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.timeline(_events(spark, sf_dir))
