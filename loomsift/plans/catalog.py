"""Queries over whole tables by name, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsift.functions import cells as C
from loomsift.functions import geometry as G
from loomsift.functions import pii
from loomsift.functions import text as T
from loomsift.operators import actions, detections, egress, elements, scoring, spans
from loomsift.operators import table_stats as S
from loomsift.sources import html
from loomsift.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the session's shuffle partitions: few bytes are read by few tasks, however much work each row makes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def r(c: Column | str, places: int = 4) -> Column:
    """Rounded, so that the order of a sum doesn't show; no negative zero."""
    return F.round(c, places) + F.lit(0.0)


# Table statistics


@query("""
    SELECT event_type, count(value) AS n, round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max, round(sum(value), 4) + 0.0 AS sum, round(avg(value), 4) + 0.0 AS mean,
        round(median(value), 4) + 0.0 AS median, round(stddev_samp(value), 4) + 0.0 AS sd, round(quantile_cont(value, 0.25), 4) + 0.0 AS p25, round(quantile_cont(value, 0.75), 4) + 0.0 AS p75
    FROM events GROUP BY event_type HAVING count(value) >= 5
""")
def a9_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.summarize(table(spark, sf_dir, "events"), ["event_type"], "value").where("n >= 5")
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("min", "max", "sum", "mean", "median", "sd", "p25", "p75")])


@query("""
    WITH f AS (
        SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
            stddev_samp(l_extendedprice) AS sd, max(l_quantity) - min(l_quantity) AS span
        FROM lineitem GROUP BY l_suppkey
    )
    SELECT l_suppkey, n, round(slope, 4) + 0.0 AS slope, round(intercept, 2) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2,
        CASE WHEN slope IS NULL OR isnan(slope) THEN NULL WHEN coalesce(sd, 0) <> 0 AND abs(slope) * (CASE WHEN span = 0 THEN 1 ELSE span END) < 0.5 * sd THEN 'flat' WHEN slope > 0 THEN 'rising' WHEN slope < 0 THEN 'falling' ELSE 'flat' END AS direction
    FROM f WHERE n >= 2
""")
def a12_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.trends(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").where("n >= 2")
    return out.select("l_suppkey", "n", r("slope").alias("slope"), r("intercept", 2).alias("intercept"), r("r2", 6).alias("r2"), "direction")


@query("""
    WITH c AS (
        SELECT l_returnflag, 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1
        UNION ALL SELECT l_returnflag, 'l_quantity', 'l_discount', count(*), corr(l_quantity, l_discount) FROM lineitem GROUP BY 1
        UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_discount', count(*), corr(l_extendedprice, l_discount) FROM lineitem GROUP BY 1
    )
    SELECT l_returnflag, col_a, col_b, n, round(r, 6) + 0.0 AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END AS strength
    FROM c WHERE n >= 3
""")
def a14_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.correlations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("l_returnflag", "col_a", "col_b", "n", r("r", 6).alias("r"), "strength")


@query("""
    WITH c AS (SELECT l_suppkey, count(*) AS n, corr(l_discount, l_tax) AS r FROM lineitem GROUP BY 1)
    SELECT l_suppkey, 'l_discount' AS col_a, 'l_tax' AS col_b, n, round(r, 6) + 0.0 AS r FROM c WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r)
""")
def a14a_correlations_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A supplier may have two lines of one number, so what is paired takes part in their order: then rows that tie are alike.
    rows = table(spark, sf_dir, "lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber", "l_discount", "l_tax"))
    values = S.cells_of(rows, ["l_suppkey"], "row", ["l_discount", "l_tax"]).withColumn("value", C.parse_number("text"))
    out = S.correlations_by_position(values, ["l_suppkey"], "label", "row_idx", "value")
    return out.select("l_suppkey", "col_a", "col_b", "n", r("r", 6).alias("r"))


@query("""
    WITH m AS (SELECT event_type, median(value) AS med, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
    o AS (SELECT e.*, med, abs(value - med) AS off FROM events e JOIN m USING (event_type) WHERE value IS NOT NULL AND n >= 4),
    s AS (SELECT event_type, median(off) AS mad, avg(off) AS mean_off FROM o GROUP BY 1),
    z AS (SELECT event_type, event_id AS row_idx, (value - med) / (CASE WHEN mad = 0 THEN nullif(mean_off, 0) * 1.253314 ELSE mad / 0.6745 END) AS z FROM o JOIN s USING (event_type)),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY row_idx) AS k FROM z WHERE abs(z) >= 3.5)
    SELECT event_type, row_idx, round(z, 4) + 0.0 AS z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM k WHERE k <= 10
""")
def a10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.outliers(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")
    return out.select("event_type", "row_idx", r("z").alias("z"), "direction")


_RANKED = """
    WITH b AS (
        SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
            value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step
        FROM events WHERE value IS NOT NULL
    ), w AS (SELECT *, greatest(2, n // 3) AS w FROM b)
"""


@query(_RANKED + """
    , a AS (
        SELECT user_id, n, w, max(v) FILTER (i = 0) AS first, max(v) FILTER (i = n - 1) AS last, avg(v) AS mean, coalesce(stddev_samp(step), 0) AS volatility, avg(v) FILTER (i >= n - w) AS moving_average,
            max(v) FILTER (i = n - w) AS rf, max(v) FILTER (i = greatest(0, n - 2 * w)) AS pf, max(v) FILTER (i = n - w - 1) AS pl,
            count(*) FILTER (i >= greatest(0, n - 2 * w) AND i < n - w) AS np, regr_r2(v, i) AS r2
        FROM w WHERE n >= 2 GROUP BY 1, 2, 3
    ), m AS (
        SELECT *, (last - rf) / (w - 1) AS rr, CASE WHEN np >= 2 THEN (pl - pf) / (np - 1) ELSE (last - rf) / (w - 1) END AS pr FROM a
    ), s AS (SELECT *, CASE WHEN volatility = 0 THEN abs(pr) * 0.05 ELSE volatility END AS scale, volatility / nullif(abs(mean), 0) * 100 AS pct FROM m)
    SELECT user_id, n, round((last - first) / nullif(abs(first), 0) * 100, 3) + 0.0 AS change_percent, round((last - first) / (n - 1), 4) + 0.0 AS rate_of_change, round(volatility, 4) + 0.0 AS volatility,
        CASE WHEN pct >= 15 THEN 'high' WHEN pct >= 4 THEN 'medium' ELSE 'low' END AS band, CASE WHEN scale = 0 OR abs(rr - pr) < scale THEN 'steady' WHEN rr > pr THEN 'accelerating' ELSE 'decelerating' END AS momentum,
        round(moving_average, 4) + 0.0 AS moving_average, CAST(w AS BIGINT) AS window, round(sqrt(r2), 5) + 0.0 AS trend_strength
    FROM s
""")
def a13_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.time_series(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")
    return out.select("user_id", "n", r("change_percent", 3).alias("change_percent"), r("rate_of_change").alias("rate_of_change"), r("volatility").alias("volatility"), "band", "momentum", r("moving_average").alias("moving_average"), "window", r("trend_strength", 5).alias("trend_strength"))


@query(_RANKED + f"""
    , t AS (SELECT unnest([{', '.join(map(str, S.T_95))}]) AS q, unnest(range(1, 31)) AS df),
    f AS (
        SELECT user_id, n, regr_slope(v, i) AS slope, regr_intercept(v, i) AS b, regr_r2(v, i) AS r2, regr_sxx(v, i) AS sxx, regr_syy(v, i) AS syy, regr_sxy(v, i) AS sxy, avg(i) AS mx, avg(v) FILTER (i >= n - 5) AS tail
        FROM w WHERE n >= 5 GROUP BY 1, 2
    ), h AS (
        SELECT f.*, CASE WHEN n - 2 > 30 THEN 1.96 ELSE q END * CASE WHEN greatest(syy - slope * sxy, 0) > syy * 1e-12 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2)) END * sqrt(1 + 1 / n + (n - mx) * (n - mx) / sxx) AS half
        FROM f LEFT JOIN t ON t.df = n - 2
    )
    SELECT user_id, n, round(CASE WHEN r2 >= 0.25 THEN slope * n + b ELSE tail END, 4) + 0.0 AS next, round(CASE WHEN r2 >= 0.25 THEN slope * n + b - half END, 4) + 0.0 AS lower, round(CASE WHEN r2 >= 0.25 THEN slope * n + b + half END, 4) + 0.0 AS upper,
        CASE WHEN r2 >= 0.25 THEN 'linear-least-squares' ELSE 'moving-average' END AS method
    FROM h
""")
def a15_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.forecasts(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")
    return out.select("user_id", "n", r("next").alias("next"), r("lower").alias("lower"), r("upper").alias("upper"), "method")


def _dressed() -> Column:
    """Prices as tables write them, by order."""
    p = F.format_string("%.2f", "o_totalprice")
    k = F.col("o_orderkey") % 8
    return F.when(k == 0, F.concat(F.lit("$"), p)).when(k == 1, F.concat(p, F.lit(" %"))).when(k == 2, F.concat(F.lit("("), p, F.lit(")"))).when(k == 3, "n/a").when(k == 4, F.replace(p, F.lit("."), F.lit(","))).when(k == 5, F.concat(F.lit("  ₹ "), p)).when(k == 6, "1,234,567.5").otherwise(p)


@query("""
    SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN -CAST(printf('%.2f', o_totalprice) AS DOUBLE) WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 6 THEN 1234567.5 ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS value, o_orderkey % 8 = 3 AS missing
    FROM orders
""")
def a2_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("text", _dressed())
    return rows.select("o_orderkey", C.parse_number("text").alias("value"), C.is_missing("text").alias("missing"))


@query("""
    WITH c AS (
        SELECT 0 AS col_idx, 'l_returnflag' AS label, l_returnflag AS t FROM lineitem UNION ALL SELECT 1, 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
        UNION ALL SELECT 2, 'l_quantity', CAST(l_quantity AS VARCHAR) FROM lineitem UNION ALL SELECT 3, 'l_linestatus', l_linestatus FROM lineitem
    ), g AS (
        SELECT col_idx, label, count(*) AS n_rows, count(*) FILTER (regexp_full_match(t, '[0-9]+(\\.[0-9]+)?')) AS n_numeric, count(DISTINCT t) AS d FROM c GROUP BY ALL
    )
    SELECT col_idx, label, n_rows, CAST(0 AS BIGINT) AS n_missing, n_numeric, n_rows - n_numeric AS n_unparsed, CASE WHEN d <= 64 THEN d END AS n_distinct, CASE WHEN n_numeric >= 0.8 * n_rows THEN 'numeric' WHEN d <= greatest(2, n_rows / 4) AND d <= 64 THEN 'categorical' ELSE 'unknown' END AS kind
    FROM g
""")
def a5_profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    out = S.profile_columns(S.cells_of(rows, ["one"], "l_orderkey", ["l_returnflag", "l_linenumber", "l_quantity", "l_linestatus"]), ["one"])
    return out.select("col_idx", "label", "n_rows", "n_missing", "n_numeric", "n_unparsed", "n_distinct", "kind")


# Personal data in texts

#: Patterns as RE2 has them, whose \b is ASCII; Luhn's check as list functions.
_SQL_RULES = " UNION ALL ".join(f"SELECT '{x.name}' AS rule, sum(len(regexp_extract_all(text, '{x.pattern}'))) AS n FROM documents" for x in pii.RULES)


@query(f"SELECT rule, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ({_SQL_RULES})")
def b1_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each rule before its check."""
    docs = table(spark, sf_dir, "documents").select("text")
    item = F.array(*[F.struct(F.lit(x.name).alias("rule"), F.when(F.col("text").rlike(x.needs), F.regexp_count("text", F.lit(pii.java_pattern(x)))).alias("n")) for x in pii.RULES])
    return docs.select(F.explode(item).alias("x")).groupBy("x.rule").agg(F.coalesce(F.sum("x.n"), F.lit(0)).alias("n"))


@query("""
    WITH m AS (SELECT source, unnest(regexp_extract_all(text, '\\b(?:\\d[ -]?){12,18}\\d\\b')) AS v FROM documents),
    d AS (SELECT source, reverse(regexp_replace(v, '[^0-9]', '', 'g')) AS v FROM m),
    s AS (SELECT source, len(v) AS n, list_sum([CASE WHEN i % 2 = 1 THEN CAST(v[i] AS INT) ELSE CAST(v[i] AS INT) * 2 - CASE WHEN CAST(v[i] AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, len(v) + 1)]) AS total FROM d)
    SELECT source, count(*) AS n FROM s WHERE n BETWEEN 12 AND 19 AND total % 10 = 0 GROUP BY source
""")
def b2_valid_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rule = next(x for x in pii.RULES if x.kind == "credit-card")
    return docs.select("source", F.size(pii.matches("text", rule)).alias("n")).where("n > 0").groupBy("source").agg(F.sum("n").alias("n"))


def _sql_checks() -> str:
    """Does match v of a rule pass its check? Digits, the last first, are in r."""
    turn = "CASE WHEN a < 5 THEN (a + b) % 5 ELSE (a - b + 5) % 5 END + CASE WHEN (a < 5) = (b < 5) THEN 0 ELSE 5 END"
    powers = ", ".join(str(list(row)) for row in pii.verhoeff_powers())
    moved = f"[[{powers}][(i - 1) % 8 + 1][CAST(r[i] AS INT) + 1] FOR i IN range(1, len(r) + 1)]"
    return f"""CASE rule
        WHEN 'luhn-credit-card' THEN len(r) BETWEEN 12 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(r[i] AS INT) ELSE CAST(r[i] AS INT) * 2 - CASE WHEN CAST(r[i] AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, len(r) + 1)]) % 10 = 0
        WHEN 'verhoeff-aadhaar' THEN len(r) = 12 AND list_reduce(list_prepend(0, {moved}), lambda a, b: {turn}) = 0
        WHEN 'pan-format' THEN regexp_full_match(v, '[A-Z]{{3}}[{pii.PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]')
        WHEN 'ssn-us' THEN left(v, 3) NOT IN ('000', '666') AND left(v, 1) <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000'
        WHEN 'ipv4' THEN list_max([CAST(x AS INT) FOR x IN string_split(v, '.')]) <= 255
        ELSE true END"""


def _sql_spans(name: str, texts: str) -> str:
    """CTE `name` (id, kind, rule, start, end, confidence): all spans of the texts (id, text)."""
    rules = " UNION ALL ".join(f"SELECT id, {i} AS k, '{x.kind}' AS kind, '{x.name}' AS rule, CAST({x.validated if x.check else x.confidence} AS DOUBLE) AS confidence, regexp_extract_all(text, '{x.pattern}') AS hits, string_split_regex(text, '{x.pattern}') AS gaps FROM {texts}" for i, x in enumerate(pii.RULES))
    return f"""{name}_each AS (SELECT id, k, kind, rule, confidence, unnest(hits) AS v, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM ({rules}) WHERE len(hits) > 0),
    {name}_at AS (SELECT *, reverse(regexp_replace(v, '[^0-9]', '', 'g')) AS r, CAST(sum(len(gap) + len(v)) OVER (PARTITION BY id, k ORDER BY i) AS BIGINT) AS "end" FROM {name}_each),
    {name} AS (SELECT id, kind, rule, "end" - len(v) AS start, "end", confidence FROM {name}_at WHERE {_sql_checks()})"""


def _sql_resolved(name: str, spans: str) -> str:
    """CTE `name` (id, kept): the spans of each text without overlaps, in order."""
    free = 'len(list_filter(acc, lambda k: k.start < x."end" AND x.start < k."end")) = 0'
    return f"""{name}_all AS (SELECT id, list({{'kind': kind, 'rule': rule, 'start': start, 'end': "end", 'confidence': confidence}} ORDER BY confidence DESC, "end" - start DESC, start, rule) AS s FROM {spans} GROUP BY id),
    {name} AS (SELECT id, list_sort(list_transform(list_reduce(list_transform(s, lambda y: [y]), lambda acc, z: list_concat(acc, list_filter(z, lambda x: {free}))), lambda y: {{'start': y.start, 's': y}})) AS kept FROM {name}_all)"""


_SQL_CLEAN = "t AS (SELECT doc_id AS id, regexp_replace(text, '\\[\\[PII:[A-Z_]+:\\d+:[0-9a-f]*\\]\\]', '', 'g') AS text, coalesce(len(regexp_extract_all(text, '\\[\\[PII:[A-Z_]+:\\d+:[0-9a-f]*\\]\\]')), 0) AS forged FROM documents)"
_SQL_REDACTED = f"""WITH {_SQL_CLEAN}, {_sql_spans('m', 't')}, {_sql_resolved('o', 'm')},
    h AS (SELECT t.*, coalesce(list_transform(list_filter(kept, lambda y: y.s.confidence >= 0.5), lambda y: y.s), []) AS e FROM t LEFT JOIN o USING (id)),
    d AS (SELECT id, forged, len(e) AS n, CASE WHEN len(e) = 0 THEN text ELSE
        list_aggregate(list_transform(e, lambda x, i: substr(text, 1 + CASE WHEN i = 1 THEN 0 ELSE e[i - 1]."end" END, x.start - CASE WHEN i = 1 THEN 0 ELSE e[i - 1]."end" END) || '[[PII:' || upper(replace(x.kind, '-', '_')) || ':' || CAST(1 + len(list_filter(e, lambda k: k.kind = x.kind AND k.start > x.start)) AS VARCHAR) || ':5eed]]'), 'string_agg', '') || substr(text, 1 + e[-1]."end") END AS text FROM h)"""


def _sql_left(texts: str, name: str) -> str:
    """CTE `name` (id, n): findings at or over 0.5, foreign placeholders and markup of the texts (id, text)."""
    bare = f"{name}_bare AS (SELECT id, regexp_replace(text, '\\[\\[PII:[A-Z_]+:\\d+:[0-9a-f]*\\]\\]', '', 'g') AS text FROM {texts})"
    odd = "coalesce(len(list_filter(regexp_extract_all(text, '\\[\\[PII:[A-Z_]+:\\d+:[0-9a-f]*\\]\\]'), lambda x: NOT ends_with(x, ':5eed]]'))) + len(regexp_extract_all(text, '(?i)<\\s*(?:" + "|".join(spans.MARKUP_TAGS) + ")\\b')), 0)"
    return f"""{bare}, {_sql_spans(name + '_s', name + '_bare')}, {name}_c AS (SELECT id, count(*) AS c FROM {name}_s WHERE confidence >= 0.5 GROUP BY id),
    {name} AS (SELECT x.id, CAST({odd} + coalesce(c, 0) AS BIGINT) AS n FROM {texts} x LEFT JOIN {name}_c USING (id))"""


@query(f"WITH r AS (SELECT doc_id AS id, text FROM documents), {_sql_spans('m', 'r')}, {_sql_resolved('o', 'm')} SELECT id AS doc_id, s.kind AS kind, s.rule AS rule, s.start AS start, s.\"end\" AS \"end\", s.confidence AS confidence FROM (SELECT id, unnest(list_transform(kept, lambda y: y.s)) AS s FROM o)")
def b14_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.scan_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query(_SQL_REDACTED + " SELECT id AS doc_id, CAST(n AS BIGINT) AS n, CAST(forged AS BIGINT) AS forgeries, text FROM d")
def c8_redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.redact_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", nonce="5eed")
    return out.select("doc_id", "redaction.n", "redaction.forgeries", "text")


@query(_SQL_REDACTED + f", w AS (SELECT doc_id AS id, text FROM documents), {_sql_left('w', 'before')}, {_sql_left('d', 'after')} SELECT id AS doc_id, b.n AS n_before, a.n AS n_after, a.n = 0 AS ok FROM before b JOIN after a USING (id)")
def e7_verify_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at or over the threshold in texts before and after redaction; the redactor's own count plays no part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    out = spans.redact_texts(docs, "doc_id", "text", nonce="5eed")
    count = lambda c: F.aggregate(spans.text_leaks(c, "5eed"), F.lit(0).cast("long"), lambda a, f: a + f["n"])
    return out.select("doc_id", count("before").alias("n_before"), count("text").alias("n_after")).withColumn("ok", F.col("n_after") == 0)


@query("SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS url FROM pages")
def c11_sanitize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_url("url").alias("url"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\\x{00}-\\x{1F}\\x{7F}-\\x{9F}]', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def d1_neutralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.neutralize("text").alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^a-zA-Z0-9]') THEN 'mixed' WHEN regexp_matches(text, '[0-9]') AND regexp_matches(text, '[a-zA-Z]') THEN 'alphanumeric' WHEN regexp_matches(text, '[0-9]') THEN 'numeric' WHEN text <> '' THEN 'alpha' ELSE 'unknown' END AS class FROM (SELECT doc_id, split_part(text, ' ', 1) AS text FROM documents)")
def b16_char_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pii.char_class(F.split_part("text", F.lit(" "), F.lit(1))).alias("class"))


# Geometry and scores


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = G.rect(F.col("l_partkey") % 97, F.col("l_orderkey") % 89, F.col("l_quantity") + 1, F.col("l_extendedprice") % 53 + 1)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"), place.alias("rect"), "l_discount")


_SQL_RECTS = """
    WITH x AS (
        SELECT l_suppkey, l_orderkey, l_linenumber, l_orderkey * 16 + l_linenumber AS id, l_discount, CAST(l_partkey % 97 AS DOUBLE) AS x, CAST(l_orderkey % 89 AS DOUBLE) AS y, l_quantity + 1 AS w, l_extendedprice % 53 + 1 AS h
        FROM lineitem
    ), p AS (
        SELECT a.*, b.id AS b_id, b.l_discount AS b_discount, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh, b.l_linenumber AS b_line,
            greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter
"""


@query(_SQL_RECTS + """
        FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    )
    SELECT id, b_id, round(inter / (w * h + bw * bh - inter), 6) + 0.0 AS iou, round(inter / (w * h), 6) + 0.0 AS containment FROM p
""")
def p2_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _rects(spark, sf_dir)
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("id").alias("b_id"), F.col("rect").alias("b"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("id", "b_id", r(G.iou(F.col("rect"), F.col("b")), 6).alias("iou"), r(G.containment(F.col("rect"), F.col("b")), 6).alias("containment"))


@query(_SQL_RECTS + """
        FROM x a LEFT JOIN x b ON a.l_suppkey = b.l_suppkey AND b.l_linenumber % 2 = 1 WHERE a.l_linenumber % 2 = 0
    ), k AS (SELECT l_suppkey, id, b_id, row_number() OVER (PARTITION BY l_suppkey, id ORDER BY CASE WHEN inter / (w * h) >= 0.6 THEN bw * bh END NULLS LAST, b_id) AS k, inter / (w * h) >= 0.6 AS ok FROM p)
    SELECT l_suppkey, id AS det_id, CASE WHEN ok THEN CAST(b_id AS VARCHAR) END AS path FROM k WHERE k = 1
""")
def c1_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    nodes = rows.where("l_linenumber % 2 = 1").select("l_suppkey", F.col("id").alias("node_ord"), F.col("id").cast("string").alias("path"), "rect")
    return detections.attach(rows.where("l_linenumber % 2 = 0").select("l_suppkey", F.col("id").alias("det_id"), "rect"), nodes, ["l_suppkey"]).select("l_suppkey", "det_id", "path").distinct()


@query()
def p5_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _rects(spark, sf_dir).select("l_suppkey", F.col("id").alias("det_id"), F.col("id").alias("ord"), F.lit("face").alias("kind"), F.col("l_discount").alias("confidence"), "rect")
    return detections.suppress(boxes, ["l_suppkey"], 0.3).select("l_suppkey", "det_id", "confidence")


@query(_SQL_RECTS + """
        FROM x a JOIN x b ON a.l_suppkey = b.l_suppkey AND b.l_linenumber % 2 = 1 WHERE a.l_linenumber % 2 = 0
    ), m AS (SELECT l_suppkey, id, min(b_id) AS target FROM p WHERE inter / (w * h + bw * bh - inter) >= 0.5 GROUP BY ALL),
    f AS (SELECT x.l_suppkey, count(*) AS found, count(target) AS hits, count(DISTINCT target) AS tp FROM x LEFT JOIN m USING (l_suppkey, id) WHERE l_linenumber % 2 = 0 GROUP BY 1),
    t AS (SELECT l_suppkey, count(*) AS n FROM x WHERE l_linenumber % 2 = 1 GROUP BY 1),
    s AS (SELECT l_suppkey, coalesce(tp, 0) AS tp, coalesce(hits - tp, 0) AS duplicates, coalesce(found - tp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn FROM f FULL JOIN t USING (l_suppkey)),
    u AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS recall FROM s)
    SELECT l_suppkey, tp, duplicates, fp, fn, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) + 0.0 AS f1 FROM u
""")
def f1_score_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rects(spark, sf_dir)
    none = F.lit(None).cast("string")
    found = rows.where("l_linenumber % 2 = 0").select("l_suppkey", F.col("id").alias("det_id"), F.lit("face").alias("kind"), F.col("l_discount").alias("confidence"), none.alias("path"), none.alias("attr"), "rect")
    truth = rows.where("l_linenumber % 2 = 1").select("l_suppkey", F.col("id").alias("truth_id"), F.col("id").alias("truth_ord"), F.lit("face").alias("kind"), none.alias("path"), none.alias("attr"), "rect", F.lit(True).alias("must_redact"))
    out = scoring.score_detections(found, truth, ["l_suppkey"])
    return out.select("l_suppkey", "tp", "duplicates", "fp", "fn", *[r(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
    WITH p AS (SELECT a.p_partkey, lower(a.p_name) AS a, lower(b.p_name) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    w AS (SELECT *, list_distinct(list_filter(string_split_regex(a, '[^a-z0-9]+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(string_split_regex(b, '[^a-z0-9]+'), lambda x: x <> '')) AS wb FROM p)
    SELECT p_partkey, round(CASE WHEN a = b THEN 1 ELSE len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) END, 6) + 0.0 AS similarity FROM w
""")
def f4_name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    b = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return parts.join(b, "p_partkey").select("p_partkey", r(scoring.name_similarity(F.col("p_name"), F.col("b")), 6).alias("similarity"))


@query("""
    WITH l AS (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n, avg(value) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT event_type, n, s[1] AS min, s[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, s[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95, s[n] AS max, round(mean, 4) + 0.0 AS mean FROM l
""")
def f6_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.distribution(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", "min", "p50", "p95", "max", r("mean").alias("mean"))


BUDGETS = {"peak_heap_mb": (10.0, 45.0), "weights_mb": (0.02, 0.08), "p50_ms": (10_000.0, 60_000.0)}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("candidate_id"), F.col("l_linestatus").alias("backend"), F.col("l_suppkey").alias("fixture_id"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"), (F.col("l_linenumber") % 2 == 0).alias("screenshot_to_server"), (F.col("l_discount") > 0.005).alias("ok"), (F.col("l_discount") * 5).alias("visual_context"), (F.col("l_tax") * 5).alias("pii_f1"), (F.col("l_discount") + F.col("l_tax")).alias("redaction_precision"), F.col("l_quantity").alias("peak_heap_mb"), F.col("l_tax").alias("weights_mb"), F.col("l_extendedprice").alias("p50_ms"))
    return scoring.score_runs(li, BUDGETS)


_SQL_RUNS = """
    WITH s AS (
        SELECT l_returnflag AS candidate_id, l_linestatus AS backend, l_suppkey AS fixture_id, l_orderkey * 16 + l_linenumber AS ord, l_linenumber % 2 = 0 AS shot, l_discount > 0.005 AS ok,
            CASE WHEN l_discount > 0.005 THEN l_discount * 5 * 0.25 + l_tax * 5 * 0.2 + (l_discount + l_tax) * 0.2
                + (CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity >= 45 THEN 0 ELSE 1 - (l_quantity - 10) / 35 END + CASE WHEN l_tax <= 0.02 THEN 1 WHEN l_tax >= 0.08 THEN 0 ELSE 1 - (l_tax - 0.02) / (0.08 - 0.02) END) / 2 * 0.2
                + CASE WHEN l_extendedprice <= 10000 THEN 1 WHEN l_extendedprice >= 60000 THEN 0 ELSE 1 - (l_extendedprice - 10000) / 50000 END * 0.15 ELSE 0 END AS total
        FROM lineitem
    )
"""


@query(_SQL_RUNS + "SELECT candidate_id, backend, round(avg(total), 5) + 0.0 AS total, count(*) AS fixtures, count(*) FILTER (NOT ok) AS failures FROM s GROUP BY ALL")
def f8_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.rank_candidates(_runs(spark, sf_dir))
    return out.select("candidate_id", "backend", r("total", 5).alias("total"), "fixtures", "failures")


@query(_SQL_RUNS + """
    , k AS (SELECT candidate_id, backend, fixture_id, arg_max(total, ord) FILTER (shot) AS on_, arg_max(total, ord) FILTER (NOT shot) AS off_ FROM s GROUP BY ALL)
    SELECT count(*) AS paired, round(avg(on_), 4) + 0.0 AS on_score, round(avg(off_), 4) + 0.0 AS off_score, avg(on_) - avg(off_) > 0.02 AS send FROM k WHERE on_ IS NOT NULL AND off_ IS NOT NULL
""")
def f9_screenshot_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.screenshot_policy(_runs(spark, sf_dir), "ord")
    return out.select("paired", r("on_score").alias("on_score"), r("off_score").alias("off_score"), "send")


# Pages


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a[\\s>]')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<h1[\\s>]')) AS BIGINT) AS titles, CAST(len(regexp_extract_all(html, '<script[\\s>]')) AS BIGINT) AS scripts FROM pages")
def s1_parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = html.dom_nodes(table(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "h1").alias("titles"), F.count_if(F.col("tag") == "script").alias("scripts"))


@query()
def d7_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = elements.extract(html.dom_nodes(table(spark, sf_dir, "pages")))
    return out.select("page_id", "ref", "role", "name", "group_name", F.array_join("states", ",").alias("states"), "path")


@query()
def c0_page_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the texts and attributes of pages, and what their markup says."""
    nodes = html.dom_nodes(table(spark, sf_dir, "pages"))
    found = spans.scan_texts(elements.page_texts(nodes), "key", "text").select("key.*", F.explode("spans").alias("s")).select("page_id", "path", "attr", F.lit("regex").alias("source"), "s.kind", "s.confidence")
    return found.unionByName(elements.markup_detections(nodes).select(found.columns))


@query()
def g3_plan_by_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.extract(html.dom_nodes(table(spark, sf_dir, "pages")))
    goals = found.where("role = 'link'").groupBy("page_id").agg(F.max_by("name", "ord").alias("goal")).select("page_id", F.lit(0).alias("goal_id"), "goal", F.array().cast("array<string>").alias("tried"))
    return elements.plan_by_keywords(found, goals)


@query()
def g4_fit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.fit_budget(elements.extract(html.dom_nodes(table(spark, sf_dir, "pages"))), token_budget=200).select("page_id", "ref", "role", "name")


# Event folds


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 7 == 0, "step/done").when(F.col("event_id") % 7 < 3, "redaction").when(F.col("event_id") % 7 == 3, "error").otherwise("latency")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), (F.col("event_id") % 50).alias("step"), kind.alias("type"), "value")


@query("""
    SELECT CAST(user_id AS VARCHAR) AS task, event_id % 50 AS step, count(*) AS n_events, count(*) FILTER (event_id % 7 IN (1, 2)) AS n_redactions, count(*) FILTER (event_id % 7 = 3) AS n_errors,
        round(coalesce(sum(value) FILTER (event_id % 7 > 3), 0), 4) + 0.0 AS latency_ms, bool_or(event_id % 7 = 0) AS sealed
    FROM events GROUP BY 1, 2
""")
def h1_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.receipts(_task_events(spark, sf_dir)).withColumn("latency_ms", r("latency_ms"))


_SQL_RUNS_OF = """
    WITH n AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n)
    SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY ALL
"""


@query(_SQL_RUNS_OF)
def h6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""
    WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_type, CAST(floor(value / 10) AS BIGINT) AS f FROM events),
    l AS (SELECT *, coalesce(lag(event_type) OVER w = event_type, false) AS rep, coalesce(lag(f) OVER w = f, false) AS stall FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)),
    c AS (SELECT *, step - coalesce(max(step) FILTER (NOT rep) OVER w, 0) AS rn, step - coalesce(max(step) FILTER (NOT stall) OVER w, 0) AS sn FROM l WINDOW w AS (PARTITION BY user_id ORDER BY step)),
    q AS (SELECT user_id, step, CASE WHEN rep AND rn >= 2 THEN 'repeating' WHEN stall AND sn >= 2 THEN 'no-progress' WHEN step >= 8 THEN 'max-steps' END AS reason FROM c)
    SELECT user_id, min(step) AS steps, arg_min(reason, step) AS reason FROM q WHERE reason IS NOT NULL GROUP BY 1
""")
def h6_stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    steps = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).cast("long").alias("step"), F.lit("click").alias("action"), F.col("event_type").alias("key"), F.floor(F.col("value") / 10).alias("fingerprint"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("cancelled"))
    return E.stop_reasons(steps, ["user_id"])


@query("SELECT user_id, event_type, round(sum(value), 4) + 0.0 AS ms, round(coalesce(sum(value) / nullif(sum(sum(value)) OVER (PARTITION BY user_id), 0), 0), 6) + 0.0 AS fraction FROM events GROUP BY 1, 2")
def h4_latency_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("ms"))
    out = E.latency_bars(sums, ["user_id"], "event_type", "ms")
    return out.select("user_id", "event_type", r("ms").alias("ms"), r("fraction", 6).alias("fraction"))


@query()
def h9_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension beside the folds: sessions by event time."""
    return E.session_counts(table(spark, sf_dir, "events"))


# Operators on detections, targets and actions


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction entries made of line items: a page is a supplier."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    return li.select(F.col("l_suppkey").alias("page_id"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("ord"), pick(F.col("l_partkey"), "email", "phone", "face").alias("kind"), pick(F.col("l_orderkey"), "regex", "vision").alias("source"), (F.col("l_linenumber") != 3).alias("applied"), pick(F.col("l_linenumber"), "placeholder", "blur", "remove-node", "drop-attribute").alias("strategy"))


_SQL_ENTRIES = """
    WITH e AS (
        SELECT l_suppkey AS page_id, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS ord, (['email', 'phone', 'face'])[l_partkey % 3 + 1] AS kind, (['regex', 'vision'])[l_orderkey % 2 + 1] AS source, l_linenumber <> 3 AS applied,
            (['placeholder', 'blur', 'remove-node', 'drop-attribute'])[l_linenumber % 4 + 1] AS strategy
        FROM lineitem
    )
"""


@query(_SQL_ENTRIES + "SELECT page_id, kind, max(o) AS last, CAST(sum(o * (ord % 7)) AS BIGINT) AS mixed FROM (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY ord) AS o FROM (SELECT DISTINCT page_id, kind, ord FROM e)) GROUP BY ALL")
def c6_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = detections.ordinals(_entries(spark, sf_dir).select("page_id", "kind", "ord").distinct(), ["page_id"], "ord")
    return numbered.groupBy("page_id", "kind").agg(F.max("ordinal").cast("long").alias("last"), F.sum(F.col("ordinal") * (F.col("ord") % 7)).alias("mixed"))


@query(_SQL_ENTRIES + "SELECT page_id, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS failed, count(*) FILTER (strategy = 'remove-node') AS removed, count(*) FILTER (strategy = 'drop-attribute') AS dropped, count(*) FILTER (applied AND kind = 'email') AS emails, count(*) FILTER (applied AND source = 'vision') AS seen FROM e GROUP BY 1")
def c14_summarize_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detections.summarize_redactions(_entries(spark, sf_dir), ["page_id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("page_id", "applied", "failed", "removed", "dropped", zero(F.col("by_kind")["email"]).alias("emails"), zero(F.col("by_source")["vision"]).alias("seen"))


@query(_SQL_ENTRIES + "SELECT kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies FROM e GROUP BY 1")
def h3_group_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_redactions(_entries(spark, sf_dir)).select("kind", "n", F.array_join("strategies", ",").alias("strategies"))


@query(_SQL_ENTRIES + "SELECT page_id, ord, CASE WHEN kind = 'face' THEN CASE WHEN source = 'vision' THEN 'blur' ELSE 'placeholder' END WHEN strategy = 'drop-attribute' THEN 'placeholder' ELSE 'placeholder' END AS strategy FROM e")
def c5_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    attr = F.when(F.col("strategy") == "drop-attribute", "value")
    out = spans.strategy_for(F.col("kind"), F.col("source") == "vision", F.lit(False), attr)
    return _entries(spark, sf_dir).select("page_id", "ord", out.alias("strategy"))


@query()
def c2_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rects(spark, sf_dir)
    none = F.lit(None).cast("string")
    rows = found.select("l_suppkey", F.col("id").cast("string").alias("det_id"), F.col("id").alias("ord"), F.lit("face").alias("kind"), F.when(F.col("id") % 2 == 0, "vision").otherwise("dom-heuristic").alias("source"), (F.col("l_discount") + 0.5).alias("confidence"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 11)).alias("path"), none.alias("attr"), F.lit(None).cast("int").alias("node_index"), "rect", F.lit("r").alias("rule"))
    return detections.merge(rows, "l_suppkey").select("l_suppkey", "det_id", "confidence", "path")


@query()
def g1_resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of each page's first link, by its text."""
    found = elements.extract(html.dom_nodes(table(spark, sf_dir, "pages")))
    spec = F.create_map(F.lit("role"), F.lit("link"), F.lit("text"), F.col("name"))
    targets = found.where("role = 'link' and name is not null").groupBy("page_id").agg(F.min_by("name", "ord").alias("name")).select("page_id", F.lit(0).alias("target_id"), spec.alias("spec"))
    return elements.resolve_targets(found, targets)


@query()
def n1_ambiguous_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = elements.extract(html.dom_nodes(table(spark, sf_dir, "pages")))
    goals = found.where("role = 'link'").select("page_id", F.col("ord").alias("goal_id"), F.col("name").alias("goal"))
    out = elements.ambiguous_goals(found, goals)
    return out.select("page_id", "goal_id", "term", "role", elements.question(F.col("candidates")).alias("question"))


@query()
def n6_parse_all_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation row, those with JSON too, which SQL can't parse alike."""
    rows = table(spark, sf_dir, "conversations")
    return actions.parse_actions(rows.select("conv_id", "turn", "text")).select("conv_id", "turn", "action.code")
