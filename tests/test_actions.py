import math

from pyspark.sql import functions as F

from loomsift.operators import actions, reports
from loomsift.operators import table_stats as S
from loomsift.sources import fixtures


def test_json_objects_ignore_braces_in_strings():
    assert actions.json_objects('x {"a":"}{"} y {"b":{"c":1}} "{" {"d":"\\"}"}') == ['{"a":"}{"}', '{"b":{"c":1}}', '{"d":"\\"}"}']


def test_parse_and_refuse(spark):
    cases = {
        '{"type":"click","ref":"e1"}': ("ok", None), '{"action":{"type":"type","ref":"e2","text":"x"}}': ("ok", None), '{"type":"type","ref":"e3","text":"x"}': ("ok", "sensitive-target"), '{"type":"type","ref":"e1","text":"x"}': ("ok", "not-typeable"),
        '{"type":"click","ref":"e9"}': ("ok", "unknown-ref"), '{"type":"scroll","direction":"up","amountPx":6000}': ("ok", "scroll-too-far"), '{"type":"wait","ms":20000}': ("ok", "wait-too-long"), '{"type":"ask_user","question":"Your password?"}': ("ok", "asks-for-credential"),
        '{"type":"navigate","url":"https://ok.org/x"}': ("ok", None), '{"type":"navigate","url":"https://no.org"}': ("ok", "origin-not-allowed"), '{"type":"navigate","url":"ftp://ok.org"}': ("ok", "bad-url"), '{"type":"click","target":{"text":"Go"}}': ("ok", "no-such-target"),
        "": ("empty-input", "empty-input"), "hello": ("no-json-found", "no-json-found"), "{bad}": ("malformed-json", "malformed-json"), '{"type":"fly"}': ("unknown-type", "unknown-type"), '{"x":1}': ("not-an-object", "not-an-object"), '{"type":"click"}': ("missing-field", "missing-field"),
        '{"type":"key","key":"F1"}': ("bad-field-type", "bad-field-type"), '{"type":"wait","ms":-1}': ("out-of-range", "out-of-range"), '{"type":"done","summary":"a"}{"type":"done","summary":"b"}': ("multiple-actions", "multiple-actions"),
    }
    df = actions.parse_actions(spark.createDataFrame([(k,) for k in cases], "text string"))
    lists = [F.array(*map(F.lit, x)) for x in (("e1", "e2", "e3"), ("e3",), ("e2", "e3"), ("https://ok.org",))]
    got = {r.text: (r.action.code, r.why) for r in df.withColumn("why", actions.refusal(F.col("action"), *lists)).collect()}
    assert got == cases


def test_output_that_no_parser_bears(spark):
    long, deep = '{"type":"wait","ms":1' + "0" * 400 + "}", '{"type":"wait","x":' + "[" * 60_000 + "]" * 60_000 + "}"
    cases = {long: "out-of-range", deep: "malformed-json", '{"type":"wait","ms":-1' + "0" * 400 + "}": "out-of-range", '{"type":"wait","ms":1e999}': "bad-field-type", "{" * 30_000 + "}" * 30_000: "malformed-json", deep + '{"type":"wait","ms":5}': "ok"}
    got = {r.text: r.action.code for r in actions.parse_actions(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases


def test_report(spark):
    log = fixtures.telemetry(spark, 300)
    numbers = ["altitude_m", "velocity_ms", "fuel_pct"]
    cells = S.cells_of(log.withColumn("t", F.lit(1)), ["t"], "sample", [*numbers, "contact"])
    values = S.typed(cells)
    stats = S.summarize(values, ["t", "label"], "value").where("n >= 5")
    trends = S.trends(values, ["t", "label"], "row_idx", "value").where("n >= 5")
    wide = log.withColumn("t", F.lit(1)).select("t", *[F.col(c).try_cast("double").alias(c) for c in numbers])
    links = S.correlations(wide, ["t"], numbers)
    odd = S.outliers(values, ["t", "label"], "row_idx", "value")
    ahead = S.forecasts(values, ["t", "label"], "row_idx", "value")
    lines = reports.render(["t"], stats, trends, links, odd, ahead).first().lines
    assert any(x.startswith("correlation altitude_m ~ fuel_pct r=-") for x in lines) and any(x.startswith("trend altitude_m rising") for x in lines)
    summary = reports.summarize_analysis(S.profile_columns(cells, ["t"]), {"stats": (stats, ["mean", "sd"]), "links": (links, ["r"])}, ["t"]).first()
    assert (summary.state, summary.metrics, summary.raw_records) == ("analysed", 2 * 3 + 3, 0)


def test_fixtures(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "a.truth.json").write_text('{"id": "a"}')
    assert fixtures.load_fixtures(spark, str(tmp_path)).first().truth == '{"id": "a"}'
    rows = fixtures.check_budgets(spark.createDataFrame([("q", 500.0, 1.0), ("r", 1.0, 1.0)], "label string, ms double, mb double"), spark.createDataFrame([("q", 100.0, 1.0), ("r", 100.0, 1.0)], "label string, max_ms double, max_mb double"))
    assert [r.label for r in rows.collect()] == ["q"]
    assert spark.range(1).select(fixtures.request_body("id")).first()[0] == '{"id":0}'
    nodes = spark.createDataFrame([(1, 0, "html"), (1, 1, "p")], "page_id long, node_ord int, path string")
    got = {r.path: r.rect for r in fixtures.stamp_rects(nodes, spark.createDataFrame([(1, 1, 0.5, 1.0, 2.2, 3.0)], "page_id long, node_ord int, x double, y double, width double, height double")).collect()}
    assert got == {"html": None, "p": "0,1,3,3"} and math.isclose(1, 1)


def test_all_conversations_are_parsed(spark, tmp_path):
    from loomsift.plans import catalog

    texts = [
        (None, "empty-input"),
        (" ", "empty-input"),
        ("no braces", "no-json-found"),
        ('so {"type": "click", "ref": "e1"} it is', "ok"),
        ('{"type": "click"}', "missing-field"),
        ('{"type": "fly"}', "unknown-type"),
        ("{not json}", "malformed-json"),
        ('{"type": "done", "summary": "a"} {"type": "wait"}', "multiple-actions"),
        ('{"type": "wait", "ms": 1e9}', "out-of-range"),
    ]
    rows = [(k, k % 2, t) for k, (t, _) in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.QUERIES["n6_parse_all_actions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, k % 2, code) for k, (_, code) in enumerate(texts)]


def test_a_question_splits_its_candidates_once(spark):
    from loomsift.operators import elements

    rows = spark.createDataFrame([(["Add A to cart", "Add B to cart"],), (["Open", "Open"],), (["x y", "x  z", "x "],), ([],), (None,)], "c array<string>").repartition(2)
    asked = rows.select("c", elements.question(F.col("c")).alias("said"))
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {None if r.c is None else tuple(r.c): r.said for r in asked.collect()} == {
        ("Add A to cart", "Add B to cart"): "Which one did you mean - A, or B? (both on: Add to cart)", ("Open", "Open"): "Which one did you mean - Open, or Open?", ("x y", "x  z", "x "): "Which one did you mean - x y, or x  z, or x ?", (): "Which one did you mean - ?", None: None,
    }
